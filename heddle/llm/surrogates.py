"""Personal data replaced by surrogates, in built-in functions.

Entities are found by one pattern; each has a type and a norm (what stays the same
between its spellings), and each norm gets one surrogate from a keyed hash: digits
for digits and letters for letters, in the format of the place where it stands.  Names
behind a title are taken word by word, the last word as a family name and those before it as
given names: a word has one surrogate everywhere, in its script and, for given names, of the gender
that the titles before it tell wherever they agree.  So "Mr. John Smith", "Dr. Smith" and "Mrs. Ada Smith"
stay one family, and the title itself stays.

The table of distinct norms is checked before use: of norms that draw one surrogate the smallest
keeps it, no surrogate is one already given away or itself found in the corpus, and all other norms
draw again until none is left.  Names grow by a syllable with each draw, and addresses with each draw
after the fourth, so any number of them can be told apart; digits can't grow, and an error says so if
a format runs out (more than ``tries`` draws).  So equal entities have equal surrogates everywhere, and
different ones different.

Only entities are shuffled, and texts only where they have entities.  A value that a third of all texts name is
one row of the table, and is aggregated before it is shuffled.  Patterns repeat groups possessively, so
a match takes no stack, however long the text.

Defined results: null text stays null; texts without entities come back unchanged;
repeated rows and null ids are treated each; extra columns are kept (``replace``) or
ignored (``surrogates``); texts are taken whole, but an address has at most 126 labels, and what
follows them stays; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.plans.durable import materialize

_MALE, _FEMALE = "Mr.|Herr|Monsieur|Señor|Sr.|Г-н", "Mrs.|Ms.|Frau|Madame|Señora|Sra.|Г-жа"
_TITLE = r"(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.|Herr|Frau|Monsieur|Madame|Señora|Señor|Sra\.|Sr\.|Г-н|Г-жа)"
_WORD = r"\p{Lu}(?:[\p{Ll}'’-]|(?<=['’-]|Mc)\p{Lu}){1,40}+"
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,126}+",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": r"(?<![\d.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d])\+\d{8,15}(?!\d)",
    "name": rf"(?<!\p{{L}}){_TITLE} {_WORD}(?: (?!{_TITLE}){_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: a text without it needs no closer look.
SIGN = rf"@|\d[ ().\d-]{{5}}|\d{{3}}|{_TITLE}"

# Names by gender and script, plain lists.
LATIN_MALE = "Adrian Benno Carl Dario Elias Felix Gustav Hugo Ivan Jonas Karsten Leon Marius Nico Oscar Pavel Quentin Robin Simon Tomas".split()
LATIN_FEMALE = "Alma Berta Clara Daria Elena Fiona Greta Helene Ines Johanna Katja Lena Marta Nora Olga Paula Rita Sofia Tessa Vera".split()
LATIN_LAST = "Abend Birk Corvin Dahl Ebner Falk Gruber Holm Ibsen Jansen Keller Lorenz Moser Nagel Orlov Pichler Quast Reuter Seidel Thaler Ulmer Vogt Winter Zeller".split()
CYRILLIC_MALE = "Антон Борис Глеб Денис Егор Захар Игорь Кирилл Лев Максим".split()
CYRILLIC_FEMALE = "Алла Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Нина".split()
CYRILLIC_LAST = "Белых Гладких Дурново Живаго Зимних Крутых Малых Петренко Русских Черных".split()


def kind_of(entity: Column) -> Column:
    """The type whose pattern the entity matches whole."""
    whole = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS.items()):
        whole = F.when(entity.rlike(rf"\A(?:{pattern})\z"), kind).otherwise(whole)
    return F.coalesce(whole, F.lit("phone"))


def norm_of(kind: Column, entity: Column) -> Column:
    """What spellings of one entity have in common."""
    return F.when(kind.isin("email", "ip"), F.lower(entity)).when(kind == "iban", F.regexp_replace(entity, " ", "")).otherwise(F.regexp_replace(entity, r"[^\d]", ""))


def _byte(digest: Column, i: Column) -> Column:
    """The i-th byte of a hex digest, read round and round."""
    return F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(names: list[str], byte: Column) -> Column:
    return F.get(F.array(*map(F.lit, names)), byte % len(names))


def draw(key: str, kind: Column, norm: Column, female: Column, attempt: Column) -> Column:
    """The surrogate norm of an entity; ``female`` is null where no gender is known."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string")).cast("binary"), 256)
    size, cyrillic = F.length(norm), norm.rlike(r"\p{IsCyrillic}")

    def one(i: Column) -> Column:
        c, b = F.substring(norm, i + 1, F.lit(1)), _byte(digest, i)
        small, large = F.lit("abcdefghijklmnopqrstuvwxyz"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        russian = F.lit("абвгдежзиклмнопрстуфхцчшэюя")
        letter = F.when(c.rlike("[A-Z]"), F.substring(large, b % 26 + 1, F.lit(1))).when(c.rlike(r"\p{IsCyrillic}"), F.substring(russian, b % 27 + 1, F.lit(1))).when(c.rlike(r"\p{L}"), F.substring(small, b % 26 + 1, F.lit(1)))
        return F.when(c.rlike(r"\d"), (b % 10).cast("string")).otherwise(F.coalesce(letter, c))

    def syllables(n: Column) -> Column:
        # each adds a choice of 100 or so: the space of names has no end
        sound = lambda k: F.when(cyrillic, F.concat(_pick(list("бвгдклмнпрст"), _byte(digest, 8 + k)), _pick(list("аеиоу"), _byte(digest, 9 + k)))).otherwise(F.concat(_pick(list("bdfgklmnprstvz"), _byte(digest, 8 + k)), _pick(list("aeiou"), _byte(digest, 9 + k))))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: sound(2 * k)), "")).otherwise("")

    keep = F.when(kind == "card", 1).when(kind == "iban", 2).when(kind == "phone", F.greatest(F.lit(0), size - 10)).otherwise(0)
    spelled = F.array_join(F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.when(i < keep, F.substring(norm, i + 1, F.lit(1))).otherwise(one(i))), "")
    # an address keeps its top-level domain
    top = F.substring_index(norm, ".", -1)
    email = F.concat(syllables(attempt - 3), F.substring(spelled, F.lit(1), size - F.length(top)), top)
    ip = F.concat_ws(".", (_byte(digest, F.lit(0)) % 223 + 1).cast("string"), *(_byte(digest, F.lit(k)).cast("string") for k in (1, 2)), (_byte(digest, F.lit(3)) % 254 + 1).cast("string"))
    # given names that no title or several kinds of title stand before draw from either list
    woman = F.coalesce(female, _byte(digest, F.lit(7)) % 2 == 0)
    of = lambda latin, other, b: F.when(cyrillic, _pick(other, b)).otherwise(_pick(latin, b))
    word = lambda b: F.when(kind == "family", of(LATIN_LAST, CYRILLIC_LAST, b)).when(woman, of(LATIN_FEMALE, CYRILLIC_FEMALE, b)).otherwise(of(LATIN_MALE, CYRILLIC_MALE, b))
    # a double name gets as many names
    name = F.concat(F.lower(F.array_join(F.transform(F.split(norm, "-"), lambda _, i: word(_byte(digest, i))), "-")), syllables(attempt))
    return F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("given", "family"), name).otherwise(spelled)


def table(entities: DataFrame, key: str, tries: int = 200) -> DataFrame:
    """(kind, norm, surrogate) for each (kind, norm) of rows (kind, norm, female); no surrogate twice or among the norms."""
    agreed = F.when(F.min("female") == F.max("female"), F.min("female")).alias("female")
    norms = materialize(entities.groupBy("kind", "norm").agg(agreed), "norms")
    own = norms.select(F.col("kind").alias("k"), F.col("norm").alias("s"))
    still, settled, attempt = norms, None, 0
    while not still.isEmpty():
        if attempt > tries:
            raise RuntimeError("surrogates still collide; the entities outnumber what their formats can tell apart")
        drawn = still.withColumn("surrogate", draw(key, F.col("kind"), F.col("norm"), F.col("female"), F.lit(attempt)))
        won = drawn.groupBy("kind", "surrogate").agg(F.min("norm").alias("norm"))
        for taken in (own, *([] if settled is None else [settled.select(F.col("kind").alias("k"), F.col("surrogate").alias("s"))])):
            won = won.join(taken.hint("merge"), (F.col("kind") == F.col("k")) & (F.col("surrogate") == F.col("s")), "left_anti")
        won = materialize(won.select("kind", "norm", "surrogate"), "surrogates")
        still = materialize(still.join(won.select("kind", "norm").hint("merge"), ["kind", "norm"], "left_anti"), "collisions")
        settled = won if settled is None else settled.unionByName(won)
        attempt += 1
    return norms.select("kind", "norm", F.lit("").alias("surrogate")).limit(0) if settled is None else settled


def poured(entity: Column, kind: Column, surrogate: Column) -> Column:
    """A surrogate norm in the format of one place."""
    size = F.length(entity)
    digits = lambda i: F.length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))

    def same_case(i: Column) -> Column:
        s, at = F.substring(surrogate, i + 1, F.lit(1)), i - (F.length(surrogate) - size)
        return F.when((at >= 0) & F.substring(entity, at + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(s)).otherwise(s)

    def slot(i: Column) -> Column:
        c = F.substring(entity, i + 1, F.lit(1))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(surrogate, digits(i), F.lit(1))).otherwise(c)

    spread = lambda f, n: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: f(i)), "")
    name = F.regexp_replace(F.initcap(F.regexp_replace(surrogate, "-", " - ")), " - ", "-")
    return F.when(kind == "ip", surrogate).when(kind.isin("given", "family"), name).when(kind == "email", spread(same_case, F.length(surrogate))).otherwise(spread(slot, size))


def parts(kind: Column, entity: Column) -> Column:
    """What of an entity is replaced: itself, or the words of a name; array of (lead, piece, kind, norm, female)."""
    title = F.substring_index(entity, " ", 1)
    female = F.when(title.isin(_FEMALE.split("|")), True).when(title.isin(_MALE.split("|")), False)
    words = F.split(F.substring(entity, F.length(title) + 2, F.length(entity)), " ")
    shape = lambda lead, piece, kind, norm, female: F.struct(lead.alias("lead"), piece.alias("piece"), kind.alias("kind"), norm.alias("norm"), female.cast("boolean").alias("female"))
    one = lambda w, i: shape(F.when(i == 0, F.concat(title, F.lit(" "))).otherwise(" "), w, F.when(i == F.size(words) - 1, "family").otherwise("given"), F.lower(w), F.when(i < F.size(words) - 1, female))
    return F.when(kind == "name", F.transform(words, one)).otherwise(F.array(shape(F.lit(""), entity, kind, norm_of(kind, entity), F.lit(None))))


def replaced(df: DataFrame, text_col: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with entities as (_row, _text, _n), and the rows without."""
    has = F.coalesce(F.col(text_col).rlike(SIGN), F.lit(False)) & F.coalesce(F.col(text_col).rlike(ANY), F.lit(False))
    inner = df.where(has).select(F.struct(*df.columns).alias("_row"), F.col(text_col).alias("_t"))
    inner = inner.select("_row", F.regexp_extract_all("_t", F.lit(ANY), F.lit(0)).alias("found"), F.split("_t", ANY, -1).alias("between"))
    rows = materialize(inner.withColumn("row", F.monotonically_increasing_id()), "personal")
    ask = rows.select("row", F.posexplode("found").alias("at", "entity"))
    ask = ask.select("row", "at", F.posexplode(parts(kind_of(F.col("entity")), F.col("entity"))).alias("part", "p")).select("row", "at", "part", "p.*")
    ask = materialize(ask, "found")
    told = table(ask, key).select(F.col("kind").alias("k"), F.col("norm").alias("n"), "surrogate")
    put = ask.join(told.hint("merge"), (F.col("kind") == F.col("k")) & (F.col("norm") == F.col("n"))).select("row", "at", "part", F.concat("lead", poured(F.col("piece"), F.col("kind"), F.col("surrogate"))).alias("new"))
    whole = lambda found: F.array_join(F.transform(F.array_sort(found), lambda x: x["new"]), "")
    put = put.groupBy("row", "at").agg(whole(F.collect_list(F.struct("part", "new"))).alias("new"))
    new = put.groupBy(F.col("row").alias("_of")).agg(F.array_sort(F.collect_list(F.struct("at", "new"))).alias("new"))
    text = F.array_join(F.transform(F.sequence(F.lit(0), F.size("between") - 1), lambda i: F.concat(F.get(F.col("between"), i), F.coalesce(F.get(F.col("new"), i)["new"], F.lit("")))), "")
    return rows.join(new.hint("merge"), F.col("row") == F.col("_of")).select("_row", text.alias("_text"), F.size("found").cast("long").alias("_n")), df.where(~has)


def surrogates(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, text with surrogates and n_entities for each row."""
    with_some, without = replaced(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_in")), "_in", key)
    out = with_some.select(F.col("_row._id").alias(id_col), F.col("_text").alias(text_col), F.col("_n").alias("n_entities"))
    return out.unionByName(without.select(F.col("_id").alias(id_col), F.col("_in").alias(text_col), F.lit(0).cast("long").alias("n_entities")))


def replace(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """All rows, with surrogates in their texts; same columns."""
    with_some, without = replaced(df, text_col, key)
    return with_some.select(*(F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in df.columns)).unionByName(without)
