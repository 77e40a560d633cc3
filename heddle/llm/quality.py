"""Line-first quality rules in built-in functions.

Each line is judged by punctuation, navigation, symbol, capitals and boilerplate
rules; failing lines go, and a document goes that fails the base rules or keeps less than
a given share of its characters in words.  Everything is computed within the row: no shuffle.

Defined results: null text has no words and fails the base rules; repeated rows
and rows with null ids are judged each; extra columns are ignored (``judge``) or
kept (``clean``); texts are taken whole; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: Marks between the entries of menus and link bars.
BARS = "|»›•·"
TERMINAL = ".!?…:;\"'”’»)]"
#: Phrases of notices about scripts, cookies, rights and newsletters, in lower case.
BOILERPLATE = [
    "enable javascript", "javascript is disabled", "javascript is required", "uses cookies", "cookie policy", "privacy policy",
    "terms of use", "terms of service", "all rights reserved", "lorem ipsum", "click here", "subscribe to our newsletter",
    "activez javascript", "utilise des cookies", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "tous droits réservés", "cliquez ici",
    "javascript aktivieren", "verwendet cookies", "datenschutzerklärung", "nutzungsbedingungen", "alle rechte vorbehalten", "hier klicken", "newsletter abonnieren",
    "active javascript", "utiliza cookies", "política de privacidad", "condiciones de uso", "aviso legal", "todos los derechos reservados", "haga clic aquí",
    "включите javascript", "использует файлы cookie", "политика конфиденциальности", "пользовательское соглашение", "все права защищены", "нажмите здесь", "подпишитесь на рассылку",
]
MIN_WORDS, MAX_REPEATED, MIN_KEPT = 50, 50, 60


def any_of(chars: str) -> str:
    return "[" + "".join(f"\\{c}" for c in chars) + "]"


def count_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return F.length(text) - F.length(F.regexp_replace(text, any_of(chars), ""))


def solid(text: Column) -> Column:
    """Characters that aren't white space."""
    return F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", ""))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def has_phrase(text: Column) -> Column:
    """Whether a boilerplate phrase is in the text, in any case."""
    return bound(F.lower(text), lambda low: F.exists(F.array(*map(F.lit, BOILERPLATE)), lambda b: low.contains(b)))


def signs(text: Column) -> Column:
    """What a text must have for some of its lines to fail by the rules that cost most.

    Of a line more than half of whose characters are capitals, two follow each other.
    """
    boilerplate = has_phrase(text)
    return F.struct(
        text.rlike(any_of(BARS)).alias("bars"), text.rlike(any_of(SYMBOLS)).alias("symbols"), text.rlike(r"\p{Lu}[\x20\x09-\x0D]*\p{Lu}").alias("capitals"), boilerplate.alias("boilerplate")
    )


def line_fails(line: Column, has: Column) -> Column:
    """Whether a line with a word in it is to go; ``has``: the signs of its text."""
    gaps = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    bars, symbols = count_of(line, BARS), count_of(line, SYMBOLS)
    capitals = F.length(line) - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    last = F.right(F.rtrim(line, F.lit(BLANKS)), F.lit(1))
    phrase = has_phrase(line)
    return (
        (has["bars"] & (bars >= 3) & (bars * 4 > gaps))
        | (has["symbols"] & (symbols * 2 > gaps + 1))
        | (has["capitals"] & (solid(line) >= 20) & (capitals * 2 > solid(line)))
        | ((gaps < 3) & (F.instr(F.lit(TERMINAL), last) == 0))
        | (has["boilerplate"] & phrase)
    )


def has_word(line: Column) -> Column:
    return line.rlike(WORD)


def repeated_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, from the windows' hashes.

    Texts whose hashes are distinct have none; only the others have them sorted.
    """

    def places(ordered: Column) -> Column:
        last = F.size(ordered) - 1
        twice = F.filter(ordered, lambda x, k: ((k > 0) & (F.get(ordered, k - 1)["h"] == x["h"])) | ((k < last) & (F.get(ordered, k + 1)["h"] == x["h"])))
        return F.array_sort(F.transform(twice, lambda x: x["i"]))

    def covered(at: Column) -> Column:
        last = F.size(at) - 1
        return F.aggregate(F.sequence(F.lit(0), last), F.lit(0), lambda n, k: n + F.when(k == last, 3).otherwise(F.least(F.lit(3), F.get(at, k + 1) - F.get(at, k))))

    windows = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    spread = bound(bound(F.array_sort(windows), places), covered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(spread)


def judged(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with the counts and verdicts as columns of their own.

    They are plain columns, not fields of a struct: a column that is used more than once is worked out once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashes = F.when(F.size("_w") >= 4, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(F.col("_w")[i], F.col("_w")[i + 1], F.col("_w")[i + 2]))).otherwise(F.array().cast("array<bigint>"))
    rows = df.withColumns({"_w": F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), "_l": F.split(text, "\n")})
    kept = bound(F.struct(signs(text).alias("has"), F.col("_l").alias("lines")), lambda m: F.filter(m["lines"], lambda x: ~has_word(x) | ~line_fails(x, m["has"])))
    rows = rows.withColumns({"_h": hashes, "_kept_text": F.array_join(kept, "\n"), "_f": F.filter("_l", has_word)})
    rows = rows.withColumns({
        "_n_words": F.size("_w").cast("long"),
        "_word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "_n_symbols": count_of(text, SYMBOLS).cast("long"),
        "_n_dup_lines": (F.size("_f") - F.size(F.array_distinct("_f"))).cast("long"),
        "_n_repeat_words": repeated_words(F.col("_h")).cast("long"),
        "_kept_chars": solid(F.col("_kept_text")).cast("long"),
    })
    rows = rows.withColumn("_failed", (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEATED * F.col("_n_words")))
    return rows.withColumn("_ok", ~F.col("_failed") & (100 * F.col("_kept_chars") >= MIN_KEPT * F.col("_word_chars")))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdicts for each row."""
    rows = judged(df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")), "_t")
    counts = [F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return rows.select(F.col("_id").alias(id_col), *counts, F.col("_failed").alias("base_failed"), F.col("_ok").alias("kept"), F.col("_kept_chars").alias("kept_chars"))


def clean(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows that are kept, without their failing lines; same columns."""
    names = df.columns
    inner = df.select(F.struct(*names).alias("_row"), F.col(text_col).alias("_t"))
    # the rows pass through a generator, as a filter on them would be pushed down and work all rules out again
    rows = judged(inner, "_t").select("_row", F.explode(F.array(F.struct(F.col("_ok").alias("ok"), F.col("_kept_text").alias("text")))).alias("_v")).where("_v.ok")
    text = F.col("_v.text")
    new = {text_col: text} | ({chars_col: F.length(text).cast(df.schema[chars_col].dataType)} if chars_col in names else {})
    return rows.select(*(new.get(c, F.col("_row")[c]).alias(c) for c in names))
