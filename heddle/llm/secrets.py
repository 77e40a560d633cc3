"""Secret scans with corpus-wide ownership frequency, in built-in functions.

Every text gives its candidate spans: assignments, access keys and long hex runs,
whose spans always stay, and further formats.  Candidates are hashed and counted
over the whole corpus by distinct owners and repositories: a value found with
``example_owners`` owners or more is a widely copied example, any other value that
doesn't look like a placeholder is a live one of its owners.  Spans of further formats are
added where their value is live, and ``redact`` blanks the live ones.

Only candidates are shuffled, never texts; counts are pre-aggregated by value,
owner and repository, so a value copied into a third of all texts is a few rows.

Defined results: null text is empty; null owners or repositories count as one of
their own; repeated rows are scanned each, and add nothing to the distinct counts;
a null id keeps its row; extra columns are ignored (``scan``) or kept (``redact``); texts
are taken whole; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.plans.durable import materialize


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(" + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
#: Kinds in the order in which they are listed; those after the third are added by the method.
KINDS = ["assign", "access", "hex", "pem", "jwt", "github", "google", "slack", "url", "mixed"]
MORE = {
    "pem": r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[^-]|-(?!----(?:BEGIN|END) ))*+-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----",
    "jwt": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]++",
    "github": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "google": r"AIza[0-9A-Za-z_-]{35}",
    "slack": r"xox[abprs]-[0-9A-Za-z-]{10,}",
    "url": r"(?<![a-z0-9])[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/@]++@",
    "mixed": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}+=*+",
}
#: Numbers that are summed at a time.
PART = 128
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|redacted|your[-_]?(?:token|key|secret|password)|^(.)\1+$|^x{4,}|<|\*{3}"


def summed(sizes: Column, start: Column) -> Column:
    """The sums of ``start`` and the numbers before each place, one more than there are numbers."""
    none = F.array(start.cast("int"))
    return F.aggregate(sizes, none, lambda sums, n: F.array_append(sums, F.element_at(sums, -1) + n))


def ends(sizes: Column) -> Column:
    """Running sums in parts of ``PART`` numbers: an array grows by copying, so no array grows long."""
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / PART).cast("int")), lambda k: F.slice(sizes, k * PART + 1, F.lit(PART)))

    def within(m: Column) -> Column:
        before = F.transform(F.array(summed(F.transform(m, lambda part: F.aggregate(part, F.lit(0), lambda a, n: a + n)), F.lit(0))), lambda b: F.transform(m, lambda part, k: F.slice(summed(part, F.get(b, k)), F.lit(2), F.size(part))))
        return F.flatten(before[0])

    return F.transform(F.array(parts), within)[0]


def matches(text: Column, pattern: str, keep: Callable[[Column], Column] | None = None, group: int = 0) -> Column:
    """Spans of the leftmost non-overlapping matches: array of (start, end, value), code points.

    ``group``: the value; a match is dropped unless its value passes ``keep``.
    Places follow from the lengths of the matches and of the text between them.  A match ends where its
    text does, so the pattern finds the same group again in the match alone; no pattern may look beyond
    that where ``group`` is given.
    """
    kind = "array<struct<start:int,end:int,value:string>>"

    def places(m: Column) -> Column:
        steps = F.transform(m["whole"], lambda w, k: F.length(F.get(m["between"], k)) + F.length(w))
        stops = F.transform(F.array(F.struct(m["whole"].alias("whole"), ends(steps).alias("ends"))), lambda x: F.transform(x["whole"], lambda w, k: F.struct((F.get(x["ends"], k) - F.length(w)).alias("start"), F.get(x["ends"], k).alias("end"), (F.regexp_extract(w, pattern, group) if group else w).alias("value"))))[0]
        return stops if keep is None else F.filter(stops, lambda s: keep(s["value"]))

    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"), F.split(text, pattern, -1).alias("between"))
    # the array of one binds what the lambda then reads again and again
    return F.when(text.rlike(pattern), F.transform(F.array(found), places)[0]).otherwise(F.array().cast(kind))


def candidates(text: Column) -> dict[str, Column]:
    """An array of (start, end, value) for each kind."""
    out = {"assign": matches(text, ASSIGN, lambda v: F.length(v) >= 6, group=2), "access": matches(text, ACCESS), "hex": matches(text, HEX)}
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Z]") & v.rlike("[a-z]")
    return out | {k: matches(text, p, mixed if k == "mixed" else None) for k, p in MORE.items()}


def _found(text: Column) -> Column:
    """All candidates of a text: array of (start, place of the kind, end, value's hash, placeholder)."""

    def of_kind(place: int, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("kind"), s["end"].alias("end"), F.sha2(s["value"].cast("binary"), 256).alias("value"), s["value"].rlike(PLACEHOLDER).alias("placeholder")))

    parts = [of_kind(place, spans) for place, spans in enumerate(candidates(text).values())]
    return F.array_sort(F.concat(*parts))


def verdicts(found: DataFrame, example_owners: int) -> DataFrame:
    """(value, owners, repositories, widely) from rows of owner, repository and found candidates."""
    rows = found.select(F.explode("found.value").alias("value"), F.struct("owner").alias("owner"), F.struct("owner", "repository").alias("repository")).distinct()
    owned = rows.groupBy("value", "owner").agg(F.count("*").alias("r"))
    return owned.groupBy("value").agg(F.count("*").alias("owners"), F.sum("r").alias("repositories")).withColumn("widely", F.col("owners") >= example_owners)


def scanned(rows: DataFrame, example_owners: int) -> DataFrame:
    """A written table of rows with ``owner``, ``repository`` and ``found``, and with ``live``, the live members of ``found``."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")
    ask = rows.select("row", F.explode("found").alias("f"))
    told = ask.join(verdicts(rows, example_owners).select(F.col("value").alias("of"), "widely"), F.col("f.value") == F.col("of"))
    live = told.where(~F.col("widely") & ~F.col("f.placeholder")).groupBy(F.col("row").alias("_of")).agg(F.array_sort(F.collect_list("f")).alias("live"))
    out = rows.join(live, F.col("row") == F.col("_of"), "left").drop("row", "_of")
    return out.withColumn("live", F.coalesce("live", F.array().cast(rows.schema["found"].dataType)))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def scan(df: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text", example_owners: int = 3) -> DataFrame:
    """Counts, digests and spans for each row, and how many of its candidates are live or examples."""
    rows = df.select(F.col(id_col).alias("_id"), _found(F.coalesce(F.col(text_col), F.lit(""))).alias("found"), owner.alias("owner"), repository.alias("repository"))
    hits = scanned(rows, example_owners)
    base = F.filter("found", lambda s: s["kind"] < 3)
    stay = F.array_sort(F.concat(base, F.filter("live", lambda s: s["kind"] >= 3)))
    count = lambda place: F.size(F.filter("found", lambda s: s["kind"] == place)).cast("long")
    return hits.select(
        F.col("_id").alias(id_col),
        *(count(k).alias(f"n_{KINDS[k]}") for k in range(3)),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(stay).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
        (F.size("found") - F.size("live")).cast("long").alias("n_examples"),
    )


def blanked(text: Column, spans: Column, mask: str) -> Column:
    """``text`` with ``mask`` for its spans (at least one, sorted); those that overlap are blanked as one.

    ``PART`` spans at a time: each part cuts its own piece from the text, and the pieces are joined at the end.
    """
    step = "struct<at:int,out:string>"

    def piece(x: Column) -> Column:
        def on(a: Column, s: Column) -> Column:
            shown = F.concat(a["out"], F.substring(x["piece"], a["at"] - x["from"] + 1, s["start"] - a["at"]), F.lit(mask))
            return F.struct(F.greatest(a["at"], s["end"]).alias("at"), F.when(s["start"] >= a["at"], shown).otherwise(a["out"]).alias("out")).cast(step)

        return F.aggregate(x["part"], F.struct(x["from"].alias("at"), F.lit("").alias("out")).cast(step), on, lambda a: a["out"])

    def joined(m: Column) -> Column:
        def cut(part: Column, k: Column) -> Column:
            start = F.get(m["bounds"], k)
            return F.struct(part.alias("part"), start.alias("from"), F.substring(text, start + 1, F.get(m["bounds"], k + 1) - start).alias("piece"))

        tail = F.substring(text, F.element_at(m["bounds"], -1) + 1, F.length(text))
        return F.concat(F.array_join(F.transform(F.transform(m["parts"], cut), piece), ""), tail)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / PART).cast("int")), lambda k: F.slice(spans, k * PART + 1, F.lit(PART)))
    furthest = lambda part: F.aggregate(part, F.lit(0), lambda n, s: F.greatest(n, s["end"]))
    # where each part ends: the furthest end so far
    bounds = lambda p: F.aggregate(p, F.array(F.lit(0)), lambda out, part: F.array_append(out, F.greatest(F.element_at(out, -1), furthest(part))))
    both = F.transform(F.array(parts), lambda p: F.struct(p.alias("parts"), bounds(p).alias("bounds")))
    return F.transform(both, joined)[0]


def redact(df: DataFrame, owner: Column, repository: Column, text_col: str = "text", example_owners: int = 3, mask: str = "[SECRET]", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows, with the live secrets of their texts replaced by ``mask``; same columns."""
    names = df.columns
    some = F.coalesce(F.col(text_col).rlike("|".join(f"(?:{p})" for p in (ASSIGN, ACCESS, HEX, *MORE.values()))), F.lit(False))
    rows = df.where(some).select(F.struct(*names).alias("_in"), F.col(text_col).alias("_t"), _found(F.col(text_col)).alias("found"), owner.alias("owner"), repository.alias("repository"))
    hits = scanned(rows, example_owners)
    text = F.when(F.size("live") > 0, blanked(F.col("_t"), F.col("live"), mask)).otherwise(F.col("_t"))
    new = {text_col: text} | ({chars_col: F.when(F.size("live") > 0, F.length(text).cast(df.schema[chars_col].dataType)).otherwise(F.col("_in")[chars_col])} if chars_col in names else {})
    changed = hits.select(*(new.get(c, F.col("_in")[c]).alias(c) for c in names))
    return changed.unionByName(df.where(~some))
