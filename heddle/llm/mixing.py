"""Mixing to target weights with soft memberships and nonnegative rates.

A classifier learned from a labelled table predicts for every text its
posteriors over the domains.  A text of n tokens then holds n * p_k expected tokens of domain k,
and rates r >= 0 are sought whose totals sum(r n p_k) match the target weights times
all tokens: least squares, with the residual measured in the inverse of H = sum(n p p') / sum(n),
and of the rates that do equally well those nearest to 1 (``RIDGE`` times their
squared distance is added).  Projected gradient from rates of 1: all steps together subtract p . g from each rate
before it is projected, so a rate is max(0, 1 - p . g).  Steps are accelerated by
the curvature over the texts with a positive rate, and halved where they do not descend.
A round is one pass of sums over the posteriors; rates are never stored, as they follow from the
posteriors and the K numbers g.  Rounds end when the gradient vanishes; if they do not, that is an
error.  Targets that no nonnegative rates reach are warned of.

The classifier takes a sample of about ``max_rows`` labelled rows by a hash of the id and
the ``top_words`` most telling words among all of theirs;
posteriors, sums and rates take every row.

Defined results: null text has no tokens and gets the posteriors of such a text; rows of the labelled
table with nulls are not learned from; without labels all texts are one domain
and all rates are 1; repeated rows are texts of their own; a null id is one more id;
extra columns are ignored (``rates``) or kept (``mix``); texts are taken whole.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.arrow import slices, texts_of
from heddle.plans.durable import materialize

_CAPITALS, _SYMBOLS, _BARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>", b"|"
_STRIP = b".,;:!?\"'()"
SHAPES = 7
#: Weight of the rates' squared distance from 1 beside the squared residual.
RIDGE = 1e-9


def features(text: str) -> tuple[int, np.ndarray, set[bytes]]:
    """Number of words, the text's shape, and its distinct lower-case words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    distinct = set(words)
    n, size = len(words), max(1, len(raw))
    part = lambda chars: (size - len(raw.translate(None, chars))) / size
    shape = [np.log1p(n) / 10, 10 * part(_CAPITALS), 10 * part(_SYMBOLS), 10 * part(_BARS), len(distinct) / max(1, n) ** 0.9, n / size, 10 * part(b"!")]
    return n, np.array(shape) if text else np.zeros(SHAPES), {w.strip(_STRIP) for w in distinct}


@dataclass(frozen=True)
class DomainModel:
    """Softmax regression over shapes and the presence of telling words."""

    domains: tuple[str, ...]
    words: dict[bytes, int]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # (1 + shapes + words) x domains

    def posteriors(self, text: str) -> tuple[int, np.ndarray]:
        n, shape, distinct = features(text)
        known = [1 + SHAPES + self.words[w] for w in distinct if w in self.words]
        logits = self.weights[0] + ((shape - self.mean) / self.scale) @ self.weights[1 : 1 + SHAPES] + self.weights[known].sum(0)
        e = np.exp(logits - logits.max())
        return n, e / e.sum()


def telling(rows: DataFrame, size: dict[str, int], top_words: int, least: int) -> list[bytes]:
    """The words whose frequency in a domain departs most from that in all rows (id, domain, shape, words)."""
    if not size:
        return []
    n, domains = sum(size.values()), sorted(size)
    seen = [F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)]
    words = rows.select("domain", F.explode("words").alias("w")).where("w <> cast('' as binary)").groupBy("w").agg(F.count("*").alias("n"), *seen).where(F.col("n") >= least)
    expected = [F.col("n") * F.lit(size[d] / n) for d in domains]
    gain = [(F.col(f"n{k}") - e) * (F.col(f"n{k}") - e) / (e + 0.5) for k, e in enumerate(expected)]
    words = words.withColumn("gain", F.greatest(*gain, F.lit(0.0))).where("gain > 15")
    return [bytes(r.w) for r in words.orderBy(F.desc("gain"), "w").limit(top_words).collect()]


def fit(rows: list[tuple[str, list[float], list[bytes]]], chosen: list[bytes], steps: int = 400, decay: float = 1e-3) -> DomainModel:
    """Softmax regression on (domain, shape, words); ``chosen``: the words whose presence counts."""
    domains = tuple(sorted({r[0] for r in rows}))
    if not domains:
        return DomainModel(("all",), {}, np.zeros(SHAPES), np.ones(SHAPES), np.zeros((1 + SHAPES, 1)))
    truth = np.array([domains.index(r[0]) for r in rows])
    words = {w: k for k, w in enumerate(chosen)}
    shapes = np.array([r[1] for r in rows])
    mean, scale = shapes.mean(0), shapes.std(0) + 1e-3
    x = np.zeros((len(rows), 1 + SHAPES + len(words)))
    x[:, 0] = 1
    x[:, 1 : 1 + SHAPES] = (shapes - mean) / scale
    for k, r in enumerate(rows):
        x[k, [1 + SHAPES + words[w] for w in r[2] if w in words]] = 1
    y = np.eye(len(domains))[truth]
    w, first, second = np.zeros((x.shape[1], len(domains))), 0.0, 0.0
    for t in range(1, steps + 1):  # Adam, full batch
        logits = x @ w
        e = np.exp(logits - logits.max(1, keepdims=True))
        grad = x.T @ (e / e.sum(1, keepdims=True) - y) / len(rows) + decay * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w -= 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return DomainModel(domains, words, mean, scale, w)


def learn(df: DataFrame, labels: DataFrame, domain: Column, id_col: str, text_col: str, max_rows: int, top_words: int = 400, least: int = 5) -> DomainModel:
    """Join the sampled labels to their texts and fit on their shapes and the ``top_words`` most telling words met in ``least`` texts."""
    spread = F.pmod(F.xxhash64(F.lit("mixing"), F.col(id_col)), F.lit(1 << 30))
    known = labels.select(F.col(id_col), domain.alias("domain")).where(F.col(id_col).isNotNull() & F.col("domain").isNotNull())
    n = known.count()
    if not n:
        return fit([], [])
    cut = int((1 << 30) * min(1.0, max_rows / n))
    known = known.where(spread < cut).select(F.col(id_col).alias("key"), "domain")
    texts = df.where(spread < cut).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                found = [features(t) for t in texts_of(part)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("domain"), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64())), pa.array([sorted(f[2]) for f in found], pa.list_(pa.binary()))], ["id", "domain", "shape", "words"]
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = texts.join(known, F.col("id") == F.col("key")).select("id", "domain", "text").mapInArrow(run, f"id {kind}, domain string, shape array<double>, words array<binary>")
    rows = materialize(rows, "labelled")
    size = {r.domain: r["count"] for r in rows.groupBy("domain").count().collect()}
    chosen = telling(rows, size, top_words, least)
    known = F.filter("words", lambda w: w.isin(*map(F.lit, chosen))) if chosen else F.array().cast("array<binary>")
    got = rows.orderBy("id", "domain").select("domain", "shape", known.alias("words")).toLocalIterator()
    return fit([(r.domain, r.shape, [bytes(w) for w in r.words]) for r in got], chosen)


def with_posteriors(df: DataFrame, text_col: str, model: DomainModel) -> DataFrame:
    """``df`` as struct ``_row``, with ``_n`` tokens and posteriors ``_p``.  No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [sent.value.posteriors(t) for t in texts_of(part, "_t")]
                yield pa.RecordBatch.from_arrays([part.column("_row"), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1].tolist() for f in found], pa.list_(pa.float64()))], ["_row", "_n", "_p"])

    row = F.struct(*df.columns).alias("_row")
    rows = df.select(row, F.col(text_col).alias("_t"))
    return rows.mapInArrow(run, rows.select("_row", F.lit(0).cast("long").alias("_n"), F.array().cast("array<double>").alias("_p")).schema)


def rate(p: Column, g: list[float]) -> Column:
    """The rate that the steps so far, ``g`` in all, lead to."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((p[k] * F.lit(x) for k, x in enumerate(g)), F.lit(0.0)))


def fit_rates(rows: DataFrame, weights: list[float], rounds: int = 1000, tolerance: float = 1e-9) -> list[float]:
    """The sum of the projected gradient's steps; ``rows``: _n, _p."""
    k = len(weights)
    p, n, r = F.col("_p"), F.col("_n"), F.col("_r")
    cells = [(a, b) for a in range(k) for b in range(a, k)]
    sums = [F.sum(n), F.sum(n * r * r), *(F.sum(n * p[a] * r) for a in range(k)), *(F.sum(F.when(r > 0, n * p[a] * p[b]).otherwise(0.0)) for a, b in cells)]

    def measure(g: np.ndarray) -> tuple[float, np.ndarray, np.ndarray] | None:
        """Half the mean square of the rates, the totals, and the curvature over positive rates."""
        got = rows.withColumn("_r", rate(p, [float(x) for x in g])).agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first()
        if not got[0]:
            return None
        values, curve = np.array(got[1:], float) / got[0], np.zeros((k, k))
        for (a, b), x in zip(cells, values[1 + k :], strict=True):
            curve[a, b] = curve[b, a] = x
        return values[0] / 2, values[1 : 1 + k], curve

    g, want = np.zeros(k), np.array(weights) / sum(weights)
    at = measure(g)
    if at is None:
        return []
    whole = at[2] + 1e-6 * np.trace(at[2]) * np.eye(k)
    loss = lambda at, g: at[0] + want @ g + RIDGE / 2 * g @ whole @ g
    done = 1
    while np.abs(left := at[1] - want - RIDGE * whole @ g).max() >= tolerance:
        step = np.linalg.solve(at[2] + RIDGE * whole, left)
        share = 1.0
        while True:
            if done == rounds:
                raise RuntimeError(f"rates have not converged in {rounds} rounds: {np.abs(left).max()} is left")
            ahead, done = measure(g + share * step), done + 1
            if loss(ahead, g + share * step) <= loss(at, g) - 1e-4 * share * (left @ step) + 1e-14:
                break
            share /= 2
        g, at = g + share * step, ahead
    if np.abs(at[1] - want).max() > 1e-3:
        warnings.warn(f"no nonnegative rates reach the targets {want.tolist()}; nearest: {at[1].tolist()}", stacklevel=2)
    return [float(x) for x in g]


def targets_for(model: DomainModel, targets: dict[str, float]) -> list[float]:
    """Weights in the model's order; a domain without a target weighs nothing, a target without a labelled domain is warned of."""
    unknown = sorted(d for d, w in targets.items() if w and d not in model.domains)
    if unknown and model.domains != ("all",):
        warnings.warn(f"no labelled row is of {unknown}; their weights go to the other domains", stacklevel=2)
    found = [float(targets.get(d, 0.0)) for d in model.domains]
    return found if sum(found) else [1.0] * len(found)


def copies(r: Column, id_col: Column, text: Column) -> Column:
    """A whole number with mean ``r``; the same for equal rows."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), id_col, text), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(r) + (draw < r - F.floor(r)).cast("long")).cast("long")


def rates(df: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> DataFrame:
    """Id, n_tokens, domain posteriors, rate and copies for each row."""
    model = learn(df, labels, domain, id_col, text_col, max_rows)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    found = with_posteriors(rows, "text", model).select(F.col("_row.id").alias("id"), F.col("_row.mark").alias("mark"), "_n", "_p")
    found = materialize(found, "posteriors")
    steps = fit_rates(found, targets_for(model, targets))
    named = [F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(model.domains)]
    out = found.withColumn("rate", rate(F.col("_p"), steps))
    return out.select(F.col("id").alias(id_col), F.col("_n").alias("n_tokens"), *named, "rate", copies(F.col("rate"), F.col("id"), F.col("mark")).alias("copies"))


def mix(df: DataFrame, labels: DataFrame, domain: Column, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", max_rows: int = 4000) -> DataFrame:
    """The rows that the mixture takes, with ``rate`` and ``copies`` (how often each is taken)."""
    model = learn(df, labels, domain, id_col, text_col, max_rows)
    found = with_posteriors(df, text_col, model)
    sums = materialize(with_posteriors(df.select(text_col), text_col, model).select("_n", "_p"), "posteriors")
    steps = fit_rates(sums, targets_for(model, targets))
    row = F.col("_row")
    out = found.withColumn("_r", rate(F.col("_p"), steps))
    out = out.withColumn("_c", copies(F.col("_r"), row[id_col], F.xxhash64(row[text_col]))).where("_c > 0")
    names = [c for c in df.columns if c not in ("rate", "copies")]
    return out.select(*(row[c].alias(c) for c in names), F.col("_r").alias("rate"), F.col("_c").alias("copies"))
