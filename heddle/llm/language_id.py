"""Language identification by averaged hashed subword embeddings.

A text is the mean of the embeddings of the subwords of its words (runs of one to
four characters, marked at the word's ends, hashed into a fixed table), and a
linear softmax reads the language off that mean.  Embeddings and softmax are
trained by stochastic gradient descent in numpy; a temperature and a rejection
threshold are set on training rows held back from the descent.  As both layers
are linear before the softmax, prediction needs only the logits of each subword,
and a word's logits are shared between texts.

Training takes a sample of at most about ``max_rows`` labelled rows, drawn at an
equal number for each language by a hash of the id; prediction takes every row.

Defined results: null text or a text without letters is ``und`` with score 0 and
rejected; a null language is never learned from; a null id counts as held out; with nothing
to learn from every row is ``und``; repeated rows are predicted alike; extra
columns are ignored; texts are taken whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.arrow import slices, texts_of

UNKNOWN = "und"
#: Runs of letters and of what ``\w`` takes beside letters, digits and the underscore: fractions, superscripts, numbers in circles and such.
_RUNS = re.compile(r"[^\W\d_]+")
MEMO_WORDS = 200_000


def subwords(word: str, buckets: int) -> list[int]:
    """Table rows of the runs of one to four characters of ``<word>``."""
    marked = f"<{word}>".encode("utf-32-le")
    end = len(marked)
    return [zlib.crc32(marked[a : a + 4 * n]) % buckets for n in (1, 2, 3, 4) for a in range(0, end - 4 * n + 1, 4)]


def words(text: str) -> list[str]:
    """Runs of letters by their Unicode category, in lower case."""
    runs = _RUNS.findall(text.lower())
    if all(map(str.isalpha, runs)):
        return runs
    return [w for run in runs for w in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


@dataclass(frozen=True)
class LanguageModel:
    """Logits of each subword, and what turns their mean into a decision."""

    languages: tuple[str, ...]
    table: np.ndarray  # subwords x languages
    bias: np.ndarray
    temperature: float
    threshold: float

    def predictor(self) -> "Predictor":
        return Predictor(self)


class Predictor:
    """Predicts texts; holds the summed logits of the words it has met."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.sums = np.zeros((1024, len(self.model.languages) + 1))

    def _row(self, word: str) -> int:
        at = self.rows[word] = len(self.rows)
        if at == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        ids = subwords(word, len(self.model.table))
        self.sums[at, :-1] = self.model.table[ids].sum(0)
        self.sums[at, -1] = len(ids)
        return at

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, calibrated probability, and whether it is rejected."""
        if not (found := words(text)) or not self.model.languages:
            return UNKNOWN, 0.0, True
        if len(self.rows) > MEMO_WORDS:
            self._forget()
        rows, new = self.rows, self._row
        total = np.zeros(self.sums.shape[1])
        for start in range(0, len(found), 100_000):
            at = [rows[w] if w in rows else new(w) for w in found[start : start + 100_000]]
            total += self.sums[at].sum(0)
        p = softmax((total[:-1] / total[-1] + self.model.bias) / self.model.temperature)
        best = int(p.argmax())
        return self.model.languages[best], float(p[best]), bool(p[best] < self.model.threshold)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(bags: list[tuple[str, np.ndarray, np.ndarray]], buckets: int, dims: int = 12, epochs: int = 12, rate: float = 0.4, keep_accepted: float = 0.99, seed: int = 7) -> LanguageModel:
    """Fit on (language, subword rows, their counts); a fifth is kept for calibration.

    Calibration sees each kept text whole and thinned to 12 and 48 of its subwords, so that
    certainty about short texts counts too.  It minimises the log loss over the temperature, then
    sets the threshold so that a share ``keep_accepted`` of its correct predictions passes.
    """
    languages = tuple(sorted({b[0] for b in bags}))
    if not languages:
        return LanguageModel((), np.zeros((buckets, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(bags))
    aside = [bags[i] for i in order[::5]] if len(bags) >= 20 else bags
    fit = [bags[i] for k, i in enumerate(order) if k % 5 or len(bags) < 20]
    embed = rng.uniform(-1, 1, (buckets, dims)) / dims
    out, bias = np.zeros((dims, len(languages))), np.zeros(len(languages))
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            language, ids, counts = fit[i]
            weight = counts / counts.sum()
            mean = weight @ embed[ids]
            error = softmax(mean @ out + bias)
            error[languages.index(language)] -= 1
            step = rate * (1 - done / steps)
            back = out @ error
            out -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            embed[ids] -= step * len(ids) * 0.05 * np.outer(weight, back)
            done += 1
    table = embed @ out
    thinned = [(lang, *np.unique(rng.choice(i, size, p=c / c.sum()), return_counts=True)) for lang, i, c in aside for size in (12, 48)]
    aside = aside + thinned
    logits = np.array([(c / c.sum()) @ table[i] + bias for _, i, c in aside])
    truth = np.array([languages.index(b[0]) for b in aside])

    def loss(t: float) -> float:
        return float(-np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())

    temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    p = softmax(logits / temperature)
    right = p.max(1)[p.argmax(1) == truth]
    threshold = float(np.quantile(right, 1 - keep_accepted)) if len(right) else 0.0
    return LanguageModel(languages, table, bias, temperature, threshold)


def sample_bags(df: DataFrame, id_col: str, text_col: str, lang_col: str, max_rows: int, buckets: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Subword bags of a balanced sample: about ``max_rows`` rows, over all languages together."""
    spread = F.pmod(F.xxhash64(F.lit("language-id"), F.col(id_col)), F.lit(1 << 30)).cast("long")
    there = {r[0]: r[1] for r in df.groupBy(lang_col).count().collect() if r[0] is not None}
    if not there:
        return []
    cuts = {lang: int((1 << 30) * min(1.0, max_rows / len(there) / n)) for lang, n in there.items()}
    cut = F.coalesce(*[F.when(F.col(lang_col) == lang, F.lit(c)) for lang, c in cuts.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 200):
                bags = []
                for text in texts_of(part):
                    bag: Counter[int] = Counter()
                    for word, n in Counter(words(text)).items():
                        for i in subwords(word, buckets):
                            bag[i] += n
                    bags.append(sorted(bag.items()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("lang"), pa.array([[i for i, _ in b] for b in bags], pa.list_(pa.int32())), pa.array([[n for _, n in b] for b in bags], pa.list_(pa.int32()))],
                    ["id", "lang", "ids", "counts"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.where(spread < cut).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = rows.mapInArrow(run, f"id {kind}, lang string, ids array<int>, counts array<int>").where("size(ids) > 0").toArrow()
    got = sorted(zip(*(got.column(c).to_pylist() for c in ("id", "lang")), *([np.array(x) for x in got.column(c).to_pylist()] for c in ("ids", "counts")), strict=True), key=lambda r: r[:2])
    return [(lang, ids, counts) for _, lang, ids, counts in got]


def identify_language(df: DataFrame, train_when: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_rows: int = 1600, buckets: int = 1 << 15) -> DataFrame:
    """Id, lang_pred, score and rejected for each row, learned from rows with ``train_when``."""
    learn = df.where(train_when & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    model = train(sample_bags(learn, id_col, text_col, lang_col, max_rows, buckets), buckets)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = sent.value.predictor()
        for whole in batches:
            for batch in slices(whole):
                found = [predictor.predict(t) for t in texts_of(batch)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.bool_())],
                    ["id", "lang_pred", "score", "rejected"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)
