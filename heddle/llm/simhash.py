"""Near-duplicates by SimHash, with a table of distances to reference fingerprints.

References are a random fingerprint, that fingerprint with each of 32 pairs of
neighbouring bits flipped, and further random ones.  The table holds each distinct
fingerprint's Hamming distances to all of them.  By the triangle inequality two
fingerprints that differ in at most ``RADIUS`` bits have distances to each
reference that differ by no more, so pairs are discarded by their maximum coordinate difference, and
the rest are verified.

So that only pairs worth comparing meet, the distances to the flipped references
fall in six groups by the bits they flip.  Two differing bits touch at most two groups,
so fingerprints that link agree in all coordinates and bits of four groups at least: each
fingerprint is dealt out under those of each of the 15 choices of four
groups.  Where many fingerprints meet under one key, they are linked through the values they take
with two bits of the other two groups blanked, in time in proportion to their number; every
linking pair meets so under the key of the four groups it agrees in.  Each
key gives a spanning forest of its links, never all pairs.  Fingerprints are distinct here and those under a
key differ in the bits of two groups, at most 24, so no key has more than 2**24 of them, however many texts there are.

Defined results: null text or no words is fingerprint zero, linked like any
other; exact copies collapse before links are searched; repeated rows each keep their row; a
component of rows with null ids only has a null id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm import similar
from heddle.llm.arrow import slices, texts_of, words_of
from heddle.llm.shingles import forest, of_hashes, shingles
from heddle.plans.components import stars
from heddle.plans.durable import materialize

RADIUS = 2
PAIRS = 32
#: Bit pairs 0..31 in six groups, and the choices of four of them.
GROUPS = [g.tolist() for g in np.array_split(np.arange(PAIRS), 6)]
CHOICES = list(combinations(range(6), 4))
_RNG = np.random.default_rng(20240607)
_BASE = _RNG.integers(0, 1 << 64, dtype=np.uint64)
REFERENCES = np.concatenate([[_BASE], _BASE ^ (np.uint64(3) << np.arange(0, 64, 2, dtype=np.uint64)), _RNG.integers(0, 1 << 64, 15, dtype=np.uint64)])
CROWD = 128


def fingerprint(words: list[bytes], size: int = 3) -> int:
    """Unsigned SimHash of the word shingles, repeats included."""
    return of_hashes(shingles(words, size))


def fingerprints(df: DataFrame, id_col: str, text_col: str, size: int = 3) -> DataFrame:
    """(id, fp) for each row; fp is the fingerprint as a signed long."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                found = np.array([fingerprint(words_of(t), size) for t in texts_of(batch)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found.view(np.int64))], ["id", "fp"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def distances(fp: np.ndarray) -> np.ndarray:
    """The pivot table: Hamming distances of fingerprints to the references."""
    return np.bitwise_count(fp[:, None] ^ REFERENCES[None, :])


def keys(fp: np.ndarray) -> np.ndarray:
    """For each fingerprint its key under each choice of four groups, from the table."""
    table = distances(fp).astype(np.int64)
    flipped = (table[:, :1] - table[:, 1 : PAIRS + 1] + 2) // 2  # bits of the pair that differ from the base: 0, 1 or 2
    group = np.stack([flipped[:, g] @ (3 ** np.arange(len(g))) for g in GROUPS], axis=1)
    out = np.empty((len(fp), len(CHOICES)), np.int64)
    for k, choice in enumerate(CHOICES):
        key = np.full(len(fp), k, np.int64)
        for g in choice:
            key = key * 3 ** len(GROUPS[g]) + group[:, g]
        mask = np.bitwise_or.reduce([np.uint64(3) << np.uint64(2 * pair) for g in choice for pair in GROUPS[g]])
        mixed = (key.view(np.uint64) ^ (fp & mask)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = (mixed >> np.uint64(5)).view(np.int64) * len(CHOICES) + k
    return out


def crowd_links(fp: np.ndarray, choice: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among many fingerprints that differ in bits of the two groups left out only."""
    free = [bit for g in range(6) if g not in CHOICES[choice] for pair in GROUPS[g] for bit in (2 * pair, 2 * pair + 1)]
    for i, j in combinations(free, 2):
        blank = fp & ~(np.uint64(1) << np.uint64(i) | np.uint64(1) << np.uint64(j))
        order = np.argsort(blank, kind="stable")
        same = np.flatnonzero(blank[order][1:] == blank[order][:-1])
        if len(same):
            yield fp[order[same]], fp[order[same + 1]]


def links(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links under each key; rows are sorted by key."""
    first = np.flatnonzero(np.diff(key, prepend=~key[:1]))
    size = np.diff(np.append(first, len(key)))
    out: list[tuple[int, int]] = []
    for start, n in zip(first[size > CROWD], size[size > CROWD], strict=True):
        own = fp[start : start + n]
        pairs = list(crowd_links(own, int(key[start] % len(CHOICES))))
        if pairs:
            out += forest(*(np.concatenate(x) for x in zip(*pairs, strict=True)))
    few = np.repeat((size > 1) & (size <= CROWD), size)
    key, fp = key[few], fp[few]
    if len(key):
        table, found = distances(fp), []
        alive = np.arange(len(key))
        for gap in range(1, CROWD):
            alive = alive[alive + gap < len(key)]
            alive = alive[key[alive] == key[alive + gap]]
            if not len(alive):
                break
            i, j = alive, alive + gap
            near = np.maximum(table[i], table[j]) - np.minimum(table[i], table[j])
            i, j = i[near.max(1) <= RADIUS], j[near.max(1) <= RADIUS]
            true = np.bitwise_count(fp[i] ^ fp[j]) <= RADIUS
            found.append((fp[i[true]], fp[j[true]]))
        if found:
            out += forest(*(np.concatenate(x) for x in zip(*found, strict=True)))
    pairs = np.array(out, np.uint64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def near_pairs(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints that keep each component together."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 4000):
                fp = batch.column("fp").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(keys(fp.view(np.uint64)).ravel()), pa.array(np.repeat(fp, len(CHOICES)))], ["key", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def give(k: np.ndarray, f: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(k) > 1:
                a, b = links(k, f.view(np.uint64))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("key").to_numpy(), batch.column("fp").to_numpy()))
            if sum(len(k) for k, _ in held) >= 100_000 and held[0][0][0] != held[-1][0][-1]:  # all but the last key are complete
                key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                cut = np.searchsorted(key, key[-1])
                yield from give(key[:cut], fp[:cut])
                held = [(key[cut:], fp[cut:])]
        if held:
            yield from give(*(np.concatenate(x) for x in zip(*held, strict=True)))

    dealt = distinct.mapInArrow(deal, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(link, "a long, b long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """Id, fingerprint (16 hex digits) and component_id for each row."""
    found = materialize(fingerprints(df, id_col, text_col, size), "fingerprints")
    firsts = found.groupBy("fp").agg(F.min("id").alias("first"))
    roots = stars(near_pairs(firsts.select("fp")))
    labelled = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("label"))
    labelled = materialize(labelled, "labels")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    named = labelled.select(F.col("fp").alias("of"), "label").join(least, "label").select("of", "component_id")
    out = found.join(named, F.col("fp") == F.col("of"))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``df`` with one row left of each group of similar texts: that of the smallest id.

    Texts are linked by the share of their distinct shingles in common, through others too: those with
    fingerprints within ``RADIUS`` bits by ``near_pairs``, those further apart as ``similar`` says.  Rows with a null id are kept.  Of several rows with the id that stays, one is kept.
    """
    rows, labels = similar.grouped(df.select(*df.columns), text_col, size, similarity, near_pairs)
    ids = rows.select("row", F.col("rec")[id_col].alias("id")).where("id is not null")
    named = ids.join(labels.hint("merge"), F.col("row") == F.col("at")).select("row", "id", "label")
    stays = named.groupBy("label").agg(F.min(F.struct("id", "row")).alias("best"), F.count("*").alias("many")).where("many > 1")
    # written, so that the join meets two plain exchanges and a label with most rows can be split
    stays = materialize(stays.select("label", F.col("best.row").alias("best")), "stays")
    gone = named.join(stays, "label").where("row <> best").select(F.col("row").alias("at"))
    # merged at every size: who goes grows with the texts, so it is never broadcast
    kept = rows.join(gone.hint("merge"), F.col("row") == F.col("at"), "left_anti")
    return kept.select(*(F.col("rec")[c].alias(c) for c in df.columns))
