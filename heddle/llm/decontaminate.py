"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are compared as lower-cased word tokens.  Windows of
``MIN_MATCH`` tokens that a text shares with an item are seeds; for each item so
found, the longest matches of unmarked tokens are marked again and again,
found by Karp-Rabin hashes of all windows of one length and verified token by token, until
none of ``MIN_MATCH`` tokens is left.  Tiles don't overlap and may lie in any order, so
a reordered passage is covered as well as a whole one.  A text is contaminated by
an item of which its tiles cover ``threshold`` or more.

The items are the query set: they are sent to all tasks in blocks of at most
about ``block_chars`` characters, and all texts are read against each block.  No shuffle.

Defined results: null texts match nothing; items that are null or have fewer than
``MIN_MATCH`` tokens match nothing, as that is too little to tell; repeated rows (of
either table) are each reported; null ids are reported as null; extra columns are
ignored (``contaminations``) or kept (``clean``); texts are taken whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.arrow import slices, texts_of

MIN_MATCH = 5
_TOKENS = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def tokens(text: str) -> list[str]:
    return _TOKENS.findall(text.lower())


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Karp-Rabin hashes of all windows of a token sequence, of any one length at a time."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        n = len(ids)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[ids] * powers(_BASE, n), out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def windows(self, length: int) -> np.ndarray:
        return (self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length]


def open_windows(marked: np.ndarray, length: int) -> np.ndarray:
    """Starts of the windows without a marked token."""
    taken = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(taken[length:] == taken[:-length])


def tile(text: np.ndarray, item: np.ndarray, values: np.ndarray, shortest: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, length), longest first.  -1 in the text matches nothing."""
    in_text, in_item = Hashes(text, values), Hashes(item, values)
    used_text, used_item = text < 0, np.zeros(len(item), bool)
    out = []

    def shared(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b = open_windows(used_text, length), open_windows(used_item, length)
        ha, hb = in_text.windows(length)[a], in_item.windows(length)[b]
        return a, b, ha, hb

    top = min(len(text), len(item))
    while top >= shortest:
        low, high = shortest - 1, top  # the longest shared length lies above low
        while low < high:
            mid = (low + high + 1) // 2
            _, _, ha, hb = shared(mid)
            low, high = (mid, high) if np.isin(hb, ha).any() else (low, mid - 1)
        if low < shortest:
            break
        a, b, ha, hb = shared(low)
        wanted = np.isin(ha, hb)
        places: dict[int, list[int]] = {}
        for at, h in zip(a[wanted][::-1].tolist(), ha[wanted][::-1].tolist(), strict=True):
            places.setdefault(h, []).append(at)
        before = len(out)
        for at, h in zip(b.tolist(), hb.tolist(), strict=True):
            if used_item[at : at + low].any():
                continue
            spots = places.get(h, [])
            while spots:
                spot = spots.pop()
                if not used_text[spot : spot + low].any() and (text[spot : spot + low] == item[at : at + low]).all():
                    used_text[spot : spot + low] = used_item[at : at + low] = True
                    out.append((spot, at, low))
                    break
        top = low if len(out) > before else low - 1
    return out


class Benchmark:
    """A block of items with the seeds that lead to them."""

    def __init__(self, items: list[tuple[object, str]]):
        self.words: dict[str, int] = {}
        kept = [(key, t) for key, text in items if len(t := tokens(text)) >= MIN_MATCH]
        self.keys = [key for key, _ in kept]
        self.items = [np.array([self.words.setdefault(w, len(self.words)) for w in t]) for _, t in kept]
        # the last value stands for -1, a word in no item
        self.values = np.random.default_rng(11).integers(1, 1 << 63, len(self.words) + 1, dtype=np.uint64)
        seeds = [(h, k) for k, ids in enumerate(self.items) for h in set(Hashes(ids, self.values).windows(MIN_MATCH).tolist())]
        seeds.sort()
        self.seeds = np.array([h for h, _ in seeds], np.uint64)
        self.of = np.array([k for _, k in seeds], np.int64)

    def find(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """(item, tiles, matched tokens, item's tokens) for each item that shares a seed."""
        words = tokens(text)
        if len(words) < MIN_MATCH or not len(self.seeds):
            return
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        starts = open_windows(ids < 0, MIN_MATCH)
        if not len(starts):
            return
        h = Hashes(ids, self.values).windows(MIN_MATCH)[starts]
        at = np.searchsorted(self.seeds, h)
        hit = self.seeds[np.minimum(at, len(self.seeds) - 1)] == h
        if not hit.any():
            return
        starts, h = starts[hit], h[hit]
        covered = np.zeros(len(ids) + 1, np.int64)
        np.add.at(covered, starts, 1)
        np.add.at(covered, starts + MIN_MATCH, -1)
        inside = np.cumsum(covered)[:-1] > 0
        places = np.flatnonzero(inside)
        gaps = np.flatnonzero(np.diff(places) > 1) + 1
        short = np.insert(ids[places], gaps, -1)
        distinct = np.unique(h)
        found = np.unique(np.concatenate([self.of[a:b] for a, b in zip(np.searchsorted(self.seeds, distinct), np.searchsorted(self.seeds, distinct, "right"), strict=True)]))
        for k in found.tolist():
            tiles = tile(short, self.items[k], self.values)
            if tiles:
                yield self.keys[k], len(tiles), sum(n for _, _, n in tiles), len(self.items[k])


def blocks(benchmark: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[Benchmark]:
    """The items in blocks that fit a task; at least one block."""
    items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
        yield Benchmark(sorted(((r.item, r.text) for r in part.collect()), key=lambda r: (r[0] is None, r[0], r[1])))


def contaminations(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, block_chars: int = 16_000_000) -> DataFrame:
    """A row for each text and item with coverage of ``threshold`` or more."""
    spark, out = df.sparkSession, None
    kind, item_kind = df.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {kind}, item {item_kind}, n_tiles long, matched_tokens long, item_tokens long, coverage double"
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole):
                    found = [(k, *f, f[2] / f[3]) for k, t in enumerate(texts_of(batch)) for f in sent.value.find(t) if f[2] >= threshold * f[3]]
                    if found:
                        at, *rest = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column("id").take(pa.array(at)), *(pa.array(x) for x in rest)], ["id", "item", "n_tiles", "matched_tokens", "item_tokens", "coverage"]
                        )

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.5, block_chars: int = 16_000_000) -> DataFrame:
    """The rows that no item contaminates; same columns."""
    for block in blocks(benchmark, item_col, item_text_col, block_chars):
        sent = df.sparkSession.sparkContext.broadcast(block)
        place = df.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = (t or "" for t in batch.column(place).to_pylist())
                yield batch.filter(pa.array([all(m < threshold * n for _, _, m, n in sent.value.find(t)) for t in texts], pa.bool_()))

        df = df.mapInArrow(run, df.schema)
    return df
