"""Language-model scores of texts: word frequencies and a suffix tree.

Tokens are lower-cased words and one end for each text.  One pass packs the texts of
each input split into blocks: the block's dictionary, each text as places in that dictionary, and
the block's distinct words and byte runs with their training counts, dealt by hash into parts.
Then, without a task that holds more than a block, a part or a leaf:

* words are summed part by part, and their corpus-wide counts go back to the blocks; a frequent word
  has one entry for each block, never one for each occurrence;
* runs are summed in the same way to the corpus' distinct runs; those are gathered by the last bytes
  of their contexts, the leaves in which the suffix tree is worked out (see ``suffix_tree``); and the
  runs' probabilities go back by part to the blocks that asked for them;
* each block scores its texts with both.

Nothing is sent to all tasks but the counts of the tree's roots, at most 65,536 numbers.

Defined results: null and empty texts are one end token; a null id counts as
held out; repeated rows are scored (and learned from) each; with nothing to learn
from, every base probability is that of an unseen token and the tree is uniform;
extra columns are ignored; texts are taken whole; no rows give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm import suffix_tree
from heddle.llm.arrow import slices, texts_of, words_of
from heddle.plans.durable import materialize

BLOCK_ROWS, BLOCK_CHARS = 8192, 24_000_000
#: Bytes of text whose words and runs one part holds, about, and the least number of parts.
PART_BYTES, LEAST_PARTS = 100_000_000, 64
NAMES = ["block", "id", "held", "n_tokens", "places", "part", "words", "runs", "times"]
PACKED = "block long, id {id}, held boolean, n_tokens long, places binary, part int, words binary, runs binary, times binary"
KINDS = [pa.int64(), None, pa.bool_(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def planes(numbers: np.ndarray, kind: str) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on; small or sorted ones compress well so."""
    return numbers.astype(kind)[:, None].view(np.uint8).T.tobytes()


def unplaned(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


class _Places(dict):
    """Words to their places in a dictionary that grows."""

    def __missing__(self, word: bytes) -> int:
        at = self[word] = len(self)
        return at


def parts_of_runs(run: np.ndarray, parts: int) -> np.ndarray:
    """The part of each run, by a mix of its bits."""
    mixed = run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def parts_of_words(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts


def pack(df: DataFrame, held: Column, id_col: str, text_col: str, parts: int) -> DataFrame:
    """For each block rows of its texts (places), one of its dictionary, and one for each part of its words and of its runs."""
    kind = df.schema[id_col].dataType.simpleString()

    def rows(id_kind: pa.DataType, n: int, block: int, **columns: pa.Array) -> pa.RecordBatch:
        given = {"block": pa.array([block] * n, pa.int64())} | columns
        return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, k or id_kind) for c, k in zip(NAMES, KINDS, strict=True)], NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        places, trained, chars, n = _Places(), np.zeros(1 << 12, np.int64), 0, 0
        streams: tuple[list[bytes], list[bytes]] = ([], [])

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal places, trained, chars, made, streams, n
            block = (task << 32) + made
            yield rows(id_kind, 1, block, words=pa.array([b"\n".join(places)], pa.binary()))
            words, of = list(places), parts_of_words(list(places), parts)
            order = np.argsort(of, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                if len(own):
                    joined, times = b"\n".join([words[k] for k in own.tolist()]), planes(trained[own], "<u4")
                    yield rows(id_kind, 1, block, part=pa.array([of[own[0]]], pa.int32()), words=pa.array([joined], pa.binary()), times=pa.array([times], pa.binary()))
            code, times = suffix_tree.count_runs([(streams[0], 1), (streams[1], 0)])
            of = parts_of_runs(code, parts)
            order = np.argsort(of, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
                if len(own):
                    yield rows(id_kind, 1, block, part=pa.array([of[own[0]]], pa.int32()), runs=pa.array([planes(code[own], "<i8")], pa.binary()), times=pa.array([planes(times[own], "<u4")], pa.binary()))
            places, trained, streams, chars, n, made = _Places(), np.zeros(1 << 12, np.int64), ([], []), 0, 0, made + 1

        for whole in batches:
            for batch in slices(whole, 500):
                id_kind, texts = batch.column("id").type, []
                for text, out in zip(texts_of(batch), batch.column("held").to_pylist(), strict=True):
                    words = words_of(text)
                    at = np.fromiter(map(places.__getitem__, words), np.int64, len(words))
                    if len(places) > len(trained):
                        trained = np.concatenate([trained, np.zeros(max(len(trained), len(places)), np.int64)])
                    if not out:
                        trained += np.bincount(at, minlength=len(trained))
                    chars += len(text)
                    streams[out].append(suffix_tree.stream(words))
                    texts.append((len(words) + 1, planes(at, "<u4")))
                n += len(texts)
                n_tokens, packed = zip(*texts, strict=True)
                yield rows(id_kind, len(texts), (task << 32) + made, id=batch.column("id"), held=batch.column("held"), n_tokens=pa.array(n_tokens, KINDS[3]), places=pa.array(packed, KINDS[4]))
                if n >= BLOCK_ROWS or chars >= BLOCK_CHARS:
                    yield from flush()
        if n:
            yield from flush()

    given = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    return given.mapInArrow(run, PACKED.format(id=kind))


def word_counts(asked: DataFrame) -> DataFrame:
    """Rows (of_block, part, totals, distinct): the corpus' counts of a block's words in a part; ``distinct`` sums to the number of trained words."""

    def gather(rows: pa.Table) -> pa.Table:
        words = [x.split(b"\n") for x in rows.column("words").to_pylist()]
        total: dict[bytes, int] = {}
        for own, times in zip(words, rows.column("times").to_pylist(), strict=True):
            for word, k in zip(own, unplaned(times, "<u4").tolist(), strict=True):
                total[word] = total.get(word, 0) + k
        found = [planes(np.fromiter(map(total.__getitem__, own), np.int64, len(own)), "<i8") for own in words]
        distinct = [sum(k > 0 for k in total.values())] + [0] * (len(found) - 1)
        return pa.table({"of_block": rows.column("block"), "part": rows.column("part"), "totals": pa.array(found, pa.binary()), "distinct": pa.array(distinct, pa.int64())})

    return asked.groupBy("part").applyInArrow(gather, "of_block long, part int, totals binary, distinct long")


def tree(asked: DataFrame, least: int, min_gain: float) -> DataFrame:
    """Rows (of_block, runs, logp) with the log10 probability of each run that a block asks for; asked: block, part, runs, times."""

    def gather(rows: pa.Table) -> pa.Table:
        codes = [unplaned(x, "<i8") for x in rows.column("runs").to_pylist()]
        run, n = suffix_tree.counted(codes, [unplaned(x, "<u4").astype(np.int64) for x in rows.column("times").to_pylist()])
        ending = np.where(suffix_tree.depth_of(run) > suffix_tree.ROOTS, suffix_tree.ending(run), -1)
        return pa.table({"part": pa.array(np.full(len(run), rows.column("part")[0].as_py()), pa.int32()), "run": run, "n": n, "ending": ending})

    distinct = materialize(asked.groupBy("part").applyInArrow(gather, "part int, run long, n long, ending long"), "runs")
    last = distinct.groupBy(F.col("run").bitwiseAND((1 << 8 * (suffix_tree.ROOTS + 1)) - 1).alias("run")).agg(F.sum("n").alias("n")).toArrow()
    sent = asked.sparkSession.sparkContext.broadcast(suffix_tree.roots(*(last.column(c).to_numpy().astype(np.int64) for c in ("run", "n"))))

    def leaf(rows: pa.Table) -> pa.Table:
        run, base = rows.column("run").to_numpy(), sent.value
        if rows.column("ending")[0].as_py() < 0:
            p = np.log10(base["p"][np.searchsorted(base["run"], run & np.int64((1 << 8 * (suffix_tree.ROOTS + 1)) - 1))])
        else:
            order = np.argsort(run)
            p = np.empty(len(run))
            p[order] = suffix_tree.probabilities(run[order], rows.column("n").to_numpy()[order], base, least, min_gain)
        return pa.table({"part": rows.column("part"), "run": run, "logp": p.astype(np.float32)})

    told = distinct.groupBy("ending").applyInArrow(leaf, "part int, run long, logp float")

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        run = right.column("run").to_numpy()
        order = np.argsort(run)
        run, p = run[order], right.column("logp").to_numpy()[order]
        found = [planes(p[np.searchsorted(run, unplaned(x, "<i8"))], "<f4") for x in left.column("runs").to_pylist()]
        return pa.table({"of_block": left.column("block"), "runs": left.column("runs"), "logp": pa.array(found, pa.binary())})

    return asked.select("block", "part", "runs").groupBy("part").cogroup(told.groupBy("part")).applyInArrow(answer, "of_block long, runs binary, logp binary")


def scores(streams: list[bytes], run: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """The sum of the log10 probabilities of each stream's runs; ``run`` in order."""
    total, size = np.zeros(len(streams)), np.array([len(s) for s in streams])
    stop, done = np.cumsum(size), 0
    for window in suffix_tree.runs(streams):
        p = logp[np.searchsorted(run, window)].astype(np.float64)
        ahead = done + len(p)
        first, last = np.searchsorted(stop, done, "right"), np.searchsorted(stop, ahead - 1, "right")
        cuts = np.maximum(stop[first:last] - done, 0)
        total[first : last + 1] += np.add.reduceat(p, np.concatenate([[0], cuts]))
        done = ahead
    return total


def score_texts(df: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", least: int = 4, min_gain: float = 5.0) -> DataFrame:
    """Id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row.

    A context is a state of the tree if it occurred ``least`` times and diverges by ``min_gain`` nats in all.
    """
    kind = df.schema[id_col].dataType.simpleString()
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(LEAST_PARTS, 1 + size // PART_BYTES)
    packed = materialize(pack(df, held, id_col, text_col, parts), "packed")
    texts = packed.where("part is null").select("block", "id", "held", "n_tokens", "places", "words")
    asked = packed.where("part is not null")
    counts = materialize(word_counts(asked.where("words is not null").select("block", "part", "words", "times")), "counts")
    ends, n = texts.where(~F.col("held")).agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    v = (counts.agg(F.sum("distinct")).first()[0] or 0) + (ends > 0)
    told = tree(asked.where("runs is not null").select("block", "part", "runs", "times"), least, min_gain)
    nothing = F.lit(None).cast("binary")
    back = counts.select("of_block", "part", "totals", nothing.alias("runs"), nothing.alias("logp")).unionByName(told.select("of_block", F.lit(None).cast("int").alias("part"), nothing.alias("totals"), "runs", "logp"))

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        joined = left.filter(left.column("words").is_valid()).column("words")[0].as_py()
        dictionary = joined.split(b"\n") if joined else []
        left, found, asked = left.filter(left.column("words").is_null()), right.filter(right.column("part").is_valid()), right.filter(right.column("part").is_null())
        c, of = np.zeros(len(dictionary), np.int64), parts_of_words(dictionary, parts)
        order = np.argsort(of, kind="stable")
        start = np.searchsorted(of[order], np.arange(parts + 1)) if len(found) else []
        for k, totals in zip(found.column("part").to_pylist(), found.column("totals").to_pylist(), strict=True):
            c[order[start[k] : start[k + 1]]] = unplaned(totals, "<i8")
        base, known = np.log10((c + 0.1) / (n + 0.1 * (v + 1))), c > 0
        end = float(np.log10((ends + 0.1) / (n + 0.1 * (v + 1))))
        runs = np.concatenate([np.zeros(0, np.int64), *(unplaned(x, "<i8") for x in asked.column("runs").to_pylist())])
        logp = np.concatenate([np.zeros(0, np.float32), *(unplaned(x, "<f4") for x in asked.column("logp").to_pylist())])
        order = np.argsort(runs)
        runs, logp = runs[order], logp[order]
        known_n, base_score, score = [], [], []
        for batch in left.select(["places"]).to_batches(max_chunksize=500):
            streams = []
            for places in batch.column("places").to_pylist():
                at = unplaned(places, "<u4").astype(np.int64)
                known_n.append(int(known[at].sum()) + (ends > 0))
                base_score.append(float(base[at].sum()) + end)
                streams.append(suffix_tree.stream([dictionary[k] for k in at.tolist()]))
            score.append(scores(streams, runs, logp))
        return pa.table(
            {"id": left.column("id"), "held_out": left.column("held"), "n_tokens": left.column("n_tokens"), "n_known": pa.array(known_n, pa.int64()), "train_tokens": pa.array([n] * len(known_n), pa.int64()), "base_score": pa.array(base_score, pa.float64()), "score": pa.array(np.concatenate([np.zeros(0), *score]))}
        )

    out = texts.groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(total, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
