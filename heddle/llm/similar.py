"""Links between texts whose word shingles are similar, for any share of common shingles.

The steps are those of ``simhash``, for sets of shingles.  Each distinct set has its SimHash
fingerprint, and ``near_pairs`` links fingerprints within two bits through its table of distances to references.
Texts of a similarity near 0.8 have fingerprints that differ in up to 14 of 64 bits
on the test tables, where no such table finds them.  So that they are linked too, texts meet in two ways:

- in a component of near fingerprints; every link in one is found;
- in one of 20 bands of five minimum hashes, which bring a pair of similarity 0.8 together with a chance of 0.9996.

However two texts meet, they pass a second table of distances and a verification.  Sets are at a distance of the number
of shingles that only one of them has, which obeys the triangle inequality.  Reference k holds all
shingles whose hash has no bit k; a set of n shingles, of which c have the bit, is 2c - n further from it than the empty set.
These 64 numbers are the sums that SimHash takes its signs of; n is the distance to a 65th, empty reference.  Sets with a share of
``similarity`` in common are at most (1 - similarity) / (1 + similarity) times their sizes' sum apart, so pairs whose maximum
coordinate difference is larger are discarded, and no link is lost by it.  The rest are
verified on the whole sets of shingles.

Texts with equal sets collapse first.  Texts that meet in one way are a group.  A first pass
links the bulk of large groups cheaply: one with more than ``CROWD`` texts is dealt at random into parts of
about that size, differently for each way, and all its texts are compared with its first one as
well; a part of more than four texts gives a spanning forest of the closest fingerprints.

What that leaves is then exhausted.  Groups whose texts are in several trees of verified links
are dealt into tiles, in which every pair from different trees passes table and verification until
it is joined by verified links or found dissimilar.  The texts of a group's largest tree are not
compared with each other, so a group of near copies costs its size times that of the
rest.  A group of many texts just below the threshold costs all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from heddle.llm.arrow import slices, texts_of, words_of
from heddle.llm.shingles import find, forest, of_ones, ones_of, shingles
from heddle.plans.components import stars
from heddle.plans.durable import materialize

BANDS, DEPTH, CROWD, FEW = 20, 5, 64, 4
#: Shingles of the texts that one side of a tile holds, about.
HEAVY = 400_000
_RNG = np.random.default_rng(20240608)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RNG.integers(0, 1 << 64, BANDS * DEPTH, dtype=np.uint64)


def bands(distinct: np.ndarray) -> list[int]:
    """A key for each band of minimum hashes; none for an empty set."""
    if not len(distinct):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(distinct), 1024):
        np.minimum(least, (distinct[start : start + 1024, None] * _TIMES + _PLUS).min(0), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), k) - (1 << 63) for k, part in enumerate(least.reshape(BANDS, DEPTH))]


def sketches(df: DataFrame, text_col: str, size: int) -> DataFrame:
    """The rows of ``df`` as ``rec``, with digest of the shingle set, its fingerprint, size, distances to the references and band keys."""
    rows = df.select(F.struct(*df.columns).alias("rec"), F.col(text_col).alias("text"))
    more = [StructField("digest", StringType()), StructField("fp", LongType()), StructField("n", LongType()), StructField("far", ArrayType(IntegerType())), StructField("bands", ArrayType(LongType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                digest, fp, n, far, keys = [], [], [], [], []
                for text in texts_of(batch):
                    own = np.unique(shingles(words_of(text), size))
                    ones = ones_of(own)
                    digest.append(xxhash.xxh3_128_hexdigest(own.tobytes()))
                    fp.append(of_ones(ones, len(own)))
                    n.append(len(own))
                    far.append(2 * ones - len(own))
                    keys.append(bands(own))
                found = [pa.array(digest, pa.string()), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(n, pa.int64()), pa.array(far, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("rec"), *found], ["rec", *(f.name for f in more)])

    return rows.mapInArrow(run, StructType([rows.schema["rec"], *more]))


def reach(sizes: Column | np.ndarray, similarity: float) -> Column | np.ndarray:
    """The largest distance of sets with this share in common, from the sum of their sizes; rounding loses no link."""
    return sizes * ((1 - similarity) / (1 + similarity) * (1 + 1e-9))


def compared(node: np.ndarray, fp: np.ndarray, n: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs of one part that are worth verifying: all of few texts, else a spanning forest, closest first."""
    i, j = np.triu_indices(len(node), 1)
    apart = np.bitwise_count(fp[i] ^ fp[j])
    able = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j])
    i, j, apart = i[able], j[able], apart[able]
    if len(node) <= FEW:
        return list(zip(node[i].tolist(), node[j].tolist(), strict=True))
    order = np.argsort(apart, kind="stable")
    return forest(node[i[order]], node[j[order]])


def groups(nodes: DataFrame) -> DataFrame:
    """The nodes (node, fp, n, bands) of each key that several share, with its number of nodes and its first one.

    Band 0 is the component of the fingerprint, the others are those of minimum hashes.
    """
    rows = nodes.select("node", "fp", "n", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("many"), F.min(F.struct("node", "fp", "n")).alias("lead")).where("many > 1")
    return rows.join(shared, ["band", "key"])


def candidates(met: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of the groups' nodes that may be similar: all of a small group, some of a larger one."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4

        def give(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            part, node, fp, n = rows
            first = np.flatnonzero(np.diff(part, prepend=~part[:1]))
            out = []
            for start, stop in zip(first, [*first[1:], len(part)], strict=True):
                if stop - start > 1:
                    out += compared(node[start:stop], fp[start:stop].view(np.uint64), n[start:stop], similarity)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in out], pa.int64()), pa.array([max(p) for p in out], pa.int64())], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            cut = np.searchsorted(held[0], held[0][-1]) if len(held[0]) else 0
            if cut >= 20_000:  # all but the last part are complete
                yield from give([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        yield from give(held)

    salt = F.pmod(F.xxhash64("node", "band"), F.ceil(F.col("many") / CROWD))
    parts = met.select(F.xxhash64("band", "key", salt).alias("part"), "node", "fp", "n").repartition("part").sortWithinPartitions("part", "node")
    within = parts.mapInArrow(link, "a long, b long")
    able = F.least("n", "lead.n") >= similarity * F.greatest("n", "lead.n")
    led = met.where((F.col("many") > CROWD) & (F.col("node") != F.col("lead.node")) & able).select(F.col("lead.node").alias("a"), F.col("node").alias("b"))
    return within.unionByName(led).distinct()


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this share in common; texts: node, text, n, far."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, 100):
                good = []
                for x, y in zip(texts_of(batch, "x"), texts_of(batch, "y"), strict=True):
                    p, q = (np.unique(shingles(words_of(t), size)) for t in (x, y))
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(both >= similarity * (len(p) + len(q) - both))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    x, y = (texts.select(F.col("node").alias(k), F.col("text").alias(t), F.col("n").alias(f"n{t}"), F.col("far").alias(f"far{t}")) for k, t in (("a", "x"), ("b", "y")))
    both = pairs.join(x.hint("merge"), "a").join(y.hint("merge"), "b")
    gap = F.array_max(F.zip_with("farx", "fary", lambda p, q: F.abs(p - q)))  # that of the sizes was looked at when the pair met
    able = both.where(gap <= reach(F.col("nx") + F.col("ny"), similarity))
    return able.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def tiles(met: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows (node, label, band, tile, side) of the groups whose nodes are in several trees of ``roots``.

    Every two nodes with different labels meet in a tile: those of one side in a tile
    with one side, others in a tile with two.  A set of nodes that is a group in several bands is dealt once.
    """
    rows = met.where(F.col("many") > FEW).select("band", "key", "node", "n")
    rows = rows.join(roots.select(F.col("node").alias("at"), "root").hint("merge"), F.col("node") == F.col("at"), "left").select("band", "key", "node", "n", F.coalesce("root", "node").alias("label"))
    trees = rows.groupBy("band", "key", "label").agg(F.count("*").alias("many"), F.sum("n").alias("size"), *(F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"x{k}") for k in (0, 1)))
    most = F.max(F.struct("many", "label", "size")).alias("most")
    found = trees.groupBy("band", "key").agg(F.sum("many").alias("many"), F.sum("size").alias("size"), F.count("*").alias("trees"), most, *(F.bit_xor(x).alias(x) for x in ("x0", "x1"))).where("trees > 1")
    parts = lambda many, size: F.ceil(F.greatest(many / CROWD, size / HEAVY)).cast("int")
    whole, bulk = parts(F.col("many"), F.col("size")) <= 1, F.col("most")
    found = found.select("band", "key", "many", "x0", "x1", bulk["label"].alias("bulk"), F.when(whole, 0).otherwise(parts(bulk["many"], bulk["size"])).alias("first"), F.when(whole, 1).otherwise(F.greatest(F.lit(1), parts(F.col("many") - bulk["many"], F.col("size") - bulk["size"]))).alias("others"))
    found = found.groupBy("many", "x0", "x1").agg(F.min(F.struct("band", "key", "bulk", "first", "others")).alias("g")).select("g.*")
    rows = rows.join(found, ["band", "key"])
    hashed = F.xxhash64("band", "node")
    own = F.when((F.col("first") > 0) & (F.col("label") == F.col("bulk")), F.pmod(hashed, F.greatest("first", F.lit(1)))).otherwise(F.col("first") + F.pmod(hashed, F.col("others"))).cast("int")
    rows = rows.withColumn("own", own)
    # blocks of the largest tree meet those of the others only
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("own") < F.col("first"), F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("others") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    return rows.select("node", "label", "band", F.xxhash64("band", "key", F.least("own", "other"), F.greatest("own", "other")).alias("tile"), side.alias("side"))


def exhausted(dealt: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Verified links (a, b) that join the trees in each tile; texts: node, text, fp, n, far, bands."""

    def joined(t: pa.Table) -> list[tuple[int, int]]:
        node, label, side, fp, n = (t.column(c).to_numpy() for c in ("node", "label", "side", "fp", "n"))
        band = t.column("band")[0].as_py()
        keys = t.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS + 1)
        far = t.column("far").combine_chunks().flatten().to_numpy().reshape(-1, 64)
        i, j = np.triu_indices(len(node), 1)
        able = (label[i] != label[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]))
        i, j = i[able], j[able]
        able = np.abs(far[i] - far[j]).max(1, initial=0) <= reach(n[i] + n[j], similarity)
        i, j = i[able], j[able]
        for earlier in range(band):  # met in an earlier band
            new = keys[i, earlier] != keys[j, earlier]
            i, j = i[new], j[new]
        order = np.argsort(np.bitwise_count((fp[i] ^ fp[j]).view(np.uint64)), kind="stable")
        root: dict[int, int] = {}
        sets: dict[int, np.ndarray] = {}
        out, text, label = [], t.column("text"), label.tolist()
        for x, y in zip(i[order].tolist(), j[order].tolist(), strict=True):
            p, q = find(root, label[x]), find(root, label[y])
            if p == q:
                continue
            for k in (x, y):
                if k not in sets:
                    sets[k] = np.unique(shingles(words_of(text[k].as_py() or ""), size))
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            if both >= similarity * (len(sets[x]) + len(sets[y]) - both):
                root[p] = q
                out.append((int(node[x]), int(node[y])))
        return out

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def give(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = joined(pa.Table.from_batches(batches)) if sum(b.num_rows for b in batches) > 1 else []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

        for batch in batches:
            tile = batch.column("tile").to_numpy()
            starts = np.flatnonzero(np.diff(tile)) + 1
            for start, stop in zip([0, *starts], [*starts, len(tile)], strict=True):
                if stop > start:
                    if held and held[0].column("tile")[0].as_py() != tile[start]:
                        yield from give(held)
                        held = []
                    held.append(batch.slice(start, stop - start))
        if held:
            yield from give(held)

    rows = dealt.join(texts.hint("merge"), "node").repartition("tile").sortWithinPartitions("tile", "node")
    return rows.mapInArrow(link, "a long, b long").distinct()


def with_components(nodes: DataFrame, near_pairs: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The nodes with the component of their fingerprint as the first of their bands; an empty set has none."""
    roots = stars(near_pairs(nodes.where("n > 0").select("fp").distinct())).select(F.col("node").alias("of"), "root")
    first = F.array(F.coalesce("root", "fp"))
    bands = F.when(F.col("n") > 0, F.concat(first, "bands")).otherwise(F.col("bands"))
    return nodes.join(roots.hint("merge"), F.col("fp") == F.col("of"), "left").select("node", "fp", "n", bands.alias("bands"))


def grouped(df: DataFrame, text_col: str, size: int, similarity: float, near_pairs: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Written tables of rows (rec, row) and of labels (at, label); rows with one label are linked by similar texts.

    ``near_pairs`` links distinct fingerprints (fp) by pairs (a, b) that keep each component together.
    """
    found = materialize(sketches(df, text_col, size).withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = found.groupBy("digest").agg(F.min("row").alias("node"))
    own = found.select("row", "fp", "n", "bands")
    nodes = materialize(own.join(nodes.select("node").hint("merge"), F.col("row") == F.col("node")).select("node", "fp", "n", "bands"), "nodes")
    nodes = materialize(with_components(nodes, near_pairs), "nodes")
    met = materialize(groups(nodes), "groups")
    pairs = materialize(candidates(met, similarity), "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("at")).unionByName(met.where(F.col("many") > FEW).select(F.col("node").alias("at"))).distinct()
    asked = nodes.join(asked.hint("merge"), F.col("node") == F.col("at"), "left_semi")
    texts = found.select(F.col("row").alias("node"), F.col("rec")[text_col].alias("text"), "far")
    texts = materialize(texts.join(asked.hint("merge"), "node"), "asked")
    roots = stars(verified(pairs, texts, size, similarity))
    more = materialize(exhausted(tiles(met, roots), texts, size, similarity), "more")
    if not more.isEmpty():
        roots = stars(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    named = found.groupBy("digest").agg(F.min("row").alias("least")).join(roots, F.col("least") == F.col("node"), "left")
    named = named.select(F.col("digest").alias("of"), F.coalesce("root", "least").alias("label"))
    labels = found.select("row", "digest").join(named, F.col("digest") == F.col("of")).select(F.col("row").alias("at"), "label")
    return found.select("rec", "row"), materialize(labels, "labels")
