"""Following links (id, to) to their ends without shuffling them once for every doubling.

Rows that a task reads together are first followed in memory, as far as they lead among themselves; a link
then stands for several.  Where linked rows lie near each other, most links reach their end at once, and only the
ends that differ are left to double.  Joins with a table of every row are never broadcast: compressed files
look far smaller than their rows are in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from heddle.plans.durable import materialize, release


def follow(ids: pa.Array, to: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Where each link of a block leads within it, and over how many links; a link of a ring leads somewhere on it."""
    following = pc.fill_null(pc.index_in(to, value_set=ids, skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    last, n = np.arange(len(ids)), np.ones(len(ids), np.int64)
    for _ in range(len(ids).bit_length()):
        live = np.flatnonzero(following >= 0)
        if not len(live):
            break
        onto = following[live]
        n[live], last[live], following[live] = n[live] + n[onto], last[onto], following[onto]
    return to.take(pa.array(last)), n


def contracted(links: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(id, to, n): every link (id, to; one for each id) led on over the links that its task reads with it, at most ``block`` at once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= block:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
        if rows:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in blocks(batches):
            ids, to = (t.column(k).combine_chunks() for k in ("id", "to"))
            ends, n = follow(ids, to)
            yield from pa.table({"id": ids, "to": ends, "n": pa.array(n)}).to_batches(max_chunksize=1 << 16)

    links = links.select("id", "to")
    return links.mapInArrow(run, StructType([StructField(f.name, f.dataType) for f in links.schema] + [StructField("n", LongType())]))


def climb(nodes: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """(id, to, pos) for every node (id): the end of its links (id, to) and how many lead there.

    Ends that differ are doubled in rounds that grow with the logarithm of the links left between them.
    """
    base = nodes.select("id").join(contracted(links).dropDuplicates(["id"]).hint("merge"), "id", "left")  # the same edge may be given twice
    base = materialize(base.select("id", F.coalesce("to", "id").alias("to"), F.coalesce("n", F.lit(0).cast("long")).alias("pos")), tag)
    now = materialize(base.join(base.select(F.col("to").alias("k")).distinct().hint("merge"), F.col("id") == F.col("k")).select("id", "to", "pos"), tag)
    sum_before = now.agg(F.sum("pos")).first()[0]
    while sum_before:
        far = now.select(F.col("id").alias("k"), F.col("to").alias("to2"), F.col("pos").alias("pos2")).hint("merge")
        after = materialize(now.join(far, F.col("to") == F.col("k")).select("id", F.col("to2").alias("to"), (F.col("pos") + F.col("pos2")).alias("pos")), tag)
        release(now)
        now, sum_now = after, after.agg(F.sum("pos")).first()[0]
        if sum_now == sum_before:
            break
        sum_before = sum_now
    ends = now.select(F.col("id").alias("k"), F.col("to").alias("end"), F.col("pos").alias("pos2")).hint("merge")
    out = materialize(base.join(ends, F.col("to") == F.col("k")).select("id", F.col("end").alias("to"), (F.col("pos") + F.col("pos2")).alias("pos")), tag)
    release(now)
    release(base)
    return out
