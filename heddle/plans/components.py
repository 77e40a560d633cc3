"""Connected components by alternating stars.

The driver sees only two numbers a round.  Each round hangs the larger neighbours
of a node on its smallest one, then the smaller ones too, until every component
is a star around its smallest node; the number of rounds grows with the logarithm of
a component's size.  Smallest neighbours are found by aggregation with partial
sums, and joined back to the edges, where a hub's edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.plans.durable import materialize, release


def stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that isn't its component's smallest."""
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    before = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if mark == before or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        hung = both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(hung, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after = materialize(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        release(large)
        release(now)
        now = after
