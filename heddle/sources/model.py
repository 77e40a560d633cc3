"""The repository model, derived from the driver's tables.

Events are commits: a user's events in time order are a branch, and some purchases
merge the newest earlier event of the user before.  Documents are files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, branch, ts, kind."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("branch"), "ts", F.col("event_type").alias("kind"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """child, parent, ord.  Both parents, the commit before and a merge's second one, are found by one sorted pass over each branch."""
    c = commits(spark, sf_dir)
    asks = c.where("kind = 'purchase' and id % 10 = 0").select((F.col("branch") - 1).alias("branch"), "ts", F.lit(0).alias("rank"), F.col("id").alias("ask"), F.lit(None).cast("long").alias("id"))
    rows = asks.unionByName(c.select("branch", "ts", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("ask"), "id"))
    newest = F.last("id", ignorenulls=True).over(Window.partitionBy("branch").orderBy("ts", "rank", "id").rowsBetween(Window.unboundedPreceding, -1))
    found = rows.select(F.coalesce("ask", "id").alias("child"), newest.alias("parent"), F.when(F.col("ask").isNull(), 0).otherwise(1).alias("ord"))
    return found.where("child is not null and parent is not null")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, oid: the newest commit of each branch, and tags on some sign-ups."""
    c = commits(spark, sf_dir)
    heads = c.groupBy("branch").agg(F.max_by("id", F.struct("ts", "id")).alias("oid")).select(F.concat(F.lit("refs/heads/u"), "branch").alias("name"), "oid")
    tags = c.where("kind = 'signup' and id % 50 = 0").select(F.concat(F.lit("refs/tags/v"), "id").alias("name"), F.col("id").alias("oid"))
    return heads.unionByName(tags)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, oid, size, doc_id of the documents as files."""
    from heddle.functions.scalars import blob_id

    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), blob_id(F.col("text")).alias("oid"), F.octet_length("text").cast("long").alias("size"), "doc_id")


def tree_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree, name, kind, oid: regions hold nations, nations hold customers."""
    r, n, c = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    top = r.select(F.lit("root").alias("tree"), F.col("r_name").alias("name"), F.lit("tree").alias("kind"), key("r", "r_regionkey").alias("oid"))
    mid = n.select(key("r", "n_regionkey").alias("tree"), F.col("n_name").alias("name"), F.lit("tree").alias("kind"), key("n", "n_nationkey").alias("oid"))
    low = c.select(key("n", "c_nationkey").alias("tree"), F.col("c_name").alias("name"), F.lit("blob").alias("kind"), key("c", "c_custkey").alias("oid"))
    return top.unionByName(mid).unionByName(low)
