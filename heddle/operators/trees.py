"""Listing and comparing directory trees, and writing commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.scalars import lossy, object_id
from heddle.operators.checks import tree_bytes
from heddle.plans.durable import materialize

TREE_ENTRIES, DIFF_CHANGES = 50_000, 50_000


def list_tree(entries: DataFrame, root: str, levels: int = 64) -> DataFrame:
    """(path, kind, oid, depth) of all entries below a tree, directories too; one join a level."""
    front = materialize(entries.where((F.col("tree") == root) & F.col("kind").isNotNull()).select(F.col("name").alias("path"), "kind", "oid", F.lit(1).alias("depth")), "level")
    out = front
    for d in range(2, levels + 1):
        below = front.where("kind = 'tree'").select(F.col("oid").alias("tree"), F.col("path").alias("prefix"))
        front = materialize(entries.where(F.col("kind").isNotNull()).join(below, "tree").select(F.concat_ws("/", "prefix", "name").alias("path"), "kind", "oid", F.lit(d).alias("depth")), "level")
        if front.where("kind = 'tree'").isEmpty():
            return out.unionByName(front)
        out = out.unionByName(front)
    raise ValueError("the tree is deeper than a path may be")


def cut(rows: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows, flagged if there were more."""
    some = materialize(rows.orderBy(*order).limit(most + 1), "cut")
    return some.orderBy(*order).limit(most).withColumn("truncated", F.lit(some.count() > most))


def in_path_order(changes: DataFrame, most: int = DIFF_CHANGES) -> DataFrame:
    """Changes (path as bytes or text) sorted by the path as text, where bytes that aren't UTF-8 are replaced, and cut with a flag."""
    return cut(changes.withColumn("path", lossy(F.col("path"))), ["path"], most)


def diff_trees(entries: DataFrame, old: str | None, new: str, levels: int = 64) -> DataFrame:
    """(path, change, old_oid, new_oid) of the files that differ below two trees; no tree is read that is the same on both sides.

    ``entries``: tree, name, kind, oid; entries without a kind don't count.  A file that becomes a directory is
    deleted and the paths under it are added.
    """
    known = materialize(entries.where(F.col("kind").isNotNull()).select("tree", "name", (F.col("kind") == "tree").alias("is_tree"), "oid"), "entries")
    spark, out = entries.sparkSession, None
    pair = spark.createDataFrame([("", old, new)] if old != new else [], "path string, a string, b string")
    for _ in range(levels):
        a, b = (pair.where(F.col(k).isNotNull()).join(known, F.col(k) == F.col("tree")).select("path", "name", "is_tree", F.col("oid").alias(f"{k}_oid")) for k in ("a", "b"))
        met = a.join(b, ["path", "name", "is_tree"], "full_outer").where(~F.col("a_oid").eqNullSafe(F.col("b_oid")))
        met = materialize(met.select(F.when(F.col("path") == "", F.col("name")).otherwise(F.concat_ws("/", "path", "name")).alias("path"), "is_tree", "a_oid", "b_oid"), "level")
        change = F.when(F.col("a_oid").isNull(), "added").when(F.col("b_oid").isNull(), "deleted").otherwise("modified")
        files = met.where("not is_tree").select("path", change.alias("change"), F.col("a_oid").alias("old_oid"), F.col("b_oid").alias("new_oid"))
        out = files if out is None else out.unionByName(files)
        pair = met.where("is_tree").select("path", F.col("a_oid").alias("a"), F.col("b_oid").alias("b"))
        if pair.isEmpty():
            return out
    raise ValueError("the tree is deeper than a path may be")


def tree_closure(entries: DataFrame, roots: DataFrame, levels: int = 64) -> DataFrame:
    """Distinct (oid, kind) reachable from trees (oid), the trees included; a shared subtree is read once."""
    front = materialize(roots.select("oid", F.lit("tree").alias("kind")).distinct(), "level")
    seen = front
    for _ in range(levels):
        front = materialize(entries.join(front.where("kind = 'tree'").select(F.col("oid").alias("tree")), "tree").where(F.col("kind").isNotNull()).select("oid", "kind").distinct().join(seen, "oid", "left_anti"), "level")
        seen = seen.unionByName(front)
        if front.where("kind = 'tree'").isEmpty():
            return seen.distinct()
    raise ValueError("the tree is deeper than a path may be")


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change, old_oid, new_oid) between two flat file lists (path, oid); modes don't count."""
    a, b = old.select("path", F.col("oid").alias("old_oid")), new.select("path", F.col("oid").alias("new_oid"))
    both = a.join(b, "path", "full_outer").where(~F.col("old_oid").eqNullSafe(F.col("new_oid")))
    change = F.when(F.col("old_oid").isNull(), "added").when(F.col("new_oid").isNull(), "deleted").otherwise("modified")
    return both.select("path", change.alias("change"), "old_oid", "new_oid")


def edit(base: DataFrame, edits: DataFrame) -> DataFrame:
    """Files (path, oid) after puts and deletes (path, oid; null deletes); deleting what is absent does nothing.

    Raises if a path is edited twice, or a put would be both file and directory.
    """
    if not edits.groupBy("path").count().where("count > 1").isEmpty():
        raise ValueError("a path is edited twice")
    out = base.join(edits, "path", "left_anti").unionByName(edits.where(F.col("oid").isNotNull()).select("path", "oid"))
    parts = F.split("path", "/")
    parents = out.where(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("path")).distinct()
    if not out.join(parents, "path", "left_semi").isEmpty():
        raise ValueError("a path is both a file and a directory")
    return out


def directories(files: DataFrame) -> DataFrame:
    """(path, oid) of every directory, from the deepest up: the hash of its canonical bytes."""
    parts = F.split("path", "/")
    level = files.select("path", "oid", F.lit("100644").alias("mode"))
    deepest = files.agg(F.max(F.size(parts))).first()[0] or 0
    out, above = None, None
    for d in range(deepest, 0, -1):
        here = level.where(F.size(parts) == d)
        here = here if above is None else here.unionByName(above)
        named = here.select(F.when(F.lit(d) > 1, F.array_join(F.slice(parts, 1, d - 1), "/")).otherwise("").alias("dir"), F.element_at(parts, -1).alias("name"), "mode", "oid")
        trees = tree_bytes(named.select(F.col("dir").alias("tree"), "mode", "name", "oid")).select(F.col("tree").alias("dir"), object_id("tree", F.col("content")).alias("oid"))
        found = trees.select(F.col("dir").alias("path"), "oid")
        above = found.select("path", "oid", F.lit("40000").alias("mode"))
        out = found if out is None else out.unionByName(found)
    return out if out is not None else files.select("path", "oid").limit(0)
