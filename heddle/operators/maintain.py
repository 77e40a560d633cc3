"""Storage upkeep as data processing."""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing(references: DataFrame, objects: DataFrame) -> DataFrame:
    """References (source, oid, kind) without an object, or with one of another kind."""
    met = references.join(objects.select("oid", F.col("kind").alias("found")), "oid", "left")
    return met.where("found is null or found <> kind").select("source", "oid", "kind", F.when(F.col("found").isNull(), "MISSING").otherwise("WRONG_KIND").alias("fault"))


def kind_conflicts(references: DataFrame) -> DataFrame:
    return references.groupBy("oid").agg(F.count_distinct("kind").alias("kinds")).where("kinds > 1")


def oldest_copies(objects: DataFrame) -> DataFrame:
    """One row for each oid: the copy with the smallest dense id, by partial aggregation."""
    rest = [c for c in objects.columns if c != "oid"]
    return objects.groupBy("oid").agg(F.min(F.struct("dense_id", *(c for c in rest if c != "dense_id"))).alias("o")).select("oid", "o.*")


def new_objects(pack: DataFrame, stored: DataFrame) -> DataFrame:
    """First copies in a pack of objects that aren't stored."""
    return oldest_copies(pack).join(stored.select("oid"), "oid", "left_anti")


def dense_ids(layers: DataFrame, most: int = (1 << 32) - 1) -> DataFrame:
    """``layers`` (repo, seq, objects) with the first id of each, contiguous in order; an empty layer gets none, nor does one that runs over ``most`` ids or comes after it."""
    before = F.coalesce(F.sum("objects").over(Window.partitionBy("repo").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    return layers.select("repo", "seq", "objects", F.when((F.col("objects") > 0) & (before + F.col("objects") <= most), before).alias("first_id"))


def sweepable(listed: DataFrame, named: DataFrame, now_ms: int, current: int, retention_ms: int, window: int = 2) -> DataFrame:
    """Listed files (file, generation, unnamed_since) that no manifest names, out of the generation window and unnamed long enough."""
    loose = listed.join(named.select("file"), "file", "left_anti")
    return loose.where((F.col("generation") < current - window) & (F.lit(now_ms) - F.col("unnamed_since") > retention_ms))


def admit(uploads: DataFrame, window: int = 2) -> DataFrame:
    """Uploads (generation, current, inline) with their outcome by the generation window."""
    out = F.when(F.col("inline"), "ACCEPTED").when(F.col("generation") > F.col("current"), "AHEAD").when(F.col("generation") < F.col("current") - window, "STALE").otherwise("ACCEPTED")
    return uploads.withColumn("outcome", out)


def replacement_faults(manifest: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """(run, fault): why layers can't replace others; a run without a fault has no row.

    ``manifest``: repo, layer, first_id, id_span; ``removed``: run, repo, layer, first_id; ``added``: run, first_id, id_span.
    Removed layers must be in the manifest and follow each other there; added ones must have ids, in order, apart,
    and within the range of those removed.
    """
    placed = manifest.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy("first_id")))
    found = removed.join(placed.withColumn("end", F.col("first_id") + F.col("id_span")), ["repo", "layer", "first_id"], "left")
    runs = found.groupBy("run").agg(F.min("first_id").alias("low"), F.max("end").alias("high"), F.count_if(F.col("place").isNull()).alias("lost"), (F.max("place") - F.min("place") + 1 != F.count("*")).alias("gaps"))
    by_id = Window.partitionBy("run").orderBy("first_id")
    stops = F.col("first_id") + F.col("id_span")
    new = added.join(runs.select("run", "low", "high"), "run").withColumn("before", F.greatest("low", F.coalesce(F.lag(stops).over(by_id), F.col("low"))))
    new = new.groupBy("run").agg(F.max((F.col("first_id") < F.col("before")) | (stops > F.col("high"))).alias("outside"), F.max(F.col("id_span") == 0).alias("empty"))
    fault = F.when(F.col("lost") > 0, "GONE").when(F.col("gaps"), "NOT_CONSECUTIVE").when(F.col("outside"), "OUTSIDE").when(F.col("empty"), "EMPTY")
    return runs.join(new, "run", "left").select("run", fault.alias("fault")).where("fault is not null")


def concatenated(graphs: DataFrame) -> DataFrame:
    """One commit graph (node, parent) out of those of layers (seq, nodes: their number, node, parent): numbers move up by the nodes of the layers before.

    A negative parent is outside its layer and stays as it is.
    """
    sizes = graphs.groupBy("seq").agg(F.max("nodes").alias("nodes"))
    # one row for each layer of one merge, a few dozen
    before = sizes.select("seq", F.coalesce(F.sum("nodes").over(Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    moved = graphs.join(before, "seq")
    return moved.select((F.col("node") + F.col("offset")).alias("node"), F.when(F.col("parent") < 0, F.col("parent")).otherwise(F.col("parent") + F.col("offset")).alias("parent"))


def idle(views: DataFrame, now_ms: int, evict_after_ms: int) -> DataFrame:
    """Views (repo, used_at, busy) that nobody holds and that weren't used for longer than allowed."""
    return views.where(~F.col("busy") & (F.lit(now_ms) - F.col("used_at") > evict_after_ms)).select("repo")


def owners(repos: DataFrame, nodes: list[str]) -> DataFrame:
    """Each repository's node: the smallest hash of both, so few move when a node leaves."""
    ranked = F.transform(F.array(*map(F.lit, nodes)), lambda n: F.struct(F.md5(F.concat_ws("|", "repo", n).cast("binary")).alias("h"), n.alias("node")))
    return repos.select("repo", F.array_min(ranked)["node"].alias("node"))


def pick_runs(sizes: list[int], factor: int = 8, floor: int = 64 * 1024) -> list[tuple[int, int]]:
    """Adjacent layers worth merging, oldest first: runs (start, end) of ``factor`` layers or more.

    The largest size from each layer on never grows along the list, so a size class, which reaches to the last layer within
    ``factor`` of the largest one left (small layers count as ``floor``), ends where that falls short: a search, not
    a scan.  Layers then join the open run one by one; a run of ``factor`` layers or more closes before a layer that would
    take its bytes over ``factor`` times the largest, and any run closes with its class.  The list is one repository's
    manifest, a few dozen entries.
    """
    largest = [*accumulate((max(s, floor) for s in reversed(sizes)), max)]  # of the last 1, 2, ... layers
    runs: list[tuple[int, int]] = []
    class_end = first = held = cap = 0
    for at, size in enumerate([*sizes, 0]):
        full = at - first >= factor and held + size > cap
        if at == class_end or full:
            if at - first >= factor:
                runs.append((first, at))
            first, held = at, 0
        if at == class_end and at < len(sizes):
            top = largest[len(sizes) - at - 1]
            cap, class_end = top * factor, len(sizes) - bisect_left(largest, -(-top // factor))
        held += size
    return runs


def compaction_runs(layers: DataFrame, factor: int = 8, floor: int = 64 * 1024) -> DataFrame:
    """(repo, first_seq, last_seq, layers) worth merging, for each repository's layers (repo, seq, bytes); a manifest is a task's row group."""

    def pick(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        seq, found = rows.column("seq").to_pylist(), pick_runs(rows.column("bytes").to_pylist(), factor, floor)
        return pa.table({"repo": rows.column("repo").take(pa.array([0] * len(found), pa.int64())), "first_seq": pa.array([seq[a] for a, _ in found], pa.int64()), "last_seq": pa.array([seq[b - 1] for _, b in found], pa.int64()), "layers": pa.array([b - a for a, b in found], pa.int32())})

    kind = layers.schema["repo"].dataType.simpleString()
    return layers.select("repo", F.col("seq").cast("long").alias("seq"), F.col("bytes").cast("long").alias("bytes")).groupBy("repo").applyInArrow(pick, f"repo {kind}, first_seq long, last_seq long, layers int")


def flush_due(layers: DataFrame, now_ms: int, age_ms: int = 30_000, most_bytes: int = 32 << 20, most: int = 256) -> DataFrame:
    """(repo, due) by the age, bytes and number of the layers (repo, bytes, at) that wait."""
    sums = layers.groupBy("repo").agg(F.min("at").alias("oldest"), F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    due = F.when(F.col("n") >= most, "count").when(F.col("bytes") >= most_bytes, "bytes").when(F.lit(now_ms) - F.col("oldest") >= age_ms, "age")
    return sums.select("repo", due.alias("due"))


def stored_prefix(layers: DataFrame) -> DataFrame:
    """The layers (repo, seq, bytes, inline) before the first inline one of their repository."""
    first = layers.where("inline").groupBy("repo").agg(F.min("seq").alias("first"))
    return layers.join(first, "repo", "left").where("first is null or seq < first").select("repo", "seq", "bytes")


def pending(changed: DataFrame, settled: DataFrame) -> DataFrame:
    """(repo, version) of repositories whose last layer change isn't settled yet, at a version as new."""
    last = changed.groupBy("repo").agg(F.max("version").alias("version"))
    done = settled.groupBy("repo").agg(F.max("version").alias("done"))
    return last.join(done, "repo", "left").where("done is null or done < version").select("repo", "version")


def reclaimable(listed: DataFrame, ended: DataFrame, now_ms: int, retention_ms: int) -> DataFrame:
    """Files (repo, epoch, file, generation, since) of ended incarnations (repo, epoch, marker), up to the marker's generation, after retention."""
    met = listed.join(ended, ["repo", "epoch"])
    return met.where((F.col("generation") <= F.col("marker")) & (F.lit(now_ms) - F.col("since") > retention_ms)).select("file")


def republish(uploads: DataFrame) -> DataFrame:
    """Uploads that were refused as stale, to be proposed again under the current generation."""
    return uploads.where("outcome = 'STALE'").withColumn("generation", F.col("current")).drop("outcome")
