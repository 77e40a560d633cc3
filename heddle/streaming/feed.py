"""The change feed as a stream: full state first, then every change in order."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StringType, StructField, StructType

CHANGES = StructType([StructField("repo", StringType()), StructField("name", StringType()), StructField("oid", StringType()), StructField("version", LongType())])


def follow(spark: SparkSession, folder: str, files_at_once: int = 64) -> DataFrame:
    """An append-only folder of changes as a stream, in batches of at most so many files."""
    return spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def current(changes: DataFrame) -> DataFrame:
    """The last value of each ref; runs in update mode on a stream."""
    return changes.groupBy("repo", "name").agg(F.max_by("oid", "version").alias("oid"), F.max("version").alias("version"))


def deliver(changes: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch to ``sink`` once, in order."""
    return changes.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


FOLDED = "repo string, version long, refs long, applied long, waiting long"


def folded(changes: DataFrame) -> DataFrame:
    """A stateful fold: each repository's refs and version, patched by its changes as they come.

    A change applies if its version follows the one held; versions already held are passed over, and those that
    come too early wait in the state until the gap closes.  Each batch gives a row for every repository it touched: version, number
    of refs, how many changes have been applied and how many wait.
    """

    def patch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, applied, names, oids, early = state.get if state.exists else (0, 0, [], [], [])
        refs, waiting = dict(zip(names, oids, strict=True)), {v: (n, o) for v, n, o in early}
        for batch in batches:
            for name, oid, v in zip(batch["name"], batch["oid"], batch["version"], strict=True):
                if v > version:
                    waiting[int(v)] = (name, oid)
        while version + 1 in waiting:
            version, applied = version + 1, applied + 1
            name, oid = waiting.pop(version)
            if oid is None:
                refs.pop(name, None)
            else:
                refs[name] = oid
        state.update((version, applied, list(refs), list(refs.values()), [(v, n, o) for v, (n, o) in sorted(waiting.items())]))
        yield pd.DataFrame({"repo": [key[0]], "version": [version], "refs": [len(refs)], "applied": [applied], "waiting": [len(waiting)]})

    held = "version long, applied long, names array<string>, oids array<string>, early array<struct<version:long,name:string,oid:string>>"
    return changes.groupBy("repo").applyInPandasWithState(patch, FOLDED, held, "update", GroupStateTimeout.NoTimeout)


def from_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The feed of a subscriber that starts, or lags too far: the full state (repo, name, oid, version) first, then what came after it."""
    at = state.groupBy("repo").agg(F.max("version").alias("at"))
    later = changes.join(at, "repo", "left").where("at is null or version > at").select("repo", "name", "oid", "version")
    return state.select("repo", "name", "oid", "version", F.lit(0).alias("part")).unionByName(later.withColumn("part", F.lit(1)))
