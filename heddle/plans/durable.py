"""Cutting lineage with tables that every executor can read again.

A result that later jobs build on is written as Parquet into the folder the
cluster names in ``spark.checkpoint.dir``.  A lost executor loses no part of it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session.

    ``spark.checkpoint.dir`` is read from the session.  Where it is unset, a
    local master (tests) gets a temporary folder of its own; a cluster gets an
    error, as no folder of one machine would do there.
    """
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    made = f"file://{tempfile.mkdtemp(prefix='heddle-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back without its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/heddle/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a frame made by :func:`materialize`."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    marker = f"{shared_dir(spark)}/heddle/".split("://", 1)[-1].lstrip("/")
    folders = {name.rsplit("/", 1)[0] for name in df.inputFiles()}
    for folder in folders:
        if marker in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
