"""Shared plumbing: scratch tables in the cluster's shared folder, table reads, file systems."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: White space as the word contracts define it: space and the bytes 0x09 to 0x0D.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset (tests
    on one machine) is a temporary folder made; off a local master that is an
    error, because executors could not see it.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return _qualified(spark, base)
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="boxwright-")
    atexit.register(shutil.rmtree, base, True)
    spark.conf.set("spark.checkpoint.dir", f"file://{base}")
    spark.sparkContext.setCheckpointDir(f"file://{base}")
    return f"file://{base}"


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as Spark and pyarrow both read it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path  # type: ignore[attr-defined]
    return out


def drop_written(*tables: DataFrame | None) -> None:
    """Removes scratch tables that no returned plan reads any more."""
    for df in tables:
        path = getattr(df, "_scratch", None)
        if path:
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def filesystem(uri: str):
    """pyarrow's file system and the path in it; works for file, hdfs, s3 and gs folders on any executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within it, Arrow batches have so many rows at most: for rows that hold whole sets or texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
