"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DIR = "spark.checkpoint.dir"
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset a fresh local one in local mode, else an error."""
    named = spark.conf.get(DIR, None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError(f"{DIR} must name a folder that the driver and all executors share")
    key = spark.sparkContext.applicationId
    return _own.setdefault(key, "file://" + tempfile.mkdtemp(prefix="regloom-"))


def save(spark: SparkSession, df: DataFrame, name: str, compression: str = "zstd", batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors cost nothing.

    Spark removes the shuffle files of the finished write, so that only the table stays on disk. ``batch``: bytes that
    travel to a Python worker at once, for rows that are large.
    """
    path = f"{folder(spark)}/regloom/{name}-{uuid.uuid4().hex}"
    meant = {CLEAN: "true"} | ({BATCH: str(batch)} if batch else {})
    before = {key: spark.conf.get(key) for key in meant}
    for key, value in meant.items():
        spark.conf.set(key, value)
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    out = spark.read.schema(df.schema).parquet(path)
    out._regloom_path = path
    return out


def drop(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete saved tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in tables:
        path = getattr(table, "_regloom_path", None)
        if path:
            with contextlib.suppress(Exception):
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)
