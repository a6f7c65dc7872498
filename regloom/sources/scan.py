"""Rows in the order of files: their number over all files, and the first N of them.

Files go by name, rows by their place in the file. A number is an offset plus the place inside a split (a file, or the
range of one that a task reads): splits are counted, the counts are summed up in order on the driver (a row for each
split, which the driver has listed anyway), and every row adds its own place. No window runs over rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Reader = Callable[[list[str]], DataFrame]


def _place(rows: DataFrame) -> tuple[list[Column], Column]:
    """What tells splits apart, in order, and a number that counts up inside one."""
    meta = dict(rows.select("_metadata.*").dtypes)
    if "row_index" in meta:  # Parquet knows a row's place in its file
        return [F.col("_metadata.file_path").alias("_file"), F.lit(0).cast("long").alias("_start")], F.col("_metadata.row_index")
    return [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")], F.monotonically_increasing_id()


def numbered(rows: DataFrame, name: str = "idx") -> DataFrame:
    """``rows``, straight from a file reader, with their number from 0 in the order of files.

    Repeated rows have numbers of their own; no rows: none. A column called ``name`` gives way.
    """
    spark, (split, at) = rows.sparkSession, _place(rows)
    held = rows.select(*(c for c in rows.columns if c != name), *split, at.alias("_at"))
    counts = held.groupBy("_file", "_start").agg(F.count("*").alias("n"), F.min("_at").alias("first")).collect()
    before, total = [], 0
    for r in sorted(counts, key=lambda r: (r["_file"], r["_start"])):
        before.append((r["_file"], r["_start"], total - r["first"]))
        total += r["n"]
    offsets = spark.createDataFrame(before, "_file string, _start bigint, _shift bigint")
    out = held.join(offsets, ["_file", "_start"]).withColumn(name, F.col("_at") + F.col("_shift"))
    return out.select(*(c for c in rows.columns if c != name), name)


def first_rows(read: Reader, files: list[str], n: int, name: str = "idx") -> DataFrame:
    """The first ``n`` rows over ``files``, in the order of their names; later files than needed are not read."""
    files, some = sorted(files), 1
    if not files:
        raise ValueError("no files")
    while some < len(files) and read(files[:some]).count() < n:
        some *= 2
    return numbered(read(files[:some]), name).where(F.col(name) < n)
