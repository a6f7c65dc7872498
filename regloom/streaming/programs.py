"""Programs that arrive on a stream. The operators on rows are the batch ones; only the counts keep state.

This is an addition: batch results over the same rows are the measure of what it gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import asm, vm


def read_sources(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Stream of source texts from JSON files (id, ts, source) that appear in a folder."""
    return spark.readStream.schema("id bigint, ts timestamp, source string").option("maxFilesPerTrigger", per_trigger).json(path)


def executed(sources: DataFrame) -> DataFrame:
    """Parsed and run, row by row: id, ts, errors, trace, status. A text with errors has a null trace."""
    return vm.run(asm.parse(sources)).drop("program", "lines", "regs", "stack")


def op_counts(programs: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Count of each operation in tumbling windows of ``ts``; rows later than ``late`` are left out, and their state with them."""
    each = programs.withWatermark("ts", late).select("ts", F.explode(F.transform("program", lambda x: x["op"])).alias("op"))
    return each.groupBy(F.window("ts", window), "op").agg(F.count("*").alias("n")).select("window.start", "window.end", "op", "n")
