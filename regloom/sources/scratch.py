"""Where queries keep files: the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset a local one in local mode, else an error."""
    base = spark.conf.get(SHARED, None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"{SHARED} must name a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="regloom-"))
    return f"{base.rstrip('/')}/regloom/{name}-{uuid.uuid4().hex}"
