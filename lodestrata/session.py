"""Session defaults and tables in the shared folder."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


#: Marks the jobs of this process's scans, so that they can be cancelled and nothing else is.
SCAN_TAG = f"lodestrata-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tagged(spark: SparkSession) -> Iterator[None]:
    """Jobs that this thread starts within carry SCAN_TAG."""
    context = spark.sparkContext
    context.addJobTag(SCAN_TAG)
    try:
        yield
    finally:
        context.removeJobTag(SCAN_TAG)


def session(app: str = "lodestrata", **settings: str) -> SparkSession:
    """A session with UTC, adaptive execution and no speculation (side effects run once)."""
    builder = SparkSession.builder.appName(app)
    fixed = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.speculation": "false",
    }
    return builder.config(map=fixed | settings).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under the temp folder of a local
    master.  On a cluster there is no such fallback: each machine would write to its own disk."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'lodestrata-shared')}"
    return f"{base.rstrip('/')}/scan-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Written and read again: outcomes of side effects must not be computed twice."""
    path = f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
