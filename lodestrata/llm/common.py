"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that a task holds as Python objects at once.
SLICE_ROWS = 128
#: Words longer than this never enter a word cache.
CACHED_WORD_BYTES = 48
CACHE_WORDS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under the session's spark.checkpoint.dir, visible to every executor.

    Where the setting is absent, a local master uses the system's temp dir; on a cluster that is an
    error, as each machine would write to its own disk.  The tables in the folder stay until the
    caller clears it, as results are read from them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{os.path.join(tempfile.gettempdir(), 'lodestrata-shared')}"
    return f"{base.rstrip('/')}/lodestrata-{uuid.uuid4().hex}"


def saved(df: DataFrame, folder: str, name: str) -> DataFrame:
    """`df` written as Parquet in a shared folder and read again: a cut in the lineage."""
    spark, path = df.sparkSession, f"{folder}/{name}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class WordCache(dict):
    """word -> compute(word), forgetting everything when `cap` words are held."""

    __slots__ = ("cap", "compute")

    def __init__(self, compute: Callable, cap: int = CACHE_WORDS):
        super().__init__()
        self.compute, self.cap = compute, cap

    def __missing__(self, word):
        value = self.compute(word)
        if len(word) <= CACHED_WORD_BYTES:
            if len(self) >= self.cap:
                self.clear()
            self[word] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def map_text(df: DataFrame, keep: list[str], text: str, factory: Callable[[], Callable], fields: str) -> DataFrame:
    """One output row per input row: the columns `keep`, then what the function made by
    `factory` (called once per task) returns for the text as a tuple of `fields`."""
    made = T.StructType.fromDDL(fields)
    name = "__text" + "_" * max((len(c) for c in keep), default=0)  # like no kept column
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(name))
    schema = T.StructType([*source.schema.fields[:-1], *made.fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        work = factory()
        kinds = [to_arrow_type(f.dataType) for f in made.fields]
        for part in slices(batches):
            rows = [work(x.as_py()) for x in part.column(part.num_columns - 1)]
            columns = [pa.array(values, kind) for values, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=schema.names)

    return source.mapInArrow(run, schema)
