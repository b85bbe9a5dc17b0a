"""Listings as DataFrames: live from a store, or from an inventory table."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from functools import reduce
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, StringStartsWith

from lodestrata.schemas import LISTING, struct
from lodestrata.session import saved, shared_folder
from lodestrata.sources.objectstore import TOP, FileStore, ObjectStore
from lodestrata.sources.rows import map_rows
from lodestrata.sources.s3store import S3Store

LISTED = T.StructType([T.StructField("scope", T.IntegerType()), *LISTING.fields, T.StructField("error", T.StringType())])
#: A range of keys of a scope: after `after`, up to `until` (null: to the end).  A listed row with `rest` is a range that
#: is left over: what follows `after`.
RANGES = struct("scope int, bucket string, prefix string, after string, until string")
_ROWS = T.StructType([*LISTED.fields, *struct("rest boolean, prefix string, after string, until string").fields])

#: Parts into which a range is cut that proves long, if the caller does not say.
PARTS = 32
#: Keys that are listed of a whole scope before it counts as long, of a range of a later round, and tasks of a round at most.
FIRST_KEYS, RANGE_KEYS, MOST_TASKS = 2000, 50_000, 10_000


def list_scopes(spark: SparkSession, store: ObjectStore, scopes: list[tuple[str, str]], parts: int = PARTS, folder: str | None = None, without: str = "") -> DataFrame:
    """The listing of every scope; a failure is a row with `error`.  Keys that begin with `without` are passed over, about: a few may be listed.

    Rounds of Spark tasks: each lists the beginning of its range, at once; what is left over is cut into ranges
    by looking for keys (`store.cuts`), also in tasks, and these are the next round's.  So long ranges, wherever
    they lie and however keys are named, end up in many tasks, the driver makes no request, and it holds no key.
    """
    folder, rounds = folder or shared_folder(spark), []
    whole = [(i, b, p, after, until) for i, (b, p) in enumerate(scopes) for after, until in _around(p, without)]
    ranges = spark.createDataFrame(whole, RANGES)
    n, most = len(whole), FIRST_KEYS
    while n:
        rounds.append(saved(_listed(ranges.repartition(min(n, MOST_TASKS)), store, most), folder, f"round-{len(rounds)}"))
        left = rounds[-1].where("rest").select(RANGES.fieldNames())
        if not (longer := left.count()):
            break
        ranges = saved(_cut(left.repartition(min(longer, MOST_TASKS)), store, max(0, parts - 1)), folder, f"ranges-{len(rounds)}")
        n, most = ranges.count(), RANGE_KEYS
    return reduce(DataFrame.unionByName, rounds).where("not rest").select(LISTED.fieldNames())


def _around(prefix: str, without: str) -> list[tuple[str, str | None]]:
    """The ranges of a prefix before and behind the keys that begin with `without`."""
    return [("", without), (without + TOP, None)] if without and without.startswith(prefix) and without != prefix else [("", None)]


def _listed(ranges: DataFrame, store: ObjectStore, most: int) -> DataFrame:
    def run(rows: Iterator[dict]):
        for r in rows:
            own, last = {"scope": r["scope"], "bucket": r["bucket"], "rest": False}, r["after"]
            try:
                found = store.list(r["bucket"], r["prefix"], r["after"], r["until"])
                for o in islice(found, most):
                    last = o.key
                    yield own | {"object_key": o.key, "etag": o.etag, "size": o.size, "last_modified": o.last_modified, "content_type": o.content_type}
                if next(found, None) is not None:
                    yield own | {"rest": True, "prefix": r["prefix"], "after": last, "until": r["until"]}
            except Exception as e:  # the row tells the driver, which ends the scan there
                yield own | {"error": f"{type(e).__name__}: {e}"}

    return map_rows(ranges, _ROWS, run)


def _cut(ranges: DataFrame, store: ObjectStore, most: int) -> DataFrame:
    def run(rows: Iterator[dict]):
        for r in rows:
            try:
                ends = store.cuts(r["bucket"], r["prefix"], most, r["after"], r["until"])
            except Exception:  # listing the range will tell
                ends = []
            for after, until in zip([r["after"], *ends], [*ends, r["until"]]):
                yield r | {"after": after, "until": until}

    return map_rows(ranges, RANGES, run)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """A parquet inventory with the listing's columns; filters and columns reach its scan."""
    return spark.read.schema(LISTING).parquet(path)


def inventory_of_files(spark: SparkSession, path: str, bucket: str) -> DataFrame:
    """A convenience over files: no zero-length files and no hidden names (Spark leaves them out)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = path.rstrip("/").rsplit("/", 1)[-1].replace("\\E", "\\E\\\\E\\Q")
    key = F.regexp_replace("path", rf"^.*?/\Q{name}\E/", "")
    return files.select(F.lit(bucket).alias("bucket"), key.alias("object_key"), F.lit("").alias("etag"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified"), F.lit("").alias("content_type"))


# ------------------------------------------------------------------ the data source


class _Range(InputPartition):
    """A range of keys of a scope, and the times (microseconds) between which its objects were modified."""

    def __init__(self, bucket: str, prefix: str, after: str, until: str | None, since: int | None = None, before: int | None = None):
        super().__init__(None)
        self.bucket, self.prefix, self.after, self.until, self.since, self.before = bucket, prefix, after, until, since, before


def _ranges(store: ObjectStore, scopes: list[tuple[str, str]], parts: int, since: int | None = None, before: int | None = None) -> list[_Range]:
    out = []
    for bucket, prefix in scopes:
        ends = store.cuts(bucket, prefix, parts - 1)
        out += [_Range(bucket, prefix, a, z, since, before) for a, z in zip(["", *ends], [*ends, None])]
    return out


def _micros(when: datetime) -> int:
    return (when - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _rows(store: ObjectStore, r: _Range) -> Iterator[tuple]:
    for o in store.list(r.bucket, r.prefix, r.after, r.until):
        if r.before is None or r.since < _micros(o.last_modified) <= r.before:
            yield r.bucket, o.key, o.etag, o.size, o.last_modified, o.content_type


class _Reader(DataSourceReader):
    def __init__(self, store: ObjectStore, scopes: list[tuple[str, str]], parts: int):
        self.store, self.scopes, self.parts = store, scopes, parts

    def partitions(self):
        return _ranges(self.store, self.scopes, self.parts)

    def read(self, partition):
        return _rows(self.store, partition) if partition is not None else iter(())


class _PushingReader(_Reader):
    def pushFilters(self, filters):
        """Equal buckets and the beginnings of keys choose and narrow the scopes; an equal key narrows them and is checked again."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("bucket",):
                self.scopes = [(b, p) for b, p in self.scopes if b == f.value]
            elif isinstance(f, (StringStartsWith, EqualTo)) and f.attribute == ("object_key",):
                self.scopes = [(b, max(p, f.value, key=len)) for b, p in self.scopes if p.startswith(f.value) or f.value.startswith(p)]
                if isinstance(f, EqualTo):
                    self.scopes = [(b, p) for b, p in self.scopes if p == f.value]
                    yield f
            else:
                yield f


class _StreamReader(DataSourceStreamReader):
    """Each object that is new or written again, once: an offset is a time, and a batch is what was modified since the one
    before.  The latest offset lags by `settle` seconds, so that no object that is listed later falls behind it."""

    def __init__(self, store: ObjectStore, scopes: list[tuple[str, str]], parts: int, settle: float):
        self.store, self.scopes, self.parts, self.settle = store, scopes, parts, settle

    def initialOffset(self):
        return {"until": -(1 << 62)}

    def latestOffset(self):
        return {"until": _micros(datetime.now(timezone.utc)) - int(self.settle * 1e6)}

    def partitions(self, start, end):
        return _ranges(self.store, self.scopes, self.parts, start["until"], end["until"])

    def read(self, partition):
        return _rows(self.store, partition)


class ListingSource(DataSource):
    """spark.read.format("lodestrata_listing").option("scopes", "bucket/prefix,...") and, for the store, .option("root", folder), or
    "endpoint", "access_key", "secret_key" and "region"; "parts" cuts each scope (default 8).  With
    "push" = "true", which needs spark.sql.python.filterPushdown.enabled, filters on the bucket and on the beginnings of keys
    reach the store.  Also a stream ("settle": seconds, default 2): deletions do not show in it."""

    @classmethod
    def name(cls):
        return "lodestrata_listing"

    def schema(self):
        return LISTING

    def _store(self) -> ObjectStore:
        o = self.options
        if o.get("root"):
            return FileStore(o["root"])
        return S3Store(o["endpoint"], o.get("access_key", ""), o.get("secret_key", ""), o.get("region", "us-east-1"))

    def _scopes(self) -> list[tuple[str, str]]:
        return [s.partition("/")[::2] for s in self.options["scopes"].split(",")]

    def reader(self, schema):
        kind = _PushingReader if self.options.get("push", "false") == "true" else _Reader
        return kind(self._store(), self._scopes(), int(self.options.get("parts", "8")))

    def streamReader(self, schema):
        return _StreamReader(self._store(), self._scopes(), int(self.options.get("parts", "8")), float(self.options.get("settle", "2")))
