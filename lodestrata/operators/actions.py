"""The stages that touch object bodies.  Each takes planned rows and returns outcome rows.

Errors are rows, not exceptions.  All writes may be repeated by a retried task: blobs are named by
their content, a pointer is put only over an object that still looks as it did, and a delete of a
missing key succeeds.
"""

from __future__ import annotations

import io
import itertools
import math
from collections.abc import Callable, Iterator
from types import SimpleNamespace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrata.functions.hashing import hash_stream
from lodestrata.functions.pointers import dump_pointer, load_pointer
from lodestrata.schemas import POINTER_TYPE, struct
from lodestrata.sources.objectstore import NoSuchKey, ObjectInfo, ObjectStore
from lodestrata.sources.rows import in_flight, map_rows

INSPECTED = struct(
    "bucket string, object_key string, etag string, size bigint, last_modified timestamp, kind string, blob_bucket string, hash string, blob_size bigint, "
    "seen_etag string, seen_size bigint, seen_modified timestamp, content_type string, error string"
)
STORED = struct("bucket string, hash string, stored_size bigint, uploaded bigint, first_key string, error string")
FINISHED = struct("bucket string, object_key string, hash string, listed_size bigint, etag string, now_size bigint, last_modified timestamp, uploaded bigint, relinked boolean, changed boolean, error string")
DELETED = struct("bucket string, blob_key string, hash string, size bigint, deleted boolean, error string")

#: A pointer document is shorter than this, whatever its keys need of escapes.
POINTER_BYTES = 32 << 10
#: Bytes of bodies and number of objects of a task, about.
TASK_BYTES, TASK_OBJECTS = 1 << 30, 2000
#: Keys of one delete call.
DELETED_AT_ONCE = 1000


def worker_count(asked: int | None, cores: int) -> int:
    """Calls at a time: all cores if nothing is asked for, else between one and two for each core."""
    return cores if asked is None else min(max(1, asked), 2 * cores)


def tasks_for(size: int, objects: int, workers: int, cores: int) -> int:
    """Tasks for bodies of `size` bytes: no more than `workers` where these are fewer than the cores,
    else so many that none has much more than its share."""
    if workers < cores:
        return workers
    return max(1, min(objects, max(workers, math.ceil(size / TASK_BYTES), math.ceil(objects / TASK_OBJECTS))))


def deal(work: DataFrame, size: str, workers: int) -> tuple[DataFrame, int]:
    """The rows dealt round robin to as many tasks as their bytes and number ask for, and the calls that
    a task has in flight.  The partitions that metadata joins leave say nothing about bodies."""
    cores = work.sparkSession.sparkContext.defaultParallelism
    total = work.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.count("*").alias("n")).first()
    n = tasks_for(total["bytes"], total["n"], workers, cores)
    return work.repartition(n), max(1, math.ceil(workers / cores))


def _mapped(df: DataFrame, schema: T.StructType, one: Callable[[SimpleNamespace], dict], threads: int = 1) -> DataFrame:
    return map_rows(df, schema, lambda rows: in_flight(lambda r: one(SimpleNamespace(**r)), rows, threads))


def inspect(work: DataFrame, store: ObjectStore, algorithm: str, blob_prefix: str, threads: int = 1) -> DataFrame:
    """Stats, reads and hashes each object; resolves pointer documents."""

    def one(r):
        row = {"bucket": r.bucket, "object_key": r.object_key, "etag": r.etag, "size": r.size, "last_modified": r.last_modified, "kind": "object"}
        try:
            seen = store.stat(r.bucket, r.object_key)
            row |= {"seen_etag": seen.etag, "seen_size": seen.size, "seen_modified": seen.last_modified, "content_type": seen.content_type}
            if seen.content_type == POINTER_TYPE and seen.size > POINTER_BYTES:
                raise ValueError(f"pointer document of {seen.size} bytes")
            with store.get(r.bucket, r.object_key) as body:
                if seen.content_type == POINTER_TYPE:
                    row["kind"] = "pointer"
                    p = load_pointer(body.read(POINTER_BYTES + 1))
                    if p["blob_key"] != blob_prefix + p["hash"]:
                        raise ValueError("pointer key does not match its hash")
                    blob = store.stat(p["blob_bucket"], p["blob_key"])
                    if (blob.key, blob.size) != (p["blob_key"], p["size"]):
                        raise ValueError("pointer and blob differ")
                    row |= {"blob_bucket": p["blob_bucket"], "hash": p["hash"], "blob_size": p["size"]}
                else:
                    row |= {"blob_bucket": r.bucket, "hash": hash_stream(body, algorithm)[0], "blob_size": r.size}
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
        return row

    return _mapped(work.select("bucket", "object_key", "etag", "size", "last_modified"), INSPECTED, one, threads)


def store_blobs(first: DataFrame, store: ObjectStore, algorithm: str, blob_prefix: str, threads: int = 1) -> DataFrame:
    """One row per (bucket, hash), from `object_key`: finds the blob, or has the store copy the object, which must still have
    the etag that it had before its body was hashed."""

    def one(r):
        row = {"bucket": r.bucket, "hash": r.hash, "uploaded": 0, "first_key": r.object_key}
        key = blob_prefix + r.hash
        try:
            try:
                row["stored_size"] = store.stat(r.bucket, key).size
                return row
            except NoSuchKey:
                pass
            store.copy(r.bucket, r.object_key, key, r.seen_etag, r.size, r.content_type or "")
            size = store.stat(r.bucket, key).size
            if size != r.size:
                raise ValueError("blob was not stored whole")
            row |= {"stored_size": size, "uploaded": size}
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
        return row

    return _mapped(first.select("bucket", "hash", "object_key", "content_type", "size", "seen_etag"), STORED, one, threads)


def finish_objects(hashed: DataFrame, store: ObjectStore, blob_prefix: str, replace: bool, threads: int = 1) -> DataFrame:
    """Replaces each object by its pointer if it may, after a last look at it.

    `hashed` has the columns of `inspect` with stored_size, uploaded, first_key and blob_error.  A
    changed object is neither replaced nor an error.
    """

    def one(r):
        row = {"bucket": r.bucket, "object_key": r.object_key, "hash": r.hash, "listed_size": r.size, "uploaded": r.uploaded if r.object_key == r.first_key else 0, "relinked": False, "changed": False}
        try:
            if r.blob_error is not None:
                raise ValueError(f"blob: {r.blob_error}")
            if r.stored_size != r.size:
                raise ValueError("blob size mismatch")
            now = store.stat(r.bucket, r.object_key)
            if (now.etag, now.size, now.last_modified) != (r.seen_etag, r.seen_size, r.seen_modified):
                row["changed"] = True
            elif replace:
                now = _replace(store, r, blob_prefix + r.hash)
                row["relinked"] = True
            row |= {"etag": now.etag, "now_size": now.size, "last_modified": now.last_modified}
        except Exception as e:
            row["error"] = f"{type(e).__name__}: {e}"
        return row

    return _mapped(hashed, FINISHED, one, threads)


def _replace(store: ObjectStore, r, blob_key: str) -> ObjectInfo:
    body = dump_pointer({"blob_bucket": r.bucket, "blob_key": blob_key, "hash": r.hash, "size": r.size, "content_type": r.content_type or ""}).encode()
    if store.put(r.bucket, r.object_key, io.BytesIO(body), len(body), POINTER_TYPE) != len(body):
        raise ValueError("pointer was not stored whole")
    now = store.stat(r.bucket, r.object_key)
    if (now.size, now.content_type) != (len(body), POINTER_TYPE):
        raise ValueError("stored pointer differs")
    return now


def delete_stored(candidates: DataFrame, store: ObjectStore, workers: int) -> DataFrame:
    """Deletes in batches per bucket, a task for each; a row says whether its blob is gone."""
    rows = candidates.select("bucket", "blob_key", "hash", "size")
    calls = max(1, math.ceil(rows.count() / DELETED_AT_ONCE))
    tasks = min(calls, workers) if workers < rows.sparkSession.sparkContext.defaultParallelism else calls

    def run(rows: Iterator[dict]):
        while part := list(itertools.islice(rows, DELETED_AT_ONCE)):
            for bucket in sorted({r["bucket"] for r in part}):
                own = [r for r in part if r["bucket"] == bucket]
                try:
                    gone = set(store.remove(bucket, [r["blob_key"] for r in own]))
                    yield from (r | {"deleted": r["blob_key"] in gone, "error": None if r["blob_key"] in gone else "not deleted"} for r in own)
                except Exception as e:
                    yield from (r | {"deleted": False, "error": f"{type(e).__name__}: {e}"} for r in own)

    return map_rows(rows.repartition(tasks), DELETED, run)
