"""Plans of side effects: which blobs to store, which objects to replace, what to delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.hashing import blob_key
from lodestrata.functions.pointers import render_pointer


def plan_uploads(hashed: DataFrame, stored: DataFrame) -> DataFrame:
    """One upload per (bucket, hash) that storage lacks, from its object with the smallest key.

    `hashed`: bucket, object_key, hash, size; `stored`: bucket, hash of the blobs in storage.
    """
    first = hashed.groupBy("bucket", "hash").agg(F.min(F.struct("object_key", "size")).alias("first"))
    return first.join(stored.select("bucket", "hash"), ["bucket", "hash"], "left_anti").select("bucket", "hash", "first.object_key", "first.size")


def plan_relinks(hashed: DataFrame, stored: DataFrame, blob_prefix: str) -> DataFrame:
    """Every object with the pointer that replaces it, what it saves and what it uploads.

    Each object is replaced, also where its content stands once; the first of a blob that storage
    lacks pays for the upload.  The hot side of the join is the objects, one row per blob the other.
    """
    uploads = plan_uploads(hashed, stored).select("bucket", "hash", F.col("object_key").alias("first_key"))
    pointer = render_pointer(F.col("bucket"), blob_key(blob_prefix, "hash"), F.col("hash"), F.col("size"), F.col("content_type"))
    uploaded = F.when(F.col("object_key") == F.col("first_key"), F.col("size")).otherwise(0)
    return (
        hashed.join(uploads, ["bucket", "hash"], "left")
        .select("bucket", "object_key", "hash", F.col("size").alias("listed_size"), pointer.alias("pointer"), uploaded.cast("long").alias("uploaded"))
        .withColumn("now_size", F.octet_length("pointer").cast("long")).withColumn("relinked", F.lit(True))
    )


def plan_collection(blobs: DataFrame, buckets: list[str]) -> DataFrame:
    """Blobs to delete: nothing names them, their bytes are stored, and their bucket is configured.

    A key that two blobs of a bucket share is an error and not a candidate; the rows carry it.
    """
    found = blobs.where((F.col("ref_count") == 0) & F.col("stored") & F.col("bucket").isin(sorted(set(buckets))))
    shared = found.groupBy("bucket", "blob_key").agg(F.count("*").alias("n"))
    return found.join(shared, ["bucket", "blob_key"]).withColumn("error", F.when(F.col("n") > 1, "duplicate blob key")).drop("n")
