"""Catalog transitions as joins over whole snapshots.

Reference counts are counted anew from the objects here, so a snapshot cannot drift from the rows it was
made of.  Scans write changes instead (`operators/changes.py`); these transitions are what they must equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.operators.filters import record_error
from lodestrata.schemas import BLOBS, KEY, OBJECTS


def label_records(records: DataFrame, objects: DataFrame, blobs: DataFrame | None = None, look: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records with `case` (insert, same, move) and `error` (null: may be registered).

    The blobs are a table, or `look`, which adds `blob` (the catalog's blob_key and size, or null) to rows of (bucket, hash).

    For one (blob bucket, hash) the key and size of an existing blob hold; without one, those of the
    record with the smallest key do.  Records of the `same` case change no blob and are not held
    against it.
    """
    old = objects.select(*KEY, F.col("blob_bucket").alias("__bucket"), F.col("blob_hash").alias("__hash"))
    known = records.join(old, KEY, "left")
    case = F.when(F.col("__hash").isNull(), "insert").when((F.col("__bucket") == F.col("blob_bucket")) & (F.col("__hash") == F.col("hash")), "same").otherwise("move")
    known = known.withColumns({"case": case, "error": record_error()}).drop("__bucket", "__hash")
    # one small row per blob: min() of a struct combines on the map side, however many copies there are
    first = (
        known.where("error is null and case <> 'same'").groupBy("blob_bucket", "hash")
        .agg(F.min(F.struct("object_key", "bucket", "blob_key", "blob_size")).alias("first"))
    )
    first = first.withColumnRenamed("blob_bucket", "bucket")
    found = look(first) if look else first.join(blobs.select("bucket", "hash", F.struct("blob_key", "size").alias("blob")), ["bucket", "hash"], "left")
    holds = found.select(F.col("bucket").alias("blob_bucket"), "hash", F.coalesce("blob.blob_key", "first.blob_key").alias("__key"), F.coalesce("blob.size", "first.blob_size").alias("__size"))
    conflict = F.when(F.col("case") == "same", None).when(F.col("blob_size") != F.col("__size"), "blob size mismatch").when(F.col("blob_key") != F.col("__key"), "blob key mismatch")
    return known.join(holds, ["blob_bucket", "hash"], "left").withColumn("error", F.coalesce("error", conflict)).drop("__key", "__size")


def register(objects: DataFrame, records: DataFrame) -> DataFrame:
    """The objects with every record written over the row of its key."""
    new = records.select(*KEY, F.struct("etag", "size", "last_modified", "blob_bucket", F.col("hash").alias("blob_hash"), "last_seen_scan", "is_pointer", "hash_algo").alias("new"))
    both = objects.join(new, KEY, "full")
    rest = [c for c in OBJECTS.fieldNames() if c not in KEY]
    return both.select(*KEY, *[F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) for c in rest])


def unregister(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """Without the rows of the keys; keys that are not there change nothing."""
    return objects.join(keys.select(KEY), KEY, "left_anti")


def mark_seen(objects: DataFrame, listed: DataFrame, scan_id: str) -> DataFrame:
    seen = listed.select(*KEY, F.lit(True).alias("__seen")).distinct()
    return objects.join(seen, KEY, "left").withColumn("last_seen_scan", F.when(F.col("__seen"), scan_id).otherwise(F.col("last_seen_scan"))).select(OBJECTS.fieldNames())


def count_references(objects: DataFrame) -> DataFrame:
    """(bucket, hash, ref_count) of every blob that an object names."""
    return objects.groupBy(F.col("blob_bucket").alias("bucket"), F.col("blob_hash").alias("hash")).agg(F.count("*").alias("ref_count"))


def refresh_blobs(blobs: DataFrame, objects: DataFrame, records: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """All known blobs with counts anew; blobs that nothing names stay with count 0.

    `stored` names blobs (bucket, hash) whose bytes this scan has put or found in storage.
    """
    on = ["bucket", "hash"]
    made = records.groupBy(F.col("blob_bucket").alias("bucket"), "hash").agg(F.min(F.struct("object_key", "blob_key", "blob_size")).alias("made"))
    refs = count_references(objects)
    out = blobs.drop("ref_count").join(made, on, "full").join(refs, on, "left")
    held = F.coalesce("stored", F.lit(False))
    if stored is not None:
        out = out.join(stored.select(*on, F.lit(True).alias("__put")).distinct(), on, "left")
        held = held | F.coalesce("__put", F.lit(False))
    return out.select("bucket", F.coalesce("blob_key", "made.blob_key").alias("blob_key"), "hash", F.coalesce("size", "made.blob_size").alias("size"), F.coalesce("ref_count", F.lit(0)).cast("long").alias("ref_count"), held.alias("stored")).select(BLOBS.fieldNames())


def unreferenced(blobs: DataFrame, bucket: str | None = None) -> DataFrame:
    found = blobs.where("ref_count = 0")
    return found if bucket is None else found.where(F.col("bucket") == bucket)


def delete_blobs(blobs: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Without the blobs (bucket, hash) whose removal is confirmed and that nothing names."""
    gone = confirmed.select("bucket", "hash").join(unreferenced(blobs).select("bucket", "hash"), ["bucket", "hash"], "left_semi")
    return blobs.join(gone, ["bucket", "hash"], "left_anti")


def broken_invariants(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows (rule, bucket, name) that break a catalog invariant: none in a sound snapshot."""
    refs = count_references(objects).withColumnRenamed("ref_count", "n")
    counted = blobs.join(refs, ["bucket", "hash"], "full")
    wrong = counted.where(F.coalesce("ref_count", F.lit(-1)) != F.coalesce("n", F.lit(0))).select(F.lit("ref_count").alias("rule"), "bucket", F.col("hash").alias("name"))
    twice = objects.groupBy(KEY).count().where("count > 1").select(F.lit("object key").alias("rule"), "bucket", F.col("object_key").alias("name"))
    double = blobs.groupBy("bucket", "hash").count().where("count > 1").select(F.lit("blob key").alias("rule"), "bucket", F.col("hash").alias("name"))
    return wrong.unionByName(twice).unionByName(double)
