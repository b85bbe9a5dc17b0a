"""Aggregations over the catalog and over a scan's outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def blob_groups(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob_bucket, blob_hash, size, n): live blobs with their logical size and number of objects.

    Objects are counted before the join, so the join moves one row per blob, not per object.
    """
    refs = objects.groupBy("blob_bucket", "blob_hash").agg(F.count("*").alias("n"))
    return refs.join(blobs.select(F.col("bucket").alias("blob_bucket"), F.col("hash").alias("blob_hash"), "size"), ["blob_bucket", "blob_hash"]).select("blob_bucket", "blob_hash", "size", "n")


def summarize(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """unique_blobs, duplicates_found, bytes_reclaimable; one row, zeros for an empty catalog."""
    extra = F.col("n") - 1
    return groups.groupBy(*(by or [])).agg(
        F.count("*").alias("unique_blobs"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, extra)), F.lit(0)).cast("long").alias("duplicates_found"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, extra * F.col("size"))), F.lit(0)).cast("long").alias("bytes_reclaimable"),
    )


def stats(objects: DataFrame, blobs: DataFrame) -> DataFrame:
    return summarize(blob_groups(objects, blobs))


def stale_by_blob(gone: DataFrame) -> DataFrame:
    return gone.groupBy("blob_bucket", "blob_hash").agg(F.count("*").alias("n"))


def reclaimed(outcomes: DataFrame) -> DataFrame:
    """objects_relinked, bytes_reclaimed (gains only) and net_bytes_reclaimed (losses taken off).

    An outcome has relinked, listed_size, now_size (what stands under the key after the scan) and
    uploaded (blob bytes that it put).
    """
    gain = F.col("listed_size") - F.col("now_size") - F.col("uploaded")
    return outcomes.agg(
        F.coalesce(F.sum(F.col("relinked").cast("long")), F.lit(0)).alias("objects_relinked"),
        F.coalesce(F.sum(F.greatest(gain, F.lit(0))), F.lit(0)).cast("long").alias("bytes_reclaimed"),
        F.coalesce(F.sum(gain), F.lit(0)).cast("long").alias("net_bytes_reclaimed"),
    )


def gc_totals(deleted: DataFrame) -> DataFrame:
    return deleted.agg(F.count("*").alias("blobs_removed"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("gc_bytes"))
