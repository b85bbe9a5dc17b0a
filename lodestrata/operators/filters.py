"""Predicates over listings and records, in the order in which a scan applies them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.schemas import KEY, POINTER_TYPE, UNCHANGED_ON


#: Scopes that are conditions on the scan, and scopes that are broadcast, at most.
PUSHED_SCOPES, BROADCAST_SCOPES = 50, 100_000


def filter_scopes(listing: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
    """Rows of each (bucket, prefix) scope, once per scope that holds them; adds the scope's columns.

    A join, whatever the number of scopes: a key gives its beginnings of the lengths that prefixes have, and meets the
    scopes on (bucket, prefix).  The scopes are broadcast if they are no more than BROADCAST_SCOPES; few of them are a
    condition on the scan besides.
    """
    if not scopes:
        raise ValueError("no scope")
    spark, each = listing.sparkSession, sorted(set(scopes))
    lengths = sorted({len(p) for _, p in each})
    table = spark.createDataFrame(each, "scope_bucket string, scope_prefix string")
    table = F.broadcast(table) if len(each) <= BROADCAST_SCOPES else table
    rows = listing.where(in_scopes(each)) if len(each) <= PUSHED_SCOPES else listing
    fits = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length("object_key"))
    begun = rows.withColumn("scope_prefix", F.explode(F.transform(fits, lambda n: F.substring(F.col("object_key"), F.lit(1), n)))).withColumn("scope_bucket", F.col("bucket"))
    held = begun.join(table, ["scope_bucket", "scope_prefix"]).select(*listing.columns, "scope_bucket", "scope_prefix")
    times = {s: scopes.count(s) for s in each} if len(each) < len(scopes) else {}
    again = [s for s, n in times.items() for _ in range(n - 1)]
    return held.unionByName(filter_scopes(listing, again)) if again else held


def in_any_scope(rows: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
    """The rows that one scope at least holds: a condition for few scopes, else a semi join on their beginnings."""
    if len(scopes) <= PUSHED_SCOPES:
        return rows.where(in_scopes(scopes))
    # a scope within another one adds nothing, so each row is in one of these at most
    outer: list[tuple[str, str]] = []
    for b, p in sorted(set(scopes)):
        if not (outer and outer[-1][0] == b and p.startswith(outer[-1][1])):
            outer.append((b, p))
    return filter_scopes(rows, outer).select(rows.columns)


def in_scopes(scopes: list[tuple[str, str]], bucket: str = "bucket", key: str = "object_key") -> Column:
    return reduce(or_, [(F.col(bucket) == name) & F.col(key).startswith(prefix) for name, prefix in scopes], F.lit(False))


def outside_blob_prefix(prefix: str, key: str = "object_key") -> Column:
    """Not a stored blob.  An empty prefix would hold every key and is refused."""
    if not prefix:
        raise ValueError("blob_prefix must not be empty")
    return ~F.col(key).startswith(prefix)


def too_small(min_size: int, known_pointer: Column | None = None) -> Column:
    """Smaller than the threshold and no pointer, by listed type or by the catalog's word."""
    pointer = F.coalesce(F.col("content_type"), F.lit("")) == POINTER_TYPE
    if known_pointer is not None:
        pointer = pointer | F.coalesce(known_pointer, F.lit(False))
    return (F.col("size") < min_size) & ~pointer


def unchanged(listing: DataFrame, objects: DataFrame) -> DataFrame:
    """Listed rows that the catalog has with equal etag, size and time: bodies need no reading."""
    return listing.join(objects.select(UNCHANGED_ON), UNCHANGED_ON, "left_semi")


def to_process(listing: DataFrame, objects: DataFrame) -> DataFrame:
    return listing.join(objects.select(UNCHANGED_ON), UNCHANGED_ON, "left_anti")


def same_as(known: str) -> Column:
    """Whether a listed row has etag, size and time of a struct; null without one."""
    return (F.col("etag") == F.col(f"{known}.etag")) & (F.col("size") == F.col(f"{known}.size")) & (F.col("last_modified") == F.col(f"{known}.last_modified"))


def is_changed(before: str, after: str) -> Column:
    """Whether two looks at an object, structs of etag, size and last_modified, differ."""
    same = F.lit(True)
    for name in ("etag", "size", "last_modified"):
        same = same & F.col(f"{before}.{name}").eqNullSafe(F.col(f"{after}.{name}"))
    return ~same


def record_error() -> Column:
    """The first rule that a catalog record breaks, or null."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    return (
        F.when(blank("blob_bucket"), "blob bucket is empty")
        .when(blank("blob_key"), "blob key is empty")
        .when(F.col("blob_size") < 0, "blob size is negative")
        .when(blank("bucket"), "bucket is empty")
        .when(blank("object_key"), "key is empty")
        .when(blank("hash"), "hash is empty")
        .when(F.col("size") < 0, "size is negative")
    )


def pointer_key_matches(blob_prefix: str) -> Column:
    return F.col("blob_key") == F.concat(F.lit(blob_prefix), F.col("hash"))


def resolve_pointers(pointers: DataFrame, inventory: DataFrame, blob_prefix: str) -> DataFrame:
    """Each pointer (columns of a pointer document beside its own) with `error`: what keeps it from
    naming a stored blob, or null.  The blob may lie in another bucket."""
    blobs = inventory.select(F.col("bucket").alias("blob_bucket"), F.col("object_key").alias("blob_key"), F.col("size").alias("stored_size"))
    error = (
        F.when(~pointer_key_matches(blob_prefix), "pointer key does not match its hash")
        .when(F.col("stored_size").isNull(), "blob does not exist")
        .when(F.col("stored_size") != F.col("size"), "pointer and blob differ")
    )
    return pointers.join(blobs, ["blob_bucket", "blob_key"], "left").withColumn("error", error).drop("stored_size")


def stale(objects: DataFrame, scopes: list[tuple[str, str]], scan_id: str) -> DataFrame:
    """Rows of the scopes that this scan has not seen."""
    return objects.where(in_scopes(scopes) & (F.col("last_seen_scan") != scan_id))


def missing_from(objects: DataFrame, listing: DataFrame, scopes: list[tuple[str, str]]) -> DataFrame:
    """The same rows set-wise: in scope and not listed."""
    return objects.where(in_scopes(scopes)).join(listing.select(KEY), KEY, "left_anti")
