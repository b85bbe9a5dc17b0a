"""Changes of a catalog: newest-wins merges, signed reference counts, and statistics that move with them.

An epoch is the rows that it writes or deletes, so its cost follows what has changed.  Reference counts
are sums of +1 and -1 over the objects' changes.  The statistics are sums over blobs of a function of the
count that is not linear (duplicates are max(n - 1, 0)), so they are moved by the difference that each
touched blob makes, which takes the counts of these blobs alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.schemas import BLOBS, KEY, OBJECTS, struct

#: A change of an object: its row, or the deletion of its key, by the version that made it.
OBJECT_CHANGES = struct(", ".join(f"{f.name} {f.dataType.simpleString()}" for f in OBJECTS.fields) + ", seq bigint, deleted boolean")
#: A change of a blob: what it is from now on, the references that it gains, and whether it is gone.
BLOB_CHANGES = struct("bucket string, hash string, blob_key string, size bigint, stored boolean, change bigint, removed boolean, seq bigint")
BLOB = ["bucket", "hash"]
TOTALS = ("unique_blobs", "duplicates_found", "bytes_reclaimable")


def newest(changes: DataFrame, key: list[str]) -> DataFrame:
    """Of each key the change with the greatest seq."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(key).agg(F.max_by(F.struct(rest), "seq").alias("c")).select(*key, "c.*")


def merge_objects(base: DataFrame, latest: DataFrame) -> DataFrame:
    """The base under the latest changes.  Both parts keep their keys, so filters and anti joins go into them."""
    return base.join(latest.select(KEY), KEY, "left_anti").unionByName(latest.where("not deleted").select(base.columns))


def fold_blobs(changes: DataFrame) -> DataFrame:
    """bucket, hash, change (the sum) and last (what the blob is by its last change)."""
    last = F.max_by(F.struct("blob_key", "size", "stored", "removed"), F.struct("seq", "removed", "stored"))
    return changes.groupBy(BLOB).agg(F.sum("change").alias("change"), last.alias("last"))


def merge_blobs(base: DataFrame, folded: DataFrame) -> DataFrame:
    """The base under folded changes.  A blob that was removed had no reference left, so its sum stands if it comes back."""
    both = base.join(folded, BLOB, "full").where(~F.coalesce("last.removed", F.lit(False)))
    now = lambda c: F.when(F.col("last").isNotNull(), F.col(f"last.{c}")).otherwise(F.col(c)).alias(c)
    count = F.coalesce("ref_count", F.lit(0)) + F.coalesce("change", F.lit(0))
    return both.select("bucket", now("blob_key"), "hash", now("size"), count.cast("long").alias("ref_count"), now("stored")).select(BLOBS.fieldNames())


def object_changes(accepted: DataFrame, dropped: DataFrame, seq: int) -> DataFrame:
    """Rows to write (records with `old`) and keys to delete (with `old`), as changes with `old`, the blob named before."""
    fields = [c for c in OBJECTS.fieldNames() if c not in (*KEY, "blob_hash")]
    old = F.struct(F.col("old.blob_bucket").alias("bucket"), F.col("old.blob_hash").alias("hash")).alias("old")
    written = accepted.select(*KEY, *fields, F.col("hash").alias("blob_hash"), F.lit(seq).cast("long").alias("seq"), F.lit(False).alias("deleted"), old)
    none = [F.lit(None).cast(OBJECTS[c].dataType).alias(c) for c in (*fields, "blob_hash")]
    return written.unionByName(dropped.select(*KEY, *none, F.lit(seq).cast("long").alias("seq"), F.lit(True).alias("deleted"), old))


def reference_changes(changes: DataFrame) -> DataFrame:
    """(bucket, hash, change): a signed multiset, -1 for each blob named before and +1 for each named now."""
    before, now = F.struct("old.bucket", "old.hash", F.lit(-1).alias("d")), F.struct(F.col("blob_bucket").alias("bucket"), F.col("blob_hash").alias("hash"), F.lit(1).alias("d"))
    each = changes.select(F.explode(F.array(before, now)).alias("r")).select("r.*").where("hash is not null")
    return each.groupBy(BLOB).agg(F.sum("d").cast("long").alias("change"))


def blob_changes(references: DataFrame, accepted: DataFrame, stored: DataFrame, look, seq: int) -> DataFrame:
    """Changes of the touched blobs, with n_before.  `look` adds `blob`, what the catalog has of a (bucket, hash) or null.

    `accepted` tells the key and size of a new blob (its record with the smallest key does), `stored` the blobs whose
    bytes are in storage from now on.  Blobs for which nothing changes are left out.
    """
    made = accepted.groupBy(F.col("blob_bucket").alias("bucket"), "hash").agg(F.min(F.struct("object_key", "blob_key", "blob_size")).alias("made"))
    put = stored.select(*BLOB).distinct().withColumn("put", F.lit(True))
    touched = look(references.join(made, BLOB, "full").join(put, BLOB, "full"))
    held = F.coalesce("blob.stored", F.lit(False))
    now, change = held | F.coalesce("put", F.lit(False)), F.coalesce("change", F.lit(0))
    known, named = F.col("blob").isNotNull(), F.col("made").isNotNull()
    rows = touched.where((known & ((change != 0) | (now != held))) | (~known & named))
    return rows.select(
        *BLOB, F.coalesce("blob.blob_key", "made.blob_key").alias("blob_key"), F.coalesce("blob.size", "made.blob_size").alias("size"), now.alias("stored"), change.cast("long").alias("change"),
        F.lit(False).alias("removed"), F.lit(seq).cast("long").alias("seq"), F.coalesce("blob.ref_count", F.lit(0)).cast("long").alias("n_before"),
    )


def total_changes(touched: DataFrame) -> DataFrame:
    """By bucket, how TOTALS move: a row for each bucket that a touched blob (size, n_before, change) lies in."""
    before, after = F.col("n_before"), F.col("n_before") + F.col("change")
    more = F.greatest(after - 1, F.lit(0)) - F.greatest(before - 1, F.lit(0))
    moves = ((after > 0).cast("long") - (before > 0).cast("long"), more, more * F.col("size"))
    return touched.groupBy("bucket").agg(*[F.sum(m).cast("long").alias(name) for name, m in zip(TOTALS, moves)])
