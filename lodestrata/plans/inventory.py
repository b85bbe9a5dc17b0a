"""A scan of an inventory that carries content hashes: the catalog moves on, and no body is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.hashing import blob_key
from lodestrata.operators import catalog, filters
from lodestrata.plans.scan import write_changes
from lodestrata.schemas import BLOBS, KEY, RECORDS
from lodestrata.session import remove_folder, saved, shared_folder
from lodestrata.sources.state import Draft, Snapshot, StateStore


def draft_inventory(state: StateStore, listed: DataFrame, scopes: list[tuple[str, str]], scan_id: str, blob_prefix: str, min_size: int, algorithm: str = "sha256", before: Snapshot | None = None) -> Draft:
    """A draft of what an inventory (columns of a listing, and `hash`) of whole scopes changes; records that break a rule, or
    differ from the blob of their hash, are left out.  Two drafts of one version may be made before either is committed."""
    before, spark = before or state.load(), listed.sparkSession
    folder, draft = shared_folder(spark), state.draft(before)
    try:
        rows = filters.in_any_scope(listed.where(filters.outside_blob_prefix(blob_prefix)), scopes)
        rows = saved(before.lookup(rows).withColumn("small", filters.too_small(min_size, F.col("old.is_pointer"))), folder, "rows")
        fresh = rows.where("not small").dropDuplicates(KEY).where(~F.coalesce(filters.same_as("old") & (F.col("old.hash_algo") == algorithm), F.lit(False)))
        made = {"blob_bucket": F.col("bucket"), "blob_key": blob_key(blob_prefix, "hash"), "blob_size": F.col("size"), "last_seen_scan": F.lit(scan_id), "is_pointer": F.lit(False), "hash_algo": F.lit(algorithm)}
        placed = fresh.where("old is not null").select(*KEY, "old.blob_bucket", "old.blob_hash")
        labelled = catalog.label_records(fresh.withColumns(made).select(RECORDS.fieldNames()), placed, look=before.lookup_blobs).join(fresh.select(*KEY, "old"), KEY)
        write_changes(before, draft, rows, saved(labelled, folder, "labelled").where("error is null"), spark.createDataFrame([], BLOBS), scopes, folder)
    finally:
        remove_folder(spark, folder)
    return draft


def scan_inventory(state: StateStore, listed: DataFrame, scopes: list[tuple[str, str]], scan_id: str, blob_prefix: str = "blobs/", min_size: int = 0) -> Snapshot:
    """The catalog after an inventory of whole scopes."""
    draft = draft_inventory(state, listed, scopes, scan_id, blob_prefix, min_size)
    return state.commit(draft, {"blob_prefix": blob_prefix, "hash_algo": "sha256"}, scan_id, scopes)
