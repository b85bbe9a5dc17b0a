"""One scan: list, filter, hash what is new, move the catalog on, store, relink, collect, report.

The planner is one join of the listing with the catalog, and joins of what has changed; bodies are read only
for listed rows that the catalog does not know as they are, and a scan writes changes only.  Outcomes of
side effects are tables in the shared folder, so a lost executor repeats rows of one stage and never a
stage that is done.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import Config
from lodestrata.functions.hashing import blob_key
from lodestrata.operators import actions, catalog, changes, filters, relink, stats
from lodestrata.schemas import KEY, RECORDS
from lodestrata.session import remove_folder, saved, shared_folder, tagged
from lodestrata.sources.listing import list_scopes
from lodestrata.sources.objectstore import ObjectStore
from lodestrata.sources.reports import empty_report
from lodestrata.sources.state import CatalogStore, Conflict, Draft, Snapshot

log = logging.getLogger("lodestrata")


class ScanError(Exception):
    """A scan-level failure; `report` holds what is known."""

    def __init__(self, message: str, report: dict):
        super().__init__(message)
        self.report = report


def _records_of(outcomes: DataFrame, config: Config, scan_id: str, size: str, etag: str, modified: str) -> DataFrame:
    prefix = config.dedup.blob_prefix
    return outcomes.select(
        *KEY, F.col(etag).alias("etag"), F.col(size).alias("size"), F.col(modified).alias("last_modified"), "blob_bucket", blob_key(prefix, "hash").alias("blob_key"),
        "blob_size", "hash", F.lit(scan_id).alias("last_seen_scan"), "is_pointer", F.lit(config.dedup.hash_algo).alias("hash_algo"),
    )


def scan_once(spark: SparkSession, store: ObjectStore, state: CatalogStore, config: Config) -> dict:
    """The report of one scan.  Raises ScanError after a scan-level failure."""
    d, started = config.dedup, datetime.now(timezone.utc)
    scan_id, report = str(time.time_ns()), empty_report(d.mode, started)
    folder = shared_folder(spark)
    try:
        with tagged(spark):
            return _scan(spark, store, state, config, scan_id, report, folder)
    finally:
        report["scan_finished"] = datetime.now(timezone.utc)
        remove_folder(spark, folder)


def _scan(spark: SparkSession, store: ObjectStore, state: CatalogStore, config: Config, scan_id: str, report: dict, folder: str) -> dict:
    d, before = config.dedup, state.load()
    if before.meta.get("blob_prefix", d.blob_prefix) != d.blob_prefix:
        report["errors"] += 1
        raise ScanError(f"blob_prefix {d.blob_prefix!r} differs from the catalog's {before.meta['blob_prefix']!r}", report)
    workers = actions.worker_count(config.schedule.workers, spark.sparkContext.defaultParallelism)

    # a sweep that is open was left by a driver that is lost, or is still at it: what it removes is deleted, and not made anew in this scan
    sweeping, closed, healed = None, set(), 0
    if d.mode == "pointer" and before.at.sweeps:
        sweeping, closed = saved(before.sweeping(), folder, "sweeping"), set(before.at.sweeps)
        healed, troubles = _delete(sweeping, store, workers, folder, "healed")
        report["errors"] += troubles
        closed = set() if troubles else closed

    listed = list_scopes(spark, store, config.scopes, folder=f"{folder}/listed", without=d.blob_prefix)
    failed = listed.where("error is not null").orderBy("scope").select("scope", "error").first()
    last = len(config.scopes) if failed is None else failed["scope"]
    complete = config.scopes[:last]
    rows = listed.where((F.col("error").isNull()) & (F.col("scope") <= last)).where(filters.outside_blob_prefix(d.blob_prefix)).drop("error")
    # the one join of the listing with the catalog: the listing moves, the catalog does not
    rows = saved(before.lookup(rows).withColumn("small", filters.too_small(d.min_size_bytes, F.col("old.is_pointer"))), folder, "rows")
    report["objects_scanned"] = rows.where("not small").count()
    eligible = rows.where("not small").dropDuplicates(KEY)
    # a change of algorithm makes an object be read again; a pointer carries its own hash
    current = (F.col("old.hash_algo") == d.hash_algo) | F.col("old.is_pointer")
    known = saved(eligible if d.force else eligible.where(~F.coalesce(filters.same_as("old") & current, F.lit(False))), folder, "work")

    work, threads = actions.deal(known, "size", workers)
    outcomes = saved(actions.inspect(work, store, d.hash_algo, d.blob_prefix, threads), folder, "inspected")
    errors = outcomes.where("error is not null").select(*KEY, "error")
    fine = outcomes.where("error is null").withColumn("is_pointer", F.col("kind") == "pointer")
    if sweeping is not None:
        gone = sweeping.select(F.col("bucket").alias("blob_bucket"), "hash")
        fine = fine.where("is_pointer").unionByName(fine.where("not is_pointer").join(gone, ["blob_bucket", "hash"], "left_anti"))
    if before.at.marks:
        named = before.marks.select("bucket", "hash").join(fine.select(F.col("blob_bucket").alias("bucket"), "hash"), ["bucket", "hash"], "left_semi")
        named = saved(before.lookup_blobs(named).where("blob is not null").drop("blob"), folder, "named")
        if not named.isEmpty():
            _committed(lambda: state.rescue(named), report)
    pointers = _records_of(fine.where("is_pointer"), config, scan_id, "size", "etag", "last_modified")
    plain = fine.where("not is_pointer")
    stored = fine.where("is_pointer").select(F.col("blob_bucket").alias("bucket"), "hash")
    if d.mode == "pointer":
        first = plain.groupBy("bucket", "hash").agg(F.min(F.struct("object_key", "content_type", "size", "seen_etag")).alias("f")).select("bucket", "hash", "f.*")
        first, threads = actions.deal(saved(first, folder, "first"), "size", workers)
        blobs = saved(actions.store_blobs(first, store, d.hash_algo, d.blob_prefix, threads), folder, "stored")
        # dealt anew: after the join all objects of a hot blob stand in a few partitions, and each costs calls, but no body
        joined = saved(plain.join(blobs.withColumnRenamed("error", "blob_error"), ["bucket", "hash"]).withColumn("moved", F.lit(0)), folder, "joined")
        joined, threads = actions.deal(joined, "moved", workers)
        finished = saved(actions.finish_objects(joined.drop("moved"), store, d.blob_prefix, d.delete_originals, threads), folder, "finished")
        errors = errors.unionByName(finished.where("error is not null").select(*KEY, "error"))
        done = finished.where("error is null and not changed")
        records = _records_of(
            done.select(*KEY, "etag", "now_size", "last_modified", F.col("bucket").alias("blob_bucket"), "hash", F.col("listed_size").alias("blob_size"), F.col("relinked").alias("is_pointer")),
            config, scan_id, "now_size", "etag", "last_modified",
        )
        stored = stored.unionByName(blobs.where("error is null").select("bucket", "hash"))
        if d.delete_originals:
            totals = stats.reclaimed(finished.where("error is null")).first()
            report["objects_relinked"], report["bytes_reclaimed"] = totals["objects_relinked"], totals["bytes_reclaimed"]
    else:
        records = _records_of(plain, config, scan_id, "size", "etag", "last_modified")

    olds = known.select(*KEY, "old")
    placed = olds.where("old is not null").select(*KEY, "old.blob_bucket", "old.blob_hash")
    labelled = catalog.label_records(records.unionByName(pointers).select(RECORDS.fieldNames()), placed, look=before.lookup_blobs)
    labelled = saved(labelled.join(olds, KEY), folder, "labelled")
    errors = errors.unionByName(labelled.where("error is not null").select(*KEY, "error"))
    report["errors"] += errors.count()
    for r in errors.limit(100).collect():
        log.warning("%s/%s: %s", r["bucket"], r["object_key"], r["error"])

    draft = state.draft(before)
    draft.closed = closed
    write_changes(before, draft, rows, labelled.where("error is null"), stored, complete, folder)
    meta = {"blob_prefix": d.blob_prefix, "hash_algo": d.hash_algo}
    if failed is not None:
        _commit(state, draft, meta, scan_id, complete, report)
        report["errors"] += 1
        raise ScanError(f"listing failed: {failed['error']}", report)

    gc_bytes = healed
    if d.mode == "pointer" and report["errors"] == 0:
        planned = saved(relink.plan_collection(draft.snapshot().blobs, [b for b, _ in config.scopes]), folder, "planned")
        free = planned.where("error is null")
        report["errors"] += planned.where("error is not null").count()
        if d.collect_after:
            draft.mark(free, d.collect_after)
        else:
            deleted = saved(actions.delete_stored(free, store, workers), folder, "deleted")
            totals = stats.gc_totals(deleted.where("deleted")).first()
            if totals["blobs_removed"]:
                draft.remove_blobs(deleted.where("deleted"))
            gc_bytes += totals["gc_bytes"]
            report["errors"] += deleted.where("not deleted").count()
    done = _commit(state, draft, meta, scan_id, complete, report)
    found = done.totals
    if draft.swept:  # only now: the catalog does not have them any more, and no one can have named them since
        swept, troubles = _delete(done.sweeping([draft.id]), store, workers, folder, "swept")
        gc_bytes += swept
        report["errors"] += troubles
        if not troubles:
            closing = state.draft(done)
            closing.closed = {draft.id}
            _committed(lambda: state.commit(closing, done.meta), report)
    report["bytes_reclaimed"] += gc_bytes
    log.info("bytes of removed blobs: %d", gc_bytes)
    report |= found | {"bytes_reclaimable": found["bytes_reclaimable"] + gc_bytes}
    report["scan_finished"] = datetime.now(timezone.utc)
    return report


def write_changes(before: Snapshot, draft: Draft, rows: DataFrame, accepted: DataFrame, stored: DataFrame, complete: list[tuple[str, str]], folder: str) -> None:
    """Writes what a listing changes: accepted records over the rows of their keys; objects that are too small now, or gone
    from a scope that was listed whole, leave.  `rows` are listed rows with `small` and `old`, `accepted` records with `old`."""
    dropped = rows.where("small and old is not null").dropDuplicates(KEY).select(*KEY, F.struct("old.blob_bucket", "old.blob_hash").alias("old"))
    if complete:
        dropped = dropped.unionByName(before.missing(rows, complete))
    moved = saved(changes.object_changes(accepted, dropped, draft.seq), folder, "moved")
    draft.write(moved, changes.blob_changes(changes.reference_changes(moved), accepted, stored, before.lookup_blobs, draft.seq))


def _delete(blobs: DataFrame, store: ObjectStore, workers: int, folder: str, name: str) -> tuple[int, int]:
    """The bytes of a sweep that is done, or none and how many blobs are left: then the whole of it is done again later, which
    does no harm, and counts then."""
    deleted = saved(actions.delete_stored(blobs, store, workers), folder, name)
    left = deleted.where("not deleted").count()
    return (0 if left else stats.gc_totals(deleted).first()["gc_bytes"]), left


def _commit(state: CatalogStore, draft: Draft, meta: dict, scan_id: str, seen: list[tuple[str, str]], report: dict) -> Snapshot:
    return _committed(lambda: state.commit(draft, meta, scan_id, seen), report)


def _committed(commit: Callable, report: dict):
    try:
        return commit()
    except Conflict as e:
        report["errors"] += 1
        raise ScanError(f"not committed: {e}", report) from e
