"""The catalog of base and deltas in the query catalogue: three epochs of the documents, written as changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.hashing import content_hash
from lodestrata.operators.changes import OBJECT_CHANGES, TOTALS
from lodestrata.plans.corpus import _STATS, CHANGED, GONE, MIN_SIZE, NEW, PREFIX, Query, listing, registrar
from lodestrata.plans.inventory import draft_inventory, scan_inventory
from lodestrata.schemas import KEY
from lodestrata.session import shared_folder
from lodestrata.sources.state import Snapshot, StateStore

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)

#: First without a source, then with it, then without another one and with changed bodies in a third.
EPOCHS = (1, 0, 2)
META = {"blob_prefix": PREFIX, "hash_algo": "sha256"}


def _hashed(spark: SparkSession, sf_dir: str, epoch: int) -> DataFrame:
    return listing(spark, sf_dir, epoch).withColumn("hash", content_hash("content")).drop("content")


def _store(spark: SparkSession) -> StateStore:
    """Every byte counts here: a base is written at once, and again when the deltas have a quarter of it."""
    return StateStore(spark, f"{shared_folder(spark)}/state", keep=len(EPOCHS) + 1, small=0)


def _buckets(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    return [(r[0], "") for r in listing(spark, sf_dir).select("bucket").distinct().orderBy("bucket").collect()]  # languages


def _epochs(spark: SparkSession, sf_dir: str) -> list[Snapshot]:
    state, scopes = _store(spark), _buckets(spark, sf_dir)
    return [scan_inventory(state, _hashed(spark, sf_dir, e), scopes, f"scan-{i}", PREFIX, MIN_SIZE) for i, e in enumerate(EPOCHS, 1)]


@query("r AS (SELECT 1) SELECT bucket, object_key, etag, size, bucket AS blob_bucket, hash AS blob_hash, 'scan-3' AS last_seen_scan FROM k2")
def catalog_after_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and deltas, merged: all objects were seen last in the third epoch, which wrote the changed ones only."""
    return _epochs(spark, sf_dir)[-1].objects.select(*KEY, "etag", "size", "blob_bucket", "blob_hash", "last_seen_scan")


@query(
    f"""a AS (SELECT bucket, hash, size, 0 AS live FROM k1 UNION ALL SELECT bucket, hash, size, 0 FROM k0 UNION ALL SELECT bucket, hash, size, 1 FROM k2)
    SELECT bucket, '{PREFIX}' || hash AS blob_key, hash, any_value(size) AS size, CAST(sum(live) AS BIGINT) AS ref_count FROM a GROUP BY ALL"""
)
def blobs_after_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts that are sums of signed changes are those of a recount; blobs that nothing names stay with 0."""
    return _epochs(spark, sf_dir)[-1].blobs.drop("stored")


def _totals(view: str, epoch: int) -> str:
    return f"SELECT {epoch} AS epoch, {_STATS} FROM (SELECT bucket, hash, size, count(*) AS n FROM {view} GROUP BY ALL)"


_TOTALS = " UNION ALL ".join(_totals(f"k{e}", i) for i, e in enumerate(EPOCHS, 1))
_WRITTEN = f"""w AS (SELECT 1 AS epoch, count(*) AS written, 0 AS deleted FROM k1 UNION ALL SELECT 2, count(*), 0 FROM k0 WHERE starts_with(object_key, '{NEW}/')
    UNION ALL SELECT 3, (SELECT count(*) FROM k2 WHERE starts_with(object_key, '{CHANGED}/')), (SELECT count(*) FROM k0 WHERE starts_with(object_key, '{GONE}/'))), t AS ({_TOTALS})"""


@query(_WRITTEN + " SELECT CAST(epoch AS INTEGER) AS epoch, CAST(written AS BIGINT) AS written, CAST(deleted AS BIGINT) AS deleted, unique_blobs, duplicates_found, bytes_reclaimable FROM w JOIN t USING (epoch)")
def changes_by_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each epoch wrote, which is what had changed, and the statistics that it moved."""
    done = _epochs(spark, sf_dir)
    store = done[-1]._store
    deltas = [store._read(s.at.own, "objects", OBJECT_CHANGES).agg(F.count_if(~F.col("deleted")).alias("written"), F.count_if("deleted").alias("deleted")).withColumn("epoch", F.lit(i)) for i, s in enumerate(done, 1)]
    totals = spark.createDataFrame([(i, *(s.totals[name] for name in TOTALS)) for i, s in enumerate(done, 1)], "epoch int, unique_blobs bigint, duplicates_found bigint, bytes_reclaimable bigint")
    written = deltas[0].unionByName(deltas[1]).unionByName(deltas[2])
    return written.join(totals, "epoch").select("epoch", "written", "deleted", *TOTALS)


@query(f"g AS (SELECT bucket, hash, size, count(*) AS n FROM k0 GROUP BY ALL) SELECT bucket, {_STATS} FROM g GROUP BY bucket")
def interleaved_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scans of different scopes begin on one version; the second takes its changes over what the first has committed."""
    state, scopes = _store(spark), _buckets(spark, sf_dir)
    before, rows = state.load(), _hashed(spark, sf_dir, 0)
    half = len(scopes) // 2
    drafts = [draft_inventory(state, rows, part, f"scan-{i}", PREFIX, MIN_SIZE, before=before) for i, part in enumerate((scopes[:half], scopes[half:]))]
    for i, (draft, part) in enumerate(zip(drafts, (scopes[:half], scopes[half:]))):
        done = state.commit(draft, META, f"scan-{i}", part)
    return spark.createDataFrame([(b, *t) for b, t in done.at.totals.items()], "bucket string, unique_blobs bigint, duplicates_found bigint, bytes_reclaimable bigint")
