"""Whole scans in the query catalogue: the documents are put into a store, scanned, changed and scanned again.

All documents are objects of one bucket, `lang/source/id` is the key.  Each entry runs the engine as a
user would, with real bodies, pointers, blobs and faults, and returns what the scan reports or keeps;
the SQL derives the same from the documents.
"""

from __future__ import annotations

import io
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.config import Bucket, Config
from lodestrata.operators import catalog, relink
from lodestrata.plans.corpus import _WITH as WITH
from lodestrata.plans.corpus import CHANGED, GONE, MIN_SIZE, NEW, PREFIX, Query, listing, moved_on, registrar, report_row
from lodestrata.plans.corpus import ORACLES as ORACLES_OF_CORPUS
from lodestrata.plans.scan import scan_once
from lodestrata.schemas import KEY, struct
from lodestrata.session import shared_folder
from lodestrata.sources.listing import list_scopes
from lodestrata.sources.objectstore import FileStore
from lodestrata.sources.reports import read_report, report_frame, write_report
from lodestrata.sources.rows import map_rows
from lodestrata.sources.state import StateStore
from lodestrata.streaming.loop import run_loop

BUCKET, KIND = "corpus", "text/plain"
#: Sources whose bodies cannot be read, whose blobs are lost, and for whose blobs other bytes stand in storage.
UNREADABLE, LOST, TAKEN = "src3", "src9", "src8"
TIMES = ("scan_started", "scan_finished")

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)


class Unreadable(FileStore):
    """A store in which the bodies of one source fail where the id ends in an odd digit."""

    def get(self, bucket: str, key: str):
        if f"/{UNREADABLE}/" in key and key[-1] in "13579":
            raise OSError("unreadable")
        return super().get(bucket, key)


class Corpus:
    def __init__(self, spark: SparkSession, sf_dir: str, mode: str = "pointer"):
        self.spark, self.sf_dir, self.folder = spark, sf_dir, shared_folder(spark)
        if not self.folder.startswith(("file:", "/")):
            raise ValueError("these scans run on a store of files: spark.checkpoint.dir must be a shared file system")
        self.store = FileStore(self.folder.removeprefix("file://") + "/store")
        self.store.create_bucket(BUCKET)
        self.config, self.states = Config(), 0
        self.config.s3.buckets = [Bucket(BUCKET, "")]
        self.config.dedup.mode, self.config.dedup.delete_originals, self.config.dedup.min_size_bytes = mode, True, MIN_SIZE
        self.forget()

    def forget(self) -> None:
        """A new, empty catalog."""
        self.states += 1
        self.state = StateStore(self.spark, f"{self.folder}/state-{self.states}")

    def objects(self, epoch: int) -> DataFrame:
        return listing(self.spark, self.sf_dir, epoch).select(F.concat("bucket", F.lit("/"), "object_key").alias("key"), "content")

    def put(self, rows: DataFrame) -> None:
        """Puts (key, content) into the store."""
        store = self.store

        def run(found):
            for r in found:
                body = r["content"].encode()
                yield {"n": store.put(BUCKET, r["key"], io.BytesIO(body), len(body), KIND)}

        map_rows(rows, struct("n bigint"), run).agg(F.sum("n")).collect()

    def remove(self, keys: DataFrame) -> None:
        store = self.store
        map_rows(keys.select("key"), struct("n bigint"), lambda rows: ({"n": len(store.remove(BUCKET, [r["key"]]))} for r in rows)).agg(F.sum("n")).collect()

    def scan(self, store: FileStore | None = None) -> DataFrame:
        return report_frame(self.spark, scan_once(self.spark, store or self.store, self.state, self.config)).drop(*TIMES)


def source_of(key: str = "key"):
    return F.element_at(F.split(key, "/"), -2)


def _documents(body: str, where: str = "") -> str:
    return f"""SELECT coalesce(lang, '') || '/' || source || '/' || CAST(doc_id AS VARCHAR) AS key, source, CAST(strlen(content) AS BIGINT) AS size, sha256(content) AS hash
    FROM (SELECT doc_id, lang, source, {body} AS content FROM documents {where}) WHERE strlen(content) >= {MIN_SIZE}"""


_WHOLE = "coalesce(text, '')"
_D0 = f"d0 AS ({_documents(_WHOLE)})"
_D1 = f"d1 AS ({_documents(_WHOLE, f"WHERE source <> '{NEW}'")})"
_SECOND = f"{_WHOLE} || CASE WHEN source = '{CHANGED}' THEN '#v2' ELSE '' END"
_D2 = f"d2 AS ({_documents(_SECOND, f"WHERE source <> '{GONE}'")})"
_POINTER = f"""CAST(strlen('{{"blob_bucket":"{BUCKET}","blob_key":"{PREFIX}","hash":"","size":,"content_type":"{KIND}"}}') + 128 + strlen(CAST(size AS VARCHAR)) AS BIGINT)"""


def _report(mode: str, scanned: str, kept: str, errors: str, relinked: str = "SELECT 0 AS saved WHERE false") -> str:
    """The report as SQL: the table that is scanned, the rows that are kept, the number of errors, and what each relinked object saves."""
    return f"""g AS (SELECT hash, size, count(*) AS n FROM {kept} GROUP BY ALL), w AS ({relinked})
    SELECT (SELECT count(*) FROM {scanned}) AS objects_scanned, (SELECT count(*) FROM g) AS unique_blobs, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM g) AS duplicates_found,
    (SELECT CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) FROM g) AS bytes_reclaimable, (SELECT CAST(coalesce(sum(greatest(saved, 0)), 0) AS BIGINT) FROM w) AS bytes_reclaimed,
    (SELECT count(*) FROM w) AS objects_relinked, {errors} AS errors, '{mode}' AS mode"""


def _saved(rows: str, stored: str = "SELECT '' AS hash") -> str:
    return f"""SELECT size - {_POINTER} - CASE WHEN key = min(key) OVER (PARTITION BY hash) AND hash NOT IN ({stored}) THEN size ELSE 0 END AS saved FROM {rows}"""


@query(f"{_D0}, {_report('pointer', 'd0', 'd0', 'CAST(0 AS BIGINT)', _saved('d0'))}")
def scan_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a first scan in pointer mode."""
    c = Corpus(spark, sf_dir)
    c.put(c.objects(0))
    return c.scan()


@query(f"{_D0} SELECT '{BUCKET}' AS bucket, key AS object_key, {_POINTER} AS size, '{BUCKET}' AS blob_bucket, hash AS blob_hash, true AS is_pointer FROM d0")
def scan_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog after it: every object is a pointer now."""
    c = Corpus(spark, sf_dir)
    c.put(c.objects(0))
    c.scan()
    return c.state.load().objects.select(*KEY, "size", "blob_bucket", "blob_hash", "is_pointer")


_BAD = f"source = '{UNREADABLE}' AND right(key, 1) IN ('1', '3', '5', '7', '9')"


@query(
    f"{_D1}, {_D2}, bad AS (SELECT * FROM d2 WHERE {_BAD}), fine AS (SELECT * FROM d2 WHERE NOT ({_BAD})), new AS (SELECT * FROM fine WHERE source IN ('{NEW}', '{CHANGED}')), "
    + _report("pointer", "d2", "fine", "(SELECT count(*) FROM bad)", _saved("new", "SELECT hash FROM d1"))
)
def scan_second(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a second scan: objects are new, changed or gone, and some of the new ones cannot be read."""
    c = Corpus(spark, sf_dir)
    c.put(c.objects(1))
    c.scan()
    c.remove(c.objects(0).where(source_of() == GONE))
    c.put(c.objects(2).where(source_of().isin(NEW, CHANGED)))
    return c.scan(Unreadable(c.store.root))


@query(f"{_D1}, {_D2}, dead AS (SELECT DISTINCT hash, size FROM d1 WHERE hash NOT IN (SELECT hash FROM d2)) SELECT (SELECT count(*) FROM dead) AS blobs_gone, (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) FROM dead) AS bytes_gone, (SELECT count(DISTINCT hash) FROM d2) AS blobs_left")
def scan_collects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the collector removes from storage when objects are gone or changed."""
    c = Corpus(spark, sf_dir)
    c.put(c.objects(1))
    c.scan()
    stored = lambda: list_scopes(spark, c.store, [(BUCKET, PREFIX)]).select(F.col("object_key").alias("key"), "size")
    before = stored()
    c.remove(c.objects(0).where(source_of() == GONE))
    c.put(c.objects(2).where(source_of().isin(NEW, CHANGED)))
    c.scan()
    after = stored()
    gone = before.join(after, "key", "left_anti").agg(F.count("*").alias("blobs_gone"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_gone"))
    return gone.join(after.agg(F.count("*").alias("blobs_left")))  # one row each


_BOTH = _report("pointer", "d2", "d2", "CAST(0 AS BIGINT)", _saved("new", "SELECT hash FROM d1"))


@query(
    f"""{_D1}, {_D2}, new AS (SELECT * FROM d2 WHERE source IN ('{NEW}', '{CHANGED}')), dead AS (SELECT CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM (SELECT DISTINCT hash, size FROM d1 WHERE hash NOT IN (SELECT hash FROM d2))),
    {_BOTH.replace("SELECT (SELECT count(*)", ", p AS (SELECT (SELECT count(*)", 1)}) SELECT p.* REPLACE (bytes_reclaimable + dead.bytes AS bytes_reclaimable, bytes_reclaimed + dead.bytes AS bytes_reclaimed) FROM p, dead"""
)
def scan_relinks_and_collects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a scan that replaces new objects and collects the blobs of those that are gone: collected bytes count in both sums."""
    c = Corpus(spark, sf_dir)
    c.put(c.objects(1))
    c.scan()
    c.remove(c.objects(0).where(source_of() == GONE))
    c.put(c.objects(2).where(source_of().isin(NEW, CHANGED)))
    return c.scan()


@query(
    f"""{_D0}, {_D1}, {_D2}, back AS (SELECT hash FROM d0 WHERE source = '{GONE}')
    SELECT hash, any_value(size) AS size, hash IN (SELECT hash FROM back) AS survives, hash IN (SELECT hash FROM back) AS in_storage FROM d1 WHERE hash NOT IN (SELECT hash FROM d2) GROUP BY hash"""
)
def scan_collects_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that a scan has marked as unreferenced, and whether they survive the next one, for which some of their objects came back."""
    c = Corpus(spark, sf_dir)
    c.config.dedup.collect_after = 1
    c.put(c.objects(1))
    c.scan()
    c.remove(c.objects(0).where(source_of() == GONE))
    c.put(c.objects(2).where(source_of().isin(NEW, CHANGED)))
    c.scan()
    marked = c.state.load().marks.select("hash", "size")
    c.put(c.objects(0).where(source_of() == GONE))
    c.scan()
    known = c.state.load().blobs.select("hash", F.lit(True).alias("known"))
    there = list_scopes(spark, c.store, [(BUCKET, PREFIX)]).select(F.substring_index("object_key", "/", -1).alias("hash"), F.lit(True).alias("there"))
    found = marked.join(known, "hash", "left").join(there, "hash", "left")
    return found.select("hash", "size", F.coalesce("known", F.lit(False)).alias("survives"), F.coalesce("there", F.lit(False)).alias("in_storage"))


def _epoch(view: str, number: int) -> str:
    return f"""SELECT {number} AS epoch, (SELECT count(*) FROM {view}) AS objects_scanned, count(*) AS unique_blobs, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates_found,
    CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS bytes_reclaimable, CAST(0 AS BIGINT) AS errors FROM (SELECT hash, size, count(*) AS n FROM {view} GROUP BY ALL)"""


@query(f"{_D0}, {_D1}, {_D2} {_epoch('d1', 1)} UNION ALL {_epoch('d0', 2)} UNION ALL {_epoch('d2', 3)}")
def loop_over_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports of the loop's first three scans: a source comes, then another one goes and a third changes."""
    c, reports = Corpus(spark, sf_dir, "report_only"), []

    def before(epoch: int) -> None:
        if epoch == 0:
            c.put(c.objects(1))
        elif epoch == 1:
            c.put(c.objects(0).where(source_of() == NEW))
        else:
            c.remove(c.objects(0).where(source_of() == GONE))
            c.put(c.objects(2).where(source_of() == CHANGED))

    def scan() -> dict:
        before(len(reports))
        reports.append(scan_once(spark, c.store, c.state, c.config))
        return reports[-1]

    run_loop(0.0, scan, scans=3)
    names = ("objects_scanned", "unique_blobs", "duplicates_found", "bytes_reclaimable", "errors")
    return spark.createDataFrame([(i, *(r[n] for n in names)) for i, r in enumerate(reports, 1)], "epoch int, " + ", ".join(f"{n} bigint" for n in names))


@query(ORACLES_OF_CORPUS["report_row"][len(WITH) :])
def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that was written as JSON and read again."""
    now, path = datetime.now(timezone.utc), Path(shared_folder(spark).removeprefix("file://"))
    path.mkdir(parents=True)
    write_report(f"{path}/report.json", report_row(spark, sf_dir).first().asDict() | dict.fromkeys(TIMES, now))
    found = read_report(f"{path}/report.json")
    if any(found[t] != now for t in TIMES):
        raise ValueError("the times differ")
    return report_frame(spark, found).drop(*TIMES)


@query("c AS (SELECT bucket, hash, count(*) OVER (PARTITION BY bucket) AS n FROM b2 WHERE ref_count = 0 AND substr(hash, 1, 1) IN ('0', '1', '2', '3')) SELECT bucket, hash FROM c WHERE n > 1")
def collection_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that share a key with another one of their bucket are not collected but errors."""
    shared = F.when(F.substring("hash", 1, 1).isin("0", "1", "2", "3"), F.lit(f"{PREFIX}shared")).otherwise(F.col("blob_key"))
    blobs = moved_on(spark, sf_dir)[1].withColumns({"stored": F.lit(True), "blob_key": shared})
    return relink.plan_collection(blobs, ["en", "de", "fr", "es"]).where("error is not null").select("bucket", "hash")


_LOST = f"SELECT hash FROM d0 WHERE source = '{LOST}'"


@query(f"{_D0}, fine AS (SELECT * FROM d0 WHERE hash NOT IN ({_LOST})), " + _report("report_only", "d0", "fine", f"(SELECT count(*) FROM d0 WHERE hash IN ({_LOST}))"))
def scan_of_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog made anew from pointers, some of whose blobs are lost."""
    c = Corpus(spark, sf_dir)
    c.put(c.objects(0))
    c.scan()
    lost = c.objects(0).where((source_of() == LOST) & (F.octet_length("content") >= MIN_SIZE))
    c.remove(lost.select(F.concat(F.lit(PREFIX), F.sha2("content", 256)).alias("key")).distinct())
    c.forget()
    c.config.dedup.mode = "report_only"
    return c.scan()


_TAKEN = f"SELECT hash FROM d0 WHERE source = '{TAKEN}'"


@query(f"{_D0}, fine AS (SELECT * FROM d0 WHERE hash NOT IN ({_TAKEN})), " + _report("pointer", "d0", "fine", f"(SELECT count(*) FROM d0 WHERE hash IN ({_TAKEN}))", _saved("fine")))
def scan_with_size_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blob keys under which bytes of another size stand: their objects stay as they are and count as errors."""
    c = Corpus(spark, sf_dir)
    c.put(c.objects(0))
    taken = c.objects(0).where((source_of() == TAKEN) & (F.octet_length("content") >= MIN_SIZE))
    c.put(taken.select(F.concat(F.lit(PREFIX), F.sha2("content", 256)).alias("key"), F.lit("other bytes").alias("content")).distinct())
    return c.scan()


_PLANTED = """o AS (SELECT * FROM c2 UNION ALL SELECT * FROM c2 WHERE starts_with(object_key, 'src4/')),
    b AS (SELECT bucket, hash, ref_count + CASE WHEN starts_with(hash, '0') THEN 1 ELSE 0 END AS ref_count FROM b2 WHERE NOT starts_with(hash, '2') UNION ALL SELECT bucket, hash, ref_count FROM b2 WHERE starts_with(hash, '1')),
    n AS (SELECT bucket, hash, count(*) AS n FROM o GROUP BY ALL)
    SELECT 'ref_count' AS rule, coalesce(b.bucket, n.bucket) AS bucket, coalesce(b.hash, n.hash) AS name FROM b FULL JOIN n ON b.bucket = n.bucket AND b.hash = n.hash WHERE coalesce(ref_count, -1) <> coalesce(n, 0)
    UNION ALL SELECT 'object key', bucket, object_key FROM o GROUP BY bucket, object_key HAVING count(*) > 1
    UNION ALL SELECT 'blob key', bucket, hash FROM b GROUP BY bucket, hash HAVING count(*) > 1"""


@query(_PLANTED)
def planted_catalog_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrong counts, doubled rows and missing blobs, planted in a sound catalog, are what the check of invariants finds."""
    objects, blobs, _ = moved_on(spark, sf_dir)
    objects = objects.unionByName(objects.where(F.col("object_key").startswith("src4/")))
    counted = blobs.withColumn("ref_count", F.col("ref_count") + F.col("hash").startswith("0").cast("long")).where(~F.col("hash").startswith("2"))
    return catalog.broken_invariants(objects, counted.unionByName(blobs.where(F.col("hash").startswith("1"))))
