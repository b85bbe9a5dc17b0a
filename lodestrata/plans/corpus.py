"""The query catalogue: every operator over the whole `documents` table seen as a bucket listing.

A document is an object: its language is the bucket, its source and id are the key, its text is the
body.  Two epochs make the incremental operators work: the first lacks one source (its objects are
new in the second), the second lacks another (its objects are gone) and has changed bodies in a
third.  Each entry has the Spark plan and the SQL that gives the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions.hashing import blob_key, content_hash
from lodestrata.functions.pointers import parse_pointer, render_pointer
from lodestrata.functions.times import rfc3339
from lodestrata.operators import catalog, filters, relink, stats
from lodestrata.schemas import BLOBS, KEY, OBJECTS, RECORDS

MIN_SIZE, PREFIX = 100, "blobs/"
NEW, GONE, CHANGED = "src3", "src5", "src7"
WHEN = "2026-03-01 00:00:00"
SCOPES = [("en", ""), ("de", "src1"), ("fr", "src2"), ("es", "src")]
OVERLAPPING = [("en", ""), ("en", "src1"), ("en", "src11")]

# ------------------------------------------------------------------ views


def listing(spark: SparkSession, sf_dir: str, epoch: int = 0, bucket: str = "lang") -> DataFrame:
    """The documents as listed objects, with their bodies.  Epoch 0 is all of them as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    body = F.coalesce("text", F.lit(""))
    if epoch == 1:
        docs = docs.where(F.col("source") != NEW)
    elif epoch == 2:
        docs = docs.where(F.col("source") != GONE)
        body = F.when(F.col("source") == CHANGED, F.concat(body, F.lit("#v2"))).otherwise(body)
    docs = docs.withColumn("content", body)
    return docs.select(
        F.coalesce(bucket, F.lit("")).alias("bucket"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("object_key"), F.md5("content").alias("etag"),
        F.octet_length("content").cast("long").alias("size"), F.lit(WHEN).cast("timestamp").alias("last_modified"), F.lit("").alias("content_type"), "content",
    )


def kept(rows: DataFrame) -> DataFrame:
    return rows.where(filters.outside_blob_prefix(PREFIX) & ~filters.too_small(MIN_SIZE))


def records(rows: DataFrame, scan: str) -> DataFrame:
    hashed = rows.withColumn("hash", content_hash("content"))
    return hashed.withColumns({"blob_bucket": F.col("bucket"), "blob_key": blob_key(PREFIX, "hash"), "blob_size": F.col("size"), "last_seen_scan": F.lit(scan), "is_pointer": F.lit(False), "hash_algo": F.lit("sha256")}).select(RECORDS.fieldNames())


def empty(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return spark.createDataFrame([], OBJECTS), spark.createDataFrame([], BLOBS)


def state(spark: SparkSession, sf_dir: str, bucket: str = "lang", epoch: int = 1) -> tuple[DataFrame, DataFrame]:
    """The catalog after a first scan."""
    objects, blobs = empty(spark)
    found = records(kept(listing(spark, sf_dir, epoch, bucket)), f"scan-{epoch}")
    objects = catalog.register(objects, found)
    return objects, catalog.refresh_blobs(blobs, objects, found)


def moved_on(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The catalog after the second scan, and what it registered."""
    objects, blobs = state(spark, sf_dir)
    rows = listing(spark, sf_dir, 2)
    found = records(filters.to_process(kept(rows), objects), "scan-2")
    after = catalog.mark_seen(objects, rows.drop("content"), "scan-2")
    after = catalog.unregister(after, rows.where(filters.too_small(MIN_SIZE)))
    after = catalog.register(after, found)
    whole = [(b, "") for b in ("en", "de", "fr", "es")]
    after = after.join(filters.stale(after, whole, "scan-2").select(KEY), KEY, "left_anti")
    return after, catalog.refresh_blobs(blobs, after, found), found


_VIEW = """SELECT coalesce({bucket}, '') AS bucket, source || '/' || CAST(doc_id AS VARCHAR) AS object_key, md5(content) AS etag,
    CAST(strlen(content) AS BIGINT) AS size, content, sha256(content) AS hash FROM (SELECT doc_id, lang, source, {body} AS content FROM documents {where})"""
_WITH = f"""WITH l0 AS ({_VIEW.format(bucket="lang", body="coalesce(text, '')", where="")}),
ls AS ({_VIEW.format(bucket="source", body="coalesce(text, '')", where="")}),
l1 AS ({_VIEW.format(bucket="lang", body="coalesce(text, '')", where=f"WHERE source <> '{NEW}'")}),
l2 AS ({_VIEW.format(bucket="lang", body=f"coalesce(text, '') || CASE WHEN source = '{CHANGED}' THEN '#v2' ELSE '' END", where=f"WHERE source <> '{GONE}'")}),
k0 AS (SELECT * FROM l0 WHERE size >= {MIN_SIZE}), ks AS (SELECT * FROM ls WHERE size >= {MIN_SIZE}), k1 AS (SELECT * FROM l1 WHERE size >= {MIN_SIZE}), k2 AS (SELECT * FROM l2 WHERE size >= {MIN_SIZE}),
c1 AS (SELECT * FROM k1), c2 AS (SELECT * FROM k2),
b2 AS (SELECT bucket, hash, any_value(size) AS size, CAST(sum(live) AS BIGINT) AS ref_count FROM (SELECT bucket, hash, size, 0 AS live FROM c1 UNION ALL SELECT bucket, hash, size, 1 AS live FROM c2) GROUP BY ALL),
"""
_STATS = "CAST(count(*) AS BIGINT) AS unique_blobs, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicates_found, CAST(coalesce(sum((n - 1) * size), 0) AS BIGINT) AS bytes_reclaimable"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registrar(queries: dict[str, Query], oracles: dict[str, str]):
    """A decorator that registers a query, with the SQL that gives the same rows."""

    def query(sql: str | None):
        def add(f: Query) -> Query:
            queries[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = _WITH + sql
            return f

        return add

    return query


query = registrar(QUERIES, ORACLES)


def _scoped(scopes: list[tuple[str, str]]) -> str:
    rows = ", ".join(f"('{b}', '{p}')" for b, p in scopes)
    return f"s AS (SELECT * FROM (VALUES {rows}) AS v(scope_bucket, scope_prefix)), r AS (SELECT * FROM l0 JOIN s ON bucket = scope_bucket AND starts_with(object_key, scope_prefix))"


# ------------------------------------------------------------------ filters


@query(_scoped(SCOPES) + " SELECT scope_bucket, scope_prefix, object_key, size FROM r")
def list_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_scopes(listing(spark, sf_dir), SCOPES).select("scope_bucket", "scope_prefix", "object_key", "size")


@query(_scoped(OVERLAPPING) + f" SELECT count(*) AS objects_scanned, count(DISTINCT object_key) AS objects_listed FROM r WHERE size >= {MIN_SIZE}")
def overlapping_scopes_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kept(filters.filter_scopes(listing(spark, sf_dir), OVERLAPPING))
    return rows.groupBy("object_key").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("objects_scanned"), F.count("*").alias("objects_listed"))


_MANY = [(b, f"src{i}/{j}") for b in ("en", "de", "fr", "es") for i in range(20) for j in range(125)]


@query(
    """s AS (SELECT b AS scope_bucket, 'src' || i || '/' || j AS scope_prefix FROM unnest(['en', 'de', 'fr', 'es']) AS x(b), range(20) AS y(i), range(125) AS z(j))
    SELECT scope_bucket, scope_prefix, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM l0 JOIN s ON bucket = scope_bucket AND starts_with(object_key, scope_prefix) GROUP BY ALL"""
)
def ten_thousand_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects and bytes of each of 10,000 overlapping scopes that has any."""
    return filters.filter_scopes(listing(spark, sf_dir), _MANY).groupBy("scope_bucket", "scope_prefix").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("r AS (SELECT 1) SELECT bucket, object_key, size FROM l0 WHERE NOT starts_with(object_key, 'src1/')")
def exclude_blob_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).where(filters.outside_blob_prefix("src1/")).select("bucket", "object_key", "size")


@query(f"r AS (SELECT 1) SELECT bucket, object_key, size, size < {MIN_SIZE} AS too_small FROM l0")
def min_size_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select("bucket", "object_key", "size", filters.too_small(MIN_SIZE).alias("too_small"))


@query("r AS (SELECT 1) SELECT k2.bucket, k2.object_key, k2.etag FROM k2 JOIN c1 ON k2.bucket = c1.bucket AND k2.object_key = c1.object_key AND k2.etag = c1.etag AND k2.size = c1.size")
def unchanged_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.unchanged(kept(listing(spark, sf_dir, 2)), state(spark, sf_dir)[0]).select("bucket", "object_key", "etag")


@query("r AS (SELECT 1) SELECT bucket, object_key, etag FROM k2 WHERE NOT EXISTS (SELECT 1 FROM c1 WHERE k2.bucket = c1.bucket AND k2.object_key = c1.object_key AND k2.etag = c1.etag AND k2.size = c1.size)")
def to_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.to_process(kept(listing(spark, sf_dir, 2)), state(spark, sf_dir)[0]).select("bucket", "object_key", "etag")


@query("r AS (SELECT 1) SELECT l1.bucket, l1.object_key, l1.etag <> l2.etag OR l1.size <> l2.size AS changed FROM l1 JOIN l2 ON l1.bucket = l2.bucket AND l1.object_key = l2.object_key")
def changed_during_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    look = lambda n: listing(spark, sf_dir, n).select(*KEY, F.struct("etag", "size", "last_modified").alias(f"look{n}"))
    return look(1).join(look(2), KEY).select(*KEY, filters.is_changed("look1", "look2").alias("changed"))


_BAD = {"src1": "blob_bucket", "src2": "blob_key", "src4": "bucket", "src6": "object_key", "src8": "hash"}


@query(
    f"""r AS (SELECT 1) SELECT source || '/' || CAST(doc_id AS VARCHAR) AS id, CASE source WHEN 'src1' THEN 'blob bucket is empty' WHEN 'src2' THEN 'blob key is empty'
    WHEN 'src9' THEN 'blob size is negative' WHEN 'src4' THEN 'bucket is empty' WHEN 'src6' THEN 'key is empty' WHEN 'src8' THEN 'hash is empty' WHEN 'src10' THEN 'size is negative' END AS error
    FROM documents WHERE strlen(coalesce(text, '')) >= {MIN_SIZE}"""
)
def invalid_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(kept(listing(spark, sf_dir)), "scan-1").withColumn("id", F.col("object_key")).withColumn("src", F.substring_index("object_key", "/", 1))
    broken = {name: F.when(F.col("src") == src, "").otherwise(F.col(name)).alias(name) for src, name in _BAD.items()}
    broken["blob_size"] = F.when(F.col("src") == "src9", -F.col("blob_size")).otherwise(F.col("blob_size"))
    broken["size"] = F.when(F.col("src") == "src10", -F.col("size")).otherwise(F.col("size"))
    return rows.withColumns(broken).select("id", filters.record_error().alias("error"))


# ------------------------------------------------------------------ projections


@query("r AS (SELECT 1) SELECT bucket, object_key, hash FROM l0")
def content_hash_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select(*KEY, content_hash("content").alias("hash"))


@query(None)
def content_hash_sha512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(spark, sf_dir).select(*KEY, content_hash("content", "sha512").alias("hash"))


@query(f"r AS (SELECT 1) SELECT bucket, object_key, etag, size, '2026-03-01T00:00:00Z' AS last_modified, bucket AS blob_bucket, '{PREFIX}' || hash AS blob_key, size AS blob_size, hash FROM k0")
def object_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(kept(listing(spark, sf_dir)), "scan-1")
    return r.select(*KEY, "etag", "size", rfc3339(F.col("last_modified")).alias("last_modified"), "blob_bucket", "blob_key", "blob_size", "hash")


@query(f"""r AS (SELECT 1) SELECT bucket, object_key, '{{"blob_bucket":"' || bucket || '","blob_key":"{PREFIX}' || hash || '","hash":"' || hash || '","size":' || CAST(size AS VARCHAR) || ',"content_type":"text/plain"}}' AS pointer FROM k0""")
def pointer_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(kept(listing(spark, sf_dir)), "scan-1")
    return r.select(*KEY, render_pointer(F.col("blob_bucket"), F.col("blob_key"), F.col("hash"), F.col("blob_size"), F.lit("text/plain")).alias("pointer"))


# pointer bodies as they may lie in storage: sound ones, and one kind of damage per source
_BODY = f"""CASE source WHEN 'src1' THEN '{{"blob_bucket":"","blob_key":"{PREFIX}' || hash || '","hash":"' || hash || '","size":' || size || '}}'
    WHEN 'src2' THEN '{{"blob_bucket":"' || bucket || '","blob_key":"{PREFIX}' || hash || '","hash":"' || hash || '","size":-1}}'
    WHEN 'src4' THEN '{{"blob_bucket":"' || bucket || '","blob_key":"{PREFIX}' || hash || '","hash":"' || hash || '","size":' || size || ',"extra":1}}'
    WHEN 'src6' THEN '{{"blob_bucket":"' || bucket || '","blob_key":"{PREFIX}' || hash || '","hash":5,"size":' || size || '}}'
    WHEN 'src8' THEN 'no json' WHEN 'src9' THEN '{{"blob_bucket":"' || bucket || '","blob_key":"{PREFIX}x","hash":"' || hash || '","size":' || size || '}}'
    WHEN 'src10' THEN '{{"blob_bucket":"' || bucket || '","blob_key":"{PREFIX}' || hash || '","hash":"' || hash || '","size":' || (size + 1) || '}}'
    WHEN 'src11' THEN '{{"blob_bucket":"nowhere","blob_key":"{PREFIX}' || hash || '","hash":"' || hash || '","size":' || size || '}}'
    ELSE '{{"blob_bucket":"' || bucket || '","blob_key":"{PREFIX}' || hash || '","hash":"' || hash || '","size":' || size || ',"content_type":"text/plain"}}' END"""
_ERROR = "CASE source WHEN 'src1' THEN 'blob_bucket is empty' WHEN 'src2' THEN 'size is negative' WHEN 'src4' THEN 'unknown field ''extra''' WHEN 'src6' THEN 'wrong type of ''hash''' WHEN 'src8' THEN 'not a JSON document' END"


def pointer_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(kept(listing(spark, sf_dir)), "scan-1").withColumn("source", F.substring_index("object_key", "/", 1))
    return r.select("bucket", "object_key", F.expr(_BODY).alias("body"))


@query(f"""p AS (SELECT *, split_part(object_key, '/', 1) AS source FROM k0) SELECT bucket, object_key, {_ERROR} AS error,
    CASE WHEN {_ERROR} IS NULL THEN CASE source WHEN 'src11' THEN 'nowhere' ELSE bucket END END AS blob_bucket,
    CASE WHEN {_ERROR} IS NULL THEN CASE source WHEN 'src9' THEN '{PREFIX}x' ELSE '{PREFIX}' || hash END END AS blob_key,
    CASE WHEN {_ERROR} IS NULL THEN hash END AS hash, CASE WHEN {_ERROR} IS NULL THEN CASE source WHEN 'src10' THEN size + 1 ELSE size END END AS size,
    CASE WHEN {_ERROR} IS NULL THEN CASE WHEN source IN ('src9', 'src10', 'src11') THEN '' ELSE 'text/plain' END END AS content_type FROM p""")
def pointer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pointer_bodies(spark, sf_dir).select("bucket", "object_key", parse_pointer(F.col("body")).alias("p")).select("bucket", "object_key", "p.error", "p.pointer.*")


@query(f"""p AS (SELECT *, split_part(object_key, '/', 1) AS source FROM k0) SELECT bucket, object_key, CASE source WHEN 'src9' THEN 'pointer key does not match its hash'
    WHEN 'src11' THEN 'blob does not exist' WHEN 'src10' THEN 'pointer and blob differ' END AS error FROM p WHERE {_ERROR} IS NULL""")
def pointer_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = records(kept(listing(spark, sf_dir)), "scan-1").select("blob_bucket", "blob_key", "blob_size").distinct()
    stored = blobs.select(F.col("blob_bucket").alias("bucket"), F.col("blob_key").alias("object_key"), F.col("blob_size").alias("size"))
    p = pointer_bodies(spark, sf_dir).select("bucket", "object_key", parse_pointer(F.col("body")).alias("p")).where("p.error is null").select("bucket", "object_key", "p.pointer.*")
    return filters.resolve_pointers(p, stored, PREFIX).select("bucket", "object_key", "error")


# ------------------------------------------------------------------ statistics


@query("r AS (SELECT bucket AS blob_bucket, hash AS blob_hash, size, count(*) AS n FROM k0 GROUP BY ALL) SELECT * FROM r WHERE n > 1")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.blob_groups(*state(spark, sf_dir, epoch=0)).where("n > 1")


@query("r AS (SELECT 1) SELECT bucket, hash, count(*) AS ref_count FROM k0 GROUP BY ALL")
def blob_ref_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.count_references(state(spark, sf_dir, epoch=0)[0])


@query(f"g AS (SELECT bucket, hash, size, count(*) AS n FROM k0 GROUP BY ALL) SELECT {_STATS} FROM g")
def stats_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stats(*state(spark, sf_dir, epoch=0))


@query(f"g AS (SELECT bucket, hash, size, count(*) AS n FROM ks GROUP BY ALL) SELECT bucket AS blob_bucket, {_STATS} FROM g GROUP BY bucket")
def stats_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summarize(stats.blob_groups(*state(spark, sf_dir, "source", 0)), ["blob_bucket"])


# ------------------------------------------------------------------ transitions


@query("r AS (SELECT 1) SELECT k2.bucket, k2.object_key, CASE WHEN c1.hash IS NULL THEN 'insert' WHEN c1.hash = k2.hash THEN 'same' ELSE 'move' END AS \"case\" FROM k2 LEFT JOIN c1 ON k2.bucket = c1.bucket AND k2.object_key = c1.object_key")
def register_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.label_records(records(kept(listing(spark, sf_dir, 2)), "scan-2"), *state(spark, sf_dir)).where("error is null").select(*KEY, "case")


def _first(value: str) -> str:
    """Per blob, what the record with the smallest key has."""
    return f"f AS (SELECT bucket, hash, arg_min({value}, object_key) AS first FROM d GROUP BY ALL)"


@query(f"d AS (SELECT *, size + CASE WHEN starts_with(object_key, 'src8/') THEN 1 ELSE 0 END AS claimed FROM k0), {_first('claimed')} SELECT bucket, object_key FROM d JOIN f USING (bucket, hash) WHERE claimed <> first")
def size_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    claimed = F.col("blob_size") + F.when(F.col("object_key").startswith("src8/"), 1).otherwise(0)
    r = records(kept(listing(spark, sf_dir)), "scan-1").withColumn("blob_size", claimed.cast("long"))
    return catalog.label_records(r, *empty(spark)).where("error = 'blob size mismatch'").select(KEY)


@query(f"d AS (SELECT *, CASE WHEN starts_with(object_key, 'src8/') THEN 'other/' ELSE '{PREFIX}' END || hash AS claimed FROM k0), {_first('claimed')} SELECT bucket, object_key FROM d JOIN f USING (bucket, hash) WHERE claimed <> first")
def blob_key_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(kept(listing(spark, sf_dir)), "scan-1").withColumn("blob_key", F.when(F.col("object_key").startswith("src8/"), blob_key("other/", "hash")).otherwise(F.col("blob_key")))
    return catalog.label_records(r, *empty(spark)).where("error = 'blob key mismatch'").select(KEY)


@query("r AS (SELECT 1) SELECT c1.bucket, c1.object_key, CASE WHEN l2.etag IS NULL THEN 'scan-1' ELSE 'scan-2' END AS last_seen_scan FROM c1 LEFT JOIN l2 ON c1.bucket = l2.bucket AND c1.object_key = l2.object_key")
def mark_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.mark_seen(state(spark, sf_dir)[0], listing(spark, sf_dir, 2).drop("content"), "scan-2").select(*KEY, "last_seen_scan")


_SMALLER = f"s2 AS (SELECT bucket, object_key FROM l2 WHERE size < 4 * {MIN_SIZE})"


@query(f"{_SMALLER} SELECT bucket, object_key FROM c1 WHERE NOT EXISTS (SELECT 1 FROM s2 WHERE s2.bucket = c1.bucket AND s2.object_key = c1.object_key)")
def unregister_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raised threshold: what is now too small leaves the catalog."""
    return catalog.unregister(state(spark, sf_dir)[0], listing(spark, sf_dir, 2).where(filters.too_small(4 * MIN_SIZE))).select(KEY)


_GONE = "g AS (SELECT c1.* FROM c1 WHERE NOT EXISTS (SELECT 1 FROM l2 WHERE l2.bucket = c1.bucket AND l2.object_key = c1.object_key))"


def _missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.missing_from(state(spark, sf_dir)[0], listing(spark, sf_dir, 2), SCOPES)


_SCOPED_GONE = _GONE + ", h AS (SELECT * FROM g WHERE " + " OR ".join(f"(bucket = '{b}' AND starts_with(object_key, '{p}'))" for b, p in SCOPES) + ")"


@query(_SCOPED_GONE + " SELECT count(*) AS removed FROM h")
def finalize_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _missing(spark, sf_dir).agg(F.count("*").alias("removed"))


@query(_SCOPED_GONE + " SELECT bucket AS blob_bucket, hash AS blob_hash, count(*) AS n FROM h GROUP BY ALL")
def finalize_delta_by_blob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.stale_by_blob(_missing(spark, sf_dir))


@query("r AS (SELECT 1) SELECT bucket, object_key, etag, size, bucket AS blob_bucket, hash AS blob_hash, 'scan-2' AS last_seen_scan FROM c2")
def objects_after_epoch2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved_on(spark, sf_dir)[0].select(*KEY, "etag", "size", "blob_bucket", "blob_hash", "last_seen_scan")


@query(f"r AS (SELECT 1) SELECT bucket, '{PREFIX}' || hash AS blob_key, hash, size, ref_count FROM b2")
def blobs_after_epoch2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return moved_on(spark, sf_dir)[1].drop("stored")


@query("r AS (SELECT 1) SELECT bucket, hash, size FROM b2 WHERE ref_count = 0")
def unreferenced_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unreferenced(moved_on(spark, sf_dir)[1]).select("bucket", "hash", "size")


@query("r AS (SELECT 1) SELECT count(*) AS blobs_removed, CAST(coalesce(sum(size), 0) AS BIGINT) AS gc_bytes FROM b2 WHERE ref_count = 0 AND bucket IN ('en', 'de')")
def gc_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = moved_on(spark, sf_dir)[1].withColumn("stored", F.lit(True))
    return stats.gc_totals(relink.plan_collection(blobs, ["en", "de", "en"]).where("error is null"))


@query("r AS (SELECT 1) SELECT bucket, hash FROM b2 WHERE ref_count > 0")
def blobs_after_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    blobs = moved_on(spark, sf_dir)[1]
    return catalog.delete_blobs(blobs, blobs.where("ref_count = 0")).select("bucket", "hash")


@query("m AS (SELECT CASE WHEN starts_with(object_key, 'src7/') THEN 'archive' ELSE bucket END AS blob_bucket, hash, size, count(*) AS n FROM k0 GROUP BY ALL) SELECT blob_bucket, " + _STATS + " FROM m GROUP BY blob_bucket")
def move_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blobs of one source move to another bucket: the hash stays, the reference changes."""
    objects, blobs = state(spark, sf_dir, epoch=0)
    moved = records(kept(listing(spark, sf_dir)).where(F.col("object_key").startswith("src7/")), "scan-2").withColumn("blob_bucket", F.lit("archive"))
    fine = catalog.label_records(moved, objects, blobs).where("error is null and case = 'move'")
    after = catalog.register(objects, fine)
    return stats.summarize(stats.blob_groups(after, catalog.refresh_blobs(blobs, after, fine)), ["blob_bucket"])


@query("r AS (SELECT 1) SELECT 'none' AS rule, '' AS bucket, '' AS name WHERE false")
def catalog_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that break an invariant of the catalog after the second scan: there are none."""
    objects, blobs, _ = moved_on(spark, sf_dir)
    return catalog.broken_invariants(objects, blobs)


# ------------------------------------------------------------------ relinking and the report

_RELINK = f"""f AS (SELECT bucket, hash, min(object_key) AS first_key FROM k0 GROUP BY ALL), r AS (SELECT k0.bucket, object_key, hash, size AS listed_size,
    CASE WHEN object_key = first_key THEN size ELSE 0 END AS uploaded, CAST(strlen('{{"blob_bucket":"","blob_key":"{PREFIX}","hash":"","size":}}') + strlen(bucket) + 128 + strlen(CAST(size AS VARCHAR)) AS BIGINT) AS now_size
    FROM k0 JOIN f USING (bucket, hash))"""


def _relinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(kept(listing(spark, sf_dir)), "scan-1").withColumn("content_type", F.lit(""))
    return relink.plan_relinks(r, empty(spark)[1], PREFIX)


@query(_RELINK + " SELECT bucket, object_key, hash, listed_size, uploaded, now_size FROM r")
def relink_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _relinks(spark, sf_dir).select("bucket", "object_key", "hash", "listed_size", "uploaded", "now_size")


_RECLAIMED = "CAST(coalesce(sum(greatest(listed_size - now_size - uploaded, 0)), 0) AS BIGINT) AS bytes_reclaimed"


@query(_RELINK + f" SELECT count(*) AS objects_relinked, {_RECLAIMED}, CAST(coalesce(sum(listed_size - now_size - uploaded), 0) AS BIGINT) AS net_bytes_reclaimed FROM r")
def bytes_reclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reclaimed(_relinks(spark, sf_dir))


@query(
    _RELINK + f""", g AS (SELECT bucket, hash, size, count(*) AS n FROM k0 GROUP BY ALL), t AS (SELECT {_STATS} FROM g), q AS (SELECT count(*) AS objects_scanned FROM k0),
    u AS (SELECT count(*) AS objects_relinked, {_RECLAIMED} FROM r) SELECT 'pointer' AS mode, CAST(0 AS BIGINT) AS errors, q.*, t.*, u.* FROM q, t, u"""
)
def report_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a first scan in pointer mode; its times are left out."""
    scanned = kept(listing(spark, sf_dir)).agg(F.count("*").alias("objects_scanned"))
    troubles = catalog.label_records(records(kept(listing(spark, sf_dir)), "scan-1"), *empty(spark)).agg(F.count("error").alias("errors"))
    rows = scanned.join(troubles).join(stats.stats(*state(spark, sf_dir, epoch=0))).join(stats.reclaimed(_relinks(spark, sf_dir)).drop("net_bytes_reclaimed"))  # one row each
    return rows.select(F.lit("pointer").alias("mode"), "*")
