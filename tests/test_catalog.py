from datetime import datetime, timezone

import pytest

from lodestrata.operators import catalog, filters, relink, stats
from lodestrata.schemas import BLOBS, LISTING, OBJECTS, RECORDS

WHEN = datetime(2026, 3, 1, tzinfo=timezone.utc)


def record(key, digest, bucket="bucket", size=100, blob_bucket=None, scan="scan-1", blob_key=None, etag="etag"):
    blob_bucket = blob_bucket if blob_bucket is not None else bucket
    return (bucket, key, etag, size, WHEN, blob_bucket, blob_key or f"blobs/{digest}", size, digest, scan, False, "sha256")


class Catalog:
    def __init__(self, spark):
        self.spark = spark
        self.objects, self.blobs = spark.createDataFrame([], OBJECTS), spark.createDataFrame([], BLOBS)

    def register(self, *rows):
        r = self.spark.createDataFrame(list(rows), RECORDS)
        labelled = catalog.label_records(r, self.objects, self.blobs).collect()
        fine = self.spark.createDataFrame([tuple(x[c] for c in RECORDS.fieldNames()) for x in labelled if x["error"] is None], RECORDS)
        self.objects = self.pin(catalog.register(self.objects, fine), OBJECTS)
        self.blobs = self.pin(catalog.refresh_blobs(self.blobs, self.objects, fine), BLOBS)
        assert catalog.broken_invariants(self.objects, self.blobs).count() == 0
        return {(x["bucket"], x["object_key"]): x["error"] or x["case"] for x in labelled}

    def drop(self, df):
        self.objects = self.pin(df, OBJECTS)
        self.blobs = self.pin(catalog.refresh_blobs(self.blobs, self.objects, self.spark.createDataFrame([], RECORDS)), BLOBS)
        assert catalog.broken_invariants(self.objects, self.blobs).count() == 0

    def pin(self, df, schema):
        return self.spark.createDataFrame(df.collect(), schema)

    def refs(self):
        return {(r["bucket"], r["hash"]): r["ref_count"] for r in self.blobs.collect()}

    def stats(self):
        return tuple(stats.stats(self.objects, self.blobs).first())


@pytest.fixture
def cat(spark):
    return Catalog(spark)


def test_register_cases(cat):
    assert cat.stats() == (0, 0, 0)
    assert cat.register(record("one", "h"), record("two", "h"), record("three", "h"))["bucket", "one"] == "insert"
    assert cat.stats() == (1, 2, 200) and cat.refs() == {("bucket", "h"): 3}
    assert cat.register(record("one", "h", etag="new"))["bucket", "one"] == "same"
    assert cat.refs() == {("bucket", "h"): 3}
    assert cat.register(record("one", "other"))["bucket", "one"] == "move"
    assert cat.refs() == {("bucket", "h"): 2, ("bucket", "other"): 1}


def test_content_change_keeps_dead_blob(cat):
    cat.register(record("one", "h"))
    cat.register(record("one", "new"))
    assert cat.refs() == {("bucket", "h"): 0, ("bucket", "new"): 1} and cat.stats() == (1, 0, 0)
    assert [r["hash"] for r in catalog.unreferenced(cat.blobs, "bucket").collect()] == ["h"]
    left = catalog.delete_blobs(cat.blobs, cat.blobs)  # a blob that something names is not deleted
    assert [r["hash"] for r in left.collect()] == ["new"]


def test_blobs_are_per_bucket(cat):
    cat.register(record("one", "h", "a"), record("one", "h", "b"), record("two", "h", "c", blob_bucket="a"))
    assert cat.refs() == {("a", "h"): 2, ("b", "h"): 1} and cat.stats() == (2, 1, 100)


def test_move_between_blob_buckets(cat):
    cat.register(record("one", "h", "source", blob_bucket="a"), record("two", "h", "source", blob_bucket="a"))
    cat.register(record("three", "h", "source", blob_bucket="b"))
    assert cat.register(record("two", "h", "source", blob_bucket="b"))["source", "two"] == "move"
    assert cat.refs() == {("a", "h"): 1, ("b", "h"): 2}


def test_conflicts(cat):
    got = cat.register(record("a", "h", size=10), record("b", "h", size=11), record("c", "h", size=10, blob_key="elsewhere/h"))
    assert got == {("bucket", "a"): "insert", ("bucket", "b"): "blob size mismatch", ("bucket", "c"): "blob key mismatch"}
    assert cat.register(record("0", "h", size=11))["bucket", "0"] == "blob size mismatch"  # the stored blob holds
    assert cat.register(record("a", "h", size=99))["bucket", "a"] == "same"


def test_invalid_records(cat):
    bad = [record("k", "h", blob_bucket=""), record("k", "h", bucket="", blob_bucket="x"), record("", "h"), record("k", ""), record("k", "h", size=-1)]
    errors = [list(cat.register(r).values())[0] for r in bad]
    assert errors == ["blob bucket is empty", "bucket is empty", "key is empty", "hash is empty", "blob size is negative"] and cat.stats() == (0, 0, 0)


def test_unregister(cat, spark):
    cat.register(record("one", "h"), record("two", "h"))
    keys = spark.createDataFrame([("bucket", "one"), ("bucket", "missing")], "bucket string, object_key string")
    cat.drop(catalog.unregister(cat.objects, keys))
    assert cat.refs() == {("bucket", "h"): 1}


def test_mark_seen_and_finalize(cat, spark):
    cat.register(record("docs/a", "h"), record("docs/b", "h"), record("other/c", "h"), record("docs/d", "x", bucket="second"))
    seen = spark.createDataFrame([("bucket", "docs/a"), ("bucket", "none")], "bucket string, object_key string")
    marked = cat.pin(catalog.mark_seen(cat.objects, seen, "scan-2"), OBJECTS)
    assert {r["object_key"] for r in filters.stale(marked, [("bucket", "docs/")], "scan-2").collect()} == {"docs/b"}
    gone = filters.missing_from(cat.objects, seen, [("bucket", "docs/")])
    assert [tuple(r) for r in stats.stale_by_blob(gone).collect()] == [("bucket", "h", 1)]
    assert {r["object_key"] for r in filters.stale(marked, [("bucket", "")], "scan-2").collect()} == {"docs/b", "other/c"}


def test_filters(spark, cat):
    cat.register(record("p/same", "h"), record("p/etag", "h"))
    rows = [("bucket", "p/same", "etag", 100, WHEN, ""), ("bucket", "p/etag", "changed", 100, WHEN, ""), ("bucket", "blobs/h", "e", 9, WHEN, ""), ("bucket", "p/small", "e", 99, WHEN, None), ("bucket", "p/point", "e", 5, WHEN, ".json+pointer")]
    listing = spark.createDataFrame(rows, LISTING)
    keys = lambda df: sorted(r["object_key"] for r in df.collect())
    assert keys(filters.unchanged(listing, cat.objects)) == ["p/same"]
    assert keys(filters.to_process(listing.where(filters.outside_blob_prefix("blobs/")), cat.objects)) == ["p/etag", "p/point", "p/small"]
    assert keys(listing.where(filters.too_small(100))) == ["blobs/h", "p/small"]
    assert keys(filters.filter_scopes(listing, [("bucket", ""), ("bucket", "p/s")])) == sorted([r[1] for r in rows] + ["p/same", "p/small"])
    with pytest.raises(ValueError):
        filters.outside_blob_prefix("")
    with pytest.raises(ValueError):
        filters.filter_scopes(listing, [])


def test_collection_plan(spark):
    blobs = spark.createDataFrame([("a", "k1", "1", 5, 0, True), ("a", "k2", "2", 5, 1, True), ("a", "k3", "3", 5, 0, False), ("b", "k4", "4", 5, 0, True), ("a", "twice", "5", 5, 0, True), ("a", "twice", "6", 5, 0, True)], BLOBS)
    plan = {(r["hash"], r["error"]) for r in relink.plan_collection(blobs, ["a", "a"]).collect()}
    assert plan == {("1", None), ("5", "duplicate blob key"), ("6", "duplicate blob key")}
