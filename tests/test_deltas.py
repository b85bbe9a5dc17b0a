"""The catalog of base and deltas: equal to rewriting it whole, small writes, joins on its buckets, and two writers."""

import os
import random
from collections import Counter
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import catalog, changes, filters, stats
from lodestrata.plans.inventory import draft_inventory, scan_inventory
from lodestrata.schemas import KEY, LISTING, OBJECTS
from lodestrata.sources.state import Conflict, StateStore, Version

WHEN = datetime(2026, 3, 1, tzinfo=timezone.utc)
META = {"blob_prefix": "blobs/", "hash_algo": "sha256"}
INVENTORY = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in LISTING.fields) + ", hash string"


def inventory(spark, rows):
    """(bucket, key, hash) rows; an object's size follows from its hash."""
    return spark.createDataFrame([(b, k, f"e{h}", size_of(h), WHEN, "", h) for b, k, h in rows], INVENTORY)


def size_of(h):
    return 10 + sum(map(ord, h)) % 90


def recounted(rows):
    """bucket -> totals of (bucket, key, hash) rows."""
    n = Counter((b, h) for b, _, h in rows)
    out = {}
    for (b, h), c in n.items():
        t = out.setdefault(b, [0, 0, 0])
        t[0], t[1], t[2] = t[0] + 1, t[1] + c - 1, t[2] + (c - 1) * size_of(h)
    return out


def check(snap, rows, seen_hashes=()):
    assert {(r["bucket"], r["object_key"], r["blob_hash"]) for r in snap.objects.collect()} == set(rows)
    counts = Counter((b, h) for b, _, h in rows)
    blobs = {(r["bucket"], r["hash"]): r["ref_count"] for r in snap.blobs.collect()}
    assert {k: n for k, n in blobs.items() if n} == counts and set(seen_hashes) <= blobs.keys()
    assert {b: t for b, t in snap.at.totals.items() if any(t)} == recounted(rows)


def test_fifty_random_epochs_equal_recounting(spark):
    """Signed changes of references and of the statistics, epoch by epoch, against counting the objects."""
    rnd, objects, blobs, totals, log = random.Random(9), {}, {}, {}, []
    schema = "bucket string, object_key string, blob_bucket string, blob_hash string, old struct<bucket: string, hash: string>"
    for epoch in range(1, 51):
        keys = {(rnd.choice("ab"), f"k{rnd.randrange(25)}") for _ in range(rnd.randrange(1, 12))}
        moved = []
        for b, k in sorted(keys):
            old, new = objects.get((b, k)), None if rnd.random() < 0.3 else f"h{min(int(rnd.expovariate(0.4)), 9)}"
            if old or new:
                moved.append((b, k, b if new else None, new, (b, old) if old else None))
            objects.pop((b, k), None)
            if new:
                objects[b, k] = new
        accepted = spark.createDataFrame([(b, k, f"blobs/{h}", size_of(h), h) for b, k, _, h, _ in moved if h], "blob_bucket string, object_key string, blob_key string, blob_size bigint, hash string")
        known = spark.createDataFrame([(b, h, (f"blobs/{h}", size_of(h), n, False)) for (b, h), n in blobs.items()], "bucket string, hash string, blob struct<blob_key: string, size: bigint, ref_count: bigint, stored: boolean>")
        none = spark.createDataFrame([], "bucket string, hash string")
        touched = changes.blob_changes(changes.reference_changes(spark.createDataFrame(moved, schema)), accepted, none, lambda rows: rows.join(known, ["bucket", "hash"], "left"), epoch)  # noqa: B023
        found = touched.collect()
        log += [tuple(r) for r in found]
        for r in found:
            assert r["n_before"] == blobs.get((r["bucket"], r["hash"]), 0)
            n = blobs[r["bucket"], r["hash"]] = r["n_before"] + r["change"]
            t = totals.setdefault(r["bucket"], [0, 0, 0])
            more = max(n - 1, 0) - max(r["n_before"] - 1, 0)
            for i, d in enumerate(((n > 0) - (r["n_before"] > 0), more, more * r["size"])):
                t[i] += d
        if epoch % 10 == 0:
            moves = {r["bucket"]: [r[c] for c in changes.TOTALS] for r in changes.total_changes(spark.createDataFrame(log, touched.schema)).collect()}
            rows = [(b, k, h) for (b, k), h in objects.items()]
            assert {b: t for b, t in totals.items() if any(t)} == recounted(rows) == {b: t for b, t in moves.items() if any(t)}
            assert {k: n for k, n in blobs.items() if n} == Counter((b, h) for b, _, h in rows)


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_random_epochs_through_the_store(spark, tmp_path, small):
    """Whole scopes, objects that come, go, change and shrink; bases are written when deltas grow, or never."""
    state, rnd, rows, hashes = StateStore(spark, str(tmp_path), small=small), random.Random(small + 1), {}, set()
    for epoch in range(5):
        for _ in range(15):
            k = rnd.choice("ab"), f"k{rnd.randrange(30)}"
            if rnd.random() < 0.3:
                rows.pop(k, None)
            else:
                rows[k] = f"h{rnd.randrange(12)}"
        now = [(b, k, h) for (b, k), h in rows.items()]
        snap = scan_inventory(state, inventory(spark, now), [("a", ""), ("b", "")], f"scan-{epoch}", min_size=20)
        kept = [(b, k, h) for b, k, h in now if size_of(h) >= 20]
        hashes |= {(b, h) for b, _, h in kept}
        check(snap, kept, hashes)
        check(state.load(), kept, hashes)
        assert {r[0] for r in snap.objects.select("last_seen_scan").distinct().collect()} <= {f"scan-{epoch}"}
        assert catalog.broken_invariants(snap.objects, snap.blobs).isEmpty()
        assert {n: v for n, v in zip(changes.TOTALS, stats.stats(snap.objects, snap.blobs).first())} == snap.totals
    assert (snap.at.base is not None) == (small == 0)


def test_merges_equal_the_whole_rewrite(spark, tmp_path):
    """The catalog's transitions over whole snapshots give the same objects and blobs."""
    state = StateStore(spark, str(tmp_path), small=0)
    first = inventory(spark, [("b", f"k{i}", f"h{i % 7}") for i in range(40)])
    second = inventory(spark, [("b", f"k{i}", f"h{i % (5 if i % 3 else 9)}") for i in range(10, 50)])
    before = scan_inventory(state, first, [("b", "")], "scan-1")
    objects, blobs = before.objects, before.blobs
    after = scan_inventory(state, second, [("b", "")], "scan-2")
    made = {"blob_bucket": F.col("bucket"), "blob_key": F.concat(F.lit("blobs/"), "hash"), "blob_size": F.col("size"), "last_seen_scan": F.lit("scan-2"), "is_pointer": F.lit(False), "hash_algo": F.lit("sha256")}
    records = filters.to_process(second, objects).withColumns(made)
    whole = catalog.register(catalog.mark_seen(objects, second, "scan-2"), records)
    whole = whole.join(filters.stale(whole, [("b", "")], "scan-2").select(KEY), KEY, "left_anti")
    assert sorted(map(tuple, whole.select(OBJECTS.fieldNames()).collect())) == sorted(map(tuple, after.objects.select(OBJECTS.fieldNames()).collect()))
    assert sorted(map(tuple, catalog.refresh_blobs(blobs, whole, records).collect())) == sorted(map(tuple, after.blobs.collect()))


def test_a_scan_with_one_percent_changes_writes_little(spark, tmp_path):
    state = StateStore(spark, str(tmp_path), small=0)
    rows = [("b", f"folder/{i * 7919 % 100_003:06d}/object", f"{i % 15_000:064x}") for i in range(20_000)]
    base = scan_inventory(state, inventory(spark, rows), [("b", "")], "scan-1").at.base
    changed = [(b, k, f"{i + 50_000:064x}" if i % 100 == 0 else h) for i, (b, k, h) in enumerate(rows)]
    snap = scan_inventory(state, inventory(spark, changed), [("b", "")], "scan-2")
    assert snap.at.base == base and state.bytes_of(snap.at.own) <= 0.05 * state.bytes_of(base["id"])
    assert snap.objects.where("last_seen_scan = 'scan-2'").count() == 20_000 and snap.at.totals == recounted(changed)


def exchanges_over(df, table):
    """Exchanges of the plan that have a scan of the table below them, before another join."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    at = [i for i, line in enumerate(lines) if "Scan parquet" in line and table in line]
    assert at
    found = 0
    for i in at:
        depth = len(lines[i]) - len(lines[i].lstrip(" :+-*"))
        for line in reversed(lines[:i]):
            d = len(line) - len(line.lstrip(" :+-*"))
            if d < depth:
                depth = d
                found += "Exchange" in line
                if "Join" in line:
                    break
    return found


def test_the_catalog_is_not_shuffled(spark, tmp_path):
    """Listing against catalog, objects that are gone, touched blobs: only the other side moves, also where nothing is small."""
    state = StateStore(spark, str(tmp_path / "state"), small=0)
    scan_inventory(state, inventory(spark, [("b", f"k{i}", f"h{i % 300}") for i in range(1000)]), [("b", "")], "scan-1")
    snap = scan_inventory(state, inventory(spark, [("b", f"k{i}", f"h{i % 299 if i < 20 else i % 300}") for i in range(1000)]), [("b", "")], "scan-2")
    assert snap.at.base and snap.at.deltas
    inventory(spark, [("b", f"k{i}", "x") for i in range(900)]).write.parquet(str(tmp_path / "listed"))
    listed = spark.read.parquet(str(tmp_path / "listed"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, rows, name in (
            (snap.lookup(listed), 900, "objects"),
            (snap.missing(listed, [("b", "")]), 100, "objects"),
            (snap.lookup_blobs(listed.select("bucket", F.concat(F.lit("h"), F.length("object_key")).alias("hash"))), 900, "blobs"),
            (snap.lookup(listed).where(~F.coalesce(filters.same_as("old"), F.lit(False))), 900, "objects"),
        ):
            assert len(df.collect()) == rows
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "Bucketed: true" in plan and exchanges_over(df, f"base_{snap.at.base['id'][5:]}_{name}") == 0, plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_two_scans_at_once(spark, tmp_path):
    """Scans of different scopes are both kept; of scans of the same objects one is, and the next one heals what the other missed."""
    state = StateStore(spark, str(tmp_path), keep=5, small=1 << 30)
    rows = [("a", f"k{i}", f"h{i % 3}") for i in range(9)] + [("b", f"k{i}", f"h{i % 4}") for i in range(9)]
    scan_inventory(state, inventory(spark, rows), [("a", ""), ("b", "")], "scan-0")
    in_a = [(b, k, "new" if k == "k1" else h) for b, k, h in rows]
    in_b = [(b, k, h) for b, k, h in rows if (b, k) != ("b", "k2")] + [("b", "k9", "h9")]
    other = StateStore(spark, str(tmp_path), keep=5, small=1 << 30)
    draft = lambda s, r, bucket: draft_inventory(s, inventory(spark, r), [(bucket, "")], "scan", "blobs/", 0)
    one, two, three = draft(state, in_a, "a"), draft(other, in_b, "b"), draft(other, in_a, "a")
    assert state.commit(one, META).version == 2 and other.commit(two, META).version == 3
    both = [r for r in in_a if r[0] == "a"] + [r for r in in_b if r[0] == "b"]
    check(state.load(), both)
    with pytest.raises(Conflict):
        other.commit(three, META)
    check(other.load(), both)
    check(scan_inventory(other, inventory(spark, both), [("a", ""), ("b", "")], "scan-9"), both)


def test_shared_blobs_of_two_scans(spark, tmp_path):
    """Counts are signed, so both scans may name one blob; they must not remove one that the other names."""
    state = StateStore(spark, str(tmp_path), keep=9, small=0)
    scan_inventory(state, inventory(spark, [("b", "x/1", "old"), ("b", "y/1", "h")]), [("b", "")], "scan-0")
    draft = lambda rows, prefix: draft_inventory(state, inventory(spark, rows), [("b", prefix)], "scan", "blobs/", 0)
    one, two = draft([("b", "x/1", "h"), ("b", "x/2", "h")], "x/"), draft([("b", "y/1", "h"), ("b", "y/2", "h"), ("b", "y/3", "h")], "y/")
    state.commit(one, META)
    check(state.commit(two, META), [("b", f"{k}", "h") for k in ("x/1", "x/2", "y/1", "y/2", "y/3")])
    gone, back = state.draft(state.load()), draft([("b", "x/1", "old"), ("b", "x/2", "h")], "x/")
    empty = spark.createDataFrame([], changes.OBJECT_CHANGES)
    gone.write(empty, spark.createDataFrame([], changes.BLOB_CHANGES).withColumn("n_before", F.lit(0).cast("long")))
    gone.remove_blobs(spark.createDataFrame([("b", "old")], "bucket string, hash string"))
    state.commit(gone, META)
    assert "old" not in {r["hash"] for r in state.load().blobs.collect()}
    with pytest.raises(Conflict):
        state.commit(back, META)


def test_scopes_that_were_seen(spark, tmp_path):
    """Only scopes that were listed whole are seen again."""
    state = StateStore(spark, str(tmp_path), small=0)
    rows = [("b", "x/1", "h"), ("b", "y/1", "h"), ("c", "x/1", "h")]
    scan_inventory(state, inventory(spark, rows), [("b", ""), ("c", "")], "scan-1")
    snap = scan_inventory(state, inventory(spark, rows), [("b", "x/")], "scan-2")
    assert {(r["bucket"], r["object_key"]): r["last_seen_scan"] for r in snap.objects.collect()} == {("b", "x/1"): "scan-2", ("b", "y/1"): "scan-1", ("c", "x/1"): "scan-1"}


def test_thousands_of_scopes_that_were_seen(spark, tmp_path):
    state = StateStore(spark, str(tmp_path), small=0)
    rows = [("b", f"{i}/1", "h") for i in range(300)]
    scan_inventory(state, inventory(spark, rows), [("b", "")], "scan-1")
    some = [("b", f"{i}/") for i in range(100, 300)] + [("b", "10")]
    snap = scan_inventory(state, inventory(spark, [r for r in rows if r[1] != "150/1"]), some, "scan-2")
    found = {r["object_key"]: r["last_seen_scan"] for r in snap.objects.collect()}
    assert found == {k: "scan-2" if int(k[:-2]) >= 100 or k.startswith("10") else "scan-1" for _, k, _ in rows if k != "150/1"}


def test_a_marker_is_never_replaced(spark, tmp_path):
    state = StateStore(spark, str(tmp_path))
    assert state._put_if_absent("CURRENT-1", b"one") and not state._put_if_absent("CURRENT-1", b"two")
    assert (tmp_path / "CURRENT-1").read_bytes() == b"one" and not [n for n in os.listdir(tmp_path) if n.startswith("_")]
    assert state._head() == Version()  # and one that cannot be read is none


def test_what_old_versions_name_is_removed(spark, tmp_path):
    state = StateStore(spark, str(tmp_path), keep=1, small=0, compacted=0)
    for i in range(3):
        snap = scan_inventory(state, inventory(spark, [("b", "k", f"h{i}")]), [("b", "")], f"scan-{i}")
    left = {n for n in os.listdir(tmp_path) if not n.startswith((".", "_"))}
    assert left == {"CURRENT-3", snap.at.base["id"], snap.at.own}
    check(state.load(), [("b", "k", "h2")])
