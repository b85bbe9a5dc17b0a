import io
import os
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from faulty import Faulty

from lodestrata.config import Bucket, Config
from lodestrata.functions.pointers import dump_pointer
from lodestrata.operators import actions
from lodestrata.plans.scan import ScanError, scan_once
from lodestrata.schemas import POINTER_TYPE
from lodestrata.session import shared_folder
from lodestrata.sources.objectstore import FileStore, NoSuchKey
from lodestrata.sources.rows import in_flight
from lodestrata.sources.state import StateStore


class World:
    def __init__(self, spark, path, mode="report_only", buckets=("bucket",), **dedup):
        self.spark, self.root = spark, str(path / "store")
        self.store = FileStore(self.root)
        for b in buckets:
            self.store.create_bucket(b)
        self.state = StateStore(spark, str(path / "state"))
        self.config = Config()
        self.config.s3.buckets = [Bucket(b, "") for b in buckets]
        self.config.dedup.mode = mode
        for k, v in dedup.items():
            setattr(self.config.dedup, k, v)

    def put(self, key, body, bucket="bucket", content_type="text/plain"):
        data = body.encode() if isinstance(body, str) else body
        self.store.put(bucket, key, io.BytesIO(data), len(data), content_type)

    def read(self, key, bucket="bucket"):
        with self.store.get(bucket, key) as f:
            return f.read().decode()

    def keys(self, bucket="bucket"):
        return sorted(o.key for o in self.store.list(bucket, ""))

    def scan(self, store=None):
        return scan_once(self.spark, store or self.store, self.state, self.config)

    def refs(self):
        return {(r["bucket"], r["hash"][:4]): r["ref_count"] for r in self.state.load().blobs.collect()}


def take(report, *names):
    return tuple(report[n] for n in names)


def test_report_only(spark, tmp_path):
    w = World(spark, tmp_path)
    w.put("one.txt", "duplicate"), w.put("two.txt", "duplicate"), w.put("empty", ""), w.put(".hidden", "x"), w.put("_a/b c/é", "x")
    r = w.scan()
    assert take(r, "objects_scanned", "unique_blobs", "duplicates_found", "bytes_reclaimable", "errors", "bytes_reclaimed") == (5, 3, 2, 10, 0, 0)
    again = w.scan(Faulty(w.root, get=["one.txt", "two.txt"]))  # nothing changed, so nothing is read
    assert take(again, "objects_scanned", "unique_blobs", "errors") == (5, 3, 0)
    w.put("one.txt", "changed!"), w.store.remove("bucket", ["empty"])
    third = w.scan()
    assert take(third, "objects_scanned", "unique_blobs", "duplicates_found") == (4, 3, 1)
    assert sorted(w.refs().values()) == [0, 1, 1, 2] and third["scan_finished"] >= third["scan_started"] > datetime(2026, 1, 1, tzinfo=timezone.utc)


def test_read_errors_keep_old_rows(spark, tmp_path):
    w = World(spark, tmp_path)
    for i in range(20):
        w.put(f"f{i}", f"content {i}")
    r = w.scan(Faulty(w.root, get=["f3"], stat=[]))
    assert take(r, "objects_scanned", "unique_blobs", "errors") == (20, 19, 1)
    assert w.scan()["unique_blobs"] == 20
    w.put("f3", "newer")
    r = w.scan(Faulty(w.root, get=["f3"]))
    assert take(r, "unique_blobs", "errors") == (20, 1)


def test_min_size_and_scopes(spark, tmp_path):
    w = World(spark, tmp_path, min_size_bytes=4)
    w.config.s3.buckets = [Bucket("bucket", "in/"), Bucket("bucket", "in/deep/")]
    w.put("in/small", "abc"), w.put("in/at", "abcd"), w.put("in/deep/x", "abcde"), w.put("out/y", "abcdef"), w.put("blobs/z", "zzzzzz")
    assert take(w.scan(), "objects_scanned", "unique_blobs") == (3, 2)  # the deep one is in two scopes
    w.put("in/at", "ab")
    assert take(w.scan(), "objects_scanned", "unique_blobs") == (2, 1)


def test_pointer_mode_relinks_and_settles(spark, tmp_path):
    w = World(spark, tmp_path, "pointer", delete_originals=True)
    body = "body " * 100
    w.put("a", body), w.put("b", body), w.put("c", "other " * 100)
    r = w.scan()
    size = w.store.stat("bucket", "b").size
    assert take(r, "objects_relinked", "unique_blobs", "duplicates_found", "bytes_reclaimable", "errors") == (3, 2, 1, 500, 0)
    assert r["bytes_reclaimed"] == 500 - size and w.store.stat("bucket", "a").content_type == POINTER_TYPE
    assert len(w.keys()) == 5 and w.read([k for k in w.keys() if k.startswith("blobs/230d") or k.startswith("blobs/")][0]) in (body, "other " * 100)
    again = w.scan(Faulty(w.root, put=[""]))
    assert take(again, "objects_relinked", "bytes_reclaimed", "unique_blobs", "duplicates_found", "bytes_reclaimable", "errors") == (0, 0, 2, 1, 500, 0)
    # a small pointer is no small object: its blob must live
    w.config.dedup.min_size_bytes = 10_000
    r = w.scan()
    assert r["unique_blobs"] == 2 and len(w.keys()) == 5
    # a fresh catalog is rebuilt from the pointers
    w.state = StateStore(spark, str(tmp_path / "state2"))
    w.config.dedup.min_size_bytes = 0
    assert take(w.scan(Faulty(w.root, put=[""])), "unique_blobs", "duplicates_found", "bytes_reclaimable", "errors") == (2, 1, 500, 0)


def test_garbage_collection(spark, tmp_path):
    w = World(spark, tmp_path, "pointer", delete_originals=True)
    w.put("a", "first " * 50), w.put("b", "second " * 50)
    w.scan()
    w.store.remove("bucket", ["a"])
    blob = [k for k in w.keys() if k.startswith("blobs/") and w.read(k).startswith("first")]
    w.put("bad", "unreadable")
    r = w.scan(Faulty(w.root, get=["bad"]))  # errors keep the collector away
    assert r["errors"] == 1 and blob[0] in w.keys()
    w.store.remove("bucket", ["bad"])
    r = w.scan(Faulty(w.root, undeletable=blob))
    assert take(r, "errors", "bytes_reclaimed") == (1, 0) and blob[0] in w.keys()
    r = w.scan()
    assert take(r, "errors", "bytes_reclaimed", "bytes_reclaimable", "unique_blobs") == (0, 300, 300, 1) and blob[0] not in w.keys()
    assert take(w.scan(), "errors", "bytes_reclaimed") == (0, 0)


def collecting(spark, tmp_path):
    """A world whose blob of `a` is marked, the epoch for which it stays being over."""
    w = World(spark, tmp_path, "pointer", delete_originals=True, collect_after=1)
    w.put("a", "first " * 50), w.put("b", "second " * 50)
    w.scan()
    (blob,) = [k for k in w.keys() if k.startswith("blobs/") and w.read(k).startswith("first")]
    w.store.remove("bucket", ["a"])
    r = w.scan()
    assert take(r, "errors", "bytes_reclaimed") == (0, 0) and blob in w.keys()
    assert [x["since"] for x in w.state.load().marks.collect()] == [2]
    return w, blob


def test_marked_blobs_go_an_epoch_later(spark, tmp_path):
    w, blob = collecting(spark, tmp_path)
    r = w.scan(Faulty(w.root, undeletable=[blob]))  # out of the catalog, but still in storage: the sweep stays open
    assert take(r, "errors", "bytes_reclaimed", "unique_blobs") == (1, 0, 1) and blob in w.keys()
    at = w.state.load().at
    assert len(at.sweeps) == 1 and w.state.load().blobs.count() == 1
    r = w.scan()
    assert take(r, "errors", "bytes_reclaimed", "bytes_reclaimable") == (0, 300, 300) and blob not in w.keys()
    assert take(w.scan(), "errors", "bytes_reclaimed") == (0, 0) and not w.state.load().at.sweeps and w.state.load().marks.count() == 0


@pytest.mark.parametrize("as_pointer", [False, True])
def test_marked_blobs_survive_if_named_again(spark, tmp_path, as_pointer):
    w, blob = collecting(spark, tmp_path)
    if as_pointer:
        w.put("again", dump_pointer({"blob_bucket": "bucket", "blob_key": blob, "hash": blob[6:], "size": 300, "content_type": ""}), content_type=POINTER_TYPE)
    else:
        w.put("again", "first " * 50)
    for _ in range(2):
        assert take(w.scan(), "errors", "unique_blobs") == (0, 2) and w.read(blob) == "first " * 50
    w.store.remove("bucket", ["again"])  # and its time begins anew
    assert w.scan()["bytes_reclaimed"] == 0 and blob in w.keys()
    assert w.scan()["bytes_reclaimed"] == 300 and blob not in w.keys()


def test_driver_lost_between_commit_and_delete(spark, tmp_path, monkeypatch):
    w, blob = collecting(spark, tmp_path)
    with monkeypatch.context() as m:
        m.setattr(actions, "delete_stored", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            w.scan()
    assert blob in w.keys() and len(w.state.load().at.sweeps) == 1
    w.put("again", "first " * 50)
    r = w.scan()  # ends the sweep; what has the content of a swept blob waits
    assert take(r, "errors", "bytes_reclaimed", "objects_relinked", "unique_blobs") == (0, 300, 0, 1)
    assert blob not in w.keys() and w.read("again") == "first " * 50 and not w.state.load().at.sweeps
    assert take(w.scan(), "errors", "objects_relinked", "unique_blobs") == (0, 1, 2) and w.read(blob) == "first " * 50


def test_driver_lost_between_delete_and_closing(spark, tmp_path, monkeypatch):
    w, blob = collecting(spark, tmp_path)
    commit = StateStore.commit
    with monkeypatch.context() as m:
        m.setattr(StateStore, "commit", lambda self, draft, *a, **k: commit(self, draft, *a, **k) if draft.written else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            w.scan()
    assert blob not in w.keys() and len(w.state.load().at.sweeps) == 1
    assert take(w.scan(), "errors", "bytes_reclaimed", "unique_blobs") == (0, 300, 1) and not w.state.load().at.sweeps


class Interrupted(StateStore):
    """Runs something once, before or after the first commit."""

    def __init__(self, *args, before=None, after=None):
        super().__init__(*args)
        self.run = [before, after]

    def commit(self, *args, **named):
        (before, after), self.run = self.run, [None, None]
        if before:
            before()
        done = super().commit(*args, **named)
        if after:
            after()
        return done


def test_blob_named_by_another_driver_before_the_sweep(spark, tmp_path):
    """It took the mark off first, so the sweep fails and nothing is deleted."""
    w, blob = collecting(spark, tmp_path)
    other = World(spark, tmp_path, "pointer", delete_originals=True, collect_after=1, buckets=())
    other.config.s3.buckets = w.config.s3.buckets

    def meanwhile():
        other.put("again", "first " * 50)
        assert take(other.scan(), "errors", "objects_relinked") == (0, 1)

    w.state = Interrupted(spark, str(tmp_path / "state"), before=meanwhile)
    with pytest.raises(ScanError, match="same blobs"):
        w.scan()
    assert w.read(blob) == "first " * 50 and w.store.stat("bucket", "again").content_type == POINTER_TYPE
    assert take(w.scan(), "errors", "bytes_reclaimed", "unique_blobs") == (0, 0, 2)


def test_blob_named_by_another_driver_after_the_sweep(spark, tmp_path):
    """It began before the sweep and cannot take the mark off, so it fails before it replaces anything."""
    w, blob = collecting(spark, tmp_path)
    other = World(spark, tmp_path, "pointer", delete_originals=True, collect_after=1, buckets=())
    other.config.s3.buckets = w.config.s3.buckets
    w.put("again", "first " * 50)

    def meanwhile():
        other.config.s3.buckets = [Bucket("bucket", "b")]  # the other one has not listed the new object
        assert other.scan()["errors"] == 0

    other.config.s3.buckets = [Bucket("bucket", "b")]
    rescue = StateStore.rescue

    class Late(StateStore):
        def rescue(self, named):
            meanwhile()
            rescue(self, named)

    w.state = Late(spark, str(tmp_path / "state"))
    with pytest.raises(ScanError, match="being collected"):
        w.scan()
    assert blob not in w.keys() and w.read("again") == "first " * 50
    w.state = StateStore(spark, str(tmp_path / "state"))
    assert take(w.scan(), "errors", "objects_relinked", "unique_blobs") == (0, 1, 2) and w.read(blob) == "first " * 50


def test_deletes_are_dealt(spark, tmp_path):
    """A task for each call, whatever the partitions of the plan, and no more at a time than workers."""
    w = World(spark, tmp_path)
    w.put("k7", "x")
    gone = spark.range(0, 2500, 1, 1).selectExpr("'bucket' AS bucket", "concat('k', id) AS blob_key", "'' AS hash", "1L AS size")
    for workers, tasks in ((4, 3), (2, 2)):
        found = actions.delete_stored(gone, w.store, workers).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("deleted").cast("int")).alias("deleted")).collect()
        assert len(found) == tasks and sum(r["n"] for r in found) == sum(r["deleted"] for r in found) == 2500
    assert w.keys() == []


def test_measured_blobs_are_not_collected(spark, tmp_path):
    w = World(spark, tmp_path)
    w.put("a", "only measured")
    w.scan()
    w.store.remove("bucket", ["a"])
    w.config.dedup.mode = "pointer"
    assert take(w.scan(), "bytes_reclaimed", "errors") == (0, 0)


def test_upload_failure_leaves_original(spark, tmp_path):
    w = World(spark, tmp_path, "pointer", delete_originals=True)
    w.put("a", "precious")
    r = w.scan(Faulty(w.root, put=["blobs/"]))
    assert take(r, "errors", "unique_blobs", "objects_relinked") == (1, 0, 0) and w.read("a") == "precious"
    assert take(w.scan(), "errors", "unique_blobs", "objects_relinked") == (0, 1, 1)


def test_change_during_scan(spark, tmp_path):
    w = World(spark, tmp_path, "pointer", delete_originals=True)
    w.put("a", "moving"), w.put("b", "still")
    r = w.scan(Faulty(w.root, changing=["a"]))
    assert w.read("a") == "moving" and take(r, "errors", "objects_relinked") == (0, 1)


def test_keep_originals(spark, tmp_path):
    w = World(spark, tmp_path, "pointer")
    w.put("a", "body"), w.put("b", "body")
    assert take(w.scan(), "objects_relinked", "bytes_reclaimed", "duplicates_found") == (0, 0, 1)
    assert w.read("a") == "body" and len(w.keys()) == 3


def test_existing_blob_of_other_size(spark, tmp_path):
    import hashlib

    w = World(spark, tmp_path, "pointer", delete_originals=True)
    w.put("a", "body"), w.put("blobs/" + hashlib.sha256(b"body").hexdigest(), "not the body")
    assert take(w.scan(), "errors", "unique_blobs") == (1, 0) and w.read("a") == "body"


def test_pointers_across_buckets_and_broken_ones(spark, tmp_path):
    w = World(spark, tmp_path, "pointer", buckets=("one", "two"))
    w.put("blobs/h", "stored", "one")
    good = {"blob_bucket": "one", "blob_key": "blobs/h", "hash": "h", "size": 6}
    for key, change in {"good": {}, "size": {"size": 7}, "key": {"blob_key": "else/h"}, "gone": {"hash": "x", "blob_key": "blobs/x"}}.items():
        w.put(key, dump_pointer(good | change), "two", POINTER_TYPE)
    w.put("junk", "{}", "two", POINTER_TYPE)
    r = w.scan()
    assert take(r, "objects_scanned", "errors", "unique_blobs") == (5, 4, 1) and w.refs() == {("one", "h"): 1}


def test_listing_failure(spark, tmp_path):
    w = World(spark, tmp_path, buckets=("a", "b", "c"))
    for b in "abc":
        w.put("k", b, b)
    assert w.scan()["unique_blobs"] == 3
    for b in "abc":
        w.store.remove(b, ["k"])
    with pytest.raises(ScanError) as e:
        w.scan(Faulty(w.root, listing=["b"]))
    assert e.value.report["errors"] == 1
    assert {r["bucket"] for r in w.state.load().objects.collect()} == {"b", "c"}  # only the scope before it is final


def test_algorithm_and_prefix_changes(spark, tmp_path):
    w = World(spark, tmp_path)
    w.put("a", "body")
    w.scan()
    w.config.dedup.hash_algo = "sha512"
    w.scan()
    assert {len(r["blob_hash"]) for r in w.state.load().objects.collect()} == {128}
    w.config.dedup.blob_prefix = "moved/"
    with pytest.raises(ScanError):
        w.scan()


def test_versions_and_empty_buckets(spark, tmp_path):
    w = World(spark, tmp_path)
    for _ in range(4):
        assert take(w.scan(), "objects_scanned", "unique_blobs", "errors") == (0, 0, 0)
    names = os.listdir(tmp_path / "state")
    assert w.state.load().version == 4 and sorted(n for n in names if n.startswith("CURRENT")) == ["CURRENT-3", "CURRENT-4"]
    assert not any(n.startswith("_") for n in names)
    with pytest.raises(NoSuchKey):
        w.store.stat("bucket", "none")


def test_bodies_are_dealt_by_bytes_and_number(spark):
    gb = 1 << 30
    assert actions.tasks_for(0, 0, 8, 8) == 1 and actions.tasks_for(5 * gb + 1, 5001, 4, 4) == 6 and actions.tasks_for(100, 5001, 4, 4) == 4 and actions.tasks_for(100, 500_000, 4, 4) == 250
    assert actions.tasks_for(3 * gb, 2, 8, 8) == 2 and actions.tasks_for(500 * gb, 10_000, 2, 8) == 2
    assert [actions.worker_count(n, 4) for n in (None, -1, 0, 1, 8, 9)] == [4, 1, 1, 1, 8, 8]
    rows = [("b", f"k{i}", 6 * gb if i == 0 else 100) for i in range(3000)]
    work = spark.createDataFrame(rows, "bucket string, object_key string, size bigint").coalesce(1)
    dealt, threads = actions.deal(work, "size", 8)
    sizes = dealt.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()
    assert dealt.rdd.getNumPartitions() == len(sizes) == 8 and max(r["n"] for r in sizes) < 500 and threads == 2


def test_calls_in_flight_keep_order_and_errors():
    import threading
    import time

    seen, most, lock = [0], [0], threading.Lock()

    def one(x):
        with lock:
            seen[0] += 1
            most[0] = max(most[0], seen[0])
        time.sleep(0.002)
        with lock:
            seen[0] -= 1
        return -x

    assert list(in_flight(one, iter(range(50)), 4)) == [-x for x in range(50)] and 1 < most[0] <= 4
    with pytest.raises(ZeroDivisionError):
        list(in_flight(lambda x: 1 // x, iter([1, 0]), 2))


def test_a_pointer_that_is_too_long_is_not_read(spark, tmp_path):
    w = World(spark, tmp_path)
    w.put("a", "{" * (actions.POINTER_BYTES + 1), content_type=POINTER_TYPE)
    assert take(w.scan(), "objects_scanned", "errors", "unique_blobs") == (1, 1, 0)


def test_a_scan_that_dies_leaves_the_old_version(spark, tmp_path):
    w = World(spark, tmp_path)
    w.put("a", "one"), w.put("b", "two")
    w.scan()
    before = {tuple(r) for r in w.state.load().objects.collect()}
    w.put("a", "changed"), w.store.remove("bucket", ["b"])

    class Dies(StateStore):
        def commit(self, *_):
            raise RuntimeError("killed between the write and the flip")

    w.state = Dies(spark, str(tmp_path / "state"))
    with pytest.raises(RuntimeError):
        w.scan()
    w.state = StateStore(spark, str(tmp_path / "state"))
    for left in ("", '{"version": 2, "me'):  # and a marker that was cut off
        (tmp_path / "state" / "CURRENT-2").write_text(left)
        (tmp_path / "state" / ".CURRENT-2.crc").unlink(missing_ok=True)
        assert w.state.load().version == 1 and {tuple(r) for r in w.state.load().objects.collect()} == before
    assert take(w.scan(), "objects_scanned", "unique_blobs") == (1, 1) and w.state.load().version == 3  # the number is taken
    w.state.close()
    with pytest.raises(ValueError):
        w.state.load()


def test_no_local_folder_on_a_cluster():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        Session.sparkContext.master = master
        with pytest.raises(ValueError):
            shared_folder(Session)
    for master in ("local", "local[4]", "local[*]"):
        Session.sparkContext.master = master
        assert shared_folder(Session).startswith("file:///")
