import bisect
import contextlib
import hashlib
import io
import os
import random
import threading
from datetime import datetime, timezone

import fake_s3
import pytest
from pyspark import InheritableThread

from lodestrata.cli import Engine, main
from lodestrata.session import SCAN_TAG, tagged
from lodestrata.sources.listing import ListingSource, inventory, inventory_of_files, list_scopes
from lodestrata.sources import listing, objectstore
from lodestrata.sources.objectstore import FileStore, NoSuchKey, health_check, probed_cuts
from lodestrata.streaming.loop import Stopper, run_and_report, run_loop, scan_on_arrival


@pytest.fixture(params=["files", "s3"])
def store(request, tmp_path):
    if request.param == "s3":
        s = request.getfixturevalue("s3")
    else:
        s = FileStore(str(tmp_path / "store"))
        s.create_bucket("b")
    fill(s)
    return s


@pytest.fixture
def files(tmp_path):
    s = FileStore(str(tmp_path / "store"))
    s.create_bucket("b")
    fill(s)
    return s


def fill(s):
    for key in ("a", "a/b", "a/b/c", ".dot", "_low", "é" * 150, "empty"):
        body = b"" if key == "empty" else key.encode()
        assert s.put("b", key, io.BytesIO(body), len(body), "text/plain") == len(body)


KEYS = sorted(["a", "a/b", "a/b/c", ".dot", "_low", "é" * 150, "empty"])


def test_listing_in_parts(store):
    keys = [f"{d}/{i}" for d in "pqrst" for i in range(7)] + ["p0", "zz"]
    for key in keys:
        store.put("b", key, io.BytesIO(b"x"), 1, "")
    every = sorted(keys + KEYS)
    for most in (0, 1, 3, 50):
        cuts = store.cuts("b", "", most)
        assert len(cuts) <= most and cuts == sorted(cuts) and (most < 3 or len(cuts) >= 3)
        found = [[o.key for o in store.list("b", "", a, z)] for a, z in zip(["", *cuts], [*cuts, None])]
        assert sorted(k for part in found for k in part) == every
    assert store.cuts("b", "none", 5) == [] and [o.key for o in store.list("b", "p/", "p/4")] and {o.key for o in store.list("b", "p/", "p/4")} == {"p/5", "p/6"}


def test_puts_and_gets(store):
    for body in (b"first", b"", b"second, longer" * 100_000):
        assert store.put("b", "a b/+%&?#é", io.BytesIO(body), len(body), "text/x") == len(body)
        info = store.stat("b", "a b/+%&?#é")
        assert (info.size, info.content_type, info.key) == (len(body), "text/x", "a b/+%&?#é") and len(info.etag) == 32
        with store.get("b", info.key) as f:
            assert f.read(3) + f.read() == body
        listed = [o for o in store.list("b", "a b")]
        assert [(o.key, o.size, o.etag) for o in listed] == [(info.key, len(body), info.etag)]
    assert store.remove("b", [info.key]) == [info.key]
    for look in (store.stat, store.get):
        with pytest.raises(NoSuchKey):
            look("b", info.key)


def test_store(store):
    assert sorted(o.key for o in store.list("b", "")) == KEYS and [o.key for o in store.list("b", "a/b/")] == ["a/b/c"]
    assert store.stat("b", "empty").size == 0 and store.remove("b", ["a", "none"]) == ["a", "none"]
    assert sorted(o.key for o in store.list("b", "a")) == ["a/b", "a/b/c"]
    health_check(store, ["b"])
    for bad in ([], ["b", "other"]):
        with pytest.raises(ValueError):
            health_check(store, bad)


def keys_like(kind, n, rnd):
    names = {
        "flat": lambda i: f"key-{i:07d}",
        "folders": lambda i: f"{'abcde'[i % 5]}/{i % 97}/{i}",
        "hashes": lambda i: f"{rnd.getrandbits(128):032x}",
        "one long folder": lambda i: f"{'x' * 300}/{i}",
        "nested": lambda i: "n" * (i + 1),
        "odd": lambda i: "".join(rnd.choice("a\u00e9/\U0001f600\uffff\x01 ") for _ in range(6)) + str(i),
        "hot": lambda i: f"hot/{i}" if i % 20 else f"{i}",
    }
    return sorted({names[kind](i) for i in range(n)})


@pytest.mark.parametrize("kind", ["flat", "folders", "hashes", "one long folder", "nested", "odd", "hot"])
def test_cuts_by_probing(kind):
    """Few asks, and parts of which none holds nearly all."""
    rnd = random.Random(kind)
    keys = keys_like(kind, 300 if kind == "nested" else 20_000, rnd)
    for most, after, until in ((31, "", None), (7, keys[len(keys) // 3], keys[-5]), (1, "", None), (0, "", None), (31, keys[-1], None), (31, keys[4], keys[5])):
        asks = []

        def first(place):
            asks.append(place)
            at = bisect.bisect_right(keys, place)
            return keys[at] if at < len(keys) else None

        cuts = probed_cuts(first, most, after, until)
        inside = [k for k in keys if k > after and (until is None or k <= until)]
        parts = [[k for k in inside if k > a and (z is None or k <= z)] for a, z in zip([after, *cuts], [*cuts, until])]
        assert cuts == sorted(cuts) and len(cuts) <= most and len(asks) <= 8 * (most + 1) + 2 and [k for p in parts for k in p] == inside
        if most == 31 and len(inside) > 1000:
            assert len(cuts) >= 15 and max(map(len, parts)) <= 0.7 * len(inside), [len(p) for p in parts]


def test_a_flat_bucket_is_listed_by_many_tasks(spark, s3, monkeypatch):
    monkeypatch.setattr(listing, "FIRST_KEYS", 500)
    monkeypatch.setattr(listing, "RANGE_KEYS", 900)
    monkeypatch.setattr(fake_s3, "PAGE", 100)
    objects = fake_s3.serve.server.buckets["b"]
    objects.update({f"key-{i:07d}": (b"x", "", datetime.now(timezone.utc)) for i in range(20_000)})
    rows = list_scopes(spark, s3, [("b", "")]).select("object_key", "error").collect()
    assert sorted(r["object_key"] for r in rows) == sorted(objects) and not any(r["error"] for r in rows)
    pages = [p for p in fake_s3.serve.server.pages if p[0] is None]
    probes = len(fake_s3.serve.server.pages) - len(pages)
    assert len(pages) <= 200 + 1.5 * 20 * 5 and probes <= 8 * 32 * 8  # hardly more pages than one listing, few asks
    assert len([p for p in pages if p[2] and not p[2].startswith("key-0000")]) > 0


def test_a_failure_in_one_of_many_ranges(spark, files, monkeypatch):
    """Its scope has failed, whatever the other ranges give."""
    monkeypatch.setattr(listing, "FIRST_KEYS", 3)
    monkeypatch.setattr(listing, "RANGE_KEYS", 2)
    for i in range(40):
        files.put("b", f"n/{i:02d}", io.BytesIO(b"x"), 1, "")

    rows = list_scopes(spark, Breaks(files.root), [("b", "n/"), ("b", "a/")]).collect()
    assert {r["scope"] for r in rows if r["error"]} == {0} and 3 < sum(r["scope"] == 0 and not r["error"] for r in rows) < 40
    assert sorted(r["object_key"] for r in rows if r["scope"] == 1) == ["a/b", "a/b/c"]
    whole = list_scopes(spark, files, [("b", "n/"), ("b", "")], parts=4).collect()
    assert [r["object_key"] for r in whole if r["scope"] == 0 and r["error"] is None] and len(whole) == 40 + 40 + len(KEYS)


class Breaks(FileStore):
    def list(self, bucket, prefix, after="", until=None):
        for o in super().list(bucket, prefix, after, until):
            if o.key == "n/17":
                raise OSError("a page is missing")
            yield o


def test_a_listing_reads_the_folders_that_it_meets(tmp_path, monkeypatch):
    """The names that all ranges together read grow as the keys, not as the keys times the ranges."""
    s, read, of = FileStore(str(tmp_path)), [0], os.listdir
    s.create_bucket("b")
    keys = sorted([f"{d}/{e}/{i}" for d in "pq" for e in range(20) for i in range(10)] + [f"blobs/{hashlib.sha256(str(i).encode()).hexdigest()}" for i in range(400)])
    for key in keys:
        s.put("b", key, io.BytesIO(b"x"), 1, "")

    def counting(call):
        def run(path):
            read[0] += len(of(path))
            return call(path)

        return run

    monkeypatch.setattr(os, "listdir", counting(os.listdir))
    monkeypatch.setattr(os, "scandir", counting(os.scandir))
    cuts = s.cuts("b", "", 31)
    assert len(cuts) == 31 and [o.key for a, z in zip(["", *cuts], [*cuts, None]) for o in s.list("b", "", a, z)] == keys
    assert read[0] < 8 * len(keys)
    read[0] = 0
    assert len(list(s.list("b", "p/3/"))) == 10 and read[0] < 60


def test_cuts_do_not_read_a_long_level(tmp_path, monkeypatch):
    """One task looks for them, so it must not read all names where folders are enough to cut between."""
    s, read, of = FileStore(str(tmp_path)), [0], os.listdir
    s.create_bucket("b")
    keys = sorted(f"{d}/{e:02d}/{i}" for d in "pq" for e in range(20) for i in range(50))
    for key in keys:
        s.put("b", key, io.BytesIO(b"x"), 1, "")

    def counting(path):
        read[0] += len(of(path))
        return of(path)

    monkeypatch.setattr(os, "listdir", counting)
    monkeypatch.setattr(objectstore, "CUT_NAMES", 100)
    cuts = s.cuts("b", "", 31)
    assert read[0] < 300 and len(cuts) == 31
    parts = [[o.key for o in s.list("b", "", a, z)] for a, z in zip(["", *cuts], [*cuts, None])]
    assert [k for part in parts for k in part] == keys and max(map(len, parts)) <= 100
    assert len(s.cuts("b", "p/03/", 7)) == 7  # a folder that holds all keys is read


def test_listings_of_files_are_in_order(tmp_path):
    """Of long names, that stand in folders of their own, short ones beside them, and cut-off characters."""
    rnd, s = random.Random(5), FileStore(str(tmp_path))
    s.create_bucket("b")
    keys = sorted({"".join(rnd.choice("a/é\U0001f600-.%bbb") for _ in range(rnd.choice([0, 1, 2, 5, 31, 33, 70]))) for _ in range(300)} | {"x" * 300 + f"/{i}" for i in range(3)})
    for key in keys:
        s.put("b", key, io.BytesIO(b"x"), 1, "")
    for _ in range(60):
        prefix, after, until = rnd.choice(keys)[: rnd.randint(0, 3)], rnd.choice(keys)[: rnd.randint(0, 40)], rnd.choice([None, rnd.choice(keys)])
        wanted = [k for k in keys if k.startswith(prefix) and k > after and (until is None or k <= until)]
        cuts = s.cuts("b", prefix, 7, after, until)
        assert [o.key for o in s.list("b", prefix, after, until)] == wanted and len(cuts) <= 7
        assert [o.key for a, z in zip([after, *cuts], [*cuts, until]) for o in s.list("b", prefix, a, z)] == wanted


def test_copies_share_their_body(tmp_path):
    """And keep it when the original is replaced or removed."""
    s, body = FileStore(str(tmp_path)), os.urandom(1 << 20)
    s.create_bucket("b")
    s.put("b", "a", io.BytesIO(body), len(body), "x")
    s.copy("b", "a", "blobs/" + "0" * 64, s.stat("b", "a").etag, len(body), "x")
    files = {os.stat(p).st_ino: os.stat(p).st_size for d, _, names in os.walk(tmp_path) for n in names for p in [os.path.join(d, n)]}
    assert sum(files.values()) < 1.1 * len(body)
    s.put("b", "a", io.BytesIO(b"pointer"), 7, "y")
    s.remove("b", ["a"])
    assert s.stat("b", "blobs/" + "0" * 64).size == len(body)
    with s.get("b", "blobs/" + "0" * 64) as f:
        assert f.read() == body
        f.seek(5)
        assert s.put("b", "rest", f, 0, "") == len(body) - 5
    with s.get("b", "rest") as f:
        assert f.read() == body[5:]


def test_listings(spark, store):
    rows = list_scopes(spark, store, [("b", "a/"), ("none", ""), ("b", "")]).collect()
    assert sorted(r["object_key"] for r in rows if r["scope"] == 0) == ["a/b", "a/b/c"]
    assert [r["scope"] for r in rows if r["error"]] == [1] and sorted(r["object_key"] for r in rows if r["scope"] == 2) == KEYS


def test_inventories(spark, files, tmp_path):
    store = files
    spark.dataSource.register(ListingSource)
    live = spark.read.format(ListingSource.name()).option("root", store.root).option("scopes", "b/,b/a/b").load()
    assert live.count() == len(KEYS) + 2
    live.write.parquet(str(tmp_path / "inventory"))
    again = inventory(spark, str(tmp_path / "inventory")).where("bucket = 'b' and startswith(object_key, 'a/')")
    assert again.count() == 4 and "PushedFilters: [" in again._jdf.queryExecution().explainString(again.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    for name in ("plain", "a.b(c+"):
        (tmp_path / name / "d").mkdir(parents=True)
        (tmp_path / name / "d" / "x.txt").write_text("abc")
        assert [tuple(r)[:4] for r in inventory_of_files(spark, str(tmp_path / name), "q").collect()] == [("q", "d/x.txt", "", 3)]


def test_filters_reach_the_store(spark, s3):
    """Requests name the pushed prefix, and only scopes that can hold rows are asked."""
    server = fake_s3.serve.server
    server.buckets["c"] = {}
    for bucket in "bc":
        server.buckets[bucket].update({f"{d}/{i:03d}": (b"x", "", datetime.now(timezone.utc)) for d in "pqr" for i in range(40)})
    spark.dataSource.register(listing.ListingSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        options = {"endpoint": s3.endpoint, "access_key": s3.access_key, "secret_key": s3.secret_key, "region": s3.region, "scopes": "b/,c/,b/q/", "parts": "3", "push": "true"}
        rows = lambda where: sorted((r["bucket"], r["object_key"]) for r in spark.read.format("lodestrata_listing").options(**options).load().where(where).collect())
        for where, wanted, prefixes in (
            ("bucket = 'b' and object_key like 'q/%'", [("b", f"q/{i:03d}") for i in range(40) for _ in range(2)], {"q/"}),
            ("bucket = 'b' and object_key like 'p/01%'", [("b", f"p/01{i}") for i in range(10)], {"p/01"}),
            ("object_key = 'r/005'", [("b", "r/005"), ("c", "r/005")], {"r/005"}),
            ("object_key = 'none' or size = 1", [(b, f"{d}/{i:03d}") for b in "bc" for d in "pqr" for i in range(40)] + [("b", f"q/{i:03d}") for i in range(40)], {"", "q/"}),
            ("bucket = 'x'", [], set()),
        ):
            server.prefixes = set()
            assert rows(where) == sorted(wanted) and server.prefixes == prefixes
        assert spark.read.format("lodestrata_listing").options(**options).load().rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_stream_of_objects_has_each_once(spark, files, tmp_path):
    import time

    spark.dataSource.register(listing.ListingSource)
    source = spark.readStream.format("lodestrata_listing").option("root", files.root).option("scopes", "b/").option("settle", "0.05").load()
    put = lambda *keys: [files.put("b", k, io.BytesIO(b"x"), 1, "") for k in keys]
    out = str(tmp_path / "out")

    def run():
        time.sleep(0.2)
        source.select("object_key").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", out).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r[0] for r in spark.read.parquet(out).collect())

    assert run() == KEYS
    put("new/1", "new/2")
    assert run() == sorted([*KEYS, "new/1", "new/2"])
    put("new/2", "new/3")  # written again, and new
    files.remove("b", ["a"])
    assert run() == sorted([*KEYS, "new/1", "new/2", "new/2", "new/3"])
    assert run() == sorted([*KEYS, "new/1", "new/2", "new/2", "new/3"])


def test_loop(tmp_path):
    calls, stop = [], threading.Event()

    def scan():
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("one bad scan")
        if len(calls) == 4:
            stop.set()
        return None

    assert run_loop(0.001, scan, stop=stop) == 4 and run_loop(0.001, scan, stop=stop) == 0
    assert run_loop(0.001, lambda: None, scans=3) == 3
    with pytest.raises(RuntimeError):
        run_and_report(lambda: (_ for _ in ()).throw(RuntimeError("x")), None)


def test_signals():
    import os
    import signal

    cancelled = []

    class Session:
        class sparkContext:
            cancelJobsWithTag = staticmethod(lambda tag: cancelled.append(tag))

    stopper = Stopper(Session())
    try:
        scans = []

        def scan():
            scans.append(1)
            os.kill(os.getpid(), signal.SIGTERM)  # the scan that runs is finished, no other starts
            assert stopper.stop.is_set() and not cancelled

        assert run_loop(0.001, scan, stop=stopper.stop) == 1 and scans == [1]
        os.kill(os.getpid(), signal.SIGINT)
        assert cancelled == [SCAN_TAG]
    finally:
        stopper.restore()


def test_a_second_signal_spares_the_jobs_of_others(spark):
    import os
    import signal
    import time

    def slow(batches):
        time.sleep(6)
        yield from batches

    done = {}

    def job(name, own):
        try:
            with tagged(spark) if own else contextlib.nullcontext():
                done[name] = spark.range(3).mapInArrow(slow, "id long").count()
        except Exception as e:
            done[name] = type(e).__name__

    threads = [InheritableThread(target=job, args=x) for x in (("scan", True), ("other", False))]
    stopper = Stopper(spark)
    try:
        for t in threads:
            t.start()
        time.sleep(3)
        os.kill(os.getpid(), signal.SIGTERM), os.kill(os.getpid(), signal.SIGTERM)
        for t in threads:
            t.join(60)
    finally:
        stopper.restore()
    assert done["other"] == 3 and done["scan"] != 3


CONFIG = """
s3: {{endpoint: "{root}", buckets: [{{name: b, prefix: ""}}]}}
dedup: {{mode: report_only, min_size_bytes: 0}}
cache: {{path: "{state}"}}
schedule: {{scan_interval: 1s}}
logging: {{level: warning}}
"""


def test_command_line(spark, files, tmp_path, monkeypatch, capsys):
    store = files
    monkeypatch.chdir(tmp_path)
    path = tmp_path / "c.yaml"
    path.write_text(CONFIG.format(root=store.root, state=tmp_path / "state"))
    assert main(["scan-once", "-c", str(path)]) == 0 and (tmp_path / "report.json").exists()
    assert main(["report", "-o", "copy.json"]) == 0 and (tmp_path / "copy.json").read_text() == (tmp_path / "report.json").read_text()
    assert main(["report", "-o", "copy.txt"]) == 1 and main(["scan-once", "-c", "none.yaml"]) == 1
    path.write_text(CONFIG.format(root="ftp://nowhere", state=tmp_path / "state"))
    assert main(["scan-once", "-c", str(path)]) == 1 and "no storage adapter" in capsys.readouterr().err


def test_scan_on_arrival(spark, files, tmp_path):
    store = files
    (tmp_path / "c.yaml").write_text(CONFIG.format(root=store.root, state=tmp_path / "state"))
    engine, reports = Engine.open(str(tmp_path / "c.yaml"), spark), []
    (tmp_path / "arrivals").mkdir()
    (tmp_path / "arrivals" / "one.json").write_text('{"day": 1}\n')
    stream = spark.readStream.schema("day int").json(str(tmp_path / "arrivals"))
    query = scan_on_arrival(stream, lambda: reports.append(engine.scan()) or reports[-1], str(tmp_path / "checkpoint"))
    query.awaitTermination(120)
    assert [r["objects_scanned"] for r in reports] == [len(KEYS)]


def test_a_copy_within_a_folder_store_is_a_link_and_lives_alone(tmp_path):
    s = FileStore(str(tmp_path / "s"))
    s.create_bucket("b")
    for name, size in (("short", 10), ("long", 10_000)):
        body = b"x" * size
        s.put("b", f"a/{name}", io.BytesIO(body), size, "t")
        etag = s.stat("b", f"a/{name}").etag
        for target in (f"blobs/{name}", f"blobs/{name}", f"blobs/{name}2", f"a/{name}2"):  # again, beside the first one, in the folder of the object
            s.copy("b", f"a/{name}", target, etag, size, "t")
        linked = os.stat(s._path("b", f"a/{name}")).st_ino
        assert linked in {os.stat(s._path("b", f"blobs/{name}{n}")).st_ino for n in ("", "2")}
        with pytest.raises(ValueError):
            s.copy("b", f"a/{name}", "blobs/other", "another etag", size, "t")
        s.copy("b", f"a/{name}", f"blobs/{name}3", etag, size, "another type")
        assert s.stat("b", f"blobs/{name}3").content_type == "another type" and s.stat("b", f"a/{name}").content_type == "t"
        s.put("b", f"a/{name}", io.BytesIO(b"pointer"), 7, "p")
        assert s.get("b", f"a/{name}").read() == b"pointer"
        left = [f"a/{name}2", *(f"blobs/{name}{n}" for n in ("", "2", "3"))]
        while left:
            assert all(s.get("b", k).read() == body and s.stat("b", k).size == size for k in left)
            s.remove("b", [left.pop()])
        s.remove("b", [f"a/{name}"])
    assert list(s.list("b", "")) == [] and not [f for _, _, files in os.walk(s.root) for f in files]


def test_a_replaced_file_has_its_blocks_before_it_is_named(tmp_path, monkeypatch):
    s, reserved = FileStore(str(tmp_path / "s")), []
    s.create_bucket("b")
    monkeypatch.setattr("os.posix_fallocate", lambda fd, at, size: reserved.append(size))
    s.put("b", "k", io.BytesIO(b"one"), 3, "t")
    assert reserved == []
    s.put("b", "k", io.BytesIO(b"two"), 3, "t")
    assert len(reserved) == 1 and s.get("b", "k").read() == b"two"


def test_a_listing_passes_over_stored_blobs(spark, tmp_path):
    class Looks(FileStore):
        def stat(self, bucket, key):
            if key.startswith("blobs/"):
                raise OSError("a blob is looked at")
            return super().stat(bucket, key)

    s = Looks(str(tmp_path / "s"))
    s.create_bucket("b")
    keys = ["a", "blobs", "blobs.x", "blobs0", "c/blobs/x"]
    for k in [*keys, *(f"blobs/{i:064d}" for i in range(5))]:
        s.put("b", k, io.BytesIO(b"x"), 1, "")
    listed = lambda *scopes: sorted((r["scope"], r["object_key"], r["error"]) for r in list_scopes(spark, s, list(scopes), without="blobs/").collect())
    assert listed(("b", ""), ("b", "blob"), ("b", "c")) == sorted([(0, k, None) for k in keys] + [(1, k, None) for k in keys[1:4]] + [(2, keys[4], None)])
    assert {error for _, _, error in listed(("none", ""))} == {"FileNotFoundError: bucket 'none' does not exist"}
