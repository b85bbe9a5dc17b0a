import io
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.hashing import check_algorithm, content_hash, hash_stream
from lodestrata.functions.pointers import dump_pointer, load_pointer, parse_pointer, render_pointer
from lodestrata.functions.times import duration_seconds, rfc3339

SHA256 = {"hello": "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824", "": "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}


def test_hash_known_answers(spark):
    rows = spark.createDataFrame([("hello",), ("",), (None,)], "t string").select("t", content_hash("t").alias("h"), content_hash("t", "sha512").alias("w")).collect()
    assert {r["t"]: r["h"] for r in rows if r["t"] is not None} == SHA256
    assert rows[0]["w"].startswith("9b71d224bd62f378") and rows[2]["h"] is None
    assert hash_stream(io.BytesIO(b"hello"), "sha256") == (SHA256["hello"], 5)
    assert hash_stream(io.BytesIO(b"a" * 3_000_000), "sha512", 1000) == hash_stream(io.BytesIO(b"a" * 3_000_000), "sha512")


@pytest.mark.parametrize("name", ["crc32", "nope", "", "SHA256"])
def test_unsupported_hash(name):
    with pytest.raises(ValueError):
        check_algorithm(name)


GOOD = {"blob_bucket": "b", "blob_key": "blobs/h", "hash": "h", "size": 3, "content_type": "text/plain"}
BODIES = [
    (json.dumps(GOOD), None),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h","size":0}', None),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h"}', None),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h","size":1,"content_type":null}', None),
    ('{"blob_bucket":"","blob_key":"k","hash":"h","size":1}', "blob_bucket is empty"),
    ('{"blob_bucket":"b","blob_key":"","hash":"h","size":1}', "blob_key is empty"),
    ('{"blob_bucket":"b","blob_key":"k","hash":"","size":1}', "hash is empty"),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h","size":-1}', "size is negative"),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h","size":1,"more":2}', "unknown field 'more'"),
    ('{"blob_bucket":"b","blob_key":"k","hash":5,"size":1}', "wrong type of 'hash'"),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h","size":"1"}', "wrong type of 'size'"),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h","size":1.5}', "wrong type of 'size'"),
    ('{"blob_bucket":"b","blob_key":"k","hash":"h","size":1} x', None),
    ("[1]", "not a JSON object"),
    ("plain", "not a JSON document"),
    ("", "not a JSON document"),
]


def test_parse_pointer_agrees_with_strict_reading(spark):
    rows = spark.createDataFrame([(b,) for b, _ in BODIES], "body string").select("body", parse_pointer(F.col("body")).alias("p")).collect()
    for row, (body, error) in zip(rows, BODIES):
        assert row["p"]["error"] == error, body
        if error is None:
            assert row["p"]["pointer"].asDict() == load_pointer(body)
        else:
            with pytest.raises(ValueError, match=error.split(" '")[0]):
                load_pointer(body)


def test_render_pointer_round_trip(spark):
    rows = [("b", "blobs/é\"<&>", "h", 7, "text/plain"), ("b", "k", "h", 0, ""), ("", "k", "h", 1, ""), ("b", "k", "h", -1, "")]
    df = spark.createDataFrame(rows, "bb string, k string, h string, s bigint, c string")
    out = [r[0] for r in df.select(render_pointer(*[F.col(c) for c in df.columns])).collect()]
    names = ["blob_bucket", "blob_key", "hash", "size", "content_type"]
    assert load_pointer(out[0]) == dict(zip(names, rows[0])) and out[0] == dump_pointer(dict(zip(names, rows[0])))
    assert "content_type" not in json.loads(out[1]) and out[2:] == [None, None]


def test_rfc3339(spark):
    times = [datetime(2026, 3, 1, tzinfo=timezone.utc), datetime(2026, 3, 1, 10, 20, 30, 120000, tzinfo=timezone.utc), datetime(2026, 3, 1, 0, 0, 0, 1, tzinfo=timezone.utc)]
    out = [r[0] for r in spark.createDataFrame([(t,) for t in times], "t timestamp").select(rfc3339(F.col("t"))).collect()]
    assert out == ["2026-03-01T00:00:00Z", "2026-03-01T10:20:30.12Z", "2026-03-01T00:00:00.000001Z"]


def test_durations():
    assert [duration_seconds(x) for x in ("20s", "1h", "1h30m", "1.5s", "250ms", "0", "-2s")] == [20, 3600, 5400, 1.5, 0.25, 0, -2]
    for bad in ("", "5", "s", "1x", "1h 2m"):
        with pytest.raises(ValueError):
            duration_seconds(bad)


def test_ten_thousand_scopes(spark, monkeypatch):
    """A plan whose size does not follow their number, and the rows of the conditions."""
    import random

    from lodestrata.operators import filters

    rnd = random.Random(1)
    keys = [("ab"[i % 2], "".join(rnd.choice("xy/é") for _ in range(rnd.randint(0, 6)))) for i in range(500)]
    listed = spark.createDataFrame([(b, k, i) for i, (b, k) in enumerate(keys)], "bucket string, object_key string, size long")
    scopes = [("a", ""), ("b", "x"), ("b", "xy"), ("b", "xy"), ("b", "é/"), ("c", "")]
    wanted = sorted((i, b, p) for b, p in scopes for i, (bucket, k) in enumerate(keys) if bucket == b and k.startswith(p))
    for pushed, broadcast in ((50, 100_000), (0, 100_000), (0, 0)):
        monkeypatch.setattr(filters, "PUSHED_SCOPES", pushed)
        monkeypatch.setattr(filters, "BROADCAST_SCOPES", broadcast)
        assert sorted((r["size"], r["scope_bucket"], r["scope_prefix"]) for r in filters.filter_scopes(listed, scopes).collect()) == wanted
        assert sorted(r["size"] for r in filters.in_any_scope(listed, scopes).collect()) == sorted({i for i, *_ in wanted})
    many = [("b", f"p{i}/") for i in range(10_000)]
    plan = filters.filter_scopes(listed, many)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 10_000 and filters.filter_scopes(listed, many).count() == 0
