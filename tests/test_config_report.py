from datetime import datetime, timezone

import pytest

from lodestrata.config import load, parse
from lodestrata.sources.reports import append_history, empty_report, read_report, report_frame, write_report

YAML = """
schedule: {workers: 3, scan_interval: 90m}
cache: {path: "hdfs://nodes/catalog", backend: sqlite}
dedup: {mode: pointer, delete_originals: true, hash_algo: sha512, blob_prefix: bodies/, min_size_bytes: 17}
logging: {level: debug, file: scan.log}
s3:
  buckets: [{name: raw}, {prefix: de/, name: crawl}]
  secure: true
  use_path_style: true
  endpoint: objects.lan
  region: moon-1
  access_key: reader
  secret_key: 12345
"""


def test_full_parse_and_environment(tmp_path):
    c = parse(YAML, {"S3_ACCESS_KEY": "fromEnvironment"})
    assert c.scopes == [("raw", ""), ("crawl", "de/")] and c.dedup.min_size_bytes == 17 and c.interval_seconds == 5400 and c.schedule.workers == 3
    assert (c.s3.access_key, c.s3.secret_key) == ("fromEnvironment", "12345") and parse(YAML.replace("workers: 3, ", ""), {}).schedule.workers is None
    assert c.s3a_options()["spark.hadoop.fs.s3a.path.style.access"] == "true"
    (tmp_path / "c.yaml").write_text(YAML)
    assert load(str(tmp_path / "c.yaml"), {}).s3.access_key == "reader"
    with pytest.raises(FileNotFoundError):
        load(str(tmp_path / "none.yaml"))


@pytest.mark.parametrize(
    "old, new",
    [
        ("mode: pointer", "mode: other"), ("backend: sqlite", "backend: memory"), ("scan_interval: 90m", "scan_interval: soon"), ("scan_interval: 90m", "scan_interval: 0s"),
        ("hash_algo: sha512", "hash_algo: adler32"), ("blob_prefix: bodies/", 'blob_prefix: ""'), ("workers: 3", "workers: many"), ("workers: 3", "workers: 3, extra: 1"), ("s3:\n", "server: {}\ns3:\n"),
    ],
)
def test_rejected(old, new):
    with pytest.raises(ValueError):
        parse(YAML.replace(old, new), {})


REPORT = empty_report("pointer", datetime(2026, 3, 1, 1, 2, 3, 456, tzinfo=timezone.utc)) | {"objects_scanned": 10, "bytes_reclaimable": 972452}


def test_report_round_trip(tmp_path, spark):
    path = str(tmp_path / "r.json")
    write_report(path, REPORT)
    assert read_report(path) == REPORT and "\n\t" in open(path).read() and open(path).read().endswith("}\n")
    for _ in range(2):
        append_history(spark, str(tmp_path / "history"), REPORT)
    assert spark.read.parquet(str(tmp_path / "history")).count() == 2
    assert report_frame(spark, REPORT).first()["objects_scanned"] == 10


def test_report_errors(tmp_path):
    with pytest.raises(ValueError):
        write_report(str(tmp_path / "r.txt"), REPORT)
    with pytest.raises(OSError):
        write_report(str(tmp_path / "no" / "r.json"), REPORT)
    for name, body in (("a", '{"more": 1}'), ("b", '{"scan_started": "2026-03-01T00:00:00Z", "scan_finished": "2026-03-01T00:00:00Z", "errors": "x"}'), ("c", "[]")):
        (tmp_path / f"{name}.json").write_text(body)
        with pytest.raises(ValueError):
            read_report(str(tmp_path / f"{name}.json"))
