"""Scan reports: strict JSON in and out, and a Parquet history."""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from lodestrata.schemas import REPORT_FIELDS

SCHEMA = "scan_started timestamp, scan_finished timestamp, objects_scanned bigint, unique_blobs bigint, duplicates_found bigint, bytes_reclaimable bigint, bytes_reclaimed bigint, objects_relinked bigint, errors bigint, mode string"


def empty_report(mode: str, started: datetime) -> dict:
    return {k: 0 for k in REPORT_FIELDS} | {"scan_started": started, "scan_finished": started, "mode": mode}


def _text(ts: datetime) -> str:
    return ts.isoformat().replace("+00:00", "Z")


def write_report(path: str, report: dict) -> None:
    if not path.endswith(".json"):
        raise ValueError("report path must end in .json")
    body = {k: _text(report[k]) if isinstance(report[k], datetime) else report[k] for k in REPORT_FIELDS}
    with open(path, "w", encoding="utf-8") as f:
        f.write(json.dumps(body, indent="\t") + "\n")


def read_report(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError("a report is a JSON object")
    if unknown := sorted(set(found) - set(REPORT_FIELDS)):
        raise ValueError(f"unknown field {unknown[0]!r}")
    out = {}
    for name in REPORT_FIELDS:
        value = found.get(name, 0)
        if name.startswith("scan_"):
            out[name] = datetime.fromisoformat(value)
        elif name == "mode":
            if not isinstance(value, str):
                raise ValueError("wrong type of 'mode'")
            out[name] = value
        elif type(value) is int:
            out[name] = value
        else:
            raise ValueError(f"wrong type of {name!r}")
    return out


def report_frame(spark: SparkSession, report: dict) -> DataFrame:
    return spark.createDataFrame([tuple(report[k] for k in REPORT_FIELDS)], SCHEMA)


def append_history(spark: SparkSession, path: str, report: dict) -> None:
    report_frame(spark, report).coalesce(1).write.mode("append").parquet(path)
