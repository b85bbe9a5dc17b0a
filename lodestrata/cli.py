"""Command line: scan-once, run, report."""

from __future__ import annotations

import argparse
import logging
import os
import sys

from lodestrata.config import Config, Storage, load
from lodestrata.plans.scan import scan_once
from lodestrata.session import session
from lodestrata.sources.objectstore import FileStore, ObjectStore, health_check
from lodestrata.sources.reports import read_report, write_report
from lodestrata.sources.s3store import S3Store
from lodestrata.sources.state import StateStore
from lodestrata.streaming.loop import Stopper, run_and_report, run_loop

REPORT = "report.json"


class Engine:
    """Configuration, storage and catalog, checked and opened together."""

    def __init__(self, config: Config, store: ObjectStore, spark=None):
        health_check(store, [b.name for b in config.s3.buckets])
        self.config, self.store, self.spark = config, store, spark or session()
        self.state = StateStore(self.spark, config.cache.path)

    @classmethod
    def open(cls, path: str, spark=None) -> Engine:
        config = load(path)
        logging.basicConfig(level=config.logging.level.upper(), filename=config.logging.file or None)
        return cls(config, store_of(config.s3), spark)

    def scan(self) -> dict:
        return scan_once(self.spark, self.store, self.state, self.config)

    def close(self) -> None:
        """Closes the catalog; the session is the caller's."""
        self.state.close()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.close()


def store_of(s3: Storage) -> ObjectStore:
    """A folder (file:///...), or an S3 endpoint: host[:port] or a URL."""
    if s3.endpoint.startswith(("file://", "/")):
        root = s3.endpoint.removeprefix("file://")
        if not os.path.isdir(root):
            raise ValueError(f"no folder {root!r}")
        return FileStore(root)
    if not s3.endpoint or "://" in s3.endpoint and not s3.endpoint.startswith(("http://", "https://")):
        raise ValueError(f"no storage adapter for endpoint {s3.endpoint!r}")
    return S3Store(s3.endpoint, s3.access_key, s3.secret_key, s3.region or "us-east-1", s3.use_path_style, s3.secure)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestrata", description="Deduplicates the objects of a store")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, about in (("scan-once", "one scan"), ("run", "scans at the configured interval")):
        p = commands.add_parser(name, help=about)
        p.add_argument("-c", "--config", required=True)
        p.add_argument("-o", "--out", default=REPORT)
    p = commands.add_parser("report", help="copies the last report")
    p.add_argument("-o", "--out", required=True)
    given = parser.parse_args(args)
    try:
        if given.command == "report":
            found = read_report(REPORT)
            write_report(given.out, found)
            print(found)
            return 0
        with Engine.open(given.config) as engine:
            if given.command == "scan-once":
                print(run_and_report(engine.scan, given.out))
            else:
                stopper = Stopper(engine.spark)
                run_loop(engine.config.interval_seconds, engine.scan, given.out, stopper.stop)
        return 0
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
