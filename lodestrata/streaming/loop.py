"""The run loop: scan, wait for the interval after its end, scan again; and signals.

Deletions are only visible in full listings, so each epoch is a batch; a stream of inventory
arrivals may start the epochs (`scan_on_arrival`), but does not replace them.
"""

from __future__ import annotations

import logging
import signal
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from lodestrata.session import SCAN_TAG
from lodestrata.sources.reports import write_report

log = logging.getLogger("lodestrata")


def run_and_report(scan: Callable[[], dict], out: str | None) -> dict:
    """Scans and writes the report, also that of a failed scan, whose error is then raised."""
    failure = None
    try:
        report = scan()
    except Exception as e:
        report, failure = getattr(e, "report", None), e
    if report is not None and out:
        log.info("%s", report)
        write_report(out, report)
    if failure is not None:
        raise failure
    return report


def run_loop(interval: float, scan: Callable[[], dict], out: str | None = None, stop: threading.Event | None = None, scans: int | None = None) -> int:
    """Scans until `stop` is set (or `scans` times); a failed scan does not end the loop."""
    stop, done = stop or threading.Event(), 0
    while not stop.is_set() and done != scans:
        log.info("scan %d starts", done)
        try:
            run_and_report(scan, out)
        except Exception as e:
            log.error("scan failed: %s", e)
        done += 1
        if done != scans:
            stop.wait(interval)
    return done


class Stopper:
    """First signal: finish the scan; second: cancel the jobs of this process's scans, and no others of the session."""

    def __init__(self, spark: SparkSession):
        self.stop, self.spark = threading.Event(), spark
        self._old = {s: signal.signal(s, self._on) for s in (signal.SIGINT, signal.SIGTERM)}

    def _on(self, *_):
        if self.stop.is_set():
            log.warning("forced shutdown: cancelling jobs")
            self.spark.sparkContext.cancelJobsWithTag(SCAN_TAG)
        else:
            log.warning("shutdown requested: finishing the scan")
            self.stop.set()

    def restore(self) -> None:
        for s, handler in self._old.items():
            signal.signal(s, handler)


def scan_on_arrival(arrivals: DataFrame, scan: Callable[[], dict], checkpoint: str, out: str | None = None, **trigger) -> StreamingQuery:
    """A query that scans once for every micro-batch of a stream of inventory arrivals."""

    def epoch(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            try:
                run_and_report(scan, out)
            except Exception as e:
                log.error("scan of epoch %d failed: %s", number, e)

    return arrivals.writeStream.foreachBatch(epoch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
