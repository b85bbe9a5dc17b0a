"""Timestamps as text, and durations such as "20s", "1h30m"."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a unit.
UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "μs": 1e-6, "ms": 1e-3, "s": 1.0, "m": 60.0, "h": 3600.0}
_PART = re.compile(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|μs|ms|s|m|h)")


def rfc3339(ts: Column) -> Column:
    """UTC text with the fraction's trailing zeros cut; the session's time zone must be UTC."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    fraction = F.rtrim(F.substring(text, 21, 6), F.lit("0"))
    return F.concat(F.substring(text, 1, 19), F.when(fraction == "", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("Z"))


def duration_seconds(text: str) -> float:
    """Seconds of a duration; ValueError if it is none."""
    body = text[1:] if text[:1] in ("+", "-") else text
    if body == "0":
        return 0.0
    total, at = 0.0, 0
    for m in _PART.finditer(body):
        if m.start() != at:
            raise ValueError(f"invalid duration {text!r}")
        total, at = total + float(m.group(1)) * UNITS[m.group(2)], m.end()
    if not body or at != len(body):
        raise ValueError(f"invalid duration {text!r}")
    return -total if text[0] == "-" else total
