"""Event times are stored as wall-clock ``timestamp_ntz``.  These helpers do epoch arithmetic
and watermark conversion on them without reading the session time zone, so results are the
same whatever zone the cluster's session uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def epoch_seconds(ntz) -> Column:
    """Seconds since 1970-01-01 00:00 of a wall-clock time (double, microsecond precision)."""
    return F.timestamp_diff("MICROSECOND", _epoch(), col(ntz)) / 1e6


def ntz_from_seconds(seconds) -> Column:
    return F.timestamp_add("MICROSECOND", (col(seconds) * 1_000_000).cast("long"), _epoch())


def utc_instant(ntz) -> Column:
    """The wall clock read as UTC, as a zoned ``timestamp`` (what watermarks and windows need)."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", _epoch(), col(ntz)))


def utc_wallclock(instant) -> Column:
    """Inverse of ``utc_instant``: a zoned timestamp back to its UTC wall clock."""
    return F.timestamp_add("MICROSECOND", F.unix_micros(col(instant)), _epoch())
