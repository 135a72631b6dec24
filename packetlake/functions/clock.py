"""Capture timestamps: whole seconds plus microseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_parts(seconds: Column, micros: Column) -> Column:
    return F.timestamp_micros(seconds * F.lit(1_000_000) + micros)


def seconds_part(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("long")


def micros_part(ts: Column) -> Column:
    return F.pmod(F.unix_micros(ts), F.lit(1_000_000))


def duration_us(later: Column, earlier: Column) -> Column:
    """Microseconds from ``earlier`` to ``later``, negative if time went back."""
    return F.unix_micros(later) - F.unix_micros(earlier)


def as_instant(ts: Column, data_type: str) -> Column:
    """TIMESTAMP of a column that may be zone-less; zone-less values are UTC."""
    if data_type == "timestamp_ntz":
        return F.timestamp_micros(
            F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)
        )
    return ts
