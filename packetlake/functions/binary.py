"""Pieces of a BINARY column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def piece(data: Column, offset: int, length: int) -> Column:
    """``length`` bytes from a 0-based offset; shorter where the data ends."""
    return F.substring(data, F.lit(offset + 1), F.lit(length))
