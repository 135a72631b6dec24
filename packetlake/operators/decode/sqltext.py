"""SQL text for reads from BINARY columns.

The decoder states its columns as SQL expressions: one expression is one call to
the session however many nodes it has, and whole stages stay in code generation.
Offsets are 0-based numbers or SQL expressions; a read past the end gives NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def piece(data: str, offset: int | str, length: int | str) -> str:
    """``length`` bytes from ``offset``, shorter where the data ends."""
    start = offset + 1 if isinstance(offset, int) else f"{offset} + 1"
    return f"substring({data}, {start}, {length})"


def uint(data: str, offset: int | str, width: int) -> str:
    """Unsigned big-endian number of ``width`` bytes."""
    kind = "bigint" if width > 3 else "int"
    return f"cast(conv(hex({piece(data, offset, width)}), 16, 10) as {kind})"


def u8(data: str, offset: int | str) -> str:
    return uint(data, offset, 1)


def u16(data: str, offset: int | str) -> str:
    return uint(data, offset, 2)


def u32(data: str, offset: int | str) -> str:
    return uint(data, offset, 4)


def any_of(values) -> str:
    """The values as the inside of an IN list."""
    return ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values)


def case(pairs, otherwise: str = "NULL") -> str:
    """CASE over (condition, result) pairs."""
    return "CASE " + " ".join(f"WHEN {c} THEN {r}" for c, r in pairs) + f" ELSE {otherwise} END"


def step(rows: DataFrame, **columns: str) -> DataFrame:
    """Adds columns that may use those of earlier steps, but not each other."""
    return rows.withColumns({name: F.expr(sql) for name, sql in columns.items()})
