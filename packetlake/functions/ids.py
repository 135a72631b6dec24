"""Identifiers that do not depend on the order of their parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlake.functions.binary import piece
from packetlake.functions.tokens import masked_bytes


def unordered_id(*columns: Column, digest: str = "xxhash64") -> Column:
    """The same id for the same values in any order."""
    parts = F.array_sort(F.array(*[c.cast("string") for c in columns]))
    return _digest(parts, digest)


def _digest(parts: Column, digest: str) -> Column:
    if digest == "md5":
        return F.md5(F.array_join(parts, ","))
    if digest == "xxhash64":
        return F.xxhash64(parts)
    raise ValueError(f"digest must be xxhash64 or md5, not {digest!r}")


def host_pair_parts(addresses: Column) -> Column:
    """Sorted addresses among the masked bytes: MACs, and IPs where 20 or 44 bytes."""
    macs = [piece(addresses, 0, 6), piece(addresses, 6, 6)]
    v4 = [piece(addresses, 12, 4), piece(addresses, 16, 4)]
    v6 = [piece(addresses, 12, 16), piece(addresses, 28, 16)]

    def listed(parts: list[Column]) -> Column:
        return F.array_sort(F.array(*[F.hex(p) for p in parts]))

    size = F.length(addresses)
    return F.when(size == 44, listed(macs + v6)).when(size == 20, listed(macs + v4)).otherwise(listed(macs))


def host_pair_id(data: Column, mask: Column, digest: str = "xxhash64") -> Column:
    """Id of the pair of hosts, from the masked address bytes; ports play no part."""
    return _digest(host_pair_parts(masked_bytes(data, mask)), digest)
