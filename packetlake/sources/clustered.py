"""Packet tables along a space-filling curve over time and both endpoints.

A question about one endpoint and a stretch of time then meets few files, row
groups and pages, whichever side the endpoint is on.
"""

from __future__ import annotations

from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.operators.decode import packet_table
#: Address columns and their cells.
ENDPOINT_COLUMNS = {"src_ip": "src_cell", "dst_ip": "dst_cell"}
#: Bits of the curve per dimension, and of the stored cell of an endpoint.
BITS, CELL_BITS = 12, 16
#: Bytes of a row group before compression, and rows of a page.
GROUP_BYTES, PAGE_ROWS = 64 << 20, 1000


def interleaved(numbers: list[Column], bits: int = BITS) -> Column:
    """The low ``bits`` bits of each number in turn, highest first, as one number."""
    taken = []
    for level in range(bits):
        for place, number in enumerate(reversed(numbers)):
            bit = F.shiftright(number, level).bitwiseAND(F.lit(1).cast("long"))
            taken.append(F.shiftleft(bit, level * len(numbers) + place))
    return reduce(lambda a, b: a.bitwiseOR(b), taken)


def _endpoint_cell(address: Column) -> Column:
    # Endpoints are looked up one by one, so their order means nothing; a hash spreads them evenly.
    return F.pmod(F.xxhash64(address), F.lit(1 << CELL_BITS)).cast("int")


def write_clustered(
    packets: DataFrame,
    path: str,
    files: int,
    bits: int = BITS,
    group_bytes: int = GROUP_BYTES,
    page_rows: int = PAGE_ROWS,
    mode: str = "errorifexists",
) -> None:
    """Stores the packet table with ``packet_no, src_ip, dst_ip``, each frame and mask once.

    ``src_cell`` and ``dst_cell`` are hashes of the addresses. The curve runs over
    their leading bits, so the pages have narrow ranges of both.
    ``files`` ranges of equal size along the curve become one file each. Ranges are
    cut by packet number inside a cell, so a busy pair of endpoints, or a burst,
    is not gathered in one task. Bloom filters on both addresses tell which row
    groups hold an endpoint; page indexes and sorted pages do the rest. An empty
    table gives an empty one. Packets without a time or address count as the
    lowest of their dimension. The packets are computed once and kept on the
    executors' disks for the three passes: time span, cuts, rows.
    """
    wide = packet_table(packets, "packet_no", *ENDPOINT_COLUMNS).persist(StorageLevel.DISK_ONLY)
    try:
        _write_along_curve(wide, path, files, bits, group_bytes, page_rows, mode)
    finally:
        wide.unpersist()


def _write_along_curve(wide: DataFrame, path: str, files: int, bits: int, group_bytes: int, page_rows: int, mode: str) -> None:
    span = wide.agg(F.min("timestamp_s"), F.max("timestamp_s")).first()
    low, high = (span[0] or 0, span[1] or 0)
    width = max(1, -(-(high - low + 1) // (1 << bits)))
    time = F.floor((F.coalesce("timestamp_s", F.lit(low)) - F.lit(low)) / F.lit(width)).cast("long")
    wide = wide.withColumns({cell: _endpoint_cell(F.col(c)) for c, cell in ENDPOINT_COLUMNS.items()})
    cells = [time, *[F.shiftright(F.col(c), CELL_BITS - bits).cast("long") for c in ENDPOINT_COLUMNS.values()]]
    placed = wide.withColumn("_cell", interleaved(cells, bits))
    ranges = placed.repartitionByRange(files, "_cell", "packet_no").sortWithinPartitions("_cell", "packet_no")
    writer = ranges.drop("_cell").write.mode(mode).option("parquet.block.size", group_bytes)
    writer = writer.option("parquet.page.row.count.limit", page_rows)
    for column in ENDPOINT_COLUMNS:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def read_clustered(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def endpoint_packets(rows: DataFrame, address: bytes, start_s: int, end_s: int) -> DataFrame:
    """Packets from or to ``address`` with ``start_s <= timestamp_s < end_s``.

    Plain comparisons of stored columns, so that the scan skips what cannot match.
    """
    here = [(F.col(c) == F.lit(address)) & (F.col(cell) == _endpoint_cell(F.lit(address))) for c, cell in ENDPOINT_COLUMNS.items()]
    side = reduce(lambda a, b: a | b, here)
    return rows.filter(side & (F.col("timestamp_s") >= start_s) & (F.col("timestamp_s") < end_s))
