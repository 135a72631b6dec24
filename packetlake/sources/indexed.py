"""Tables stored by row position, so that slices and gathers read only their rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.operators.ordered import row_index

PER_SEGMENT = 1 << 20
#: Folders of a table at most; a folder of a table with more segments holds several in a row.
FOLDERS = 4096
#: Different folders of a gather that are named in the scan; more are found by the join alone.
NAMED_SEGMENTS = 4096


def _segment(position, per_segment: int):
    return F.floor(position / F.lit(per_segment)).cast("long")


def _stride(stored: DataFrame) -> int:
    """Segments of a folder of the table: folders are named by their first segment, so this is the second name."""
    names = {int(found[1]) for f in stored.inputFiles() if (found := re.search(r"/segment=(\d+)/", f))}
    return min(names - {0}, default=max(1, FOLDERS))


def write_indexed(rows: DataFrame, order: str, path: str, per_segment: int = PER_SEGMENT, mode: str = "errorifexists") -> None:
    """Stores ``rows`` with ``row_idx``, their 0-based position along the unique integer ``order``.

    Each folder holds ``per_segment`` positions in a row, sorted, so the folder
    of a position is known by arithmetic, and inside it row groups and pages have
    ranges of ``row_idx`` that do not overlap. A table of more than FOLDERS
    segments has folders of several, named by their first one, since files and
    their listing cost more than the rows of short segments.
    """
    stride = max(1, -(-rows.count() // (per_segment * FOLDERS)))
    placed = row_index(rows, order, "row_idx").withColumn("segment", _segment(F.col("row_idx"), per_segment * stride) * stride)
    placed.repartition("segment").sortWithinPartitions("segment", "row_idx").write.mode(mode).partitionBy("segment").parquet(path)


def read_slice(spark: SparkSession, path: str, start: int, count: int, per_segment: int = PER_SEGMENT) -> DataFrame:
    """``count`` rows from position ``start`` on, fewer at the end of the table; only their folders are read."""
    if start < 0 or count < 0:
        raise ValueError("a slice begins at 0 or later and has no negative length")
    last = start + count - 1
    stored = spark.read.parquet(path)
    stride = _stride(stored)
    wide = per_segment * stride
    folders = F.col("segment").between(start // wide * stride, last // wide * stride)
    return stored.filter(folders & F.col("row_idx").between(start, last)).drop("segment")


def gather_rows(wanted: DataFrame, path: str, per_segment: int = PER_SEGMENT) -> DataFrame:
    """The stored rows at the positions ``row_idx`` of ``wanted``, with its other columns.

    A position that is listed twice gives two rows; one beyond the table gives none.
    """
    spark = wanted.sparkSession
    stored = spark.read.parquet(path)
    stride = _stride(stored)
    placed = wanted.withColumn("segment", _segment(F.col("row_idx"), per_segment * stride) * stride)
    named = placed.select("segment").distinct().limit(NAMED_SEGMENTS + 1).collect()
    if len(named) <= NAMED_SEGMENTS:
        stored = stored.filter(F.col("segment").isin([r.segment for r in named]) if named else F.lit(False))
    return placed.join(stored, ["segment", "row_idx"]).drop("segment")
