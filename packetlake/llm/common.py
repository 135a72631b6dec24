"""Stored intermediate tables, membership filters and connected components."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.session import shared_folder, small_batches

#: Bits of a membership filter: 1 MiB, whatever the number of members.
FILTER_BITS = 1 << 23
#: Bytes of text that one numpy pass handles; a single longer text is one pass.
SLICE_BYTES = 1 << 19
#: Rounds after which components must have converged (a path of n nodes needs about log n).
MAX_ROUNDS = 60


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file on the machine at hand."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written to the shared folder and read again: lineage ends here."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text (a longer text is alone).

    After the last one, memory that the worker holds unused goes back to the system.
    """
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    low, held = 0, 0
    for row, size in enumerate(sizes):
        if row > low and held + size > limit:
            yield low, row
            low, held = row, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)
    give_back()


def give_back() -> None:
    """Workers live as long as their executor, so what they hold unused would add up over the jobs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def unused(rows: DataFrame, name: str) -> str:
    """A column name that ``rows`` does not have, in any spelling."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = f"_{name}"
    return name


def maybe_member(rows: DataFrame, members: DataFrame, key: Column, name: str) -> DataFrame:
    """Adds boolean ``name``: false only for rows whose key is surely not among ``members.key``.

    The filter is a bitmap of FILTER_BITS bits, so what is broadcast is at most
    1 MiB at any size of the data. A fuller bitmap only lets more rows pass;
    an exact join must follow.
    """
    bucket, octets = unused(rows, "bucket"), unused(rows, "octets")
    place = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS)) + 1
    bits = (
        members.select((F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS)) + 1).alias("_place"))
        .groupBy(F.bitmap_bucket_number("_place").alias(bucket))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias(octets))
    )
    position = F.bitmap_bit_position(place)
    octet = F.conv(F.hex(F.substring(F.col(octets), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10)
    hit = octet.cast("int").bitwiseAND(F.call_function("shiftleft", F.lit(1), (position % 8).cast("int"))) != 0
    return (
        rows.withColumn(bucket, F.bitmap_bucket_number(place))
        .join(F.broadcast(bits), bucket, "left")
        .withColumn(name, F.coalesce(hit, F.lit(False)))
        .drop(bucket, octets)
    )


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round sends every edge to the smallest neighbour of its larger end,
    then of its smaller end. Minima combine before the shuffle, joins can be
    split by the adaptive skew join, and no list of neighbours is gathered.
    """
    links = stored(
        edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).filter("hi <> lo").distinct(), "links"
    )
    for _ in range(MAX_ROUNDS):
        # Larger neighbours of each node move to its smallest neighbour.
        both = links.unionByName(links.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = stored(both.groupBy(F.col("hi").alias("node")).agg(F.least(F.min("lo"), F.min("hi")).alias("least")), "least")
        large = (
            links.join(least, links.lo == least.node)
            .select("hi", F.col("least").alias("lo"))
            .filter("hi <> lo")
            .unionByName(links.join(least, links.hi == least.node).select("hi", F.col("least").alias("lo")).filter("hi <> lo"))
            .distinct()
        )
        large = stored(large, "links")
        # Smaller neighbours of each node, and the node, move to the smallest of them.
        least = stored(large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least")), "least")
        moved = large.join(least, large.hi == least.node).select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
        small = moved.filter("hi <> lo").unionByName(least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct()
        small = stored(small, "links")
        # Stars are the end: every node has one smaller neighbour, which has none.
        open_ends = small.groupBy("hi").count().filter("count > 1").limit(1).count()
        if not open_ends and not small.join(small.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count():
            return small.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
                small.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
            )
        links = small
    raise RuntimeError("components have not converged")


def tuned(spark: SparkSession) -> None:
    """Small Arrow batches, so that long texts do not pile up in a worker."""
    small_batches(spark)


def id_remainder(divisor: int) -> Column:
    """crc32 of doc_id as text, modulo ``divisor``; null without an id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor
