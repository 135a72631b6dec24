"""Token ids as Parquet lists: encoded, written in document order, read in parts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetlake.llm.common import slices
from packetlake.llm.wordpieces import word_pieces

END_ID = 1
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000

SCHEMA = "doc_id long, part long, local_start long, n_tokens long, ids array<int>"


def encode_in_order(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """``docs`` (doc_id, text) as rows (doc_id, part, local_start, n_tokens, ids) in doc_id order.

    Parts are ranges of (doc_id, text); ``local_start`` counts the ids before a
    document within its part. Null text is empty; null doc_id comes first.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_pieces(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        before = 0
        for batch in batches:
            texts = batch.column(2)
            for low, high in slices(texts):
                packed = [ids + end for ids in encoder.encode([t or "" for t in texts.slice(low, high - low).to_pylist()])]
                counts = np.array([len(ids) // 4 for ids in packed], np.int64)
                ends = np.cumsum(counts)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(packed), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(offsets), values)
                columns = [
                    batch.column(0).slice(low, high - low),
                    batch.column(1).slice(low, high - low),
                    pa.array(before + ends - counts),
                    pa.array(counts),
                    lists,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])
                before += int(ends[-1])

    ranged = (
        docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        .repartitionByRange("doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", "text")
        .select("doc_id", F.spark_partition_id().cast("long").alias("part"), "text")
    )
    return ranged.mapInArrow(encode, SCHEMA)


def write_ids(rows: DataFrame, path: str, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES, page_rows: int = PAGE_ROWS) -> None:
    """Writes the rows with dictionary ids, delta-encoded numbers and small pages.

    Ids repeat, so they keep a dictionary; the counters grow steadily, so they
    get none and format version 2 writes them as deltas. Column and offset
    indexes are part of every file: a filter on ``doc_id`` reads only its pages.
    """
    (
        rows.write.option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#doc_id", "false")
        .option("parquet.enable.dictionary#local_start", "false")
        .option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.dictionary.page.size", 4 << 20)
        .option("compression", "zstd")
        .parquet(path)
    )


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; the reader prunes columns and skips pages by their index."""
    return spark.read.schema(SCHEMA).parquet(path)


def starts(rows: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids of all documents before each one.

    The window and the broadcast hold one row per part, and parts are no more
    than the shuffle partitions of the writer.
    """
    sums = rows.groupBy(F.col("part").alias("_part")).agg(F.sum("n_tokens").alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), rows.part == bases["_part"]).select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids"
    )


def id_checksums(lists: pa.Array) -> list[int]:
    """crc32 of each list's little-endian unsigned 32-bit ids."""
    offsets = lists.offsets.to_numpy()
    values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
    view = memoryview(np.ascontiguousarray(values)).cast("B")
    return [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
