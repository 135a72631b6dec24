"""Packing token sequences into bins of fixed capacity with certified bin counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import slices, stored
from packetlake.llm.wordpieces import word_pieces

CAPACITY = 4096
END_ID = 1
#: Pieces that one task packs; their number, not that of all data, bounds its memory.
PIECES_PER_BUCKET = 12_000
#: Exchanges after the first packing.
ROUNDS = 4
#: Largest k of the rounding functions used for the bound.
ROUNDINGS = 40

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for ``docs`` (doc_id, text).

    A document is its ids and ``end_id``; null or empty text is the end id
    alone. Only documents above ``capacity`` are cut. Repeated rows stay rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_pieces(tokenizer)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1)
            for low, high in slices(texts):
                out: list[list] = [[], [], [], [], []]
                names = batch.column(0).slice(low, high - low).to_pylist()
                for doc_id, ids in zip(names, encoder.encode([t or "" for t in texts.slice(low, high - low).to_pylist()])):
                    ids += end
                    view = memoryview(ids)
                    for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = view[at : at + 4 * capacity]
                        for column, value in zip(out, (doc_id, number, at // 4, len(part) // 4, zlib.crc32(part))):
                            column.append(value)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Lower bound for packing ``counts[x]`` items of length x: the best of two
    families of dual feasible functions (threshold and rounding)."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    counts = counts.astype(np.int64)
    best = -(-int((sizes * counts).sum()) // capacity)
    # Items above capacity - t count as full, items below t as nothing.
    weight, number = np.cumsum(sizes * counts), np.cumsum(counts)
    t = np.arange(1, capacity // 2 + 1)
    total = (number[-1] - number[capacity - t]) * capacity + weight[capacity - t] - weight[t - 1]
    best = max(best, -(-int(total.max(initial=0)) // capacity))
    for k in range(1, ROUNDINGS + 1):
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin and offset of every item, and the fill of every bin."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    spaces: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_spaces = 0  # bit s is set if some bin has s free places
    for item in order.tolist():
        size = int(lengths[item])
        fitting = open_spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            chosen = spaces[space].pop()
            if not spaces[space]:
                open_spaces ^= 1 << space
        else:
            space, chosen = capacity, len(fill)
            fill.append(0)
        bins[item], offsets[item] = chosen, fill[chosen]
        fill[chosen] += size
        left = space - size
        if left:
            if not spaces[left]:
                open_spaces |= 1 << left
            spaces[left].append(chosen)
    return bins, offsets, np.asarray(fill, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_bucket: int = PIECES_PER_BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` (flat columns, with ``length`` from 1 to capacity) with sequence_id and offset.

    Columns of those two names are replaced. Pieces are dealt to buckets of bounded size by a
    hash of the row and its place, and each bucket is packed best-fit decreasing. A bucket whose count equals its dual-feasible bound is
    certified and keeps its bins, all but the emptiest; of a bucket with a gap
    only full bins stay. What does not stay is dealt to new buckets and packed
    again, ``rounds`` times at most. Full bins and certified ones never move, so
    each round starts from the rest alone. An empty table gives no rows.
    """
    pieces = pieces.drop("sequence_id", "offset", "_settled", "_bucket")
    fields = pieces.schema.names
    rows = stored(pieces, "pieces")
    total = rows.count()
    result = None
    schema = rows.select(
        *fields,
        F.lit(0).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        F.lit(True).alias("_settled"),
    ).schema

    for turn in range(rounds + 1):
        buckets = max(1, -(-total // per_bucket))
        last = turn == rounds or (turn > 0 and buckets == 1)

        def one_bucket(key: tuple, frame: pa.Table) -> pa.Table:
            bucket = key[0].as_py()
            frame = frame.select(fields).sort_by([(name, "ascending") for name in fields])
            lengths = frame["length"].to_numpy().astype(np.int64)
            bins, offsets, fill = best_fit(lengths, capacity)
            bound = least_bins(np.bincount(lengths, minlength=capacity + 1), capacity)
            if len(fill) == bound:
                settled = np.ones(len(fill), bool)
                settled[np.argmin(fill)] = fill.min() == capacity
            else:
                settled = fill == capacity
            numbers = (np.int64(turn) << np.int64(58)) + (np.int64(bucket) << 24) + bins
            for name, values in (("sequence_id", numbers), ("offset", offsets), ("_settled", settled[bins])):
                frame = frame.append_column(name, pa.array(values))
            return frame

        # With the place of the row in the stored table, equal rows are dealt out too.
        dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id(), *fields), F.lit(buckets)))
        packed = stored(dealt.groupBy("_bucket").applyInArrow(one_bucket, schema), "packed")
        kept = (packed if last else packed.filter("_settled")).drop("_settled")
        result = kept if result is None else result.unionByName(kept)
        if last:
            return result
        rows = packed.filter("NOT _settled").select(*fields)
        total = rows.count()
        if not total:
            return result
    return result
