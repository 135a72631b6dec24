"""Ranked lexical search without random access: impact-sorted lists, score intervals, exact ranks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetlake.llm.common import slices, stored

#: Bytes of item text searched for together. All items of a group go to every task; groups follow one another.
ITEM_BYTES = 4 << 20
#: Documents and postings at which a block's lists are sorted and searched.
BLOCK_DOCUMENTS, BLOCK_POSTINGS = 8_192, 1 << 20
#: Postings of each list that the first read takes; every further read takes twice as many.
FIRST_READ = 64

#: What separates terms, and the only letters that change case.
SEPARATORS = (*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TERM_BYTES = bytearray(bytes.maketrans(UPPER, UPPER.lower()))
for _byte in SEPARATORS:
    TERM_BYTES[_byte] = 0x20


def terms(text: bytes | None) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return (text or b"").translate(TERM_BYTES).split()


def forward_lists(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts): documents with a term, their number of terms, and counts of those in ``vocabulary``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                n, held, found = [], [0], []
                for text in part.column(1).to_pylist():
                    words = terms(text)
                    n.append(len(words))
                    found += [v for v in map(vocabulary.get, words) if v is not None]
                    held.append(len(found))
                row = np.repeat(np.arange(high - low), np.diff(held))
                key, counts = np.unique(row * max(1, len(vocabulary)) + np.array(found, np.int64), return_counts=True)
                row, term = np.divmod(key, max(1, len(vocabulary)))
                offsets = pa.array(np.searchsorted(row, np.arange(high - low + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c.astype(np.int32))) for c in (term, counts)]
                rows = pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])
                yield rows.filter(pa.array(np.array(n, np.int64) > 0))

    rows = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


class Lists:
    """Impact-sorted lists of one block of documents: one list per term, greatest impact first."""

    def __init__(self, batches: list[pa.RecordBatch], weights: np.ndarray, documents: int, length: int):
        rows = pa.Table.from_batches(batches).combine_chunks()
        self.doc_id = rows["doc_id"].to_numpy()
        n = rows["n"].to_numpy()
        m = 100 - 75 + 75 * n * documents // length
        sizes = np.concatenate([np.diff(c.offsets.to_numpy()) for c in rows["terms"].chunks])
        doc = np.repeat(np.arange(len(n)), sizes)
        term, count = (np.concatenate([c.flatten().to_numpy() for c in rows[name].chunks]).astype(np.int64) for name in ("terms", "counts"))
        impact = weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m[doc]))
        some = np.flatnonzero(impact > 0)
        order = some[np.lexsort((doc[some], -impact[some], term[some]))]
        self.doc, self.impact = doc[order], impact[order]
        self.begins = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def best(self, wanted: np.ndarray, times: np.ndarray, k: int, least: int, first_read: int = FIRST_READ) -> tuple[np.ndarray, np.ndarray]:
        """(score, doc_id) of the k best documents that score ``least`` or more; equal scores by doc_id.

        Each round reads on in every list of ``wanted`` terms. What a document
        has been seen with is its lower bound; the next impact of each list it
        was not seen in makes the upper one. It goes on until no unseen document
        and no seen one outside can reach the kth lower bound, and every one that
        can has equal bounds.
        """
        start = self.begins[wanted]
        size = self.begins[wanted + 1] - start
        lower = np.zeros(len(self.doc_id), np.int64)
        seen = np.zeros((len(wanted), len(lower)), bool)
        depth, step = 0, first_read
        while True:
            low, high = np.minimum(depth, size), np.minimum(depth + step, size)
            read = np.repeat(np.arange(len(wanted)), high - low)
            at = np.arange(len(read)) - np.repeat(np.cumsum(high - low) - high, high - low) + start[read]
            doc = self.doc[at]
            lower += np.bincount(doc, self.impact[at] * times[read], len(lower)).astype(np.int64)
            seen[read, doc] = True
            depth, step = depth + step, step * 2
            unread = depth < size
            ahead = np.where(unread, self.impact[np.where(unread, start + depth, 0)] * times, 0) if len(self.impact) else np.zeros(len(wanted), np.int64)
            bound = max(least, int(np.partition(lower, -k)[-k]) if len(lower) >= k else 1)
            if ahead.sum() >= bound:
                continue
            able = np.flatnonzero(lower + ahead.sum() >= bound)
            missing = (~seen[:, able] * ahead[:, None]).sum(0)
            able, missing = able[lower[able] + missing >= bound], missing[lower[able] + missing >= bound]
            if not missing.any():
                score, doc_id = lower[able], self.doc_id[able]
                order = np.lexsort((doc_id, -score))[:k]
                return score[order], doc_id[order]


def search(forward: DataFrame, items: list[tuple[int, np.ndarray, np.ndarray]], weights: np.ndarray, documents: int, length: int, k: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each task for each item (number, terms, repeats).

    A task cuts its documents into blocks and searches one after another; the
    kth score that an item has reached bounds the blocks that follow.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {number: (np.zeros(0, np.int64), np.zeros(0, np.int64)) for number, _, _ in items}
        for block in blocks(batches):
            lists = Lists(block, weights, documents, length)
            for number, wanted, times in items:
                score, doc_id = best[number]
                found = lists.best(wanted, times, k, max(1, int(score[-1])) if len(score) == k else 1)
                score, doc_id = np.concatenate([score, found[0]]), np.concatenate([doc_id, found[1]])
                order = np.lexsort((doc_id, -score))[:k]
                best[number] = score[order], doc_id[order]
        held = [(number, d, s) for number, (score, doc_id) in best.items() for s, d in zip(score.tolist(), doc_id.tolist())]
        columns = list(zip(*held)) or [(), (), ()]
        types = (pa.int32(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item", "doc_id", "score"])

    return forward.mapInArrow(run, "item int, doc_id long, score long")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    held, rows, postings = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        postings += len(batch.column(2).flatten())
        if rows >= BLOCK_DOCUMENTS or postings >= BLOCK_POSTINGS:
            yield held
            held, rows, postings = [], 0, 0
    if held:
        yield held


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents above 0 for each row of ``items`` (item_id, text).

    Scores are whole numbers, so ranks are exact; equal scores rank by doc_id.
    Rows of ``docs`` (doc_id, text) without doc_id take no part, a repeated
    doc_id is a document each time, null or termless text is in no count.
    Repeated items count once; an item_id with two texts is two items; an item
    without terms, or with terms that no document has, gets no row.

    Documents are read once and kept as counts of the items' terms. Blocks of
    documents, not terms, are the unit of work, so a term that every document
    holds is cut like any other. Items are searched for in groups of bounded
    size, which the driver and every task hold.
    """
    asked = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    groups = 1 + size // ITEM_BYTES
    deal = F.pmod(F.xxhash64("item_id", "text"), F.lit(groups))
    parts = [_group(docs, asked.filter(deal == g).collect(), k) for g in range(groups)]
    return reduce(DataFrame.unionByName, parts)


def _group(docs: DataFrame, asked: list, k: int) -> DataFrame:
    """Results of one group of items."""
    spark = docs.sparkSession
    vocabulary: dict[bytes, int] = {}
    wanted, names = [], []
    for number, row in enumerate(asked):
        own = [vocabulary.setdefault(term, len(vocabulary)) for term in terms(row.text.encode())]
        names.append((number, row.item_id))
        if own:
            wanted.append((number, *np.unique(own, return_counts=True)))
    forward = stored(forward_lists(docs, vocabulary), "forward-lists")
    total = forward.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    holding = np.zeros(len(vocabulary), np.int64)
    for term, n in forward.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holding[term] = n
    weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * df + 1))) for df in holding.tolist()], np.int64)
    found = search(forward.filter(F.size("terms") > 0), wanted, weights, total.documents, max(1, total.length), k)
    # The first window keeps k rows an item in each task before the shuffle.
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = spark.createDataFrame(names, "item int, item_id long")
    return ranked.join(named, "item").select("item_id", "rank", "doc_id", "score")
