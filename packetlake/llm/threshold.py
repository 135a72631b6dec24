"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetlake.llm.common import stored

#: Rows of one block: candidates, and queries that meet them in one task.
CANDIDATES, QUERIES = 8_192, 2_048
#: First depth of the sorted lists and its growth from step to step.
DEPTH, GROWTH = 16, 8


class SortedLists:
    """One block of candidates with a list per dimension, sorted by value."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids, self.values = ids, values
        order = np.argsort(values, axis=0, kind="stable").T
        self.order = np.ascontiguousarray(order)
        self.sorted = np.take_along_axis(values.T, order, 1)

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best, best first, ties to the smaller id.

        All lists are read to one depth, from the end where their product with
        the query is largest. No unread row can score above the sum of the
        products at that depth; reading stops when the kth score is above it.
        """
        n = len(self.ids)
        up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
        seen = self.ids == own
        left = n - int(seen.sum())
        places, scores = np.zeros(0, np.int64), np.zeros(0, self.values.dtype)
        depth = DEPTH
        while True:
            depth = min(depth, n)
            fresh = np.zeros(n, bool)
            fresh[self.order[up, n - depth :]] = True
            fresh[self.order[down, :depth]] = True
            if depth == n:
                fresh[:] = True
            fresh &= ~seen
            seen |= fresh
            new = np.flatnonzero(fresh)
            left -= len(new)
            places, scores = np.concatenate([places, new]), np.concatenate([scores, self.values[new] @ query])
            if len(places) > k:
                kth = np.partition(scores, len(scores) - k)[len(scores) - k]
                keep = scores >= kth
                places, scores = places[keep], scores[keep]
            bound = (self.sorted[up, n - depth] * query[up]).sum() + (self.sorted[down, depth - 1] * query[down]).sum()
            if not left or (len(places) >= k and scores.min() > bound):
                break
            depth *= GROWTH
        best = np.lexsort((self.ids[places], -scores))[:k]
        return places[best], scores[best]


def exact_type(first: np.ndarray, second: np.ndarray):
    """The quickest number type in which all inner products are exact."""
    most = [int(np.abs(x).max(initial=0)) for x in (first, second)]
    total = most[0] * most[1] * first.shape[1]
    return np.float32 if total < 1 << 24 else np.float64 if total < 1 << 53 else np.int64


def table_of(lists: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of one width; shorter ones end in zeros."""
    rows = lists.to_pylist()
    out = np.zeros((len(rows), width), np.int64)
    for place, row in enumerate(rows):
        out[place, : len(row)] = row
    return out


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``vectors`` (vec_id, embedding) for each query row.

    Components become floor(scale * x). Rows without vec_id, and vectors that
    are null or hold null or non-finite components, take no part. Shorter vectors count
    as ending in zeros. Candidates and queries are dealt to blocks of bounded
    size; every query meets every block, which keeps its own k best.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite)
    rows = rows.select(
        "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"), is_query.alias("q")
    )
    rows = stored(rows, "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, groups = max(1, math.ceil(sizes["n"] / CANDIDATES)), max(1, math.ceil(sizes["q"] / QUERIES))
    block = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block")
    group = F.pmod(F.xxhash64("vec_id", "v"), F.lit(groups)).cast("int").alias("group")
    candidates = rows.select("vec_id", "v", block, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"))
    queries = rows.filter("q").select("vec_id", "v", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), group)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            width = max(max(map(len, t["v"].to_pylist()), default=0) for t in (left, right)) or 1
            values, asked = table_of(left["v"], width), table_of(right["v"], width)
            kind = exact_type(values, asked)
            lists = SortedLists(left["vec_id"].to_numpy(), values.astype(kind))
            for own, query in zip(right["vec_id"].to_pylist(), asked.astype(kind)):
                places, scores = lists.top(own, query, k)
                out[0] += [own] * len(places)
                out[1] += lists.ids[places].tolist()
                out[2] += scores.astype(np.int64).tolist()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out)})

    best = candidates.groupBy("block", "group").cogroup(queries.groupBy("block", "group")).applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
