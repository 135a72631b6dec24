"""Near-duplicate embeddings: a forest of random splits with overlap, compared within leaves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import components, stored

COSINE = 0.98
TREES = 6
#: Vectors at which a node is a leaf, and vectors of a leaf that one task compares.
LEAF = 512
BLOCK = 1_024
#: Overlap of a split, in standard deviations of the projected distance of a pair at the threshold.
OVERLAP = 1.2
#: Quantiles among which a split looks for the widest gap, so that it does not cut a dense cloud.
QUANTILES = tuple(q / 100 for q in range(25, 80, 5))
#: A node that keeps this share of its parent (a dense cloud inside the overlap) is a leaf of any size.
DENSE = 0.9
#: Most vectors of a node that one task splits to its leaves, and bytes of them.
SUBTREE, SUBTREE_BYTES = 1 << 16, 1 << 25
SEED = 5

NODE_LEAVES = "node long, rep long, leaves array<long>, sizes array<long>"
LINKS = "rep long, links long, root long"


def usable(column: str):
    """Not null, not zero, all components finite."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(column).isNotNull() & finite & F.exists(column, lambda x: x != 0), F.lit(False))


def projected(points: DataFrame, depth: int) -> DataFrame:
    """(tree, node, rep, above, projections): every vector at the root of each tree of its label."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            lists = pa.chunked_array([batch.column(2)])
            sizes = pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False)
            flat = np.zeros((len(sizes), TREES * depth))
            for size in np.unique(sizes).tolist():
                if size not in directions:
                    made = np.random.default_rng(SEED + size).normal(size=(size, TREES * depth))
                    directions[size] = made / np.linalg.norm(made, axis=0)
                at = np.flatnonzero(sizes == size)
                x = list_matrix(lists, at, size).astype(np.float64)
                x /= np.abs(x).max(1, keepdims=True)
                flat[at] = x / np.linalg.norm(x, axis=1, keepdims=True) @ directions[size]
            values = flat.reshape(len(sizes) * TREES, depth)
            offsets = np.arange(0, values.size + 1, depth, dtype=np.int32)
            projections = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().astype(np.float32)))
            place = np.repeat(np.arange(len(sizes)), TREES)
            tree = np.tile(np.arange(TREES, dtype=np.int32), len(sizes))
            columns = [batch.column(0).take(pa.array(place)), batch.column(1).take(pa.array(place)), pa.array(tree), projections]
            yield pa.RecordBatch.from_arrays(columns, ["rep", "label", "tree", "p"])

    rows = points.select("rep", "label", "embedding").mapInArrow(project, "rep long, label string, tree int, p array<float>")
    return rows.select(F.xxhash64("tree", "label").alias("node"), "rep", F.lit(None).cast("long").alias("above"), "p")


def leaves(points: DataFrame, n: int, dimensions: int, cosine: float) -> DataFrame:
    """(node, rep, leaves, sizes): the leaves that hold a vector, by the node that one task has split to its leaves.

    Each level splits every large node by a random projection, at the middle
    quantile whose neighbours are farthest apart; vectors within the overlap of
    that value go both ways. All nodes of a level,
    of all trees and labels, are split by the same few jobs, until a node is so
    small that one task does its further levels by the same rule.
    """
    depth = 2 + math.ceil(1.5 * math.log2(max(2.0, n / LEAF)))
    margin = OVERLAP * math.sqrt(2 * (1 - cosine)) / math.sqrt(max(dimensions, 1))
    most = max(LEAF, min(SUBTREE, SUBTREE_BYTES // (8 * max(dimensions, 1))))
    state = stored(projected(points, depth), "nodes")
    done = None
    for level in range(depth + 1):
        sizes = stored(state.groupBy("node").agg(F.count("*").alias("n"), F.max("above").alias("was")), "sizes")
        end = (F.col("n") <= LEAF) | F.coalesce(F.col("n") >= DENSE * F.col("was"), F.lit(False)) | F.lit(level == depth)
        joined = state.join(sizes, "node")
        ended = joined.filter(end).select("node", "rep", F.array("node").alias("leaves"), F.array("n").alias("sizes"))
        within = joined.filter(~end & (F.col("n") <= most)).groupBy("node").applyInArrow(splitter(level, depth, margin), NODE_LEAVES)
        ended = ended.unionByName(within)
        done = ended if done is None else done.unionByName(ended)
        large = ~end & (F.col("n") > most)
        if not sizes.filter(large).limit(1).count():
            return done
        value = F.get("p", F.lit(level))
        stats = joined.filter(large).groupBy("node").agg(F.percentile_approx(value, list(QUANTILES)).alias("q"))
        gaps = F.transform(F.sequence(F.lit(1), F.lit(len(QUANTILES) - 2)), lambda i: F.struct(F.get("q", i + 1) - F.get("q", i - 1), F.get("q", i)))
        stats = stored(stats.select("node", F.array_max(gaps)["col2"].alias("middle")), "splits")
        sides = F.array_compact(
            F.array(F.when(value <= F.col("middle") + margin, F.lit(0)), F.when(value > F.col("middle") - margin, F.lit(1)))
        )
        split = joined.filter(large).join(stats, "node").withColumn("_side", F.explode(sides))
        state = stored(split.select(F.xxhash64("node", "_side", F.lit(level)).alias("node"), "rep", F.col("n").alias("above"), "p"), "nodes")
    return done


def splitter(level: int, depth: int, margin: float):
    """Splits one node, from ``level`` on, to its leaves; the first leaf has the name of the node."""
    leaf_rows = LEAF

    def split(key: tuple, table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        p = list_matrix(table["p"], np.arange(len(rep)), depth).astype(np.float64)
        open_nodes, ended = [(np.arange(len(rep)), table["above"][0].as_py(), level)], []
        while open_nodes:
            rows, above, at = open_nodes.pop()
            n = len(rows)
            if n <= leaf_rows or at == depth or (above is not None and n >= DENSE * above):
                ended.append(rows)
                continue
            value = p[rows, at]
            q = np.sort(value)[[math.ceil(share * n) - 1 for share in QUANTILES]]
            middle = max(zip(q[2:] - q[:-2], q[1:-1]))[1]
            for side in (value <= middle + margin, value > middle - margin):
                if side.any():
                    open_nodes.append((rows[side], n, at + 1))
        sizes = np.array([len(rows) for rows in ended])
        names = np.arange(len(ended), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([key[0].as_py()]).view(np.uint64)
        order = np.argsort(np.concatenate(ended), kind="stable")
        number = np.repeat(np.arange(len(ended)), sizes)[order]
        offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(ended), minlength=len(rep)))]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(values[number])) for values in (names.view(np.int64), sizes)]
        return pa.table([table["node"], table["rep"], *lists], ["node", "rep", "leaves", "sizes"])

    return split


def flat_lists(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, values) of a column of lists."""
    array = lists.combine_chunks()
    return array.offsets.to_numpy(), array.values.to_numpy(zero_copy_only=False)


def gathered(lists: tuple[np.ndarray, np.ndarray], rows: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` values of the lists in ``rows``; a shorter list repeats its last value."""
    offsets, values = lists
    last = offsets[rows + 1] - 1
    return values[np.minimum(offsets[rows][:, None] + np.arange(width), last[:, None])]


def list_matrix(lists: pa.ChunkedArray, rows: np.ndarray, width: int) -> np.ndarray:
    return gathered(flat_lists(lists), rows, width)


def near_pairs(vectors: tuple[np.ndarray, np.ndarray], rows: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs at the threshold among ``rows``, as places in ``rows``."""
    lengths = np.diff(vectors[0])[rows]
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for length in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == length)
        x = gathered(vectors, rows[at], length)
        scale = np.linalg.norm(x, axis=1)
        cos = (x @ x.T) / np.outer(scale, scale)
        left, right = np.nonzero(np.triu(cos >= cosine, 1))
        pairs.append((at[left], at[right]))
    left, right = (np.concatenate(side) for side in zip(*pairs))
    return left, right


def first_shared(leaf: int, held: tuple[np.ndarray, np.ndarray], rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whether ``leaf`` is the smallest that holds both vectors of a pair; each smaller leaf is a bit of its vectors."""
    used = np.flatnonzero(np.bincount(left, minlength=len(rows)) + np.bincount(right, minlength=len(rows)))
    lists = gathered(held, rows[used], int(np.diff(held[0])[rows[used]].max()))
    place, column = np.nonzero(lists < leaf)
    smaller = lists[place, column]
    names = np.unique(smaller)
    out = np.ones(len(left), bool)
    if not len(names):
        return out
    number = np.searchsorted(names, smaller)
    bits = np.zeros((len(rows), -(-len(names) // 64)), np.uint64)
    np.bitwise_or.at(bits, (used[place], number >> 6), np.uint64(1) << (number & 63).astype(np.uint64))
    step = max(1, (1 << 20) // bits.shape[1])
    for low in range(0, len(left), step):
        out[low : low + step] = ~(bits[left[low : low + step]] & bits[right[low : low + step]]).any(1)
    return out


def least_places(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``count`` places the smallest one that pairs lead to."""
    group = np.arange(count)
    while True:
        least = np.minimum(group[left], group[right])
        before = group.copy()
        np.minimum.at(group, left, least)
        np.minimum.at(group, right, least)
        group = group[group]
        if (before == group).all():
            return group


def links_table(rep: np.ndarray, links: np.ndarray, left: np.ndarray, right: np.ndarray) -> pa.Table:
    """(rep, links, root) of the vectors in the pairs."""
    group = least_places(len(rep), left, right)
    used = np.unique(np.concatenate([left, right]))
    root = rep.copy()
    np.minimum.at(root, group[used], rep[used])
    return pa.table({"rep": rep[used], "links": links[used], "root": root[group[used]]})


def compare_leaves(points: DataFrame, found: DataFrame, cosine: float) -> DataFrame:
    """(rep, links, root): links counted once per pair, and the smallest vector of its group in the node or block.

    All leaves of a node are compared by one task, which has each vector once.
    Leaves of several blocks are few, and compared in pairs of blocks.
    """
    held = F.collect_list(F.struct("node", F.col("leaves").alias("own"), "sizes")).alias("held")
    lists = found.groupBy("rep").agg(F.sort_array(F.flatten(F.collect_list("leaves"))).alias("leaves"), held)
    rows = stored(points.join(lists, "rep").select("rep", "size", "embedding", "leaves", "held"), "points")
    each = rows.withColumn("_held", F.explode("held")).select("rep", "size", "embedding", "leaves", "_held.*")
    small = each.withColumn("own", F.filter("own", lambda _, i: F.get("sizes", i) <= BLOCK)).filter(F.size("own") > 0).drop("sizes")
    zipped = F.filter(F.arrays_zip("own", "sizes"), lambda x: x["sizes"] > BLOCK)
    dealt = (
        each.withColumn("_leaf", F.explode(zipped))
        .withColumn("_blocks", F.ceil(F.col("_leaf.sizes") / BLOCK).cast("int"))
        .withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .select(
            F.col("_leaf.own").alias("leaf"), F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), "_own", "rep", "size", "embedding", "leaves"
        )
    )

    def compare_node(key: tuple, table: pa.Table) -> pa.Table:
        rep, size = (table[c].to_numpy() for c in ("rep", "size"))
        vectors, held, own = (flat_lists(table[c]) for c in ("embedding", "leaves", "own"))
        names, holder = own[1][own[0][0] : own[0][-1]], np.repeat(np.arange(len(rep)), np.diff(own[0]))
        order = np.argsort(names, kind="stable")
        names, holder = names[order], holder[order]
        links, lefts, rights = np.zeros(len(rep), np.int64), [holder[:0]], [holder[:0]]
        for members in np.split(np.arange(len(names)), np.flatnonzero(np.diff(names)) + 1):
            at, leaf = holder[members], names[members[0]]
            left, right = near_pairs(vectors, at, cosine)
            if not len(left):
                continue
            first = first_shared(leaf, held, at, left, right)
            left, right = left[first], right[first]
            np.add.at(links, at[left], size[at[right]])
            np.add.at(links, at[right], size[at[left]])
            # A star for each group of the leaf holds the same as its pairs.
            used, group = np.unique(np.concatenate([left, right])), least_places(len(at), left, right)
            lefts.append(at[used])
            rights.append(at[group[used]])
        return links_table(rep, links, np.concatenate(lefts), np.concatenate(rights))

    def compare_blocks(key: tuple, table: pa.Table) -> pa.Table:
        leaf, i, j = (k.as_py() for k in key)
        own, rep, size = (table[c].to_numpy() for c in ("_own", "rep", "size"))
        vectors, held = (flat_lists(table[c]) for c in ("embedding", "leaves"))
        left, right = near_pairs(vectors, np.arange(len(rep)), cosine)
        wanted = (np.minimum(own[left], own[right]) == i) & (np.maximum(own[left], own[right]) == j)
        left, right = left[wanted], right[wanted]
        links = np.zeros(len(rep), np.int64)
        if len(left):
            first = first_shared(leaf, held, np.arange(len(rep)), left, right)
            left, right = left[first], right[first]
        np.add.at(links, left, size[right])
        np.add.at(links, right, size[left])
        return links_table(rep, links, left, right)

    within = small.groupBy("node").applyInArrow(compare_node, LINKS)
    return within.unionByName(dealt.groupBy("leaf", "_i", "_j").applyInArrow(compare_blocks, LINKS))


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Equal vectors of one label are one class from the start. Vectors that are
    null, zero or hold null or non-finite components, and rows without label or
    vec_id, are linked with nothing. Vectors of different length have no cosine.
    A link is counted in the first leaf that both vectors share, so each counts
    once whatever the number of trees. A repeated vec_id is a vector each time:
    its rows are linked by their own labels and vectors only, and each has the
    smallest vec_id that it reaches.
    """
    rows = vectors.select("vec_id", "embedding", F.col("label").cast("string"))
    rows = rows.withColumn("_ok", usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull())
    good = rows.filter("_ok").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    classes = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"))
    # Numbers of the stored rows; a vec_id may name several vectors.
    points = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    shape = points.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    found = stored(leaves(points, shape["n"], shape["d"] or 1, cosine), "leaves")
    links = stored(compare_leaves(points, found, cosine), "links")
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    placed = points.select("rep", "least").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = stored(placed.join(named, "component").select("rep", "component_id"), "components")
    classes = (
        points.join(counts, "rep", "left")
        .join(named, "rep")
        .select("label", "embedding", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    classes = stored(classes, "classes")
    linked = good.join(classes, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("NOT _ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
