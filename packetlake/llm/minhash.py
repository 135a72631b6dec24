"""Near-duplicate documents: an inverted join on MinHash coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import SLICE_BYTES, components, maybe_member, slices, stored
from packetlake.llm.textarrays import LOWER, as_bytes, mix, placed, word_hashes, words

SHINGLE_WORDS = 5
PERCENT = 80
#: Coordinates of a signature, and how many must be equal for a pair to be confirmed.
#: A pair of similarity s is not looked at with P(Bin(40, s) < 18): 2.0e-7 at 0.80,
#: 7.6e-8 at 0.81, 2.7e-8 at 0.82.
COORDINATES, MATCHES = 40, 18
#: Documents of one posting list that one task compares with each other.
LIST_BLOCK = 512
SEED, CHECK_SEED = 11, 0x9E3779B97F4A7C15


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the k-word shingles of all texts, and where each text's begin (end last).

    A text of fewer words has their whole sequence as its one shingle.
    """
    data, begins = as_bytes(texts)
    data = LOWER[data]
    starts, ends, first = words(data, begins)
    word = word_hashes(data, starts, ends)
    counts = np.diff(first)
    row = np.repeat(np.arange(len(counts)), np.where(counts >= k, counts - k + 1, np.minimum(counts, 1)))
    number = np.arange(len(row)) - np.searchsorted(row, np.arange(len(counts)))[row]
    at = first[row] + number
    size = np.minimum(k, first[row + 1] - at)
    shingle = np.zeros(len(row), np.uint64)
    # A text of fewer than k words is one shingle of them all, so no loop is longer than k.
    for step in range(min(k, int(size.max(initial=0)))):
        part = placed(word[np.minimum(at + step, len(word) - 1)], np.full(1, step))
        shingle += np.where(step < size, part, np.uint64(0))
    shingle = mix(shingle + size.astype(np.uint64))
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[fresh], shingle[fresh]
    return shingle, np.searchsorted(row, np.arange(len(counts) + 1))


def set_keys(shingle: np.ndarray, begins: np.ndarray, seed: int = SEED) -> np.ndarray:
    """One number for each set, whatever its order; 0 for an empty set."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(shingle ^ np.uint64(seed)), dtype=np.uint64)])
    size = np.diff(begins)
    return np.where(size > 0, mix(sums[begins[1:]] - sums[begins[:-1]] + size.astype(np.uint64)) | np.uint64(1), 0).view(np.int64)


def signatures(shingle: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(texts, COORDINATES) minima of as many hash functions; texts without shingles are left out."""
    numbers = np.random.default_rng(SEED).integers(1, 1 << 63, (COORDINATES, 2), dtype=np.uint64) | np.uint64(1)
    at = begins[:-1][np.diff(begins) > 0]
    columns = []
    for factor, offset in numbers:
        value = (shingle * factor + offset) ^ (shingle >> np.uint64(29))
        columns.append(np.minimum.reduceat((value * factor >> np.uint64(32)).astype(np.uint32), at).view(np.int32))
    return np.stack(columns, 1)


def signed(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, set_key, check, signature) for every row of ``docs`` (doc_id, text).

    ``check`` is a second number of the set, so that sets are told apart by 127 bits.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(2)):
                part = batch.slice(low, high - low)
                shingle, begins = shingle_sets(part.column(2), k)
                size = np.diff(begins)
                flat = signatures(shingle, begins).ravel() if len(shingle) else np.zeros(0, np.int32)
                offsets = np.concatenate([[0], np.cumsum(np.where(size > 0, COORDINATES, 0))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                keys = [pa.array(set_keys(shingle, begins, seed)) for seed in (SEED, CHECK_SEED)]
                columns = [part.column(0), part.column(1), pa.array(size), *keys, lists]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "set_key", "check", "signature"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_hash long, n_shingles long, set_key long, check long, signature array<int>")


def prefixes(sets: DataFrame) -> DataFrame:
    """(posting, set_key, weight): the posting lists by which all pairs with MATCHES equal coordinates meet.

    A posting is a coordinate with its value. Postings of one set only cannot
    collide and are dropped; a set left with fewer than MATCHES is done. Of the
    others, ordered from rare to frequent, all but the last MATCHES - 1 are
    kept: two sets with MATCHES equal coordinates share one of those, and the
    long lists at the end are skipped. ``weight`` counts a set's collisions.
    """
    posting = F.xxhash64("place", "value").alias("posting")
    posted = sets.select("set_key", F.posexplode("signature").alias("place", "value")).select("set_key", posting)
    often = stored(posted.groupBy("posting").agg(F.count("*").alias("n")).filter("n > 1"), "postings")
    ranked = (
        posted.join(often, "posting")
        .groupBy("set_key")
        .agg(F.sort_array(F.collect_list(F.struct("n", "posting"))).alias("list"), F.sum("n").alias("weight"))
        .filter(F.size("list") >= MATCHES)
    )
    kept = F.slice("list", F.lit(1), F.size("list") - (MATCHES - 1))
    return ranked.select("set_key", "weight", F.explode(kept).alias("p")).select("p.posting", "set_key", "weight")


def equal_coordinates(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def texts_of(wanted: DataFrame, docs: DataFrame, owners: DataFrame, k: int) -> DataFrame:
    """(set_key, text) for the set keys ``wanted``; only their documents leave their task.

    ``owners`` (set_key, owner, own_key) names a document of each set, and the
    number that its text gives.
    """
    wanted = stored(wanted.distinct().join(owners, "set_key"), "wanted")
    rows = docs.select(F.col("doc_id").cast("long").alias("owner"), F.col("text").cast("string"))
    some = maybe_member(rows, wanted.select(F.col("owner").alias("key")), F.col("owner"), "maybe").filter("maybe")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                own = pa.array(set_keys(*shingle_sets(part.column(1), k)))
                yield part.filter(pc.equal(own, part.column(0))).select(["set_key", "text"])

    found = some.select("owner", "text").join(wanted, "owner").select("own_key", "text", "set_key")
    # A document may stand in the table more than once.
    return stored(found.mapInArrow(keyed, "set_key long, text string").dropDuplicates(["set_key"]), "texts")


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The ``pairs`` (a, b) of set keys whose whole sets reach ``percent``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3)))
            for low, high in size_slices(both.to_pylist()):
                part = batch.slice(low, high - low)
                rows, values, sizes = [], [], []
                for column in (2, 3):
                    shingle, begins = shingle_sets(part.column(column), k)
                    rows.append(np.repeat(np.arange(high - low), np.diff(begins)))
                    values.append(shingle)
                    sizes.append(np.diff(begins))
                row, value = np.concatenate(rows), np.concatenate(values)
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                twice = np.flatnonzero((row[1:] == row[:-1]) & (value[1:] == value[:-1]))
                shared = np.bincount(row[twice], minlength=high - low)
                union = sizes[0] + sizes[1] - shared
                yield part.select([0, 1]).filter(pa.array(100 * shared >= percent * union))

    left = texts.select(F.col("set_key").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_key").alias("b"), F.col("text").alias("text_b"))
    paired = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return paired.mapInArrow(compare, "a long, b long")


def open_links(lists: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links between different components within each posting list.

    ``lists`` (posting, n, set_key, component, postings, signature, text). A long
    list is cut into blocks, and each pair of blocks is compared by its own task:
    signatures first, then whole sets. A pair is looked at in the first list that
    it shares, and one link for each set and component is enough. Pairs that are
    no links never leave the task.
    """
    blocks = F.ceil(F.col("n") / LIST_BLOCK).cast("int")
    dealt = (
        lists.withColumn("_blocks", blocks)
        .withColumn("_own", F.pmod(F.xxhash64("set_key"), F.col("_blocks")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
        .withColumns({"_i": F.least("_own", "_other"), "_j": F.greatest("_own", "_other")})
        .select("posting", "_i", "_j", "_own", "set_key", "component", "postings", "signature", "text")
    )

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        posting, i, j = (part.as_py() for part in key)
        own, keys, part = (rows[c].to_numpy() for c in ("_own", "set_key", "component"))
        flat = rows["signature"].combine_chunks().flatten().to_numpy().reshape(-1, COORDINATES)
        shared_lists = [set(p) for p in rows["postings"].to_pylist()]
        sets: dict[int, np.ndarray] = {}

        def set_of(place: int) -> np.ndarray:
            if place not in sets:
                sets[place] = shingle_sets(rows["text"].slice(place, 1).combine_chunks(), k)[0]
            return sets[place]

        first, second = np.flatnonzero(own == i), np.flatnonzero(own == j)
        out: list[tuple[int, int]] = []
        for at in first.tolist():
            rest = second[second > at] if i == j else second
            rest = rest[part[rest] != part[at]]
            if not len(rest):
                continue
            rest = rest[(flat[rest] == flat[at]).sum(1) >= MATCHES]
            rest = [r for r in rest.tolist() if min(shared_lists[at] & shared_lists[r]) == posting]
            if not rest:
                continue
            mine, others = set_of(at), [set_of(r) for r in rest]
            size = np.array([len(o) for o in others])
            value = np.concatenate(others)
            place = np.minimum(np.searchsorted(mine, value), len(mine) - 1)
            both = np.add.reduceat((mine[place] == value).astype(np.int64), np.cumsum(size) - size)
            linked = np.array(rest)[100 * both >= percent * (size + len(mine) - both)]
            _, one = np.unique(part[linked], return_index=True)
            out += [(int(keys[at]), int(keys[r])) for r in linked[one]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return dealt.groupBy("posting", "_i", "_j").applyInArrow(compare, "a long, b long").distinct()


def size_slices(sizes: list[int], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` in all (a larger row is alone)."""
    low, held = 0, 0
    for row, size in enumerate(sizes):
        if row > low and held + size > limit:
            yield low, row
            low, held = row, 0
        held += size
    if low < len(sizes):
        yield low, len(sizes)


def sets_of(marked: DataFrame) -> DataFrame:
    """One row per set: its document with the least doc_id, and the range of its second number."""
    owner = F.min(F.struct("doc_id", "text_hash", "signature", "own_key")).alias("o")
    usable = marked.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    found = usable.groupBy("set_key").agg(owner, F.min("check").alias("lo"), F.max("check").alias("hi"))
    return found.select("set_key", F.col("o.doc_id").alias("owner"), "o.text_hash", "o.signature", "o.own_key", "lo", "hi")


def near_duplicates(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Documents with equal sets are one class from the start, so copies never meet
    in pairs. Sets that share a posting list are first confirmed against the
    list's set with most collisions, which joins large groups at the cost of one
    pair a document. Only lists that still hold more than one component are
    compared further, so no link between components is lost among pairs with
    MATCHES equal coordinates. Of links at the limit of 80 percent, the worst
    case, one in 4.9 million has fewer and is found only through other sets.
    Texts without a word, and rows without doc_id, are linked with nothing.
    """
    return decided(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept")


def decided(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """As ``near_duplicates``, with text_hash (xxhash64 of the text) and ``chosen`` beside.

    Of each component the rows of one doc_id and text are chosen, also where a
    doc_id has several texts: the least doc_id, and of its texts the least hash.
    """
    marked = stored(signed(docs, k).withColumn("own_key", F.col("set_key")), "signed")
    sets = stored(sets_of(marked), "sets")
    clashing = sets.filter("lo <> hi").select("set_key")
    if clashing.limit(1).count():
        # Different sets with one number: each gets another, from both of its numbers.
        clashing = clashing.withColumn("clashes", F.lit(True))
        other = F.when(F.col("clashes"), F.xxhash64("set_key", "check")).otherwise(F.col("set_key"))
        marked = stored(marked.join(clashing, "set_key", "left").withColumn("set_key", other).drop("clashes"), "signed")
        sets = stored(sets_of(marked), "sets")
    owners, signs = sets.select("set_key", "owner", "own_key"), sets.select("set_key", "signature")

    posted = stored(prefixes(sets), "prefixes")
    most = F.max(F.struct("weight", "set_key"))
    lists = stored(posted.groupBy("posting").agg(most.alias("m"), F.count("*").alias("n")).filter("n > 1").select("posting", "n", F.col("m.set_key").alias("a")), "lists")
    stars = posted.join(lists, "posting").filter("a <> set_key").select("a", F.col("set_key").alias("b")).distinct()
    matched = (
        stars.join(signs.select(F.col("set_key").alias("a"), F.col("signature").alias("sa")), "a")
        .join(signs.select(F.col("set_key").alias("b"), F.col("signature").alias("sb")), "b")
        .filter(equal_coordinates("sa", "sb") >= MATCHES)
        .select("a", "b")
    )
    matched = stored(matched, "pairs")
    both = matched.select(F.col("a").alias("set_key")).unionByName(matched.select(F.col("b").alias("set_key")))
    links = stored(confirmed(matched, texts_of(both, docs, owners, k), k, percent), "confirmed")
    found = stored(components(links).withColumnRenamed("node", "set_key"), "components")

    placed = posted.join(lists.select("posting", "n"), "posting").join(found, "set_key", "left")
    placed = stored(placed.select("posting", "n", "set_key", F.coalesce("component", "set_key").alias("component")), "placed")
    mixed = placed.groupBy("posting").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("posting")
    rest = stored(placed.join(stored(mixed, "mixed"), "posting"), "mixed")
    members = rest.groupBy("set_key").agg(F.collect_set("posting").alias("postings"))
    members = members.join(signs, "set_key").join(texts_of(rest.select("set_key"), docs, owners, k), "set_key")
    more = stored(open_links(rest.join(stored(members, "members"), "set_key"), k, percent), "links")
    if more.limit(1).count():
        found = stored(components(links.unionByName(more)).withColumnRenamed("node", "set_key"), "components")

    classes = sets.select("set_key", "owner", "text_hash").join(found, "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    classes = stored(classes, "classes")
    least = stored(classes.groupBy("component").agg(F.min(F.struct("owner", "text_hash")).alias("least")), "least")
    named = stored(classes.join(least, "component").select("set_key", F.col("least.owner").alias("least"), F.col("least.text_hash").alias("least_hash")), "named")
    rows = marked.select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key"))
    yes = F.lit(True)
    alone = rows.filter("set_key IS NULL").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), yes.alias("kept"), yes.alias("chosen"))
    kept = F.col("doc_id") == F.col("least")
    return (
        rows.filter("set_key IS NOT NULL")
        .join(named, "set_key")
        .select("doc_id", "text_hash", "n_shingles", F.col("least").alias("component_id"), kept.alias("kept"), (kept & (F.col("text_hash") == F.col("least_hash"))).alias("chosen"))
        .unionByName(alone)
    )
