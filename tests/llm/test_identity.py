"""What tells texts, sets, vectors and rows apart; bounds on what is gathered; names that clash."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from packetlake.llm import chunkreuse, factorization, forest, minhash, mixture, packing
from packetlake.llm.common import maybe_member, tokenizer_path, unused


def thue_morse(n, letters):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_chunks_that_alternate_are_told_apart(spark):
    texts = [thue_morse(2048, "b "), thue_morse(2048, " b"), thue_morse(2048, "b "), thue_morse(4096, "xy") + " end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    library = Tokenizer.from_file(tokenizer_path())
    for r in chunkreuse.encode_documents(docs, tokenizer_path()).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == library.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_words_and_shingles_that_alternate_are_told_apart(spark):
    one, other = thue_morse(1024, "ab"), thue_morse(1024, "ba")
    sentence, reverse = (" ".join(t) for t in (thue_morse(1024, "cd"), thue_morse(1024, "dc")))
    docs = spark.createDataFrame(list(enumerate([one, other, one, f"{one} x y", f"{other} x y"])), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=4).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    keys = minhash.set_keys(*minhash.shingle_sets(pa.array([sentence, reverse]), 1024))
    assert keys[0] != keys[1]


@pytest.mark.parametrize("k", [1, 4, 5])
def test_shingle_sets_have_the_size_of_sets_of_words(k):
    rng = random.Random(k)
    texts = [" ".join(rng.choices("aAbBc", k=rng.randint(0, 30))) for _ in range(200)] + [None, "", " x "]
    shingle, begins = minhash.shingle_sets(pa.array(texts), k)
    for i, text in enumerate(texts):
        words = (text or "").lower().split()
        expected = {tuple(words[j : j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
        assert begins[i + 1] - begins[i] == len(expected) == len(set(shingle[begins[i] : begins[i + 1]].tolist()))


def test_sets_with_one_number_are_told_apart(spark, monkeypatch):
    plain = minhash.set_keys
    monkeypatch.setattr(minhash, "set_keys", lambda s, b, seed=minhash.SEED: np.where(np.diff(b) > 0, 7, 0) if seed == minhash.SEED else plain(s, b, seed))
    texts = [" ".join(f"{n}{i}" for i in range(30)) for n in "abcab"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = minhash.sets_of(minhash.signed(docs, 4).selectExpr("*", "set_key AS own_key")).collect()
    if len(rows) == 1:  # workers see the replaced function
        assert rows[0].lo != rows[0].hi
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=4).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 0, 4: 1}


def plain_vectors(rows):
    def cos(a, b):
        return np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))

    n = len(rows)
    linked = [(i, j) for i in range(n) for j in range(i) if rows[i][2] == rows[j][2] and cos(rows[i][1], rows[j][1]) >= 0.98]
    label = list(range(n))
    for _ in range(n):
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    least = {c: min(rows[i][0] for i in range(n) if label[i] == c) for c in set(label)}
    links = [sum(i in p for p in linked) for i in range(n)]
    return sorted((rows[i][0], links[i], least[label[i]]) for i in range(n))


def test_repeated_vector_ids_do_not_link_labels(spark):
    o, v, w = [1.0, 0.0, 0.0], [0.1, 0.995, 0.0], [0.1, 0.0, 0.995]
    rows = [(5, o, "a"), (5, v, "b"), (6, w, "a"), (7, o, "b"), (5, o, "a"), (9, v, "b"), (3, o, "a")]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain_vectors(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_forest_splits_find_every_link(spark, monkeypatch):
    """Trees of many levels, dense leaves and several blocks a leaf, against all pairs."""
    monkeypatch.setattr(forest, "LEAF", 16)
    monkeypatch.setattr(forest, "BLOCK", 24)
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + rng.normal(size=24) * 0.02 * (i % 5)).tolist(), "ab"[i % 2]) for i in range(420)]
    rows += [(1000 + i, (centres[0] + rng.normal(size=24) * 0.005).tolist(), "a") for i in range(80)]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain_vectors(rows)


@pytest.mark.parametrize("subtree", [48, 200, 1000])
def test_forest_nodes_split_within_a_task_find_every_link(spark, monkeypatch, subtree):
    """Nodes split by jobs first, then by one task each, and dense leaves above and below that size, against all pairs."""
    for name, value in (("LEAF", 16), ("BLOCK", 24), ("SUBTREE", subtree)):
        monkeypatch.setattr(forest, name, value)
    rng = np.random.default_rng(13)
    centres = rng.normal(size=(60, 24))
    rows = [(i, (centres[i % 60] + rng.normal(size=24) * 0.02 * (i % 5)).tolist(), "ab"[i % 2]) for i in range(420)]
    rows += [(1000 + i, (centres[0] + rng.normal(size=24) * 0.005).tolist(), "a") for i in range(80)]
    rows += [(2000 + i, rng.normal(size=8).tolist(), "c") for i in range(40)] + [(3000 + i, rows[i][1], "b") for i in range(0, 40, 2)]
    got = forest.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == plain_vectors(rows)


def test_forest_hands_a_vector_on_once_per_tree(spark, monkeypatch):
    """A vector that is in many leaves is handed on with their names, and further levels of a small node take no jobs."""
    monkeypatch.setattr(forest, "LEAF", 16)
    rng = np.random.default_rng(14)
    jobs = []
    for n in (60, 600):
        points = spark.createDataFrame([(i, "a", rng.normal(size=8).tolist()) for i in range(n)], "rep long, label string, embedding array<double>")
        spark.sparkContext.setJobGroup(f"forest {n}", "leaves")
        found = forest.leaves(points, n, 8, 0.98).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest {n}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert len(found) == n * forest.TREES
    assert jobs[0] == jobs[1]
    assert sum(len(r.leaves) for r in found) > 1.3 * len(found)


def test_near_duplicates_in_blocks(spark, monkeypatch):
    """Posting lists of several components and blocks, against all pairs."""
    monkeypatch.setattr(minhash, "LIST_BLOCK", 16)
    rng = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    texts = []
    for group in range(45):
        own = [f"{group}w{i}" for i in range(rng.choice([20, 30, 70]))]
        for _ in range(rng.randint(1, 3)):
            words = shared + own
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
            texts.append(" ".join(words))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 4]) for i in range(len(w) - 3)})
    label = list(range(len(texts)))
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in texts:
        for i, j in linked:
            label[i] = label[j] = min(label[i], label[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, k=4).collect()} == dict(enumerate(label))


def test_fit_is_bounded_where_a_document_repeats(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text {i}", 5) for i in range(3000)] + [(2, "other", 5)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(factorization, "fit_rows", lambda at, index, value, labels: seen.append(len(labels)))
    factorization.fit(docs, labels, rows=10)
    assert seen == [10]


def test_equal_pieces_are_dealt_to_many_buckets(spark):
    pieces = spark.range(6000).selectExpr("1L AS doc_id", "0 AS piece", "0L AS start", "40L AS length", "7L AS ids_crc32")
    rows = packing.pack(pieces, 128, per_bucket=500).collect()
    fill = {}
    for r in rows:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert len(rows) == 6000 and max(fill.values()) <= 128 and len(fill) == 2000


def test_gain_tells_learned_text_from_other_text(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=50)), "xa") for i in range(30)]
    model = mixture.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([("qqqq zzzz xxxx jjjj",), (" ".join(words[:9]),), (None,)], "text string")
    got = asked.select(mixture.languages_of(model, F.col("text"))["gain"].alias("gain")).collect()
    assert got[0].gain < 0 < got[1].gain and got[2].gain == 0


CLASHING = ["_id", "_label", "_bucket", "_maybe", "_bits", "bucket", "octets", "going_id", "stays", "maybe", "label", "set_key", "key", "Text_Hash"]


@pytest.mark.parametrize("number", range(5))
def test_stages_with_clashing_columns(spark, sf_dir, number):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("doc_id < 150")
    wide = docs.select("*", *[F.lit(i).alias(name) for i, name in enumerate(CLASHING)])
    name, stage = corpus_pipeline.STAGES[number]
    plain, other = stage(spark, docs, sf_dir), stage(spark, wide, sf_dir)
    if number < 4:
        assert other.columns == wide.columns
    assert sorted(map(repr, other.select(plain.columns[:2]).collect())) == sorted(map(repr, plain.select(plain.columns[:2]).collect())), name
    assert stage(spark, wide.limit(0), sf_dir).count() == 0


def test_language_stage_drops_what_no_mixture_explains(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "qqqq zzzz xxxx jjjj " * 20, None), (-2, "жцщ йъэ " * 30, None)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(odd), sf_dir).select("doc_id").collect()}
    assert not kept & {-1, -2}
    known = {r.doc_id for r in docs.filter("lang IS NOT NULL AND length(text) > 200").select("doc_id").collect()}
    assert len(known - kept) <= 0.01 * len(known)


def test_unused_names(spark):
    rows = spark.createDataFrame([(1, 2)], "Maybe int, _maybe int")
    assert unused(rows, "maybe") == "__maybe"
    from pyspark.sql import functions as F

    flagged = maybe_member(rows.selectExpr("Maybe AS bucket", "_maybe AS octets"), rows.selectExpr("Maybe AS key"), F.col("bucket"), "found")
    assert flagged.columns == ["bucket", "octets", "found"] and flagged.first().found
    assert re.fullmatch("_*x", unused(rows, "x"))
