"""Operators against brute force, the library they follow, and odd input."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from packetlake.llm import chunkreuse, factorization, forest, idfiles, markov, minhash, mixture, packing, queries, skipchain, threshold
from packetlake.llm.common import components, tokenizer_path
from packetlake.llm.wordpieces import WordPieces

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double"
ODD = ["", "   ", "\n", "!!! ???", "\x1c a\x1db <|endoftext|> c<|startoftext|>d", "ΑΣ ΌΔΟΣ é ½ 一二  x", "it's WE'LL 'tis 12.50", "a" * 5000]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzéß", k=rng.randint(1, 9))) for _ in range(300)]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(40)]
    near = []
    for _ in range(30):  # a group around one text, at all distances
        some = made[0].split()[:120]
        for _ in range(rng.randint(0, 12)):
            some[rng.randrange(len(some))] = rng.choice(words)
        near.append(" ".join(some))
    return [*made, *near, made[3], made[3], made[5] + " tail", *ODD, None, None]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", None if t is None else len(t), 0.5) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[0]], DOCS)


@pytest.fixture(scope="module")
def ids_of(texts):
    library = Tokenizer.from_file(tokenizer_path())
    return {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_word_pieces_equal_library(texts, ids_of):
    own = WordPieces(tokenizer_path())
    for i, packed in enumerate(own.encode([t or "" for t in texts])):
        assert np.frombuffer(packed, "<u4").tolist() == ids_of[i]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, ids_of):
    rows = packing.pack(packing.cut_pieces(docs, tokenizer_path(), 128), 128, per_bucket=60).collect()
    bins = {}
    for r in rows:
        ids = (ids_of[r.doc_id] + [1])[r.start : r.start + r.length]
        assert r.ids_crc32 == crc(ids) and r.length == len(ids)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in bins.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 128
    total = sum(r.length for r in rows)
    assert total == sum(len(v) + 1 for v in ids_of.values()) + len(ids_of[0]) + 1
    assert len(bins) <= -(-total // 128) + 1


def test_least_bins_never_exceeds_a_packing():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = rng.integers(1, 65, rng.integers(1, 200))
        bound = packing.least_bins(np.bincount(lengths, minlength=65), 64)
        assert -(-lengths.sum() // 64) <= bound <= len(packing.best_fit(lengths, 64)[2])
    assert packing.least_bins(np.bincount([33] * 5, minlength=65), 64) == 5


def test_id_files(spark, docs, ids_of, tmp_path):
    path = str(tmp_path / "ids")
    idfiles.write_ids(idfiles.encode_in_order(docs, tokenizer_path()), path)
    rows = idfiles.starts(idfiles.read_ids(spark, path)).collect()
    before = 0
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.ids == ids_of[r.doc_id] + [1] and r.start == before
        before += r.n_tokens


def test_chunk_reuse(docs, ids_of):
    rows = chunkreuse.encode_documents(docs, tokenizer_path()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert np.frombuffer(r.ids, "<u4").tolist() == ids_of[r.doc_id]
    library = Tokenizer.from_file(tokenizer_path())
    assert chunkreuse.PieceTexts(tokenizer_path()).decode(ids_of[4]).decode() == library.decode(ids_of[4], skip_special_tokens=False)


def reach(nodes, linked):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_near_duplicates(docs, texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set())
    linked = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    expected = reach(range(len(sets)), linked)
    for r in minhash.near_duplicates(docs, k=4).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), expected[r.doc_id], expected[r.doc_id] == r.doc_id)


def test_near_duplicates_with_unlucky_signatures(spark):
    """Isolated pairs of exactly 80 percent, those with the fewest equal coordinates of 6,000."""
    import pyarrow as pa

    pairs = []
    for i in range(6000):
        first = [f"{i}w{j}" for j in range(93)]  # 90 shingles, of which the other text has 80
        pairs.append((" ".join(first), " ".join([*first[:83], *(f"{i}x{j}" for j in range(10))])))
    signs = minhash.signatures(*minhash.shingle_sets(pa.array([t for pair in pairs for t in pair]), 4))
    equal = (signs[::2] == signs[1::2]).sum(1)
    worst = np.argsort(equal, kind="stable")[:4].tolist()
    assert equal[worst[0]] < 24
    rows = [(2 * n + side, pairs[at][side]) for n, at in enumerate(worst) for side in (0, 1)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4).collect()}
    assert got == {d: d - d % 2 for d, _ in rows}


def test_components(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 199)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {n: c for n, c in reach({x for p in pairs for x in p}, pairs).items() if n in nodes}


def vectors_of(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(base)]
    rows += [(100 + i, (base[0] + rng.normal(size=16) * 0.1).tolist(), 0) for i in range(50)]
    rows += [(200, base[0].tolist(), 0), (201, base[0].tolist(), 1), (202, base[0].tolist(), None), (203, None, 0), (204, [0.0] * 16, 0)]
    rows += [(205, [float("nan")] * 16, 0), (206, [None] * 16, 0), (207, [], 0), (208, [1.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def good(vector):
    return vector is not None and all(x is not None and np.isfinite(x) for x in vector)


def test_near_vectors(spark):
    rows, frame = vectors_of(spark)
    links = []
    for i, a, x in rows:
        for j, b, y in rows:
            if j < i and x == y and x is not None and good(a) and good(b) and len(a) == len(b) and any(a) and any(b):
                if np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links.append((i, j))
    expected = reach([r[0] for r in rows], links)
    for r in forest.near_vectors(frame).collect():
        assert r.n_links == sum(r.vec_id in p for p in links)
        assert r.component_id == expected[r.vec_id] and r.kept == (r.vec_id == expected[r.vec_id])


def test_top_products(spark):
    from pyspark.sql import functions as F

    rows, frame = vectors_of(spark)
    usable = {i: np.floor(64 * np.array(v + [0.0] * (16 - len(v)))).astype(int) for i, v, _ in rows if good(v)}
    expected = []
    for q in usable:
        if q % 20 == 0:
            best = sorted(((-int(usable[q] @ v), i) for i, v in usable.items() if i != q))[:7]
            expected += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    got = threshold.top_products(frame, F.col("vec_id") % 20 == 0, k=7).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


BASE_PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_base_patterns_of_personal_data():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choices("1234@.-+ a(é", k=rng.randint(0, 40))) + rng.choice(["", " 4111 1111 1111 1111", "x@y.z.w@q.r", "+1 (416) 555-4060", "1.2.3.4.5.256.7.8"])
        expected = []
        for kind, pattern in BASE_PII.items():
            for m in re.finditer(pattern, text):
                n = sum(c.isdigit() for c in m[0])
                fits = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "phone": 9 <= n <= 15}
                if fits.get(kind) if kind != "card" else 13 <= n <= 19 and skipchain.luhn(skipchain.digits_of(m[0])):
                    expected.append((kind, *m.span()))
        assert skipchain.base_spans(text) == expected


def test_field_carries_labels_to_repeated_tokens():
    seen = [f"call +1 (416) 555-40{i:02d} now, room {i} of 7" for i in range(60)]
    model = skipchain.fit_fields([skipchain.build(t, skipchain.base_spans(t)) for t in seen])
    assert model.skip.trace() >= 2.5 and model.skip[0, 4] <= 0
    text = "call +1 (416) 555-4060 now, or 555-4060"
    marginal = model.marginals(skipchain.build(text, skipchain.base_spans(text)))
    assert np.allclose(marginal.sum(1), 1)
    assert set(skipchain.base_spans(text)) <= set(skipchain.spans_of(model, text))
    assert skipchain.spans_of(model, "") == []


def test_field_reaches_every_mention_of_a_value():
    unary, skip = np.zeros((skipchain.HASHED, 5)), np.full((5, 5), -3.0) + 6 * np.eye(5)
    model = skipchain.FieldModel(unary, np.zeros((5, 5)), skip)
    text = "+14165554060 " + ", ".join(["so 14165554060 it is"] * 60)
    field = skipchain.build(text, skipchain.base_spans(text))
    assert len(field.known) == 61 and field.known[0] == 4 and set(field.known[1:]) == {-1}
    assert model.marginals(field)[:, 4].min() > skipchain.CERTAIN
    chained = skipchain.Field(field.spans, field.features, [], [(i, i + 1) for i in range(60)], field.known)
    exact = np.linalg.matrix_power(np.exp(skip) / np.exp(skip).sum(1), 60)[4]  # a tree: messages are exact
    assert np.allclose(model.marginals(chained)[60], exact, atol=1e-3)


def test_field_is_fitted_on_different_texts(spark):
    from pyspark.sql import functions as F

    rooms = spark.createDataFrame([(f"room {i} of 7",) for i in range(400)], "text string")
    first = rooms.orderBy(F.xxhash64("text")).first().text
    phones = [f"call +1 (416) 555-40{i:02d} now" for i in range(40)]
    lowest = spark.createDataFrame([(t,) for t in [first, *phones]], "text string").orderBy(F.xxhash64("text")).first().text
    assert lowest == first
    docs = spark.createDataFrame([(t,) for t in [first] * 50 + phones], "text string")
    model = skipchain.fit(docs, rows=20)
    assert model.unary[:, skipchain.LABELS.index("phone")].max() > 0


def test_base_patterns_of_secrets():
    rng = random.Random(6)
    patterns = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    for _ in range(2000):
        text = "".join(rng.choices(["token", "API_KEY", "=", ": ", '"', "AKIA", "ABCDEFG1", "0123456789abcdef", "af9", " ", "é", "x"], k=rng.randint(0, 12)))
        expected = []
        for order, (kind, pattern) in enumerate(patterns.items()):
            for m in re.finditer(pattern, text, re.ASCII):
                if len(m[2]) >= 12 if kind == "assign" else len(m[0]) >= (18 if kind == "access" else 16):
                    expected.append((m.start(), order, kind, m.end()))
        assert markov.base_spans(text) == [(k, a, b) for a, _, k, b in sorted(expected)]


def test_markov_finds_random_tokens(spark, sf_dir):
    rng = random.Random(7)
    rows = [(f"the key password={rng.randbytes(12).hex()} and AKIA{''.join(rng.choices('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', k=16))} are here",) for _ in range(300)]
    ordinary = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    model = markov.fit(spark.createDataFrame([*rows, (None,)], "text string").unionByName(ordinary))
    text = "the internationalization of QX7ZJ4K2VW9MB3RT5YHN here"
    assert [text[a:b] for k, a, b in markov.spans_of(model, text) if k == "random"] == ["QX7ZJ4K2VW9MB3RT5YHN"]


def test_models_on_odd_and_empty_input(spark, docs):
    from pyspark.sql import functions as F

    empty = docs.filter("false")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    model = factorization.fit(empty, labels)
    scores = docs.select(factorization.quality_score(model, F.col("text"), F.col("n_chars")).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in scores)
    for trained in (mixture.fit(docs), mixture.fit(empty)):
        for r in docs.select("text", mixture.languages_of(trained, F.col("text")).alias("p")).collect():
            assert 0 <= r.p.score <= 1
            if not any(c.isalpha() for c in r.text or ""):
                assert r.p.lang == "und"
    assert packing.pack(packing.cut_pieces(empty, tokenizer_path())).count() == 0
    assert minhash.near_duplicates(empty).count() == 0
    assert chunkreuse.encode_documents(empty, tokenizer_path()).count() == 0


def test_factor_scores_equal_all_pairs():
    rng = np.random.default_rng(8)
    model = factorization.FactorModel(0.1, rng.normal(size=factorization.FEATURES), rng.normal(size=(factorization.FEATURES, 3)))
    index, value = np.array([3, 9, 20, 4]), rng.normal(size=4)
    for low, high in ((0, 3), (3, 4)):
        i, v = index[low:high], value[low:high]
        pairs = sum(model.factors[a] @ model.factors[b] * x * y for n, (a, x) in enumerate(zip(i, v)) for b, y in list(zip(i, v))[:n])
        expected = factorization.sigmoid(0.1 + model.weights[i] @ v + pairs)
        assert np.isclose(model.scores(np.array([0, 3, 4]), index, value)[0 if low == 0 else 1], expected)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = queries.op4(spark, sf_dir).filter("held_out").join(docs.filter("lang IS NOT NULL"), "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.98 * len(found)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = queries.op10(spark, sf_dir).filter("held_out").join(labels, "doc_id").select("quality", "predicted").collect()
    assert sum(r.quality == r.predicted for r in found) >= 0.9 * len(found)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).dtypes == docs.dtypes
    kept = corpus_pipeline.near_duplicates(spark, docs.unionByName(docs.limit(5)), sf_dir)
    expected = minhash.near_duplicates(docs).filter("kept")
    assert kept.count() == expected.count() and not kept.join(expected, "doc_id", "left_anti").count()
    secret = "token = \"0641917ea4e9feb9cda83477b57ac265\""
    one = spark.createDataFrame([(1, f"a {secret} b", "en", "s", 5, "x")], "doc_id long, text string, lang string, source string, n_chars long, kind string")
    row = corpus_pipeline.secrets(spark, one, sf_dir).first()
    assert "0641917ea4e9" not in row.text and row.n_chars == len(row.text)
    assert hashlib.sha256(row.text.encode()).hexdigest() != hashlib.sha256(one.first().text.encode()).hexdigest()


def test_pipeline_decides_each_text_of_a_doc_id(spark, sf_dir):
    import corpus_pipeline

    a, b, c = (" ".join(f"{name}{i}" for i in range(40)) for name in "abc")
    rows = [(3, b), (5, a), (5, b), (7, a), (8, c), (8, c + " end"), (8, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    assert sorted((d, t[0]) for d, t in kept) == [(3, "b"), (5, "a"), (8, "c")]


def test_pipeline_keeps_mixtures_of_languages(spark, sf_dir):
    import corpus_pipeline

    rng = random.Random(4)
    tongues = {name: ["".join(rng.choices(letters, k=6)) for _ in range(40)] for name, letters in (("xa", "abcdef"), ("xb", "ghijkl"), ("xc", "mnopqr"))}
    rows = [(i, " ".join(rng.choices(tongues[name], k=60)), name) for i, name in enumerate(list(tongues) * 12)]
    mixed = " ".join(w for name, n in (("xa", 80), ("xb", 60), ("xc", 60)) for w in rng.choices(tongues[name], k=n))
    docs = spark.createDataFrame([*rows, (100, mixed, None), (101, "12 !!", "xa"), (102, None, "xa")], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs, sf_dir).collect()}
    assert kept == {*range(36), 100}
