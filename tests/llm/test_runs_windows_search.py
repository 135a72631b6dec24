"""Periodic runs, chat windows and lexical search against brute force, and odd input."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare

from packetlake.llm import chatwindows, grammarruns, lexical, queries
from packetlake.llm.common import tokenizer_path
from packetlake.llm.wordpieces import WordPieces


def plain_runs(words):
    """(start, length, period) by comparing all words at all distances."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if j > i and length >= max(6, 4 * q):
                if not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                    found.append((i, length, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, period in runs for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(rng):
    letters = rng.choice([1, 2, 3, 5, 20])
    words = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(0, 60))]
    for _ in range(rng.randint(0, 3)):
        part = [f"w{rng.randrange(letters)}" for _ in range(rng.randint(1, 7))]
        at = rng.randint(0, len(words))
        words[at:at] = part * rng.randint(2, 12) + part[: rng.randint(0, len(part))]
    return words


@pytest.mark.parametrize("share", [0, 1 / 64, 1])
def test_runs_equal_brute_force(share, monkeypatch):
    monkeypatch.setattr(grammarruns, "LEAST_SHARE", share)
    rng = random.Random(1)
    for _ in range(150):
        docs = [repetitive(rng) for _ in range(rng.randint(1, 12))]
        docs += docs[:1] + [[]]
        _, ids, begins = grammarruns.word_ids([" ".join(d).encode() for d in docs])
        start, end, period = grammarruns.runs_of(ids, begins)
        expected = [(s + int(b), n, q) for d, b in zip(docs, begins) for s, n, q in plain_runs(d)]
        assert list(zip(start.tolist(), (end - start).tolist(), period.tolist())) == expected


def test_each_two_neighbours_meet_once_in_a_rule():
    _, ids, begins = grammarruns.word_ids([b"a b a b a b c c c c c a b", b"", b"a b c"])
    middles = np.sort(np.concatenate([m for _, m, _, _ in grammarruns.derivation(ids, begins)]))
    assert middles.tolist() == [*range(1, 13), 14, 15]


def test_long_repetition_is_one_run():
    _, ids, begins = grammarruns.word_ids([b"a b c " * 60_000, b"z " * 50_000])
    start, end, period = grammarruns.runs_of(ids, begins)
    assert list(zip(start.tolist(), end.tolist(), period.tolist())) == [(0, 180_000, 3), (180_000, 230_000, 1)]


def test_periodic_runs_of_odd_rows(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(repetitive(rng)) for _ in range(30)] + ["", None, " \t\n", "   ", "éß " * 9, "a\x1cb " * 8 + "c\x85d"]
    rows = [(i % 20 if i else None, t, "x", 1) for i, t in enumerate(texts)] + [(3, texts[3], "x", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, length int")
    got = [(r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in grammarruns.periodic_runs(docs).collect()]
    expected = []
    for doc_id, text, _, _ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = plain_runs(words)
        expected.append((doc_id, runs, collapsed(words, runs)))
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert grammarruns.periodic_runs(docs.limit(0)).count() == 0


def test_runs_query(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11(spark, sf_dir).collect()}
    assert len(got) == len(rows) and sum(r.n_runs > 0 for r in got.values()) > 50
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        r = got[doc_id]
        if len(words) <= 400:
            runs = plain_runs(words)
        else:  # long texts: check what is returned, and that the planted tail is among it
            runs = None
        if runs is not None:
            best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
            assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
            assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
            assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
            assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
        elif h % 10 == 0 and n - a >= 4 * p:
            assert r.n_runs and Fraction(r.length, r.period) >= Fraction(n - a, p)


def plain_digests(rows):
    """Digests per conversation of (conv_id, turn, role, text) rows."""
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, chatsafe(r[2]), chatsafe(r[3])))
    turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in order)
    loss = "".join(r[3] or "" for r in order if r[2] == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def chatsafe(text):
    return re.sub(r"<(\\*)\|", lambda m: f"<{m[1]}\\|", text or "").replace("\n", "\n")


def chat_rows():
    rng = random.Random(5)
    said = ["", None, "<|im_end|>", "<\\|im_start|>x\n<\\\\|", "a<|", "|>", "naïve \U0001f600 text\n", "\\", "<|n|>"]
    rows = [(1, t, r, " ".join(rng.choices(["one", "two", *(s for s in said if s)], k=rng.randint(0, 90)))) for t, r in enumerate(["system", *["user", "assistant"] * 40])]
    rows += [(2, 10 * t, ["user", "assistant"][t % 2], said[t % len(said)]) for t in range(200)]
    rows += [(3, t, r, "x " * 3000) for t, r in enumerate(["system", "user", "assistant", "assistant"])]
    rows += [(4, None, "user", "first"), (4, 0, None, "b"), (4, 0, "tool\nx<|n|>", "a"), (4, 0, "assistant", "a"), (4, 0, "assistant", "a"), (4, -300, "user", None)]
    rows += [(None, 1, "assistant", "of no conversation"), (5, 3, "assistant", "later<|im_end|>"), (5, 600, "user", "far")]
    return rows


def test_windows_read_back_to_every_turn(spark):
    rows = chat_rows()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, window int")
    windows = chatwindows.windows(turns, tokenizer_path(), budget=300, history=60)
    held = windows.collect()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chatwindows.digests(windows).collect()}
    assert got == {c: plain_digests([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    encoder = WordPieces(tokenizer_path())
    repeating = 0
    for w in held:
        turns_of = re.findall(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", w.text, re.DOTALL)
        assert "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns_of) == w.text and len(turns_of) == w.n_turns
        assert w.n_tokens == sum(4 + (len(encoder.encode([r])[0]) + len(encoder.encode([t])[0])) // 4 for r, t in turns_of)
        new = [t for r, t in turns_of[w.n_repeated :] if r == "assistant"]
        assert [w.text[x.start : x.start + x.length] for x in w.loss] == new
        assert w.over_budget == (w.n_tokens > 300) and (not w.over_budget or len(turns_of) - w.n_repeated == 1)
        if w.conv_id == 1 and (w.segment, w.window) != (0, 0):
            assert turns_of[0][0] == "system"
        repeating += w.n_repeated > 1
    assert repeating > 5
    later = [w for w in held if w.conv_id == 2 and w.window == 0 and w.segment > 0]
    assert later and all(w.n_repeated > 0 for w in later)
    assert chatwindows.digests(chatwindows.windows(turns.limit(0), tokenizer_path())).count() == 0


def test_system_turn_reaches_later_segments(spark):
    rows = [(7, t, "system" if not t else ["assistant", "user"][t % 2], f"turn {t}") for t in range(700)] + [(8, 5, "user", "a"), (8, 400, "system", "b"), (8, 401, "user", "x " * 2000)]
    rows += [(9, 0, "system", "turn 0"), (9, 5000, "user", "far"), (9, 5001, "user", "x " * 2000)]
    windows = chatwindows.windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), tokenizer_path()).collect()
    for w in windows:
        assert (w.conv_id != 8) == w.text.startswith("<|im_start|>system\nturn 0<|im_end|>")
    assert sorted((w.segment, w.window, w.n_turns, w.n_repeated) for w in windows if w.conv_id == 9) == [(0, 0, 1, 0), (19, 0, 2, 1), (19, 1, 2, 1)]
    assert {w.segment for w in windows if w.conv_id == 7} == {0, 1, 2}


def test_windows_query(spark, sf_dir):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    by_id = {}
    for r in rows:
        by_id.setdefault(r[0], []).append(r)
    got = queries.op12(spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == {c: plain_digests(r) for c, r in by_id.items()}
    assert all(r.formatted_chars >= sum(len(x[3] or "") for x in by_id[r.conv_id]) for r in got)


def test_search_query_equals_sql(spark, sf_dir):
    assert compare(spark, sf_dir, queries.op13, queries.OP13_SQL) > 0


def plain_search(docs, items, k):
    bags = [(d, lexical.terms(t.encode())) for d, t in docs if d is not None and t]
    bags = [(d, b) for d, b in bags if b]
    n, length = len(bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = []
    for item, text in set(items):
        scored = []
        for d, b in bags:
            m = 25 + 75 * len(b) * n // length
            score = 0
            for t in lexical.terms((text or "").encode()):
                if t in df:
                    w = int(np.floor(1000 * np.log((2 * n + 2) / (2 * df[t] + 1))))
                    score += w * (1_000_000_000 * b.count(t) // (1000 * b.count(t) + 8 * m))
            if score > 0:
                scored.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_DOCUMENTS", 16)
    monkeypatch.setattr(lexical, "ITEM_BYTES", 600)
    rng = random.Random(9)
    words = [f"t{i}" for i in range(30)] + ["Éa", "éa", "A", "a"]
    weights = [1 / (i + 1) for i in range(len(words))]
    texts = [rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, weights, k=rng.randint(0, 60))) for _ in range(150)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(500 + i, texts[0]) for i in range(40)] + [(3, texts[3]), (None, texts[1]), (600, None), (601, ""), (602, "?!"), (603, "t0 " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12)))) for i in range(25)] + [(1, "t1 t1 T1"), (30, texts[0]), (31, None), (32, "unknown"), (33, "t0"), (33, "t0")]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, terms string, n int").repartition(2)
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in lexical.top_documents(frame, asked, k=5).collect()), key=repr)
    assert got == plain_search(docs, items, 5)
    assert lexical.top_documents(frame.limit(0), asked).count() == 0
    assert lexical.top_documents(frame, asked.limit(0)).count() == 0


@pytest.mark.parametrize("first_read", [1, 4, 64])
def test_lists_stop_early_and_stay_exact(first_read):
    rng = np.random.default_rng(2)
    for _ in range(60):
        terms = [np.unique(rng.integers(0, 12, rng.integers(0, 9))).astype(np.int32) for _ in range(60)]
        counts = [rng.integers(1, 4, len(t)).astype(np.int32) for t in terms]
        batch = pa.RecordBatch.from_arrays(
            [pa.array(rng.permutation(60)), pa.array([max(1, int(c.sum())) for c in counts], pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
            ["doc_id", "n", "terms", "counts"],
        )
        weights = rng.integers(0, 4, 12) * 1000
        lists = lexical.Lists([batch], weights, 60, 500)
        wanted = np.unique(rng.integers(0, 12, 5))
        times = rng.integers(1, 3, len(wanted))
        score = np.zeros(60, np.int64)
        for w, t in zip(wanted, times):
            at = slice(lists.begins[w], lists.begins[w + 1])
            score[lists.doc[at]] += lists.impact[at] * t
        least = int(rng.integers(1, max(2, score.max())))
        expected = sorted((-s, d) for s, d in zip(score.tolist(), lists.doc_id.tolist()) if s >= least)[:7]
        got = lists.best(wanted, times, 7, least, first_read)
        assert [(-s, d) for s, d in zip(*(x.tolist() for x in got))] == expected
