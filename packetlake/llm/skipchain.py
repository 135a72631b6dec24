"""Personal data: fixed patterns, and a skip-chain conditional random field over number-like tokens."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from packetlake.llm.common import slices
from packetlake.llm.markov import Span, spans_array

#: Kinds in order and their patterns. The look-behinds only spare
#: the search from starting inside a run of digits, where no match can begin.
KINDS = ("email", "ip", "card", "phone")
EMAIL_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)

#: Labels of the field: none, then the kinds.
LABELS = ("", *KINDS)
#: Bound on the different texts with candidate tokens that the field is fitted on, in hash order.
TRAIN_ROWS = 4_000
HASHED = 4_096
EPOCHS, RATE, DECAY = 60, 0.5, 1e-3
#: Message passing ends when no message changes by more than TOLERANCE; damping, and the marginal from
#: which a token is reported. Graphs with loops need not converge: after LEAST_ROUNDS and two rounds a token,
#: enough for evidence to cross the text, damping grows.
TOLERANCE, DAMPING, CERTAIN = 1e-4, 0.5, 0.9
LEAST_ROUNDS = 200
#: Characters between two tokens that still count as neighbours.
NEAR = 3


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ outwards so that long runs cost nothing."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and EMAIL_LOCAL.match(text, start - 1):
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if domain:
            found.append(("email", start, domain.end()))
            free = domain.end()
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns by kind, then start."""
    found = emails(text) if "@" in text else []
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(part_fits(p) for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(digits_of(m[0])) <= PHONE_DIGITS[1]]
    return found


def part_fits(part: str) -> bool:
    """At most 255, leading zeros allowed; long runs are not converted."""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


@dataclass
class Field:
    """Graph of one text: candidate tokens, their features, edges, and labels where known."""

    spans: list[tuple[int, int]]
    features: list[list[int]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]
    known: list[int]  # label of tokens inside base matches, else -1


_MARK = re.compile("[0-9@]")
_EDGE = " \t\r\n\x0b\x0c"
_TRIM = ".,;:!?()[]{}<>\"'"


def tokens(text: str) -> list[tuple[int, int]]:
    """Runs without white space that hold a digit or @, without outer punctuation."""
    found, at = [], 0
    mark = _MARK.search(text)
    while mark:
        start, end = mark.start(), mark.end()
        while start > at and text[start - 1] not in _EDGE:
            start -= 1
        while end < len(text) and text[end] not in _EDGE:
            end += 1
        at = end
        token = text[start:end]
        start += len(token) - len(token.lstrip(_TRIM))
        end -= len(token) - len(token.rstrip(_TRIM))
        if start < end:
            found.append((start, end))
        mark = _MARK.search(text, at)
    return found


def shape(token: str) -> str:
    """Digits as 0, letters as a, other characters as they are; runs are cut at four."""
    out: list[str] = []
    for c in token[:256]:
        kind = "0" if c.isdigit() else "a" if c.isalpha() else c
        if out[-4:] != [kind] * 4:
            out.append(kind)
    return "".join(out)


def build(text: str, base: list[Span]) -> Field:
    spans = tokens(text)
    features, known = [], []
    order = sorted((a, b, LABELS.index(kind)) for kind, a, b in base)
    at = 0
    for start, end in spans:
        token = text[start:end]
        before = text[max(0, start - 40) : start].split()
        names = [
            f"s:{shape(token)}", f"l:{min(len(token), 24)}", f"d:{min(len(digits_of(token[:64])), 20)}",
            f"p:{before[-1].lower().strip(_TRIM + '=') if before else ''}", f"m:{'@' in token}{'.' in token}{'-' in token}",
            f"c:{text[start - 1] if start else ''}", f"e:{text[end : end + 1]}",
        ]
        features.append([zlib.crc32(n.encode("utf-8", "replace")) % HASHED for n in names])
        while at < len(order) and order[at][1] <= start:
            at += 1
        known.append(next((label for a, b, label in order[at : at + 4] if a < end and start < b), -1))
    chain = [(i, i + 1) for i in range(len(spans) - 1) if spans[i + 1][0] - spans[i][1] <= NEAR]
    # Tokens with the same digits, or the same text, are all linked to the first one.
    hub: dict[str, int] = {}
    skip = []
    for i, (start, end) in enumerate(spans):
        token = text[start:end].lower()
        digits = digits_of(token)
        key = digits if len(digits) >= 4 and "@" not in token else token
        if key in hub:
            skip.append((hub[key], i))
        else:
            hub[key] = i
    return Field(spans, features, chain, skip, known)


@dataclass(frozen=True)
class FieldModel:
    unary: np.ndarray  # (HASHED, labels)
    chain: np.ndarray  # (labels, labels)
    skip: np.ndarray

    def marginals(self, field: Field) -> np.ndarray:
        """Loopy message passing until messages stand still; known tokens keep their label."""
        n, k = len(field.spans), len(LABELS)
        own = np.array([self.unary[f].sum(0) for f in field.features])
        for i, label in enumerate(field.known):
            if label >= 0:
                own[i] = -30.0
                own[i, label] = 0.0
        edges = np.array(field.chain + field.skip, np.int64).reshape(-1, 2)
        pair = np.concatenate([np.repeat(self.chain[None], len(field.chain), 0), np.repeat(self.skip[None], len(field.skip), 0)])
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        half = len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((2 * half, k))
        damping, rounds, change = DAMPING, 0, np.inf if half else 0.0
        while change > TOLERANCE:
            belief = own.copy()
            np.add.at(belief, target, message)
            sent = log_sum(pair + (belief[source] - message[back])[:, :, None], 1)
            sent -= log_sum(sent, 1)[:, None]
            fresh = damping * message + (1 - damping) * sent
            change = np.abs(fresh - message).max()
            message, rounds = fresh, rounds + 1
            if rounds > LEAST_ROUNDS + 2 * n:
                damping = 1 - (1 - damping) * 0.95  # steps shrink, so that an oscillation ends too
        belief = own.copy()
        np.add.at(belief, target, message)
        return np.exp(belief - log_sum(belief, 1)[:, None])


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_fields(fields: list[Field]) -> FieldModel:
    """Pseudo-likelihood: each token's label given its neighbours' labels.

    Base matches are the labels, everything else is none. Rare kinds weigh as
    much as frequent ones, and the skip potential never favours disagreement.
    """
    k = len(LABELS)
    unary, chain, skip = np.zeros((HASHED, k)), np.zeros((k, k)), np.zeros((k, k))
    rows = [f for field in fields for f in field.features]
    if not rows:
        unary[:, 0] = 1.0
        return FieldModel(unary, chain, skip)
    x = np.array(rows)
    y = np.array([max(0, label) for field in fields for label in field.known])
    base = np.cumsum([0] + [len(field.spans) for field in fields])
    links = [np.array([(b + i, b + j) for b, field in zip(base, fields) for i, j in getattr(field, kind)], np.int64).reshape(-1, 2) for kind in ("chain", "skip")]
    one_hot = np.eye(k)[y]
    counts = one_hot.sum(0)
    weight = (len(y) / (np.count_nonzero(counts) * np.maximum(counts, 1)))[y][:, None]
    seen = [np.full(p.shape, 1e-6) for p in (unary, chain, skip)]
    for _ in range(EPOCHS):
        score = unary[x].sum(1)
        for table, edge in zip((chain, skip), links):
            np.add.at(score, edge[:, 1], table[y[edge[:, 0]]])
            np.add.at(score, edge[:, 0], table.T[y[edge[:, 1]]])
        error = (np.exp(score - log_sum(score, 1)[:, None]) - one_hot) * weight / len(y)
        steps = [DECAY * unary, DECAY * chain, DECAY * skip]
        np.add.at(steps[0], x.ravel(), np.repeat(error, x.shape[1], 0))
        for step, edge in zip(steps[1:], links):
            np.add.at(step, y[edge[:, 0]], error[edge[:, 1]])
            np.add.at(step.T, y[edge[:, 1]], error[edge[:, 0]])
        for table, step, square in zip((unary, chain, skip), steps, seen):
            square += step**2
            table -= RATE * step / np.sqrt(square)
        skip[:] = np.where(np.eye(k, dtype=bool), np.maximum(skip, 0.5), np.minimum(skip, 0))
    return FieldModel(unary, chain, skip)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> FieldModel:
    """Fitted on at most ``rows`` different texts that hold a digit or @, first in hash order.

    Copies of a text count once: hashes are made distinct before the limit. Only the graphs of those texts (feature numbers, edges, labels) reach the driver.
    """
    marked = docs.filter("text IS NOT NULL").select(F.col("text").cast("string")).filter(F.col("text").rlike("[0-9@]"))
    marked = marked.withColumn("_h", F.xxhash64("text"))
    first = F.broadcast(marked.select("_h").distinct().orderBy("_h").limit(rows))
    chosen = marked.join(first, "_h", "left_semi").groupBy("_h").agg(F.min("text").alias("text")).orderBy("_h").select("text")

    def graphs(batches):
        for batch in batches:
            fields = [build(t, base_spans(t)) for t in batch.column(0).to_pylist()]
            columns = [pa.array([getattr(f, name) for f in fields], t) for name, t in ARROW.items()]
            yield pa.RecordBatch.from_arrays(columns, list(ARROW))

    types = "spans array<array<long>>, features array<array<long>>, chain array<array<long>>, skip array<array<long>>, known array<long>"
    table = chosen.mapInArrow(graphs, types).toArrow().to_pylist()
    return fit_fields([Field(**row) for row in table])


_PAIRS = pa.list_(pa.list_(pa.int64()))
ARROW = {"spans": _PAIRS, "features": _PAIRS, "chain": _PAIRS, "skip": _PAIRS, "known": pa.list_(pa.int64())}


def spans_of(model: FieldModel, text: str) -> list[Span]:
    """Base spans and the tokens outside them that the field is certain of, by kind, then start."""
    found = base_spans(text)
    field = build(text, found)
    if field.spans and min(field.known) < 0:
        marginal = model.marginals(field)
        for (start, end), known, row in zip(field.spans, field.known, marginal):
            label = int(row.argmax())
            if known < 0 and label > 0 and row[label] >= CERTAIN:
                found.append((LABELS[label], start, end))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def personal_spans(model: FieldModel, text: Column) -> Column:
    """array<struct<kind,start,end>> in code points, end exclusive; empty for null text."""

    @arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        rows = []
        for low, high in slices(texts):
            rows += [spans_of(model, t or "") for t in texts.slice(low, high - low).to_pylist()]
        return spans_array(rows)

    return scan(text.cast("string"))
