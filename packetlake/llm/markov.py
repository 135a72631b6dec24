"""Secrets: fixed patterns, and tokens that a Markov model of random strings explains better."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from packetlake.llm.common import slices

#: The base patterns, their kinds in order, and the least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
ASSIGN_LENGTH, ACCESS_LENGTH = 12, 18
KEYWORDS = re.compile(r"(?i:passw|secret|token|api)", re.ASCII)

#: Tokens that the models judge. Shorter ones hold too little evidence.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
#: Log-likelihood ratio, per character and in all, above which a token is random.
PER_CHARACTER, IN_ALL = 0.35, 12.0
SMOOTHING = 0.5
#: Symbols of the models: 0 is the token's edge, 1 any other character.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(ALPHABET) + 2
_SYMBOL = np.ones(256, np.int64)
_SYMBOL[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET)) + 2

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind, by start."""
    found: list[Span] = []
    if KEYWORDS.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LENGTH]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LENGTH]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def transitions(token: str) -> np.ndarray:
    """Pair numbers of a token's neighbouring characters, its edges included."""
    codes = _SYMBOL[np.frombuffer(token.encode("latin-1", "replace"), np.uint8)]
    padded = np.concatenate([[0], codes, [0]])
    return padded[:-1] * SYMBOLS + padded[1:]


@dataclass(frozen=True)
class SecretModel:
    ratio: np.ndarray  # log P(next | this) among random strings less that among identifiers

    def is_random(self, token: str) -> bool:
        total = float(self.ratio[transitions(token)].sum())
        return total >= IN_ALL and total >= PER_CHARACTER * len(token)


def samples(text: str) -> tuple[list[str], list[str]]:
    """Labelled samples of one text: values of its base matches, and its identifiers.

    Identifiers are runs of the model's characters outside all base matches
    that hold at most two digits.
    """
    spans = base_spans(text)
    secret = [text[a:b] if kind != "assign" else ASSIGN.match(text, a)[2] for kind, a, b in spans]
    plain, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        plain.append(text[at:a])
        at = max(at, b)
    plain.append(text[at:])
    return secret, plain


_RUN_END = np.uint8(32)


def identifier_counts(texts: list[str]) -> np.ndarray:
    """Transitions of all words of three letters or more, edges included."""
    data = np.frombuffer(" ".join(texts).encode("latin-1", "replace"), np.uint8)
    codes = _SYMBOL[data]
    codes[codes == 1] = 0
    padded = np.concatenate([[0], codes, [0]])
    pair = padded[:-1] * SYMBOLS + padded[1:]
    return np.bincount(pair, minlength=SYMBOLS * SYMBOLS)


def fit(docs: DataFrame) -> SecretModel:
    """Both character models from all of ``docs`` (text); null texts are left out.

    The labels come from the base patterns: what they match are samples of
    random strings, all other text samples of ordinary identifiers. One number
    per model and pair of characters reaches the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        for batch in batches:
            for low, high in slices(batch.column(0)):
                outside: list[str] = []
                for text in batch.column(0).slice(low, high - low).to_pylist():
                    secret, plain = samples(text)
                    for token in secret:
                        np.add.at(sums[0], transitions(token), 1)
                    outside += plain
                sums[1] += identifier_counts(outside)
        model, pair = np.nonzero(sums)
        columns = [pa.array(model), pa.array(pair), pa.array(sums[model, pair])]
        yield pa.RecordBatch.from_arrays(columns, ["model", "pair", "n"])

    rows = docs.filter("text IS NOT NULL").select(F.col("text").cast("string"))
    table = rows.mapInArrow(count, "model long, pair long, n long").groupBy("model", "pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((2, SYMBOLS, SYMBOLS))
    pair = table["pair"].to_numpy()
    counts[table["model"].to_numpy(), pair // SYMBOLS, pair % SYMBOLS] = table["n"].to_numpy()
    counts[1, 0, 0] = 0  # white space next to white space
    smooth = counts + SMOOTHING
    log_p = np.log(smooth / smooth.sum(2, keepdims=True))
    return SecretModel((log_p[0] - log_p[1]).ravel())


def spans_of(model: SecretModel, text: str) -> list[Span]:
    """Base spans, and random tokens that touch none of them."""
    found = base_spans(text)
    taken = [(a, b) for _, a, b in found]
    extra = [
        ("random", *m.span())
        for m in TOKEN.finditer(text)
        if not any(a < m.end() and m.start() < b for a, b in taken) and model.is_random(m[0])
    ]
    return ordered(found + extra)


def secret_spans(model: SecretModel, text: Column) -> Column:
    """array<struct<kind,start,end>> in code points, end exclusive; empty for null text."""

    @arrow_udf("array<struct<kind:string,start:long,end:long>>")
    def scan(texts: pa.Array) -> pa.Array:
        return spans_array([spans_of(model, t or "") for t in texts.to_pylist()])

    return scan(text.cast("string"))


def spans_array(rows: list[list[Span]]) -> pa.Array:
    flat = [span for row in rows for span in row]
    offsets = np.concatenate([[0], np.cumsum([len(row) for row in rows])]).astype(np.int32)
    fields = [pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64())]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["kind", "start", "end"]))


def without(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redacted(model: SecretModel, text: Column) -> Column:
    """The text without its secrets; null stays null. One pass in one worker."""

    @arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for low, high in slices(texts):
            out += [t and without(t, spans_of(model, t)) for t in texts.slice(low, high - low).to_pylist()]
        return pa.array(out, pa.string())

    return replace(text.cast("string"))
