"""Quality classifier: a factorisation machine over hashed words, text statistics and metadata."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from packetlake.llm.common import slices
from packetlake.llm.textarrays import as_bytes, prefix_sums, span_hashes, words

#: Bound on the labelled rows that the model is fitted on, taken in hash order of doc_id.
TRAIN_ROWS = 12_000
WORD_BUCKETS = 1 << 14
BINS = 24
RANK = 8
#: Passes over the sample, more of them until there were LEAST_STEPS mini-batches.
EPOCHS, LEAST_STEPS = 6, 1_200
BATCH = 64
RATE = 0.05
DECAY = 1e-5
SEED = 7
THRESHOLD = 0.3

STATISTICS = (
    "bytes", "words", "word length", "upper case", "digits", "punctuation", "not ASCII",
    "line breaks", "distinct words", "longest word", "most frequent word", "stored length",
)
FEATURES = WORD_BUCKETS + len(STATISTICS) * BINS


def _class_of_byte() -> np.ndarray:
    kinds = np.zeros(256, np.int64)  # 0 letters, controls and the rest
    kinds[ord("A") : ord("Z") + 1] = 1
    kinds[ord("0") : ord("9") + 1] = 2
    kinds[[b for b in range(33, 127) if not chr(b).isalnum()]] = 3
    kinds[128:] = 4
    kinds[10] = 5
    return kinds


KINDS = _class_of_byte()


def share_bin(share: np.ndarray) -> np.ndarray:
    """Bins of a share from 0 to 1, finer towards 0."""
    return np.minimum((np.sqrt(np.clip(share, 0, 1)) * BINS).astype(np.int64), BINS - 1)


def size_bin(size: np.ndarray) -> np.ndarray:
    """Bins of a count by powers of two; -1 (not known) is the last bin."""
    return np.where(size < 0, BINS - 1, np.minimum(np.log2(np.maximum(size, 0) + 1).astype(np.int64), BINS - 2))


def features(texts: pa.Array, lengths: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: where each begins (end last), feature numbers, values.

    Distinct words share one unit of weight as their square root; each statistic
    sets one bin. Whole texts count; null text is empty, null length its own bin.
    """
    data, begins = as_bytes(texts)
    n = len(texts)
    starts, ends, first = words(data, begins)
    sums = prefix_sums(data)
    bucket = (span_hashes(sums, starts, ends) % np.uint64(WORD_BUCKETS)).astype(np.int64)
    row = np.repeat(np.arange(n), np.diff(first))
    pairs, counts = np.unique(row * WORD_BUCKETS + bucket, return_counts=True)
    owner, word = pairs // WORD_BUCKETS, pairs % WORD_BUCKETS
    distinct = np.bincount(owner, minlength=n)

    size = np.diff(begins)
    text_of = np.repeat(np.arange(n), size)
    kinds = np.bincount(text_of * 6 + KINDS[data], minlength=6 * n).reshape(n, 6)
    n_words, n_bytes = np.diff(first), np.maximum(size, 1)
    longest, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
    np.maximum.at(longest, row, ends - starts)
    np.maximum.at(most, owner, counts)
    letters = np.bincount(row, weights=ends - starts, minlength=n)
    stored = lengths.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    per_word = np.maximum(n_words, 1)
    binned = [
        size_bin(size), size_bin(n_words), np.minimum((letters / per_word * 2).astype(np.int64), BINS - 1),
        *(share_bin(kinds[:, k] / n_bytes) for k in (1, 2, 3, 4)), share_bin(kinds[:, 5] / per_word),
        share_bin(distinct / per_word), size_bin(longest), share_bin(most / per_word), size_bin(stored),
    ]
    statistics = np.stack(binned, 1) + WORD_BUCKETS + np.arange(len(binned)) * BINS

    width = distinct + len(binned)
    at = np.concatenate([[0], np.cumsum(width)])
    index, value = np.empty(at[-1], np.int64), np.empty(at[-1], np.float32)
    place = at[owner] + np.arange(len(owner)) - np.concatenate([[0], np.cumsum(distinct)])[owner]
    index[place], value[place] = word, 1 / np.sqrt(np.maximum(distinct, 1))[owner]
    place = (at[1:, None] - len(binned) + np.arange(len(binned))).ravel()
    index[place], value[place] = statistics.ravel(), 1 / np.sqrt(len(binned))
    return at, index, value


@dataclass(frozen=True)
class FactorModel:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, at: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probability of label 1. All pairs of features interact, in time linear in
        their number: half of the squared sum less the sum of squares, per factor."""
        if len(at) == 1:
            return np.zeros(0)
        linear, inner = self._sums(at, index, value)
        square = np.add.reduceat((self.factors[index] * value[:, None]) ** 2, at[:-1])
        return sigmoid(self.bias + linear + 0.5 * (inner**2 - square).sum(1))

    def _sums(self, at: np.ndarray, index: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.add.reduceat(self.weights[index] * value, at[:-1]), np.add.reduceat(self.factors[index] * value[:, None], at[:-1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_rows(at: np.ndarray, index: np.ndarray, value: np.ndarray, labels: np.ndarray) -> FactorModel:
    """Logistic loss by mini-batches with per-weight step sizes, both labels weighing
    the same; without both labels, their prior alone."""
    rng = np.random.default_rng(SEED)
    positive = float(labels.sum())
    bias = float(np.log((positive + 1) / (len(labels) - positive + 1)))
    weights = np.zeros(FEATURES, np.float32)
    factors = rng.normal(0, 0.05, (FEATURES, RANK)).astype(np.float32)
    if not 0 < positive < len(labels):
        return FactorModel(bias, weights, np.zeros_like(factors))
    seen_w, seen_f = np.full(FEATURES, 1e-3, np.float32), np.full((FEATURES, RANK), 1e-3, np.float32)
    balance = np.where(labels > 0, len(labels) / (2 * positive), len(labels) / (2 * (len(labels) - positive))).astype(np.float32)
    bias = 0.0
    model = FactorModel(bias, weights, factors)
    for _ in range(max(EPOCHS, LEAST_STEPS * BATCH // len(labels))):
        order = rng.permutation(len(labels))
        for low in range(0, len(order), BATCH):
            rows = order[low : low + BATCH]
            width = at[rows + 1] - at[rows]
            local = np.concatenate([[0], np.cumsum(width)])
            pick = np.repeat(at[rows] - local[:-1], width) + np.arange(local[-1])
            i, v = index[pick], value[pick]
            _, inner = model._sums(local, i, v)
            error = np.repeat((balance[rows] * (model.scores(local, i, v) - labels[rows])).astype(np.float32), width)
            used, slot = np.unique(i, return_inverse=True)
            spread = np.repeat(inner, width, axis=0)
            by_factor = (error * v)[:, None] * (spread - factors[i] * v[:, None])
            grad_w = np.bincount(slot, weights=error * v, minlength=len(used)) + DECAY * weights[used]
            grad_f = np.stack([np.bincount(slot, weights=by_factor[:, k], minlength=len(used)) for k in range(RANK)], 1)
            grad_f += DECAY * factors[used]
            seen_w[used] += grad_w**2
            seen_f[used] += grad_f**2
            weights[used] -= RATE * grad_w / np.sqrt(seen_w[used])
            factors[used] -= RATE * grad_f / np.sqrt(seen_f[used])
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> FactorModel:
    """Fitted on at most ``rows`` labelled documents.

    ``labels`` (doc_id, quality 0/1, no other values used) holds only rows that
    may be learned from. Its first rows in hash order are joined to ``docs``.
    """
    chosen = (
        labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL")
        .select("doc_id", F.col("quality").cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label")
        .limit(rows)
    )
    # Only the columns read here, so that no other name of ``docs`` can clash.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"), length_column(docs))
    # Broadcast: at most ``rows`` rows of two numbers. A doc_id with many rows may not pass the bound either.
    known = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", "n_chars")
    known = known.orderBy(F.xxhash64("text", "n_chars", "label"), "text", "n_chars", "label").limit(rows)

    def extract(batches):
        for batch in batches:
            for low, high in slices(batch.column(1)):
                part = batch.slice(low, high - low)
                at, index, value = features(part.column(1), part.column(2))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(index.astype(np.int32)))
                values = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(value))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, values], ["label", "index", "value"])

    rows_seen = known.mapInArrow(extract, "label int, index array<int>, value array<float>").toArrow().combine_chunks()
    if not rows_seen.num_rows:
        return fit_rows(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0))
    index, value = rows_seen["index"].combine_chunks(), rows_seen["value"].combine_chunks()
    at = index.offsets.to_numpy().astype(np.int64)
    return fit_rows(at - at[0], index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy(), rows_seen["label"].to_numpy())


def length_column(docs: DataFrame) -> Column:
    """The stored length as metadata; null where the table has none."""
    number = F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)
    return number.cast("long").alias("n_chars")


def quality_score(model: FactorModel, text: Column, length: Column) -> Column:
    """Probability (0 to 1) that a text has label 1. Never null."""

    @arrow_udf("double")
    def score(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        found = [model.scores(*features(texts.slice(low, high - low), lengths.slice(low, high - low))) for low, high in slices(texts)]
        return pa.array(np.concatenate(found) if found else np.zeros(0))

    return score(text.cast("string"), length)
