"""Language identification: proportions of languages in each text by expectation-maximisation."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from packetlake.llm.common import slices
from packetlake.llm.textarrays import mix

#: Letter trigrams are counted in so many buckets, so a model has that many numbers a language.
BUCKETS = 1 << 16
SMOOTHING = 0.5
STEPS = 8
#: A language more must raise the log-likelihood by PENALTY * ln(words); 0.5 would be the plain criterion.
PENALTY = 3.0
#: Words are trusted less than their trigrams' product says, as trigrams overlap.
TEMPER = 1 / 3
UNKNOWN = "und"


@functools.lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Code point of the lower-case letter for every code point; 0 where it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x110000):
        char = chr(code)
        if char.isalpha():
            low = char.lower()
            table[code] = ord(low) if len(low) == 1 else code
    return table


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram bucket of every letter, where each word begins (end last), and the text of each word.

    A word is a run of letters. Each letter counts with its two predecessors, of
    which those outside the word are blanks, and each word end counts as a letter.
    """
    codes = [np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) for text in texts]
    sizes = np.array([len(c) + 2 for c in codes])
    flat = np.zeros(int(sizes.sum()) + 2, np.uint64)
    at = 2
    table = letters()
    for code, size in zip(codes, sizes.tolist()):
        flat[at : at + size - 2] = table[code]
        at += size
    word = flat > 0
    # Letters, and the blank right after a word.
    place = np.flatnonzero(word | np.concatenate([[False], word[:-1]]))
    place = place[place >= 2]
    before = np.where(flat[place - 1] > 0, flat[place - 2], 0)
    gram = mix((flat[place] << np.uint64(42)) ^ (flat[place - 1] << np.uint64(21)) ^ before.astype(np.uint64)) % np.uint64(BUCKETS)
    opens = np.flatnonzero(word[place] & ~word[place - 1])
    text = np.searchsorted(np.cumsum(sizes) + 2, place[opens], "right")
    return gram.astype(np.int64), np.append(opens, len(place)), text


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    log_p: np.ndarray  # (BUCKETS, languages)


def fit(docs: DataFrame) -> LanguageModel:
    """Trigram probabilities of each language over all of ``docs`` (text, lang).

    Null texts and null languages are left out. What reaches the driver is one
    number per language and bucket.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for low, high in slices(batch.column(0)):
                part = batch.slice(low, high - low)
                names = part.column(1).to_pylist()
                gram, begins, text = word_grams(part.column(0).to_pylist())
                owner = np.repeat(text, np.diff(begins))
                known = sorted(set(names))
                code = np.array([known.index(n) for n in names], np.int64)
                table = np.bincount(code[owner] * BUCKETS + gram, minlength=len(known) * BUCKETS).reshape(len(known), BUCKETS)
                for name, row in zip(known, table):
                    sums[name] = sums[name] + row if name in sums else row
        for name, row in sums.items():
            used = np.flatnonzero(row)
            columns = [pa.array([name] * (len(used) + 1)), pa.array(np.append(used, -1)), pa.array(np.append(row[used], 0))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "bucket", "n"])

    kept = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select(F.col("text").cast("string"), F.col("lang").cast("string"))
    table = kept.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = tuple(sorted(set(table["lang"].to_pylist())))
    counts = np.zeros((len(names), BUCKETS))
    rows = np.array([names.index(n) for n in table["lang"].to_pylist()], np.int64)
    bucket, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    real = bucket >= 0
    counts[rows[real], bucket[real]] = n[real]
    log_p = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
    return LanguageModel(names, np.ascontiguousarray(log_p.T.astype(np.float32)))


def proportions(model: LanguageModel, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language proportions of each text (0 outside the chosen set), its number of words and its gain.

    The gain is how much likelier a trigram is under the chosen mixture than if
    all BUCKETS were equally likely, as a mean logarithm; 0 without words.

    Expectation-maximisation over the words of all texts at once. It starts from
    all languages and drops the rarest one of each text in turn; the set with the
    best penalised log-likelihood stays.
    """
    n, k = len(texts), len(model.names)
    gram, begins, text = word_grams(texts)
    n_words = np.bincount(text, minlength=n)
    best, gain = np.zeros((n, k)), np.zeros(n)
    if not k or not len(text):
        return best, n_words, gain
    log_w = np.add.reduceat(model.log_p[gram], begins[:-1], axis=0).astype(np.float64) * TEMPER
    top = log_w.max(1)
    weight = np.exp(log_w - top[:, None])
    first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    owners = text[first]
    lengths = np.diff(np.append(first, len(text)))
    row = np.repeat(np.arange(len(owners)), lengths)
    allowed = np.ones((len(owners), k), bool)
    best_value, chosen = np.full(len(owners), -np.inf), np.zeros((len(owners), k))
    for size in range(k, 0, -1):
        theta = allowed / allowed.sum(1, keepdims=True)
        for _ in range(STEPS if size > 1 else 0):
            part = weight * theta[row]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
            theta = np.add.reduceat(part, first, axis=0) / lengths[:, None]
        likelihood = np.add.reduceat(np.log(np.maximum((weight * theta[row]).sum(1), 1e-300)), first)
        value = likelihood - PENALTY * (size - 1) * np.log(lengths + 1)
        better = value > best_value
        best_value[better], chosen[better] = value[better], theta[better]
        if size > 1:
            allowed[np.arange(len(owners)), np.where(allowed, theta, np.inf).argmin(1)] = False
    best[owners] = chosen
    part = weight * chosen[row]
    part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
    told = np.add.reduceat((part * log_w).sum(1), first) / TEMPER
    grams = np.add.reduceat(np.diff(begins), first)
    gain[owners] = told / grams + np.log(BUCKETS)
    return best, n_words, gain


PREDICTION = "lang string, score double, languages map<string,double>, gain double"


def languages_of(model: LanguageModel, text: Column) -> Column:
    """Struct (lang, score, languages, gain): the main language, its share, all shares, and how well they explain the text.

    Null text, or text without a letter, is ``und`` with score 0; so is any text
    where no language was learned. Equal shares go to the first name.
    """

    @arrow_udf(PREDICTION)
    def identify(texts: pa.Array) -> pa.Array:
        names, scores, keys, values, at, gains = [], [], [], [], [0], []
        for low, high in slices(texts):
            share, n_words, gain = proportions(model, [t or "" for t in texts.slice(low, high - low).to_pylist()])
            gains += gain.tolist()
            for row, known in zip(share, n_words):
                used = np.flatnonzero(row > 0)
                if not known or not len(used):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    names.append(model.names[int(row.argmax())])
                    scores.append(min(1.0, float(row.max())))
                keys += [model.names[i] for i in used]
                values += row[used].tolist()
                at.append(len(keys))
        shares = pa.MapArray.from_arrays(pa.array(at, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.float64()))
        columns = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), shares, pa.array(gains, pa.float64())]
        return pa.StructArray.from_arrays(columns, ["lang", "score", "languages", "gain"])

    return identify(text.cast("string"))
