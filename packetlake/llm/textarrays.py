"""Words and their hashes for a whole batch of texts in numpy."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the rolling polynomial, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A number for each byte value.
LETTERS = np.random.default_rng(17).integers(0, 1 << 64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins, with the end last (null: empty)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the output."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def placed(values: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A number for each value at its place; sums of them tell sequences apart.

    Unlike a polynomial modulo a power of two, which collides for texts that
    alternate like the Thue-Morse word, no two places depend on each other.
    """
    return mix(values + (places.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans, which follow one another without overlap."""
    sizes = ends - starts
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    letters = LETTERS[data[np.repeat(starts, sizes) + place]]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(placed(letters, place), dtype=np.uint64)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return mix(sums[at[1:]] - sums[at[:-1]] + sizes.astype(np.uint64))


@functools.lru_cache(maxsize=4)
def _powers(length: int, base: int) -> np.ndarray:
    powers = np.full(length, base, np.uint64)
    powers[:1] = 1
    return np.multiply.accumulate(powers)


def powers(length: int, base: int = BASE) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    return _powers(1 << max(16, int(length).bit_length()), base)[:length]


def prefix_sums(values: np.ndarray, base: int = BASE) -> np.ndarray:
    """Polynomial prefix sums, so that any span has its hash from two of them."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values.astype(np.uint64) * powers(len(values), base), out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, inverse: int = INVERSE) -> np.ndarray:
    back = powers(len(sums), inverse)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first-word index per text of the runs without white space."""
    space = SPACE[data]
    opens, closes = np.ones(len(data), bool), np.ones(len(data), bool)
    opens[1:] = space[:-1]
    closes[:-1] = space[1:]
    edges = begins[(begins > 0) & (begins < len(data))]
    opens[edges] = True
    closes[edges - 1] = True
    starts = np.flatnonzero(opens & ~space)
    ends = np.flatnonzero(closes & ~space) + 1
    return starts, ends, np.searchsorted(starts, begins)
