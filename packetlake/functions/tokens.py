"""Token arrays from packet bytes.

Token rows have 1,520 numbers, so the byte-level work runs on whole Arrow batches
with numpy; Spark decides which rows meet in a batch. A batch of Spark's default
size would be 10,000 rows, hundreds of MB of work arrays in each worker, so these
functions set smaller ones in the active session (``small_batches``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from packetlake.schemas import CLS, END, ENDPOINT, MASK, PAD, TOKENS_PER_PACKET, VOCABULARY
from packetlake.session import small_batches

# Where the class token goes: first with a closing token, or last.
PLACEMENTS = {"SOS": 2, "EOS": 1}
OVERFLOWS = ("error", "truncate", "drop")
# Tokens that are never chosen for corruption (fixed values).
UNSELECTABLE = [END, PAD, CLS, ENDPOINT]
# Most tokens corrupted in one packet: a quarter of its width.
MASK_CAP = TOKENS_PER_PACKET // 4


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in one array, and the offsets of its rows."""
    column = column.fill_null(b"")
    width = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    values = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lists(values: np.ndarray, offsets: np.ndarray, nulls: pa.Array | None = None) -> pa.ListArray:
    mask = nulls if nulls is not None and nulls.true_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.astype(np.int32)), mask=mask)


def _masked(data: pa.Array, mask: pa.Array, value: int) -> tuple[np.ndarray, np.ndarray]:
    numbers, offsets = _bytes_of(data)
    flags, flag_offsets = _bytes_of(mask)
    if not np.array_equal(offsets, flag_offsets):
        raise ValueError("data and mask must have the same length in every row")
    numbers = numbers.astype(np.int32)
    return np.where(flags == 1, np.int32(value), numbers), offsets


def token_rows(numbers: np.ndarray, offsets: np.ndarray, placement: str, overflow: str) -> tuple[np.ndarray, np.ndarray]:
    """Padded token matrix, and which rows did not fit."""
    room = TOKENS_PER_PACKET - PLACEMENTS[placement]
    sizes = np.diff(offsets)
    too_long = sizes > room
    if too_long.any():
        if overflow == "error":
            raise ValueError(f"a packet has {int(sizes.max())} bytes, more than the {room} that fit")
        within = np.arange(len(numbers)) - np.repeat(offsets[:-1], sizes)
        numbers = numbers[within < room]
        sizes = np.minimum(sizes, room)
    tokens = np.full((len(sizes), TOKENS_PER_PACKET), PAD, np.int32)
    first = 1 if placement == "SOS" else 0
    places = np.arange(TOKENS_PER_PACKET) - first
    tokens[(places >= 0) & (places < sizes[:, None])] = numbers
    row = np.arange(len(sizes))
    tokens[row, sizes + first] = END if placement == "SOS" else CLS
    if placement == "SOS":
        tokens[:, 0] = CLS
    return tokens, too_long


def check_options(placement: str, overflow: str) -> None:
    if placement not in PLACEMENTS:
        raise ValueError(f"Invalid CLS placement: {placement}")
    if overflow not in OVERFLOWS:
        raise ValueError(f"overflow must be one of {OVERFLOWS}, not {overflow!r}")


def bytes_to_ints(data: Column) -> Column:
    """Bytes as an array of numbers 0-255."""
    small_batches(SparkSession.active())

    @F.arrow_udf("array<int>")
    def to_ints(batch: pa.Array) -> pa.Array:
        return _lists(*_bytes_of(batch), batch.is_null())

    return to_ints(data)


def apply_mask(data: Column, mask: Column, value: int = 0) -> Column:
    """Bytes as numbers, ``value`` where the mask byte is 1."""
    small_batches(SparkSession.active())

    @F.arrow_udf("array<int>")
    def masked(batch: pa.Array, flags: pa.Array) -> pa.Array:
        return _lists(*_masked(batch, flags, value), batch.is_null())

    return masked(data, mask)


def apply_mask_to_numbers(data: Column, mask: Column, value: int = 0) -> Column:
    """``apply_mask`` for columns that hold arrays of numbers already."""
    return F.zip_with(data, mask, lambda number, flag: F.when(flag == 1, F.lit(value)).otherwise(number))


def encode_tokens(
    data: Column, mask: Column, mask_value: int = ENDPOINT, placement: str = "EOS", overflow: str = "error"
) -> Column:
    """Masked bytes as one padded token row.

    A packet that does not fit raises an error, is cut, or gives NULL (``drop``).
    """
    check_options(placement, overflow)
    small_batches(SparkSession.active())

    @F.arrow_udf("array<int>")
    def encode(batch: pa.Array, flags: pa.Array) -> pa.Array:
        tokens, too_long = token_rows(*_masked(batch, flags, mask_value), placement, overflow)
        gone = pa.array(too_long) if overflow == "drop" else pa.array(np.zeros(len(tokens), bool))
        return _lists(tokens.ravel(), np.arange(len(tokens) + 1) * TOKENS_PER_PACKET, gone)

    return encode(data, mask)


def masked_bytes(data: Column, mask: Column) -> Column:
    """The bytes where the mask is 1, in order."""
    small_batches(SparkSession.active())

    @F.arrow_udf("binary")
    def extract(batch: pa.Array, flags: pa.Array) -> pa.Array:
        numbers, offsets = _bytes_of(batch)
        chosen, _ = _bytes_of(flags)
        kept = chosen == 1
        ends = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int32)
        return pa.Array.from_buffers(
            pa.binary(), len(batch), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(numbers[kept].tobytes())]
        )

    return extract(data, mask)


# --- corruption for masked-token training ----------------------------------

# Multipliers of the 32-bit mixing function (fixed values, also used in SQL).
MIX, POSITION_STEP, SEED_STEP = 73244475, 2654435, 40503
LOW32 = 0xFFFFFFFF
# Rows corrupted at a time, which bounds the size of the work arrays.
ROWS_AT_ONCE = 512


def _mix(value: np.ndarray) -> np.ndarray:
    for _ in range(2):
        value = ((value >> np.uint64(16)) ^ value) * np.uint64(MIX) & np.uint64(LOW32)
    return (value >> np.uint64(16)) ^ value


def _corrupt_rows(values, offsets, base, rate_percent, mask_percent, random_percent, cap) -> None:
    """Corrupts consecutive rows of ``values`` in place."""
    sizes = np.diff(offsets)
    width = int(sizes.max(initial=0))
    if not width:
        return
    there = np.arange(width) < sizes[:, None]
    tokens = np.full((len(sizes), width), PAD)
    tokens[there] = values[offsets[0] : offsets[-1]]
    selectable = there & ~np.isin(tokens, UNSELECTABLE)
    place = np.arange(width, dtype=np.uint64)
    start = base[:, None] + place * np.uint64(POSITION_STEP)

    def draw(salt: int, of: np.ndarray) -> np.ndarray:
        return _mix(of + np.uint64(salt) & np.uint64(LOW32))

    wanted = np.minimum(-(-selectable.sum(axis=1) * rate_percent // 100), cap)
    most = int(wanted.max())
    if not most:
        return
    # Hash, then position, as one number; the smallest of each row are taken.
    key = np.where(selectable, draw(0, start) << np.uint64(20) | place, np.uint64(1) << np.uint64(63))
    lowest = np.sort(np.partition(key, most - 1, axis=1)[:, :most], axis=1)
    limit = lowest[np.arange(len(sizes)), np.maximum(wanted, 1) - 1]
    chosen = selectable & (key <= limit[:, None]) & (wanted[:, None] > 0)
    kind = draw(1, start[chosen]) % np.uint64(100)
    new = np.where(kind < mask_percent, MASK, (draw(2, start[chosen]) % np.uint64(VOCABULARY)).astype(np.int64))
    tokens[chosen] = np.where(kind < mask_percent + random_percent, new, tokens[chosen])
    values[offsets[0] : offsets[-1]] = tokens[there]


def corrupt_tokens(
    tokens: Column,
    row_id: Column,
    seed: int,
    rate_percent: int = 10,
    mask_percent: int = 90,
    random_percent: int = 10,
    cap: int = MASK_CAP,
) -> Column:
    """Replaces a share of the selectable tokens by the mask token or a random one.

    Of the selectable tokens the share is taken, rounded up and at most ``cap``;
    which ones depends only on the seed, the row id and the position.
    """
    small_batches(SparkSession.active())

    @F.arrow_udf("array<int>")
    def corrupt(batch: pa.Array, ids: pa.Array) -> pa.Array:
        offsets = np.asarray(batch.offsets).astype(np.int64)
        values = np.asarray(batch.flatten()).astype(np.int64)
        offsets = offsets - offsets[0]
        base = (np.asarray(ids).astype(np.uint64) & np.uint64(LOW32)) * np.uint64(MIX) + np.uint64(seed * SEED_STEP)
        for start in range(0, len(base), ROWS_AT_ONCE):
            rows = slice(start, start + ROWS_AT_ONCE)
            _corrupt_rows(values, offsets[start : start + ROWS_AT_ONCE + 1], base[rows], rate_percent, mask_percent, random_percent, cap)
        return _lists(values, offsets, batch.is_null())

    return corrupt(tokens, row_id)


def masked_labels(original: Column, corrupted: Column) -> Column:
    """(position, original token) of every mask token."""
    pairs = F.transform(
        F.arrays_zip(original.alias("token"), corrupted.alias("shown")),
        lambda pair, i: F.struct(i.alias("pos"), pair["token"].alias("token"), pair["shown"].alias("shown")),
    )
    hits = F.filter(pairs, lambda p: p["shown"] == MASK)
    return F.transform(hits, lambda p: F.struct(p["pos"].alias("pos"), p["token"].alias("token")))


def class_token_position(tokens: Column) -> Column:
    """0-based position of the first class token; NULL if there is none."""
    return F.nullif(F.array_position(tokens, CLS), F.lit(0)) - 1


def pooled_vector(tokens: Column, vectors: Column) -> Column:
    """The vector at the class token, zeros where there is no class token."""
    at = F.array_position(tokens, CLS).cast("int")
    zeros = F.transform(F.element_at(vectors, 1), lambda x: x * 0)
    return F.when(at > 0, F.try_element_at(vectors, at)).otherwise(zeros)


def slot_vector(vectors: Column, length: Column) -> Column:
    """The vector of the slot right behind a sequence of ``length`` packets."""
    return F.try_element_at(vectors, (length + 1).cast("int"))
