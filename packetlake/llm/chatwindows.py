"""Chat formatting in windows of a token budget that follow turns."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import slices
from packetlake.llm.wordpieces import word_pieces

#: Tokens of a window, and how many of them may repeat earlier turns.
BUDGET, HISTORY = 1024, 256
#: Turn numbers that are formatted together; windows end there, histories reach at most so many turn numbers back across.
SEGMENT, CARRIED = 256, 32
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a turn besides those of role and text: both marks and two line ends.
TURN_TOKENS = 4
#: Kinds of rows of a segment, in the order in which they come.
SYSTEM, EARLIER, OWN = 0, 1, 2

WINDOWS = (
    "conv_id long, segment long, window int, text string, n_repeated int, n_turns int, n_tokens long, "
    "over_budget boolean, loss array<struct<start:int,length:int>>"
)
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escaped(text: Column) -> Column:
    """``text`` without control strings: one backslash more in each "<", backslashes, "|"."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """As ``escaped``; line ends, which close a role, become a mark that no escaped text holds."""
    return F.regexp_replace(escaped(role), "\n", "<|n|>")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def unescaped_role(role: str) -> str:
    return unescaped(role.replace("<|n|>", "\n"))


def counted(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, turn, role, text, n_tokens) of every row: escaped, with the tokens that its turn takes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_pieces(tokenizer)
        for batch in batches:
            for low, high in slices(batch.column(3)):
                part = batch.slice(low, high - low)
                roles, texts = (encoder.encode(part.column(c).to_pylist()) for c in (2, 3))
                sizes = [TURN_TOKENS + (len(r) + len(t)) // 4 for r, t in zip(roles, texts)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64())], ["conv_id", "turn", "role", "text", "n_tokens"])

    empty = F.lit("")
    rows = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        escaped_role(F.coalesce(F.col("role").cast("string"), empty)).alias("role"),
        escaped(F.coalesce(F.col("text").cast("string"), empty)).alias("text"),
    )
    return rows.mapInArrow(count, "conv_id long, turn long, role string, text string, n_tokens long")


def segments(turns: DataFrame, tokenizer: str) -> DataFrame:
    """(conv_id, segment, rows): turns in order, SEGMENT turn numbers at a time.

    A long conversation is many segments, so none is gathered whole. Each
    segment also gets the last turns of the one before it, and one row of kind
    SYSTEM: the turn that begins the conversation (without text if it is no
    system turn). The first segment of a conversation has no such row.
    """
    segment = F.coalesce(F.floor(F.col("turn") / SEGMENT), F.lit(-(1 << 62)))
    raw = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    places = raw.select("conv_id", segment.alias("segment")).distinct()
    several = places.groupBy(F.col("conv_id").alias("c")).agg(F.min("segment").alias("first"), F.count("*").alias("n")).filter("n > 1")
    same = F.equal_null("conv_id", "c")
    later = places.join(several, same).filter("segment > first").select("conv_id", "segment")

    rows = counted(raw, tokenizer).withColumn("segment", segment)
    own = F.struct(F.col("segment"), F.lit(OWN).alias("kind"))
    ahead = F.struct((F.col("segment") + 1).alias("segment"), F.lit(EARLIER).alias("kind"))
    late = F.coalesce(F.pmod("turn", F.lit(SEGMENT)) >= SEGMENT - CARRIED, F.lit(False))
    dealt = rows.withColumn("place", F.explode(F.when(late, F.array(own, ahead)).otherwise(F.array(own))))
    dealt = dealt.select("conv_id", "place.segment", "place.kind", "turn", "role", "text", "n_tokens")
    # Only conversations of several segments send their leading turn on, and no other text moves for it.
    system = F.col("role") == "system"
    lead = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.when(system, F.col("text")).alias("text"))
    leads = raw.join(several, same, "left_semi").groupBy("conv_id").agg(F.min(lead).alias("lead"))
    leads = counted(leads.select("conv_id", "lead.*"), tokenizer)
    systems = later.withColumnRenamed("conv_id", "c").join(leads, same).select("conv_id", "segment", F.lit(SYSTEM).alias("kind"), "turn", "role", "text", "n_tokens")
    everything = dealt.unionByName(systems)
    row = F.struct("kind", "turn", "role", "text", "n_tokens")
    gathered = everything.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return gathered.filter(F.exists("rows", lambda r: r["kind"] == OWN))


def spans(tokens: np.ndarray, system: int, lead: int, first: int, budget: int, history: int) -> Iterator[tuple[int, int, int]]:
    """(from, new, end) of each window over turns with ``tokens``: history ``from`` to ``new``, new turns to ``end``.

    ``system`` tokens are spent in each window, but not in the one that the system
    turn itself begins: ``lead`` is 1 where it is turn 0. Turns before ``first``
    are history only. Sums of whole spans are differences
    of prefix sums, so each end is one search. A window without room for its
    history and a new turn goes without history; a turn larger than the budget
    is a window of its own.
    """
    sums = np.concatenate([[0], np.cumsum(tokens)])
    new = first
    while new < len(tokens):
        spent = system if new >= lead else 0
        since = min(max(int(np.searchsorted(sums, sums[new] - history)), lead), new)
        end = int(np.searchsorted(sums, sums[since] + budget - spent, "right")) - 1
        if end <= new:
            since = new
            end = max(int(np.searchsorted(sums, sums[new] + budget - spent, "right")) - 1, new + 1)
        yield since, new, end
        new = end


def windows(turns: DataFrame, tokenizer: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """Formatted windows of all conversations in ``turns`` (conv_id, turn, role, text): WINDOWS.

    Every turn is new in exactly one window. Windows after the first repeat the
    system turn that begins the conversation, then the turns before their new
    ones as far as ``history`` tokens go; ``n_repeated`` counts both. ``loss``
    holds the places (code points) of the texts of new assistant turns, so a
    repeated target is under no mask. ``over_budget`` marks windows whose one
    new turn, with the system turn, is larger than ``budget``.

    Null text or role is empty; equal turn numbers go by role and text, null
    ones come first; rows without conv_id are one conversation; a repeated row
    is a turn again. Control strings in texts are escaped. Windows end at
    multiples of SEGMENT turn numbers, whatever the size of a conversation.
    """

    def form(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv, segment, rows in zip(*(c.to_pylist() for c in batch.columns)):
                later = rows[0]["kind"] == SYSTEM
                repeated = [r for r in rows[:1] if r["role"] == "system"]
                rows = rows[later:]
                lead = len(repeated) * (not later)
                first = sum(r["kind"] == EARLIER for r in rows)
                tokens = np.array([r["n_tokens"] for r in rows])
                system = sum(r["n_tokens"] for r in repeated)
                for window, (since, new, end) in enumerate(spans(tokens, system, lead, first, budget, history)):
                    head = repeated if new >= lead else []
                    text, loss, at = [], [], 0
                    for place, r in [*((-1, r) for r in head), *enumerate(rows[since:end], since)]:
                        opening = f"{START}{r['role']}\n"
                        if place >= new and r["role"] == "assistant":
                            loss.append({"start": at + len(opening), "length": len(r["text"])})
                        text.append(f"{opening}{r['text']}{END}\n")
                        at += len(text[-1])
                    spent = int(tokens[since:end].sum()) + sum(r["n_tokens"] for r in head)
                    out.append((conv, segment, window, "".join(text), len(head) + new - since, len(head) + end - since, spent, spent > budget, loss))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), WINDOW_TYPES)], WINDOW_NAMES)

    kind = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    WINDOW_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), kind]
    WINDOW_NAMES = ["conv_id", "segment", "window", "text", "n_repeated", "n_turns", "n_tokens", "over_budget", "loss"]
    return segments(turns, tokenizer).mapInArrow(form, WINDOWS)


def new_turns(text: str, n_repeated: int) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window that it does not repeat, as they were before formatting."""
    return [(unescaped_role(r), unescaped(t)) for r, t in _TURN.findall(text)[n_repeated:]]


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation of ``formatted`` windows, read from their text and loss places alone.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    A digest takes its text in order, so the windows of a conversation pass
    through one task; it keeps the state of one digest and one batch of windows.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        state = None
        for batch in batches:
            for conv, text, n_repeated, loss in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(ended(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in new_turns(text, n_repeated):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for place in loss:
                    target = unescaped(text[place["start"] : place["start"] + place["length"]])
                    state[3] += len(target)
                    state[4].update(target.encode())
                state[5] += len(text)
            yield packed(done)
            done = []
        yield packed([] if state is None else [ended(state)])

    def ended(state: list) -> tuple:
        return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, types)], names)

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return ordered.select("conv_id", "text", "n_repeated", "loss").mapInArrow(digest, schema)
