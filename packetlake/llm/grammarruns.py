"""Periodic runs of words, found once per rule of a Re-Pair grammar."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.llm.common import slices

#: A run has at least this many words, and at least this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Bytes of text that share one grammar; a single longer text has one of its own.
GRAMMAR_BYTES = 1 << 20
#: Pairs are no longer chosen by frequency once a round replaces less than this share of them;
#: what is left is paired from left to right. Runs found do not depend on it.
LEAST_SHARE = 1 / 64
#: Parts of a period at which two halves are compared before the whole halves are.
PROBES = (0.5, 0.25, 0.75, 0.125, 0.875)

RUNS = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def word_ids(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words of all texts, their ids (equal words, equal ids), and where each text begins (end last)."""
    words, begins = [], [0]
    for text in texts:
        words += text.split()  # white space of bytes is that of the contract
        begins.append(len(words))
    ids = pa.array(words, pa.binary()).dictionary_encode().indices.to_numpy()
    return words, ids.astype(np.int64), np.array(begins)


def frequent_pairs(at: np.ndarray, number: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Which of the pairs at positions ``at`` are replaced this round.

    Where pairs overlap, the more frequent one wins; so all pairs that a
    sequential Re-Pair would take before any of their neighbours go at once.
    Of overlapping equal pairs every second one is taken. Pairs met once stay.
    """
    rank = (count << 32) | (np.arange(len(count)) * 2654435761 & 0xFFFFFFFF)
    near = at[1:] == at[:-1] + 1
    opens = np.ones(len(at), bool)
    opens[1:] = ~near | (number[1:] != number[:-1])
    first = np.flatnonzero(opens)
    own = rank[number[first]]
    before, after = np.full(len(first), -1), np.full(len(first), -1)
    touching = near[first[1:] - 1]
    before[1:][touching] = own[:-1][touching]
    after[:-1][touching] = own[1:][touching]
    wins = (own > before) & (own > after) & (count[number[first]] > 1)
    part = np.cumsum(opens) - 1
    return np.flatnonzero(wins[part] & ((np.arange(len(at)) - first[part]) % 2 == 0))


def derivation(ids: np.ndarray, begins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, middle, end, rule) of every replaced pair, round by round.

    Rule X -> YZ is replaced at all places it derives, Y from ``first`` to
    ``middle`` and Z from there to ``end``. Equal rule numbers of a round are
    one rule. Every two neighbouring words of a text are the middle of one place.
    """
    symbol, start = ids.copy(), np.arange(len(ids))
    text = np.repeat(np.arange(len(begins) - 1), np.diff(begins))
    fresh = int(ids.max()) + 1 if len(ids) else 0
    frequent = True
    while True:
        inside = text[1:] == text[:-1]
        at = np.flatnonzero(inside)
        if not len(at):
            return
        key = symbol[at] * fresh + symbol[at + 1]
        if frequent:
            _, number, count = np.unique(key, return_inverse=True, return_counts=True)
            chosen = frequent_pairs(at, number, count)
            frequent = len(chosen) > LEAST_SHARE * len(at)
            if not len(chosen):
                continue
        else:
            head = np.flatnonzero(np.concatenate([[True], ~inside]))
            place = at - head[np.searchsorted(head, at, "right") - 1]
            chosen = np.flatnonzero(place % 2 == 0)
        rules, rule = np.unique(key[chosen], return_inverse=True)
        left = at[chosen]
        end = np.append(start[1:], len(ids))[left + 1]
        yield start[left], start[left + 1], end, rule
        symbol[left] = fresh + rule
        fresh += len(rules)
        stays = np.ones(len(symbol), bool)
        stays[left + 1] = False
        symbol, start, text = symbol[stays], start[stays], text[stays]


def agree(ids: np.ndarray, i: int, j: int, limit: int) -> int:
    """How many words from ``i`` on equal those from ``j`` on, at most ``limit``."""
    done, block = 0, 64
    while done < limit:
        size = min(block, limit - done)
        other = ids[i + done : i + done + size] != ids[j + done : j + done + size]
        place = int(other.argmax())
        if other[place]:
            return done + place
        done, block = done + size, block * 4
    return limit


def agree_back(ids: np.ndarray, i: int, j: int, limit: int) -> int:
    """How many words before ``i`` equal those before ``j``, at most ``limit``."""
    done, block = 0, 64
    while done < limit:
        size = min(block, limit - done)
        other = (ids[i - done - size : i - done] != ids[j - done - size : j - done])[::-1]
        place = int(other.argmax())
        if other[place]:
            return done + place
        done, block = done + size, block * 4
    return limit


def half_candidates(ids: np.ndarray, middle: np.ndarray, room: np.ndarray, whole: np.ndarray, side: int) -> tuple[list[int], list[int]]:
    """(rule, period) where the half beside the middle may begin with two equal periods.

    ``side`` is 1 for the words behind the middle and -1 for those before it.
    """
    most = np.where(room >= 3, np.minimum(room // 2, whole // LEAST_PERIODS), 0)
    rule = np.repeat(np.arange(len(most)), most)
    period = np.arange(len(rule)) - np.repeat(np.cumsum(most) - most, most) + 1
    base = middle[rule] if side > 0 else middle[rule] - 1
    kept = ids[base] == ids[base + side * period]
    rule, period, base = rule[kept], period[kept], base[kept]
    for part in (1, *PROBES):
        offset = np.maximum(period - 1, 1) if part == 1 else (period * part).astype(np.int64)
        kept = ids[base + side * offset] == ids[base + side * (offset + period)]
        rule, period, base = rule[kept], period[kept], base[kept]
    return rule.tolist(), period.tolist()


def crossing_runs(ids: np.ndarray, first: np.ndarray, middle: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(rule, start, end, period) of the runs of each place that cross its middle, maximal within it.

    A run of four periods has two of them, and three words, on one side of the
    middle. A multiple of a shorter period that reaches as far is no period of its own.
    """
    found = []
    whole = end - first
    large = np.flatnonzero(whole >= LEAST_WORDS)
    f, m, e, w = first[large], middle[large], end[large], whole[large]
    for side, room in ((1, e - m), (-1, m - f)):
        last, known = -1, []
        for rule, q in zip(*half_candidates(ids, m, room, w, side)):
            if rule != last:
                last, known = rule, []
            if any(q % shorter == 0 and reach >= 2 * q for shorter, reach in known):
                continue
            low, at, high = int(f[rule]), int(m[rule]), int(e[rule])
            if side > 0:
                reach = agree(ids, at, at + q, high - at - q)
            else:
                reach = agree_back(ids, at - q, at, at - q - low)
            if reach < max(q, 3 - q):
                continue
            known.append((q, q + reach))
            over = agree_back(ids, at, at + q, at - low) if side > 0 else agree(ids, at - q, at, high - at)
            if over and over + q + reach >= max(LEAST_WORDS, LEAST_PERIODS * q):
                start = at - over if side > 0 else at - q - reach
                found.append((int(large[rule]), start, start + over + q + reach, q))
    return found


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals that lie in no other of their period, each with its smallest period, by start and period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.concatenate([[0], period[1:] != period[:-1]])) if len(period) else period
    reach = group * (int(end.max(initial=0)) + 1) + end
    before = np.concatenate([[-1], np.maximum.accumulate(reach)[:-1]]) if len(reach) else reach
    kept = reach > before
    start, end, period = start[kept], end[kept], period[kept]
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    fresh = np.ones(len(start), bool)
    fresh[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[fresh], end[fresh], period[fresh]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_of(ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of the texts, by start and period."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for first, middle, end, rule in derivation(ids, begins):
        _, one = np.unique(rule, return_index=True)
        found = crossing_runs(ids, first[one], middle[one], end[one])
        if not found:
            continue
        order = np.argsort(rule, kind="stable")
        bounds = np.searchsorted(rule[order], np.arange(len(one) + 1))
        for at, start, stop, period in found:
            places = first[order[bounds[at] : bounds[at + 1]]] - first[one[at]]
            parts.append((places + start, places + stop, np.full(len(places), period)))
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return maximal(*(np.concatenate(column) for column in zip(*parts)))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, runs, collapsed) for every row of ``docs`` (doc_id, text); other columns are not read.

    Words are what stands between white space. ``runs`` (start, length, period;
    words numbered from 0) are all maximal stretches of at least six words and
    four periods, with their smallest period, by start and period. ``collapsed``
    joins by one space the words that no run repeats: of each run the first
    period stays. A null text has no words; a doc_id may be null or repeated.

    Texts of GRAMMAR_BYTES are rewritten by one Re-Pair grammar, so copies share
    its rules. A run crosses the middle of the least rule that derives it, so it
    is looked for once in each rule, and what is found holds at every place of
    the rule. Runs cut off by the end of a rule lie in a longer one of another
    rule. Memory is bounded by the grammar's texts, or by the longest text.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1), GRAMMAR_BYTES):
                part = batch.slice(low, high - low)
                words, ids, begins = word_ids([text or b"" for text in part.column(1).to_pylist()])
                start, end, period = runs_of(ids, begins)
                text = np.searchsorted(begins, start, "right") - 1
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, end, -1)
                dropped = np.cumsum(change) > 0
                hit = set(text.tolist())
                collapsed = []
                for row, (a, b) in enumerate(zip(begins.tolist(), begins[1:].tolist())):
                    own = words[a:b] if row not in hit else [words[i] for i in np.flatnonzero(~dropped[a:b]) + a]
                    collapsed.append(b" ".join(own).decode())
                offsets = pa.array(np.searchsorted(text, np.arange(high - low + 1)).astype(np.int32))
                columns = [pa.array(c) for c in (start - begins[text], end - start, period)]
                found = pa.StructArray.from_arrays(columns, ["start", "length", "period"])
                arrays = [part.column(0), pa.ListArray.from_arrays(offsets, found), pa.array(collapsed, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(find, RUNS)
