"""Flows closed by an idle timeout in a packet stream, each written once."""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from packetlake.operators.flows import SESSION_GAP_US, flow_measures
from packetlake.schemas import FLOW_KEY
from packetlake.streaming.state import append_with_state

STATS = ["first_seen_us", "last_seen_us", "packets", "bytes"]
SESSIONS = "ip_lo binary, ip_hi binary, port_lo int, port_hi int, protocol string, " + ", ".join(f"{c} long" for c in STATS)


# Flows are dealt to so many groups; a group keeps its open sessions in one state.
GROUPS = 4096


class IdleTimeout(StatefulProcessor):
    """Merges the slots of a group of flows into sessions; one open session per flow is kept.

    A session ends when a slot begins more than ``gap_us`` after its last packet,
    or when the watermark says that no slot with an earlier packet can follow.
    The state is read and written once per group and micro-batch, and one timer
    stands at the first deadline of the group.
    """

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("open", SESSIONS)

    def deadline_ms(self, last_us: int) -> int:
        """A packet within the gap lies in a slot that ends within two gaps."""
        return -(-(last_us + 2 * self.gap_us) // 1000)

    def first_deadline(self, sessions: dict) -> int | None:
        return min((self.deadline_ms(s[1]) for s in sessions.values()), default=None)

    def load(self) -> dict:
        n = len(FLOW_KEY)
        return {tuple(r[:n]): tuple(r[n:]) for r in self.state.get()}

    def store(self, sessions: dict) -> None:
        if sessions:
            self.state.put([(*flow, *s) for flow, s in sessions.items()])
        else:
            self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, m = len(FLOW_KEY), len(FLOW_KEY) + len(STATS)
        sessions = self.load()
        before = self.first_deadline(sessions)
        for slot, flow in sorted(((tuple(r[n:m]), tuple(r[:n])) for r in rows), key=itemgetter(0)):
            session = sessions.get(flow)
            if session and slot[0] - session[1] <= self.gap_us:
                slot = (min(session[0], slot[0]), max(session[1], slot[1]), session[2] + slot[2], session[3] + slot[3])
            elif session:
                yield self.closed(flow, session)
            sessions[flow] = slot
        self.store(sessions)
        after = self.first_deadline(sessions)
        if after != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(after)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        sessions, now = self.load(), timerValues.getCurrentWatermarkInMs()
        over = [flow for flow, s in sessions.items() if self.deadline_ms(s[1]) <= now]
        for flow in over:
            yield self.closed(flow, sessions.pop(flow))
        self.store(sessions)
        if sessions:
            self.handle.registerTimer(self.first_deadline(sessions))

    def closed(self, flow, session) -> Row:
        return Row(**dict(zip(FLOW_KEY, flow)), **dict(zip(STATS, session)))

    def close(self) -> None:
        pass


def idle_sessions(packets: DataFrame, gap_us: int = SESSION_GAP_US, delay: str = "10 minutes", groups: int = GROUPS) -> DataFrame:
    """Sessions of a packet stream (append mode): SESSIONS, each once it is over.

    Packets are combined per flow and slot of ``gap_us`` before the shuffle, so a
    busy flow sends one row per slot and task to its state. Packets that come
    later than ``delay`` behind the newest one are left out. The state needs the
    RocksDB provider. The flows of one of ``groups`` are kept together, so the
    number of calls to the state follows the groups and not the flows; a stream
    with many millions of flows open at a time takes more groups. It may not
    change for a checkpoint once written.
    """
    micros = f"{gap_us} microseconds"
    slots = (
        flow_measures(packets.withWatermark("ts", delay))
        .groupBy(F.window("ts", micros), *FLOW_KEY)
        .agg(
            F.min("ts_us").alias("first_seen_us"),
            F.max("ts_us").alias("last_seen_us"),
            F.count(F.lit(1)).alias("packets"),
            F.sum("bytes").cast("long").alias("bytes"),
        )
    )
    group = F.pmod(F.xxhash64(*FLOW_KEY), F.lit(groups)).cast("int")
    placed = slots.select(*FLOW_KEY, *STATS, "window", group.alias("flow_group"))
    return placed.groupBy("flow_group").transformWithState(IdleTimeout(gap_us), SESSIONS, "append", "EventTime")


def write_idle_sessions(packets: DataFrame, path: str, checkpoint: str, gap_us: int = SESSION_GAP_US, delay: str = "10 minutes") -> None:
    """Drains the stream; every closed session is appended exactly once."""
    append_with_state(idle_sessions(packets, gap_us, delay), path, checkpoint)
