"""Repeated DNS queries in a stream."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from packetlake.operators.dns import FLAGS, QUERY_KEY, STATE_AGE_US, WINDOW_US, flag_retransmissions
from packetlake.streaming.state import append_with_state

STATE = ["packet_no", "ts", *QUERY_KEY]


def write_flagged_queries(queries: DataFrame, path: str, state: str, checkpoint: str) -> None:
    """Flags every micro-batch against the last time each query was asked.

    The state is a table with one row per query asked in the last 300 seconds of
    stream time. A micro-batch runs the batch operator over its rows and that
    table, so a popular name is spread there as well. A repeated batch replaces
    its own folders.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        both = batch.select(*STATE).withColumn("carried", F.lit(False))
        if number > 0:
            known = spark.read.parquet(f"{state}/version={number - 1}")
            both = both.unionByName(known.select(*STATE).withColumn("carried", F.lit(True)))
        flagged = flag_retransmissions(both).filter(~F.col("carried")).drop("carried")
        flagged.write.mode("overwrite").parquet(f"{path}/batch={number}")
        order = F.struct("ts", "packet_no")
        last = both.groupBy(*QUERY_KEY).agg(F.max_by(order, order).alias("l")).select("l.packet_no", "l.ts", *QUERY_KEY)
        newest = both.agg(F.max("ts")).scalar()
        fresh = F.unix_micros("ts") >= F.unix_micros(newest) - STATE_AGE_US
        last.filter(fresh).write.mode("overwrite").parquet(f"{state}/version={number}")
        batch.unpersist()

    query = (
        queries.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


class RepeatedQueries(StatefulProcessor):
    """Flags the queries of one name in one slot of time; the state is the time of the last one.

    Queries of the slot before come along as carries: they are not flagged here
    but may be what a query of this slot repeats. The watermark ends the state
    when the slot is over, as then no query of it can follow.
    """

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, number long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.last.get() if self.last.exists() else None
        newest = last = before and tuple(before)
        for at, number, asked in sorted((r.ts_us, r.packet_no, r.asked) for r in rows):
            if asked:
                since = at - last[0] if last else None
                repeated = since is not None and 0 < since <= self.window_us
                yield Row(packet_no=number, ts_us=at, **dict(zip(QUERY_KEY, key)), **dict(zip(FLAGS, (repeated, since if repeated else None))))
            last = (at, number)
            newest = max(newest, last) if newest else last
        self.last.update(newest)
        if before is None:
            self.handle.registerTimer((key[-1] + 1) * self.window_us // 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def repeated_queries(queries: DataFrame, window_us: int = WINDOW_US, delay: str = "10 minutes") -> DataFrame:
    """``packet_no, ts_us``, the query and both flags of ``flag_retransmissions``, for a stream (append mode).

    The state is keyed by query and slot of ``window_us``: a repeat lies in the
    slot of the query it repeats or in the next one, so a task holds at most the
    new queries of one name in two slots, and a replay of a popular name spreads
    over its slots. Queries that come later than ``delay`` behind the newest one
    are left out. The state needs the RocksDB provider.
    """
    ts_us = F.unix_micros("ts")
    slot = F.floor(ts_us / F.lit(window_us)).cast("long")
    copies = F.array(
        F.struct(slot.alias("slot"), F.lit(True).alias("asked")), F.struct((slot + 1).alias("slot"), F.lit(False).alias("asked"))
    )
    timed = queries.withWatermark("ts", delay).select("packet_no", "ts", ts_us.alias("ts_us"), *QUERY_KEY, F.explode(copies).alias("__c"))
    slotted = timed.select("packet_no", "ts", "ts_us", *QUERY_KEY, "__c.slot", "__c.asked")
    schema = StructType([slotted.schema[c] for c in ("packet_no", "ts_us", *QUERY_KEY)]).add(FLAGS[0], "boolean").add(FLAGS[1], "long")
    return slotted.groupBy(*QUERY_KEY, "slot").transformWithState(RepeatedQueries(window_us), schema, "append", "EventTime")


def write_repeated_queries(queries: DataFrame, path: str, checkpoint: str, window_us: int = WINDOW_US, delay: str = "10 minutes") -> list:
    """Drains the stream; every query is appended once, with its flags. Returns the progress of the micro-batches."""
    return append_with_state(repeated_queries(queries, window_us, delay), path, checkpoint)
