"""Tables that streams keep: edges in buckets, sessions with a timeout."""

import os
import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import Row
from pyspark.sql import functions as F

from packetlake.operators.graph import EDGE_KEY, EDGE_STATS, upsert_edges
from packetlake.operators.dns import flag_retransmissions
from packetlake.streaming.dns import write_repeated_queries
from packetlake.streaming.edgetable import EdgeTable
from packetlake.streaming.sessions import SESSIONS, IdleTimeout, idle_sessions, write_idle_sessions

EDGES = "label string, src binary, dst binary, protocol string, src_port int, dst_port int, " + ", ".join(f"{c} long" for c in EDGE_STATS)


def edges(spark, rnd, ports):
    rows = [("IPv4", b"\x0a\0\0\1", b"\x0a\0\0\2", None if p % 7 == 0 else "TCP", p, 80, *(rnd.randrange(1000) for _ in EDGE_STATS)) for p in ports]
    return spark.createDataFrame(rows, EDGES)


def files(folder):
    return {os.path.relpath(os.path.join(d, f), folder): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def keyed(rows):
    """Sorted rows; a null protocol is a key of its own here."""
    return sorted((tuple(map(repr, (r[c] for c in (*EDGE_KEY, *EDGE_STATS))))) for r in rows.collect())


def test_edge_table_equals_upserts_and_writes_changed_buckets_only(spark, tmp_path):
    rnd = random.Random(2)
    table = EdgeTable(spark, str(tmp_path / "edges"), buckets=8, compact_after=3)
    expected = {}
    for number, ports in enumerate([range(1, 60), [3, 4], [3, 99], [3], [], range(40, 80), [3]]):
        new = edges(spark, rnd, ports).cache()
        for r in new.collect():
            expected[tuple(map(repr, (r[c] for c in EDGE_KEY)))] = tuple(map(repr, (r[c] for c in EDGE_STATS)))
        before = files(tmp_path / "edges") if number else {}
        table.upsert(new, number)
        after = files(tmp_path / "edges")
        assert all(after[f] == t for f, t in before.items())
        touched = {r.b for r in new.select(F.pmod(F.xxhash64(*EDGE_KEY), F.lit(8)).alias("b")).distinct().collect()}
        fresh = {f for f in after if f not in before and not f.startswith("commits")}
        assert {int(f.split("bucket=")[1].split("/")[0]) for f in fresh} == touched
        assert keyed(table.view()) == sorted(k + v for k, v in expected.items())
        if number == 3:
            table.upsert(new, number)
            assert keyed(table.view()) == sorted(k + v for k, v in expected.items())
    assert len(keyed(table.view(0))) == 59
    read = [f for f in table.merged({0: table.commit_before(None)[0]}).inputFiles()]
    assert read and all("bucket=0/" in f for f in read)


def test_edge_table_follows_plain_upserts(spark, tmp_path):
    rnd = random.Random(4)
    plain, table = None, EdgeTable(spark, str(tmp_path / "edges"), buckets=4, compact_after=2)
    for number in range(4):
        new = edges(spark, rnd, [p for p in rnd.sample(range(1, 60), 20) if p % 7]).cache()
        plain = new if plain is None else upsert_edges(plain, new)
        table.upsert(new, number)
        assert keyed(table.view()) == keyed(plain)


def test_idle_timeout_with_late_and_open_sessions(spark, tmp_path):
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    a, b = b"\x0a\0\0\1", b"\x0a\0\0\2"

    def packets(*seconds, port=1):
        return [(start + timedelta(seconds=s), a, b, port, 80, "TCP", 10) for s in seconds]

    arriving = [
        packets(0, 100, 299) + packets(50, port=2),
        packets(700, 550) + packets(1000, port=2),  # 550 is late by less than the delay and joins 299 to 700
        packets(5000) + packets(5000, port=3),
        packets(20) + packets(5100, port=3),  # 20 is too late
    ]
    schema = "ts timestamp, src_ip binary, dst_ip binary, src_port int, dst_port int, protocol string, size int"
    for rows in arriving:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    write_idle_sessions(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.schema(SESSIONS).parquet(str(tmp_path / "out")).collect()
    base = int(start.timestamp())
    seen = sorted((r.port_lo, r.first_seen_us // 10**6 - base, r.last_seen_us // 10**6 - base, r.packets, r.bytes) for r in got)
    assert seen == [(1, 0, 700, 5, 50), (2, 50, 50, 1, 10), (2, 1000, 1000, 1, 10)]
    # A second run finds nothing new and writes nothing again.
    write_idle_sessions(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert spark.read.schema(SESSIONS).parquet(str(tmp_path / "out")).count() == 3


def test_packets_combine_before_the_state(spark, tmp_path):
    """The plan aggregates per flow and slot before the first exchange."""
    schema = "ts timestamp, src_ip binary, dst_ip binary, src_port int, dst_port int, protocol string, size int"
    os.makedirs(tmp_path / "in")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    plan = idle_sessions(stream)._jdf.queryExecution().analyzed().toString()
    assert plan.index("TransformWithState") < plan.index("Aggregate") < plan.index("StreamingRelation")


def test_dns_state_equals_the_batch_operator_and_expires(spark, tmp_path):
    start, rnd = datetime(2024, 1, 1, tzinfo=timezone.utc), random.Random(3)
    schema = "packet_no long, ts timestamp, qry_name string, qry_type int, qry_class int"
    rows, number = [], 0
    for part in range(4):
        batch = []
        for _ in range(200):
            number += 1
            # Whole seconds give ties; a third of all rows ask one name; one type is null.
            at = start + timedelta(seconds=1800 * part + rnd.randrange(600))
            batch.append((number, at, "hot" if rnd.random() < 0.33 else f"n{rnd.randrange(40)}", rnd.choice([1, 28, None]), 1))
        rows += batch
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    progress = write_repeated_queries(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    flags = ("packet_no", "dns_retransmit", "dns_retransmit_request_in")
    got = sorted(tuple(r[c] for c in flags) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    expected = sorted(tuple(r[c] for c in flags) for r in flag_retransmissions(spark.createDataFrame(rows, schema)).collect())
    assert got == expected and sum(r[1] for r in got) > 100
    # After every part the slots of the parts before it are gone.
    held = [p.stateOperators[0].numRowsTotal for p in progress if p.stateOperators]
    assert len(held) >= 4 and max(held[1:]) <= 2 * held[0]
    late = [(9001, start, "hot", 1, 1), (9002, start + timedelta(seconds=7300), "hot", 1, 1)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    write_repeated_queries(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.packet_no for r in spark.read.parquet(str(tmp_path / "out")).filter("packet_no > 9000").collect()} == {9002}


class Held:
    """State and timers of one group in memory; counts the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.put([])

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_a_group_of_flows_takes_few_calls_to_the_state():
    gap, rnd, held = 300_000_000, random.Random(5), Held()
    processor = IdleTimeout(gap)
    processor.init(held)
    # Whole minutes give gaps of exactly 300 s; one protocol is null.
    times = {p: sorted({rnd.randrange(300) * 60_000_000 for _ in range(20)}) for p in range(200)}
    flow = {p: (b"\x0a\0\0\1", b"\x0a\0\0\2", p, 80, "TCP" if p else None) for p in times}
    got = []
    for start in range(0, 300 * 60_000_000, 75 * 60_000_000):
        rows = [Row(*flow[p], t, t, 1, 10, None) for p in times for t in times[p] if start <= t < start + 75 * 60_000_000]
        rnd.shuffle(rows)
        before = held.calls
        got += processor.handleInputRows((0,), iter(rows), None)
        assert len(rows) > 500 and held.calls - before <= 4
        assert held.timers == {min(processor.deadline_ms(r[6]) for r in held.rows)}
    middle = sorted(processor.deadline_ms(r[6]) for r in held.rows)[100]
    for now in (middle, 10**9):
        held.timers.clear()
        got += processor.handleExpiredTimer((0,), Now(now), None)
        assert all(processor.deadline_ms(r[6]) > now for r in held.rows) and len(held.timers) == bool(held.rows)
    expected = []
    for p, seen in times.items():
        runs = [[seen[0]]]
        for t in seen[1:]:
            runs.append([t]) if t - runs[-1][-1] > gap else runs[-1].append(t)
        expected += [(*flow[p], r[0], r[-1], len(r), 10 * len(r)) for r in runs]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, expected))


def test_edge_batches_read_packets_that_were_computed_once(spark, sf_dir, monkeypatch):
    from packetlake.queries.streams import edge_table_versions

    plans, upsert = [], EdgeTable.upsert

    def seen(self, edges, number):
        plans.append(edges._jdf.queryExecution().optimizedPlan().toString())
        upsert(self, edges, number)

    monkeypatch.setattr(EdgeTable, "upsert", seen)
    assert edge_table_versions(spark, sf_dir).count() > 0
    assert len(plans) == 5
    for plan in plans:
        # No filter lies below the packets, where it would repeat their expressions.
        above = plan.split("InMemoryRelation")[0]
        assert "InMemoryRelation" in plan and "unhex" not in above
