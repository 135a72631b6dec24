"""The three-packet flow, skewed flows, and ordering rules."""

import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from packetlake.functions.net import ip_text, ipv4_from_text, is_internal
from packetlake.operators import flows as ops
from packetlake.operators.dns import flag_retransmissions
from packetlake.operators.ordered import SEGMENT, balanced, numbered, previous_value, row_index, segment_of
from packetlake.operators.skew import join_salted
from packetlake.schemas import FLOW_KEY

SCHEMA = "packet_no long, ts timestamp, src_ip binary, dst_ip binary, src_port int, dst_port int, protocol string, size int"
A, B = bytes([192, 168, 1, 1]), bytes([192, 168, 1, 2])


def at(seconds, micros=0):
    return datetime.fromtimestamp(seconds, timezone.utc).replace(microsecond=micros)


ROWS = [
    (1, at(10, 500_000), A, B, 12345, 80, "TCP", 125),
    (2, at(12, 500_000), B, A, 80, 12345, "TCP", 150),
    (3, at(14, 5), A, B, 12345, 80, "TCP", 80),
]


def test_three_packets_running(spark):
    running = ops.running_flow_stats(spark.createDataFrame(ROWS, SCHEMA)).orderBy("packet_no").collect()
    seen = [
        (r.fwd_packet_count, r.fwd_byte_count, r.bwd_packet_count, r.bwd_byte_count, r.min_packet_size, r.max_packet_size, r.duration_us)
        for r in running
    ]
    assert seen == [
        (1, 125, 0, 0, 125, 125, 0),
        (1, 125, 1, 150, 125, 150, 2_000_000),
        (2, 205, 1, 150, 80, 150, 3_500_005),
    ]


def test_three_packets_final(spark):
    flows = ops.flow_stats(spark.createDataFrame(ROWS, SCHEMA))
    row = flows.first()
    assert flows.count() == 1
    assert (row.duration_us // 1_000_000, row.duration_us // 1000) == (3, 3500)
    assert abs(row.avg_pps - 3 / 3.500005) < 1e-9 and abs(row.avg_bps - 355 / 3.500005) < 1e-9
    assert abs(row.avg_packet_size - 355 / 3) < 1e-9
    assert ops.flow_duration(flows).first().duration_ms == 3500


def test_equal_endpoints_count_backward_and_addresses_order_as_numbers(spark):
    low, high = bytes([9, 0, 0, 1]), bytes([10, 0, 0, 2])
    rows = [(1, at(1), A, A, 5, 5, "TCP", 10), (2, at(1), low, high, 9, 1, "TCP", 10)]
    flows = {bytes(r.ip_lo): r for r in ops.flow_stats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (flows[A].fwd_packet_count, flows[A].bwd_packet_count) == (0, 1)
    assert flows[low].fwd_packet_count == 1


def test_clock_going_back_is_flagged(spark):
    rows = [(1, at(10), A, B, 1, 2, "TCP", 10), (2, at(5), A, B, 1, 2, "TCP", 10)]
    row = ops.flow_stats(spark.createDataFrame(rows, SCHEMA)).first()
    assert row.clock_went_back and row.duration_us == 0 and row.avg_bps == 10.0


def hot_packets(spark, n=4000):
    """A third of all packets in one flow."""
    rnd = random.Random(3)
    rows = []
    for i in range(n):
        port = 1 if i % 3 == 0 else rnd.randrange(2, 200)
        ends = (A, B, port, 80) if rnd.random() < 0.5 else (B, A, 80, port)
        rows.append((i, at(1000 + i * 7, i % 1000), *ends, "TCP", 60 + rnd.randrange(1000)))
    return spark.createDataFrame(rows, SCHEMA)


def test_segments_do_not_change_running_stats(spark):
    packets = hot_packets(spark).cache()
    whole = ops.running_flow_stats(packets, width=1 << 30)
    cut = ops.running_flow_stats(packets, width=37)
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty()
    final = ops.flow_stats(packets)
    last = cut.join(cut.groupBy(*FLOW_KEY).agg(F.max("packet_no").alias("packet_no")), [*FLOW_KEY, "packet_no"])
    assert final.exceptAll(last.select(*final.columns)).isEmpty()


def test_numbered_over_segments(spark):
    rows = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id") % 5).alias("k"))
    placed = numbered(rows, ["k"], ["id"], segment_of("id", 13), "rn", "total").collect()
    groups = {}
    for r in sorted(placed, key=lambda r: r.id):
        groups.setdefault(r.k, []).append(r)
    assert len(placed) == 1000
    for members in groups.values():
        assert [r.rn for r in members] == list(range(len(members)))
        assert {r.total for r in members} == {len(members)}


def test_balanced_segments_of_sparse_orders(spark):
    """Offsets with 40 bits per file, a hot key, small keys, ties, and an order without variety."""
    rnd = random.Random(3)
    rows = [("hot", (i % 5 << 40) + 60 * i) for i in range(3000)] + [(f"k{i % 50}", i << 40) for i in range(400)]
    rows += [("tied", 7)] * 300 + [("tied", 7 + i) for i in range(300)] + [("same", 5)] * 400 + [(None, i) for i in range(200)]
    rows += [("last", 9)] * 299 + [("last", 3)]
    rnd.shuffle(rows)
    cut = balanced(spark.createDataFrame(rows, "k string, at long"), ["k"], "at", target=100).collect()
    assert sorted(map(repr, ((r.k, r.at) for r in cut))) == sorted(map(repr, rows))
    parts = {}
    for r in cut:
        parts.setdefault((r.k, r[2]), []).append(r.at)
    for key in {r.k for r in cut}:
        ranges = [(min(v), max(v), len(v)) for (k, s), v in sorted(parts.items(), key=repr) if k == key]
        ranges.sort()
        by_segment = [(min(v), max(v)) for (k, s), v in sorted(((p, v) for p, v in parts.items() if p[0] == key), key=lambda x: x[0][1])]
        assert by_segment == sorted(by_segment) and all(a[1] < b[0] for a, b in zip(by_segment, by_segment[1:]))
        assert all(n <= 100 or lo == hi for lo, hi, n in ranges)
    assert len([1 for k, _ in parts if k == "hot"]) >= 30 and len([1 for k, _ in parts if k == "k1"]) == 1
    indexed = row_index(spark.createDataFrame([(a,) for a in range(0, 4000 << 40, 4 << 40)], "at long"), "at", "i", width=64)
    assert indexed.filter("i <> at div (4L << 40)").isEmpty() and indexed.count() == 1000


def test_a_name_with_a_third_of_all_queries_is_cut(spark):
    rnd = random.Random(8)
    rows = [(i, at(1000 + i // 4, i % 4 * 250_000), "hot" if i % 3 == 0 else f"n{rnd.randrange(60)}", 1, 1) for i in range(1500)]
    rows += [(5000 + i, at(1100), "hot", 1, 1) for i in range(40)]
    queries = spark.createDataFrame(rows, "packet_no long, ts timestamp, qry_name string, qry_type int, qry_class int")
    whole, cut = flag_retransmissions(queries), flag_retransmissions(queries, target=50)
    assert whole.exceptAll(cut).isEmpty() and cut.exceptAll(whole).isEmpty() and cut.count() == len(rows)
    last = {}
    for r in sorted(whole.collect(), key=lambda r: (r.ts, r.packet_no)):
        since = int((r.ts - last[r.qry_name]).total_seconds() * 1e6) if r.qry_name in last else None
        assert r.dns_retransmit == (since is not None and 0 < since <= 60_000_000)
        assert r.dns_retransmit_request_in == (since if r.dns_retransmit else None)
        last[r.qry_name] = r.ts
    cuts = balanced(queries.withColumn("ts_us", F.unix_micros("ts")), ["qry_name"], "ts_us", 50)
    assert cuts.filter("qry_name = 'hot'").select(SEGMENT).distinct().count() > 8


def test_previous_value_over_segments(spark):
    rows = spark.range(500).select("id", (F.col("id") % 4).alias("k"), (F.col("id") * 10).alias("v"))
    linked = previous_value(rows, ["k"], ["id"], segment_of("id", 9), "v", "before").collect()
    assert all(r.before == (None if r.id < 4 else (r.id - 4) * 10) for r in linked)


def test_sessions_merge_a_gap_of_exactly_300_seconds(spark):
    times = [0, 299, 599, 900, 1000]
    rows = [(i, at(10_000 + t), A, B, 1, 2, "TCP", 1) for i, t in enumerate(times)]
    sessions = ops.flow_sessions(spark.createDataFrame(rows, SCHEMA)).orderBy("session_no").collect()
    assert [s.packets for s in sessions] == [3, 2]


def test_salted_join_equals_plain_join(spark):
    large = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain, salted = large.join(small, "k", how), join_salted(large, small, ["k"], how, salts=5)
        assert plain.exceptAll(salted.select(*plain.columns)).isEmpty() and plain.count() == salted.count()


def test_salted_join_broadcasts_by_the_size_of_all_copies(spark):
    large = spark.range(20_000).select((F.col("id") % 2500).alias("k"), "id")
    # 2,000 keys are below 64 KB, 16 copies of each are above; 20 keys are below with their copies.
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(64 << 10))
    try:
        for keys, how, kind in ((2000, "left_semi", "SortMergeJoin"), (2000, "left", "SortMergeJoin"), (20, "left_semi", "BroadcastHashJoin")):
            small = spark.range(keys * 3).select((F.col("id") % keys).alias("k")).distinct()
            joined = join_salted(large, small, ["k"], how)
            assert len(joined.collect()) == (20_000 if how == "left" else 8 * keys)
            final = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert "isFinalPlan=true" in final and f"{kind} " in final
            assert "SortMergeJoin" not in final or kind == "SortMergeJoin"
    finally:
        spark.conf.set(limit, before)


def test_address_text(spark):
    import ipaddress

    rnd = random.Random(1)
    groups = [0, 0, 0, 1, 0xFE80, 0xAB, 0xFFFF]
    rows = [(b"".join(rnd.choice(groups).to_bytes(2, "big") for _ in range(8)),) for _ in range(500)]
    rows += [(bytes(16),), (bytes(15) + b"\x01",), (bytes(10) + b"\xff\xff\x01\x02\x03\x04",), (bytes([8, 8, 4, 4]),)]
    shown = spark.createDataFrame(rows, "a binary").select("a", ip_text(F.col("a")).alias("t")).collect()
    assert all(r.t == str(ipaddress.ip_address(bytes(r.a))) for r in shown)


def test_address_scope(spark):
    cases = {
        "10.1.2.3": True, "11.0.0.0": False, "172.15.255.255": False, "172.16.0.0": True, "172.31.255.255": True,
        "172.32.0.0": False, "192.168.9.9": True, "192.169.0.0": False, "127.0.0.1": True, "169.254.3.4": True, "8.8.8.8": False,
    }
    rows = spark.createDataFrame(list(cases.items()), "t string, want boolean")
    assert rows.filter(is_internal(ipv4_from_text(F.col("t"))) != F.col("want")).isEmpty()
    v6 = {"::1": True, "::2": False, "fe80::1": True, "febf::": True, "fec0::": False, "fc00::1": True, "fdff::": True, "ff02::1": True, "2001:db8::": False}
    import ipaddress

    packed = [(ipaddress.ip_address(k).packed, v) for k, v in v6.items()]
    assert spark.createDataFrame(packed, "a binary, want boolean").filter(is_internal(F.col("a")) != F.col("want")).isEmpty()


def test_invalid_ipv4_text(spark):
    bad = ["1.2.3", "1.2.3.256", "01.2.3.4", "a.b.c.d", "", "1.2.3.4.5"]
    assert spark.createDataFrame([(b,) for b in bad], "t string").filter(ipv4_from_text(F.col("t")).isNotNull()).isEmpty()
