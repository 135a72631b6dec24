"""Token arrays against plain Python."""

import random

import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from packetlake.functions.ids import host_pair_id, unordered_id
from packetlake.functions.tokens import apply_mask, corrupt_tokens, encode_tokens, masked_bytes, masked_labels
from packetlake.operators.sequences import assemble_sequences, flow_sequences


def packets(spark, sizes):
    rnd = random.Random(5)
    rows = []
    for i, n in enumerate(sizes):
        rows.append((i, bytearray(rnd.randbytes(n)), bytearray(rnd.choice([0, 1]) for _ in range(n))))
    return spark.createDataFrame(rows, "packet_no long, data binary, mask binary"), rows


def test_encode_matches_plain_python(spark):
    frame, rows = packets(spark, [0, 1, 7, 1518, 300])
    for placement in ("SOS", "EOS"):
        got = frame.select("packet_no", encode_tokens(F.col("data"), F.col("mask"), 260, placement).alias("t")).collect()
        for r in got:
            _, data, mask = rows[r.packet_no]
            body = [260 if m else d for d, m in zip(data, mask)]
            want = [258, *body, 257] if placement == "SOS" else [*body, 258]
            assert r.t == want + [256] * (1520 - len(want))


def test_overflow_rules(spark):
    frame, rows = packets(spark, [1519, 1520, 10])
    args = (F.col("data"), F.col("mask"), 260, "EOS")
    with pytest.raises(PythonException, match="more than the 1519"):
        frame.select(encode_tokens(*args)).collect()
    cut = frame.select(encode_tokens(*args, overflow="truncate").alias("t")).collect()
    assert [r.t[1519] for r in cut] == [258, 258, 256]
    kept = frame.select(encode_tokens(*args, overflow="drop").alias("t")).collect()
    assert [r.t is None for r in kept] == [False, True, False]
    with pytest.raises(ValueError):
        encode_tokens(*args[:3], "middle")


def test_masking_and_extraction(spark):
    frame, rows = packets(spark, [0, 5, 64])
    got = frame.select(
        "packet_no", apply_mask(F.col("data"), F.col("mask")).alias("z"), masked_bytes(F.col("data"), F.col("mask")).alias("x")
    ).collect()
    for r in got:
        _, data, mask = rows[r.packet_no]
        assert r.z == [0 if m else d for d, m in zip(data, mask)]
        assert bytes(r.x) == bytes(d for d, m in zip(data, mask) if m)


def test_corruption_share_and_repeatability(spark):
    frame, _ = packets(spark, [0, 3, 1000, 1500])
    tokens = frame.select("packet_no", encode_tokens(F.col("data"), F.col("mask")).alias("t"))
    both = tokens.select("t", corrupt_tokens(F.col("t"), F.col("packet_no"), 1).alias("c"))
    again = tokens.repartition(3).select("t", corrupt_tokens(F.col("t"), F.col("packet_no"), 1).alias("c"))
    assert both.exceptAll(again).isEmpty()
    for r in both.withColumn("l", masked_labels(F.col("t"), F.col("c"))).collect():
        selectable = sum(t < 256 for t in r.t)
        changed = sum(a != b for a, b in zip(r.t, r.c))
        assert changed <= -(-selectable // 10) and all(a == b for a, b in zip(r.t, r.c) if a > 255)
        assert [(x.pos, x.token) for x in r.l] == [(i, a) for i, (a, b) in enumerate(zip(r.t, r.c)) if b == 259]
    heavy = tokens.select(corrupt_tokens(F.col("t"), F.col("packet_no"), 1, rate_percent=100, mask_percent=100, random_percent=0).alias("c"))
    assert max(sum(t == 259 for t in r.c) for r in heavy.collect()) == 380


def test_sequences_of_a_hot_flow(spark):
    rows = [(i, bytearray([i % 256]), bytearray([0]), "x" if i % 3 else "y", 1 if i % 3 == 0 else i % 7) for i in range(400)]
    frame = spark.createDataFrame(rows, "packet_no long, data binary, mask binary, AttackLabel string, FlowID long")
    cut, whole = flow_sequences(frame, 6, width=11), flow_sequences(frame, 6)
    assert cut.exceptAll(whole).isEmpty() and cut.count() == whole.count()
    got = assemble_sequences(cut, 6).collect()
    flows = {}
    for n, data, _, label, flow in rows:
        flows.setdefault((label, flow), []).append(data[0])
    assert len(got) == sum(max(1, len(v) // 6) for v in flows.values())
    for r in got:
        members = flows[r.AttackLabel, r.FlowID][r.seq_no * 6 : r.seq_no * 6 + 6]
        assert r.length == len(members) and len(r.tokens) == 7
        assert [t[0] for t in r.tokens[: r.length]] == members
        assert all(set(t) == {256} for t in r.tokens[r.length :])


def test_ids_ignore_order(spark):
    macs, ips = bytes(range(12)), bytes(range(20, 28))
    back = macs[6:] + macs[:6] + b"\x08\x00" + b"\x00" * 12 + ips[4:] + ips[:4]
    there = macs + b"\x08\x00" + b"\x00" * 12 + ips
    mask = b"\x01" * 12 + b"\x00" * 14 + b"\x01" * 8
    frame = spark.createDataFrame([(bytearray(there), bytearray(mask)), (bytearray(back), bytearray(mask))], "data binary, mask binary")
    for digest in ("md5", "xxhash64"):
        assert frame.select(host_pair_id(F.col("data"), F.col("mask"), digest)).distinct().count() == 1
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "a int, b int")
    assert pairs.select(unordered_id(F.col("a"), F.col("b"))).distinct().count() == 1


def test_token_functions_bound_the_batches_of_a_worker(spark):
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    frame, _ = packets(spark, [40] * 1200)
    spark.conf.set(rows, "10000")

    @F.arrow_udf("long")
    def seen(batch: pa.Array) -> pa.Array:
        return pa.array([len(batch)] * len(batch), pa.int64())

    tokens = encode_tokens(F.col("data"), F.col("mask"))
    widest = frame.coalesce(1).select(seen(corrupt_tokens(tokens, F.col("packet_no"), 7)).alias("n")).agg(F.max("n")).scalar()
    assert frame.select(widest.alias("n")).first().n <= 500


def test_md5_of_joined_token_rows(spark):
    import hashlib

    from packetlake.queries.labelled import joined_md5

    rows = [(0, [[0, 9, 10], [256, 258, 99]]), (1, [[100], [0], [7]]), (2, [[999, 0]])]
    got = {r.i: r.d for r in spark.createDataFrame(rows, "i int, t array<array<int>>").select("i", joined_md5("t").alias("d")).collect()}
    assert got == {i: hashlib.md5(",".join(str(x) for row in t for x in row).encode()).hexdigest() for i, t in rows}
