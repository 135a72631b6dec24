"""Capture files: split points, byte orders, damage, and the job on top."""

import datetime
import random
import struct

import pytest
from pyspark.sql import functions as F

from packetlake.plans.capture import read_frames, run_capture_job
from packetlake.plans.sequences import training_batch, validation_batches, with_flow_id
from packetlake.fixtures import labelled_packets, synth_frames
from packetlake.queries import load
from packetlake.sources.pcap import capture_damage, list_captures, open_capture, record_ranges
from packetlake.sources import indexed
from packetlake.sources.indexed import gather_rows, read_slice, write_indexed
from packetlake.sources.sinks import append_payloads, read_payloads
from packetlake.sources.tables import preview


def capture(path, records, order="<", nanos=False, link=1):
    magic = 0xA1B23C4D if nanos else 0xA1B2C3D4
    scale = 1000 if nanos else 1
    with open(path, "wb") as out:
        out.write(struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link))
        for seconds, micros, data in records:
            out.write(struct.pack(order + "IIII", seconds, micros * scale, len(data), len(data)) + data)


def records(n, seed=1):
    rnd = random.Random(seed)
    return [(1_700_000_000 + i, rnd.randrange(1_000_000), rnd.randbytes(rnd.choice([20, 60, 400, 1500]))) for i in range(n)]


@pytest.mark.parametrize("order,nanos", [("<", False), (">", False), ("<", True), (">", True)])
@pytest.mark.parametrize("split", [0, 999, 20_000])
def test_every_record_once_and_in_order(spark, tmp_path, order, nanos, split):
    made = {"a.pcap": records(150, 1), "b.pcap": records(80, 2)}
    for name, rows in made.items():
        capture(tmp_path / name, rows, order, nanos)
    got = read_frames(spark, str(tmp_path), split_bytes=split).orderBy("packet_no").select(F.unix_micros("ts").alias("us"), "data").collect()
    want = [(s * 1_000_000 + u, d) for name in sorted(made) for s, u, d in made[name]]
    assert [(r.us, bytes(r.data)) for r in got] == want


def test_a_cut_last_record_is_left_out(spark, tmp_path):
    capture(tmp_path / "a.pcap", records(20))
    whole = (tmp_path / "a.pcap").read_bytes()
    (tmp_path / "a.pcap").write_bytes(whole[:-5])
    assert read_frames(spark, str(tmp_path), damage="stop").count() == 19
    with pytest.raises(Exception, match="whole record"):
        read_frames(spark, str(tmp_path)).count()


@pytest.mark.parametrize("split", [0, 700, 934, 1794])
def test_payloads_that_look_like_records(spark, tmp_path, split):
    inner = b"".join(struct.pack("<IIII", 1_700_000_000, 7, 60, 60) + bytes(60) for _ in range(20))
    capture(tmp_path / "a.pcap", [*records(5), (1_700_000_009, 1, inner)])
    got = read_frames(spark, str(tmp_path), split_bytes=split).collect()
    assert len(got) == 6 and inner in {bytes(r.data) for r in got}


@pytest.mark.parametrize("split", [0, 300_000])
def test_empty_and_large_records(spark, tmp_path, split):
    made = records(40)
    made[7:7] = [(1_700_000_000, 5, b"")]
    made[20:20] = [(1_700_000_000, 6, bytes(9_000_000))]
    capture(tmp_path / "a.pcap", made)
    (tmp_path / "b.pcap").write_bytes((tmp_path / "a.pcap").read_bytes()[:24])
    got = read_frames(spark, str(tmp_path), split_bytes=split).orderBy("packet_no").select(F.length("data").alias("n")).collect()
    assert [r.n for r in got] == [len(d) for _, _, d in made]


@pytest.mark.parametrize("split", [0, 500])
def test_a_damaged_length_is_listed(spark, tmp_path, split):
    made = records(10)
    capture(tmp_path / "a.pcap", made)
    capture(tmp_path / "b.pcap", made)
    whole = bytearray((tmp_path / "a.pcap").read_bytes())
    at = 24 + sum(16 + len(d) for _, _, d in made[:3])
    whole[at + 8 : at + 12] = struct.pack("<I", 1 << 30)
    (tmp_path / "a.pcap").write_bytes(whole)
    with pytest.raises(Exception, match=f"byte {at} "):
        read_frames(spark, str(tmp_path), split_bytes=split).count()
    assert read_frames(spark, str(tmp_path), split_bytes=split, damage="stop").count() == 3 + 10
    (row,) = capture_damage(spark, str(tmp_path)).select("file_no", "at", "bytes_left", F.unix_micros("ts").alias("us")).collect()
    assert tuple(row) == (0, at, len(whole) - at, made[3][0] * 1_000_000 + made[3][1])


def nested(rnd, depth=2):
    """A payload of capture records whose own payloads are capture records."""
    if not depth:
        return rnd.choice([bytes(rnd.randrange(80)), rnd.randbytes(rnd.randrange(80))])
    parts = [nested(rnd, depth - 1) for _ in range(rnd.randrange(1, 6))]
    return b"".join(struct.pack("<IIII", 1_700_000_000, 7, len(p), len(p)) + p for p in parts)


def walked(data, split):
    """The first record of each range, by walking the file from its beginning; damage ends it."""
    at, out, last = 24, [], -1
    while at + 16 <= len(data):
        size = 16 + struct.unpack_from("<I", data, at + 8)[0]
        if at // split != last:
            last = at // split
            out.append(at)
        if at + size > len(data):
            break
        at += size
    else:
        if at < len(data) and at // split != last:
            out.append(at)
    return out


@pytest.mark.parametrize("split", [777, 5_000])
def test_composed_maps_equal_a_walk(spark, tmp_path, split):
    rnd = random.Random(split)
    made = {}
    for number, snap in enumerate([65535, 100, 40, 0, 300]):
        rows = []
        for _ in range(120):
            data = rnd.choice([nested(rnd), bytes(rnd.randrange(300)), rnd.randbytes(rnd.randrange(200)), b"", nested(rnd, 3) * 3])
            rows.append((1_700_000_000, 5, data))
        name = tmp_path / f"{number}.pcap"
        capture(name, rows)
        raw = bytearray(name.read_bytes())
        raw[16:20] = struct.pack("<I", snap)  # records longer than the file says are entries that nobody foresaw
        name.write_bytes(raw[: len(raw) - 3 * (number % 2)])
        made[number] = bytes(raw[: len(raw) - 3 * (number % 2)])
    files = list_captures(str(tmp_path))
    ranges = record_ranges(spark, str(tmp_path), files, split)
    got = {}
    for r in ranges.collect():
        assert r.stop == min(r.size, (r.start // split + 1) * split)
        got.setdefault(r.file_no, []).append(r.start)
    assert {n: sorted(s) for n, s in got.items()} == {n: walked(data, split) for n, data in made.items()}
    whole = sum(1 for n in made for _ in records_of(made[n]))
    assert read_frames(spark, str(tmp_path), split_bytes=split, damage="stop").count() == whole
    assert {(r.file_no, r.at) for r in capture_damage(spark, str(tmp_path), split_bytes=split).collect()} == {
        (n, end_of(data)) for n, data in made.items() if n % 2
    }


def records_of(data):
    at = 24
    while at + 16 <= len(data):
        size = 16 + struct.unpack_from("<I", data, at + 8)[0]
        if at + size > len(data):
            return
        yield at
        at += size


def end_of(data):
    *_, last = records_of(data)
    return last + 16 + struct.unpack_from("<I", data, last + 8)[0]


def test_no_task_walks_a_whole_file(spark, tmp_path):
    """Each range looks at itself and a bounded lead-in, and foresees its true entry."""
    rows = [(1_700_000_000, i, nested(random.Random(i))) for i in range(3000)]
    capture(tmp_path / "a.pcap", rows)
    (file,) = list_captures(str(tmp_path))
    split, true = 20_000, walked((tmp_path / "a.pcap").read_bytes(), 20_000)
    with open_capture(str(tmp_path), file.path, file.size) as opened:
        opened.reach, read = 2_000, []
        plain, opened.source = opened.source, type("Counted", (), {"read_at": lambda self, n, at: (read.append(n), plain.read_at(n, at))[1]})()
        for number, at in enumerate(true[1:], 1):
            entries = opened.entries(number * split)
            assert at in entries and sum(read) <= 4 * 2_000 + 16
            read.clear()
    ranges = record_ranges(spark, str(tmp_path), [file], split)
    assert ranges.count() == len(true) and ranges.rdd.getNumPartitions() >= 1


def test_packet_numbers_never_overflow(tmp_path):
    for name in "abc":
        capture(tmp_path / name, records(2))
    with pytest.raises(ValueError, match="offset_bits"):
        list_captures(str(tmp_path), offset_bits=62)
    with pytest.raises(ValueError, match="offset_bits"):
        list_captures(str(tmp_path), offset_bits=3)


def test_other_link_types_are_refused(spark, tmp_path):
    capture(tmp_path / "a.pcap", records(2), link=101)
    with pytest.raises(Exception, match="not Ethernet"):
        read_frames(spark, str(tmp_path)).count()


def test_payloads_of_one_flow(spark, tmp_path):
    rows = spark.range(100).select(
        F.concat(F.lit("k"), (F.col("id") % 7).cast("string")).alias("flow_key"), F.col("id").alias("packet_no"), F.lit(b"x").alias("payload")
    )
    append_payloads(rows, str(tmp_path / "q"), buckets=4)
    append_payloads(rows, str(tmp_path / "q"), buckets=4)
    assert read_payloads(spark, str(tmp_path / "q"), "k3", buckets=4).count() == 2 * 14


def test_capture_job_with_queues(spark, sf_dir, tmp_path):
    small = sf_dir.replace("sf0.01", "sf0.001")
    totals = run_capture_job(synth_frames(spark, small), str(tmp_path / "out"), cache_payloads=True)
    packets = spark.read.parquet(str(tmp_path / "out/packets"))
    assert packets.count() == totals["frames"] - totals["issues"] == spark.read.parquet(str(tmp_path / "out/queues")).count()
    assert spark.read.parquet(str(tmp_path / "out/errors")).count() == totals["issues"]
    assert len(preview(packets).collect()) == 5


def test_sequence_jobs(spark, sf_dir):
    packets = labelled_packets(spark, sf_dir.replace("sf0.01", "sf0.001"))
    batches = validation_batches(packets, 4, 16)
    assert batches.groupBy("batch_id").count().filter("count > 16").isEmpty()
    drawn = training_batch(packets, 40, 8, seed=3)
    assert drawn.count() == 40 and drawn.filter((F.size("tokens") != 9) | (F.col("length") > 8)).isEmpty()
    assert with_flow_id(packets).filter("FlowID IS NULL").isEmpty()


class Counted:
    """A source that notes how many bytes are asked for."""

    def __init__(self, source):
        self.source, self.bytes = source, 0

    def read_at(self, size, at):
        self.bytes += size
        return self.source.read_at(size, at)


def test_a_range_reads_and_maps_only_itself(spark, tmp_path):
    rows = [(s, u, d[:20] + bytes(len(d) - 20)) for s, u, d in records(30_000)]
    capture(tmp_path / "a.pcap", rows)
    path, split = str(tmp_path / "a.pcap"), 64 * 1024
    size = (tmp_path / "a.pcap").stat().st_size
    with open_capture(path, path, size) as opened:
        opened.source = Counted(opened.source)
        entries = opened.entries(20 * split)
        opened.source.bytes = 0
        left = opened.exits([at for at in entries if at < 21 * split], 21 * split)
        assert opened.source.bytes <= split + 16 and left
        opened.source.bytes, first = 0, min(a for a in left if a >= 20 * split)
        list(opened.blocks(first, 21 * split))
        assert opened.source.bytes <= 2 * (split + opened.reach)
    files = list_captures(path)
    plan = record_ranges(spark, path, files, split)
    # What meets in the task of a file is a row per range, with few chains.
    maps = plan._jdf.queryExecution().analyzed().toString()
    assert "entries#" in maps and "exits#" in maps
    assert read_frames(spark, path, split_bytes=split).count() == len(rows)


def test_many_short_segments_share_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indexed, "FOLDERS", 8)
    path = str(tmp_path / "t")
    write_indexed(spark.range(2000).selectExpr("id * 5 AS packet_no", "id AS v"), "packet_no", path, per_segment=10)
    assert len(list((tmp_path / "t").glob("segment=*"))) == 8
    assert sorted(r.v for r in read_slice(spark, path, 245, 30, 10).collect()) == list(range(245, 275))
    wanted = spark.createDataFrame([(0, 5), (1, 1999), (2, 5), (3, 7000)], "draw int, row_idx long")
    assert sorted((r.draw, r.v) for r in gather_rows(wanted, path, 10).collect()) == [(0, 5), (1, 1999), (2, 5)]


def test_slices_and_gathers_read_their_folders(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(2000).selectExpr("shiftleft(id, 40) AS packet_no", "id AS v")
    write_indexed(rows.repartition(3), "packet_no", path, per_segment=100)
    found = read_slice(spark, path, 250, 120, 100)
    assert sorted(r.v for r in found.collect()) == list(range(250, 370))
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(segment" in scan and "PushedFilters: [IsNotNull(row_idx)" in scan
    assert read_slice(spark, path, 1990, 50, 100).count() == 10 and read_slice(spark, path, 5000, 5, 100).isEmpty()
    with pytest.raises(ValueError, match="slice"):
        read_slice(spark, path, -1, 5)
    wanted = spark.createDataFrame([(0, 5), (1, 1999), (2, 5), (3, 7000)], "draw int, row_idx long")
    got = gather_rows(wanted, path, 100)
    assert sorted((r.draw, r.v) for r in got.collect()) == [(0, 5), (1, 1999), (2, 5)]
    assert "segment#" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["pcap_scan", "pcap_one_file"])
def test_no_frames_are_broadcast(spark, tmp_path, name):
    """Frames are far larger than the ranges by which Spark judges them, so they must not pass through the driver."""
    base = datetime.datetime(2024, 1, 1)
    made = [(i * 3, base + datetime.timedelta(microseconds=i * 1_000_003), i % 7, ("click", "signup")[i % 2], 1.5, f'{{"k": "{"é" * (i % 90)}"}}') for i in range(4000)]
    made[5] = (*made[5][:5], "")
    rows = spark.createDataFrame(made, "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
    rows.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    result = load()[name][0](spark, str(tmp_path))
    got = sorted((r.frame_no, r.timestamp_s, r.timestamp_us, r.props) for r in result.collect())
    assert got == [(n, 1_704_067_200 + n * 1_000_003 // 1_000_000, n * 1_000_003 % 1_000_000, r[5].encode().hex().upper()) for n, r in enumerate(made)]
    assert "Broadcast" not in result._jdf.queryExecution().executedPlan().toString()
