"""Packet tables along a curve: whole rows, and how little of them a question reads."""


import pytest
from pyspark.sql import functions as F

from packetlake.functions.net import ipv4_from_long
from packetlake.sources.clustered import endpoint_packets, interleaved, read_clustered, write_clustered

START = 1_704_067_200
ROWS, HOUR = 200_000, 3600


def packets(spark, rows):
    """Ten days of packets; one server has a third of them, on either side."""
    ids = spark.range(0, rows, numPartitions=8).withColumnRenamed("id", "packet_no")
    busy = F.when(F.pmod(F.xxhash64("packet_no"), F.lit(3)) == 0, 1).otherwise(F.pmod(F.xxhash64("packet_no", F.lit(1)), F.lit(500)))
    user = F.lit(10_000) + F.pmod(F.xxhash64("packet_no", F.lit(2)), F.lit(3000))
    forward = F.col("packet_no") % 2 == 0
    return ids.select(
        "packet_no",
        F.timestamp_seconds(F.lit(START) + F.floor(F.col("packet_no") * (240 * HOUR) / rows)).alias("ts"),
        ipv4_from_long(F.when(forward, busy).otherwise(user)).alias("src_ip"),
        ipv4_from_long(F.when(forward, user).otherwise(busy)).alias("dst_ip"),
        F.lit(1).alias("src_port"),
        F.lit(2).alias("dst_port"),
        F.lit("Ethernet->IPv4->TCP").alias("protocol"),
        F.lit("Ethernet->IPv4->TCP").alias("proto_hierarchy"),
        F.unhex(F.sha2(F.col("packet_no").cast("string"), 512)).alias("data"),
        F.unhex(F.sha2(F.col("packet_no").cast("string"), 512)).alias("mask"),
        F.lit(54).alias("header_len"),
    )


def rows_read(frame):
    """Rows that the scan handed on, after row groups and pages were skipped."""
    frame = frame.select("*")  # A plan adds up the rows of all its runs.
    plan = frame._jdf.queryExecution().executedPlan()
    frame._jdf.queryExecution().toRdd().count()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_interleaved(spark):
    row = spark.range(1).select(interleaved([F.lit(0b10).cast("long"), F.lit(0b11).cast("long"), F.lit(0b00).cast("long")], 2))
    assert row.first()[0] == 0b110010
    with_low_bits = spark.range(1).select(interleaved([F.lit(7).cast("long"), F.lit(0).cast("long")], 2))
    assert with_low_bits.first()[0] == 0b1010


def test_whole_and_pruned(spark, tmp_path):
    given, path = packets(spark, ROWS), str(tmp_path / "table")
    write_clustered(given, path, files=16, group_bytes=1 << 20, page_rows=50)
    stored = read_clustered(spark, path)
    keys = ["packet_no", "src_ip", "dst_ip", "data", "mask"]
    assert stored.select(keys).exceptAll(given.select(keys)).isEmpty() and stored.count() == ROWS
    sizes = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    # Ranges are cut from a sample.
    assert len(sizes) == 16 and max(sizes) < 2 * ROWS / 16
    read = {}
    for address in (77, 1, 10_042):
        for hours in (24, 240):
            begin = START + (240 - hours) // 2 * HOUR
            found = endpoint_packets(stored, address.to_bytes(4, "big"), begin, begin + hours * HOUR)
            met = F.lit(address.to_bytes(4, "big")).isin(F.col("src_ip"), F.col("dst_ip"))
            time = F.unix_seconds("ts")
            wanted = given.filter(met & (time >= begin) & (time < begin + hours * HOUR))
            assert sorted(r.packet_no for r in found.collect()) == sorted(r.packet_no for r in wanted.collect())
            read[address, hours] = rows_read(found) / ROWS
    # In the order of capture a day is a tenth of the table, and an endpoint all of it.
    assert read[77, 24] < 0.07 and read[10_042, 24] < 0.07 and read[77, 240] < 0.4 and read[10_042, 240] < 0.4
    # The busy server is on one side of a third of all packets.
    assert read[1, 24] < 0.1 and read[1, 240] < 0.6


def test_bursts_and_odd_tables(spark, tmp_path):
    given = packets(spark, 20_000)
    one = given.withColumns({"src_ip": F.lit(b"\x00\x00\x00\x01"), "dst_ip": F.lit(b"\x00\x00\x00\x02"), "ts": F.timestamp_seconds(F.lit(START))})
    write_clustered(one, str(tmp_path / "burst"), files=8)
    sizes = [r["count"] for r in read_clustered(spark, str(tmp_path / "burst")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 5_000
    write_clustered(given.limit(0), str(tmp_path / "empty"), files=8)
    assert read_clustered(spark, str(tmp_path / "empty")).count() == 0
    gaps = given.limit(50).withColumns({"src_ip": F.lit(None).cast("binary"), "ts": F.lit(None).cast("timestamp")})
    write_clustered(gaps, str(tmp_path / "gaps"), files=8)
    assert read_clustered(spark, str(tmp_path / "gaps")).filter("src_ip IS NULL").count() == 50
    with pytest.raises(Exception, match="already exists"):
        write_clustered(given, str(tmp_path / "gaps"), files=8)


def test_packets_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = packets(spark, 1000)
    write_clustered(rows.mapInArrow(count, rows.schema), str(tmp_path / "table"), files=3)
    assert seen.value == 1000
    assert read_clustered(spark, str(tmp_path / "table")).count() == 1000
