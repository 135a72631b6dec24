"""Queries through streams, captures and stored tables."""

from __future__ import annotations

import functools

from pyspark import StorageLevel
from pyspark.sql import functions as F

from packetlake.fixtures import (
    document_segments,
    landed_events,
    packets_of,
    queries_of,
    synth_devices,
    synth_frames,
    synth_packets,
    with_instants,
    write_captures,
)
from packetlake.functions.clock import micros_part, seconds_part
from packetlake.functions.flowkey import flow_key_text, with_normalised_key
from packetlake.operators.decode import decode_packets
from packetlake.operators.flows import flow_stats
from packetlake.operators.graph import device_nodes, flow_edges
from packetlake.plans.capture import read_frames, run_capture_job
from packetlake.plans.pretraining import pretraining_batches
from packetlake.queries.base import FLOW_COLUMNS, FLOW_TEXT, FLOWS_CTE, PACKETS_CTE, REGISTRY, as_text, query, sql_hash
from packetlake.queries.decoding import FRAMES_CTE
from packetlake.queries.graph import EDGES_CTE
from packetlake.queries.labelled import KEY_SQL
from packetlake.queries.tokens import EOS_SQL, SEGMENTS_CTE
from packetlake.schemas import FLOW_KEY, PACKET_TABLE
from packetlake.session import shared_folder
from packetlake.sources.pcap import capture_damage
from packetlake.sources.sinks import append_payloads, write_feature_csv, write_packet_table
from packetlake.sources.tables import read_packet_table, read_topology
from packetlake.streaming.dns import write_flagged_queries, write_repeated_queries
from packetlake.streaming.drain import drain, message_stream
from packetlake.streaming.edgetable import EdgeTable
from packetlake.streaming.sessions import SESSIONS, write_idle_sessions
from packetlake.streaming.flows import (
    latest_flows,
    latest_graph,
    new_flows,
    session_updates,
    upsert_graph,
    write_flow_updates,
)


def _arriving(spark, sf_dir, folder):
    """Events as a stream of files, one per micro-batch."""
    landed_events(spark, sf_dir, f"{folder}/landed")
    schema = spark.read.parquet(f"{folder}/landed").schema
    return with_instants(message_stream(spark, f"{folder}/landed", schema, files=1))


@query("stream_flow_stats", REGISTRY["flow_stats"][1])
def stream_flow_stats(spark, sf_dir):
    folder = shared_folder(spark, "stream-flows")
    write_flow_updates(packets_of(_arriving(spark, sf_dir, folder)), f"{folder}/flows", f"{folder}/checkpoint")
    return as_text(latest_flows(spark, f"{folder}/flows"), "ip_lo", "ip_hi")


@query("stream_graph_upsert", f"WITH {EDGES_CTE} SELECT * FROM edges")
def stream_graph_upsert(spark, sf_dir):
    folder = shared_folder(spark, "stream-graph")
    upsert_graph(packets_of(_arriving(spark, sf_dir, folder)), f"{folder}/edges", f"{folder}/checkpoint")
    return as_text(latest_graph(spark, f"{folder}/edges"), "src", "dst")


def _edges_after(i: int) -> str:
    until = f"(SELECT * FROM events WHERE event_id < (SELECT (max(event_id) + 1) / 4 * {i + 1} FROM events))"
    return f"SELECT {i} AS batch, * FROM (WITH " + EDGES_CTE.replace("FROM events", f"FROM {until}") + " SELECT * FROM edges)"


@query("edge_table_versions", " UNION ALL ".join(_edges_after(i) for i in range(4)))
def edge_table_versions(spark, sf_dir):
    """The edge table after each micro-batch, with compaction after every second delta of a bucket and the last batch repeated."""
    folder = shared_folder(spark, "edge-table")
    landed_events(spark, sf_dir, f"{folder}/landed", folders=True)
    events = with_instants(spark.read.parquet(f"{folder}/landed"))
    table = EdgeTable(spark, f"{folder}/edges", buckets=16, compact_after=2)
    # Kept on the executors' disks: the join's null checks would otherwise be pushed below the packets and
    # compute the endpoints many times per row, in every batch again.
    parts = [packets_of(events.filter(F.col("part") == i)).persist(StorageLevel.DISK_ONLY) for i in range(4)]
    for number in (0, 1, 2, 3, 3):
        arrived = functools.reduce(lambda a, b: a.unionByName(b), parts[: number + 1])
        touched = with_normalised_key(parts[number]).select(*FLOW_KEY).distinct()
        table.upsert(flow_edges(flow_stats(arrived).join(touched, FLOW_KEY, "left_semi")), number)
    for part in parts:
        part.unpersist()
    views = [table.view(i).select(F.lit(i).alias("batch"), "*") for i in range(4)]
    return as_text(functools.reduce(lambda a, b: a.unionByName(b), views), "src", "dst")


@query("stream_new_flows", f"WITH {FLOWS_CTE} SELECT {FLOW_TEXT} FROM flows")
def stream_new_flows(spark, sf_dir):
    folder = shared_folder(spark, "stream-new")
    drain(new_flows(packets_of(_arriving(spark, sf_dir, folder))), f"{folder}/new", f"{folder}/checkpoint")
    return as_text(spark.read.parquet(f"{folder}/new").select(*FLOW_KEY), "ip_lo", "ip_hi")


@query("stream_drain", "SELECT event_id, user_id, event_type, value, props, epoch_us(ts) AS ts_us FROM events")
def stream_drain(spark, sf_dir):
    folder = shared_folder(spark, "stream-drain")
    drain(_arriving(spark, sf_dir, folder), f"{folder}/drained", f"{folder}/checkpoint")
    drained = spark.read.parquet(f"{folder}/drained")
    return drained.select("event_id", "user_id", "event_type", "value", "props", F.unix_micros("ts").alias("ts_us"))


@query("stream_dns_retransmit", REGISTRY["dns_retransmit"][1])
def stream_dns_retransmit(spark, sf_dir):
    folder = shared_folder(spark, "stream-dns")
    stream = queries_of(_arriving(spark, sf_dir, folder))
    write_flagged_queries(stream, f"{folder}/flagged", f"{folder}/state", f"{folder}/checkpoint")
    flagged = spark.read.parquet(f"{folder}/flagged")
    return flagged.select("packet_no", "qry_name", "dns_retransmit", "dns_retransmit_request_in")


@query("stream_dns_slots", REGISTRY["dns_retransmit"][1])
def stream_dns_slots(spark, sf_dir):
    """The same flags from keyed state that expires with the watermark."""
    folder = shared_folder(spark, "stream-dns")
    write_repeated_queries(queries_of(_arriving(spark, sf_dir, folder)), f"{folder}/flagged", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/flagged").select("packet_no", "qry_name", "dns_retransmit", "dns_retransmit_request_in")


@query("session_windows", "SELECT * EXCLUDE (session_no) FROM (" + REGISTRY["flow_sessions_300s"][1] + ")")
def session_windows(spark, sf_dir):
    return as_text(session_updates(synth_packets(spark, sf_dir)), "ip_lo", "ip_hi")


@query(
    "session_timeouts",
    "WITH " + REGISTRY["flow_sessions_300s"][1].removeprefix("WITH ").replace("SELECT " + FLOW_TEXT, ", whole AS (SELECT " + FLOW_COLUMNS, 1)
    + f"""),
    ahead AS (SELECT *, lead(first_seen_us) OVER (PARTITION BY {FLOW_COLUMNS} ORDER BY first_seen_us) AS next_us,
      (SELECT max(ts_us) // 1000 - 600000 FROM packets) AS watermark_ms FROM whole)
    SELECT {FLOW_TEXT}, first_seen_us, last_seen_us, packets, bytes FROM ahead
    WHERE (last_seen_us + 999) // 1000 + 600000 <= watermark_ms OR (next_us // 300000000 + 1) * 300000 <= watermark_ms""",
)
def session_timeouts(spark, sf_dir):
    """Sessions that the idle timeout closes in a stream with late packets; those still open at its end are not written."""
    folder = shared_folder(spark, "stream-timeouts")
    landed_events(spark, sf_dir, f"{folder}/landed", late="400 DAYS")
    schema = spark.read.parquet(f"{folder}/landed").schema
    arriving = with_instants(message_stream(spark, f"{folder}/landed", schema, files=1))
    write_idle_sessions(packets_of(arriving), f"{folder}/sessions", f"{folder}/checkpoint")
    return as_text(spark.read.schema(SESSIONS).parquet(f"{folder}/sessions"), "ip_lo", "ip_hi")


@query(
    "pcap_scan",
    f"""WITH {FRAMES_CTE} SELECT ts_us // 1000000 AS timestamp_s, ts_us % 1000000 AS timestamp_us,
      upper(hex(encode(props))) AS props, row_number() OVER (ORDER BY packet_no) - 1 AS frame_no FROM frames""",
)
def pcap_scan(spark, sf_dir):
    from packetlake.operators.ordered import numbered

    folder = shared_folder(spark, "captures")
    plain = synth_frames(spark, sf_dir, variants=False)
    write_captures(plain, folder)
    frames = read_frames(spark, folder, split_bytes=64 * 1024)
    # Frames are numbered behind the decoder. A join of the two would be broadcast: Spark takes frames to be about
    # as large as the ranges they are read from.
    decoded = decode_packets(frames).select("packet_no", "ts", F.hex("payload").alias("props"))
    # A segment is a MiB of a file, so no task sorts a whole file.
    order = numbered(decoded, [], ["packet_no"], F.shiftright("packet_no", 20), "frame_no")
    return order.select(
        "frame_no", seconds_part(F.col("ts")).alias("timestamp_s"), micros_part(F.col("ts")).alias("timestamp_us"), "props"
    )


@query(
    "pcap_one_file",
    f"""WITH {FRAMES_CTE} SELECT ts_us // 1000000 AS timestamp_s, ts_us % 1000000 AS timestamp_us,
      upper(hex(encode(props))) AS props, row_number() OVER (ORDER BY packet_no) - 1 AS frame_no FROM frames""",
)
def pcap_one_file(spark, sf_dir):
    """One large file whose payloads are capture records themselves, read in ranges that are composed."""
    from packetlake.operators.ordered import numbered

    folder = shared_folder(spark, "captures")
    props = F.encode("props", "UTF-8")
    size = F.reverse(F.unhex(F.lpad(F.hex(F.length(props).cast("long")), 8, "0")))
    record = F.concat(F.lit(bytes(8)), size, size, props)
    write_captures(synth_frames(spark, sf_dir, F.concat(record, record, record), variants=False), folder, one_file=True)
    frames = read_frames(spark, folder, split_bytes=256 * 1024)
    # Numbered behind the decoder and not joined, as in pcap_scan.
    decoded = decode_packets(frames).select("packet_no", "ts", F.expr("hex(substring(payload, 17, (length(payload) - 48) div 3))").alias("props"))
    order = numbered(decoded, [], ["packet_no"], F.shiftright("packet_no", 20), "frame_no")
    return order.select(
        "frame_no", seconds_part(F.col("ts")).alias("timestamp_s"), micros_part(F.col("ts")).alias("timestamp_us"), "props"
    )


@query(
    "pcap_damage",
    f"WITH {FRAMES_CTE} SELECT ts_us // 1000000 AS timestamp_s, ts_us % 1000000 AS timestamp_us FROM frames",
)
def pcap_damage(spark, sf_dir):
    """Captures that each miss their last bytes: the whole records, and the listed damage, are all there was."""
    folder = shared_folder(spark, "captures")
    write_captures(synth_frames(spark, sf_dir, variants=False), folder, cut=5)
    whole = read_frames(spark, folder, split_bytes=64 * 1024, damage="stop").select("ts")
    found = whole.unionByName(capture_damage(spark, folder).select("ts"))
    return found.select(seconds_part(F.col("ts")).alias("timestamp_s"), micros_part(F.col("ts")).alias("timestamp_us"))


@query(
    "topology_scan",
    "SELECT DISTINCT s_name AS name, n_name AS roles FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 10 <> 0",
)
def topology_scan(spark, sf_dir):
    folder = shared_folder(spark, "topology")
    documents = synth_devices(spark, sf_dir).select(F.array(F.struct("name", "roles", "ip_addresses")).alias("devices"))
    documents.write.json(folder)
    devices = read_topology(spark, folder, multi_line=False)
    return device_nodes(devices).withColumn("roles", F.array_join("roles", ","))


@query(
    "packet_table_files",
    f"WITH {FRAMES_CTE} SELECT proto_hierarchy, count(*) AS packets, CAST(sum(header_len) AS BIGINT) AS header_bytes FROM named GROUP BY 1",
)
def packet_table_files(spark, sf_dir):
    folder = shared_folder(spark, "packets")
    write_packet_table(decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL"), folder, by_day=True)
    stored = read_packet_table(spark, folder).select([f.name for f in PACKET_TABLE.fields])
    return stored.groupBy("proto_hierarchy").agg(F.count(F.lit(1)).alias("packets"), F.sum("header_len").alias("header_bytes"))


@query(
    "csv_files",
    f"""WITH {FRAMES_CTE} SELECT CASE kind WHEN 'tcp' THEN src_port ELSE 0 END AS srcport, count(*) AS rows FROM named GROUP BY 1""",
)
def csv_files(spark, sf_dir):
    folder = shared_folder(spark, "features")
    write_feature_csv(decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL"), folder)
    stored = spark.read.csv(folder, header=True)
    return stored.groupBy(F.col("`tcp.srcport`").cast("int").alias("srcport")).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "payload_files",
    f"WITH {PACKETS_CTE} SELECT {KEY_SQL} AS flow_key, count(*) AS payloads FROM packets GROUP BY 1",
)
def payload_files(spark, sf_dir):
    folder = shared_folder(spark, "queues")
    direct = [F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]
    rows = synth_packets(spark, sf_dir).select(flow_key_text(*direct).alias("flow_key"), "packet_no", F.encode("props", "UTF-8").alias("payload"))
    append_payloads(rows, folder, buckets=8)
    return spark.read.parquet(folder).groupBy("flow_key").agg(F.count(F.lit(1)).alias("payloads"))


@query(
    "capture_job",
    f"""WITH {FRAMES_CTE} SELECT count(*) AS frames, count(*) FILTER (WHERE kind = 'bad') AS issues,
      (SELECT count(*) FROM named) AS packets, (SELECT count(*) FROM
        (SELECT DISTINCT least(s, d), greatest(s, d), proto_hierarchy FROM (
          SELECT src_hex || '/' || lpad(CASE WHEN kind IN ('tcp', 'udp') THEN src_port ELSE 0 END::VARCHAR, 5, '0') AS s,
                 dst_hex || '/' || lpad(CASE WHEN kind IN ('tcp', 'udp') THEN dst_port ELSE 0 END::VARCHAR, 5, '0') AS d, proto_hierarchy FROM named))) AS edges
    FROM kinds""",
)
def capture_job(spark, sf_dir):
    folder = shared_folder(spark, "capture-job")
    totals = run_capture_job(synth_frames(spark, sf_dir), folder, devices=synth_devices(spark, sf_dir))
    packets = spark.read.parquet(f"{folder}/packets").agg(F.count(F.lit(1)).alias("packets"))
    edges = spark.read.parquet(f"{folder}/flow_edges").agg(F.count(F.lit(1))).scalar()
    return packets.select(
        F.lit(totals["frames"]).alias("frames"), F.lit(totals["issues"]).alias("issues"), "packets", edges.alias("edges")
    )


@query(
    "pretraining_batches",
    f"""WITH {SEGMENTS_CTE}, o AS (SELECT *, row_number() OVER (ORDER BY {sql_hash(5, 'packet_no')}, packet_no) - 1 AS i,
      dense_rank() OVER (ORDER BY source) - 1 AS class_index FROM ints)
    SELECT packet_no, i // 128 AS batch_id, i % 128 AS pos, class_index, source AS proto_hierarchy, md5(CAST({EOS_SQL} AS VARCHAR)) AS tokens,
      least((len(b) - (len(b) + 6) // 7 + 9) // 10, 380) >= 0 AS has_labels FROM o""",
)
def pretraining_batches_query(spark, sf_dir):
    batches = pretraining_batches(document_segments(spark, sf_dir), 128, 5)
    digest = F.md5(F.col("tokens").cast("string"))
    return batches.select(
        "packet_no", "batch_id", "pos", "class_index", "proto_hierarchy", digest.alias("tokens"), (F.size("masked_labels") >= 0).alias("has_labels")
    )


