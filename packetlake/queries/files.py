"""Tables that are written and read back, all columns compared; and filters, previews and ports."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.fixtures import SERVERS, application_frames, events, labelled_packets, synth_frames
from packetlake.functions.tokens import encode_tokens
from packetlake.operators import permutation, sampling, sequences
from packetlake.operators.decode import decode_packets
from packetlake.operators.dns import with_retransmissions
from packetlake.operators.features import csv_projection, flatten_features
from packetlake.plans.capture import run_capture_job
from packetlake.plans.sequences import with_flow_id
from packetlake.queries.base import PACKETS_CTE, REGISTRY, query, sql_hash
from packetlake.queries.decoding import APPS_CTE, FRAMES_CTE, FLAT_ALL_SQL, FLAT_COLUMNS, _plain_name, _plain_names
from packetlake.queries.labelled import BATCH, ROWS_CTE, SEED, SHUFFLED
from packetlake.queries.tokens import EOS_SQL, SEGMENTS_CTE, SOS_SQL
from packetlake.fixtures import document_segments
from packetlake.schemas import ENDPOINT
from packetlake.session import shared_folder
from packetlake.sources.clustered import endpoint_packets, read_clustered, write_clustered
from packetlake.sources.indexed import gather_rows, read_slice, write_indexed
from packetlake.sources.sinks import write_batches, write_by_label, write_feature_csv, write_flat_csv
from packetlake.sources.tables import preview, read_labelled_packets

LABELLED_SQL = """event_id AS packet_no, upper(hex(encode(props))) AS data, '01' || repeat('00', CAST(length(props) - 1 AS INTEGER)) AS mask,
  'Ethernet->' || upper(event_type) AS proto_hierarchy, event_type AS "AttackLabel", user_id AS "FlowID" """


def _shown(rows):
    """Binary columns as hexadecimal text."""
    return rows.withColumns({"data": F.hex("data"), "mask": F.hex("mask")})


@query("labelled_files", f"SELECT {LABELLED_SQL} FROM events")
def labelled_files(spark, sf_dir):
    folder = shared_folder(spark, "labelled")
    labelled_packets(spark, sf_dir).write.parquet(folder)
    return _shown(read_labelled_packets(spark, folder))


def _stored_frames(spark, sf_dir):
    folder = shared_folder(spark, "clustered")
    write_clustered(decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL"), folder, files=8)
    return read_clustered(spark, folder)


# A frame begins with both addresses as hardware addresses, and is marked from its first address on.
CLUSTERED_SQL = """packet_no, src_hex AS src_ip, dst_hex AS dst_ip, proto_hierarchy, ts_us // 1000000 AS timestamp_s,
      ts_us % 1000000 AS timestamp_us, header_len, '0200' || dst4 || '0200' || src4 AS hardware"""


def _clustered(rows):
    return rows.select(
        "packet_no", F.hex("src_ip").alias("src_ip"), F.hex("dst_ip").alias("dst_ip"), "proto_hierarchy", "timestamp_s", "timestamp_us",
        "header_len", F.hex(F.substring("data", 1, 12)).alias("hardware"),
    )


@query("clustered_files", f"WITH {FRAMES_CTE} SELECT {CLUSTERED_SQL} FROM named")
def clustered_files(spark, sf_dir):
    return _clustered(_stored_frames(spark, sf_dir).filter("length(mask) = length(data)"))


BUSY = SERVERS["view"][0]


@query(
    "endpoint_day",
    f"""WITH {FRAMES_CTE} SELECT {CLUSTERED_SQL} FROM named
    WHERE '{BUSY:08X}' IN (src_hex, dst_hex) AND ts_us // 86400000000 = (SELECT min(ts_us) // 86400000000 + 7 FROM named)""",
)
def endpoint_day(spark, sf_dir):
    rows = _stored_frames(spark, sf_dir)
    start = (rows.agg(F.min("timestamp_s")).first()[0] // 86400 + 7) * 86400
    return _clustered(endpoint_packets(rows, BUSY.to_bytes(4, "big"), start, start + 86400))


@query("label_folders", f"SELECT {LABELLED_SQL}, event_type AS folder FROM events")
def label_folders(spark, sf_dir):
    folder = shared_folder(spark, "labels")
    write_by_label(labelled_packets(spark, sf_dir), folder)
    rows = spark.read.parquet(folder).withColumn("folder", F.regexp_extract(F.input_file_name(), "AttackLabel=([^/]+)/", 1))
    return _shown(rows)


@query(
    "batch_files",
    f"""SELECT {LABELLED_SQL}, i // {BATCH} AS batch_id, i % {BATCH} AS pos, i // {BATCH} // 8 AS batch_folder
    FROM (SELECT e.*, i FROM events e JOIN {SHUFFLED} s USING (event_id))""",
)
def batch_files(spark, sf_dir):
    folder = shared_folder(spark, "batches")
    packets = labelled_packets(spark, sf_dir)
    rows = sampling.gather(sampling.epoch_batches(packets, "packet_no", BATCH, SEED), packets, "packet_no")
    write_batches(rows, folder, per_folder=8)
    return _shown(spark.read.parquet(folder))


# A CSV file does not tell an empty text from none.
FLAT_CSV_SQL = (
    "SELECT " + ", ".join(f"nullif({_plain_name(n)}, '') AS {_plain_name(n)}" if kind == "VARCHAR" else _plain_name(n) for n, (kind, _) in FLAT_COLUMNS.items()) + f" FROM ({FLAT_ALL_SQL})"
)


@query("flat_csv_files", FLAT_CSV_SQL)
def flat_csv_files(spark, sf_dir):
    folder = shared_folder(spark, "flat-csv")
    packets = with_retransmissions(decode_packets(application_frames(spark, sf_dir)).filter("decode_error IS NULL"))
    write_flat_csv(packets, folder)
    return _plain_names(spark.read.schema(flatten_features(packets).schema).csv(folder, header=True))


@query("feature_csv_files", REGISTRY["csv_features_all"][1])
def feature_csv_files(spark, sf_dir):
    folder = shared_folder(spark, "feature-csv")
    packets = with_retransmissions(decode_packets(application_frames(spark, sf_dir)).filter("decode_error IS NULL"))
    write_feature_csv(packets, folder)
    rows = _plain_names(spark.read.schema(csv_projection(packets).schema).csv(folder, header=True))
    return rows.fillna("")


@query("capture_features", FLAT_ALL_SQL)
def capture_features(spark, sf_dir):
    """The feature table of the capture job, retransmissions among its columns."""
    folder = shared_folder(spark, "capture-features")
    run_capture_job(application_frames(spark, sf_dir), folder, features=True)
    return _plain_names(spark.read.parquet(f"{folder}/features"))


# Ports of each kind of server, by packet number (fixed values of the fixture).
OTHER_PORTS = {"click": [80, 8080, 8888, 3000, 8000, 8008], "purchase": [443], "view": [1883, 8883], "signup": [53, 5353], "error": [502, 22]}
PORT_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {p}[packet_no % {len(p)} + 1]" for k, p in OTHER_PORTS.items()) + " END"


@query(
    "ports_and_tags",
    f"""WITH {APPS_CTE}, ported AS (SELECT *, {PORT_SQL} AS port,
      CASE WHEN packet_no % 7 = 0 THEN 'none' WHEN packet_no % 13 = 0 THEN 'cut' WHEN packet_no % 11 = 0 THEN 'unicast' ELSE 'ok' END AS state FROM apps)
    SELECT packet_no, port, 'Ethernet->IPv4->' || protocol || CASE event_type WHEN 'click' THEN '->HTTP' WHEN 'purchase' THEN '->HTTPS'
        WHEN 'view' THEN CASE WHEN packet_no % 9 <> 0 AND turn = 4 THEN '' ELSE '->MQTT' END
        WHEN 'signup' THEN CASE WHEN state NOT IN ('ok', 'cut') THEN '' WHEN port = 53 THEN '->DNS' ELSE '->MDNS' END
        ELSE CASE port WHEN 22 THEN '->SSH' ELSE '->ModbusTCP' END END AS proto_hierarchy,
      CASE WHEN event_type = 'signup' AND state IN ('ok', 'cut') THEN port = 5353 END AS mdns,
      CASE WHEN event_type = 'signup' AND state = 'ok' THEN 'user' || user_id || '.example' WHEN event_type = 'signup' AND state = 'cut' THEN '' END AS qry_name,
      CASE WHEN event_type = 'error' AND port = 502 THEN user_id % 256 END AS unit_id
    FROM ported""",
)
def ports_and_tags(spark, sf_dir):
    """Every port of the application table, multicast DNS and SSH among them."""
    decoded = decode_packets(application_frames(spark, sf_dir, ports=OTHER_PORTS))
    server = F.when(F.col("packet_no") % 2 == 0, F.col("dst_port")).otherwise(F.col("src_port"))
    return decoded.select("packet_no", server.alias("port"), "proto_hierarchy", "dns.mdns", "dns.qry_name", "modbus.unit_id")


@query("first_packets", f"SELECT {LABELLED_SQL} FROM events ORDER BY event_id LIMIT 5")
def first_packets(spark, sf_dir):
    return _shown(preview(labelled_packets(spark, sf_dir).orderBy("packet_no")))


@query(
    "flow_id_groups",
    f"""WITH {PACKETS_CTE} SELECT packet_no, min(packet_no) OVER pair AS first_of_id, count(*) OVER pair AS packets FROM packets
    WINDOW pair AS (PARTITION BY least(src_ip, dst_ip), greatest(src_ip, dst_ip))""",
)
def flow_id_groups(spark, sf_dir):
    """Packets that share a FlowID, as added by the sequence job: those between the same two hosts."""
    folder = shared_folder(spark, "decoded")
    decode_packets(synth_frames(spark, sf_dir, variants=False)).select("packet_no", "data", "mask").write.parquet(folder)
    rows = with_flow_id(spark.read.parquet(folder)).select("packet_no", "FlowID")
    groups = rows.groupBy("FlowID").agg(F.min("packet_no").alias("first_of_id"), F.count(F.lit(1)).alias("packets"))
    return rows.join(groups, "FlowID").drop("FlowID")


@query(
    "token_placement",
    f"""WITH {SEGMENTS_CTE} SELECT packet_no, 'SOS' AS placement, md5(CAST({SOS_SQL} AS VARCHAR)) AS tokens FROM ints
    UNION ALL SELECT packet_no, 'EOS', md5(CAST({EOS_SQL} AS VARCHAR)) FROM ints""",
)
def token_placement(spark, sf_dir):
    rows = document_segments(spark, sf_dir)
    both = [
        rows.select("packet_no", F.lit(p).alias("placement"), F.md5(encode_tokens(F.col("data"), F.col("mask"), ENDPOINT, p).cast("string")).alias("tokens"))
        for p in ("SOS", "EOS")
    ]
    return both[0].unionByName(both[1])


@query(
    "label_flow_rows",
    f"""WITH {ROWS_CTE} SELECT 'label' AS kept_by, packet_no FROM rows WHERE label = 'view'
    UNION ALL SELECT 'flow', packet_no FROM rows WHERE flow = 7 UNION ALL SELECT 'both', packet_no FROM rows WHERE label = 'view' AND flow = 7""",
)
def label_flow_rows(spark, sf_dir):
    packets = labelled_packets(spark, sf_dir)
    chosen = {"label": {"label": "view"}, "flow": {"flow": 7}, "both": {"label": "view", "flow": 7}}
    parts = [sequences.rows_of(packets, **how).select(F.lit(name).alias("kept_by"), "packet_no") for name, how in chosen.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SLICES = [(0, 10), (250, 13), (255, 600), (9_900, 1_000)]
INDEXED_SQL = f"(SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events)"


@query("row_slices", " UNION ALL ".join(f"SELECT {a} AS start, row_idx, {LABELLED_SQL} FROM {INDEXED_SQL} WHERE row_idx BETWEEN {a} AND {a + n - 1}" for a, n in SLICES))
def row_slices(spark, sf_dir):
    """Runs of rows by position, from a table stored by position."""
    folder = shared_folder(spark, "indexed")
    write_indexed(labelled_packets(spark, sf_dir), "packet_no", folder, per_segment=256)
    parts = [_shown(read_slice(spark, folder, a, n, 256)).withColumn("start", F.lit(a)) for a, n in SLICES]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query("row_gather", f"SELECT i // {BATCH} AS batch_id, i % {BATCH} AS pos, row_idx, {LABELLED_SQL} FROM (SELECT x.*, i FROM {INDEXED_SQL} x JOIN {SHUFFLED} s USING (event_id))")
def row_gather(spark, sf_dir):
    """The rows of shuffled batches by their positions, from a table stored by position."""
    folder = shared_folder(spark, "indexed")
    packets = labelled_packets(spark, sf_dir)
    write_indexed(packets, "packet_no", folder, per_segment=256)
    places = spark.read.parquet(folder).select("packet_no", "row_idx")
    batches = sampling.epoch_batches(packets, "packet_no", BATCH, SEED).join(places, "packet_no").drop("packet_no")
    return _shown(gather_rows(batches, folder, 256))


def _round_sql(number: int) -> str:
    moving, fixed, side = ("y", "x", "b") if number % 2 else ("x", "y", "a")
    moved = f"({moving} + {sql_hash(SEED, str(number), fixed)} % {side}) % {side} AS {moving}"
    return f"SELECT i, n, a, b, {fixed}, {moved} FROM "


def _scrambled_sql(source: str) -> str:
    nested = f"(SELECT i, n, a, b, z % a AS x, z // a AS y FROM {source})"
    for number in range(permutation.ROUNDS):
        nested = f"({_round_sql(number)} {nested})"
    return f"SELECT i, n, a, b, x + y * a AS z FROM {nested}"


PERMUTED_SQL = f"""WITH RECURSIVE size AS (SELECT n, a, (n + a - 1) // a AS b FROM (
    SELECT count(*) AS n, CAST(ceil(sqrt(count(*))) AS BIGINT) AS a FROM events)),
  walk AS (SELECT i, n, a, b, i AS z, 0 AS step FROM range((SELECT n FROM size)) t(i), size
    UNION ALL SELECT *, 1 FROM ({_scrambled_sql("(SELECT * FROM walk WHERE step = 0 OR z >= n)")}) q),
  placed AS (SELECT i, z FROM walk WHERE step = 1 AND z < n)"""


@query("epoch_permuted", f"{PERMUTED_SQL} SELECT event_id, z // {BATCH} AS batch_id, z % {BATCH} AS pos FROM placed JOIN {INDEXED_SQL} ON i = row_idx")
def epoch_permuted(spark, sf_dir):
    """An epoch in the order of a keyed permutation of row numbers."""
    return permutation.permuted_batches(events(spark, sf_dir), "event_id", BATCH, SEED)


@query(
    "epoch_drawn_batches",
    f"{PERMUTED_SQL} SELECT z // {BATCH} AS batch_id, z % {BATCH} AS pos, row_idx, {LABELLED_SQL} FROM placed JOIN {INDEXED_SQL} ON i = row_idx WHERE z // {BATCH} BETWEEN 2 AND 5",
)
def epoch_drawn_batches(spark, sf_dir):
    """Four batches of that epoch, found by the inverse permutation in a table stored by position."""
    folder = shared_folder(spark, "indexed")
    packets = labelled_packets(spark, sf_dir)
    write_indexed(packets, "packet_no", folder, per_segment=256)
    return _shown(permutation.drawn_batches(spark, folder, packets.count(), BATCH, SEED, 2, 4, per_segment=256))
