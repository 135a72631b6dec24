"""Sequence, batch and sample queries over labelled packets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from packetlake.fixtures import document_segments, events, labelled_packets, synth_packets
from packetlake.functions.flowkey import flow_key_text
from packetlake.functions.tokens import apply_mask
from packetlake.operators import metrics, sampling, sequences
from packetlake.operators.ordered import row_index
from packetlake.queries.base import PACKETS_CTE, query, sql_hash, sql_ip
from packetlake.queries.tokens import _masked_sql, SEGMENTS_CTE
from packetlake.schemas import ENDPOINT

K, BATCH, SEED, DRAWS = 4, 128, 11, 512

ROWS_CTE = """rows AS (SELECT event_id AS packet_no, event_type AS label, user_id AS flow, props FROM events)"""


@query("label_histogram", "SELECT event_type AS \"AttackLabel\", count(*) AS count FROM events GROUP BY 1")
def label_histogram(spark, sf_dir):
    return metrics.label_histogram(labelled_packets(spark, sf_dir))


@query("distinct_labels", "SELECT DISTINCT event_type AS \"AttackLabel\" FROM events")
def distinct_labels(spark, sf_dir):
    return metrics.distinct_values(labelled_packets(spark, sf_dir), "AttackLabel")


@query("distinct_flows", "SELECT DISTINCT event_type AS \"AttackLabel\", user_id AS \"FlowID\" FROM events")
def distinct_flows(spark, sf_dir):
    return metrics.distinct_values(labelled_packets(spark, sf_dir), "AttackLabel", "FlowID")


@query(
    "class_index",
    """WITH c AS (SELECT DISTINCT 'Ethernet->' || upper(event_type) AS p FROM events),
    i AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS class_index, count(*) OVER () AS n FROM c)
    SELECT event_id AS packet_no, p AS proto_hierarchy, class_index,
      array_to_string(list_transform(range(0, n), lambda x: CASE WHEN x = class_index THEN 1 ELSE 0 END), '') AS one_hot
    FROM events JOIN i ON p = 'Ethernet->' || upper(event_type)""",
)
def class_index(spark, sf_dir):
    packets = labelled_packets(spark, sf_dir)
    classes = metrics.class_dictionary(packets)
    flat = classes.withColumn("class_bits", F.array_join(F.col("one_hot").cast("array<int>").cast("array<string>"), ""))
    named = metrics.with_class_index(packets, classes).join(flat.select("proto_hierarchy", "class_bits"), "proto_hierarchy")
    return named.select("packet_no", "proto_hierarchy", "class_index", F.col("class_bits").alias("one_hot"))


@query("row_index", "SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS row_idx FROM events")
def row_index_query(spark, sf_dir):
    return row_index(events(spark, sf_dir).select("event_id"), "event_id")


SHUFFLED = f"(SELECT event_id, row_number() OVER (ORDER BY {sql_hash(SEED, 'event_id')}, event_id) - 1 AS i FROM events)"


@query("epoch_batches", f"SELECT event_id, i // {BATCH} AS batch_id, i % {BATCH} AS pos FROM {SHUFFLED}")
def epoch_batches(spark, sf_dir):
    return sampling.epoch_batches(events(spark, sf_dir), "event_id", BATCH, SEED)


@query(
    "gather_batch",
    f"""SELECT s.event_id AS packet_no, i // {BATCH} AS batch_id, i % {BATCH} AS pos,
      list_transform(range(0, length(props)), lambda x: CASE WHEN x = 0 THEN {ENDPOINT} ELSE ascii(substr(props, x + 1, 1)) END)::VARCHAR AS tokens,
      'Ethernet->' || upper(event_type) AS proto_hierarchy
    FROM {SHUFFLED} s JOIN events e ON s.event_id = e.event_id""",
)
def gather_batch(spark, sf_dir):
    packets = labelled_packets(spark, sf_dir)
    batches = sampling.epoch_batches(packets, "packet_no", BATCH, SEED)
    rows = sampling.gather(batches, packets, "packet_no")
    tokens = apply_mask(F.col("data"), F.col("mask"), ENDPOINT).cast("array<string>")
    shown = F.concat(F.lit("["), F.array_join(tokens, ", "), F.lit("]"))
    return rows.select("packet_no", "batch_id", "pos", shown.alias("tokens"), "proto_hierarchy")


SEQUENCES_CTE = f"""{ROWS_CTE},
placed AS (SELECT *, row_number() OVER (PARTITION BY label, flow ORDER BY packet_no) - 1 AS rn, count(*) OVER (PARTITION BY label, flow) AS n FROM rows),
runs AS (SELECT *, rn // {K} AS seq_no, rn % {K} AS pos FROM placed WHERE n < {K} OR rn < n // {K} * {K})"""


@query("flow_sequences", f"""WITH {SEQUENCES_CTE} SELECT packet_no, label AS "AttackLabel", flow AS "FlowID", seq_no, pos FROM runs""")
def flow_sequences(spark, sf_dir):
    placed = sequences.flow_sequences(labelled_packets(spark, sf_dir), K)
    return placed.select("packet_no", "AttackLabel", "FlowID", "seq_no", "pos")


def joined_md5(tokens: str) -> Column:
    """md5 of all numbers of the token rows (0 to 999), joined by commas.

    A text per number in the JVM costs far more than the digest itself.
    """

    def digest(rows: pa.Array) -> pa.Array:
        # Four bytes per number, padded with zero bytes.
        words = np.array([b"%d," % t for t in range(1000)], "S4")
        texts = (words[row.values.flatten().to_numpy()].tobytes().replace(b"\0", b"")[:-1] for row in rows)
        return pa.array([hashlib.md5(text).hexdigest() for text in texts], pa.string())

    return F.arrow_udf(digest, "string")(tokens)


@query(
    "sequence_pad",
    f"""WITH {SEQUENCES_CTE}, bytes AS (
      SELECT *, array_to_string(list_concat(list_transform(range(0, length(props)), lambda x: CASE WHEN x = 0 THEN 0 ELSE ascii(substr(props, x + 1, 1)) END),
        [258], list_transform(range(0, 1519 - length(props)), lambda x: 256)), ',') AS t FROM runs),
    seqs AS (SELECT label, flow, seq_no, count(*) AS length, min(packet_no) AS first_packet_no, string_agg(t, ',' ORDER BY pos) AS body FROM bytes GROUP BY 1, 2, 3)
    SELECT label AS "AttackLabel", flow AS "FlowID", seq_no, label, length, first_packet_no,
      md5(body || repeat(',256', CAST(1520 * ({K} + 1 - length) AS INTEGER))) AS tokens, {K} + 1 AS rows FROM seqs""",
)
def sequence_pad(spark, sf_dir):
    placed = sequences.flow_sequences(labelled_packets(spark, sf_dir), K)
    whole = sequences.assemble_sequences(placed, K)
    return whole.select(
        *sequences.SEQUENCE, "label", "length", "first_packet_no", joined_md5("tokens").alias("tokens"), F.size("tokens").alias("rows")
    )


@query(
    "sequence_batches",
    f"""WITH {SEQUENCES_CTE}, seqs AS (SELECT min(packet_no) AS first_packet_no, count(*) AS length FROM runs GROUP BY label, flow, seq_no),
    i AS (SELECT *, row_number() OVER (ORDER BY first_packet_no) - 1 AS i FROM seqs)
    SELECT first_packet_no, length, i // 32 AS batch_id, i % 32 AS batch_pos, (SELECT (count(*) + 31) // 32 FROM seqs) AS batches FROM i""",
)
def sequence_batches(spark, sf_dir):
    placed = sequences.flow_sequences(labelled_packets(spark, sf_dir), K)
    heads = placed.groupBy(*sequences.SEQUENCE).agg(F.min("packet_no").alias("first_packet_no"), F.count(F.lit(1)).alias("length"))
    batched = sequences.batches_of(heads, "first_packet_no", 32)
    total = sequences.batch_count(heads, 32).scalar()
    return batched.select("first_packet_no", "length", "batch_id", "batch_pos", total.alias("batches"))


@query(
    "validation_batch",
    f"""WITH {SEQUENCES_CTE}, seqs AS (SELECT min(packet_no) AS first_packet_no FROM runs GROUP BY label, flow, seq_no),
    i AS (SELECT *, row_number() OVER (ORDER BY first_packet_no) - 1 AS i FROM seqs)
    SELECT first_packet_no, i % 32 AS batch_pos FROM i WHERE i // 32 = 100000 % (SELECT (count(*) + 31) // 32 FROM seqs)""",
)
def validation_batch(spark, sf_dir):
    placed = sequences.flow_sequences(labelled_packets(spark, sf_dir), K)
    heads = placed.groupBy(*sequences.SEQUENCE).agg(F.min("packet_no").alias("first_packet_no"))
    return sequences.validation_batch(sequences.batches_of(heads, "first_packet_no", 32), 100000).select("first_packet_no", "batch_pos")


DRAWS_CTE = f"""{ROWS_CTE},
labels AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS label_no FROM rows GROUP BY label),
draws AS (SELECT range AS draw_id, {sql_hash(SEED, "'label'", "range")} % (SELECT count(*) FROM labels) AS label_no FROM range({DRAWS})),
picked AS (SELECT * FROM draws JOIN labels USING (label_no)),
by_label AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY packet_no) - 1 AS place FROM rows),
by_flow AS (SELECT *, row_number() OVER (PARTITION BY label, flow ORDER BY packet_no) - 1 AS place,
            count(*) OVER (PARTITION BY label, flow) AS flow_rows FROM rows)"""


def _start_sql(rows: str, k: int, key: str = "draw_id") -> str:
    return f"CASE WHEN {rows} < {k} THEN 0 ELSE {sql_hash(SEED, chr(39) + 'start' + chr(39), key)} % greatest({rows} - {k} + 1, 1) END"


@query(
    "sample_even",
    f"""WITH {DRAWS_CTE}, starts AS (SELECT *, {_start_sql('n', K)} AS s FROM picked)
    SELECT draw_id, place - s AS pos, b.label AS "AttackLabel", packet_no FROM starts JOIN by_label b ON b.label = starts.label AND place BETWEEN s AND s + {K} - 1""",
)
def sample_even(spark, sf_dir):
    return sampling.even_sample(labelled_packets(spark, sf_dir), DRAWS, K, SEED)


@query(
    "sample_flow_even",
    f"""WITH {DRAWS_CTE}, chosen AS (
      SELECT draw_id, b.label, b.flow FROM picked JOIN by_label b ON b.label = picked.label AND place = {sql_hash(SEED, "'row'", "draw_id")} % n),
    sized AS (SELECT DISTINCT label, flow, flow_rows FROM by_flow),
    starts AS (SELECT *, {_start_sql('flow_rows', 16)} AS s FROM chosen JOIN sized USING (label, flow))
    SELECT draw_id, place - s AS pos, b.label AS "AttackLabel", b.flow AS "FlowID", packet_no
    FROM starts JOIN by_flow b ON b.label = starts.label AND b.flow = starts.flow AND place BETWEEN s AND s + 15""",
)
def sample_flow_even(spark, sf_dir):
    return sampling.sample_flow_even(labelled_packets(spark, sf_dir), DRAWS, 16, SEED)


@query(
    "random_window",
    f"""WITH {DRAWS_CTE}, flows AS (SELECT DISTINCT label, flow, flow_rows, label || '/' || flow AS draw_id FROM by_flow),
    starts AS (SELECT *, {_start_sql('flow_rows', K)} AS s FROM flows)
    SELECT b.label AS "AttackLabel", b.flow AS "FlowID", place - s AS pos, packet_no
    FROM starts JOIN by_flow b ON b.label = starts.label AND b.flow = starts.flow AND place BETWEEN s AND s + {K} - 1""",
)
def random_window(spark, sf_dir):
    return sampling.random_windows(labelled_packets(spark, sf_dir), K, SEED)


@query(
    "encoded_batch",
    f"""WITH {DRAWS_CTE}, starts AS (SELECT *, {_start_sql('n', K)} AS s FROM picked),
    drawn AS (SELECT draw_id, place - s AS pos, b.label, props FROM starts JOIN by_label b ON b.label = starts.label AND place BETWEEN s AND s + {K} - 1),
    bytes AS (SELECT *, array_to_string(list_concat(list_transform(range(0, length(props)), lambda x: CASE WHEN x = 0 THEN 0 ELSE ascii(substr(props, x + 1, 1)) END),
      [258], list_transform(range(0, 1519 - length(props)), lambda x: 256)), ',') AS t FROM drawn)
    SELECT draw_id, min(label) AS label, count(*) AS length, md5(string_agg(t, ',' ORDER BY pos)) AS tokens FROM bytes GROUP BY draw_id""",
)
def encoded_batch(spark, sf_dir):
    packets = labelled_packets(spark, sf_dir)
    drawn = sampling.even_sample(packets, DRAWS, K, SEED).drop("AttackLabel")
    rows = sampling.gather(drawn, packets, "packet_no", bound=DRAWS * K)
    whole = sequences.assemble_sequences(rows, K, keys=["draw_id"], pad_rows=False)
    digest = F.md5(F.array_join(F.flatten("tokens").cast("array<string>"), ","))
    return whole.select("draw_id", "label", "length", digest.alias("tokens"))


KEY_SQL = f"{sql_ip('src_ip')} || ':' || src_port || ' -> ' || {sql_ip('dst_ip')} || ':' || dst_port || ' (' || protocol || ')'"


def _queued(spark, sf_dir):
    direct = [F.col(c) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]
    return synth_packets(spark, sf_dir).select("packet_no", flow_key_text(*direct).alias("flow_key"), F.col("props").alias("payload"))


@query(
    "payload_lists",
    f"""WITH {PACKETS_CTE}, k AS (SELECT packet_no, {KEY_SQL} AS flow_key, props AS payload FROM packets)
    SELECT *, row_number() OVER (PARTITION BY flow_key ORDER BY packet_no DESC) - 1 AS queue_pos FROM k""",
)
def payload_lists(spark, sf_dir):
    return sequences.payload_queues(_queued(spark, sf_dir))


@query(
    "drain_batches",
    f"""WITH {PACKETS_CTE}, k AS (SELECT packet_no, {KEY_SQL} AS flow_key, props AS payload FROM packets),
    d AS (SELECT *, (row_number() OVER (PARTITION BY flow_key ORDER BY packet_no) - 1) // 5 AS drain_no FROM k)
    SELECT flow_key, drain_no, string_agg(packet_no || '=' || payload, ';' ORDER BY packet_no) AS messages FROM d GROUP BY 1, 2""",
)
def drain_batches(spark, sf_dir):
    drained = sequences.drain_batches(_queued(spark, sf_dir), 5)
    text = F.transform("messages", lambda m: F.concat(m["packet_no"].cast("string"), F.lit("="), m["payload"]))
    return drained.select("flow_key", "drain_no", F.array_join(text, ";").alias("messages"))


@query(
    "document_sequences",
    f"""WITH {SEGMENTS_CTE}, placed AS (
      SELECT packet_no, lang, doc_id, row_number() OVER (PARTITION BY lang, doc_id ORDER BY packet_no) - 1 AS rn,
        count(*) OVER (PARTITION BY lang, doc_id) AS n, list_sum({_masked_sql(0)}) AS total FROM ints)
    SELECT lang AS "AttackLabel", doc_id AS "FlowID", rn // {K} AS seq_no, count(*) AS length, CAST(sum(total) AS BIGINT) AS byte_sum
    FROM placed WHERE n < {K} OR rn < n // {K} * {K} GROUP BY 1, 2, 3""",
)
def document_sequences(spark, sf_dir):
    placed = sequences.flow_sequences(document_segments(spark, sf_dir), K)
    numbers = apply_mask(F.col("data"), F.col("mask"), 0)
    summed = placed.withColumn("s", F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x))
    return summed.groupBy(*sequences.SEQUENCE).agg(F.count(F.lit(1)).alias("length"), F.sum("s").alias("byte_sum"))
