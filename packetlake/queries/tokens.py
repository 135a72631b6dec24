"""Token queries over whole documents sent as packet streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetlake.fixtures import SEGMENT_BYTES, document_segments, synth_frames, synth_packets, synth_predictions, synth_token_predictions, table
from packetlake.functions.ids import host_pair_id, unordered_id
from packetlake.functions.tokens import (
    MIX,
    POSITION_STEP,
    SEED_STEP,
    apply_mask,
    apply_mask_to_numbers,
    bytes_to_ints,
    class_token_position,
    corrupt_tokens,
    encode_tokens,
    masked_bytes,
    masked_labels,
    pooled_vector,
    slot_vector,
)
from packetlake.operators.decode import decode_packets
from packetlake.operators.metrics import accuracy, masked_positions, position_quality, predicted_class, weighted_loss
from packetlake.queries.base import PACKETS_CTE, query
from packetlake.queries.decoding import FRAMES_CTE, V6_SQL

SEED = 7

SEGMENTS_CTE = f"""
docs AS (SELECT doc_id, lang, source, hex(encode(text)) AS h, octet_length(encode(text)) AS n FROM documents),
cuts AS (SELECT *, unnest(range(0, (greatest(n, 1) - 1) // {SEGMENT_BYTES} + 1)) AS segment FROM docs),
segs AS (SELECT doc_id, lang, source, doc_id * 10000 + segment AS packet_no,
         substr(h, CAST(segment * {2 * SEGMENT_BYTES} + 1 AS BIGINT), {2 * SEGMENT_BYTES}) AS h FROM cuts),
ints AS (SELECT *, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS INTEGER)) AS b FROM segs)
"""


def _masked_sql(value: int) -> str:
    return f"list_transform(range(0, len(b)), lambda i: CASE WHEN i % 7 = 0 THEN {value} ELSE b[i + 1] END)"


def _digest(tokens):
    return F.md5(tokens.cast("string"))


def _sql_digest(name: str, expression: str) -> str:
    return f"WITH {SEGMENTS_CTE} SELECT packet_no, len(t) AS n, md5(CAST(t AS VARCHAR)) AS {name} FROM (SELECT packet_no, {expression} AS t FROM ints)"


def _digests(rows, tokens, name):
    computed = rows.select("packet_no", tokens.alias("t"))
    return computed.select("packet_no", F.size("t").cast("long").alias("n"), _digest(F.col("t")).alias(name))


@query("bytes_to_ints", _sql_digest("ints", "b"))
def bytes_to_ints_query(spark, sf_dir):
    return _digests(document_segments(spark, sf_dir), bytes_to_ints(F.col("data")), "ints")


@query("mask_zero", _sql_digest("masked", _masked_sql(0)))
def mask_zero(spark, sf_dir):
    return _digests(document_segments(spark, sf_dir), apply_mask(F.col("data"), F.col("mask"), 0), "masked")


@query("mask_token", _sql_digest("masked", _masked_sql(260)))
def mask_token(spark, sf_dir):
    return _digests(document_segments(spark, sf_dir), apply_mask(F.col("data"), F.col("mask"), 260), "masked")


@query(
    "mask_numbers",
    """SELECT vec_id, array_to_string(list_transform(range(0, len(embedding)), lambda i: CASE WHEN i % 3 = 0 THEN 260 ELSE i END), ',') AS masked
    FROM embeddings""",
)
def mask_numbers(spark, sf_dir):
    places = F.sequence(F.lit(0), F.size("embedding") - 1)
    mask = F.transform(places, lambda i: F.when(i % 3 == 0, 1).otherwise(0))
    masked = apply_mask_to_numbers(places, mask, 260)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(masked.cast("array<string>"), ",").alias("masked"))


PAD_SQL = "list_transform(range(0, {n} - len(b)), lambda i: 256)"
SOS_SQL = f"list_concat([258], {_masked_sql(260)}, [257], {PAD_SQL.format(n=1518)})"
EOS_SQL = f"list_concat({_masked_sql(260)}, [258], {PAD_SQL.format(n=1519)})"


@query("encode_sos", _sql_digest("tokens", SOS_SQL))
def encode_sos(spark, sf_dir):
    return _digests(document_segments(spark, sf_dir), encode_tokens(F.col("data"), F.col("mask"), placement="SOS"), "tokens")


def _encoded(spark, sf_dir):
    return document_segments(spark, sf_dir).withColumn("tokens", encode_tokens(F.col("data"), F.col("mask")))


@query("encode_eos", _sql_digest("tokens", EOS_SQL))
def encode_eos(spark, sf_dir):
    return _digests(_encoded(spark, sf_dir), F.col("tokens"), "tokens")


@query(
    "cls_position",
    f"WITH {SEGMENTS_CTE} SELECT packet_no, len(b) AS cls_position FROM ints",
)
def cls_position(spark, sf_dir):
    return _encoded(spark, sf_dir).select("packet_no", class_token_position(F.col("tokens")).cast("long").alias("cls_position"))


def _mix_sql(value: str) -> str:
    once = f"((xor(({value}) >> 16, ({value})) * {MIX}) & 4294967295)"
    return once


def _hash_columns(salts: int) -> str:
    """Nested selects giving h0, h1, .. of (packet_no, pos); the same mixing as the operator."""
    start = f"(packet_no & 4294967295) * {MIX} + {SEED * SEED_STEP} + pos * {POSITION_STEP}"
    first = ", ".join(f"({start} + {s}) & 4294967295 AS a{s}" for s in range(salts))
    second = ", ".join(f"{_mix_sql(f'a{s}')} AS b{s}" for s in range(salts))
    third = ", ".join(f"{_mix_sql(f'b{s}')} AS c{s}" for s in range(salts))
    last = ", ".join(f"xor(c{s} >> 16, c{s}) AS h{s}" for s in range(salts))
    return f"""hashed AS (SELECT *, {last} FROM (SELECT *, {third} FROM (SELECT *, {second} FROM (SELECT *, {first} FROM places))))"""


CORRUPT_CTE = f"""{SEGMENTS_CTE},
places AS (SELECT packet_no, unnest({EOS_SQL}) AS token, unnest(range(0, 1520)) AS pos FROM ints),
{_hash_columns(3)},
ranked AS (SELECT *, token NOT IN (256, 257, 258, 260) AS ok,
    row_number() OVER (PARTITION BY packet_no ORDER BY token IN (256, 257, 258, 260), h0, pos) AS r,
    count(*) FILTER (WHERE token NOT IN (256, 257, 258, 260)) OVER (PARTITION BY packet_no) AS n FROM hashed),
shown AS (SELECT *, CASE WHEN ok AND r <= least((n * 10 + 99) // 100, 380)
    THEN CASE WHEN h1 % 100 < 90 THEN 259 ELSE h2 % 262 END ELSE token END AS shown FROM ranked)"""


@query(
    "mlm_corrupt",
    f"""WITH {CORRUPT_CTE} SELECT packet_no, md5(CAST(list(shown ORDER BY pos) AS VARCHAR)) AS corrupted,
      count(*) FILTER (WHERE shown = 259) AS masked FROM shown GROUP BY packet_no""",
)
def mlm_corrupt(spark, sf_dir):
    corrupted = _encoded(spark, sf_dir).select("packet_no", corrupt_tokens(F.col("tokens"), F.col("packet_no"), SEED).alias("t"))
    masked = F.size(F.filter("t", lambda x: x == 259)).cast("long")
    return corrupted.select("packet_no", _digest(F.col("t")).alias("corrupted"), masked.alias("masked"))


@query("mlm_labels", f"WITH {CORRUPT_CTE} SELECT packet_no, pos, token FROM shown WHERE shown = 259")
def mlm_labels(spark, sf_dir):
    both = _encoded(spark, sf_dir).select(
        "packet_no", "tokens", corrupt_tokens(F.col("tokens"), F.col("packet_no"), SEED).alias("shown")
    )
    labels = both.select("packet_no", F.explode(masked_labels(F.col("tokens"), F.col("shown"))).alias("l"))
    return labels.select("packet_no", F.col("l.pos").cast("long").alias("pos"), F.col("l.token").alias("token"))


@query("masked_extract", f"WITH {SEGMENTS_CTE} SELECT packet_no, array_to_string(list_transform(range(0, len(b), 7), lambda i: b[i + 1]), ',') AS kept FROM ints")
def masked_extract(spark, sf_dir):
    kept = document_segments(spark, sf_dir).select("packet_no", masked_bytes(F.col("data"), F.col("mask")).alias("k"))
    return kept.select("packet_no", F.array_join(bytes_to_ints(F.col("k")).cast("array<string>"), ",").alias("kept"))


@query(
    "host_pair_id",
    f"""WITH {FRAMES_CTE} SELECT packet_no, md5(array_to_string(list_sort(['0200' || dst4, '0200' || src4,
      CASE WHEN {V6_SQL} THEN 'FD' || repeat('00', 11) ELSE '' END || src4,
      CASE WHEN {V6_SQL} THEN 'FD' || repeat('00', 11) ELSE '' END || dst4]), ',')) AS flow_id
    FROM named WHERE kind <> 'arp'
    UNION ALL SELECT packet_no, md5(array_to_string(list_sort(['0200' || dst4, '0200' || src4]), ',')) FROM named WHERE kind = 'arp'""",
)
def host_pair(spark, sf_dir):
    decoded = decode_packets(synth_frames(spark, sf_dir)).filter("decode_error IS NULL")
    return decoded.select("packet_no", host_pair_id(F.col("data"), F.col("mask"), "md5").alias("flow_id"))


@query(
    "unordered_id",
    f"""WITH {PACKETS_CTE} SELECT packet_no, md5(array_to_string(list_sort([CAST(src_port AS VARCHAR), CAST(dst_port AS VARCHAR), protocol]), ',')) AS pair_id FROM packets""",
)
def unordered(spark, sf_dir):
    columns = [F.col(c) for c in ("src_port", "dst_port", "protocol")]
    return synth_packets(spark, sf_dir).select("packet_no", unordered_id(*columns, digest="md5").alias("pair_id"))


@query(
    "cls_pooling",
    """SELECT vec_id, CASE WHEN vec_id % 4 = 3 THEN 0.0 ELSE CAST(embedding[vec_id % 4 + 1] AS DOUBLE) END AS x,
      CASE WHEN vec_id % 4 = 3 THEN 0.0 ELSE CAST(embedding[vec_id % 4 + 2] AS DOUBLE) END AS y FROM embeddings""",
)
def cls_pooling(spark, sf_dir):
    # Three two-number vectors per row; the class token is at one of them, or nowhere.
    rows = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    vectors = F.array(*[F.slice("e", i, 2) for i in (1, 2, 3)])
    tokens = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.when(i == F.col("vec_id") % 4, 258).otherwise(0))
    pooled = rows.select("vec_id", pooled_vector(tokens, vectors).alias("v"))
    return pooled.select("vec_id", F.element_at("v", 1).alias("x"), F.element_at("v", 2).alias("y"))


@query("slot_gather", "SELECT vec_id, CAST(embedding[vec_id % len(embedding) + 1] AS DOUBLE) AS slot FROM embeddings")
def slot_gather(spark, sf_dir):
    vectors = F.col("embedding").cast("array<double>")
    return table(spark, sf_dir, "embeddings").select("vec_id", slot_vector(vectors, F.col("vec_id") % F.size("embedding")).alias("slot"))


@query(
    "prediction_quality",
    """SELECT count(*) AS n, count(*) FILTER (WHERE list_position(embedding, list_max(embedding)) - 1 = label) AS hits,
      avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label THEN 1.0 ELSE 0.0 END) AS accuracy FROM embeddings""",
)
def prediction_quality(spark, sf_dir):
    scored = synth_predictions(spark, sf_dir).withColumn("predicted", predicted_class(F.col("class_logits")))
    return accuracy(scored)


@query(
    "weighted_loss",
    """WITH l AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    ce AS (SELECT ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[label + 1] AS c,
                  ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[64 - vec_id % 64] AS t FROM l)
    SELECT round(avg(c), 6) AS class_loss, round(avg(t), 6) AS reconstruction_loss, round(4 * avg(c) + avg(t), 6) AS total_loss FROM ce""",
)
def weighted_loss_query(spark, sf_dir):
    loss = weighted_loss(synth_predictions(spark, sf_dir))
    return loss.select(*[F.round(c, 6).alias(c) for c in loss.columns])


@query(
    "masked_position_quality",
    """WITH p AS (SELECT vec_id, i AS pos, list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: CAST(x AS DOUBLE)) AS e, (vec_id + i) % 8 AS target
      FROM embeddings, range(8) t(i) WHERE (vec_id * 3 + i) % 5 = 0),
    s AS (SELECT pos, list_position(e, list_max(e)) - 1 = target AS hit, ln(list_sum(list_transform(e, lambda x: exp(x)))) - e[target + 1] AS loss FROM p)
    SELECT pos, count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9) AS accuracy,
      round(avg(loss), 6) AS loss, 0 AS unbounded FROM s GROUP BY pos
    UNION ALL SELECT -1, count(*), count(*) FILTER (WHERE hit), round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 9), round(avg(loss), 6), 0 FROM s""",
)
def masked_position_quality(spark, sf_dir):
    """Per masked position, and over all of them as position -1."""
    positions = masked_positions(synth_token_predictions(spark, sf_dir), "logits", "targets", "masked")
    both = position_quality(positions, "pos").unionByName(position_quality(positions).withColumn("pos", F.lit(-1)))
    return both.withColumns({"accuracy": F.round("accuracy", 9), "loss": F.round("loss", 6)})
