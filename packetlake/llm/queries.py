"""Registered queries op1 to op13, each applying its operator to the whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.llm import chatwindows, chunkreuse, factorization, forest, grammarruns, idfiles, lexical, markov, minhash, mixture, packing, skipchain, threshold
from packetlake.llm.common import id_remainder, slices, stored, table, tokenizer_path, tuned
from packetlake.session import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        REGISTRY[name] = (function, sql)
        return function

    return register


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return packing.pack(packing.cut_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


@query("op2_token_id_files")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    path = shared_folder(spark, "token-ids")
    idfiles.write_ids(idfiles.encode_in_order(table(spark, sf_dir, "documents"), tokenizer_path()), path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array(idfiles.id_checksums(batch.column(3)), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = idfiles.starts(idfiles.read_ids(spark, path))
    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


@query("op4_language_mixture")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(4) == 2, F.lit(False))
    model = mixture.fit(docs.filter(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), mixture.languages_of(model, F.col("text")).alias("r"))
    return found.select("doc_id", "held_out", F.col("r.lang").alias("lang_pred"), F.col("r.score").alias("score"))


def span_text(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def span_digests(docs: DataFrame, kinds: tuple[str, ...], scan: Callable, base: Callable) -> DataFrame:
    """Counts per base kind, the digest of the base spans, and all spans of ``docs`` (doc_id, text).

    ``scan`` gives all spans of a text. Those that ``base`` gives for the same
    text are among them, in the same order.
    """
    schema = ", ".join(["doc_id long", *(f"n_{kind} long" for kind in kinds), "base_sha256 string", "spans string"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                own = base(text or "")
                counts = [sum(kind == k for kind, _, _ in own) for k in kinds]
                rows.append((*counts, hashlib.sha256(span_text(own).encode()).hexdigest(), span_text(scan(text or ""))))
            columns = list(zip(*rows)) or [()] * (len(kinds) + 2)
            types = [pa.int64()] * len(kinds) + [pa.string()] * 2
            names = ["doc_id", *(f"n_{kind}" for kind in kinds), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(digest, schema)


@query("op5_skip_chain_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    model = skipchain.fit(docs)
    return span_digests(docs, skipchain.KINDS, lambda text: skipchain.spans_of(model, text), skipchain.base_spans)


@query("op8_markov_secrets")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    model = markov.fit(docs)
    return span_digests(docs, markov.KINDS[:3], lambda text: markov.spans_of(model, text), markov.base_spans)


@query("op9_chunk_reuse_encoding")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    path = tokenizer_path()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = chunkreuse.PieceTexts(path)
        for batch in batches:
            for low, high in slices(batch.column(1)):
                out: list[list] = [[], [], []]
                for packed in batch.column(1).slice(low, high - low).to_pylist():
                    ids = np.frombuffer(packed, "<u4").tolist()
                    out[0].append(len(ids))
                    out[1].append(hashlib.sha256(texts.decimal(ids)).hexdigest())
                    out[2].append(hashlib.sha256(texts.decode(ids)).hexdigest())
                columns = [batch.column(0).slice(low, high - low), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    encoded = chunkreuse.encode_documents(table(spark, sf_dir, "documents"), path)
    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, x -> CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, x -> x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), p -> coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op3_forest_embeddings")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op6_minhash_documents")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4)


@query("op7_threshold_search", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return threshold.top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op10_factorization_quality")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder(5) == 0, F.lit(False))
    model = factorization.fit(docs, table(spark, sf_dir, "labels").filter(~held_out))
    score = factorization.quality_score(model, F.col("text"), factorization.length_column(docs))
    found = docs.select("doc_id", held_out.alias("held_out"), score.alias("score"))
    return found.withColumn("predicted", (F.col("score") >= factorization.THRESHOLD).cast("int"))


#: What separates words in the queries over runs.
WHITE_SPACE = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the end of every tenth document, by crc32 of its doc_id, repeats a stretch of itself."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), h.alias("h"), F.floor(h / 10).alias("g"))
    words = F.filter(F.split("text", WHITE_SPACE), lambda w: w != "")
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, words)).withColumn("n", F.when(F.size("words") > 0, F.size("words").cast("long")))
    rows = rows.withColumn("a", (F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a")), F.slice(again, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return rows.select("doc_id", F.coalesce(F.array_join(whole, " "), F.col("text")).alias("text"))


@query("op11_grammar_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    found = grammarruns.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    longer = lambda best, run: F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    found = found.withColumn("best", F.aggregate("runs", none, longer))
    line = lambda run: F.concat(run["start"], F.lit(","), run["length"], F.lit(","), run["period"], F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.*",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query("op12_budgeted_windows")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    said = "<|im_end|><|im_start|>assistant ok"
    planted = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chatwindows.digests(stored(chatwindows.windows(turns, tokenizer_path()), "chat-windows"))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
docs AS (SELECT doc_id, t, len(t) AS n FROM d WHERE len(t) > 0),
totals AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs),
asked AS (SELECT item_id, term, count(*) AS times FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
post AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM docs) GROUP BY ALL),
weighted AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM post GROUP BY term), totals),
scored AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * nn) // ll)))) AS BIGINT) AS score
  FROM asked JOIN weighted USING (term) JOIN post USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""


@query("op13_nra_search", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    tuned(spark)
    return lexical.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def load() -> dict[str, tuple[Query, str | None]]:
    """All of the above, and the pipeline of the repository's top folder."""
    import corpus_pipeline

    return {**REGISTRY, "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}
