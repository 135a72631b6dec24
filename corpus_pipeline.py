"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.llm import factorization, markov, minhash, mixture, packing
from packetlake.llm.common import id_remainder, maybe_member, stored, table, tokenizer_path, tuned, unused
from packetlake.session import ship_package

#: Stages score and link documents by models; SQL cannot express them.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the factorisation machine scores below its threshold."""
    begin(spark)
    labels = table(spark, sf_dir, "labels").filter(id_remainder(5) != 0)
    model = factorization.fit(docs, labels)
    score = factorization.quality_score(model, F.col("text"), factorization.length_column(docs))
    return docs.filter(score >= factorization.THRESHOLD)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that no mixture of the learned languages explains; mixtures stay, whatever the shares.

    That is text without a letter, and text whose trigrams are likelier if all
    were equally likely than under its own best mixture (``gain`` of 0 or less).
    """
    begin(spark)
    model = mixture.fit(docs.filter(F.coalesce(id_remainder(4) != 2, F.lit(False))))
    found = mixture.languages_of(model, F.col("text"))
    return docs.filter((found["lang"] != mixture.UNKNOWN) & (found["gain"] > 0))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of near-duplicates.

    Where a doc_id has several texts, each is decided by itself, and of those in
    one group one stays. Rows that repeat as a whole, doc_id and text, count as
    one. Rows without doc_id stay. Only documents that may have to go leave
    their task.
    """
    begin(spark)
    found = stored(minhash.decided(docs), "near-duplicates").filter("doc_id IS NOT NULL")
    # Names that no column of the documents has.
    key, text_hash, stays, maybe = (unused(docs, name) for name in ("going_id", "going_hash", "stays", "maybe"))
    going = found.groupBy("doc_id", "text_hash").agg(F.every("chosen").alias(stays), (F.count("*") > 1).alias("repeats"))
    going = going.filter(~F.col(stays) | F.col("repeats"))
    going = stored(going.select(F.col("doc_id").alias(key), F.col("text_hash").alias(text_hash), stays), "going")
    asked = F.col(maybe) & F.col("doc_id").isNotNull()
    marked = maybe_member(docs, going.select(F.col(key).alias("key")), F.col("doc_id").cast("long"), maybe)
    safe = marked.filter(~asked).drop(maybe)
    same = (F.col("doc_id").cast("long") == F.col(key)) & (F.xxhash64(F.col("text").cast("string")) == F.col(text_hash))
    kept = marked.filter(asked).drop(maybe).join(going, same, "left").filter(F.coalesce(stays, F.lit(True)))
    return safe.unionByName(kept.drop(key, text_hash, stays).dropDuplicates(["doc_id", "text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces each secret by its kind in brackets; n_chars follows the new text."""
    begin(spark)
    model = markov.fit(docs)
    rows = docs.withColumn("text", markov.redacted(model, F.col("text")))
    if "n_chars" not in docs.columns:
        return rows
    kind = docs.schema["n_chars"].dataType
    return rows.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text")).otherwise(F.col("n_chars")).cast(kind))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4,096 ids with their sequence and place in it."""
    begin(spark)
    return packing.pack(packing.cut_pieces(docs, tokenizer_path()))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("language ID", language),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secrets),
    ("best-fit packing", pack),
]


def begin(spark: SparkSession) -> None:
    ship_package(spark)
    tuned(spark)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
