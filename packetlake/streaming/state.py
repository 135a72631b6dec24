"""Streams whose keyed state lies in the RocksDB store."""

from __future__ import annotations

from pyspark.sql import DataFrame

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def append_with_state(rows: DataFrame, path: str, checkpoint: str) -> list:
    """Drains a stateful stream into a Parquet table, each row exactly once; returns the progress of its micro-batches."""
    spark = rows.sparkSession
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)  # read where the query starts, and kept in its checkpoint
    query = (
        rows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return list(query.recentProgress)
