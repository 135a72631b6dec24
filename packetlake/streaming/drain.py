"""Draining a folder of messages into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FILES_PER_BATCH = 100


def message_stream(spark: SparkSession, folder: str, schema: StructType, files: int = FILES_PER_BATCH) -> DataFrame:
    """Landed Parquet files as a stream, a bounded number of files per micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def drain(messages: DataFrame, path: str, checkpoint: str) -> None:
    """Appends everything there is, exactly once, and stops."""
    query = (
        messages.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
