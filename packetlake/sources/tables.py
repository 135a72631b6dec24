"""Readers of stored packet tables and device topologies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.schemas import LABELLED_PACKETS, PACKET_TABLE, TOPOLOGY


def read_packet_table(spark: SparkSession, path: str) -> DataFrame:
    """The seven-column packet table."""
    return spark.read.schema(PACKET_TABLE).parquet(path)


def read_labelled_packets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELLED_PACKETS).parquet(path)


def read_topology(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Devices of topology files (JSON with a ``devices`` list), one row each.

    ``multi_line`` expects one document per file, otherwise one per line.
    """
    files = spark.read.schema(TOPOLOGY).json(path, multiLine=multi_line)
    return files.select(F.explode("devices").alias("d")).select("d.*")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first rows, as a look at a table."""
    return rows.limit(n)
