"""Writers of packet, graph, queue, feature and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetlake.operators.decode import packet_table
from packetlake.operators.features import csv_projection, flatten_features

BUCKETS = 256


def write_packet_table(packets: DataFrame, path: str, by_day: bool = False, mode: str = "errorifexists") -> None:
    """Seven-column Parquet; by capture day if asked."""
    table = packet_table(packets)
    writer = table.write.mode(mode)
    if by_day:
        day = F.to_date(F.timestamp_seconds("timestamp_s"))
        writer = table.withColumn("day", day).write.mode(mode).partitionBy("day")
    writer.parquet(path)


def write_feature_csv(packets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The 63-column feature file; values with commas are quoted."""
    csv_projection(packets).write.mode(mode).csv(path, header=True)


def write_flat_csv(packets: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flatten_features(packets).write.mode(mode).csv(path, header=True)


def write_graph(nodes: DataFrame, edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    nodes.write.mode(mode).parquet(f"{path}/ip_nodes")
    edges.write.mode(mode).parquet(f"{path}/flow_edges")


def append_payloads(packets: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Appends ``flow_key, packet_no, payload`` below a folder per hash of the flow.

    Reading one flow needs one folder; the rows of a busy flow keep the files of
    the tasks that wrote them and are not gathered.
    """
    bucket = F.pmod(F.xxhash64("flow_key"), F.lit(buckets)).cast("int")
    rows = packets.select("flow_key", "packet_no", "payload", bucket.alias("bucket"))
    rows.write.mode("append").partitionBy("bucket").parquet(path)


def read_payloads(spark, path: str, flow_key: str, buckets: int = BUCKETS) -> DataFrame:
    """The payloads of one flow; only its folder is read."""
    bucket = F.pmod(F.xxhash64(F.lit(flow_key)), F.lit(buckets)).cast("int")
    rows = spark.read.parquet(path)
    return rows.filter((F.col("bucket") == bucket) & (F.col("flow_key") == flow_key)).drop("bucket")


def write_batches(rows: DataFrame, path: str, per_folder: int = 1024, mode: str = "overwrite") -> None:
    """Batches for a trainer, sorted inside folders of ``per_folder`` batches."""
    folder = F.floor(F.col("batch_id") / per_folder).cast("long")
    grouped = rows.withColumn("batch_folder", folder).repartition("batch_folder", F.pmod("batch_id", F.lit(64)))
    grouped.sortWithinPartitions("batch_id", "pos").write.mode(mode).partitionBy("batch_folder").parquet(path)


def write_by_label(packets: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per label."""
    packets.write.mode(mode).partitionBy("AttackLabel").parquet(path)
