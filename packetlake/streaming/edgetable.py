"""An edge table that is merged where it is read: bases and deltas per bucket of keys.

Below the path, ``delta/batch=n/bucket=b`` holds the edges that batch n brought,
``base/version=n/bucket=b`` a bucket as it was after batch n, and
``commits/batch=n`` which of those folders make the table after batch n. A batch
writes the buckets its edges fall into and nothing else; a bucket with many
deltas is compacted when a batch touches it. Folders are written under the number
of their batch, so a repeated batch writes the same ones again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetlake.operators.graph import EDGE_KEY, EDGE_STATS

BUCKETS, COMPACT_AFTER = 256, 8
COMMIT = "bucket int, base long, pending array<long>"


class EdgeTable:
    """``buckets`` may not change once the table is written; ``compact_after`` is the number of deltas that a bucket may gather."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, compact_after: int = COMPACT_AFTER):
        self.spark, self.path, self.buckets, self.compact_after = spark, path, buckets, compact_after

    def upsert(self, edges: DataFrame, number: int) -> None:
        """Writes batch ``number``: one edge per key, replacing the one that the table has.

        Batches come in order; the last one may come again.
        """
        state = self.commit_before(number)
        bucket = F.pmod(F.xxhash64(*EDGE_KEY), F.lit(self.buckets)).cast("int")
        rows = edges.select(*EDGE_KEY, *EDGE_STATS, bucket.alias("bucket"))
        delta = f"{self.path}/delta/batch={number}"
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(delta)
        # At most ``buckets`` numbers.
        touched = [r.bucket for r in self.spark.read.schema("bucket int").parquet(delta).select("bucket").distinct().collect()] if self.has_rows(delta) else []
        for b in touched:
            base, pending = state.get(b, (None, []))
            state[b] = (base, [*pending, number])
        due = {b: state[b] for b in touched if len(state[b][1]) >= self.compact_after}
        if due:
            merged = self.merged(due).withColumn("bucket", bucket).repartition("bucket")
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/version={number}")
            state.update({b: (number, []) for b in due})
        listed = [(b, base, pending) for b, (base, pending) in sorted(state.items())]
        self.spark.createDataFrame(listed, COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={number}")

    def has_rows(self, folder: str) -> bool:
        try:
            return not self.spark.read.parquet(folder).isEmpty()
        except AnalysisException:
            return False  # a batch without edges leaves a folder without files

    def commit_before(self, number: int | None) -> dict[int, tuple[int | None, list[int]]]:
        """Base and deltas of each bucket after the last batch before ``number``; at most ``buckets`` rows."""
        try:
            commits = self.spark.read.schema(f"{COMMIT}, batch long").parquet(f"{self.path}/commits")
        except AnalysisException:
            return {}
        if number is not None:
            commits = commits.filter(F.col("batch") < number)
        last = commits.select(F.max("batch")).scalar()
        newest = commits.filter(F.col("batch") == last).collect()
        return {r.bucket: (r.base, list(r.pending)) for r in newest}

    def merged(self, state: dict[int, tuple[int | None, list[int]]]) -> DataFrame:
        """The newest edge of each key of the buckets in ``state``; only their folders are listed and read."""
        bases = [f"version={base}/bucket={b}" for b, (base, _) in state.items() if base is not None]
        deltas = [f"batch={n}/bucket={b}" for b, (_, pending) in state.items() for n in pending]
        parts = []
        for kind, number, folders in (("base", "version", bases), ("delta", "batch", deltas)):
            if folders:
                root = f"{self.path}/{kind}"
                found = self.spark.read.option("basePath", root).parquet(*[f"{root}/{f}" for f in folders])
                parts.append(found.select(*EDGE_KEY, *EDGE_STATS, F.col(number).cast("long").alias("batch")))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        newest = both.groupBy(*EDGE_KEY).agg(F.max_by(F.struct(*EDGE_STATS), "batch").alias("s"))
        return newest.select(*EDGE_KEY, "s.*")

    def view(self, number: int | None = None) -> DataFrame:
        """The table now, or as it was after batch ``number``."""
        state = self.commit_before(None if number is None else number + 1)
        if not state:
            raise ValueError(f"{self.path} holds no edge yet")
        return self.merged(state)
