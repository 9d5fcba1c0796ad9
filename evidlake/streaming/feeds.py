"""Streams: the change feed kept applied, and telemetry windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidlake.operators.delete_vectors import DeleteVectorTable, normalized


class AppliedFeed:
    """A delete-vector table that a stream of change batches keeps current.

    Each micro-batch is one version, and its number is part of the version's manifest. So a stream that is started
    again, with a new object or in a new process, goes on where the table is: a batch that was applied before
    is left out, one that broke off is applied as a whole. Changes carry their own order, so late batches leave the same
    state. After ``compact_every`` versions the images are compacted. The table's folder must be shared by
    all executors and is chosen by the caller, as the stream's checkpoint is.
    """

    def __init__(self, spark: SparkSession, path: str, columns: list[str], key: str = "id", compact_every: int = 64):
        self.table, self.compact_every = DeleteVectorTable(spark, path, key, columns), compact_every

    def apply(self, batch: DataFrame, epoch: int) -> None:
        if epoch > self.table.epoch and not batch.isEmpty():
            self.table = self.table.apply(normalized(batch), epoch)
            if len(self.table.manifest["images"]) >= self.compact_every:
                self.table = self.table.compact()

    def start(self, feed: DataFrame, checkpoint: str) -> StreamingQuery:
        return feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply).trigger(availableNow=True).start()

    def read(self) -> DataFrame:
        return self.table.read()


def hit_windows(hits: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Hits per surface and window, each hit counted once by id; rows later than ``late`` are ignored by the stream."""
    t = hits.withColumn("at", F.timestamp_seconds("queried_at")).withWatermark("at", late)
    once = t.dropDuplicatesWithinWatermark(["id"]) if hits.isStreaming else t.dropDuplicates(["id"])
    return once.groupBy(F.window("at", window), "surface").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "surface", "n")
