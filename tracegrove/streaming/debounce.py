"""Changes as streams: bursts debounced by session windows, and tables kept current batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def debounced(changes: DataFrame, key: str = "path", ts: str = "ts", gap: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """One row per burst of changes of a key: a burst ends when nothing came for ``gap``; rows later than ``late`` are lost.

    ``changes`` is a stream (or a batch). State is one open session per key; it is dropped as the watermark passes.
    """
    return (
        changes.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("burst"), F.col(key))
        .agg(F.count("*").alias("changes"), F.min(ts).alias("first"), F.max(ts).alias("last")).select(key, "changes", "first", "last")
    )


def change_feed(spark: SparkSession, folder: str, schema: StructType, extensions: list[str] | None = None) -> DataFrame:
    """Rows of Parquet files as they arrive in ``folder``; of the given extensions only, deletions included."""
    rows = spark.readStream.schema(schema).parquet(folder)
    if extensions:
        rows = rows.where(F.lower(F.regexp_extract("relative_path", r"\.([A-Za-z0-9]+)$", 1)).isin(*extensions))
    return rows


class KeptCurrent:
    """A versioned table of the latest row per key, brought up to date by each micro-batch.

    Each batch reads the last version, takes the newest row per key of both, and writes the next version under
    the batch's number; a batch that is run again writes the same version again, so the result is exactly once.
    ``changed`` is told of the rows that are new or differ.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, content: str, changed: Callable[[DataFrame, int], None] | None = None):
        self.spark, self.path, self.key, self.order, self.content, self.changed = spark, path, key, order, content, changed

    def version(self, number: int) -> str:
        return f"{self.path}/v={number}"

    def read(self, number: int) -> DataFrame | None:
        """The version of the batch ``number``, or the last one before it."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return None
        have = [int(s.getPath().getName()[2:]) for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("v=")]
        have = [v for v in have if v <= number]
        return self.spark.read.parquet(self.version(max(have))) if have else None

    def apply(self, batch: DataFrame, number: int) -> None:
        before = self.read(number - 1)
        every = batch if before is None else before.unionByName(batch)
        others = [c for c in batch.columns if c != self.key]
        order = F.struct(F.col(self.order), F.xxhash64(*others))
        latest = every.groupBy(self.key).agg(F.max_by(F.struct(*others), order).alias("row")).select(self.key, *[F.col("row")[c].alias(c) for c in others])
        latest.select(*batch.columns).write.mode("overwrite").parquet(self.version(number))
        if self.changed:
            now = self.spark.read.parquet(self.version(number))
            new = now if before is None else now.join(before.select(self.key, F.col(self.content).alias("_old"), F.lit(True).alias("_had")), self.key, "left").where(F.col("_had").isNull() | ~F.col(self.content).eqNullSafe(F.col("_old"))).drop("_old", "_had")
            self.changed(new, number)

    def start(self, stream: DataFrame, checkpoint: str, once: bool = False):
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()
