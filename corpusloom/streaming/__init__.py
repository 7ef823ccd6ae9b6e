"""Streams: the same column code on unbounded tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream(spark: SparkSession, path: str, schema: StructType | str, fmt: str = "parquet", max_files: int = 1) -> DataFrame:
    """A folder as an unbounded table."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def written(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Row-wise work, appended exactly once; runs through what is there and stops."""
    return df.writeStream.format(fmt).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def per_batch(df: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Operators that look at a whole batch (packing, chunks, shifts): a micro-batch is their batch. A batch written again replaces itself."""

    def run(batch: DataFrame, number: int) -> None:
        work(batch.withColumn("batch_id", F.lit(number).cast("long"))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return df.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_counts(events: DataFrame, time: str, key: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event-time window and key, with a watermark for late rows."""
    at = events.withColumn("__ts", F.col(time).cast("timestamp")).withWatermark("__ts", late)
    grouped = at.groupBy(F.window("__ts", size, slide) if slide else F.window("__ts", size), key)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n", "total")
