"""Streams: files as they arrive, deduplicated by content; windows over the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_documents(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """New rows of a Parquet folder, the first of each content within the watermark."""
    rows = spark.readStream.schema(schema).parquet(path)
    stamped = rows.withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("seen_at", F.current_timestamp())
    return stamped.withWatermark("seen_at", "1 day").dropDuplicatesWithinWatermark(["sha256"])


def ingest_stream(spark: SparkSession, path: str, schema: StructType | str, out: str, checkpoint: str) -> StreamingQuery:
    """Appends what is new to `out`; a batch that is run again overwrites its own folder, so that nothing is doubled."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream_documents(spark, path, schema).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """event_type, hour, n over a stream or a table of events."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    return timed.groupBy("event_type", F.window("ts", every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("event_type", F.col("w.start").alias("hour"), "n")
