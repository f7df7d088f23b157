"""An addition: launches a day as a stream, with a watermark for late events and an idempotent sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def launches(events: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """events (ts, event_type, value), batch or stream -> (day, event_type, n, value)."""
    w = events.withColumn("ts", F.col("ts").cast("timestamp"))
    w = w.withWatermark("ts", late) if events.isStreaming else w
    return w.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("day"), "event_type", "n", "value")


def stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema) -> object:  # noqa: ANN001
    """Starts the stream from Parquet files into a folder for each batch; a batch that is run again replaces its own."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    events = spark.readStream.schema(schema).parquet(source)
    return launches(events).writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(put).start()
