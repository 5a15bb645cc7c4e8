"""Ticks to bars, as a batch or as a stream with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars_of_ticks(ticks: DataFrame, width: str = "1 day", *, late: str | None = None) -> DataFrame:
    """(symbol, timestamp, open, high, low, close, volume) of ticks (symbol, ts, seq, price, size) in windows of `width`.

    With `late` on a stream, windows close once the watermark passes them and later ticks are left out."""
    df = ticks.withWatermark("ts", late) if late else ticks
    out = df.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", F.struct("ts", "seq")).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", F.struct("ts", "seq")).alias("close"), F.sum("size").alias("volume"),
    )
    return out.select("symbol", F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume")


def event_ticks(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").cast("string").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("size"))


def stream_ticks(spark: SparkSession, folder: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(folder)
