"""Caption files as a stream, with event-time windows and late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "json", **options) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).options(**options).load(folder)


def counts(stream: DataFrame, ts: str, by: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events by window and kind; rows later than ``late`` behind the watermark go."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    return s.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def sessions(stream: DataFrame, ts: str, by: str, gap: str = "12 hours", late: str = "1 day") -> DataFrame:
    """Runs of events of one key that are at most ``gap`` apart."""
    s = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return s.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop; exactly once into Parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
