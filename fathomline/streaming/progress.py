"""Progress events: latest state, debounce, and the same as streams (STR-01, STR-04)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """STR-01: the last event of each key; `at` has no ties within a key."""
    last = F.max_by(F.struct(*values), at).alias("last")
    return events.groupBy(key).agg(F.max(at).alias(at), last).select(key, at, *[f"last.{v}" for v in values])


def debounced(events: DataFrame, key: str, at: str, tie: str, seconds: int) -> DataFrame:
    """STR-04: bursts of each key, with gaps under `seconds` inside: key, first, last, events."""
    w = Window.partitionBy(key).orderBy(at, tie)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))
    burst = F.sum(F.coalesce((gap >= seconds * 1_000_000).cast("int"), F.lit(1))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("burst", burst).groupBy(key, "burst").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("events")).drop("burst")


def stream_events(spark: SparkSession, folder: str, like: DataFrame, glob: str = "*.parquet", files_per_batch: int = 1) -> DataFrame:
    """Event files as they arrive, of the schema of `like`."""
    return spark.readStream.schema(like.schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_latest(events: DataFrame, key: str, at: str, values: list[str], out: str, checkpoint: str):
    """STR-01 as a stream: `out` always holds the last event of each key that has arrived."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return latest(events, key, at, values).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def stream_bursts(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """STR-04 as a stream: session windows, closed once the watermark has passed them."""
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(key, F.session_window(at, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(key, F.col("w.start").alias("first"), F.col("w.end").alias("closed"), "events")
