"""Recorded model responses by the key of their file's content (SRC-24, SNK-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.scalars import cache_key


def keyed(files: DataFrame, *settings: str) -> DataFrame:
    """`files` (path, content) with the key of their content under these settings."""
    return files.withColumn("key", cache_key(F.col("content"), *settings))


def write(responses: DataFrame, path: str) -> None:
    """SNK-06: appends responses (key, response, error, truncated); errors and cut responses are never kept."""
    good = responses.where("error is null and not coalesce(truncated, false) and response is not null")
    good.select("key", "response").write.mode("append").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All kept responses, one of each key; unreadable files count as misses."""
    rows = spark.read.option("ignoreCorruptFiles", "true").schema("key string, response string").parquet(path)
    return rows.groupBy("key").agg(F.max("response").alias("response"))


def looked_up(files: DataFrame, cache: DataFrame, *settings: str) -> DataFrame:
    """SRC-24: `files` with key, response (null: a miss) and hit."""
    return keyed(files, *settings).join(cache.select("key", "response"), "key", "left").withColumn("hit", F.col("response").isNotNull())
