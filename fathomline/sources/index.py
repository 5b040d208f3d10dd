"""An index of files' rows that is brought up to date file by file (DF-01, DF-21).

The rows lie in a Parquet table partitioned by a hash of the path.  An update
reads only the partitions that changed and removed files fall into, and replaces
those alone; with many more parts than files change, few of them are written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.sources.shared import stored


def _part(parts: int):
    return F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int").alias("part")


def create_index(files: DataFrame, rows_of: Callable[[DataFrame], DataFrame], path: str, parts: int = 1024) -> None:
    """Writes rows_of(files), which have a path, to the index at `path`, with the files' hashes; files: path, content.

    A null path is left out; repeated files give their rows repeatedly; no files give an empty index.
    """
    known = files.where("path is not null")
    rows_of(known).select("*", _part(parts)).repartition("part").write.partitionBy("part").parquet(f"{path}/rows")
    known.select("path", F.md5(F.coalesce("content", F.lit(""))).alias("hash"), _part(parts)).repartition("part").write.partitionBy("part").parquet(f"{path}/files")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all files."""
    return spark.read.parquet(f"{path}/rows").where("path is not null").drop("part")


def update_index(spark: SparkSession, files: DataFrame, rows_of: Callable[[DataFrame], DataFrame], path: str, removed: DataFrame | None = None, parts: int = 1024) -> DataFrame:
    """Brings the index up to date with changed and new files (path, content) and removed ones (path); what it rewrote, as rows of path, state (changed, same, removed).

    Files whose content has the hash that the index knows are left alone.  Rows of
    changed and removed files go, whatever they were, and `parts` is that of
    create_index.  Only the partitions of such files are read and replaced.
    """
    given = files.where("path is not null").select("path", "content", F.md5(F.coalesce("content", F.lit(""))).alias("hash"), _part(parts))
    held = spark.read.schema("path string, hash string, part int").parquet(f"{path}/files")
    met = given.join(held.select("path", "part", F.col("hash").alias("was")), ["path", "part"], "left")
    met = stored(met.withColumn("state", F.when(F.col("hash") == F.col("was"), "same").otherwise("changed")))
    gone = removed.where("path is not null").select("path", _part(parts)).distinct() if removed is not None else met.select("path", "part").limit(0)
    changed = met.where("state = 'changed'")
    stale = stored(changed.select("path", "part").unionByName(gone).distinct())
    touched = stored(stale.select("part").distinct())
    fresh = changed.join(gone, ["path", "part"], "left_anti")
    rows = spark.read.parquet(f"{path}/rows")
    # there are at most `parts` of them, so they are broadcast; partitions named by a join are pruned where Spark knows them in time; what is rewritten is stored first, as it is read from where it goes
    for name, new in (("rows", rows_of(fresh.select("path", "content")).select("*", _part(parts))), ("files", fresh.select("path", "hash", "part"))):
        old = (rows if name == "rows" else held).where("path is not null").join(F.broadcast(touched), "part", "left_semi").join(stale, ["path", "part"], "left_anti")
        whole = stored(old.select(*new.columns).unionByName(new))
        # a partition that has lost all its files keeps a row without a path, which readers leave out
        empty = touched.join(whole.select("part").distinct(), "part", "left_anti")
        blank = empty.select(*[F.col("part") if c == "part" else F.lit(None).cast(t).alias(c) for c, t in whole.dtypes])
        whole.unionByName(blank).repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{path}/{name}")
    return met.join(gone, ["path", "part"], "left_anti").select("path", "state").unionByName(gone.select("path", F.lit("removed").alias("state")))
