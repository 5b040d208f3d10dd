"""Recorded output of version control, other tools and earlier runs (SRC-04..05, SRC-13, SRC-15, SRC-22, SRC-26, SRC-29) and summary tables (SNK-13..15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.fixed import DEFAULT_EXCLUDES
from fathomline.functions.rules import posix_path
from fathomline.functions.scalars import component_excluded


def changed_files(status: DataFrame, suffix: str = ".py") -> DataFrame:
    """SRC-13: the files that a name-status listing (value: a line) names as added, changed, renamed or untracked.

    A renamed or copied file is its new name; deleted ones are left out.
    """
    parts = F.split("value", "\t")
    letter = F.substring(F.get(parts, F.lit(0)), 1, 1)
    short = F.startswith("value", F.lit("?? "))
    path = F.when(short, F.trim(F.substr("value", F.lit(4)))).when(letter.isin("R", "C"), F.get(parts, F.lit(2))).when(letter.isin("A", "M", "T"), F.get(parts, F.lit(1)))
    return status.select(posix_path(path).alias("path")).where((F.col("path") != "") & F.endswith("path", F.lit(suffix))).distinct()


def confined(path: Column) -> Column:
    """SRC-05: whether a path stays below its root: not blank, not absolute, and never above the root on its way."""
    plain = posix_path(path)
    depth = F.aggregate(F.split(plain, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct(F.when(p == "..", a["at"] - 1).otherwise(a["at"] + 1).alias("at"), F.least(a["low"], F.when(p == "..", a["at"] - 1).otherwise(a["at"] + 1)).alias("low")), lambda a: a["low"])
    return (plain != "") & ~F.startswith(plain, F.lit("/")) & ~F.rlike(plain, F.lit("^[A-Za-z]:")) & (depth >= 0)


def listed(files: DataFrame, extra_excludes: tuple[str, ...] = (), suffix: str = ".py") -> DataFrame:
    """SRC-04: the paths of `files` (path) that a confined listing shows, each once."""
    return files.where(confined(F.col("path")) & F.endswith("path", F.lit(suffix)) & ~component_excluded(F.col("path"), DEFAULT_EXCLUDES + tuple(extra_excludes))).select("path").distinct()


def above_depth(files: DataFrame, depth: int, suffix: str = ".py") -> DataFrame:
    """SRC-15: the files in fewer than `depth` folders."""
    return files.where(F.endswith("path", F.lit(suffix)) & (F.size(F.split("path", "/")) - 1 < depth))


def tool_findings(document: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """SRC-22: detections (d, file, line, cwe, type, source) of a linter's recorded document, and its errors (file, reason); what lies outside `root` is dropped.

    document: results (filename, line_number, issue_cwe.id, test_name), errors (filename, reason).
    """
    top = root.rstrip("/") + "/"
    r = document.select(F.posexplode("results").alias("d", "r")).where(F.startswith("r.filename", F.lit(top)))
    found = r.select(F.col("d").cast("long").alias("d"), posix_path(F.col("r.filename"), root).alias("file"), F.coalesce("r.line_number", F.lit(0)).alias("line"), F.coalesce(F.col("r.issue_cwe.id").cast("string"), F.lit("")).alias("cwe"), F.coalesce("r.test_name", F.lit("")).alias("type"), F.lit("bandit").alias("source"))
    return found, document.select(F.explode("errors").alias("e")).select(posix_path(F.col("e.filename"), root).alias("file"), F.col("e.reason").alias("reason"))


def new_jobs(found: DataFrame, known: DataFrame) -> DataFrame:
    """SRC-26: jobs (id) that other processes have written since, the last state of each."""
    fresh = found.join(known.select("id"), "id", "left_anti")
    return fresh.groupBy("id").agg(F.max_by(F.struct(*[c for c in fresh.columns if c != "id"]), F.col("updated_at")).alias("j")).select("id", "j.*")


def expected_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-29: test, category, vulnerable and cwe of a ground-truth CSV with a commented header; lines without a test are left out."""
    rows = spark.read.option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true").schema("test string, category string, vulnerable string, cwe string").csv(path)
    rows = rows.where("test is not null and test not like '#%'")
    return rows.select("test", "category", (F.lower("vulnerable") == "true").alias("vulnerable"), F.regexp_extract(F.coalesce("cwe", F.lit("")), "([0-9]+)", 1).alias("cwe"))


def summary_csv(rows: DataFrame, path: str, *columns: str) -> None:
    """SNK-13..15: a summary's rows as CSV with a header, in the order of the first column; nulls are empty."""
    rows.select(*columns).orderBy(columns[0]).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)
