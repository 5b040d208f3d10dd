"""Routing, suppression, baselines, gates and fix checks (FLT-01..07, JON-08..09, JON-21)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions.scalars import lines_of, severity_rank

DIRECTIVE = r"(?i)#\s*scan:\s*ignore(?:\[([A-Z_,\s()]+)\])?(?:\s+(.*))?$"
WHOLE_FILE = r"(?i)#\s*scan:\s*ignore-file\b"
FOREIGN = r"(?i)#\s*(?:nosec|nosemgrep|noqa:\s*S[0-9]+)\b"


def route(files: DataFrame, rule_hits: DataFrame | None = None, min_risk: int = 3, limit: int | None = None) -> DataFrame:
    """FLT-01: files (path, risk) with a rule hit or enough risk; with a limit, those of highest risk, then first by path."""
    out = files
    if rule_hits is not None:
        hit = rule_hits.select(F.col("file_path").alias("path")).distinct().withColumn("__hit", F.lit(True))
        out = out.join(hit, "path", "left")
        out = out.where(F.coalesce("__hit", F.lit(False)) | (F.col("risk") >= min_risk)).drop("__hit")
    else:
        out = out.where(F.col("risk") >= min_risk)
    return out if limit is None else out.orderBy(F.desc("risk"), "path").limit(limit)


def directives(files: DataFrame, directive: str = DIRECTIVE, whole: str = WHOLE_FILE, foreign: str = FOREIGN) -> DataFrame:
    """FLT-03: path, line, types (null for all); a whole-file directive is line 0.

    A directive holds for its line and the next; the next line's own directive
    comes before it, a foreign marker there does not.
    """
    lines = files.select("path", F.posexplode(lines_of(F.col("content"))).alias("at", "text")).withColumn("line", F.col("at") + 1)
    all_file = lines.where(F.rlike("text", F.lit(whole)))
    own = F.rlike("text", F.lit(directive)) & ~F.rlike("text", F.lit(whole))
    listed = F.regexp_extract("text", directive, 1)
    types = F.when(listed != "", F.array_remove(F.transform(F.split(F.upper(listed), ","), lambda t: F.trim(t)), ""))
    marks = lines.select("path", "line", F.when(own, F.lit(0)).when(F.rlike("text", F.lit(foreign)), F.lit(2)).alias("kind"), F.when(own, types).alias("types")).where("kind is not null")
    after = marks.where("kind = 0").select("path", (F.col("line") + 1).alias("line"), F.lit(1).alias("kind"), "types")
    best = Window.partitionBy("path", "line").orderBy("kind")
    chosen = marks.unionByName(after).withColumn("__n", F.row_number().over(best)).where("__n = 1").select("path", "line", "types")
    whole_rows = all_file.select("path", F.lit(0).alias("line"), F.lit(None).cast("array<string>").alias("types")).distinct()
    return chosen.join(whole_rows.select("path"), "path", "left_anti").unionByName(whole_rows)


def suppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """FLT-04: the findings that a directive covers on any of their lines."""
    f = findings.withColumn("__end", F.greatest(F.coalesce("end_line", "start_line"), "start_line"))
    inside = (marks["line"] == 0) | ((marks["line"] >= f["start_line"]) & (marks["line"] <= f["__end"]))
    fits = marks["types"].isNull() | F.array_contains(F.coalesce(marks["types"], F.array().cast("array<string>")), F.upper(f["type"]))
    return f.join(marks, (f["file_path"] == marks["path"]) & inside & fits, "left_semi").drop("__end")


def unsuppressed(findings: DataFrame, marks: DataFrame) -> DataFrame:
    """FLT-05: the findings that no directive covers."""
    return findings.join(suppressed(findings, marks).select("seq"), "seq", "left_anti")


def partition_by_baseline(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """JON-08: adds is_new: the fingerprint is not in the baseline."""
    known = baseline.select("fingerprint").distinct().withColumn("__known", F.lit(True))
    return findings.join(known, "fingerprint", "left").withColumn("is_new", F.col("__known").isNull()).drop("__known")


def resolved(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """JON-09: baseline fingerprints that are gone."""
    return baseline.join(findings.select("fingerprint"), "fingerprint", "left_anti")


def updated_baseline(findings: DataFrame, baseline: DataFrame, now: Column) -> DataFrame:
    """SNK-05: one row per fingerprint; the first_seen of known ones stays."""
    first = F.min(F.struct("seq", "file_path", "type", "severity")).alias("f")
    fresh = findings.groupBy("fingerprint").agg(first).select("fingerprint", "f.file_path", "f.type", "f.severity")
    return fresh.join(baseline.select("fingerprint", "first_seen"), "fingerprint", "left").withColumn("first_seen", F.coalesce("first_seen", now))


def gate(findings: DataFrame, threshold: str | None, confirmed_only: bool = False) -> DataFrame:
    """FLT-06: findings at or above the threshold; confirmed_only leaves out model-only ones (rule-only ones still block)."""
    if threshold is None:
        return findings.where("false")
    out = findings.where(severity_rank(F.col("severity")) <= severity_rank(F.lit(threshold)))
    return out.where("source <> 'LLM'") if confirmed_only else out


def fix_check(before: DataFrame, after: DataFrame) -> DataFrame:
    """JON-21: fingerprint and state (resolved, persistent, regression)."""
    a = before.select("fingerprint").distinct().withColumn("__b", F.lit(True))
    b = after.select("fingerprint").distinct().withColumn("__a", F.lit(True))
    state = F.when(F.col("__a").isNull(), "resolved").when(F.col("__b").isNull(), "regression").otherwise("persistent")
    return a.join(b, "fingerprint", "full_outer").select("fingerprint", state.alias("state"))
