"""Aggregations, rankings, windows, views and evidence states (AGG-01..13, AGG-20..22, AGG-31, RNK-04..07, RNK-09..10, PRJ-22, PRJ-44, PRJ-50, FLT-10, JON-19, JON-22)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.rules import posix_path, source_label
from fathomline.functions.scalars import coerce_confidence, normalize_cwe, severity_weight


def severity_summary(findings: DataFrame, *by: str, chains: DataFrame | None = None) -> DataFrame:
    """AGG-01, AGG-02: totals by severity, the summed weights as risk, and risk_score, a tenth more for each chain.

    chains: `by` and chains, how many chains each group has; none without it.
    """
    counts = [F.count_if(F.col("severity") == s).alias(s.lower()) for s in fixed.SEVERITIES]
    out = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), *counts, F.sum(severity_weight(F.col("severity"))).cast("long").alias("risk"))
    if chains is not None:
        out = out.join(chains.select(*by, F.col("chains").alias("__chains")), list(by), "left")
    n = F.coalesce("__chains", F.lit(0)) if chains is not None else F.lit(0)
    return out.withColumn("risk_score", F.round(F.col("risk") * (1 + F.lit(0.1) * n), 2)).select(*by, "total", *[s.lower() for s in fixed.SEVERITIES], "risk", "risk_score")


def provenance(findings: DataFrame) -> DataFrame:
    """AGG-03: source, n: how many findings each tier has alone and both have together, none counting as 0, and TOTAL."""
    counts = findings.agg(*[F.count_if(F.col("source") == s).alias(s) for s in fixed.CONFIDENCE], F.count(F.lit(1)).alias("TOTAL"))
    return counts.unpivot([], counts.columns, "source", "n")


def top_types(findings: DataFrame, n: int = 10) -> DataFrame:
    """AGG-04: the commonest types, ties by name."""
    return findings.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "type").limit(n)


def coverage(files: DataFrame) -> DataFrame:
    """AGG-05, AGG-06: files by outcome and the scan's status; files: status (completed, partial, failed)."""
    n = F.count(F.lit(1))
    done, failed, partial = (F.count_if(F.col("status") == s) for s in ("completed", "failed", "partial"))
    status = F.when(failed == n, "failed").when((failed > 0) | (partial > 0), "partial").otherwise("completed")
    return files.agg(n.alias("requested"), done.alias("completed"), failed.alias("failed"), partial.alias("partial"), status.alias("status"))


def stability(signatures: DataFrame) -> DataFrame:
    """AGG-09: of runs (configuration, run, signature, a row for each finding): how many signatures every run has and how many come and go, both in per cent, and the least, most and average findings of a run, with the spread."""
    each = signatures.groupBy("configuration", "run").agg(F.count(F.lit(1)).alias("found"))
    runs = each.groupBy("configuration").agg(F.count(F.lit(1)).alias("runs"), F.min("found").alias("least"), F.max("found").alias("most"), F.round(F.avg("found"), 1).alias("average"))
    seen = signatures.groupBy("configuration", "signature").agg(F.count_distinct("run").alias("n")).join(runs, "configuration")
    told = ["runs", "least", "most", "average"]
    stable = F.count_if(F.col("n") == F.col("runs"))
    out = seen.groupBy("configuration", *told).agg(F.count(F.lit(1)).alias("signatures"), stable.alias("stable"))
    out = out.withColumn("consistency_pct", F.round(F.col("stable") / F.col("signatures") * 100, 1))
    return out.select("configuration", "runs", "signatures", "stable", (F.col("signatures") - F.col("stable")).alias("intermittent"), "consistency_pct", F.round(100 - F.col("consistency_pct"), 1).alias("variance_pct"), "least", "most", "average", (F.col("most") - F.col("least")).alias("spread"))


def newest(jobs: DataFrame, limit: int) -> DataFrame:
    """RNK-04: the newest jobs, ties by id."""
    return jobs.orderBy(F.desc("created_at"), "id").limit(max(1, limit))


def retained(jobs: DataFrame, by: str, keep: int = 50) -> DataFrame:
    """RNK-05: unfinished jobs, and the newest `keep` finished ones of each `by`."""
    place = F.row_number().over(Window.partitionBy(by, F.col("status").isin("running", "queued")).orderBy(F.desc("created_at"), "id"))
    return jobs.withColumn("__n", place).where(F.col("status").isin("running", "queued") | (F.col("__n") <= keep)).drop("__n")


def capped_events(events: DataFrame, by: str, at: str, head: int = 50, tail: int = 1450) -> DataFrame:
    """RNK-06: of a log longer than head + tail, its first `head` and last `tail` events."""
    w = Window.partitionBy(by)
    place = events.withColumn("__n", F.row_number().over(w.orderBy(at))).withColumn("__all", F.count(F.lit(1)).over(w))
    return place.where((F.col("__n") <= head) | (F.col("__n") > F.col("__all") - tail)).drop("__n", "__all")


def search(lines: DataFrame, pattern: str, literal: bool = True, limit: int = 40) -> DataFrame:
    """RNK-09: the first matching lines by path and line."""
    test = F.contains("text", F.lit(pattern)) if literal else F.rlike("text", F.lit(pattern))
    return lines.where(test).select("path", "line", "text").orderBy("path", "line").limit(limit)


def first_occurrences(rows: DataFrame, value: str, at: str) -> DataFrame:
    """RNK-10: distinct values in the order of their first occurrence, as (value, first)."""
    return rows.groupBy(value).agg(F.min(at).alias("first"))


def code_window(lines: DataFrame, marked: Column, around: int = 2) -> DataFrame:
    """PRJ-22: for each marked line, the lines around it, numbered, with `>` at the line itself."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(-around, around)
    near = F.collect_list(F.struct("line", "text")).over(w)
    out = lines.withColumn("__near", near).where(marked)
    shown = F.transform("__near", lambda x: F.concat(F.when(x["line"] == F.col("line"), "> ").otherwise("  "), x["line"].cast("string"), F.lit(": "), x["text"]))
    return out.select("path", "line", F.array_join(shown, "\n").alias("window"))


def snapshot(files: DataFrame) -> DataFrame:
    """STR-05: path and sha256 of the content."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def manifest_digest(snapshots: DataFrame, *by: str) -> DataFrame:
    """AGG-20: 16 digits over the sorted `path:hash` lines of each group."""
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "path", "sha256")))
    return snapshots.groupBy(*by).agg(F.substring(F.sha2(F.array_join(lines, "\n"), 256), 1, 16).alias("digest"), F.count(F.lit(1)).alias("files"))


def evidence_state(evidence: DataFrame, current: DataFrame) -> DataFrame:
    """JON-19: evidence_id, state: valid, or why not (missing, changed, out_of_range).

    evidence: evidence_id, path, content_hash, end_line; current: path, sha256, n_lines.
    """
    e = evidence.join(current, "path", "left")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("content_hash"), "changed").when(F.col("end_line") > F.col("n_lines"), "out_of_range").otherwise("valid")
    return e.select("evidence_id", state.alias("state"))


def stale_assessments(assessments: DataFrame, states: DataFrame) -> DataFrame:
    """JON-22: supported or refuted assessments of which any evidence is not valid.

    assessments: finding_id, status, evidence_ids.
    """
    used = assessments.where(F.col("status").isin("supported", "refuted")).select("finding_id", "status", F.explode("evidence_ids").alias("evidence_id"))
    bad = used.join(states, "evidence_id", "left").where(F.coalesce("state", F.lit("unknown")) != "valid")
    return bad.groupBy("finding_id", "status").agg(F.count(F.lit(1)).alias("invalid"))


def call_summary(calls: DataFrame, by: str) -> DataFrame:
    """AGG-12, AGG-13: requests, failures and token sums; calls: ok, tokens."""
    return calls.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("ok")).alias("failed"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("most"))


def finding_view(findings: DataFrame, root: str | None = None) -> DataFrame:
    """PRJ-50: findings as a scan's output shows them: relative paths, CWE and source by their usual names, clamped confidence; what is blank is null, so JSON leaves it out.

    findings: seq, type, cwe_id, severity, file_path, start_line, end_line,
    confidence, source, description, context and, where there, owasp_category,
    cvss_score, impact, remediation, secure_code_example.
    """
    more = {"owasp_category": "owasp", "cvss_score": "cvss", "impact": "impact", "remediation": "remediation", "secure_code_example": "secure_code_example"}
    rest = [(F.nullif(c, F.lit("")) if dict(findings.dtypes)[c] == "string" else F.col(c)).alias(n) for c, n in more.items() if c in findings.columns]
    told = lambda c: F.coalesce(c, F.lit(""))
    return findings.select("seq", "type", normalize_cwe(F.col("cwe_id")).alias("cwe"), "severity", posix_path(F.col("file_path"), root).alias("file"), "start_line", "end_line", coerce_confidence(F.col("confidence")).alias("confidence"), source_label(F.col("source")).alias("source"), told("description").alias("description"), told("context").alias("snippet"), *rest)


def job_payload(view: DataFrame, files: DataFrame, by: str) -> DataFrame:
    """AGG-22: per scan its findings by severity and by source, how many files it has, and their summed risk in two places.

    view: `by` and finding_view's columns; files: `by`, risk_score.
    """

    def counted(column: str) -> DataFrame:
        one = view.groupBy(by, F.coalesce(column, F.lit("")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        return one.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))  # a handful of names

    risk = files.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.round(F.sum(F.coalesce("risk_score", F.lit(0.0))), 2).alias("risk_score"))
    return risk.join(counted("severity").withColumnRenamed("m", "counts"), by, "left").join(counted("source").withColumnRenamed("m", "sources"), by, "left")


def failed_or_degraded(status: Column, degraded: Column, engine_failure: Column, rule_error: Column, report_states: Column) -> Column:
    """FLT-10: why a scan's result cannot be relied on, or null: an engine's failure first, then its status, then its reports'."""
    bad = F.filter(F.coalesce(report_states, F.array().cast("array<string>")), lambda s: s.isin("failed", "partial", "degraded"))
    return (
        F.when(F.coalesce(engine_failure, F.lit(False)), "engine failure")
        .when(F.coalesce(rule_error, F.lit("")) != "", F.concat(F.lit("rule error: "), rule_error))
        .when(status.isin("failed", "error"), F.concat(F.lit("failed with status "), status))
        .when(status.isin("partial", "incomplete"), F.concat(F.lit("incomplete with status "), status))
        .when(F.coalesce(degraded, F.lit(False)), "degraded coverage")
        .when(~status.isin("completed", "clean"), F.concat(F.lit("incomplete with status "), status))
        .when(F.size(bad) > 0, F.concat(F.lit("a report is "), F.get(bad, F.lit(0))))
    )


def route_category(text: Column, known: tuple[str, ...]) -> Column:
    """PRJ-44: the category that a benchmark route names (`/benchmark/<category>-...`), if it is a known one."""
    found = F.lower(F.substring_index(F.regexp_extract(F.coalesce(text, F.lit("")), "/benchmark/([^/]+)/", 1), "-", 1))
    return F.when(found.isin(*known), found)


def ordered_summaries(summaries: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """AGG-31: one summary of each model, the newest file's, with its place: the named models first, in their order, then the others by name."""
    one = summaries.where("model is not null").groupBy("model").agg(F.max_by(F.struct(*[c for c in summaries.columns if c not in ("model", "file")]), "file").alias("s"))
    at = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("model"))
    return one.select("model", "s.*", F.when(at > 0, at).otherwise(len(order) + 1).alias("__at")).withColumn("place", F.row_number().over(Window.orderBy("__at", "model"))).drop("__at")  # one row per model
