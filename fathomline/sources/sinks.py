"""Sinks: scan documents, SARIF and logs (SNK-01..10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scan_documents(findings: DataFrame, by: str) -> DataFrame:
    """SNK-01: one JSON document per scan: its findings in order and their counts."""
    one = F.struct("seq", F.col("file_path").alias("file"), "type", "severity", F.col("start_line").alias("line"), F.col("cwe_id").alias("cwe"), "source")
    return findings.groupBy(by).agg(F.to_json(F.struct(F.col(by), F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list(one)).alias("findings"))).alias("document"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """SNK-02, AGG-23: one rule per type, described by its first finding."""
    first = F.min(F.struct("seq", "description", "severity")).alias("f")
    level = F.when(F.col("f.severity").isin("CRITICAL", "HIGH"), "error").when(F.col("f.severity") == "MEDIUM", "warning").otherwise("note")
    return findings.groupBy("type").agg(first).select(F.col("type").alias("id"), F.col("f.description").alias("text"), level.alias("level"))


def sarif_results(findings: DataFrame) -> DataFrame:
    """SNK-02: one SARIF result per finding, as JSON."""
    level = F.when(F.col("severity").isin("CRITICAL", "HIGH"), "error").when(F.col("severity") == "MEDIUM", "warning").otherwise("note")
    region = F.struct(F.greatest("start_line", F.lit(1)).alias("startLine"), F.greatest("end_line", "start_line").alias("endLine"))
    place = F.struct(F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    return findings.select("seq", F.to_json(F.struct(F.col("type").alias("ruleId"), level.alias("level"), F.struct(F.col("description").alias("text")).alias("message"), F.array(place).alias("locations"))).alias("result"))


def append_log(records: DataFrame, kind: str, path: str) -> None:
    """SNK-08: appends records to a JSON-lines log under their kind."""
    records.select(F.lit(kind).alias("record_type"), F.struct("*").alias("data")).write.mode("append").json(path)
