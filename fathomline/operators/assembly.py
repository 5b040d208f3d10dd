"""From tiers to reports: scope, snippets, reliable rules, per-file status, verification (FLT-02, FLT-07, PRJ-14, JON-05, RNK-03, RNK-12, AGG-24, AGG-27..28)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.rules import reliable
from fathomline.functions.scalars import fingerprint, severity_rank
from fathomline.operators.firstcome import BLOCK, first_come, placed
from fathomline.sources.shared import stored

#: Lines of a snippet after its first.
SNIPPET_LINES = 12


def with_snippets(findings: DataFrame, files: DataFrame) -> DataFrame:
    """PRJ-14: context is the finding's lines, at most SNIPPET_LINES after the first, trimmed; findings of unknown files keep theirs.

    files: path, content.
    """
    lines = F.split("__content", "\n")
    last = F.least(F.greatest(F.coalesce("end_line", "start_line"), "start_line"), F.col("start_line") + SNIPPET_LINES)
    cut = F.trim(F.array_join(F.slice(lines, F.greatest("start_line", F.lit(1)), F.greatest(F.lit(1), last - F.greatest("start_line", F.lit(1)) + 1)), "\n"), F.lit(" \t\n\r\f\x0b"))
    told = files.select(F.col("path").alias("file_path"), F.col("content").alias("__content"))
    return findings.join(told, "file_path", "left").withColumn("context", F.coalesce(cut, F.col("context"))).drop("__content")


def in_scope(findings: DataFrame, files: DataFrame) -> DataFrame:
    """FLT-07: the findings of discovered files, with snippets and with fingerprints taken anew."""
    kept = with_snippets(findings.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi"), files)
    return kept.withColumn("fingerprint", fingerprint(F.col("file_path"), F.col("type"), F.col("context"), F.col("start_line")))


def keep_reliable(fused: DataFrame, read_by_model: DataFrame) -> DataFrame:
    """FLT-02 applied: rule findings that no model finding confirms go where the model read the file, unless they are reliable.

    fused: fusion's columns and rule_id, context; read_by_model: path.
    """
    sure = reliable(F.array("rule_id"), F.col("severity"), F.col("cwe_id"), F.col("type"), F.col("context"), F.col("description"))
    read = read_by_model.select(F.col("path").alias("file_path")).distinct().withColumn("__read", F.lit(True))
    return fused.join(read, "file_path", "left").where((F.col("source") != "SEMGREP") | F.col("__read").isNull() | sure).drop("__read")


@dataclass(frozen=True)
class Engines:
    """What a scan was asked for, and whether the rule engine was there or failed as a whole."""

    rules: bool = True
    model: bool = True
    rules_available: bool = True
    rules_error: str = ""


def assemble(files: DataFrame, rule_counts: DataFrame, model_counts: DataFrame, routed: DataFrame, errors: DataFrame, engines: Engines = Engines(), missing: DataFrame | None = None) -> DataFrame:
    """JON-05: per file its status, each tier's state and reason, and each tier's number of findings.

    files: path; rule_counts, model_counts: path, n; routed: path, outcome of the
    model tier (a file without one was not routed); errors: path, message of the
    rule engine, of which a file's least counts; missing: path of files asked for
    and not found.
    """
    first = errors.groupBy("path").agg(F.min("message").alias("__error"))
    told = files.select("path").join(routed.groupBy("path").agg(F.min("outcome").alias("__outcome")), "path", "left").join(first, "path", "left")
    told = told.join(rule_counts.select("path", F.col("n").alias("rules_found")), "path", "left").join(model_counts.select("path", F.col("n").alias("model_found")), "path", "left")
    outcome = F.coalesce("__outcome", F.lit("not routed"))
    if engines.model:
        model = F.when(F.startswith(outcome, F.lit("failed")), "failed").when(outcome == "not routed", "not_routed").otherwise("ok")
        model_why = F.when(F.startswith(outcome, F.lit("failed")), outcome).when(outcome == "not routed", "File did not clear risk threshold").otherwise("")
    else:
        model, model_why = F.lit("disabled"), F.lit("LLM tier disabled")
    told = told.withColumn("model_state", model).withColumn("model_reason", model_why)
    whole = "disabled" if not engines.rules else "failed" if engines.rules_error else "unavailable" if not engines.rules_available else ""
    if whole:
        why = {"disabled": "Engine disabled", "failed": engines.rules_error, "unavailable": "Rule engine unavailable"}[whole]
        told = told.withColumn("rules_state", F.lit(whole)).withColumn("rules_reason", F.lit(why))
    else:
        skipped = F.lit("syntax_skipped" if engines.model else "parse_error")
        broken = F.when(F.col("model_state") == "ok", skipped).otherwise("parse_error")
        told = told.withColumn("rules_state", F.when(F.col("__error").isNotNull(), broken).otherwise("ok")).withColumn("rules_reason", F.coalesce("__error", F.lit("")))
    failed = (F.col("rules_state").isin("failed", "parse_error") & (F.col("model_state") != "ok")) | (F.col("model_state") == "failed")
    partial = (F.col("rules_state") == "unavailable") | (F.col("model_state") == "not_routed")
    out = told.select("path", F.when(failed, "failed").when(partial, "partial").otherwise("completed").alias("status"), "rules_state", "rules_reason", "model_state", "model_reason", F.coalesce("rules_found", F.lit(0)).cast("long").alias("rules_found"), F.coalesce("model_found", F.lit(0)).cast("long").alias("model_found"))
    if missing is not None:
        gone = [F.lit(x) for x in ("failed", "failed", "Target file missing on disk or inaccessible", "not_routed", "Target file missing")]
        out = out.unionByName(missing.select("path", *[c.alias(n) for c, n in zip(gone, out.columns[1:6], strict=True)], F.lit(0).cast("long").alias("rules_found"), F.lit(0).cast("long").alias("model_found")))
    return out


def report_degraded(*states: Column) -> Column:
    """AGG-28: a tier's state, up to a colon, is none that was intended."""
    out = F.lit(False)
    for state in states:
        out = out | ~F.trim(F.substring_index(state, ":", 1)).isin(*fixed.INTENTIONAL_STATES)
    return out


def scan_degraded(reports: DataFrame, files_requested: int, engine_failed: bool = False) -> DataFrame:
    """AGG-27: one row, degraded: the engine failed, files were asked for and none reported, or a report is degraded."""
    some = F.coalesce(F.bool_or(report_degraded(F.col("rules_state"), F.col("model_state"))), F.lit(False))
    return reports.agg((F.lit(engine_failed) | some | ((F.count(F.lit(1)) == 0) & F.lit(files_requested > 0))).alias("degraded"))


def with_verdicts(findings: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Findings with assessment_status after verification; an upheld finding is confident and corroborated.

    findings: seq, type, cwe_id, confidence, corroborated, has_taint; verdicts:
    seq, verdict (confirmed, refuted, else uncertain), control.  A refuted finding
    that a syntax slice or a taint path backs is uncertain unless a control is
    named; for weak hashing a constant input is no control.  A finding without a
    verdict has a null status.
    """
    said = findings.join(verdicts.select("seq", "verdict", F.lower(F.trim(F.coalesce("control", F.lit("")))).alias("__control")), "seq", "left")
    weak = F.regexp_replace(F.coalesce("cwe_id", F.lit("")), "^CWE-", "").isin("327", "328") | (F.col("type") == "USE_OF_WEAK_HASHING_ALGORITHM")
    void = F.lit(False)
    for word in fixed.VOID_CONTROL:
        void = void | F.contains("__control", F.lit(word))
    controlled = ~F.col("__control").isin(*fixed.NO_CONTROL) & ~(weak & void)
    backed = F.coalesce("corroborated", F.lit(False)) | F.coalesce("has_taint", F.lit(False))
    status = F.when(F.col("verdict").isNull(), F.lit(None)).when(F.col("verdict") == "confirmed", "supported").when((F.col("verdict") == "refuted") & (~backed | controlled), "refuted").otherwise("uncertain")
    said = said.withColumn("assessment_status", status)
    upheld = F.coalesce(F.col("assessment_status") == "supported", F.lit(False))
    return said.withColumn("confidence", F.when(upheld, 0.98).otherwise(F.col("confidence"))).withColumn("corroborated", F.when(upheld, True).otherwise(F.col("corroborated"))).drop("verdict", "__control")


def verified(assessed: DataFrame, window: int = fixed.FUSION_LINES, block_lines: int = BLOCK) -> DataFrame:
    """RNK-03: all findings with `kept`: not refuted, and in files that lost one not a lesser finding near a better one of its kind.

    Better: corroborated, then of both tiers, then the more confident, then the
    worse, then the earlier in seq.  Lines are compared by their starts alone.
    A null confidence counts as 0.5, a null corroborated as false.
    """
    orders = [~F.coalesce("corroborated", F.lit(False)), ~F.coalesce(F.col("source") == "CONFIRMED", F.lit(False)), -F.coalesce("confidence", F.lit(0.5)), severity_rank(F.col("severity"))]
    # what the walk needs, assessed once and without the texts
    slim = stored(assessed.select("seq", "file_path", "type", "cwe_id", "start_line", "assessment_status", *[o.alias(f"__o{k}") for k, o in enumerate(orders)]))
    lost = slim.where("assessment_status = 'refuted'").select("file_path").distinct().withColumn("__lost", F.lit(True))
    tried = slim.join(lost, "file_path").where("assessment_status is null or assessment_status <> 'refuted'").select("seq", "file_path", "type", "cwe_id", "start_line", "__o0", "__o1", "__o2", "__o3")
    gone = first_come(placed(stored(tried), starts_only=True), [F.col(f"__o{k}") for k in range(len(orders))], window, block_lines).where("kept").select("seq", F.lit(True).alias("__kept"))
    out = assessed.join(lost, "file_path", "left").join(gone, "seq", "left")
    kept = F.when(F.col("assessment_status") == "refuted", False).when(F.col("__lost").isNull(), True).otherwise(F.coalesce("__kept", F.lit(False)))
    return out.select(*assessed.columns, kept.alias("kept"))


def severity_line(findings: DataFrame, *by: str) -> DataFrame:
    """AGG-24: one line per group: how many findings, and the counts of the severities that occur, from the worst down."""
    counts = [F.count_if(F.col("severity") == s) for s in fixed.SEVERITIES]
    told = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {s.lower()}"))) for n, s in zip(counts, fixed.SEVERITIES, strict=True)]
    return findings.groupBy(*by).agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" finding(s): "), F.concat_ws(", ", *told)).alias("line"))
