"""Sources: files, recorded engine output, payloads, labels, baselines and logs as DataFrames (SRC-01..29)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.fixed import DEFAULT_EXCLUDES
from fathomline.functions.rules import first_cwe, preferred_owasp, rule_type
from fathomline.functions.scalars import component_excluded, lines_of, risk_reasons, risk_score
from fathomline.sources.shared import stored

MAX_BYTES = 512_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discover(spark: SparkSession, root: str, suffix: str = ".py", extra_excludes: tuple[str, ...] = (), max_bytes: int = MAX_BYTES) -> DataFrame:
    """SRC-01: path (below root), content, risk, reasons of the files that a scan takes.

    The size filter reaches the source, so larger files are never read; bytes
    that are not UTF-8 become replacement characters.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root).where(F.col("length") <= max_bytes)
    raw = raw.withColumn("path", F.substring_index("path", root.rstrip("/") + "/", -1))
    raw = raw.where(~component_excluded(F.col("path"), DEFAULT_EXCLUDES + tuple(extra_excludes)))
    files = raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")).where(F.trim("content") != "")
    return files.withColumn("risk", risk_score(F.col("content"))).withColumn("reasons", risk_reasons(F.col("content")))


def ignore_patterns(spark: SparkSession, path: str) -> list[str]:
    """SRC-02: the lines of an ignore file without comments, negations and trailing slashes."""
    rows = spark.read.text(path).select(F.rtrim(F.trim("value"), F.lit("/")).alias("p")).where("p <> '' and p not like '#%' and p not like '!%'")
    return [r["p"] for r in rows.distinct().collect()]  # the lines of one file that people write


def kept(rows: DataFrame) -> DataFrame:
    """`rows` written once in the shared folder, for plans that read them several times."""
    return stored(rows)


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents in the shape of discovered files: path, content."""
    return docs.select("doc_id", F.concat(F.lit("src/"), F.coalesce("source", F.lit("none")), F.lit("/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(".txt")).alias("path"), F.coalesce("text", F.lit("")).alias("content"), "lang", "source")


def numbered_lines(files: DataFrame) -> DataFrame:
    """PRJ-23: path, line (from 1), text."""
    return files.select(*[c for c in files.columns if c != "content"], F.posexplode(lines_of(F.col("content"))).alias("at", "text")).withColumn("line", F.col("at") + 1).drop("at")


def line_range(lines: DataFrame, wanted: DataFrame, most: int = 200) -> DataFrame:
    """SRC-07: lines of wanted (path, start_line, end_line), at most `most` of each request."""
    w = wanted.withColumn("last", F.least("end_line", F.col("start_line") + most - 1))
    return lines.join(w, "path").where("line between start_line and last").select("path", "start_line", "end_line", "line", "text")


def payload_findings(raw: DataFrame) -> DataFrame:
    """SRC-21: one row per finding of scan payloads (id, json), whichever of the known shapes a payload has.

    The first shape that is there wins: a job's result, findings,
    vulnerabilities, reports, raw_findings, results, SARIF runs, a bare array.
    """
    v = raw.select("id", F.try_parse_json("json").alias("v"))
    # a job wraps its payload
    v = v.withColumn("v", F.coalesce(F.try_variant_get("v", "$.result", "variant"), F.col("v")))

    def at(path: str):
        return F.try_variant_get("v", path, "array<variant>")

    def inner(path: str, name: str):
        return F.flatten(F.transform(F.filter(at(path), lambda x: F.try_variant_get(x, f"$.{name}", "array<variant>").isNotNull()), lambda x: F.try_variant_get(x, f"$.{name}", "array<variant>")))

    def full(c):
        return F.when(F.size(c) > 0, c)

    found = F.coalesce(at("$.findings"), at("$.vulnerabilities"), full(inner("$.reports", "vulnerabilities")), full(inner("$.results", "raw_findings")), at("$.results"), full(inner("$.runs", "results")), at("$"))
    return v.select("id", F.posexplode(found).alias("place", "finding"))


def engine_findings(results: DataFrame) -> DataFrame:
    """SRC-08, PRJ-11: recorded rule-engine results as findings; results that no type stands for are left out.

    results: check_id, path, start.line, end.line, extra (severity, message, fix,
    metadata: cwe, owasp and references as arrays, impact).
    """
    first = F.upper(F.coalesce("extra.severity", F.lit("WARNING")))
    kind = rule_type(first_cwe(F.col("extra.metadata.cwe")), F.col("check_id"))
    r = results.withColumn("type", kind).where("type is not null")
    severity = F.coalesce(*[F.when(first == a, b) for a, b in fixed.RULE_SEVERITIES.items()], F.lit("MEDIUM"))
    severity = F.when((severity == "HIGH") & F.col("type").isin(*fixed.CRITICAL_TYPES), "CRITICAL").otherwise(severity)
    own = first_cwe(F.col("extra.metadata.cwe"))
    number = F.coalesce(*[F.when(F.col("type") == t, c) for t, c in fixed.CANONICAL_CWES.items()], own)
    start = F.coalesce("start.line", F.lit(0))
    blank = lambda c: F.trim(F.coalesce(c, F.lit("")))
    fix = blank(F.col("extra.fix"))
    return r.select(
        F.col("check_id").alias("rule_id"),
        F.coalesce("path", F.lit("")).alias("file_path"),
        start.alias("start_line"),
        F.coalesce("end.line", start).alias("end_line"),
        "type",
        severity.alias("severity"),
        F.coalesce(F.nullif(blank(F.col("extra.message")), F.lit("")), F.concat(F.lit("Rule "), "check_id", F.lit(" matched."))).alias("description"),
        F.coalesce(F.nullif("extra.metadata.impact", F.lit("")), F.lit("See rule documentation.")).alias("impact"),
        fix.alias("remediation"),
        F.when(number != "", F.concat(F.lit("CWE-"), number)).otherwise("").alias("cwe_id"),
        preferred_owasp(F.col("extra.metadata.owasp")).alias("owasp_category"),
        F.coalesce(*[F.when(severity == s, F.lit(v)) for s, v in fixed.SEVERITY_CVSS.items()]).alias("cvss_score"),
        F.coalesce("extra.metadata.references", F.array().cast("array<string>")).alias("references"),
        fix.alias("secure_code_example"),
        F.lit("SEMGREP").alias("source"),
        F.lit(fixed.CONFIDENCE["SEMGREP"]).alias("confidence"),
    )


def engine_errors(document: DataFrame) -> DataFrame:
    """SRC-09: engine errors by file; errors of no file are under the empty path."""
    e = document.select(F.explode("errors").alias("e"))
    where = F.coalesce("e.path", F.element_at("e.spans", 1)["file"], "e.location.path", F.lit(""))
    return e.select(where.alias("file_path"), F.col("e.message").alias("message"), F.col("e.type").alias("type"))


def label_rows(document: DataFrame) -> DataFrame:
    """SRC-20: the labels of a label file, CWE prefixes stripped."""
    rows = document.select("name", F.posexplode("labels").alias("l", "x"))
    return rows.select("name", F.col("l").cast("long").alias("l"), F.col("x.file").alias("file"), F.coalesce("x.line", F.lit(0)).alias("line"), F.regexp_replace("x.cwe", "(?i)^CWE-", "").alias("cwe"), F.col("x.type").alias("type"), F.col("x.note").alias("note"))


def baseline_rows(document: DataFrame) -> DataFrame:
    """SRC-23: the fingerprints of a baseline of version 1; any other version counts as empty."""
    rows = document.where("version = 1").select(F.explode("fingerprints").alias("fingerprint", "x"))
    return rows.select("fingerprint", "x.*")


def jobs_at_start(jobs: DataFrame) -> DataFrame:
    """SRC-25: jobs found unfinished when the store opens have failed."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "queued"), "failed").otherwise(F.col("status")))


def audit_records(log: DataFrame, kind: str) -> DataFrame:
    """SRC-27: the data of one kind of audit line."""
    return log.where(F.col("record_type") == kind).select("data")
