"""Registered queries over reports, labels and code, each over whole tables, with their SQL.

Documents stand in for source files as in `queries`; for operators over syntax
trees each document becomes a Python file by a fixed rule: one statement per
line, chosen by the line's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.rules import preferred_owasp, reliable, rule_type, source_label
from fathomline.functions.scalars import types_agree
from fathomline.operators import assembly, chains, code, evaluation, evidence, reports
from fathomline.plans.queries import _FILES, _FINDINGS, _LINES, _RANK, MODEL, RULES, _kept, files, findings, printable, printed
from fathomline.sources import cache, recorded, tables
from fathomline.sources.syntax import syntax_rows
from fathomline.sources.tables import table

#: What a line of a length modulo their number becomes, and the rule that finds it.
STATEMENTS = (
    ("eval(p)", "python-insecure-eval"),
    ("subprocess.run(p, shell=True)", "python-insecure-subprocess-shell"),
    ('cur.execute("select " + p)', "python-sql-injection"),
    ("render_template_string(p)", "python-flask-render-template-string"),
    ("open(p)", "python-path-traversal-open"),
    ("pickle.loads(p)", "python-insecure-deserialization"),
    ("conn.search_s(p)", "python-ldap-injection"),
    ("etree.XPath(p)", "python-xpath-injection"),
    ("xml.sax.parse(p)", "python-xml-external-entity"),
    ("random.random()", "python-insecure-randomness"),
    ("hashlib.md5(p)", "python-weak-hashing"),
    ("redirect(p)", "python-open-redirect"),
    ('resp.set_cookie("k", p)', "python-insecure-cookie"),
    ("requests.get(p)", "python-ssrf-requests"),
    ("print(p)", None),
    ("p = q", None),
)


def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a function `work` of a statement for each line, and two that call it in turn."""
    texts = F.array(*[F.lit(f"    {s}") for s, _ in STATEMENTS])
    body = F.transform(F.split("content", "\n"), lambda x: F.get(texts, F.pmod(F.length(x), F.lit(len(STATEMENTS)))))
    tail = "\ndef outer(a, b):\n    work(a, b)\n\ndef far(c, d):\n    outer(c, d)\n"
    return files(spark, sf_dir).select(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(F.lit("def work(p, q):\n"), F.array_join(body, "\n"), F.lit("\n" + tail)).alias("content"))


def _code(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.kept(syntax_rows(python_files(spark, sf_dir)))
    return rows, code.rule_hits(code.resolved_calls(rows))


def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 14 pinned rules over the documents' Python files."""
    return _code(spark, sf_dir)[1].groupBy("rule_id", "severity", "cwe").agg(F.count(F.lit(1)).alias("hits"), F.sum("line").alias("lines"))


def wrapper_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions that pass a parameter on to a dangerous call, directly or through others (DF-04)."""
    return code.wrappers(*_code(spark, sf_dir)).groupBy("function").agg(F.count(F.lit(1)).alias("files"))


def sink_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward slices from every rule hit (DF-05..07), by how many lines they have."""
    rows, hits = _code(spark, sf_dir)
    slices = code.backward_slices(rows, hits)
    return slices.groupBy("path", "sink_line").agg(F.count(F.lit(1)).alias("lines")).groupBy("lines").agg(F.count(F.lit(1)).alias("slices"))


def rule_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as rule ids without CWE metadata: the type that their words stand for (PRJ-10)."""
    c = table(spark, sf_dir, "conversations")
    return c.groupBy(rule_type(F.lit(""), F.col("text")).alias("type")).agg(F.count(F.lit(1)).alias("n"))


def rule_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OWASP entries and source labels of events as rules list them (PRJ-09, PRJ-13)."""
    e = table(spark, sf_dir, "events")
    year = F.when(F.col("event_id") % 3 == 0, "2017").when(F.col("event_id") % 3 == 1, "2021").otherwise("2025")
    entries = F.array(F.concat(F.lit("A1:"), year, F.lit(" - "), F.col("event_type")), F.concat(F.lit("A0"), (F.col("user_id") % 9).cast("string"), F.lit(":"), F.when(F.col("user_id") % 2 == 0, "2021").otherwise("2017")))
    name = F.when(F.col("event_type") == "click", "Corroborated").when(F.col("event_type") == "view", "rule").when(F.col("event_type") == "signup", "LLM").otherwise(F.col("event_type"))
    return e.groupBy(preferred_owasp(entries).alias("owasp"), source_label(name).alias("source")).agg(F.count(F.lit(1)).alias("n"))


def reliable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings that stand without a model finding (FLT-02)."""
    f = findings(spark, sf_dir, RULES)
    sure = reliable(F.array("rule_id", F.when(F.col("start_line") % 5 == 0, "audit.rule")), F.col("severity"), F.col("cwe_id"), F.col("type"), F.col("context"), F.col("description"))
    return f.groupBy("type").agg(F.count_if(sure).alias("kept"), F.count(F.lit(1)).alias("total"))


def tier_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all files by status and tier states (JON-05), with how many are degraded (AGG-28)."""
    f, found = files(spark, sf_dir), findings(spark, sf_dir)
    counts = [found.where(F.col("source") == s).groupBy(F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n")) for s in ("SEMGREP", "LLM")]
    size = F.length("content")
    routed = f.where((size < 50) | (size % 3 != 0)).select("path", F.when(size < 50, "failed: too short").otherwise("ok").alias("outcome"))
    errors = f.where(F.contains("content", F.lit("###"))).select("path", F.lit("no parse").alias("message"))
    out = assembly.assemble(f, *counts, routed, errors)
    degraded = assembly.report_degraded(F.col("rules_state"), F.col("model_state"))
    return out.groupBy("status", "rules_state", "model_state").agg(F.count(F.lit(1)).alias("files"), F.sum("rules_found").alias("rules_found"), F.sum("model_found").alias("model_found"), F.count_if(degraded).alias("degraded"))


def scoped_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the files in scope, with the snippets that reports carry (FLT-07, PRJ-14)."""
    f = files(spark, sf_dir)
    kept = assembly.with_snippets(findings(spark, sf_dir).withColumn("end_line", F.col("start_line") + F.col("start_line") % 20), f.where("doc_id % 3 <> 0"))
    kept = kept.join(f.where("doc_id % 3 <> 0").select(F.col("path").alias("file_path")), "file_path", "left_semi")
    return kept.select("seq", F.md5("context").alias("context_md5"))


def _assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = tables.kept(findings(spark, sf_dir).drop("context", "description")).withColumn("confidence", F.when(F.col("source") == "LLM", 0.55).otherwise(0.9)).withColumn("corroborated", F.col("start_line") % 4 == 0).withColumn("has_taint", F.lit(False))
    said = F.when(F.col("start_line") % 3 == 0, "confirmed").when(F.col("start_line") % 3 == 1, "refuted")
    verdicts = f.where("source = 'LLM'").select("seq", said.alias("verdict"), F.when(F.col("start_line") % 8 == 0, "escaped").alias("control")).where("verdict is not null")
    return assembly.with_verdicts(f, verdicts)


def verdict_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by what verification made of them, with their summed confidence in hundredths."""
    return _assessed(spark, sf_dir).groupBy("type", "assessment_status").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("confidence"))


def verified_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings that stay after verification and the dedup behind it (RNK-03)."""
    return assembly.verified(_assessed(spark, sf_dir)).select("seq", "kept")


def severity_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.severity_line(findings(spark, sf_dir), "file_path")


def payload_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as payloads of three shapes, read back as detections (SRC-21, PRJ-29)."""
    f = findings(spark, sf_dir)
    flat = F.struct(F.struct(F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.concat(F.lit("CWE-"), "cwe_id", F.lit(": x")).alias("cwe"), "type", "source").alias("f"))
    nested = F.struct(F.struct(F.struct("file_path", "start_line").alias("location"), F.lit("other").alias("cwe_id"), F.col("type").alias("vulnerability_type"), "source").alias("f"))
    engine = F.struct(F.struct(F.col("file_path").alias("path"), F.struct(F.col("start_line").alias("line")).alias("start"), F.col("rule_id").alias("check_id"), F.struct(F.struct(F.array(F.concat(F.lit("CWE-"), "cwe_id")).alias("cwe")).alias("metadata")).alias("extra")).alias("f"))
    one = lambda s, key: F.concat(F.lit(f'{{"{key}":['), F.get_json_object(F.to_json(s), "$.f"), F.lit("]}"))
    shape = F.pmod(F.col("seq"), F.lit(3))
    raw = f.select(F.col("seq").alias("id"), F.when(shape == 0, one(flat, "findings")).when(shape == 1, one(nested, "vulnerabilities")).otherwise(one(engine, "results")).alias("json"))
    return evaluation.detections(tables.payload_findings(raw)).select("id", "d", "file", "line", "cwe", "type", "source")


def labelled_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as scans write them, brought to the labels' names (PRJ-30)."""
    f = files(spark, sf_dir)
    kind = F.pmod(F.col("doc_id"), F.lit(5))
    written = F.when(kind == 0, F.concat(F.lit("samples/"), "path")).when(kind == 1, F.concat(F.lit("/data/set/samples/"), "path")).when(kind == 2, F.concat(F.lit("/home/u/"), "path")).when(kind == 3, F.replace("path", F.lit("/"), F.lit("\\"))).otherwise(F.col("path"))
    return evaluation.label_paths(f.select("doc_id", written.alias("file")), f.where("doc_id % 3 <> 0").select(F.col("path").alias("file")), folder="/data/set").select("doc_id", "file")


def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule findings by language as scans, scored against model findings as labels (AGG-26)."""
    langs = files(spark, sf_dir).select(F.col("path").alias("file_path"), F.coalesce("lang", F.lit("none")).alias("lang"))
    # detected once: the two sides are read several times, and never their texts
    every = tables.kept(findings(spark, sf_dir).select("seq", "file_path", "start_line", "cwe_id", "type", "source", "rule_id"))
    found = every.where("source = 'SEMGREP'").join(langs, "file_path").select(F.col("lang").alias("id"), F.col("seq").alias("d"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("cwe_id").alias("cwe"), "type", "source")
    labels = every.where("source = 'LLM'").select(F.col("seq").alias("l"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("cwe_id").alias("cwe"), "type", F.col("rule_id").alias("note"))
    return evaluation.evaluate_scans(found, labels)


def connected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other files each file's text names (JON-12)."""
    pairs = chains.connected_files(files(spark, sf_dir).select("path", "content"))
    return pairs.groupBy("path").agg(F.count(F.lit(1)).alias("others"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content a recorded response is kept for (SRC-24)."""
    f = files(spark, sf_dir).select("doc_id", "path", "content")
    recorded = cache.keyed(f.where("doc_id % 2 = 0"), "1", "local").groupBy("key").agg(F.max("path").alias("response"))
    return cache.looked_up(f, recorded, "1", "local").select("doc_id", "response", "hit")


def agreeing_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of rule and model findings on one line whose types agree (FLT-15), by type."""
    a = findings(spark, sf_dir, RULES).select("file_path", "start_line", F.col("type").alias("rule_type"), F.col("cwe_id").alias("a"))
    b = findings(spark, sf_dir, MODEL).select("file_path", "start_line", F.col("type").alias("model_type"), F.col("cwe_id").alias("b"))
    both = a.join(b, ["file_path", "start_line"]).where(types_agree(F.col("rule_type"), F.col("model_type"), F.col("a"), F.col("b")))
    return both.groupBy("rule_type", "model_type").agg(F.count(F.lit(1)).alias("n"))


def _issued(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    shots = f.where("doc_id % 4 <> 1").select(F.lit("s1").alias("snapshot_id"), "path", F.sha2(F.when(F.col("doc_id") % 5 == 2, F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("sha256"))
    found = findings(spark, sf_dir)
    said = F.when(F.col("seq") % 7 == 0, "else")
    requests = found.select(F.col("seq").alias("request"), F.when(F.col("seq") % 11 == 0, "s0").otherwise("s1").alias("snapshot_id"), F.col("file_path").alias("path"), "start_line", (F.col("start_line") + F.col("seq") % 3).cast("int").alias("end_line"), said.alias("content"))
    return evidence.issue(requests, shots, f.select("path", "content"))


def issued_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence issued for findings' lines against a snapshot of some of the files (JON-20)."""
    return _issued(spark, sf_dir).select("request", "state", "excerpt_hash")


def assessed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on findings under the evidence policy (FLT-09), by status and notes."""
    proof = tables.kept(_issued(spark, sf_dir).withColumn("evidence_id", F.concat(F.lit("e"), F.col("request").cast("string"))))
    step = lambda kind, line: F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("string").alias("file"), line.cast("int").alias("line"), F.concat(F.lit("e"), F.col("seq").cast("string")).alias("evidence_id"))
    path = F.when(F.col("seq") % 4 == 0, F.array(step("source", F.col("start_line")), step("sink", F.col("start_line")))).when(F.col("seq") % 4 == 1, F.array(step("source", F.col("start_line") + 5)))
    verdict = F.when(F.col("seq") % 2 == 0, "supported").when(F.col("seq") % 3 == 0, "refuted").otherwise("unsure")
    asked = findings(spark, sf_dir).select(F.col("seq").alias("finding_id"), "type", F.lit("s1").alias("snapshot_id"), verdict.alias("verdict"), F.array(F.concat(F.lit("e"), F.col("seq").cast("string"))).alias("evidence_ids"), F.when(F.col("seq") % 9 == 0, "escaped").alias("control"), F.lit(None).cast("string").alias("control_evidence_id"), path.alias("taint_path"))
    out = evidence.assess(asked, proof, proof.select("snapshot_id"))
    return out.groupBy("status", F.array_join("notes", "; ").alias("notes")).agg(F.count(F.lit(1)).alias("n"))


def taint_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severe findings of a file as the steps of one path, with their kinds and code (PRJ-21, PRJ-48)."""
    f = findings(spark, sf_dir).where("severity in ('CRITICAL', 'HIGH')")
    steps = f.select(F.col("file_path").alias("seq"), F.col("seq").alias("pos"), F.when(F.col("start_line") % 6 == 0, "Propagator").alias("kind"), F.lit("").alias("file"), F.col("start_line").alias("line"), F.col("file_path").alias("default_file"))
    out = evidence.enriched_taint(steps, tables.numbered_lines(files(spark, sf_dir)).select("path", "line", "text"))
    return out.select("seq", "pos", "kind", "file", F.md5("code").alias("code_md5"))


def changed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a recorded name-status listing (SRC-13)."""
    k, tab = F.pmod(F.col("doc_id"), F.lit(5)), F.lit("\t")
    line = F.when(k == 0, F.concat(F.lit("M"), tab, "path")).when(k == 1, F.concat(F.lit("D"), tab, "path")).when(k == 2, F.concat(F.lit("R090"), tab, "path", tab, F.lit("new/"), "path")).when(k == 3, F.concat(F.lit("?? "), "path")).otherwise(F.concat(F.lit("A"), tab, F.lit("./"), "path"))
    return recorded.changed_files(files(spark, sf_dir).select(line.alias("value")), ".txt")


def confined_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which written paths stay below their root (SRC-05)."""
    k = F.pmod(F.col("doc_id"), F.lit(4))
    written = F.when(k == 0, F.concat(F.lit("a/../../"), "path")).when(k == 1, F.concat(F.lit("/"), "path")).when(k == 2, F.concat(F.lit("a/../"), "path")).otherwise(F.col("path"))
    return files(spark, sf_dir).select("doc_id", recorded.confined(written).alias("inside"))


def foreign_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state of jobs that others have written (SRC-26): users as jobs, of which the even ones are known."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("updated_at"), F.col("event_type").alias("status"))
    return recorded.new_jobs(e, e.where("id % 2 = 0").select("id").distinct())


def outer_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the documents' Python files define a function of a name (RNK-11)."""
    sources = python_files(spark, sf_dir)
    out = evidence.definitions(syntax_rows(sources), tables.numbered_lines(sources), "outer")
    return out.select("path", "line", "end_line", F.md5("source").alias("source_md5"))


def first_sink_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten slices of each of the documents' Python files (RNK-08)."""
    rows, hits = _code(spark, sf_dir)
    return evidence.first_slices(code.backward_slices(rows, hits)).groupBy("path").agg(F.count(F.lit(1)).alias("slices"), F.max("sink_line").alias("last"))


def engine_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a rule engine records them, read back as findings (SRC-08, PRJ-11)."""
    f = findings(spark, sf_dir)
    k = F.pmod(F.col("seq"), F.lit(4))
    check = F.when(k == 0, F.concat(F.lit("a.b.tainted-sql-"), "rule_id")).when(k == 1, F.lit("python-weak-hashing")).when(k == 2, F.concat(F.lit("x."), "rule_id")).otherwise(F.lit("py.some-cookie"))
    extra = F.struct(
        F.when(F.col("severity").isin("CRITICAL", "HIGH"), "ERROR").when(F.col("severity") == "MEDIUM", "warning").when(F.col("severity") == "LOW", "INFO").alias("severity"),
        F.when(k == 0, " ").otherwise(F.col("description")).alias("message"), F.when(k == 1, " use x ").alias("fix"),
        F.struct(F.when(k == 2, F.array(F.lit("none"), F.concat(F.lit("CWE-"), "cwe_id", F.lit(": y")))).alias("cwe"), F.array(F.lit("A1:2017"), F.lit("A03:2021")).alias("owasp"), F.lit(None).cast("array<string>").alias("references"), F.lit("").alias("impact")).alias("metadata"),
    )
    r = f.select(check.alias("check_id"), F.col("file_path").alias("path"), F.struct(F.col("start_line").alias("line")).alias("start"), F.struct(F.when(k == 3, F.col("start_line") + 1).alias("line")).alias("end"), extra.alias("extra"))
    out = tables.engine_findings(r)
    return out.groupBy("type", "severity", "cwe_id", "cvss_score", "description", "remediation", "owasp_category").agg(F.count(F.lit(1)).alias("n"), F.sum("end_line").alias("ends"))


def _view(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).withColumn("confidence", F.when(F.col("start_line") % 2 == 0, "high").otherwise("0.123")).withColumn("impact", F.when(F.col("start_line") % 3 == 0, "loss").otherwise(""))
    return reports.finding_view(f, "src")


def finding_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings as a scan's output shows them (PRJ-50)."""
    return _view(spark, sf_dir).select("seq", "cwe", "file", "confidence", "source", "impact", F.md5("snippet").alias("snippet_md5"))


def job_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language a scan's counts by severity and source, and its files' risk (AGG-22)."""
    f = files(spark, sf_dir).select((F.substring_index("path", "/", -2)).alias("file"), F.coalesce("lang", F.lit("none")).alias("lang"), F.length("content").alias("size"))
    view = _view(spark, sf_dir).join(f.select("file", "lang"), "file")
    out = reports.job_payload(view, f.select("lang", (F.col("size") % 8 / 4).alias("risk_score")), "lang")
    told = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return out.select("lang", "files", "risk_score", told("counts").alias("counts"), told("sources").alias("sources"))


def scan_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files as scans: which results cannot be relied on, and why (FLT-10)."""
    f = files(spark, sf_dir).select(F.length("content").alias("n"), "content")
    status = F.when(F.col("n") < 50, "failed").when(F.col("n") % 7 == 0, "partial").when(F.col("n") % 11 == 0, "odd").otherwise("completed")
    states = F.array(F.lit("completed"), F.when(F.col("n") % 13 == 0, "degraded").otherwise("completed"))
    why = reports.failed_or_degraded(status, F.col("n") % 5 == 0, F.contains("content", F.lit("###")), F.when(F.col("n") % 17 == 0, "e"), states)
    return f.groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("files"))


QUERIES = {f.__name__: printable(f) for f in (rule_hits, wrapper_functions, sink_slices, rule_types, rule_metadata, reliable_rules, tier_assembly, scoped_findings, verdict_states, verified_findings, severity_lines, payload_detections, labelled_paths, scan_scores, connected_files, cache_hits, agreeing_pairs, issued_evidence, assessed_findings, taint_code, changed_paths, confined_paths, foreign_jobs, outer_definitions, first_sink_slices, engine_results, finding_views, job_payloads, scan_states)}

_N = len(STATEMENTS)
_CODE = _LINES + f", code AS (SELECT path, line, length(text) % {_N} AS k FROM lines)"
_RULES = ", ".join(f"({k}, '{r}', '{s}', '{c}')" for k, (_, r) in enumerate(STATEMENTS) if r for s, c in [next((s, c) for n, s, c in [*[(n, s, c) for n, s, c, _ in code.CALL_RULES], ("python-insecure-subprocess-shell", "ERROR", "78"), ("python-sql-injection", "ERROR", "89"), ("python-path-traversal-open", "WARNING", "22"), ("python-ldap-injection", "ERROR", "90"), ("python-xpath-injection", "ERROR", "643"), ("python-insecure-cookie", "WARNING", "614")] if n == r)])
_NO_P, _CLEAN, _REBIND = 9, 14, 15


def _words(text: str) -> str:
    return " ".join(f"WHEN contains({text}, '{w}') THEN '{t}'" for w, t in fixed.RULE_WORDS)


_AGREE = " OR ".join(f"(a.type IN ({q}) AND b.type IN ({q}))" for g in fixed.TYPE_ALIASES if (q := ", ".join(f"'{t}'" for t in g)))
_STATUS = "CASE WHEN verdict IS NULL THEN NULL WHEN verdict = 'confirmed' THEN 'supported' WHEN verdict = 'refuted' AND (start_line % 4 <> 0 OR start_line % 8 = 0) THEN 'refuted' ELSE 'uncertain' END"
_SNIPPET = "trim(array_to_string(list_slice(string_split(content, chr(10)), start_line, greatest(start_line, least(start_line + start_line % 20, start_line + 12))), chr(10)), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"

_FILE_LINES = "len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END"
_ISSUED = f"""{_FINDINGS}, asked AS (SELECT f.*, content, files.doc_id AS doc, CAST(start_line + seq % 3 AS INTEGER) AS last FROM findings f JOIN files ON file_path = path),
issued AS (SELECT *, CASE WHEN seq % 11 = 0 THEN 'no snapshot' WHEN doc % 4 = 1 THEN 'not in snapshot' WHEN doc % 5 = 2 THEN 'changed' WHEN last > {_FILE_LINES} THEN 'out of range' WHEN seq % 7 = 0 THEN 'fabricated' ELSE 'valid' END AS state FROM asked)"""
_TAINTED = "(contains(lower(type), 'sql') OR contains(lower(type), 'command') OR contains(lower(type), 'traversal') OR contains(lower(type), 'xss') OR contains(lower(type), 'code_injection') OR contains(lower(type), 'rce'))"

SQL = {
    "rule_hits": f"WITH {_CODE}, rules(k, rule_id, severity, cwe) AS (VALUES {_RULES}) SELECT rule_id, severity, cwe, count(*) AS hits, CAST(sum(line + 1) AS BIGINT) AS lines FROM code JOIN rules USING (k) GROUP BY ALL",
    "wrapper_functions": f"WITH {_CODE}, n AS (SELECT count(DISTINCT path) AS files FROM code WHERE k < {_CLEAN} AND k <> {_NO_P}) SELECT unnest(['work', 'outer', 'far']) AS function, files FROM n WHERE files > 0",
    "sink_slices": f"WITH {_CODE}, s AS (SELECT k, coalesce(max(CASE WHEN k = {_REBIND} THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bound FROM code) SELECT lines, count(*) AS slices FROM (SELECT CAST(CASE WHEN k = {_NO_P} THEN 1 ELSE 2 + bound END AS BIGINT) AS lines FROM s WHERE k < {_CLEAN}) GROUP BY lines",
    "rule_types": f"WITH c AS (SELECT lower(text) AS t, lower(string_split(text, '.')[-1]) AS tail FROM conversations) SELECT coalesce(CASE {_words('tail')} END, CASE {_words('t')} END) AS type, count(*) AS n FROM c GROUP BY 1",
    "rule_metadata": "WITH e AS (SELECT event_type, 'A1:' || CASE event_id % 3 WHEN 0 THEN '2017' WHEN 1 THEN '2021' ELSE '2025' END || ' - ' || event_type AS x, 'A0' || user_id % 9 || ':' || CASE WHEN user_id % 2 = 0 THEN '2021' ELSE '2017' END AS y FROM events) SELECT CASE WHEN contains(y, '2021') THEN y ELSE x END AS owasp, CASE event_type WHEN 'click' THEN 'confirmed' WHEN 'view' THEN 'rule-only' WHEN 'signup' THEN 'llm-only' ELSE event_type END AS source, count(*) AS n FROM e GROUP BY ALL",
    "reliable_rules": f"WITH {_FINDINGS} SELECT type, count(*) FILTER ({_RANK} <= 1 AND cwe_id NOT IN ('22', '23', '35', '36', '73') AND start_line % 5 <> 0 AND NOT contains(lower(context), 'os.path.join')) AS kept, count(*) AS total FROM findings WHERE source = 'SEMGREP' GROUP BY type",
    "tier_assembly": f"WITH {_FINDINGS}, n AS (SELECT file_path AS path, count(*) FILTER (source = 'SEMGREP') AS r, count(*) FILTER (source = 'LLM') AS m FROM findings GROUP BY 1), s AS (SELECT path, CASE WHEN length(content) < 50 THEN 'failed' WHEN length(content) % 3 <> 0 THEN 'ok' ELSE 'not_routed' END AS model_state, contains(content, '###') AS broken FROM files), t AS (SELECT *, CASE WHEN NOT broken THEN 'ok' WHEN model_state = 'ok' THEN 'syntax_skipped' ELSE 'parse_error' END AS rules_state FROM s) SELECT CASE WHEN rules_state = 'parse_error' OR model_state = 'failed' THEN 'failed' WHEN model_state = 'not_routed' THEN 'partial' ELSE 'completed' END AS status, rules_state, model_state, count(*) AS files, CAST(sum(coalesce(r, 0)) AS BIGINT) AS rules_found, CAST(sum(coalesce(m, 0)) AS BIGINT) AS model_found, count(*) FILTER (rules_state = 'parse_error' OR model_state = 'failed') AS degraded FROM t LEFT JOIN n USING (path) GROUP BY ALL",
    "scoped_findings": f"WITH {_FINDINGS} SELECT seq, md5({_SNIPPET}) AS context_md5 FROM findings JOIN files ON file_path = path WHERE files.doc_id % 3 <> 0",
    "verdict_states": f"WITH {_FINDINGS}, v AS (SELECT *, CASE WHEN findings.source <> 'LLM' OR start_line % 3 = 2 THEN NULL WHEN start_line % 3 = 0 THEN 'confirmed' ELSE 'refuted' END AS verdict FROM findings), s AS (SELECT type, source, {_STATUS} AS assessment_status FROM v) SELECT type, assessment_status, count(*) AS n, CAST(sum(CASE WHEN assessment_status = 'supported' THEN 98 WHEN source = 'LLM' THEN 55 ELSE 90 END) AS BIGINT) AS confidence FROM s GROUP BY ALL",
    "verified_findings": f"WITH {_FINDINGS}, v AS (SELECT *, CASE WHEN findings.source <> 'LLM' OR start_line % 3 = 2 THEN NULL WHEN start_line % 3 = 0 THEN 'confirmed' ELSE 'refuted' END AS verdict FROM findings), s AS (SELECT *, coalesce({_STATUS}, '') AS status FROM v), lost AS (SELECT DISTINCT file_path FROM s WHERE status = 'refuted'), tried AS (SELECT file_path, list_sort(list({{'o': CASE WHEN status = 'supported' OR start_line % 4 = 0 THEN 0 ELSE 1 END, 'c': CASE WHEN status = 'supported' THEN -98 WHEN source = 'LLM' THEN -55 ELSE -90 END, 'a': {_RANK}, 'seq': seq, 'line': start_line, 'type': type, 'cwe': cwe_id}})) AS found FROM s WHERE status <> 'refuted' AND file_path IN (FROM lost) GROUP BY file_path), k AS (SELECT unnest({_kept('found')}) AS x FROM tried) SELECT seq, CASE WHEN status = 'refuted' THEN false WHEN file_path NOT IN (FROM lost) THEN true ELSE seq IN (SELECT x.seq FROM k) END AS kept FROM s",
    "severity_lines": f"WITH {_FINDINGS} SELECT file_path, count(*) || ' finding(s): ' || concat_ws(', ', {', '.join(f'''CASE WHEN count(*) FILTER (severity = '{s}') > 0 THEN count(*) FILTER (severity = '{s}') || ' {s.lower()}' END''' for s in fixed.SEVERITIES)}) AS line FROM findings GROUP BY file_path",
    "payload_detections": f"WITH {_FINDINGS} SELECT seq AS id, CAST(0 AS BIGINT) AS d, file_path AS file, start_line AS line, CASE WHEN seq % 3 = 1 THEN coalesce(CASE {' '.join(f'''WHEN contains(type, '{t}') THEN '{c}' ''' for t, c in fixed.TYPE_CWES)} END, 'OTHER') ELSE cwe_id END AS cwe, CASE WHEN seq % 3 = 2 THEN rule_id ELSE type END AS type, CASE WHEN seq % 3 = 2 THEN '' ELSE source END AS source FROM findings",
    "labelled_paths": f"WITH {_FILES} SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN path WHEN doc_id % 5 = 1 THEN '/data/set/samples/' || path WHEN doc_id % 5 = 2 THEN '/home/u/' || path ELSE path END AS file FROM files",
    "connected_files": f"WITH {_FILES} SELECT a.path, count(*) AS others FROM files a JOIN files b ON a.path <> b.path AND contains(a.content, CAST(b.doc_id AS VARCHAR)) GROUP BY a.path",
    "cache_hits": f"WITH {_FILES}, r AS (SELECT content, max(path) AS response FROM files WHERE doc_id % 2 = 0 GROUP BY content) SELECT doc_id, response, response IS NOT NULL AS hit FROM files LEFT JOIN r USING (content)",
    "issued_evidence": f"WITH {_ISSUED} SELECT seq AS request, state, CASE WHEN state = 'valid' THEN sha256(array_to_string(list_slice(string_split(content, chr(10)), start_line, last), chr(10))) END AS excerpt_hash FROM issued",
    "assessed_findings": f"""WITH {_ISSUED}, v AS (SELECT *, CASE WHEN seq % 2 = 0 THEN 'supported' WHEN seq % 3 = 0 THEN 'refuted' ELSE 'uncertain' END AS verdict FROM issued),
n AS (SELECT verdict, concat_ws('; ', CASE WHEN verdict = 'refuted' AND seq % 9 <> 0 THEN 'no mitigating control' END, CASE WHEN verdict <> 'uncertain' AND state <> 'valid' THEN 'unsound evidence cited' END, CASE WHEN verdict = 'supported' AND {_TAINTED} AND seq % 4 = 2 THEN 'no taint path' END,
CASE WHEN verdict = 'supported' AND seq % 4 = 0 AND state <> 'valid' THEN 'step on unsound evidence; step on unsound evidence' END) AS notes FROM v)
SELECT CASE WHEN notes = '' THEN verdict ELSE 'uncertain' END AS status, notes, count(*) AS n FROM n GROUP BY ALL""",
    "taint_code": f"WITH {_FINDINGS}, s AS (SELECT file_path AS d, seq, file_path, start_line, CASE WHEN start_line % 6 = 0 THEN 'propagation' WHEN seq = max(seq) OVER w AND seq <> min(seq) OVER w THEN 'sink' WHEN seq = min(seq) OVER w THEN 'source' ELSE 'propagation' END AS kind FROM findings WHERE severity IN ('CRITICAL', 'HIGH') WINDOW w AS (PARTITION BY file_path)) SELECT d AS seq, seq AS pos, kind, file_path AS file, md5(string_agg(CASE WHEN line = start_line THEN '> ' ELSE '  ' END || line || ': ' || text, chr(10) ORDER BY line)) AS code_md5 FROM s JOIN lines ON path = file_path AND line BETWEEN start_line - 2 AND start_line + 2 GROUP BY ALL",
    "changed_paths": f"WITH {_FILES} SELECT CASE WHEN doc_id % 5 = 2 THEN 'new/' || path ELSE path END AS path FROM files WHERE doc_id % 5 <> 1",
    "confined_paths": f"WITH {_FILES} SELECT doc_id, doc_id % 4 IN (2, 3) AS inside FROM files",
    "foreign_jobs": "SELECT user_id AS id, max(event_id) AS updated_at, arg_max(event_type, event_id) AS status FROM events WHERE user_id % 2 <> 0 GROUP BY user_id",
    "outer_definitions": f"WITH {_FILES} SELECT 'src/m' || doc_id || '.py' AS path, CAST(len(string_split(content, chr(10))) + 3 AS INTEGER) AS line, CAST(len(string_split(content, chr(10))) + 4 AS INTEGER) AS end_line, md5('def outer(a, b):' || chr(10) || '    work(a, b)') AS source_md5 FROM files",
    "first_sink_slices": f"WITH {_CODE}, s AS (SELECT path, line + 1 AS line FROM code WHERE k < {_CLEAN} QUALIFY row_number() OVER (PARTITION BY path ORDER BY line) <= 10) SELECT 'src/m' || replace(string_split(path, '/')[-1], '.txt', '.py') AS path, count(*) AS slices, CAST(max(line) AS INTEGER) AS last FROM s GROUP BY ALL",
    "finding_views": f"WITH {_FINDINGS} SELECT seq, 'CWE-' || cwe_id AS cwe, substr(file_path, 5) AS file, CASE WHEN start_line % 2 = 0 THEN 0.9::DOUBLE ELSE 0.12::DOUBLE END AS confidence, CASE source WHEN 'LLM' THEN 'llm-only' ELSE 'rule-only' END AS source, CASE WHEN start_line % 3 = 0 THEN 'loss' END AS impact, md5(context) AS snippet_md5 FROM findings",
    "job_payloads": f"""WITH {_FINDINGS}, l AS (SELECT coalesce(lang, 'none') AS lang, count(*) AS files, CAST(sum(length(content) % 8 / 4) AS DOUBLE) AS risk_score FROM files GROUP BY 1),
c AS (SELECT coalesce(lang, 'none') AS lang, severity AS k, count(*) AS n FROM findings GROUP BY 1, 2), s AS (SELECT coalesce(lang, 'none') AS lang, CASE source WHEN 'LLM' THEN 'llm-only' ELSE 'rule-only' END AS k, count(*) AS n FROM findings GROUP BY 1, 2)
SELECT lang, files, risk_score, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM c WHERE c.lang = l.lang) AS counts, (SELECT string_agg(k || '=' || n, ',' ORDER BY k) FROM s WHERE s.lang = l.lang) AS sources FROM l""",
    "scan_states": f"WITH {_FILES}, n AS (SELECT length(content) AS n, content FROM files) SELECT CASE WHEN contains(content, '###') THEN 'engine failure' WHEN n % 17 = 0 THEN 'rule error: e' WHEN n < 50 THEN 'failed with status failed' WHEN n % 7 = 0 THEN 'incomplete with status partial' WHEN n % 5 = 0 THEN 'degraded coverage' WHEN n % 11 = 0 THEN 'incomplete with status odd' WHEN n % 13 = 0 THEN 'a report is degraded' END AS reason, count(*) AS files FROM n GROUP BY 1",
    "engine_results": f"""WITH {_FINDINGS}, t AS (SELECT seq % 4 AS k, CASE seq % 4 WHEN 0 THEN 'a.b.tainted-sql-' || rule_id WHEN 1 THEN 'python-weak-hashing' WHEN 2 THEN 'x.' || rule_id ELSE 'py.some-cookie' END AS check_id, *, CASE seq % 4 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'USE_OF_WEAK_HASHING_ALGORITHM' WHEN 3 THEN 'SECURE_COOKIE' ELSE CASE cwe_id {' '.join(f"WHEN '{c}' THEN '{t}'" for c, t in fixed.CWE_TYPES.items())} END END AS kind FROM findings),
s AS (SELECT *, CASE WHEN {_RANK} <= 1 THEN CASE WHEN kind IN {fixed.CRITICAL_TYPES} THEN 'CRITICAL' ELSE 'HIGH' END WHEN severity = 'LOW' THEN 'LOW' ELSE 'MEDIUM' END AS level FROM t WHERE kind IS NOT NULL)
SELECT kind AS type, level AS severity, 'CWE-' || coalesce(CASE kind {' '.join(f"WHEN '{t}' THEN '{c}'" for t, c in fixed.CANONICAL_CWES.items())} END, cwe_id) AS cwe_id, CASE level {' '.join(f"WHEN '{s}' THEN {v}::DOUBLE" for s, v in fixed.SEVERITY_CVSS.items())} END AS cvss_score, CASE WHEN k = 0 THEN 'Rule ' || check_id || ' matched.' ELSE description END AS description, CASE WHEN k = 1 THEN 'use x' ELSE '' END AS remediation, 'A03:2021' AS owasp_category, count(*) AS n, CAST(sum(start_line + CASE WHEN k = 3 THEN 1 ELSE 0 END) AS BIGINT) AS ends FROM s GROUP BY ALL""",
    "agreeing_pairs": f"WITH {_FINDINGS} SELECT a.type AS rule_type, b.type AS model_type, count(*) AS n FROM findings a JOIN findings b USING (file_path, start_line) WHERE a.source = 'SEMGREP' AND b.source = 'LLM' AND (a.type = b.type OR a.cwe_id = b.cwe_id OR {_AGREE}) GROUP BY ALL",
}

for _name, _keys in {"scoped_findings": ["seq"], "verified_findings": ["seq"], "payload_detections": ["id"], "issued_evidence": ["request"], "taint_code": ["pos"], "finding_views": ["seq"]}.items():
    SQL[_name] = printed(SQL[_name], *_keys)
