"""The registered queries of the findings plane, each over whole tables, with their SQL.

Documents stand in for source files: two sets of line detectors play the rule
tier and the model tier, so findings follow from the data and grow with it.
"""

from __future__ import annotations

import re
from decimal import Decimal
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.scalars import cache_key, coerce_confidence, coerce_cvss, fingerprint, normalize_cwe, risk_score, risk_signal_counts, severity_rank
from fathomline.operators import chains, fusion, policy, repair, reports, scoring
from fathomline.sources import sinks
from fathomline.sources.shared import stored
from fathomline.sources.tables import documents_as_files, numbered_lines, table
from fathomline.streaming import progress

#: (rule, pattern, type, severity, CWE) of the two tiers; patterns mean the same to both engines.
RULES = (
    (1, 'token = "', "HARDCODED_CREDENTIALS", "HIGH", "798"),
    (2, "[a-z0-9]@[a-z0-9]", "SENSITIVE_DATA_EXPOSURE", "MEDIUM", "200"),
    (3, "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", "SECURITY_MISCONFIGURATION", "LOW", "16"),
    (4, "!!", "CODE_INJECTION", "MEDIUM", "94"),
    (5, "###", "SQL_INJECTION", "CRITICAL", "89"),
    (6, "[|]", "PATH_TRAVERSAL", "LOW", "22"),
)
MODEL = (
    (51, "[*][*][*]", "INJECTION", "HIGH", "564"),
    (52, "[0-9]{3}", "EXPOSED_SECRET", "MEDIUM", "259"),
    (53, "[A-Z]{6}", "CODE_INJECTION", "LOW", "95"),
    (54, "@", "EXCESSIVE_DATA_EXPOSURE", "HIGH", "359"),
    (55, "[Ll]icense", "INFORMATION_EXPOSURE_THROUGH_QUERY_STRING", "INFO", "200"),
)


#: Places of a document, the stand-in for a null doc_id (below every long), and the columns that hold keys.
PLACES, NULL_ID = 10**16, Decimal(-93 * 10**17)
KEYS = ("seq", "merged_seq", "d", "l", "a", "b", "id", "request", "pos", "first")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_files(table(spark, sf_dir, "documents"))


def place(within: Column) -> Column:
    """A number that orders by doc_id (null first), then by a place within the document below 10**16, and is no other place's."""
    doc = F.coalesce(F.col("doc_id").cast("decimal(19,0)"), F.lit(NULL_ID).cast("decimal(19,0)"))
    return (doc * F.lit(Decimal(PLACES)) + within).cast("decimal(38,0)")


def printable(query):
    """The query with its keys as text, which every reader takes alike."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = query(spark, sf_dir)
        return out.select(*[F.col(c).cast("string").alias(c) if c in KEYS and kind == "decimal(38,0)" else F.col(c) for c, kind in out.dtypes])

    return run


def printed(sql: str, *keys: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'CAST({k} AS VARCHAR) AS {k}' for k in keys)}) FROM ({sql})"


_PIECE = re.compile(r"\[([^\]^\\]+)\](\{\d+(?:,\d+)?\})?|([^\\.^$*+?{}()|\[\]])")


def needed(pattern: str) -> tuple[str, bool]:
    """The longest text that every match of a detector's pattern holds, and whether that text is all it asks for."""
    pieces = list(_PIECE.finditer(pattern))
    if "".join(p[0] for p in pieces) != pattern:
        return "", False
    # a sign that may be several ends a run
    fixed_signs = [p[3] or (p[1] if len(p[1]) == 1 and not p[2] else "\0") for p in pieces]
    run = max("".join(fixed_signs).split("\0"), key=len)
    return run, len(run) == len(pieces)


def holds(text: Column, pattern: str) -> Column:
    """Whether a detector's pattern is in a text; where it needs a fixed text, that is looked for as bytes first."""
    run, whole = needed(pattern)
    found = F.rlike(text, F.lit(pattern))
    return F.contains(text, F.lit(run)) if whole else F.contains(text, F.lit(run)) & found if run else found


def detect(lines: DataFrame, detectors=RULES + MODEL) -> DataFrame:
    """Findings of line detectors; seq orders them by document, line and detector."""
    one = [
        F.when(holds(F.col("text"), p), F.struct(F.lit(k).alias("rule"), F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(c).alias("cwe_id"), F.lit("LLM" if k > 50 else "SEMGREP").alias("source")))
        for k, p, t, s, c in detectors
    ]
    hits = lines.select("doc_id", "path", "line", "text", F.explode(F.array_compact(F.array(*one))).alias("d"))
    return hits.select(
        place(F.col("line") * 100 + F.col("d.rule")).alias("seq"),
        F.col("path").alias("file_path"), F.col("line").alias("start_line"), F.col("line").alias("end_line"), "d.type", "d.severity", "d.cwe_id", "d.source",
        F.concat(F.lit("rule-"), F.col("d.rule").cast("string")).alias("rule_id"), F.concat(F.col("d.type"), F.lit(" found")).alias("description"), F.col("text").alias("context"),
    )


def findings(spark: SparkSession, sf_dir: str, detectors=RULES + MODEL) -> DataFrame:
    return detect(numbered_lines(files(spark, sf_dir)), detectors)


_PLACE = f"CAST(coalesce(CAST(doc_id AS HUGEINT), {NULL_ID}) AS HUGEINT) * {PLACES}"
_FILES = "files AS (SELECT doc_id, 'src/' || coalesce(source, 'none') || '/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '.txt' AS path, coalesce(text, '') AS content, lang, source FROM documents)"
_LINES = _FILES + ", lines AS (SELECT doc_id, path, lang, source, unnest(string_split(content, chr(10))) AS text, unnest(generate_series(1, len(string_split(content, chr(10))))) AS line FROM files)"
_DETECTORS = ", ".join(f"({k}, '{p}', '{t}', '{s}', '{c}', '{'LLM' if k > 50 else 'SEMGREP'}')" for k, p, t, s, c in RULES + MODEL)
_FINDINGS = (
    _LINES
    + f", detectors(rule, pattern, type, severity, cwe_id, source) AS (VALUES {_DETECTORS}), findings AS (SELECT {_PLACE} + line * 100 + rule AS seq, path AS file_path, CAST(line AS INTEGER) AS start_line, CAST(line AS INTEGER) AS end_line, type, severity, cwe_id, detectors.source AS source, 'rule-' || rule AS rule_id, type || ' found' AS description, text AS context, lines.source AS origin, lang FROM lines, detectors WHERE regexp_matches(text, pattern))"
)
_SPACE = "[ \\t\\n\\x0B\\f\\r\\x{85}\\p{Z}]+"
_PRINT = f"substr(sha256(file_path || '|' || type || '|' || CASE WHEN trim(regexp_replace(context, '{_SPACE}', ' ', 'g')) = '' THEN 'L' || start_line ELSE trim(regexp_replace(context, '{_SPACE}', ' ', 'g')) END), 1, 16)"
_RANK = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 4 END"


def _re2(pattern: str) -> str:
    """A signal's pattern for RE2, with word boundaries by Unicode letters and digits."""
    out, k = "", 0
    while k < len(pattern):
        if pattern.startswith(r"\b", k):
            ahead = pattern[k + 2 : k + 3]
            out += r"(?:^|[^\p{L}\p{N}_])" if ahead.isalnum() else r"(?:$|[^\p{L}\p{N}_])"
            k += 2
        else:
            out += pattern[k]
            k += 1
    return "(?i)" + out.replace("'", "''")


_RISK = " + ".join(f"CASE WHEN regexp_matches(content, '{_re2(p)}') THEN {w} ELSE 0 END" for p, w, _ in fixed.RISK_SIGNALS)


def risk_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: files scored by risk, routed, and summed by language and source."""
    scored = files(spark, sf_dir).withColumn("risk", risk_score(F.col("content")))
    hits = findings(spark, sf_dir, RULES).select("file_path")
    routed = policy.route(scored.select("path", "lang", "source", "risk"), hits)
    return routed.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("files"), F.sum("risk").cast("long").alias("risk"), F.max("risk").alias("most"))


def risk_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = files(spark, sf_dir).agg(*risk_signal_counts(F.col("content")))
    return counts.unpivot([], counts.columns, "signal", "files").where("files > 0")


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    return f.select("seq", fingerprint(F.col("file_path"), F.col("type"), F.col("context"), F.col("start_line")).alias("fingerprint"), normalize_cwe(F.col("cwe_id")).alias("cwe"), severity_rank(F.col("severity")).alias("rank"))


def severity_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    # files with two findings of a source and more stand in for its chains
    chains = f.groupBy("source", "file_path").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("source").agg(F.count(F.lit(1)).alias("chains"))
    return reports.severity_summary(f, "source", chains=chains)


def provenance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by tier, with the tier that has none and the total (AGG-03)."""
    return reports.provenance(findings(spark, sf_dir))


def top_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top_types(findings(spark, sf_dir), 5)


def tier_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.deduplicate(findings(spark, sf_dir, RULES).drop("source")).select("seq", "file_path", "type", "severity", "start_line")


def two_tier_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.fuse(findings(spark, sf_dir, RULES).drop("source"), findings(spark, sf_dir, MODEL).drop("source"))
    return out.select("seq", "file_path", "type", "severity", "cwe_id", "start_line", "source", "confidence", "corroborated", "merged_seq", "fingerprint")


def overlap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = findings(spark, sf_dir).withColumn("end_line", F.col("start_line") + F.col("start_line") % 4)
    out = fusion.overlap_merged(spans)
    return out.select("file_path", "type", "start_line", "end_line", "seq", F.array_join("merged_rule_ids", ",").alias("rules"))


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    # licence lines stand in for markers: the named kind for a typed directive, others for foreign markers and whole files
    return policy.directives(files(spark, sf_dir).select("path", "content"), r"(?i)Apache (L)icense", r"(?i)CC BY-NC", r"(?i)MIT License")


def suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir)
    kept = policy.unsuppressed(f, _marks(spark, sf_dir).withColumn("types", F.when(F.col("types").isNotNull(), F.array(F.lit("EXPOSED_SECRET"), F.lit("SECURITY_MISCONFIGURATION")))))
    return kept.groupBy("type").agg(F.count(F.lit(1)).alias("kept"))


def _printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark, sf_dir).withColumn("fingerprint", fingerprint(F.col("file_path"), F.col("type"), F.col("context"), F.col("start_line")))


def baseline_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _printed(spark, sf_dir)
    old = f.where("start_line % 2 = 0").select("fingerprint")
    return policy.partition_by_baseline(f, old).groupBy("type", "is_new").agg(F.count(F.lit(1)).alias("n"))


def fix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _printed(spark, sf_dir)
    return policy.fix_check(f.where("start_line % 3 <> 0"), f.where("start_line % 2 = 0")).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


def build_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = policy.gate(findings(spark, sf_dir), "HIGH", confirmed_only=True)
    return out.groupBy("severity", "source").agg(F.count(F.lit(1)).alias("blocking"))


def _detections(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # detected once: scoring reads both sides several times, and never their texts
    found = stored(findings(spark, sf_dir).select("seq", "file_path", "start_line", "cwe_id", "type", "source", "rule_id"))
    d = found.where("source = 'SEMGREP'").select(F.col("seq").alias("d"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("cwe_id").alias("cwe"), "type", "source")
    y = found.where("source = 'LLM'").select(F.col("seq").alias("l"), F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.col("cwe_id").alias("cwe"), "type", F.col("rule_id").alias("note"))
    clean = table(spark, sf_dir, "labels").where("quality = 1").join(files(spark, sf_dir).select("doc_id", F.col("path").alias("file")), "doc_id").select("file")
    return d, y, clean


def label_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y, _ = _detections(spark, sf_dir)
    return scoring.candidate_pairs(d, y).select("d", "l", "file", "cost")


def detection_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y, clean = _detections(spark, sf_dir)
    matched = scoring.match(scoring.candidate_pairs(d, y))
    return scoring.outcomes(d, y, matched, clean).groupBy("cwe", "outcome").agg(F.count(F.lit(1)).alias("n"))


def cwe_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, y, _ = _detections(spark, sf_dir)
    return scoring.per_cwe(y, scoring.match(scoring.candidate_pairs(d, y)))


def document_labels_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Risk as a detector of low quality, scored against the labels by language."""
    flagged = files(spark, sf_dir).withColumn("hit", F.rlike("content", F.lit("###|!!|[|]|%%%")))
    both = table(spark, sf_dir, "labels").join(flagged, "doc_id").withColumn("bad", F.col("quality") == 0)
    tp, fp, fn = F.count_if(F.col("hit") & F.col("bad")), F.count_if(F.col("hit") & ~F.col("bad")), F.count_if(~F.col("hit") & F.col("bad"))
    out = both.groupBy("lang").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return out.select("*", *scoring.ratios(F.col("tp"), F.col("fp"), F.col("fn")))


def related_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = findings(spark, sf_dir).select(F.col("file_path").alias("scope"), "file_path", "type", "start_line", "description", F.lit("").alias("impact"), F.lit(None).cast("double").alias("cvss_score"))
    return chains.related_counts(f).groupBy("score").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("scopes"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("user_id").alias("users"), F.max("value").alias("most"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def event_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["click", "view", "purchase", "signup", "logout"]
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("total"))


def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("configuration"), F.dayofmonth("ts").alias("run"), F.col("user_id").alias("signature"))
    return reports.stability(e)


def newest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "event_type")
    return reports.newest(e, 50)


def retained_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), "user_id", F.when(F.col("event_type") == "click", "running").otherwise("done").alias("status"))
    return reports.retained(e, "user_id", 5)


def capped_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.capped_events(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "event_id", 3, 10)


def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.latest(table(spark, sf_dir, "events"), "user_id", "event_id", ["event_type", "value"])


def debounced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.debounced(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600)


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("most"))


def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("role", (F.length("text") > 20).alias("ok"), F.length("text").cast("long").alias("tokens"))
    return reports.call_summary(c, "role")


def text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.search(numbered_lines(files(spark, sf_dir)), "License")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = numbered_lines(files(spark, sf_dir)).where("text <> ''").withColumn("at", place(F.col("line"))).withColumn("sum", F.md5("text"))
    return reports.first_occurrences(lines, "sum", "at").select("sum", "first")


def code_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = reports.code_window(numbered_lines(files(spark, sf_dir)).select("path", "line", "text"), F.contains("text", F.lit("License")))
    return out.select("path", "line", F.md5("window").alias("window_md5"))


def snapshot_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return reports.manifest_digest(f.select("source", "lang", F.md5(F.concat_ws("|", "path")).substr(1, 2).alias("folder"), "path", F.sha2("content", 256).alias("sha256")), "source", "folder")


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("doc_id", cache_key(F.col("content"), "1", "local", "base").alias("key"))


def coercions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    word = F.when(F.col("l_linenumber") == 1, "high").when(F.col("l_linenumber") == 2, "Medium").when(F.col("l_linenumber") == 3, "oops").otherwise(F.col("l_quantity").cast("string"))
    return li.select(coerce_confidence(word).alias("confidence"), coerce_cvss(word).alias("cvss")).groupBy("confidence", "cvss").agg(F.count(F.lit(1)).alias("n"))


def sarif_rule_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_rules(findings(spark, sf_dir))


def sarif_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sarif_results(findings(spark, sf_dir)).select("seq", F.get_json_object("result", "$.ruleId").alias("rule"), F.get_json_object("result", "$.level").alias("level"), F.get_json_object("result", "$.locations[0].physicalLocation.region.endLine").cast("int").alias("end_line"))


def scan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per file with findings, by the digest of its findings' places and its total (SNK-01)."""
    out = sinks.scan_documents(findings(spark, sf_dir), "file_path")
    doc = F.from_json("document", "total long, findings array<struct<seq: decimal(38,0), line: int, type: string>>")
    return out.select("file_path", doc.alias("d")).select("file_path", "d.total", F.md5(F.array_join(F.transform("d.findings", lambda f: F.concat_ws(":", f["seq"].cast("string"), f["line"].cast("string"), f["type"])), "|")).alias("digest"))


def scan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).withColumn("status", F.when(F.length("content") < 50, "failed").when(F.contains("content", F.lit("###")), "partial").otherwise("completed"))
    return reports.coverage(f)


def supply_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importer expansion: parts that share an order with the seeds, in two hops (JON-16)."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    found = table(spark, sf_dir, "part").where("p_partkey % 500 = 1").select(F.col("p_partkey").alias("part"), F.lit(0).alias("depth"))
    for hop in (1, 2):
        orders = li.join(found.select(F.col("part").alias("l_partkey")).distinct(), "l_partkey", "left_semi").select("l_orderkey").distinct()
        near = li.join(orders, "l_orderkey", "left_semi").select(F.col("l_partkey").alias("part")).distinct()
        found = found.unionByName(near.join(found, "part", "left_anti").withColumn("depth", F.lit(hop)))
    return found.groupBy("depth").agg(F.count(F.lit(1)).alias("parts"))


def priced_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollup with a grand total over a five-table join."""
    li, o, c, n, r = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation", "region"))
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.rollup("r_name", "n_name").agg(F.sum(cents).alias("cents"), F.count(F.lit(1)).alias("lines"))


def order_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dearest orders of each customer segment and status, with the one before."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    w = Window.partitionBy("c_mktsegment", "o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey")
    j = o.join(c, o.o_custkey == c.c_custkey).withColumn("place", F.row_number().over(w)).withColumn("before", F.lag("o_orderkey").over(w))
    return j.where("place <= 3").select("c_mktsegment", "o_orderstatus", "o_orderkey", F.col("place").cast("int").alias("place"), "before")


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty documents of each quality and language, by the digest of their ids (SRC-31, a sampling operator)."""
    rows = table(spark, sf_dir, "labels").join(files(spark, sf_dir), "doc_id").select("doc_id", "quality", "lang", F.md5(F.col("doc_id").cast("string")).alias("digest"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("quality", "lang").orderBy("digest", "doc_id"))).where("place <= 50").select("doc_id", "quality", "lang", F.col("place").cast("int").alias("place"))


def taint_touch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of one file as steps of paths: which touch within a line to either side (JON-14)."""
    steps = findings(spark, sf_dir).where("severity in ('CRITICAL', 'HIGH')").select("seq", F.col("file_path").alias("file"), F.col("start_line").alias("line"), F.lit("step").alias("kind"))
    return repair.taint_pairs(steps)


def evidence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence on licence lines against the current files, of which some changed or went (JON-19)."""
    f = files(spark, sf_dir)
    old = f.withColumn("sha256", F.sha2("content", 256)).where(F.contains("content", F.lit("License")))
    evidence = old.select(F.concat(F.lit("e"), F.col("doc_id").cast("string")).alias("evidence_id"), "path", F.col("sha256").alias("content_hash"), F.size(F.split("content", "\n")).alias("end_line"))
    now = f.where("doc_id % 7 <> 3").withColumn("content", F.when(F.col("doc_id") % 5 == 1, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    states = reports.evidence_state(evidence, now.select("path", F.sha2("content", 256).alias("sha256"), F.size(F.split("content", "\n")).alias("n_lines")))
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: printable(f) for f in (risk_route, risk_signals, fingerprints, severity_by_source, provenance_counts, top_types, tier_dedup, two_tier_fusion, overlap_merge, suppression, baseline_partition, fix_check, build_gate, label_candidates, detection_outcomes, cwe_recall, document_labels_score, related_findings, dashboard, event_matrix, run_stability, newest_events, retained_events, capped_log, latest_state, debounced, event_props, call_summary, text_search, first_lines, code_windows, snapshot_digest, cache_keys, coercions, sarif_rule_list, sarif_results, scan_documents, scan_coverage, supply_depth, priced_nations, order_ranks, stratified_sample, taint_touch, evidence_states)}

_SIGNALS = " UNION ALL ".join(f"SELECT '{n}' AS signal, count(*) AS files FROM files WHERE regexp_matches(content, '{_re2(p)}')" for p, _, n in fixed.RISK_SIGNALS)
_CLASS = " OR ".join(f"(d.cwe IN ({q}) AND y.cwe IN ({q}))" for g in fixed.CWE_CLASSES if (q := ", ".join(f"'{c}'" for c in g)))
_WORD = "CASE l_linenumber WHEN 1 THEN 'high' WHEN 2 THEN 'Medium' WHEN 3 THEN 'oops' ELSE CAST(l_quantity AS VARCHAR) END"

SQL = {
    "risk_route": f"WITH {_FINDINGS}, scored AS (SELECT *, {_RISK} AS risk FROM files) SELECT lang, source, count(*) AS files, CAST(sum(risk) AS BIGINT) AS risk, max(risk) AS most FROM scored WHERE risk >= 3 OR path IN (SELECT file_path FROM findings WHERE source = 'SEMGREP') GROUP BY lang, source",
    "risk_signals": f"WITH {_FILES} SELECT * FROM ({_SIGNALS}) WHERE files > 0",
    "fingerprints": f"WITH {_FINDINGS} SELECT seq, {_PRINT} AS fingerprint, 'CWE-' || cwe_id AS cwe, {_RANK} AS rank FROM findings",
    "provenance_counts": f"WITH {_FINDINGS} SELECT s AS source, CASE s WHEN 'TOTAL' THEN (SELECT count(*) FROM findings) ELSE (SELECT count(*) FROM findings WHERE source = s) END AS n FROM (VALUES ('CONFIRMED'), ('SEMGREP'), ('LLM'), ('TOTAL')) t(s)",
    "severity_by_source": f"WITH {_FINDINGS}, c AS (SELECT source, count(*) AS chains FROM (SELECT source, file_path FROM findings GROUP BY ALL HAVING count(*) > 1) GROUP BY source), t AS (SELECT source, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (severity = 'INFO') AS info, CAST(sum(CASE severity WHEN 'CRITICAL' THEN 10 WHEN 'HIGH' THEN 8 WHEN 'MEDIUM' THEN 5 WHEN 'LOW' THEN 2 ELSE 1 END) AS BIGINT) AS risk FROM findings GROUP BY source) SELECT t.*, round(risk * (1 + 0.1::DOUBLE * coalesce(chains, 0)), 2) AS risk_score FROM t LEFT JOIN c USING (source)",
    "top_types": f"WITH {_FINDINGS} SELECT type, count(*) AS n FROM findings GROUP BY type ORDER BY n DESC, type LIMIT 5",
    "overlap_merge": f"WITH {_FINDINGS}, f AS (SELECT * REPLACE (start_line + start_line % 4 AS end_line) FROM findings), m AS (SELECT *, CASE WHEN start_line <= max(end_line) OVER (PARTITION BY file_path, type ORDER BY start_line, end_line, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM f), g AS (SELECT *, sum(new) OVER (PARTITION BY file_path, type ORDER BY start_line, end_line, seq) AS run FROM m) SELECT file_path, type, min(start_line) AS start_line, max(end_line) AS end_line, first(seq ORDER BY start_line, end_line, seq) AS seq, string_agg(DISTINCT rule_id, ',' ORDER BY rule_id) AS rules FROM g GROUP BY file_path, type, run",
    "suppression": f"WITH {_FINDINGS}, whole AS (SELECT DISTINCT path FROM lines WHERE regexp_matches(text, '(?i)CC BY-NC')), own AS (SELECT path, line, 0 AS kind FROM lines WHERE regexp_matches(text, '(?i)Apache License')), marks AS (SELECT * FROM own UNION ALL SELECT path, line + 1, 1 FROM own UNION ALL SELECT path, line, 2 FROM lines WHERE regexp_matches(text, '(?i)MIT License') AND NOT regexp_matches(text, '(?i)Apache License')), best AS (SELECT path, line, min(kind) AS kind FROM marks GROUP BY path, line) SELECT type, count(*) AS kept FROM findings f WHERE file_path NOT IN (SELECT path FROM whole) AND NOT EXISTS (SELECT 1 FROM best b WHERE b.path = f.file_path AND b.line = f.start_line AND (b.kind = 2 OR f.type IN ('EXPOSED_SECRET', 'SECURITY_MISCONFIGURATION'))) GROUP BY type",
    "baseline_partition": f"WITH {_FINDINGS}, p AS (SELECT *, {_PRINT} AS fp FROM findings) SELECT type, fp NOT IN (SELECT fp FROM p WHERE start_line % 2 = 0) AS is_new, count(*) AS n FROM p GROUP BY ALL",
    "fix_check": f"WITH {_FINDINGS}, p AS (SELECT *, {_PRINT} AS fp FROM findings), a AS (SELECT DISTINCT fp FROM p WHERE start_line % 3 <> 0), b AS (SELECT DISTINCT fp FROM p WHERE start_line % 2 = 0) SELECT CASE WHEN b.fp IS NULL THEN 'resolved' WHEN a.fp IS NULL THEN 'regression' ELSE 'persistent' END AS state, count(*) AS n FROM a FULL JOIN b ON a.fp = b.fp GROUP BY 1",
    "build_gate": f"WITH {_FINDINGS} SELECT severity, source, count(*) AS blocking FROM findings WHERE {_RANK} <= 1 AND source <> 'LLM' GROUP BY severity, source",
    "label_candidates": f"WITH {_FINDINGS}, d AS (SELECT seq AS d, file_path AS file, start_line AS line, cwe_id AS cwe, CAST(('0x' || substr(md5(file_path || ':' || start_line || ':' || cwe_id || ':' || type || ':' || source), 1, 8)) AS BIGINT) % 10000 AS tie FROM findings WHERE source = 'SEMGREP'), y AS (SELECT seq AS l, file_path AS file, start_line AS line, cwe_id AS cwe, CAST(('0x' || substr(md5(file_path || ':' || start_line || ':' || cwe_id || ':' || type || ':' || rule_id), 1, 8)) AS BIGINT) % 10000 AS tie FROM findings WHERE source = 'LLM') SELECT d, l, d.file AS file, abs(d.line - y.line) * 100000000 + d.tie * 10000 + y.tie AS cost FROM d JOIN y ON d.file = y.file AND abs(d.line - y.line) <= 3 WHERE d.cwe = y.cwe OR {_CLASS}",
    "document_labels_score": f"WITH {_FILES}, b AS (SELECT lang, regexp_matches(content, '###|!!|[|]|%%%') AS hit, quality = 0 AS bad FROM labels JOIN files USING (doc_id)), c AS (SELECT lang, count(*) FILTER (hit AND bad) AS tp, count(*) FILTER (hit AND NOT bad) AS fp, count(*) FILTER (NOT hit AND bad) AS fn FROM b GROUP BY lang) SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END AS f1 FROM c",
    "dashboard": "SELECT event_type, count(*) AS events, count(DISTINCT user_id) AS users, max(value) AS most, min(ts) AS first, max(ts) AS last FROM events GROUP BY event_type",
    "event_matrix": "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'logout') AS logout, count(*) AS total FROM events GROUP BY user_id",
    "run_stability": "WITH e AS (SELECT event_type AS configuration, day(ts) AS run, user_id AS signature FROM events), r AS (SELECT configuration, count(*) AS runs, min(n) AS least, max(n) AS most, round(avg(n), 1) AS average FROM (SELECT configuration, run, count(*) AS n FROM e GROUP BY 1, 2) GROUP BY 1), s AS (SELECT configuration, signature, count(DISTINCT run) AS n FROM e GROUP BY 1, 2), t AS (SELECT configuration, runs, least, most, average, count(*) AS signatures, count(*) FILTER (n = runs) AS stable FROM s JOIN r USING (configuration) GROUP BY ALL) SELECT configuration, runs, signatures, stable, signatures - stable AS intermittent, round(stable / signatures * 100, 1) AS consistency_pct, round(100 - round(stable / signatures * 100, 1), 1) AS variance_pct, least, most, average, most - least AS spread FROM t",
    "newest_events": "SELECT event_id AS id, ts AS created_at, event_type FROM events ORDER BY ts DESC, event_id LIMIT 50",
    "retained_events": "SELECT event_id AS id, ts AS created_at, user_id, CASE WHEN event_type = 'click' THEN 'running' ELSE 'done' END AS status FROM events QUALIFY event_type = 'click' OR row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts DESC, event_id) <= 5",
    "capped_log": "SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 3 OR row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 10",
    "latest_state": "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id",
    "debounced": "WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 3600000000 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS events FROM b GROUP BY user_id, burst",
    "event_props": "SELECT event_type, count(CAST(json_extract(props, '$.k') AS BIGINT)) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY event_type",
    "call_summary": "SELECT role, count(*) AS requests, count(*) FILTER (length(text) <= 20) AS failed, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(max(length(text)) AS BIGINT) AS most FROM conversations GROUP BY role",
    "text_search": f"WITH {_LINES} SELECT path, CAST(line AS INTEGER) AS line, text FROM lines WHERE contains(text, 'License') ORDER BY path, line LIMIT 40",
    "first_lines": f"WITH {_LINES} SELECT md5(text) AS sum, min({_PLACE} + line) AS first FROM lines WHERE text <> '' GROUP BY 1",
    "code_windows": f"WITH {_LINES} SELECT a.path, CAST(a.line AS INTEGER) AS line, md5(string_agg(CASE WHEN b.line = a.line THEN '> ' ELSE '  ' END || b.line || ': ' || b.text, chr(10) ORDER BY b.line)) AS window_md5 FROM lines a JOIN lines b ON a.path = b.path AND b.line BETWEEN a.line - 2 AND a.line + 2 WHERE contains(a.text, 'License') GROUP BY a.path, a.line",
    "snapshot_digest": f"WITH {_FILES} SELECT source, substr(md5(path), 1, 2) AS folder, substr(sha256(string_agg(path || ':' || sha256(content), chr(10) ORDER BY path)), 1, 16) AS digest, count(*) AS files FROM files GROUP BY 1, 2",
    "cache_keys": f"WITH {_FILES} SELECT doc_id, sha256('1' || chr(0) || 'local' || chr(0) || 'base' || chr(0) || content) AS key FROM files",
    "coercions": f"WITH w AS (SELECT {_WORD} AS w, l_linenumber AS k, l_quantity AS q FROM lineitem) SELECT CASE k WHEN 1 THEN 0.9::DOUBLE WHEN 2 THEN 0.6::DOUBLE WHEN 3 THEN 0.5::DOUBLE ELSE greatest(0.0, least(1.0, q)) END AS confidence, CASE k WHEN 1 THEN 8.0::DOUBLE WHEN 2 THEN 5.5::DOUBLE WHEN 3 THEN 5.0::DOUBLE ELSE greatest(0.0, least(10.0, q)) END AS cvss, count(*) AS n FROM w GROUP BY ALL",
    "sarif_rule_list": f"WITH {_FINDINGS} SELECT type AS id, arg_min(description, seq) AS text, CASE arg_min(severity, seq) WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level FROM findings GROUP BY type",
    "sarif_results": f"WITH {_FINDINGS} SELECT seq, type AS rule, CASE WHEN {_RANK} <= 1 THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' ELSE 'note' END AS level, end_line FROM findings",
    "scan_documents": f"WITH {_FINDINGS} SELECT file_path, count(*) AS total, md5(string_agg(seq || ':' || start_line || ':' || type, '|' ORDER BY seq)) AS digest FROM findings GROUP BY file_path",
    "scan_coverage": f"WITH {_FILES}, s AS (SELECT CASE WHEN length(content) < 50 THEN 'failed' WHEN contains(content, '###') THEN 'partial' ELSE 'completed' END AS status FROM files) SELECT count(*) AS requested, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'partial') AS partial, CASE WHEN count(*) FILTER (status = 'failed') = count(*) THEN 'failed' WHEN count(*) FILTER (status <> 'completed') > 0 THEN 'partial' ELSE 'completed' END AS status FROM s",
    "supply_depth": "WITH l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), d0 AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 500 = 1), d1 AS (SELECT DISTINCT p FROM l WHERE o IN (SELECT o FROM l WHERE p IN (SELECT p FROM d0)) AND p NOT IN (SELECT p FROM d0)), k AS (SELECT p FROM d0 UNION SELECT p FROM d1), d2 AS (SELECT DISTINCT p FROM l WHERE o IN (SELECT o FROM l WHERE p IN (SELECT p FROM k)) AND p NOT IN (SELECT p FROM k)), a AS (SELECT 0 AS depth FROM d0 UNION ALL SELECT 1 FROM d1 UNION ALL SELECT 2 FROM d2) SELECT depth, count(*) AS parts FROM a GROUP BY depth",
    "priced_nations": "SELECT r_name, n_name, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "stratified_sample": f"WITH {_FILES} SELECT doc_id, quality, lang, CAST(row_number() OVER w AS INTEGER) AS place FROM labels JOIN files USING (doc_id) WINDOW w AS (PARTITION BY quality, lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) QUALIFY row_number() OVER w <= 50",
    "taint_touch": f"WITH {_FINDINGS}, f AS (SELECT seq, file_path, start_line FROM findings WHERE severity IN ('CRITICAL', 'HIGH')) SELECT x.seq AS a, y.seq AS b FROM f x JOIN f y ON x.file_path = y.file_path AND abs(x.start_line - y.start_line) <= 2 AND x.seq < y.seq",
    "evidence_states": f"WITH {_FILES} SELECT CASE WHEN doc_id % 7 = 3 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'changed' ELSE 'valid' END AS state, count(*) AS n FROM files WHERE contains(content, 'License') GROUP BY 1",
    "order_ranks": "SELECT c_mktsegment, o_orderstatus, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, lag(o_orderkey) OVER w AS before FROM orders JOIN customer ON o_custkey = c_custkey WINDOW w AS (PARTITION BY c_mktsegment, o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) QUALIFY row_number() OVER w <= 3",
}

# The greedy steps in order, as reductions over each file's sorted findings.
_KEEP_ORDER = f"{{'a': {_RANK}, 'b': -length(description), 'seq': seq, 'line': start_line, 'type': type, 'cwe': cwe_id, 'severity': severity, 'context': context}}"
_ALIKE = " OR ".join(["{a}.type = {b}.type", "{a}.cwe = {b}.cwe", *(f"({{a}}.type IN ({q}) AND {{b}}.type IN ({q}))" for g in fixed.TYPE_ALIASES if (q := ", ".join(f"'{t}'" for t in g)))])


def _near(a: str, b: str) -> str:
    return f"(abs({a}.line - {b}.line) <= {fixed.FUSION_LINES} AND ({_ALIKE.format(a=a, b=b)}))"


def _kept(found: str) -> str:
    """SQL: a sorted list of findings without those near one that was kept before them."""
    return f"list_reduce(list_transform({found}, lambda x: [x]), lambda kept, one: CASE WHEN len(list_filter(kept, lambda k: {_near('k', 'one[1]')})) > 0 THEN kept ELSE list_concat(kept, one) END)"


_TIERS = f"{_FINDINGS}, tiers AS (SELECT file_path, source, list_sort(list({_KEEP_ORDER})) AS found FROM findings GROUP BY file_path, source), kept AS (SELECT file_path, source, {_kept('found')} AS kept FROM tiers)"
_MET = f"list_sort(list_transform(list_filter(models, lambda m: {_near('one[1].r', 'm')} AND NOT list_contains(list_transform(done, lambda z: coalesce(z.m, -1)), m.seq)), lambda m: {{'d': abs(m.line - one[1].r.line), 'k': list_position(models, m), 'seq': m.seq}}))[1].seq"
_MOVED = "y IS NOT NULL AND regexp_matches(lower(x.context), 'import |from ') AND NOT regexp_matches(lower(y.context), 'import |from ')"
_WORSE = "CASE WHEN coalesce(y.a, 9) < x.a THEN y.severity ELSE x.severity END"

SQL |= {
    "tier_dedup": f"WITH {_TIERS}, k AS (SELECT file_path, unnest(kept) AS x FROM kept WHERE source = 'SEMGREP') SELECT x.seq AS seq, file_path, x.type AS type, x.severity AS severity, x.line AS start_line FROM k",
    "two_tier_fusion": f"""WITH {_TIERS},
sides AS (SELECT file_path, coalesce(any_value(kept) FILTER (source = 'SEMGREP'), []) AS rules, coalesce(any_value(kept) FILTER (source = 'LLM'), []) AS models FROM kept GROUP BY file_path),
pairs AS (SELECT file_path, models, list_reduce(list_transform(list_concat([NULL], rules), lambda r: CASE WHEN r IS NULL THEN [] ELSE [{{'r': r, 'm': CAST(NULL AS HUGEINT)}}] END), lambda done, one: list_concat(done, [{{'r': one[1].r, 'm': {_MET}}}])) AS done FROM sides),
met AS (SELECT file_path, unnest(done) AS d FROM pairs),
said AS (SELECT file_path, unnest(models) AS y FROM pairs),
both_ AS (SELECT met.file_path, d.r AS x, y FROM met LEFT JOIN said ON met.file_path = said.file_path AND d.m = y.seq),
fused AS (
SELECT x.seq AS seq, file_path, coalesce(y.type, x.type) AS type, {_WORSE} AS severity, coalesce(y.cwe, x.cwe) AS cwe_id, CASE WHEN {_MOVED} THEN y.line ELSE x.line END AS start_line, CASE WHEN {_MOVED} THEN y.context ELSE x.context END AS context, CASE WHEN y IS NULL THEN 'SEMGREP' ELSE 'CONFIRMED' END AS source, CASE WHEN y IS NULL THEN {fixed.CONFIDENCE["SEMGREP"]}::DOUBLE ELSE {fixed.CONFIDENCE["CONFIRMED"]}::DOUBLE END AS confidence, y IS NOT NULL AS corroborated, y.seq AS merged_seq FROM both_
UNION ALL SELECT y.seq, file_path, y.type, y.severity, y.cwe, y.line, y.context, 'LLM', {fixed.CONFIDENCE["LLM"]}::DOUBLE, false, NULL FROM said WHERE y.seq NOT IN (SELECT d.m FROM met WHERE d.m IS NOT NULL))
SELECT * EXCLUDE (context), {_PRINT} AS fingerprint FROM fused""",
}
_POINTS = {(a, b): 2.0 * (b in fixed.ATTACK_CHAINS.get(a, ()) or a in fixed.ATTACK_CHAINS.get(b, ())) + 1.0 * any(a in g and b in g for g in chains.CONTEXTS) + 1.0 * bool(set(chains.TYPE_PREREQUISITES.get(a, ())) & set(chains.TYPE_PREREQUISITES.get(b, ()))) for _, _, a, _, _ in RULES + MODEL for _, _, b, _, _ in RULES + MODEL}
_WORDED = {t: {n for n, words in chains.DATA_WORDS.items() if any(w in f"{t} found ".lower() for w in words)} for t, _ in _POINTS}
_POINT_ROWS = ", ".join(f"('{a}', '{b}', {v + 1.5 * bool(_WORDED[a] & _WORDED[b])})" for (a, b), v in sorted(_POINTS.items()))
SQL["related_findings"] = f"WITH {_FINDINGS}, points(a, b, p) AS (VALUES {_POINT_ROWS}), n AS (SELECT file_path, type, start_line, count(*) AS n FROM findings GROUP BY ALL), pairs AS (SELECT x.file_path, p + 0.5 + CASE WHEN abs(x.start_line - y.start_line) <= {fixed.CHAIN_LINES} THEN 0.5 ELSE 0 END AS score, CASE WHEN x.type = y.type AND x.start_line = y.start_line THEN x.n * (x.n - 1) // 2 ELSE x.n * y.n END AS k FROM n x JOIN n y ON x.file_path = y.file_path AND (x.type, x.start_line) <= (y.type, y.start_line) JOIN points ON a = x.type AND b = y.type), s AS (SELECT file_path, CAST(score AS DOUBLE) AS score, sum(k) AS pairs FROM pairs WHERE score >= 2 AND k > 0 GROUP BY ALL) SELECT score, CAST(sum(pairs) AS BIGINT) AS pairs, count(*) AS scopes FROM s GROUP BY score"

for _name, _keys in {"fingerprints": ["seq"], "tier_dedup": ["seq"], "two_tier_fusion": ["seq", "merged_seq"], "overlap_merge": ["seq"], "label_candidates": ["d", "l"], "first_lines": ["first"], "sarif_results": ["seq"], "taint_touch": ["a", "b"]}.items():
    SQL[_name] = printed(SQL[_name], *_keys)
