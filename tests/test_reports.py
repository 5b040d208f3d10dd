"""Rule metadata, report assembly, verification, evaluation and the response cache."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import fixed, rules
from fathomline.operators import assembly, chains, evaluation, reports, scoring
from fathomline.sources import cache


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_rule_types(spark):
    rows = [("89", "x.md5"), ("CWE-704", "python.lang.tainted-sql-string"), ("", "a.b.python-insecure-eval"), (None, "python.Audit.Use-MD5"), ("", "pickles.use"), ("1", "nothing"), (None, None), ("", "xml.sql")]
    want = ["SQL_INJECTION", "SQL_INJECTION", "CODE_INJECTION", "USE_OF_WEAK_HASHING_ALGORITHM", "INSECURE_DESERIALIZATION", None, None, "SQL_INJECTION"]
    assert values(spark, rules.rule_type(F.col("c"), F.col("r")), rows, "c string, r string") == want


def test_rule_metadata(spark):
    lists = [(["CWE-X", "CWE-89: a", "CWE-1"],), ([],), (None,), (["A1:2017", "A3:2021", "A03:2021 - Injection"],), (["A1:2017", "x"],)]
    assert values(spark, rules.first_cwe(F.col("e")), lists, "e array<string>") == ["89", "", "", "", ""]
    assert values(spark, rules.preferred_owasp(F.col("e")), lists, "e array<string>") == ["CWE-X", "", "", "A03:2021 - Injection", "A1:2017"]
    names = [("Corroborated",), ("RULE_only",), ("llm",), ("other",), (None,)]
    assert values(spark, rules.source_label(F.col("s")), names, "s string") == ["confirmed", "rule-only", "llm-only", "other", ""]
    paths = [("/r/a//b/./c.py",), ("./a\\b",), ("/r",), ("/rx/a",), (None,), ("a/.",), ("/",)]
    assert values(spark, rules.posix_path(F.col("p"), "/r/"), paths, "p string") == ["a/b/c.py", "a/b", ".", "/rx/a", "", "a", "/"]


def test_reliable_rules(spark):
    rows = [(["sql"], "HIGH", "89", "SQL_INJECTION", "x"), (["sql", "py.audit.x"], "HIGH", "89", "S", "x"), ([" ", None], "HIGH", "89", "S", "x"), (["sql"], "MEDIUM", "89", "S", "x"), (["sql"], "CRITICAL", "CWE-73", "S", "x"), (["sql"], "HIGH", None, "INSECURE_FILE_READ", "x"), (["sql"], "HIGH", None, "S", "OS.path.join(a)"), (None, "HIGH", "1", "S", None), (["sql"], "CRITICAL", None, None, None)]
    got = values(spark, rules.reliable(F.col("i"), F.col("s"), F.col("c"), F.col("t"), F.col("x"), F.lit(None).cast("string")), rows, "i array<string>, s string, c string, t string, x string")
    assert got == [True, False, False, False, False, False, False, False, True]


def test_unconfirmed_rules_stay_where_no_model_read(spark):
    rows = [(1, "a", "SEMGREP", "LOW"), (2, "a", "SEMGREP", "HIGH"), (3, "b", "SEMGREP", "LOW"), (4, "a", "LLM", "LOW"), (5, "a", "CONFIRMED", "LOW")]
    fused = spark.createDataFrame([(*r, "sql", "89", "SQL_INJECTION", "x", "y") for r in rows], "seq long, file_path string, source string, severity string, rule_id string, cwe_id string, type string, context string, description string")
    out = assembly.keep_reliable(fused, spark.createDataFrame([("a",), ("a",)], "path string"))
    assert {r["seq"] for r in out.collect()} == {2, 3, 4, 5}


def test_assembly(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    files = one([(p,) for p in "abcdef"], "path string")
    routed = one([("a", "ok"), ("b", "failed: x"), ("d", "ok"), ("f", "ok")], "path string, outcome string")
    errors = one([("d", "z"), ("d", "no parse"), ("e", "no parse")], "path string, message string")
    counts = one([("a", 2), ("d", 1)], "path string, n long")
    out = {r["path"]: tuple(r)[1:] for r in assembly.assemble(files, counts, counts.where("path = 'a'"), routed, errors, missing=one([("g",)], "path string")).collect()}
    assert out["a"] == ("completed", "ok", "", "ok", "", 2, 2)
    assert out["b"] == ("failed", "ok", "", "failed", "failed: x", 0, 0)
    assert out["c"] == ("partial", "ok", "", "not_routed", "File did not clear risk threshold", 0, 0)
    assert out["d"] == ("completed", "syntax_skipped", "no parse", "ok", "", 1, 0)
    assert out["e"][:3] == ("failed", "parse_error", "no parse")
    assert out["g"][:2] == ("failed", "failed") and len(out) == 7

    def states(**options):
        rows = assembly.assemble(files, counts, counts, routed, errors, assembly.Engines(**options))
        return {r["path"]: (r["status"], r["rules_state"], r["model_state"]) for r in rows.collect()}, rows

    got, rows = states(model=False)
    assert got["a"] == ("completed", "ok", "disabled") and got["d"] == ("failed", "parse_error", "disabled")
    assert assembly.scan_degraded(rows, 6).first()[0] and not assembly.scan_degraded(rows.where("path = 'a'"), 1).first()[0]
    assert assembly.scan_degraded(rows.where("false"), 1).first()[0] and not assembly.scan_degraded(rows.where("false"), 0).first()[0]
    assert states(rules_available=False)[0]["a"] == ("partial", "unavailable", "ok")
    assert states(rules_error="boom")[0]["c"] == ("failed", "failed", "not_routed") and states(rules_error="boom")[0]["a"] == ("completed", "failed", "ok")
    assert states(rules=False)[0]["e"] == ("partial", "disabled", "not_routed")


def test_verdicts(spark):
    rows = [(1, "T", "89", 0.5, False, False), (2, "T", "89", 0.5, True, False), (3, "T", "89", 0.5, None, True), (4, "T", "CWE-328", 0.5, True, False), (5, "T", "89", 0.5, True, False), (6, "T", "89", 0.5, None, None), (7, "T", "89", 0.5, False, False)]
    f = spark.createDataFrame(rows, "seq long, type string, cwe_id string, confidence double, corroborated boolean, has_taint boolean")
    said = spark.createDataFrame([(1, "refuted", None), (2, "refuted", " N/A "), (3, "refuted", "escaped"), (4, "refuted", "a constant input"), (5, "confirmed", None), (6, "uncertain", "x")], "seq long, verdict string, control string")
    out = {r["seq"]: (r["assessment_status"], r["confidence"], r["corroborated"]) for r in assembly.with_verdicts(f, said).collect()}
    assert [out[k][0] for k in range(1, 8)] == ["refuted", "uncertain", "refuted", "uncertain", "supported", "uncertain", None]
    assert out[5][1:] == (0.98, True) and out[7][1:] == (0.5, False)


def test_verified_equals_a_walk_over_each_file(spark):
    rng = random.Random(4)
    kinds = ["SQL_INJECTION", "INJECTION", "CSRF"]
    rows = [(k, f"f{rng.randint(0, 5)}", rng.choice(kinds), rng.choice(fixed.SEVERITIES), line := rng.randint(1, 90), line + rng.randint(0, 30), rng.choice(["89", "90", None]), rng.choice(["LLM", "CONFIRMED"]), rng.choice([0.5, 0.9, None]), rng.choice([True, False, None]), rng.choice([None, "supported", "refuted", "uncertain"]) if k % 6 < 5 else None) for k in range(160)]
    rows = [r if r[1] != "f0" else (*r[:-1], None) for r in rows]
    schema = "seq long, file_path string, type string, severity string, start_line int, end_line int, cwe_id string, source string, confidence double, corroborated boolean, assessment_status string"
    frame = spark.createDataFrame(rows, schema).repartition(3)
    got = {r["seq"]: r["kept"] for r in assembly.verified(frame).collect()}
    want = {}
    for path, group in itertools.groupby(sorted(rows, key=lambda r: r[1]), key=lambda r: r[1]):
        group = list(group)
        stay = [r for r in group if r[10] != "refuted"]
        want |= {r[0]: r in stay for r in group}
        if len(stay) < len(group):
            kept = []
            for r in sorted(stay, key=lambda r: (not r[9], r[7] != "CONFIRMED", -(r[8] if r[8] is not None else 0.5), fixed.SEVERITIES.index(r[3]), r[0])):
                near = [k for k in kept if abs(k[4] - r[4]) <= 12 and (k[2] == r[2] or any(k[2] in g and r[2] in g for g in fixed.TYPE_ALIASES) or (k[6] and k[6] == r[6]))]
                want[r[0]] = not near
                kept += [] if near else [r]
    assert got == want


def test_snippets_and_scope(spark):
    files = spark.createDataFrame([("a", "\n".join(f"l{k}" for k in range(1, 31)))], "path string, content string")
    f = spark.createDataFrame([(1, "a", "T", 2, 40, "old"), (2, "a", "T", 30, 30, "old"), (3, "b", "T", 1, 1, "old")], "seq long, file_path string, type string, start_line int, end_line int, context string")
    out = {r["seq"]: r for r in assembly.in_scope(f, files).collect()}
    assert set(out) == {1, 2} and out[2]["context"] == "l30" and out[1]["context"].split("\n") == [f"l{k}" for k in range(2, 15)] and len(out[1]["fingerprint"]) == 16


def test_detections_of_any_shape(spark):
    texts = ['{"file": "a", "line": 3, "cwe": ["CWE-89: x"], "type": "T", "source": "s"}', '{"location": {"file_path": "b", "start_line": 4}, "vulnerability_type": "x SQL_INJECTION"}', '{"path": "c", "start": {"line": "5"}, "check_id": "r", "extra": {"metadata": {"cwe": "cwe-22"}}}', '{"locations": [{"physicalLocation": {"artifactLocation": {"uri": "d"}, "region": {"startLine": 6}}}], "cwe_id": "other"}', '"no object"', '{"filename": "e", "line_number": "x", "issue_cwe": {"id": 78}}']
    rows = spark.createDataFrame([(k, 0, t) for k, t in enumerate(texts)], "id long, place int, t string").select("id", "place", F.parse_json("t").alias("finding"))
    got = {r["id"]: (r["file"], r["line"], r["cwe"], r["type"]) for r in evaluation.detections(rows).collect()}
    assert got == {0: ("a", 3, "89", "T"), 1: ("b", 4, "89", "x SQL_INJECTION"), 2: ("c", 5, "22", "r"), 3: ("d", 6, "OTHER", ""), 5: ("e", 0, "78", "")}


def test_label_paths(spark):
    labels = spark.createDataFrame([("a/b.py",), ("c.py",), ("x/a/b.py",)], "file string")
    tries = {"a/b.py": "a/b.py", "samples/a/b.py": "a/b.py", "/set/samples/a/b.py": "a/b.py", "/else/x/a/b.py": "x/a/b.py", "q/c.py": "c.py", "samples/none.py": "none.py", "none/n.py": "none/n.py", None: ""}
    out = evaluation.label_paths(spark.createDataFrame([(k, p) for k, p in enumerate(tries)], "k int, file string"), labels, folder="/set")
    assert [r["file"] for r in out.orderBy("k").collect()] == list(tries.values())


def test_scan_scores(spark):
    rng = random.Random(9)
    found = [(s, k, f"f{rng.randint(0, 3)}", rng.randint(1, 12), rng.choice(["89", "22"]), "T", "S") for s in ("x", "y", "z") for k in range(15)]
    labels = [(k, f"f{rng.randint(0, 3)}", rng.randint(1, 12), rng.choice(["89", "22"]), "T", "") for k in range(12)]
    f = spark.createDataFrame(found, "id string, d long, file string, line int, cwe string, type string, source string")
    y = spark.createDataFrame(labels, "l long, file string, line int, cwe string, type string, note string")
    got = {r["id"]: r for r in evaluation.evaluate_scans(f, y).collect()}
    for s in ("x", "y", "z"):
        tp = scoring.match(scoring.candidate_pairs(f.where(F.col("id") == s).drop("id"), y)).count()
        assert (got[s]["tp"], got[s]["fp"], got[s]["fn"]) == (tp, 15 - tp, 12 - tp) and got[s]["precision"] == tp / 15


def test_likelihood_and_connections(spark):
    schema = "scope string, chain long, severity string, type string, description string, impact string, cvss_score double, references array<string>"
    rows = [("s", 1, "CRITICAL", "SQL_INJECTION", "remote x", "", None, ["CVE"]), ("s", 1, "LOW", "CSRF", "needs authentication", "", None, None), ("s", 2, "HIGH", "T", "x", "", None, None)]
    related = spark.createDataFrame([("s", 1, 1)], "scope string, chain long, pairs long")
    got = {r["chain"]: r["likelihood"] for r in chains.likelihood(spark.createDataFrame(rows, schema), related).collect()}
    assert got == {1: round(0.7 * (1 - 0.1 + 0.05) * (1 - 5 * 0.1) * 1.2 * 1.1 * 0.7, 4), 2: 0.8}
    files = spark.createDataFrame([("a/util.py", "x"), ("b/main.py", "import util_x\nfrom a"), ("c/x.py", "main"), ("d/.py", None)], "path string, content string")
    assert {tuple(r) for r in chains.connected_files(files).collect()} == {("b/main.py", "a/util.py"), ("a/util.py", "c/x.py"), ("b/main.py", "c/x.py"), ("c/x.py", "b/main.py")}


def test_connections_send_no_pieces_of_texts(spark):
    """Texts whose characters no name has are not sent anywhere; the others once for each distinct run."""
    rng = random.Random(3)
    words = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwz", k=12)) for _ in range(4000)) for _ in range(4)]
    rows = [(f"s/{k}.txt", f"{words[k % 4]} x{k - 1}y 7.{k + 1} -{k}-") for k in range(100010, 100018)] + [("s/a b.txt", "a b 100011"), ("s/\U0001F600.txt", "100012")]
    files = spark.createDataFrame(rows, "path string, content string")
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()

    def sent() -> int:
        bus.waitUntilEmpty()
        every = store.executorList(False)
        return sum(every.apply(k).totalShuffleWrite() for k in range(every.size()))

    before = sent()
    got = {tuple(r) for r in chains.connected_files(files).collect()}
    assert sent() - before < 50_000
    assert got == {(p, o) for p, text in rows for o, _ in rows if p != o and (name := o[2:-4]).isdigit() and name in text}


def test_cache(spark, tmp_path):
    path = str(tmp_path / "cache")
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("d", "x")], "path string, content string")
    keyed = cache.keyed(files, "1")
    said = keyed.select("key", F.concat(F.lit("r-"), "content").alias("response"), F.when(F.col("path") == "b", "boom").alias("error"), (F.col("path") == "c").alias("truncated"))
    cache.write(said, path)
    got = {r["path"]: r["response"] for r in cache.looked_up(files, cache.read(spark, path), "1").collect()}
    assert got == {"a": "r-x", "b": None, "c": None, "d": "r-x"}
    assert cache.looked_up(files, cache.read(spark, path), "2").where("hit").count() == 0


@pytest.mark.parametrize("rows", [[], [("HIGH",), ("HIGH",), ("INFO",)]])
def test_severity_line(spark, rows):
    out = [r["line"] for r in assembly.severity_line(spark.createDataFrame(rows, "severity string").withColumn("f", F.lit(1)), "f").collect()]
    assert out == (["3 finding(s): 2 high, 1 info"] if rows else [])


def test_views_and_payload(spark):
    schema = "scan string, seq long, type string, cwe_id string, severity string, file_path string, start_line int, end_line int, confidence string, source string, description string, context string, impact string, cvss_score double"
    rows = [("s", 1, "T", "89", "HIGH", "/r/a.py", 1, 2, "high", "LLM", None, None, "", 7.5), ("s", 2, "T", None, "LOW", "b.py", 1, 1, "1.7", "CONFIRMED", "d", "c", "i", None), ("t", 3, "T", "CWE-1", "LOW", "c.py", 1, 1, None, "x", "d", "c", "i", None)]
    f = spark.createDataFrame(rows, schema)
    view = reports.finding_view(f, "/r")
    got = {r["seq"]: r.asDict() for r in view.collect()}
    assert got[1] == {"seq": 1, "type": "T", "cwe": "CWE-89", "severity": "HIGH", "file": "a.py", "start_line": 1, "end_line": 2, "confidence": 0.9, "source": "llm-only", "description": "", "snippet": "", "cvss": 7.5, "impact": None}
    assert (got[2]["cwe"], got[2]["confidence"], got[2]["source"], got[3]["confidence"]) == ("CWE-Unknown", 1.0, "confirmed", 0.5)
    files = spark.createDataFrame([("s", 1.25), ("s", None), ("t", 2.0), ("u", 0.5)], "scan string, risk_score double")
    out = {r["scan"]: r for r in reports.job_payload(view.join(f.select("seq", "scan"), "seq"), files, "scan").collect()}
    assert (out["s"]["files"], out["s"]["risk_score"], out["s"]["counts"], out["s"]["sources"]) == (2, 1.25, {"HIGH": 1, "LOW": 1}, {"llm-only": 1, "confirmed": 1})
    assert out["u"]["counts"] is None


def test_scan_states(spark):
    rows = [("completed", False, False, "", ["completed"]), (None, None, None, None, None), ("failed", False, False, "", []), ("partial", False, False, "", []), ("completed", True, False, "", []), ("odd", False, False, "", []), ("completed", False, True, "x", []), ("completed", False, False, "x", []), ("clean", False, False, "", ["completed", "partial"])]
    f = spark.createDataFrame(rows, "status string, degraded boolean, engine boolean, error string, reports array<string>")
    got = [r[0] for r in f.select(reports.failed_or_degraded(*[F.col(c) for c in f.columns])).collect()]
    assert got == [None, None, "failed with status failed", "incomplete with status partial", "degraded coverage", "incomplete with status odd", "engine failure", "rule error: x", "a report is partial"]
    assert values(spark, reports.route_category(F.col("t"), ("sqli", "xss")), [("@x('/benchmark/SQLI-00/T1')",), ("/benchmark/other-1/T",), (None,), ("/benchmark/xss/T",)], "t string") == ["sqli", None, None, "xss"]


def test_summaries_in_order(spark):
    s = spark.createDataFrame([("f1", "b", 1), ("f2", "a", 2), ("f3", "z", 3), ("f4", "b", 4), ("f5", None, 5)], "file string, model string, tp int")
    assert [(r["model"], r["tp"]) for r in reports.ordered_summaries(s, ("z", "b")).orderBy("place").collect()] == [("z", 3), ("b", 4), ("a", 2)]


def test_attack_paths(spark):
    rows = [("s", 1, 1, "A", "LOW", "a.py", 3, 4, "First. more", "Loss. more"), ("s", 1, 2, "B", "HIGH", "b.py", 5, 5, None, "x"), ("s", 1, 3, "C", "INFO", "c.py", 6, 6, "c", None)]
    members = spark.createDataFrame(rows, "scope string, chain long, seq long, type string, severity string, file_path string, start_line int, end_line int, description string, impact string")
    pairs = spark.createDataFrame([("s", 1, 2)], "scope string, a long, b long")
    assert chains.attack_paths(members, pairs).first()["path"].split("\n") == ["Step 1: B (HIGH) at b.py:5", "   by: ", "   so: x", "   leads to the next", "Step 2: A (LOW) at a.py:3-4", "   by: First", "   so: Loss", "   stands beside the next", "Step 3: C (INFO) at c.py:6", "   by: c", "   so: "]
