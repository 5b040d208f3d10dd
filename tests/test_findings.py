import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from fathomline.functions import fixed, scalars
from fathomline.functions.scalars import coerce_confidence, coerce_cvss, component_excluded, cwe_matches, fingerprint, line_distance, normalize_cwe, cwe_marks, risk_reasons, risk_score, types_agree
from fathomline.operators import chains, firstcome, fusion, policy, reports, scoring
from fathomline.plans import queries, scans
from fathomline.sources import sinks, tables

FINDING = "seq long, file_path string, type string, severity string, start_line int, end_line int, cwe_id string, description string, rule_id string"


def finding(seq, path="a.py", kind="SQL_INJECTION", severity="HIGH", line=1, end=None, cwe="89", text="x", rule="r"):
    return (seq, path, kind, severity, line, end if end is not None else line, cwe, text, rule)


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_risk_counts_each_signal_once(spark):
    text = "import subprocess\nsubprocess.run(x)\npassword = 'a'\neval(x)"
    assert one(spark, risk_score(F.col("c")), c=text) == 11
    assert one(spark, risk_reasons(F.col("c")), c=text) == ["process execution", "dynamic evaluation", "secrets"]
    assert spark.createDataFrame([(None,)], "c string").select(risk_score(F.col("c"))).first()[0] == 0


@pytest.mark.parametrize(("value", "confidence", "cvss"), [("high", 0.9, 8.0), (" Med ", 0.6, 5.5), ("l", 0.3, 3.0), ("7.126", 1.0, 7.13), ("-1", 0.0, 0.0), ("none", 0.5, 5.0), (None, 0.5, 5.0), ("crit", 0.5, 9.5)])
def test_coercions(spark, value, confidence, cvss):
    row = spark.createDataFrame([(value,)], "v string").select(coerce_confidence(F.col("v")), coerce_cvss(F.col("v"))).first()
    assert tuple(row) == (confidence, cvss)


def test_every_signal_is_counted(spark):
    """A text for each of the 17 signals, and one for two: counts equal those of the names one by one."""
    texts = ["import subprocess", "eval (x)", "pickle.load(f)", "cur.execute(q)", "@app.route('/')", "request.args", "API_KEY = 1", "if is_admin and session", "send_file(p)", "requests.get(u)", "hashlib.md5", "render_template_string(x)", "CORS(app)", "x.innerHTML = y <div", "obj.loads(x)", "ldap.search_s(q)", "resp.set_cookie(k)", "eval(pickle.loads(x))", "", None]
    frame = spark.createDataFrame([(t,) for t in texts], "c string")
    got = frame.agg(*scalars.risk_signal_counts(F.col("c"))).first().asDict()
    want = dict(frame.select(F.explode(risk_reasons(F.col("c"))).alias("s")).groupBy("s").count().collect())
    assert {k: n for k, n in got.items() if n} == want and len(got) == len(fixed.RISK_SIGNALS) == 17
    assert set(want) == set(got)


def test_fingerprint_ignores_lines_and_space_but_not_placeholders(spark):
    rows = spark.createDataFrame([("a", "T", "x  =\n1", 1), ("a", "T", " x = 1 ", 9), ("a", "T", "requires login", 1), ("a", "T", "...", 2), ("a", "T", None, 2)], "p string, t string, s string, l int")
    out = [r[0] for r in rows.select(fingerprint(F.col("p"), F.col("t"), F.col("s"), F.col("l"))).collect()]
    assert out[0] == out[1] and out[2] != out[3] and out[3] == out[4] and len(out[0]) == 16


def test_predicates(spark):
    pairs = [("89", "564", True), ("CWE-89", "89", True), ("89", "79", False), ("", "", False), (None, "89", False)]
    rows = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(cwe_matches(F.col("a"), F.col("b"))).collect()
    assert [bool(r[0]) for r in rows] == [p[2] for p in pairs]
    for exact in (False, True):
        both = spark.createDataFrame([p[:2] for p in pairs], "a string, b string").select(cwe_matches(F.col("a"), F.col("b"), exact), F.coalesce(F.arrays_overlap(cwe_marks(F.col("a"), exact), cwe_marks(F.col("b"), exact)), F.lit(False))).collect()
        assert [bool(x[0]) for x in both] == [x[1] for x in both]
    assert one(spark, normalize_cwe(F.col("a")), a="79") == "CWE-79" and one(spark, normalize_cwe(F.col("a")), a=" ") == "CWE-Unknown"
    agree = lambda a, b: one(spark, types_agree(F.col("a"), F.col("b"), F.lit(""), F.lit("")), a=a, b=b)
    assert agree("SQL_INJECTION", "INJECTION") and agree("INJECTION", "LDAP_INJECTION") and not agree("SQL_INJECTION", "LDAP_INJECTION")
    gap = lambda *x: one(spark, line_distance(*[F.lit(v) for v in x]), z=1)
    assert gap(1, 5, 3, 9) == 0 and gap(1, 1, 13, 13) == 12 and gap(1, 1, 14, 14) is None and gap(9, 2, 12, 1) == 3
    assert one(spark, component_excluded(F.col("p")), p="x/tests/a.py") and one(spark, component_excluded(F.col("p")), p="a.egg-info/x.py") and not one(spark, component_excluded(F.col("p")), p="x/testsuite.py")


def greedy(rows, window=fixed.FUSION_LINES):
    def near(a, b):
        kinds = a[2] == b[2] or any(a[2] in g and b[2] in g for g in fixed.TYPE_ALIASES) or (a[6] and a[6] == b[6])
        return a[1] == b[1] and kinds and max(0, max(a[4], b[4]) - min(a[5], b[5])) <= window

    kept = []
    for r in sorted(rows, key=lambda r: (fixed.SEVERITIES.index(r[3]), -len(r[7]), r[0])):
        if not any(near(k, r) for k in kept):
            kept.append(r)
    return {r[0] for r in kept}


def test_dedup_compares_with_kept_rows_only(spark):
    rows = [finding(k, line=x) for k, x in enumerate((10, 20, 30))]
    assert {r["seq"] for r in fusion.deduplicate(spark.createDataFrame(rows, FINDING)).collect()} == {0, 2}
    rng = random.Random(1)
    kinds = ["SQL_INJECTION", "INJECTION", "LDAP_INJECTION", "CODE_INJECTION"]
    rows = []
    for k in range(300):
        line = rng.randint(1, 400)
        rows.append(finding(k, f"f{rng.randint(0, 2)}.py", rng.choice(kinds), rng.choice(fixed.SEVERITIES), line, line + rng.randint(0, 5), rng.choice(["", "89", "94"]), "d" * rng.randint(0, 3)))
    got = {r["seq"] for r in fusion.deduplicate(spark.createDataFrame(rows, FINDING)).collect()}
    assert got == greedy(rows)


def test_fusion_pairs_nearest_unclaimed(spark):
    rules = spark.createDataFrame([finding(1, line=10), finding(2, line=40, kind="CODE_INJECTION", cwe="94")], FINDING)
    model = spark.createDataFrame([finding(11, line=12, severity="CRITICAL", kind="INJECTION", cwe="", text="told"), finding(12, line=90, kind="PATH_TRAVERSAL", cwe="22")], FINDING)
    out = {r["seq"]: r for r in fusion.fuse(rules, model).collect()}
    assert set(out) == {1, 2, 12}
    assert (out[1]["source"], out[1]["severity"], out[1]["description"], out[1]["start_line"], out[1]["merged_seq"]) == ("CONFIRMED", "CRITICAL", "told", 10, 11)
    assert (out[2]["confidence"], out[12]["confidence"]) == (0.90, 0.55)
    assert {r["seq"] for r in fusion.fuse(rules, model, drop_unconfirmed=True).collect()} == {1, 12}
    empty = spark.createDataFrame([], FINDING)
    assert fusion.fuse(empty, empty).count() == 0


def spread(rng, n, paths, lines):
    kinds = ["SQL_INJECTION", "INJECTION", "LDAP_INJECTION", "CODE_INJECTION"]
    rows = []
    for k in range(n):
        line = rng.randint(1, lines)
        rows.append(finding(k, rng.choice(paths), rng.choice(kinds), rng.choice(fixed.SEVERITIES), line, line + rng.choice([0, 0, 1, 5, 17]), rng.choice(["", "89", "CWE-94"]), "d" * rng.randint(0, 3)))
    return rows


def one_file(a, b):
    a, b = (x.replace("\\", "/").strip().lstrip("./") for x in (a or "", b or ""))
    return not a or not b or a.lower() == b.lower() or ("/" in b and a.endswith("/" + b)) or ("/" in a and b.endswith("/" + a))


def agreeing(a, b, window=fixed.FUSION_LINES):
    numbers = ["".join(c for c in x[6] if c.isdigit()) for x in (a, b)]
    kinds = a[2] == b[2] or any(a[2] in g and b[2] in g for g in fixed.TYPE_ALIASES) or (numbers[0] and numbers[0] == numbers[1])
    gap = max(0, max(a[4], b[4]) - min(a[5], b[5]))
    return gap if one_file(a[1], b[1]) and kinds and gap <= window else None


def walked(rows):
    kept = []
    for r in sorted(rows, key=lambda r: (fixed.SEVERITIES.index(r[3]), -len(r[7]), r[0])):
        if all(agreeing(k, r) is None for k in kept):
            kept.append(r)
    return kept


def paired(rules, models):
    """seq of each kept rule finding and of the model finding that it takes."""
    free, out = walked(models), {}
    taken = set()
    for r in walked(rules):
        near = [(d, k) for k, m in enumerate(free) if m[0] not in taken and (d := agreeing(r, m)) is not None]
        out[r[0]] = free[min(near)[1]][0] if near else None
        taken.add(out[r[0]])
    return out


PATHS = ("/abs/app/a.py", "app/a.py", "./app/A.py", "x/app/a.py", "a.py", "y\\b.py", "y/b.py", "z/y/b.py", "c.py")


@pytest.mark.parametrize("lines", [60, 900])
def test_blocks_of_lines_equal_one_walk(spark, lines):
    """Paths in several forms, spans over block borders, dense and sparse files, blocks of any size."""
    rng = random.Random(lines)
    rows, more = spread(rng, 400, PATHS, lines), spread(rng, 400, PATHS, lines)
    want, pairs = {r[0] for r in walked(rows)}, paired(rows, more)
    a, b = spark.createDataFrame(rows, FINDING), spark.createDataFrame(more, FINDING)
    for block in (1, 1 << 14):  # a block has at least four times what its rows can reach
        assert {r["seq"] for r in fusion.deduplicate(a, block_lines=block).collect()} == want
        out = fusion.fuse(a, b, block_lines=block).collect()
        assert {r["seq"]: r["merged_seq"] for r in out if r["source"] != "LLM"} == pairs
        assert {r["seq"] for r in out if r["source"] == "LLM"} == {r[0] for r in walked(more)} - set(pairs.values())


def test_a_chain_through_many_blocks(spark):
    """Every line of one file has the same finding twice: each kept one depends on all before it."""
    rows = spark.range(6000).selectExpr("id seq", "'a.py' file_path", "'XSS' type", "'HIGH' severity", "cast(id div 2 as int) start_line", "cast(id div 2 as int) end_line", "'79' cwe_id", "'d' description", "'r' rule_id")
    got = sorted(r["start_line"] for r in fusion.deduplicate(rows, block_lines=500).collect())
    assert got == list(range(0, 3000, 13))


def test_blank_paths(spark):
    rows = [finding(0, "a.py", line=5), finding(1, None, line=7), finding(2, " ", line=40)]
    assert {r["seq"] for r in fusion.deduplicate(spark.createDataFrame(rows, FINDING)).collect()} == {0, 2}
    rows += [finding(3, "b.py", line=7)]
    assert {r["seq"] for r in fusion.deduplicate(spark.createDataFrame(rows, FINDING)).collect()} == {0, 1, 2, 3}


def test_a_pair_is_the_models_finding_at_the_rules_place(spark):
    schema = FINDING + ", context string, references array<string>, owasp_category string"
    r = [(*finding(1, line=3, cwe="89", rule="r1"), "import sqlite3", ["a", "b"], "A03"), (*finding(2, line=50, rule="r2"), "run(q)", ["c"], "A03")]
    m = [(*finding(11, line=9, kind="INJECTION", cwe="", severity="CRITICAL", text="said", rule="m"), "db.run(q)", ["b", "z"], ""), (*finding(12, line=52, cwe="564", text="two", rule="m"), "import x", None, "A01")]
    out = {x["seq"]: x for x in fusion.fuse(spark.createDataFrame(r, schema), spark.createDataFrame(m, schema)).collect()}
    one, two = out[1], out[2]
    assert (one["start_line"], one["context"], one["type"], one["cwe_id"], one["owasp_category"], one["references"], one["rule_id"], one["severity"]) == (9, "db.run(q)", "INJECTION", "89", "A03", ["b", "z", "a"], "r1", "CRITICAL")
    assert (two["start_line"], two["context"], two["cwe_id"], two["owasp_category"], two["references"]) == (50, "run(q)", "564", "A01", ["c"])
    assert len(one["fingerprint"]) == 16 and one["fingerprint"] != two["fingerprint"]


def test_overlap_merge_collects_rules(spark):
    rows = [finding(1, line=1, end=4, rule="b"), finding(2, line=3, end=9, rule="a"), finding(3, line=10, rule="c")]
    out = fusion.overlap_merged(spark.createDataFrame(rows, FINDING)).orderBy("start_line").collect()
    assert [(r["start_line"], r["end_line"], r["merged_rule_ids"]) for r in out] == [(1, 9, ["a", "b"]), (10, 10, ["c"])]


def test_suppression(spark):
    code = "\n".join(["x", "# scan: ignore[SQL_INJECTION, CSRF] why", "y", "z  # nosec", "# scan: ignore", "# nosec", "w"])
    files = spark.createDataFrame([("a.py", code), ("b.py", "q\n# scan: ignore-file"), ("c.py", "# scan: ignore\n# scan: ignore[CSRF]\nk")], "path string, content string")
    marks = policy.directives(files)
    at = {(r["path"], r["line"]): r["types"] for r in marks.collect()}
    assert at["a.py", 2] == ["SQL_INJECTION", "CSRF"] == at["a.py", 3] and at["a.py", 4] is None and ("b.py", 0) in at
    assert at["c.py", 2] == ["CSRF"] and at["c.py", 3] == ["CSRF"]
    rows = [finding(1, line=3), finding(2, line=3, kind="XSS"), finding(3, line=4), finding(4, line=1), finding(5, "b.py", line=7), finding(6, line=1, end=2)]
    kept = policy.unsuppressed(spark.createDataFrame(rows, FINDING), marks)
    assert {r["seq"] for r in kept.collect()} == {2, 4}


def test_gate_baseline_and_fix_check(spark):
    rows = spark.createDataFrame([(1, "HIGH", "LLM", "p", "T", "f"), (2, "LOW", "SEMGREP", "q", "T", "f"), (3, "CRITICAL", "SEMGREP", "r", "T", "f")], "seq long, severity string, source string, fingerprint string, type string, file_path string")
    assert {r["seq"] for r in policy.gate(rows, "HIGH").collect()} == {1, 3}
    assert {r["seq"] for r in policy.gate(rows, "HIGH", True).collect()} == {3}
    assert policy.gate(rows, None).count() == 0
    old = spark.createDataFrame([("p", "2020"), ("gone", "2019")], "fingerprint string, first_seen string")
    assert {r["fingerprint"]: r["is_new"] for r in policy.partition_by_baseline(rows, old).collect()} == {"p": False, "q": True, "r": True}
    assert [r["fingerprint"] for r in policy.resolved(rows, old).collect()] == ["gone"]
    assert {r["fingerprint"]: r["first_seen"] for r in policy.updated_baseline(rows, old, F.lit("now")).collect()} == {"p": "2020", "q": "now", "r": "now"}
    assert {r["fingerprint"]: r["state"] for r in policy.fix_check(old, rows).collect()} == {"p": "persistent", "gone": "resolved", "q": "regression", "r": "regression"}


def best_by_trial(pairs):
    ds = sorted({d for d, _, _ in pairs})
    cost = {(d, x): c for d, x, c in pairs}
    best = (0, 0)

    def walk(k, used, n, total):
        nonlocal best
        if k == len(ds):
            best = max(best, (n, -total))
            return
        walk(k + 1, used, n, total)
        for (d, x), c in cost.items():
            if d == ds[k] and x not in used:
                walk(k + 1, used | {x}, n + 1, total + c)

    walk(0, frozenset(), 0, 0)
    return best


def test_matching_is_largest_then_cheapest():
    rng = random.Random(3)
    for _ in range(200):
        pairs = [(d, x, rng.randint(0, 9)) for d, x in itertools.product(range(rng.randint(1, 5)), range(rng.randint(1, 5))) if rng.random() < 0.5]
        found = scoring.least_cost_matching(pairs)
        cost = {(d, x): c for d, x, c in pairs}
        assert (len(found), -sum(cost[p] for p in found)) == best_by_trial(pairs)
        rng.shuffle(pairs)
        again = scoring.least_cost_matching(pairs)
        assert sum(cost[p] for p in again) == sum(cost[p] for p in found)


def test_outcomes_split_false_positives(spark):
    d = spark.createDataFrame([(1, "a", 10, "89", "T", "S"), (2, "a", 11, "89", "T", "S"), (3, "a", 50, "89", "T", "S"), (4, "a", 10, "79", "T", "S"), (5, "clean", 1, "89", "T", "S")], "d long, file string, line int, cwe string, type string, source string")
    y = spark.createDataFrame([(1, "a", 10, "564", "T", "n"), (2, "b", 1, "22", "T", "n")], "l long, file string, line int, cwe string, type string, note string")
    matched = scoring.match(scoring.candidate_pairs(d, y))
    clean = spark.createDataFrame([("clean",)], "file string")
    out = {r["d"]: r["outcome"] for r in scoring.outcomes(d, y, matched, clean).collect()}
    assert out == {1: "true_positive", 2: "duplicate", 3: "wrong_line", 4: "wrong_type", 5: "clean"}
    recall = {r["cwe"]: (r["total"], r["tp"], r["recall"]) for r in scoring.per_cwe(y, matched).collect()}
    assert recall == {"564": (1, 1, 1.0), "22": (1, 0, 0.0)}


def test_chains_follow_the_seed_only(spark):
    schema = "scope string, seq long, file_path string, type string, start_line int, description string, impact string, cvss_score double"
    rows = [("s", 1, "a", "SQL_INJECTION", 1, "", "", None), ("s", 2, "a", "BROKEN_AUTHENTICATION", 500, "", "", None), ("s", 3, "b", "BROKEN_ACCESS_CONTROL", 1, "", "", None), ("s", 4, "z", "XSS", 1, "", "", None)]
    f = spark.createDataFrame(rows, schema)
    pairs = chains.related_pairs(f)
    assert {(r["a"], r["b"]): r["score"] for r in pairs.collect()} == {(1, 2): 2.5, (1, 3): 2.0, (2, 3): 2.0}
    members = chains.chains(f, pairs.where("not (a = 1 and b = 3)"))
    assert {(r["chain"], r["seq"]) for r in members.collect()} == {(1, 1), (1, 2), (3, 3), (3, 2)}
    facts = chains.chain_facts(members.join(f.select("seq", F.when(F.col("seq") == 1, "HIGH").otherwise("LOW").alias("severity")), "seq")).where("chain = 1").first()
    assert (facts["size"], facts["value"], facts["priority"]) == (2, 4.8, 4)
    need = spark.createDataFrame([("CSRF", "needs login and user input", "bypass", 8.0)], "t string, d string, i string, c double").select(chains.prerequisites(F.col("t"), F.col("d"), F.col("i"), F.col("c"))).first()[0]
    assert need == sorted(["Active user session", "Predictable form structure", "Valid authentication credentials", "User interaction", "No special access required (High severity)", "Knowledge of security mechanism"])


def test_related_findings_count_every_pair(spark, monkeypatch):
    rng = random.Random(8)
    kinds = [(t, d) for t in ("SQL_INJECTION", "CSRF", "HARDCODED_CREDENTIALS", "SENSITIVE_DATA_EXPOSURE", "XSS") for d in (f"{t} found", "a session token", None)]
    rows = [(k, rng.choice("st"), rng.choice("abc"), *rng.choice(kinds), rng.randint(1, 60), "", rng.choice([None, 8.0])) for k in range(150)]
    f = spark.createDataFrame(rows, "seq long, scope string, file_path string, type string, description string, start_line int, impact string, cvss_score double")
    want = chains.related_pairs(f).groupBy("scope", "score").count().collect()
    assert {(r["scope"], r["score"]): r["pairs"] for r in chains.related_counts(f).collect()} == {(r["scope"], r["score"]): r["count"] for r in want}
    monkeypatch.setattr(queries, "findings", lambda *_: f)
    alone = f.withColumn("scope", F.col("file_path")).withColumn("cvss_score", F.lit(None).cast("double"))
    want = chains.related_pairs(alone).groupBy("score").agg(F.count(F.lit(1)), F.count_distinct("scope")).collect()
    assert sorted(map(tuple, queries.related_findings(spark, "").collect())) == sorted(map(tuple, want))


def test_payload_shapes(spark):
    item = {"type": "T"}
    shapes = [{"result": {"findings": [item]}}, {"result": [item]}, {"findings": [item]}, {"vulnerabilities": [item]}, {"reports": [{"vulnerabilities": [item]}]}, {"results": [{"raw_findings": [item]}]}, {"results": [item]}, {"runs": [{"results": [item]}]}, [item]]
    raw = spark.createDataFrame([(k, json.dumps(x)) for k, x in enumerate(shapes)] + [(99, "not json")], "id int, json string")
    out = tables.payload_findings(raw).select("id", F.try_variant_get("finding", "$.type", "string").alias("t")).collect()
    assert {(r["id"], r["t"]) for r in out} == {(k, "T") for k in range(len(shapes))}


def test_discover_and_ranges(spark, tmp_path):
    (tmp_path / "pkg" / "tests").mkdir(parents=True)
    (tmp_path / "pkg" / "a.py").write_bytes(b"import subprocess\n# \xff\n")
    (tmp_path / "pkg" / "tests" / "b.py").write_text("eval(1)")
    (tmp_path / "pkg" / "blank.py").write_text("  ")
    (tmp_path / "pkg" / "c.txt").write_text("x")
    rows = tables.discover(spark, str(tmp_path)).collect()
    assert [(r["path"].split("pkg/")[-1], r["risk"]) for r in rows] == [("a.py", 4)] and "�" in rows[0]["content"]
    lines = tables.numbered_lines(spark.createDataFrame([("a", "1\n2\n3\n")], "path string, content string"))
    assert lines.count() == 4
    want = spark.createDataFrame([("a", 2, 9)], "path string, start_line int, end_line int")
    assert [r["text"] for r in tables.line_range(lines, want, 2).orderBy("line").collect()] == ["2", "3"]


def test_evidence_and_logs(spark, tmp_path):
    e = spark.createDataFrame([("e1", "a", "h", 3), ("e2", "a", "old", 3), ("e3", "b", "h", 1), ("e4", "a", "h", 9)], "evidence_id string, path string, content_hash string, end_line int")
    now = spark.createDataFrame([("a", "h", 5)], "path string, sha256 string, n_lines int")
    states = reports.evidence_state(e, now)
    assert {r["evidence_id"]: r["state"] for r in states.collect()} == {"e1": "valid", "e2": "changed", "e3": "missing", "e4": "out_of_range"}
    a = spark.createDataFrame([("f1", "supported", ["e1"]), ("f2", "refuted", ["e1", "e2"]), ("f3", "uncertain", ["e3"])], "finding_id string, status string, evidence_ids array<string>")
    assert [r["finding_id"] for r in reports.stale_assessments(a, states).collect()] == ["f2"]
    sinks.append_log(a, "assessment", str(tmp_path / "log"))
    sinks.append_log(e, "event", str(tmp_path / "log"))
    assert tables.audit_records(spark.read.json(str(tmp_path / "log")), "assessment").count() == 3


def test_sinks(spark):
    rows = spark.createDataFrame([finding(2, severity="LOW", text="second"), finding(1, severity="CRITICAL", text="first")], FINDING).withColumn("source", F.lit("LLM")).withColumn("scan", F.lit("s"))
    document = json.loads(sinks.scan_documents(rows, "scan").first()["document"])
    assert document["total"] == 2 and [f["seq"] for f in document["findings"]] == [1, 2]
    assert tuple(sinks.sarif_rules(rows).first()) == ("SQL_INJECTION", "first", "error")
    result = json.loads(sinks.sarif_results(rows).orderBy("seq").first()["result"])
    assert result["level"] == "error" and result["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] == "a.py"


def test_matching_by_runs_equals_matching_by_file(spark):
    rng = random.Random(8)
    d = [(k, "f", rng.randint(1, 60), "89", "T", "S") for k in range(25)]
    y = [(k, "f", rng.randint(1, 60), "89", "T", "n") for k in range(25)]
    pairs = scoring.candidate_pairs(spark.createDataFrame(d, "d long, file string, line int, cwe string, type string, source string"), spark.createDataFrame(y, "l long, file string, line int, cwe string, type string, note string"))
    cost = {(r["d"], r["l"]): r["cost"] for r in pairs.collect()}
    got = [(r["d"], r["l"]) for r in scoring.match(pairs).collect()]
    want = scoring.least_cost_matching([(a, b, c) for (a, b), c in cost.items()])
    assert len(got) == len(want) and sum(cost[p] for p in got) == sum(cost[p] for p in want)


def test_signal_words_lose_no_match(spark):
    assert set(scalars.SIGNAL_WORDS) == {n for _, _, n in fixed.RISK_SIGNALS}
    rng = random.Random(11)
    parts = ["subprocess", "os.system", "OS.POPEN", "eval (", "exec(", "compile(", "pickle", "marshal", "yaml.load (", "shelve", ".execute(", "raw (", "cursor", "SELECT", "insert", "@app.route", "@bp.post", "request.args", "request.JSON", "password", "ſecret", "toKen", "api_key", "credentials", "auth", "login", "permission", "is_admin", "session", "open(", "Path (", "send_file", "sendfile", "requests.", "urllib", "httpx", "aiohttp", "hashlib", "crypt", "cipher", "random.", "render_template_string", ".innerHTML", "mark_safe", "| safe", "permissions", "CORS", "allow_origins", "HTML (", "render_output", "<div", "<HTML", ".loads(", ".unserialize (", ".unpickle(", ".decode_payload", "serial", "pcrypt", "ldap", "search_s", "xpath", ".xpath(", "set_cookie", "Set-Cookie", "secure = False", "x", "é", "_", "1"]
    texts = [*parts, *("".join(rng.choice(parts) + rng.choice([" ", "", "\n", "."]) for _ in range(rng.randint(1, 4))) for _ in range(300))]
    rows = spark.createDataFrame([(t,) for t in texts], "c string")
    plain = F.array_compact(F.array(*[F.when(F.rlike("c", F.lit("(?iu)" + p)), F.lit(n)) for p, _, n in fixed.RISK_SIGNALS]))
    assert rows.where(~F.col("c").isNull() & (risk_reasons(F.col("c")) != plain)).collect() == []
    met = {n for r in rows.select(F.explode(plain)).distinct().collect() for n in r}
    assert met == set(scalars.SIGNAL_WORDS)


def test_keys_of_findings_never_clash(spark):
    """Lines beyond 100,000, far ids and null ids: each finding has a key of its own, in the order of documents, lines and rules."""
    docs = [(1, "x\n" * 100_000 + "a!!b ###"), (2, "!!"), (None, "!!\n###"), (-5, "!!"), (2**63 - 1, "!!\n!!")]
    files = tables.documents_as_files(spark.createDataFrame([(i, t, None, None) for i, t in docs], "doc_id long, text string, lang string, source string"))
    rows = queries.detect(tables.numbered_lines(files)).collect()
    keys = {(r["file_path"], r["start_line"], r["rule_id"]): r["seq"] for r in rows}
    assert len(rows) == len(keys) == len(set(keys.values())) == 8 and None not in keys.values()
    assert [k[0].split("/")[-1] for k in sorted(keys, key=keys.get)] == ["null.txt"] * 2 + ["-5.txt"] + ["1.txt"] * 2 + ["2.txt"] + [f"{2**63 - 1}.txt"] * 2


def test_detectors_look_for_fixed_texts_as_bytes(spark):
    assert {p: queries.needed(p) for p in ("###", "[|]", "[a-z]@[a-z]", "[0-9]{3}", "[*]{2}a", "a+b", "x|y")} == {"###": ("###", True), "[|]": ("|", True), "[a-z]@[a-z]": ("@", False), "[0-9]{3}": ("", False), "[*]{2}a": ("a", False), "a+b": ("", False), "x|y": ("", False)}
    rng = random.Random(5)
    parts = ['token = "', "token =", "a@b", "@", "A@", "1.2.3.4", "1.2.3", "!!", "!", "###", "##", "|", "***", "**", "12", "345", "ABCDEF", "ABCDE", "License", "icense", "licens", "é", " ", ""]
    lines = spark.createDataFrame([("".join(rng.choices(parts, k=rng.randint(0, 4))),) for _ in range(500)] + [(None,)], "t string")
    for _, p, *_ in queries.RULES + queries.MODEL:
        assert lines.where(~queries.holds(F.col("t"), p).eqNullSafe(F.rlike("t", F.lit(p)))).isEmpty()


@pytest.mark.parametrize("query", [queries.detection_outcomes, scans.scan_scores, queries.related_findings, scans.verified_findings])
def test_findings_are_detected_once(spark, sf, query):
    # what follows reads stored findings and cuts no document into lines again
    assert "posexplode" not in query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_fusion_finds_its_files_in_stored_findings(spark, sf, monkeypatch):
    seen = []
    monkeypatch.setattr(fusion, "placed", lambda rows: seen.append(rows.inputFiles()) or firstcome.placed(rows))
    queries.two_tier_fusion(spark, sf)
    assert len(seen) == 1 and not any("documents" in f for f in seen[0])


def test_a_call_of_the_matching_takes_many_runs(spark, monkeypatch):
    pairs = spark.createDataFrame([(k, k + n, f"f{k % 7}", 5 + n, k, k) for k in range(0, 300, 2) for n in (0, 1)], "d long, l long, file string, cost long, low int, high int")
    matched = scoring.match(pairs)
    assert matched.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert {(r["d"], r["l"]) for r in matched.collect()} == {(k, k) for k in range(0, 300, 2)}
    monkeypatch.setattr(scoring, "ROWS", 20)
    assert scoring.match(pairs).rdd.getNumPartitions() == 15
