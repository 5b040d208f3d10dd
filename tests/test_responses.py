import json

from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.operators import repair
from fathomline.sources import responses
from fathomline.sources.cut_json import brackets

ITEM = {"type": "SQL injection", "severity": "high", "location": {"start_line": 4, "end_line": 6}, "description": "d", "cwe": "CWE-89", "fix": "use parameters"}


def parsed(spark, *texts):
    raw = spark.createDataFrame([(f"f{k}", t) for k, t in enumerate(texts)], "file string, response string")
    rows = responses.findings_of(responses.response_items(raw)).orderBy("file_path", "place").collect()
    return [[r for r in rows if r["file_path"] == f"f{k}"] for k in range(len(texts))]


def test_responses_in_all_shapes(spark):
    body = json.dumps({"vulnerabilities": [ITEM, {"vulnerability_type": "XSS", "location": "sink at line 12", "line": 3}]})
    cut = body[: body.index(', {"vuln') + 30]
    out = parsed(spark, body, f"<think>{{1}}</think>\nSure:\n```json\n{body}\n```", "{'x'", body.replace("}]", "},]"), '{"findings": [{"type": "RACE_CONDITION", "safe": False, "n": None}]}', cut, "nothing here", None, json.dumps([ITEM]))
    for rows in (out[0], out[1], out[3]):
        assert [(r["type"], r["severity"], r["start_line"], r["end_line"], r["cwe_id"], r["remediation"]) for r in rows] == [("SQL_INJECTION", "HIGH", 4, 6, "CWE-89", "use parameters"), ("CROSS_SITE_SCRIPTING", "MEDIUM", 12, 12, "CWE-79", "")]
    assert [(r["type"], r["cwe_id"]) for r in out[4]] == [("RACE_CONDITION", "CWE-Other")] and out[2] == out[6] == out[7] == []
    assert [(r["type"], r["start_line"], r["salvaged"]) for r in out[5]] == [("SQL_INJECTION", 4, True)] and len(out[8]) == 1


def stacked(text):
    """A plain stack parser: every object that the text holds whole, and the text closed behind the last of them."""
    decoder, found = json.JSONDecoder(), []
    for k, c in enumerate(text):
        if c == "{":
            try:
                found.append((decoder.raw_decode(text, k)[1], k))
            except ValueError:
                pass
    if not found:
        return [], None
    end, stack, quoted, k = max(found)[0], [], False, 0
    while k < end:
        c = text[k]
        if quoted and c == "\\":
            k += 1
        elif c == '"':
            quoted = not quoted
        elif not quoted and c in "{[":
            stack.append("}" if c == "{" else "]")
        elif not quoted and c in "}]":
            stack.pop()
        k += 1
    return sorted(found), text[:end] + "".join(reversed(stack)) if stack else None


def test_answers_cut_at_any_byte():
    deep = {"vulnerabilities": [{"type": "A", "severity": "LOW", "location": {"a": {"b": {"c": '}"]{\\'}}, "l": [1, {"z": []}]}}, {"type": "B\"{", "severity": "x", "e": {}, "p": [[{}]]}]}
    body = json.dumps(deep)
    for k in range(len(body) + 1):
        outer, closed, objects = brackets(body[:k])
        found, want = stacked(body[:k])
        assert sorted(objects) == sorted(body[a:b] for b, a in found)
        assert (outer is not None) == (k == len(body)) and closed == want
        assert closed is None or isinstance(json.loads(closed), dict)
    assert brackets('so "quoted: {"a": 1} ] and {"b": [2') == ('{"a": 1}', None, ['{"a": 1}'])


def test_deep_and_cut_answers(spark):
    item = {"type": "SQL_INJECTION", "severity": "LOW", "location": {"start_line": 3, "more": {"deep": {"er": [1, {"x": "}"}]}}}}
    other = item | {"type": "XSS"}
    body = json.dumps({"vulnerabilities": [item, other, item]})
    broken = "so: " + json.dumps(item) + " and {'oops " + json.dumps(other) + json.dumps(item) + json.dumps({"type": "NOT", "note": 1})
    out = parsed(spark, body, body[: body.index("XSS") + 9], "Sure, " + body + " as asked }", broken, '{"vulnerabilities": []}', "{" * 50)
    assert [[(r["type"], r["start_line"], r["salvaged"]) for r in x] for x in out[:2]] == [[("SQL_INJECTION", 3, False), ("CROSS_SITE_SCRIPTING", 3, False), ("SQL_INJECTION", 3, False)], [("SQL_INJECTION", 3, True)]]
    assert len(out[2]) == 3 and [r["type"] for r in out[3]] == ["SQL_INJECTION", "CROSS_SITE_SCRIPTING"] and out[4] == out[5] == []


def test_types_scores_and_cwes_of_models(spark):
    told = [("sqli", None, None), ("Cross-Site Request Forgery", "None", "crit"), ("odd thing", None, 3), ("odd thing", "CWE-601", "CVSS:3.1/AV:N/AC:L/C:H/I:M/A:N"), ("CWE_643 thing", None, "x"), ("Use of eval", "CWE-Other", 70), ("SERVER_SIDE_REQUEST_FORGERY_(SSRF)", "CWE-918", "CVSS:4/C:H/I:H/A:H/AV:H"), ("RACE_CONDITION", "CWE-000", "7.25"), ("xpath walk", None, None), (None, None, None)]
    items = [{"type": t, "cwe": c, "cvss_score": v, "severity": "odd", "references": ["r"], "proof_of_concept": "p"} for t, c, v in told]
    rows = parsed(spark, json.dumps(items))[0]
    assert [(r["place"], r["type"], r["cwe_id"], r["cvss_score"]) for r in rows] == [(0, "SQL_INJECTION", "CWE-89", 5.0), (1, "CSRF", "CWE-352", 9.5), (3, "UNVALIDATED_REDIRECTS_AND_FORWARDED_REQUESTS", "CWE-601", 6.3), (4, "XPATH_INJECTION", "CWE-643", 5.0), (5, "CODE_INJECTION", "CWE-94", 10.0), (6, "SERVER_SIDE_REQUEST_FORGERY", "CWE-918", 10.0), (7, "RACE_CONDITION", "CWE-000", 7.25), (8, "PATH_TRAVERSAL", "CWE-22", 5.0)]
    assert {(r["severity"], tuple(r["references"]), r["proof_of_concept"]) for r in rows} == {("MEDIUM", ("r",), "p")}


def test_verdicts(spark):
    told = {
        '{"verdict": "False_Positive"}': "refuted",
        "This call is vulnerable.": "confirmed",
        None: "error",
        '```json\n{"verdict": "confirmed",}\n```': "confirmed",
        "hm": "error",
        "This call is unsafe.": "error",
        "The code is not vulnerable.": "refuted",
        "It remains unconfirmed.": "error",
        '{"verdict": "unsafe"}': "uncertain",
        '{"status": " TP "}': "confirmed",
        "Confirmed, the finding is incorrect": "refuted",
    }
    rows = spark.createDataFrame(list(enumerate(told)), "k int, t string")
    assert [r["v"] for r in rows.select("k", responses.verdict(F.col("t")).alias("v")).orderBy("k").collect()] == list(told.values())


def test_taint_pairs_touch_within_a_line(spark):
    steps = spark.createDataFrame([(1, "a/x.py", 10, "source"), (2, "b/X.py", 12, "sink"), (3, "x.py", 20, "step"), (4, "y.py", 10, "step"), (5, "x.py", 0, "step")], "seq long, file string, line int, kind string")
    assert {tuple(r) for r in repair.taint_pairs(steps).collect()} == {(1, 2)}


def test_patch_plan_and_result(spark):
    code = "def f():\n    a = 1\n    b = 2\n    c = 3\nend"
    files = spark.createDataFrame([("m.py", code)], "path string, content string")
    rows = [(1, "m.py", 2, 2, "a = 9", None), (2, "m.py", 3, 4, "```python\nb = 8\nif b:\n    return True\n```", None), (3, "m.py", 2, 3, "zz", None), (4, "no.py", 1, 1, "x", None), (5, "m.py", 9, 9, "x", None), (6, "m.py", 5, 5, "end", None), (7, "m.py", 1, 1, "", None), (8, "m.py", 1, 1, "x", "old"), (9, "m.py", 1, 2, "zz", None), (10, "m.py", 1, 1, "def g():", None)]
    plan = repair.patch_plan(spark.createDataFrame(rows, "seq long, file_path string, start_line int, end_line int, secure_code_example string, file_hash string"), files)
    got = {r["seq"]: r for r in plan.collect()}
    assert {k: r["rejected"] for k, r in got.items()} == {1: None, 2: None, 3: "overlaps", 4: "file not found", 5: "past end of file", 6: "identical", 7: "no suggestion", 8: "stale", 9: "overlaps", 10: None}
    assert repair.patched(files, plan).first()["content"] == "def g():\n    a = 9\n    b = 8\n    if b:\n        return True\nend"
    reasons = plan.where("seq = 2").select(repair.risk_reasons(F.col("original"), F.col("replacement"))).first()[0]
    assert reasons == [fixed.PATCH_REASONS[k] for k in (3, 4, 5)]
    last = repair.patch_plan(spark.createDataFrame([(1, "m.py", 5, 5, "fin", None)], "seq long, file_path string, start_line int, end_line int, secure_code_example string, file_hash string"), files)
    assert repair.patched(files, last).first()["content"] == code[:-3] + "fin"
    new = repair.patched(files, last)
    backups = new.select("path", F.lit(code).alias("content"), F.sha2("content", 256).alias("written_hash"))
    assert repair.reverted(new, backups).count() == 1 and repair.reverted(files, backups).count() == 0


def test_budget_counts_distinct_lines(spark):
    rows = [("s", 0, k, k // 2, k) for k in range(10)]
    kept = repair.within_budget(spark.createDataFrame(rows, "slice string, priority int, distance int, line int, id int"), 3)
    assert {r["id"] for r in kept.collect()} == set(range(6))


def test_reasons_of_patches(spark):
    """The values that no one meant, flow, imports, constants and no-ops, each against a plain reading."""
    pairs = [
        ("x = open(p)", "x = open('/path/to/file')"), ("x = 1", "x = <name>"), ("k = v", "k = CHANGE_ME"), ("u = h", "u = 'https://example.com'"), ("a\n\nb", "a\n\t\nb\nc\nd\ne"), ("import os\nx", "import os\nimport re\nfrom a import b\nimport z\nx"),
        ("x()", "def f():\n    x()"), ("x()", "class A:\n    x = 1"), ("x()", "    match x:\n        y"), ("return f(x)", "return True"), ("f(x)", "pass"), ("return 1", "return 'a'"), ("pass", "pass"), ("", ""), (None, None), ("TODO", "TODO todo"),
    ]
    told = [fixed.PATCH_REASONS[k] for k in range(7)]
    want = [
        [told[0]], [told[0]], [told[0]], [told[0]], ["expands 2 line(s) into 5"], ["expands 2 line(s) into 5", "introduces import(s): import re, from a import b"],
        [told[3]], [told[3]], [], [told[5]], [told[6]], [], [], [], [], [told[0]],
    ]
    rows = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "k int, a string, b string").select("k", repair.risk_reasons(F.col("a"), F.col("b")).alias("r")).orderBy("k").collect()
    assert [r["r"] for r in rows] == want
