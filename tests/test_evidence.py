"""Evidence, assessment policy, taint paths, patches, and recorded sources."""

import pytest
from pyspark.sql import functions as F

from fathomline.operators import evidence
from fathomline.sources import recorded
from fathomline.sources.syntax import syntax_rows
from fathomline.sources.tables import numbered_lines

TEXT = "a = 1\nb = 2\nc = 3\n"


def test_issue(spark):
    files = spark.createDataFrame([("a.py", TEXT), ("new.py", "x"), ("old.py", "y")], "path string, content string")
    shots = files.where("path <> 'new.py'").select(F.lit("s1").alias("snapshot_id"), "path", F.sha2(F.when(F.col("path") == "old.py", "z").otherwise(F.col("content")), 256).alias("sha256"))
    rows = [(1, "s1", "a.py", 1, 2, None), (2, "s0", "a.py", 1, 1, None), (3, "s1", "none.py", 1, 1, None), (4, "s1", "new.py", 1, 1, None), (5, "s1", "old.py", 1, 1, None), (6, "s1", "a.py", 3, 4, None), (7, "s1", "a.py", 1, 1, "a = 2"), (8, "s1", "a.py", 1, 2, "a = 1\r\nb = 2\n"), (9, "s1", "a.py", 0, 1, None)]
    out = {r["request"]: r for r in evidence.issue(spark.createDataFrame(rows, "request int, snapshot_id string, path string, start_line int, end_line int, content string"), shots, files).collect()}
    assert [out[k]["state"] for k in range(1, 10)] == ["valid", "no snapshot", "no file", "not in snapshot", "changed", "out of range", "fabricated", "valid", "out of range"]
    assert out[1]["content"] == "a = 1\nb = 2" and out[1]["evidence_id"] == out[8]["evidence_id"] and len(out[1]["evidence_id"]) == 17 and out[2]["evidence_id"] is None


def test_policy(spark):
    proof = spark.createDataFrame([("e1", "s", "a.py", 1, 9, "valid"), ("e2", "s", "b.py", 1, 9, "changed"), ("e3", "t", "a.py", 1, 9, "valid")], "evidence_id string, snapshot_id string, path string, start_line int, end_line int, state string")
    path = [("source", "a.py", 2, "e1"), ("Imported-Sink", None, 9, "e1")]
    rows = [
        ("good", "SQL_INJECTION", "s", " Supported", ["e1"], None, None, path),
        ("no path", "SQL_INJECTION", "s", "supported", ["e1"], None, None, None),
        ("no sink", "SQL_INJECTION", "s", "supported", ["e1"], None, None, path[:1]),
        ("bad line", "SQL_INJECTION", "s", "supported", ["e1"], None, None, [("source", "a.py", 2, "e1"), ("sink", "a.py", 10, "e1")]),
        ("bad file", "SQL_INJECTION", "s", "supported", ["e1"], None, None, [("source", "c.py", 2, "e1"), ("sink", "./a.py", 9, "e1")]),
        ("bad kind", "T", "s", "supported", ["e1"], None, None, [("?", "a.py", 2, "e1")]),
        ("plain", "T", "s", "supported", ["e1"], None, None, None),
        ("stale", "T", "s", "supported", ["e1", "e2"], None, None, None),
        ("other snapshot", "T", "s", "supported", ["e3"], None, None, None),
        ("none", "T", "s", "supported", [], None, None, None),
        ("lost", "T", "x", "supported", ["e1"], None, None, None),
        ("refuted", "T", "s", "refuted", ["e1"], "escaped", "e1", None),
        ("no control", "T", "s", "refuted", ["e1"], " ", None, None),
        ("other control", "T", "s", "refuted", ["e1"], "escaped", "e2", None),
        ("odd", "T", "s", "maybe", None, None, None, None),
    ]
    schema = "finding_id string, type string, snapshot_id string, verdict string, evidence_ids array<string>, control string, control_evidence_id string, taint_path array<struct<kind: string, file: string, line: int, evidence_id: string>>"
    out = {r["finding_id"]: (r["status"], r["notes"]) for r in evidence.assess(spark.createDataFrame(rows, schema), proof, proof.select("snapshot_id")).collect()}
    assert out["good"] == ("supported", []) and out["plain"] == ("supported", []) and out["refuted"] == ("refuted", []) and out["odd"] == ("uncertain", [])
    want = {"no path": "no taint path", "no sink": "taint path without source and sink", "bad line": "step out of its evidence", "bad file": "step in another file", "bad kind": "step of no known kind", "stale": "unsound evidence cited", "other snapshot": "unsound evidence cited", "none": "no evidence cited", "no control": "no mitigating control", "other control": "control on other evidence"}
    for name, note in want.items():
        assert out[name] == ("uncertain", [note]), name
    assert out["lost"][0] == "uncertain" and out["lost"][1][0] == "snapshot not found"


def test_taint_steps_get_their_code(spark):
    lines = numbered_lines(spark.createDataFrame([("a.py", TEXT)], "path string, content string"))
    steps = spark.createDataFrame([(1, 0, None, "", 1, "a.py"), (1, 1, "propagator", "a.py", 2, "a.py"), (1, 2, "?", None, 9, "a.py"), (2, 0, "sink", "b.py", 1, "a.py"), (3, 0, None, "a.py", 1, "a.py")], "seq long, pos int, kind string, file string, line int, default_file string")
    out = {(r["seq"], r["pos"]): (r["kind"], r["file"], r["code"]) for r in evidence.enriched_taint(steps, lines, 1).collect()}
    assert out == {(1, 0): ("source", "a.py", "> 1: a = 1\n  2: b = 2"), (1, 1): ("propagation", "a.py", "  1: a = 1\n> 2: b = 2\n  3: c = 3"), (1, 2): ("sink", "a.py", None), (2, 0): ("sink", "b.py", None), (3, 0): ("source", "a.py", "> 1: a = 1\n  2: b = 2")}


def test_patches(spark):
    files = spark.createDataFrame([("a.py", TEXT), ("a.txt", TEXT)], "path string, content string")
    plan = spark.createDataFrame([(1, "a.py", 2, 2, "b = (", None), (2, "a.py", 2, 3, "b = 5", None), (3, "a.txt", 1, 1, "(", None), (4, "a.py", 1, 1, "(", "overlaps")], "seq long, file_path string, start int, end int, replacement string, rejected string")
    out = {r["seq"]: r["rejected"] for r in evidence.parse_checked(plan, files).collect()}
    assert out[1].startswith("breaks the file, line 2") and (out[2], out[3], out[4]) == (None, None, "overlaps")
    diff = spark.createDataFrame([("a\nb\n", "a\nc\n"), (None, "x")], "a string, b string").select(evidence.unified_diff(F.col("a"), F.col("b"), F.lit("p")).alias("d")).collect()
    assert diff[0]["d"] == "--- p (current)\n+++ p (proposed)\n@@ -1,2 +1,2 @@\n a\n-b\n+c\n" and "+x" in diff[1]["d"]


def test_slices_and_definitions(spark):
    slices = spark.createDataFrame([("a", s, line) for s in range(1, 15) for line in ({s, 1} if s != 3 else {1, 2})], "path string, sink_line int, line int")
    out = evidence.first_slices(slices).orderBy("place").collect()
    assert len(out) == 10 and [r["sink_line"] for r in out] == [1, 2, 4, 5, 6, 7, 8, 9, 10, 11]
    files = spark.createDataFrame([("a.py", "def f():\n    pass\n\nclass K:\n    def f(self):\n        return 1\n"), ("b.py", "x = 1\n")], "path string, content string")
    got = {(r["path"], r["line"]): (r["kind"], r["source"]) for r in evidence.definitions(syntax_rows(files), numbered_lines(files), "f").collect()}
    assert got == {("a.py", 1): ("function", "def f():\n    pass"), ("a.py", 5): ("function", "    def f(self):\n        return 1")}
    assert evidence.definitions(syntax_rows(files), numbered_lines(files), "f", path="b.py").count() == 0


def test_recorded_sources(spark, tmp_path):
    status = spark.createDataFrame([(x,) for x in ("M\ta.py", "A\tb.txt", "D\tc.py", "R100\told.py\tnew.py", "?? d/e.py", "M\ta.py", "")], "value string")
    assert {r["path"] for r in recorded.changed_files(status).collect()} == {"a.py", "new.py", "d/e.py"}
    paths = {"a/b.py": True, "../x.py": False, "a/../../x.py": False, "a/../b.py": True, "/etc/x.py": False, "": False, None: False, "C:\\x.py": False}
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(paths)], "k int, path string")
    assert [r[0] for r in rows.orderBy("k").select(recorded.confined(F.col("path"))).collect()] == list(paths.values())
    assert {r["path"] for r in recorded.listed(rows.unionByName(spark.createDataFrame([(9, "tests/t.py"), (10, "a/b.py")], "k int, path string"))).collect()} == {"a/b.py", "a/../b.py"}
    assert {r["path"] for r in recorded.above_depth(spark.createDataFrame([("a.py",), ("d/a.py",), ("d/e/a.py",)], "path string"), 2).collect()} == {"a.py", "d/a.py"}
    doc = spark.createDataFrame([([("/r/a.py", 3, (78,), "t"), ("/else/b.py", 1, None, None)], [("/r/c.py", "syntax")])], "results array<struct<filename: string, line_number: int, issue_cwe: struct<id: int>, test_name: string>>, errors array<struct<filename: string, reason: string>>")
    found, errors = recorded.tool_findings(doc, "/r")
    assert [tuple(r) for r in found.collect()] == [(0, "a.py", 3, "78", "t", "bandit")] and [tuple(r) for r in errors.collect()] == [("c.py", "syntax")]
    jobs = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, updated_at int, status string")
    assert [tuple(r) for r in recorded.new_jobs(jobs, jobs.where("id = 'b'")).collect()] == [("a", 2, "y")]
    csv = tmp_path / "expected.csv"
    csv.write_text("# test name, category, real vulnerability, cwe\nT1,sqli,true,89\nT2, xss ,FALSE, 79\n\n")
    assert sorted(tuple(r) for r in recorded.expected_results(spark, str(csv)).collect()) == [("T1", "sqli", True, "89"), ("T2", "xss", False, "79")]
    out = str(tmp_path / "out")
    recorded.summary_csv(jobs, out, "id", "status")
    assert spark.read.option("header", "true").csv(out).count() == 3


@pytest.mark.parametrize("kind", ["source", " SINK ", "sanitise", "other", None])
def test_step_kinds(spark, kind):
    want = {"source": "source", " SINK ": "sink", "sanitise": "sanitizer"}.get(kind)
    assert spark.createDataFrame([(kind,)], "k string").select(evidence.step_kind(F.col("k"))).first()[0] == want
