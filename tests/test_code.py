import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomline.operators import code
from fathomline.sources import syntax
from fathomline.sources.syntax import syntax_rows

FILES = {
    "app/main.py": """import subprocess as sp
from subprocess import run
from .db import query as q, helper
import hashlib

LIMIT = 3

def go(cmd, flag):
    full = "x" + cmd
    unused = 1
    if flag:
        full = full + "y"
    run(full, shell=True)
    sp.Popen(full, shell=False)
    hashlib.new("md5")
    return open(full)

class K:
    def m(self, a):
        go(a, True)
""",
    "app/db.py": """from app.base import *

def query(cur, name):
    cur.execute("select " + name)
    cur.execute(f"{name}")
    cur.execute("select 1")
    resp.set_cookie("k", "v")
""",
    "app/base.py": "from app.db import query\n\ndef helper(x):\n    eval(x)\n\ndef outer(y):\n    helper(y)\n",
    "app/loop.py": "def f(a):\n    x = 0\n    while a:\n        eval(x)\n        x = a\n",
    "bad.py": "def (:",
    "empty.py": "",
}


@pytest.fixture(scope="module")
def rows(spark):
    return syntax_rows(spark.createDataFrame(list(FILES.items()), "path string, content string")).cache()


def test_rules_follow_import_names(rows):
    hits = code.rule_hits(code.resolved_calls(rows))
    got = {(r["path"], r["line"], r["rule_id"]) for r in hits.collect()}
    assert got == {
        ("app/main.py", 13, "python-insecure-subprocess-shell"),
        ("app/main.py", 15, "python-weak-hashing"),
        ("app/main.py", 16, "python-path-traversal-open"),
        ("app/db.py", 4, "python-sql-injection"),
        ("app/db.py", 5, "python-sql-injection"),
        ("app/db.py", 7, "python-insecure-cookie"),
        ("app/base.py", 4, "python-insecure-eval"),
        ("app/loop.py", 4, "python-insecure-eval"),
    }
    assert [r["path"] for r in rows.where("kind = 'error'").collect()] == ["bad.py"]


def test_backward_slices(rows):
    sinks = code.rule_hits(code.resolved_calls(rows)).select("path", "scope", "line")
    out = code.backward_slices(rows, sinks.where("path in ('app/main.py', 'app/loop.py') and line in (13, 4)"))
    got = {}
    for r in out.collect():
        got.setdefault(r["path"], set()).add(r["line"])
    assert got["app/main.py"] == {13, 12, 9, 8} and got["app/loop.py"] == {4, 2, 5, 1}
    assert not any(r["partial"] for r in out.collect())
    short = code.backward_slices(rows, sinks.where("path = 'app/main.py' and line = 13"), rounds=1).collect()
    assert {r["line"] for r in short} < {13, 12, 9, 8} and all(r["partial"] for r in short)
    whole = code.backward_slices(rows, sinks.where("path = 'app/main.py' and line = 13"), rounds=9).collect()
    assert {r["line"] for r in whole} == {13, 12, 9, 8} and not any(r["partial"] for r in whole)


def test_wrappers_reach_a_fixpoint(rows):
    found = code.wrappers(rows, code.rule_hits(code.resolved_calls(rows)))
    assert {(r["path"], r["function"]) for r in found.collect()} >= {("app/base.py", "helper"), ("app/base.py", "outer"), ("app/db.py", "query")}


def test_scopes_and_imports(spark, rows):
    places = spark.createDataFrame([("app/main.py", 13), ("app/main.py", 20), ("app/main.py", 18), ("app/main.py", 6)], "path string, line int")
    assert {(r["line"], r["scope"]) for r in code.enclosing_scopes(rows, places).collect()} == {(13, "go"), (20, "K.m"), (18, "K")}
    paths = spark.createDataFrame([(p,) for p in FILES], "path string")
    edges = code.import_edges(rows, paths)
    assert {(r["path"], r["imported"]) for r in edges.collect()} == {("app/main.py", "app/db.py"), ("app/db.py", "app/base.py"), ("app/base.py", "app/db.py")}
    assert [r["path"] for r in code.importers(edges, spark.createDataFrame([("app/db.py",)], "path string"), 1).collect()] == ["app/base.py"]


def test_symbols_resolve_through_reexports_and_cycles(spark, rows):
    paths = spark.createDataFrame([(p,) for p in FILES], "path string")
    wanted = spark.createDataFrame([("app/db.py", "helper"), ("app/base.py", "query"), ("app/db.py", "nothing"), ("app/main.py", "LIMIT")], "path string, symbol string")
    got = {(r["asked"], r["wanted"]): (r["path"], r["line"], r["hops"]) for r in code.resolve_symbols(rows, paths, wanted, depth=3).collect()}
    assert got == {("app/db.py", "helper"): ("app/base.py", 3, 1), ("app/base.py", "query"): ("app/db.py", 3, 1), ("app/main.py", "LIMIT"): ("app/main.py", 6, 0)}
    assert rows.where(F.col("kind") == "class").count() == 1


RULE_LINES = {
    "python-insecure-eval": ["exec(x)", "eval(x)"],
    "python-insecure-subprocess-shell": ["subprocess.Popen(x, shell=True)"],
    "python-sql-injection": ["c.execute('a %s' % x)", "c.execute('{}'.format(x))"],
    "python-flask-render-template-string": ["render_template_string(x)"],
    "python-path-traversal-open": ["open(x)"],
    "python-insecure-deserialization": ["pickle.loads(x)", "yaml.load(x, Loader=yaml.Loader)", "marshal.load(x)"],
    "python-ldap-injection": ["conn.search_s(x)", "ldap.search(x)"],
    "python-xpath-injection": ["etree.XPath(x)", "t.findall(x)"],
    "python-xml-external-entity": ["xml.sax.parse(x)", "lxml.etree.fromstring(x)"],
    "python-insecure-randomness": ["random.choice(x)"],
    "python-weak-hashing": ["hashlib.sha1(x)", "hashlib.new('sha1')"],
    "python-open-redirect": ["redirect(x)", "HttpResponseRedirect(x)"],
    "python-insecure-cookie": ["r.set_cookie('k', x, secure=False)", "r.set_cookie('k', x)"],
    "python-ssrf-requests": ["requests.get(x)", "urllib.request.urlopen(x)"],
}
CLEAN_LINES = ["evaluate(x)", "subprocess.run(x)", "c.execute('a', x)", "open()", "yaml.load(x, Loader=yaml.SafeLoader)", "conn.search()", "hashlib.new('sha256')", "r.set_cookie('k', x, secure=True)", "secrets.choice(x)", "session.get(x)"]


def test_each_pinned_rule(spark):
    lines = [(rule, text) for rule, texts in RULE_LINES.items() for text in texts] + [(None, text) for text in CLEAN_LINES]
    files = spark.createDataFrame([(f"{k}.py", text) for k, (_, text) in enumerate(lines)], "path string, content string")
    got = {(r["path"], r["rule_id"]) for r in code.rule_hits(code.resolved_calls(syntax_rows(files))).collect()}
    assert got == {(f"{k}.py", rule) for k, (rule, _) in enumerate(lines) if rule} and len(RULE_LINES) == 14


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("x = a\n    if c:\n        x = b\n    eval(x)", {2, 4}),  # one arm: the value before may remain
        ("x = a\n    if c:\n        x = b\n    else:\n        x = d\n    eval(x)", {4, 6}),  # both arms hide what was before
        ("x = a\n    if c:\n        x = b\n    else:\n        eval(x)", {2}),  # another arm does not reach
        ("x = a\n    x = b\n    eval(x)", {3}),
        ("x = a\n    for i in c:\n        x = b\n    eval(x)", {2, 4}),  # a loop may not run
        ("x = a\n    try:\n        x = b\n    except E:\n        x = d\n    eval(x)", {2, 4, 6}),
        ("x = a\n    with c:\n        x = b\n    eval(x)", {4}),  # a with block always runs
        ("x = a\n    if c:\n        if d:\n            x = b\n        else:\n            x = d\n    eval(x)", {2, 5, 7}),
    ],
)
def test_definitions_over_branches(spark, body, want):
    rows = syntax_rows(spark.createDataFrame([("a.py", f"def f(a, b, c, d, E):\n    {body}\n")], "path string, content string"))
    last = rows.where("kind = 'call'").agg(F.max("line")).first()[0]
    got = code._definitions_reaching(rows).where(f"name = 'x' and line = {last}").collect()
    assert {r["bound"] for r in got} == want


def test_rows_come_in_small_batches():
    """A batch of many files is not held as rows all at once, nor are empty batches a fault."""
    text = "def work(p):\n" + "    eval(p)\n" * 500
    files = pa.record_batch({"path": [f"m{k}.py" for k in range(100)] + ["bad.py", "none.py"], "content": [text] * 100 + ["def (", None]})
    got = list(syntax.batches_of(iter([files.slice(0, 0), files])))
    assert max(b.num_rows for b in got) <= syntax.HELD + 1001
    table = pa.Table.from_batches(got)
    assert table.num_rows == 100 * 1001 + 1 and table.column("kind").to_pylist().count("call") == 100 * 500
    assert list(syntax.batches_of(iter([])))[0].num_rows == 0


def test_the_collector_rests_while_a_file_is_read(monkeypatch):
    seen = []
    monkeypatch.setattr(syntax, "rows_of", lambda path, source: seen.append(gc.isenabled()) or [])
    list(syntax.batches_of(iter([pa.record_batch({"path": ["a.py", "b.py"], "content": ["x = 1", None]})])))
    assert seen == [False, False] and gc.isenabled()


def test_reads_meet_bindings_once_where_nothing_loops(rows):
    plan = code._definitions_reaching(rows)._jdf.queryExecution().optimizedPlan().toString()
    # one join for all reads, two for those of scopes with a loop
    assert plan.count("Join ") == 3


def test_methods_are_the_last_part_after_a_dot(spark):
    calls = spark.createDataFrame([("a.execute",), ("execute",), ("a.execute.",), ("?.execute",), ("a.b",), ("",)], "call string")
    assert [r[0] for r in calls.select(code._method("execute")).collect()] == [True, False, False, True, False, False]
