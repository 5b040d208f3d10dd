"""Wrappers of dangerous calls across files, by place, keyword and method; what is safe is no sink."""

import random

import pytest
from pyspark.sql import functions as F

from fathomline.operators import callsites, dataflow
from fathomline.sources.flow import flow_rows
from fathomline.sources.shared import stored
from fathomline.sources.syntax import syntax_rows

FILES = {
    "app/low.py": "import os\ndef run(cmd, quiet=False):\n    text = cmd + ' 2>&1'\n    os.system(text)\ndef clean(x):\n    print(x)\ndef lost(x):\n    x = 'ls'\n    y = 1\n    os.system(x)\n",
    "app/mid.py": "from app.low import run as go, clean\nimport app.low as low\ndef middle(a, b):\n    go(quiet=a, cmd=b)\n    clean(a)\ndef other(c, d):\n    low.run(d)\n",
    "app/top.py": "from app.mid import middle\ndef far(p, q):\n    middle(q, p)\nuser = input()\nfar(user, 1)\n",
    "app/cls.py": "class Box:\n    def put(self, k, v):\n        self.serial.read(v)\n    def wrap(self, z):\n        self.put(1, z)\nbox = Box()\nbox.wrap(name)\nlen(name)\n",
    "app/loop.py": "def a(x):\n    b(x)\ndef b(y):\n    a(y)\n    if y:\n        eval(y)\n",
    "app/bad.py": "def (:\n",
}


@pytest.fixture(scope="module")
def tables(spark):
    files = spark.createDataFrame(list(FILES.items()), "path string, content string")
    return stored(flow_rows(files)), stored(syntax_rows(files))


def test_anchors_across_files(tables):
    anchors, told = callsites.call_site_anchors(*tables)
    got = {tuple(r) for r in told.collect()}
    shell = "INSECURE_SUBPROCESS_SHELL"
    assert got == {
        ("app/low.py", "run", "cmd", shell), ("app/mid.py", "middle", "b", shell), ("app/mid.py", "other", "d", shell), ("app/top.py", "far", "p", shell),
        ("app/cls.py", "Box.put", "v", "DESERIALIZATION"), ("app/cls.py", "Box.wrap", "z", "DESERIALIZATION"),
        ("app/loop.py", "a", "x", "INSECURE_EVAL"), ("app/loop.py", "b", "y", "INSECURE_EVAL"),
        ("app/low.py", "lost", "x", shell),
    }
    sites = {tuple(r)[:4] + (r["name"],) for r in anchors.collect()}
    assert sites == {
        ("app/mid.py", 4, "go", "run", "b"), ("app/mid.py", 7, "low.run", "run", "d"), ("app/top.py", 3, "middle", "middle", "p"), ("app/top.py", 5, "far", "far", "user"),
        ("app/cls.py", 5, "self.put", "put", "z"), ("app/cls.py", 7, "box.wrap", "wrap", "name"),
        ("app/loop.py", 2, "b", "b", "x"), ("app/loop.py", 4, "a", "a", "y"),
    }


def test_hops_and_empty_tables(tables):
    flow, rows = tables
    _, told = callsites.call_site_anchors(flow, rows, limit=1)
    assert {r["function"] for r in told.where("path like 'app/%p.py' or path like 'app/mid.py'").collect()} == {"middle", "other", "a", "b"} - {"a", "b"} | {r["function"] for r in told.where("path = 'app/loop.py'").collect()}
    assert "far" not in {r["function"] for r in told.collect()}
    none, nothing = callsites.call_site_anchors(flow.limit(0), rows.limit(0))
    assert none.isEmpty() and nothing.isEmpty()


def test_long_chains_take_few_rounds(spark, monkeypatch):
    n = 120
    text = "".join(f"def f{k}(p, q):\n    f{k + 1}(q, p)\n" for k in range(n)) + f"def f{n}(p, q):\n    eval(p)\n"
    files = spark.createDataFrame([("deep.py", text)], "path string, content string")
    flow, rows = stored(flow_rows(files)), stored(syntax_rows(files))
    written = []
    monkeypatch.setattr(dataflow, "stored", lambda df: written.append(1) or stored(df))
    _, told = callsites.call_site_anchors(flow, rows)
    assert {(r["function"], r["param"]) for r in told.collect()} == {(f"f{k}", "p" if (n - k) % 2 == 0 else "q") for k in range(n + 1)}
    assert len(written) < 40


CUT = {
    "t/text.py": 'X = """\ndef a(x):\n    eval(x)\n"""\ndef b(y):\n    eval(y)\n',
    "t/marked.py": "@wrap(1)\ndef a(x):\n    eval(x)\ndef b(y, z=eval(X)):\n    a(y)\n",
    "t/ends.py": "def a(x):\r\n    eval(x)\r\ndef b(y):\r\n    a(y)\rdef c(y):\r    a(y)\r",
    "t/after.py": "def a(x):\n    eval(x)\nz = input()\na(z)\ndef b(k):\n    a(k)\nb(z)\n",
    "t/inner.py": "def o(a):\n    def i(b):\n        eval(b)\n    i(a)\nif 1:\n    def q(c):\n        o(c)\n",
    "t/again.py": "def a(x, y):\n    eval(x)\ndef a(x, y):\n    b = y\n    while x:\n        b = x\n    eval(b)\ndef c(p):\n    a(1, y=p)\n",
    "t/whole.py": "from t.after import a as far\nimport t.again as again\ndef m(v):\n    far(v)\ndef n(w):\n    again.a(1, w)\n",
    "t/broken.py": "def a(x):\n    eval(x)\ndef b(:\n",
    "t/empty.py": "",
    "t/null.py": None,
}


def test_facts_of_pieces_equal_those_of_files(spark, monkeypatch):
    """Files are read by pieces, equal ones once; what they say is what their rows say."""
    files = spark.createDataFrame([*FILES.items(), *CUT.items()], "path string, content string")
    facts = stored(callsites.file_facts(files))
    rows = stored(syntax_rows(files))
    want = callsites.call_site_anchors(stored(flow_rows(files)), rows)
    got = callsites.fact_anchors(facts, callsites.symbol_rows(facts))
    for a, b in zip(want, got, strict=True):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert {r["path"] for r in got[1].where("path like 't/%'").select("path").collect()} == {f"t/{n}.py" for n in ("text", "marked", "ends", "after", "inner", "again", "whole")}
    assert {r["path"] for r in callsites.symbol_rows(facts).collect()} == {r["path"] for r in rows.select("path").collect()}
    # a function is parsed once, however many files hold it
    parsed, rows_of = [], callsites.flow_source.rows_of
    monkeypatch.setattr(callsites.flow_source, "rows_of", lambda path, text: parsed.append(text) or rows_of(path, text))
    callsites._remembered.cache_clear()
    told = [callsites.facts_of(f"{k}.py", f"from m{k} import f\n" + "def a(x):\n    eval(x)\ndef b(y):\n    a(y)\n" * 2)[0] for k in range(5)]
    assert len(parsed) == 5 + 2
    assert [[(r[1], r[3]) for r in rows if r[1] != "symbol"] for rows in told] == [[(kind, line) for top in (2, 4, 6, 8) for kind, line in (("function", top), ("call", top + 1))]] * 5


def test_marks_behind_any_graph(spark):
    rng = random.Random(5)
    for size, count in ((12, 8), (40, 40), (60, 90)):
        edges = {(rng.randrange(size), rng.randrange(size)) for _ in range(count)} | {(100 + k, 100 + (k + 1) % 9) for k in range(9)} | {(200, 100), (201, 200), (0, 200)}
        own = {(rng.randrange(size), rng.choice("ABC")) for _ in range(6)} | {(104, "R")}
        want, before = set(own), None
        while want != before:
            before = set(want)
            want |= {(a, m) for a, b in edges for n, m in before if n == b}
        got = dataflow.inherited(spark.createDataFrame(sorted(own), "node long, mark string"), spark.createDataFrame(sorted(edges), "node long, next long"))
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_categories(spark):
    want = {
        "eval": "INSECURE_EVAL", "subprocess.run": "INSECURE_SUBPROCESS_SHELL", "self.db.cursor.execute": "SQL_INJECTION", "execute": "SQL_INJECTION", "shutil.rmtree": "PATH_TRAVERSAL_OPEN", "my.shutil.x": "PATH_TRAVERSAL_OPEN",
        "json.loads": None, "ujson.loads": None, "self.codec.loads": "INSECURE_DESERIALIZATION", "pcrypt.x": "DESERIALIZATION", "tool.spawn": "COMMAND_EXECUTION", "spawn": None, "run_cmd": "COMMAND_EXECUTION", "len": None, "": None, None: None, "x.strip": None, "thing.joinpath": "PATH_TRAVERSAL", " eval ": "INSECURE_EVAL",
    }
    rows = spark.createDataFrame(list(enumerate(want)), "k int, c string").select("k", callsites.sink_category(F.col("c")).alias("x")).orderBy("k").collect()
    got = dict(zip(want, [r["x"] for r in rows], strict=True))
    # a bare last part of a listed name matches it, as either may be the ending of the other
    assert got.pop("self.codec.loads") in ("DESERIALIZATION", "INSECURE_DESERIALIZATION") and want.pop("self.codec.loads")
    assert got == want
