"""Definitions, aliases and slices against random walks over the programs themselves."""

import ast
import random

import pytest

from fathomline.operators import dataflow
from fathomline.sources.flow import flow_programs, flow_rows

NAMES = ("a", "b", "c", "d")


class Program:
    """A random function of nested statements, one on a line."""

    def __init__(self, seed):
        self.rng, self.lines = random.Random(seed), ["def f(a, b):"]
        self.left = self.rng.randint(5, 11)
        self.body(1, 0)
        self.lines.append("    sink(" + self.rng.choice(NAMES) + ")")

    def text(self):
        return "\n".join(self.lines) + "\n"

    def body(self, depth, loops):
        for _ in range(self.rng.randint(1, 3)):
            self.statement(depth, loops)
        if depth > 1 and self.rng.random() < 0.3:
            self.put(depth, self.rng.choice(["return", "raise E", *(["break", "continue"] if loops else [])]))

    def put(self, depth, text):
        self.lines.append("    " * depth + text)

    def statement(self, depth, loops):
        x, y, z = (self.rng.choice(NAMES) for _ in range(3))
        self.left -= 1
        kind = self.rng.random()
        if depth > 3 or self.left < 0 or kind < 0.4:
            self.put(depth, self.rng.choice([f"{x} = {y}", f"{x} = {y} + {z}", f"{x} += {y}", f"{x}, {y} = {y}, {z}", f"{x}.append({y})", f"{x}[0] = {y}", f"{x} = f({y})", f"{x} = 1"]))
        elif kind < 0.6:
            self.put(depth, f"if {x}:")
            self.body(depth + 1, loops)
            if self.rng.random() < 0.5:
                self.put(depth, "else:")
                self.body(depth + 1, loops)
        elif kind < 0.8:
            self.put(depth, self.rng.choice([f"while {x}:", f"for {y} in {x}:"]))
            self.body(depth + 1, loops + 1)
            if self.rng.random() < 0.3:
                self.put(depth, "else:")
                self.body(depth + 1, loops)
        else:
            self.put(depth, "try:")
            self.body(depth + 1, loops)
            handlers = self.rng.randint(0, 2)
            for k in range(handlers):
                self.put(depth, "except:" if k == handlers - 1 and self.rng.random() < 0.5 else f"except {x}:")
                self.body(depth + 1, loops)
            if handlers and self.rng.random() < 0.3:
                self.put(depth, "else:")
                self.body(depth + 1, loops)
            if not handlers or self.rng.random() < 0.5:
                self.put(depth, "finally:")
                self.body(depth + 1, loops)


class Out(Exception):
    def __init__(self, way):
        self.way = way


def names(*nodes):
    return [x.id for n in nodes for x in ast.walk(n) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)]


class Walk:
    """Runs a program with random outcomes of tests and exceptions, and notes which definition each read meets."""

    def __init__(self, tree, seed):
        self.f, self.rng, self.seen = tree.body[0], random.Random(seed), set()
        pairs = [(t.id, v.id) for s in ast.walk(tree) if isinstance(s, ast.Assign) for t, v in self.elements(s) if isinstance(v, ast.Name)]
        pairs += [(s.targets[0].value.id, s.value.id) for s in ast.walk(tree) if isinstance(s, ast.Assign) and isinstance(s.targets[0], ast.Subscript)]
        pairs += [(s.value.func.value.id, s.value.args[0].id) for s in ast.walk(tree) if isinstance(s, ast.Expr) and isinstance(s.value.func, ast.Attribute)]
        pairs += [(s.target.id, s.iter.id) for s in ast.walk(tree) if isinstance(s, ast.For)]
        group = {n: {n} for n in NAMES}
        for x, y in pairs:
            joined = group[x] | group[y]
            for n in joined:
                group[n] = joined
        self.group = group

    @staticmethod
    def elements(s):
        t = s.targets[0]
        return zip(t.elts, s.value.elts, strict=True) if isinstance(t, ast.Tuple) else [(t, s.value)] if isinstance(t, ast.Name) else []

    def run(self, walks):
        for _ in range(walks):
            self.env, self.steps, self.tries = {"a": {1}, "b": {1}}, 0, 0
            try:
                self.many(self.f.body)
            except Out:
                pass
        return self.seen

    def at(self, line, reads, strong=(), weak=()):
        self.steps += 1
        if self.steps > 60:
            raise Out("stop")
        for n in reads:
            self.seen |= {(line, n, d) for d in self.env.get(n, ())}
        early = self.tries and self.rng.random() < 0.12
        if not early:
            for n in strong:
                self.env[n] = {line}
            for w in weak:
                for n in self.group[w]:
                    self.env[n] = self.env.get(n, set()) | {line}
        if early or self.tries and self.rng.random() < 0.12:
            raise Out("raise")

    def many(self, body):
        for s in body:
            self.one(s)

    def one(self, s):
        coin = lambda p=0.5: self.rng.random() < p
        if isinstance(s, ast.Assign):
            t = s.targets[0]
            if isinstance(t, ast.Subscript):
                self.at(s.lineno, names(s.value), weak=[t.value.id])
            else:
                self.at(s.lineno, names(s.value), strong=[x.id for x in getattr(t, "elts", [t])])
        elif isinstance(s, ast.AugAssign):
            self.at(s.lineno, [*names(s.value), s.target.id], strong=[s.target.id])
        elif isinstance(s, ast.Expr):
            method = isinstance(s.value.func, ast.Attribute)
            self.at(s.lineno, names(s), weak=[s.value.func.value.id] if method else ())
        elif isinstance(s, ast.If):
            self.at(s.lineno, names(s.test))
            self.many(s.body if coin() else s.orelse)
        elif isinstance(s, (ast.While, ast.For)):
            while True:
                self.at(s.lineno, names(s.test if isinstance(s, ast.While) else s.iter))
                if coin(0.4):
                    return self.many(s.orelse)
                if isinstance(s, ast.For):
                    self.at(s.lineno, names(s.iter), strong=[s.target.id])
                try:
                    self.many(s.body)
                except Out as out:
                    if out.way == "break":
                        return None
                    if out.way != "continue":
                        raise
        elif isinstance(s, ast.Try):
            try:
                self.tries += 1
                caught = False
                try:
                    if coin(0.05):
                        raise Out("raise")  # before its first statement is through
                    self.many(s.body)
                except Out as out:
                    if out.way != "raise" or not s.handlers:
                        raise
                    bare = s.handlers[-1].type is None
                    k = self.rng.randrange(len(s.handlers) + (not bare))
                    if k == len(s.handlers):
                        raise
                    caught = True
                    h = s.handlers[k]
                    self.guarded(bool(s.finalbody), lambda: (self.at(h.lineno, names(h.type) if h.type else []), self.many(h.body)))
                if not caught:
                    self.guarded(bool(s.finalbody), lambda: self.many(s.orelse))
            except Out as out:
                self.tries -= 1
                if out.way != "stop":
                    self.many(s.finalbody)
                raise
            self.tries -= 1
            self.many(s.finalbody)
        elif isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)):
            self.at(s.lineno, [])
            raise Out({ast.Return: "return", ast.Raise: "raise", ast.Break: "break", ast.Continue: "continue"}[type(s)])

    def guarded(self, watched, run):
        """Handlers and else may raise on only where something outside may notice."""
        self.tries -= not watched
        try:
            run()
        finally:
            self.tries += not watched


@pytest.fixture(scope="module")
def programs():
    return {f"p{k}.py": Program(k).text() for k in range(36)}


@pytest.fixture(scope="module")
def flow(spark, programs):
    return flow_rows(spark.createDataFrame(list(programs.items()), "path string, content string").repartition(4)).cache()


def reads_of(flow, reach):
    at = flow.where("kind = 'node'").select("path", "node", "line")
    both = reach.join(at, "node").join(at.selectExpr("node def", "line def_line"), "def")
    return {(r["path"], r["line"], r["name"], r["def_line"]) for r in both.collect()}


def test_definitions_equal_random_walks(flow, programs):
    reach, unfinished = dataflow.reaching_definitions(flow.where("scope = 'f'"))
    got = {x for x in reads_of(flow, reach) if x[2] in NAMES}
    want = {(path, *x) for path, text in programs.items() for x in Walk(ast.parse(text), 1).run(4000)}
    assert unfinished.isEmpty()
    assert want - got == set()
    # of code that runs, nothing else; what 4,000 walks have not met, 60,000 do
    lines = {(p, x) for p, x, _, _ in want}
    more = {x for x in got - want if (x[0], x[1]) in lines and ((x[0], x[3]) in lines or x[3] == 1)}
    longer = {p: Walk(ast.parse(programs[p]), 2).run(60_000) for p in {x[0] for x in more}}
    assert {x for x in more if x[1:] not in longer[x[0]]} == set()


FOR = "def build(items):\n    sql = 'S'\n    for item in items:\n        sql += f' {item}'\n    cursor.execute(sql)\n"
DYNAMIC = "def handle(obj, name, payload):\n    handler = getattr(obj, name)\n    a = b = payload\n    handler(a)\n"
ESCAPE = "def f(u, v):\n    items = []\n    other = items\n    w = v\n    other.append(u)\n    target = items[0]\n    eval(target)\n"
PAIR = "def f(u):\n    a, b = u, 'safe'\n    eval(b)\n    eval(a)\n"
GUARD = "def f(c, u):\n    x = 1\n    y = u\n    if c:\n        with u as h:\n            eval(x)\n"
LOCAL = "def f(u):\n    def g(z):\n        return z\n    eval(g(u))\n    wash(u)\n    safe_wash(u)\n"
SELF = "class A:\n    def run(self, s):\n        self.q = s.strip()\n        sql = self.q + ''\n        self.c.execute(sql)\n"
DEEP = "def f(v):\n" + "".join(f"    x{k + 1} = x{k}\n" for k in range(30)).replace("x0", "v", 1) + "    eval(x30)\n"
LOOPED = "def f(v):\n    y = v\n    while v:\n        eval(y)\n" + "".join(f"        if v{k}:\n            pass\n" for k in range(12)) + "        y = v\n"


def test_slices_of_known_programs(spark):
    files = {"for.py": FOR, "dyn.py": DYNAMIC, "esc.py": ESCAPE, "pair.py": PAIR, "guard.py": GUARD, "local.py": LOCAL, "self.py": SELF, "deep.py": DEEP, "bad.py": "def f(:\n", "none.py": None, "looped.py": LOOPED}
    flow = flow_rows(spark.createDataFrame(list(files.items()), "path string, content string"))
    sinks = [("for.py", 5), ("dyn.py", 4), ("esc.py", 7), ("pair.py", 3), ("pair.py", 4), ("guard.py", 6), ("local.py", 4), ("self.py", 5), ("deep.py", 32), ("bad.py", 1), ("none.py", 1), ("for.py", 99), ("for.py", 5), (None, 3), ("for.py", None), ("looped.py", 4)]
    asked = spark.createDataFrame([(p, n, "x") for p, n in sinks], "path string, line int, node string")
    _, states = dataflow.flow_slices(flow, asked)
    got = {(r["path"], r["sink_line"]): (r["lines"], r["status"], r["reason"]) for r in states.collect()}
    assert len(got) == 13
    done = ("complete", "backward_slice_complete")
    assert got["for.py", 5] == ([1, 2, 3, 4, 5], *done)
    assert got["dyn.py", 4] == ([1, 2, 3, 4], "partial", "alias_escape; dynamic_dispatch:getattr")
    assert got["esc.py", 7] == ([1, 2, 3, 5, 6, 7], "partial", "alias_escape; alias_escape:other")
    assert got["pair.py", 3] == ([2, 3], *done) and got["pair.py", 4] == ([1, 2, 4], *done)
    assert got["guard.py", 6] == ([1, 2, 4, 5, 6], *done)
    assert got["local.py", 4][1:] == ("partial", "interprocedural_call:g")
    assert got["self.py", 5] == ([2, 3, 4, 5], *done)
    assert got["deep.py", 32] == (list(range(1, 33)), *done)
    assert got["looped.py", 4][0][:4] == [1, 2, 3, 4] and got["looped.py", 4][0][-1] == LOOPED.count("\n")
    assert got["bad.py", 1] == ([], "failed", "syntax_error: SyntaxError") and got["none.py", 1][1:] == ("failed", "sink_line_not_found") == got["for.py", 99][1:]
    # a limit marks what it cuts off, and nothing else
    for limit in (7,):
        _, short = dataflow.flow_slices(flow, asked.where("path in ('deep.py', 'for.py', 'looped.py')"), limit)
        cut = {(r["path"], r["sink_line"]): r for r in short.collect()}
        assert cut["deep.py", 32]["reason"] == "fixpoint_iteration_budget_exceeded" and len(cut["deep.py", 32]["lines"]) < 32
        assert cut["looped.py", 4]["status"] == "partial"
        assert cut["for.py", 5]["status"] == "complete"
    # one name of a sink's alone
    _, named = dataflow.flow_slices(flow, spark.createDataFrame([("pair.py", 4, "u")], "path string, line int, name string"))
    assert named.first()["lines"] == [1, 4]
    assert dataflow.flow_slices(flow, asked.limit(0))[1].count() == 0
    assert dataflow.flow_slices(flow.limit(0), asked.where("line = 5"))[1].first()["status"] == "failed"


def test_scopes_are_walked_where_they_lie(spark, flow, programs, monkeypatch):
    """Slices take no rounds of joins over all files, and equal those that do; so do the slices of packed programs."""
    more = {"for.py": FOR, "dyn.py": DYNAMIC, "esc.py": ESCAPE, "guard.py": GUARD, "local.py": LOCAL, "self.py": SELF, "looped.py": LOOPED, "one.py": "def g(a): eval(a)\neval(\n    b)\n", "bad.py": "def f(:\n"}
    files = spark.createDataFrame([*programs.items(), *more.items()], "path string, content string")
    every = flow_rows(files).cache()
    sinks = every.where("kind = 'node' and (array_contains(calls, 'sink') or array_contains(calls, 'eval') or array_contains(calls, 'handler'))").select("path", "line")
    sinks = sinks.unionByName(spark.createDataFrame([("bad.py", 1), ("for.py", 99), ("one.py", 3)], "path string, line int"))
    named = sinks.selectExpr("path", "line", "explode(array('a', 'v', 'zz')) name")

    def rows(df, *columns):
        return sorted(map(str, df.select(*columns).collect()))

    columns, places = ("path", "sink_line", "lines", "status", "reason"), ("path", "sink_line", "line", "end_line", "type")
    rounds = [dataflow.flow_slices(every, s, 1000) for s in (sinks, named)]
    want = [(rows(picked, *places), rows(states, *columns)) for picked, states in rounds]
    monkeypatch.setattr(dataflow, "fixpoint", None)
    for s, w in zip((sinks, named), want, strict=True):
        picked, states = dataflow.flow_slices(every, s)
        assert (rows(picked, *places), rows(states, *columns)) == w
    asked = sinks.groupBy("path").agg({"line": "collect_list"}).toDF("path", "asked")
    packed = flow_programs(files)
    assert rows(dataflow.program_slices(packed.join(asked, "path")), *columns) == want[0][1]
    assert sorted(packed.where("path = 'local.py'").first()["calls"]) == [(4, "eval"), (4, "g"), (5, "wash"), (6, "safe_wash")]


def test_files_are_dealt_out_before_they_are_parsed(spark, sf):
    """Documents in one part are no reason for one task to parse them all."""
    from fathomline.plans import flows

    for made in (flows.shaped_files, flows.linked_files):
        assert made(spark, sf).rdd.getNumPartitions() > spark.read.parquet(f"{sf}/documents.parquet").rdd.getNumPartitions()


def test_lines_are_taken_once(spark, sf):
    """The rules that write files from documents ask for line lengths; no lambda splits a text again for each line."""
    from fathomline.plans import flows

    for made in (flows.shaped_files, flows.linked_files):
        plan = made(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1


def test_garbage_is_not_searched_while_a_file_grows(monkeypatch):
    """A file's tree and rows are no garbage until they are written, and the collector is on again afterwards."""
    import gc

    import pyarrow as pa

    from fathomline.sources import flow

    met, run = [], []
    rows_of = flow.rows_of
    monkeypatch.setattr(flow, "rows_of", lambda *a: met.append(gc.isenabled()) or rows_of(*a))
    monkeypatch.setattr(flow, "TaskContext", type("Task", (), {"get": staticmethod(lambda: type("At", (), {"partitionId": lambda self: 0})())}))
    files = type("Files", (), {"select": lambda self, *a: self, "mapInArrow": lambda self, f, schema: run.append(f)})()
    flow.flow_rows(files)
    batch = pa.RecordBatch.from_pydict({"path": ["a.py", "b.py"], "content": ["x = (y := 1)\neval(x)\n", None]})
    rows = [r for b in run[0](iter([batch])) for r in b.to_pylist()]
    assert met == [False, False] and gc.isenabled()
    assert [r["binds"] for r in rows if r["kind"] == "node"] == [["x", "y"], None]
