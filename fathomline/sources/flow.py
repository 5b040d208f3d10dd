"""Control flow of Python files as rows: statements, what they bind and read, and which may follow which (DF-05, DF-08, DF-11, DF-12, DF-19).

A small helper turns each function, class body and module of one file into nodes
and edges; definitions and slices are found by joins over the rows
(fathomline.operators.dataflow).  Nodes that can only run one after the other
share a block, named by its first node, and edges join blocks.  Numbers of nodes
are unique over all files of one flow_rows; what is empty is null, and so are
kills that are the binds and arguments that are the reads.  A function's entry has
its parameters in order as arguments.  A call row has the call's name as type,
and as flows which argument (its place or its keyword) reads which names.

break, continue, return and raise end their path.  Any statement of a try body
may raise before or after it binds; a bare except that comes first catches all.  A finally body has
a copy for each way it is entered, and leads on as that way does.  Loops may run no
time, and are taken to end.  Control is what a statement stands in, not the early
exits before it.
"""

from __future__ import annotations

import ast
import pickle
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fathomline.sources.syntax import unhurried

_PAIR = "array<struct<a:string,b:string>>"
SCHEMA = f"path string, scope string, kind string, node long, block long, line int, end_line int, type string, binds array<string>, weak array<string>, kills array<string>, reads array<string>, arguments array<string>, flows {_PAIR}, control long, calls array<string>, mutates string, aliases {_PAIR}, next long"
_STRINGS, _PAIRS = pa.list_(pa.string()), pa.list_(pa.struct([("a", pa.string()), ("b", pa.string())]))
_ARROW = pa.schema([("path", pa.string()), ("scope", pa.string()), ("kind", pa.string()), ("node", pa.int64()), ("block", pa.int64()), ("line", pa.int32()), ("end_line", pa.int32()), ("type", pa.string()), ("binds", _STRINGS), ("weak", _STRINGS), ("kills", _STRINGS), ("reads", _STRINGS), ("arguments", _STRINGS), ("flows", _PAIRS), ("control", pa.int64()), ("calls", _STRINGS), ("mutates", pa.string()), ("aliases", _PAIRS), ("next", pa.int64())])

#: What a packed program holds of each row, in this order; walks go by it.
COLUMNS = ("scope", "kind", "node", "block", "line", "end_line", "type", "binds", "weak", "kills", "reads", "arguments", "flows", "control", "calls", "mutates", "aliases", "next")
PROGRAMS = "path string, calls array<struct<line:int,name:string>>, program binary"
_CALLED = pa.list_(pa.struct([("line", pa.int32()), ("name", pa.string())]))

# Methods that change the object they are called on.
MUTATING = ("append", "extend", "insert", "add", "update", "setdefault", "pop", "popitem", "remove", "discard", "clear", "sort", "reverse", "__setitem__", "write", "writelines")

#: Expressions with nothing inside them.
_LEAVES = frozenset((ast.Name, ast.Constant))
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def dotted(node: ast.AST | None) -> str:
    """a.b.c as written; nothing if it does not begin with a name."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""


def loads(node: ast.AST | None) -> set[str]:
    """Names that an expression reads, and its dotted names with each of their prefixes; not those that it binds for itself."""
    if node is None or isinstance(node, ast.stmt):
        return set()
    if isinstance(node, ast.Name):
        return {node.id} if isinstance(node.ctx, ast.Load) else set()
    if isinstance(node, ast.Attribute) and dotted(node):
        parts = dotted(node).split(".")
        return {".".join(parts[: k + 1]) for k in range(len(parts))}
    own: set[str] = set()
    if isinstance(node, _COMPREHENSIONS):
        own = {x.id for g in node.generators for x in ast.walk(g.target) if isinstance(x, ast.Name)}
    elif isinstance(node, ast.Lambda):
        own = {a.arg for a in ast.walk(node.args) if isinstance(a, ast.arg)}
    found = set().union(*(loads(c) for c in ast.iter_child_nodes(node)))
    return {x for x in found if x.split(".")[0] not in own}


def _walrus(*nodes: ast.AST | None) -> set[str]:
    return {x.target.id for n in nodes if n is not None and type(n) not in _LEAVES for x in ast.walk(n) if isinstance(x, ast.NamedExpr) and isinstance(x.target, ast.Name)}


def targets(node: ast.AST | None) -> tuple[set[str], set[str]]:
    """Names that a target binds, and names whose object it changes in part."""
    if isinstance(node, ast.Name):
        return {node.id}, set()
    if isinstance(node, ast.Starred):
        return targets(node.value)
    if isinstance(node, (ast.Tuple, ast.List)):
        both = [targets(x) for x in node.elts]
        return set().union(*(x[0] for x in both)), set().union(*(x[1] for x in both))
    if isinstance(node, ast.Attribute):
        name = dotted(node)
        return ({name}, {name.split(".")[0]}) if name else (set(), loads(node.value))
    if isinstance(node, ast.Subscript):
        return set(), {x for x in loads(node.value) if x == dotted(node.value) or "." not in x}
    return set(), set()


def mapped(target: ast.AST, value: ast.AST | None, out: list[tuple[str, str]]) -> None:
    """(bound, read) of an assignment; tuples of one length go element by element."""
    if isinstance(target, (ast.Tuple, ast.List)) and isinstance(value, (ast.Tuple, ast.List)) and len(target.elts) == len(value.elts) and not any(isinstance(x, ast.Starred) for x in [*target.elts, *value.elts]):
        for a, b in zip(target.elts, value.elts, strict=True):
            mapped(a, b, out)
        return
    strong, weak = targets(target)
    out += [(a, b) for a in strong | weak for b in loads(value)]


def atoms(value: ast.AST | None) -> set[str]:
    """Names whose objects an expression may hand on as they are, or hold."""
    if isinstance(value, (ast.Name, ast.Attribute)):
        return {dotted(value).split(".")[0]} - {""}
    if isinstance(value, (ast.Subscript, ast.Starred, ast.Await)):
        return atoms(value.value)
    if isinstance(value, ast.NamedExpr):
        return atoms(value.value) | atoms(value.target)
    if isinstance(value, ast.IfExp):
        return atoms(value.body) | atoms(value.orelse)
    if isinstance(value, ast.BoolOp):
        return set().union(*map(atoms, value.values))
    if isinstance(value, (ast.Tuple, ast.List, ast.Set)):
        return set().union(*map(atoms, value.elts))
    if isinstance(value, ast.Dict):
        return set().union(*map(atoms, value.values))
    return set()


class Graph:
    """Nodes and edges of one scope; `build` returns after all its statements, nested scopes wait in `inner`."""

    def __init__(self, path: str, scope: str, first: int):
        self.path, self.scope, self.first = path, scope, first
        self.nodes: list[dict] = []
        self.calls: list[dict] = []
        self.edges: set[tuple[int, int]] = set()
        self.inner: list[ast.stmt] = []
        self.raising: list[list[int]] = [[]]
        self.loops: list[dict] = []
        self.finals: list[dict] = []
        self.copying = 0

    def add(self, at: ast.AST, incoming: Iterable[int], control: int | None, kind: str = "", strong: Iterable[str] = (), weak: Iterable[str] = (), reads: Iterable[str] = (), expressions: Iterable[ast.AST | None] = (), flows: list[tuple[str, str]] | None = None, aliases: Iterable[tuple[str, str]] = (), mutates: str | None = None, head: bool = False) -> int:
        node = self.first + len(self.nodes)
        given = [x for x in expressions if x is not None]
        calls = [c for e in given if type(e) not in _LEAVES for c in ast.walk(e) if isinstance(c, ast.Call)]
        # what a call gets, and a callee that is a plain name: another binding may stand for it
        inside = set().union(*(loads(a) for c in calls for a in [c.func if isinstance(c.func, ast.Name) else None, *c.args, *(k.value for k in c.keywords)])) if calls else set(reads)
        # where all that is bound comes from all that is read, no pairs are needed
        split = flows is not None and len(set(flows)) != len(set(strong) | set(weak)) * len(set(reads))
        line = getattr(at, "lineno", 1)
        end = max([line, *(e.end_lineno or line for e in given)]) if head else getattr(at, "end_lineno", line)
        self.nodes.append({"path": self.path, "scope": self.scope, "kind": "node", "node": node, "line": line, "end_line": end, "type": kind or type(at).__name__, "binds": sorted(set(strong)) or None, "weak": sorted(set(weak) - set(strong)) or None, "reads": sorted(set(reads)) or None, "arguments": sorted(inside) if calls else None, "flows": [{"a": a, "b": b} for a, b in sorted(set(flows))] if flows is not None and split else None, "control": control, "calls": sorted({dotted(c.func) for c in calls if mutates is None or c is not given[0]}) or None, "mutates": mutates, "aliases": [{"a": a, "b": b} for a, b in sorted(set(aliases)) if a != b] or None})
        for c in calls:
            slots = [(str(k), a.value if isinstance(a, ast.Starred) else a) for k, a in enumerate(c.args)] + [(k.arg or "**", k.value) for k in c.keywords]
            self.calls.append({"path": self.path, "scope": self.scope, "kind": "call", "node": node, "line": c.lineno, "end_line": c.end_lineno, "type": dotted(c.func), "flows": [{"a": slot, "b": n} for slot, a in slots for n in sorted(loads(a))] or None})
        self.edges |= {(p, node) for p in incoming}
        self.raising[-1].append(node)
        return node

    def sequence(self, body: list[ast.stmt], incoming: list[int], control: int | None) -> list[int]:
        for s in body:
            incoming = self.statement(s, incoming, control)
        return incoming

    def leave(self, way: str, loop: dict | None, nodes: list[int]) -> None:
        """break, continue or return from nodes: through the finally bodies in between, then on."""
        if len(self.finals) > (loop["finals"] if loop else 0):
            self.finals[-1].setdefault((way, id(loop)), (loop, []))[1].extend(nodes)
        elif loop and way == "break":
            loop["breaks"] += nodes
        elif loop:
            self.edges |= {(n, loop["header"]) for n in nodes}

    def statement(self, s: ast.stmt, incoming: list[int], control: int | None) -> list[int]:
        simple = getattr(self, f"_{type(s).__name__.lower()}", None)
        if simple:
            return simple(s, incoming, control)
        expressions = [c for c in ast.iter_child_nodes(s) if isinstance(c, ast.expr)]
        reads = set().union(*map(loads, expressions)) if expressions else set()
        node = self.add(s, incoming, control, strong=_walrus(*expressions), reads=reads, expressions=expressions)
        if isinstance(s, ast.Return):
            self.leave("return", None, [node])
        elif isinstance(s, (ast.Break, ast.Continue)) and self.loops:
            self.leave("break" if isinstance(s, ast.Break) else "continue", self.loops[-1], [node])
        return [] if isinstance(s, (ast.Return, ast.Raise, ast.Break, ast.Continue)) else [node]

    def _assign(self, s: ast.Assign | ast.AnnAssign, incoming: list[int], control: int | None) -> list[int]:
        every = s.targets if isinstance(s, ast.Assign) else [s.target] if s.value is not None else []
        both, flows = [targets(t) for t in every], []
        for t in every:
            mapped(t, s.value, flows)
        strong, weak = set().union(*(x[0] for x in both)), set().union(*(x[1] for x in both))
        bound = {x.split(".")[0] for x in strong | weak}
        return [self.add(s, incoming, control, strong=strong | _walrus(s.value), weak=weak, reads=loads(s.value), expressions=[s.value], flows=flows + [(w, r) for w in _walrus(s.value) for r in loads(s.value)], aliases=[(a, b) for a in bound for b in atoms(s.value)])]

    _annassign = _assign

    def _augassign(self, s: ast.AugAssign, incoming: list[int], control: int | None) -> list[int]:
        strong, weak = targets(s.target)
        reads = loads(s.value) | strong | weak
        return [self.add(s, incoming, control, strong=strong | _walrus(s.value), weak=weak, reads=reads, expressions=[s.value])]

    def _expr(self, s: ast.Expr, incoming: list[int], control: int | None) -> list[int]:
        call, weak, pairs, base = s.value, set(), [], None
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Attribute) and call.func.attr in MUTATING and dotted(call.func.value):
            base = dotted(call.func.value).split(".")[0]
            weak = {base}
            pairs = [(base, b) for a in [*call.args, *(k.value for k in call.keywords)] for b in atoms(a)]
        return [self.add(s, incoming, control, strong=_walrus(call), weak=weak, reads=loads(call), expressions=[call], aliases=pairs, mutates=base)]

    def _delete(self, s: ast.Delete, incoming: list[int], control: int | None) -> list[int]:
        reads = {x for t in s.targets for x in [*targets(t)[0], *targets(t)[1]]}
        return [self.add(s, incoming, control, reads=reads)]

    def _import(self, s: ast.Import | ast.ImportFrom, incoming: list[int], control: int | None) -> list[int]:
        names = {a.asname or (a.name.split(".")[0] if isinstance(s, ast.Import) else a.name) for a in s.names} - {"*"}
        return [self.add(s, incoming, control, strong=names)]

    _importfrom = _import

    def _functiondef(self, s: ast.stmt, incoming: list[int], control: int | None) -> list[int]:
        self.inner.append(s)
        outside = [*s.decorator_list]
        outside += [*s.bases, *(k.value for k in s.keywords)] if isinstance(s, ast.ClassDef) else [*s.args.defaults, *s.args.kw_defaults]
        reads = set().union(*map(loads, outside)) if outside else set()
        return [self.add(s, incoming, control, strong={s.name}, reads=reads, expressions=outside, head=True)]

    _asyncfunctiondef = _classdef = _functiondef

    def _if(self, s: ast.If, incoming: list[int], control: int | None) -> list[int]:
        guard = self.add(s, incoming, control, strong=_walrus(s.test), reads=loads(s.test), expressions=[s.test], head=True)
        return [*self.sequence(s.body, [guard], guard), *(self.sequence(s.orelse, [guard], guard) if s.orelse else [guard])]

    def _loop(self, s: ast.stmt, header: int, first: int, control: int | None) -> list[int]:
        loop = {"header": header, "breaks": [], "finals": len(self.finals)}
        self.loops.append(loop)
        self.edges |= {(n, header) for n in self.sequence(s.body, [first], header)}
        self.loops.pop()
        return [*(self.sequence(s.orelse, [header], control) if s.orelse else [header]), *loop["breaks"]]

    def _while(self, s: ast.While, incoming: list[int], control: int | None) -> list[int]:
        header = self.add(s, incoming, control, strong=_walrus(s.test), reads=loads(s.test), expressions=[s.test], head=True)
        return self._loop(s, header, header, control)

    def _for(self, s: ast.For, incoming: list[int], control: int | None) -> list[int]:
        header = self.add(s, incoming, control, strong=_walrus(s.iter), reads=loads(s.iter), expressions=[s.iter], head=True)
        strong, weak = targets(s.target)
        # the target is bound where an iteration begins, so a loop that runs no time leaves it
        bound = self.add(s, [header], header, "target", strong=strong, weak=weak, reads=loads(s.iter), aliases=[(a.split(".")[0], b) for a in strong for b in atoms(s.iter)], head=True)
        return self._loop(s, header, bound, control)

    _asyncfor = _for

    def _with(self, s: ast.With, incoming: list[int], control: int | None) -> list[int]:
        both = [targets(i.optional_vars) for i in s.items]
        contexts = [i.context_expr for i in s.items]
        pairs = [(a.split(".")[0], b) for i in s.items for a in targets(i.optional_vars)[0] for b in atoms(i.context_expr)]
        header = self.add(s, incoming, control, strong=set().union(*(x[0] for x in both)) | _walrus(*contexts), weak=set().union(*(x[1] for x in both)), reads=set().union(*map(loads, contexts)), expressions=contexts, aliases=pairs, head=True)
        return self.sequence(s.body, [header], header)

    _asyncwith = _with

    def _match(self, s: ast.Match, incoming: list[int], control: int | None) -> list[int]:
        before = [self.add(s, incoming, control, strong=_walrus(s.subject), reads=loads(s.subject), expressions=[s.subject], head=True)]
        header, out = before[0], []
        for case in s.cases:
            names = {n for x in ast.walk(case.pattern) for n in (getattr(x, "name", None), getattr(x, "rest", None)) if isinstance(n, str)}
            at = case.pattern
            # a pattern takes its names from the subject
            node = self.add(at, before, header, "match_case", strong=names | _walrus(case.guard), reads=loads(case.guard) | loads(s.subject), expressions=[case.guard], aliases=[(n, b) for n in names for b in atoms(s.subject)])
            out += self.sequence(case.body, [node], node)
            before = [node]
        last = s.cases[-1]
        sure = last.guard is None and isinstance(last.pattern, ast.MatchAs) and last.pattern.pattern is None
        return out if sure else [*out, *before]

    def _try(self, s: ast.Try, incoming: list[int], control: int | None) -> list[int]:
        final: dict = {}
        if s.finalbody:
            self.finals.append(final)
        self.raising.append(list(incoming))
        done = self.sequence(s.body, incoming, control)
        raised = self.raising.pop()
        self.raising.append([])
        out: list[int] = []
        for h in s.handlers:
            node = self.add(h, raised, control, strong={h.name} if h.name else (), reads=loads(h.type), expressions=[h.type], head=True)
            out += self.sequence(h.body, [node], control)
        out += self.sequence(s.orelse, done, control) if s.orelse else done
        escaping = [*self.raising.pop(), *([] if s.handlers and s.handlers[0].type is None else raised)]
        if not s.finalbody:
            self.raising[-1] += escaping
            return out
        self.finals.pop()
        jumps = list(final.items())
        # the first statement of a copy may raise before it binds
        self.raising[-1] += [*out, *escaping, *(n for _, (_, nodes) in jumps for n in nodes)]
        if self.copying > 1:  # a finally in a finally in a finally: one copy, entered and left every way
            out = self.sequence(s.finalbody, [*out, *escaping, *(n for _, (_, nodes) in jumps for n in nodes)], control)
            for (way, _), (loop, _) in jumps:
                self.leave(way, loop, out)
            return out
        self.copying += 1
        out = self.sequence(s.finalbody, out, control) if out else []
        self.sequence(s.finalbody, escaping, control)
        for (way, _), (loop, nodes) in jumps:
            self.leave(way, loop, self.sequence(s.finalbody, nodes, control))
        self.copying -= 1
        return out

    _trystar = _try

    def rows(self) -> Iterator[dict]:
        """Nodes with their blocks, calls, and edges between blocks; none from code that cannot run into code that can."""
        yield from self.calls
        onward: dict[int, list[int]] = {}
        for a, b in self.edges:
            onward.setdefault(a, []).append(b)
        live, queue = {self.first}, [self.first]
        while queue:
            more = [n for n in onward.get(queue.pop(), ()) if n not in live]
            live.update(more)
            queue += more
        self.edges = {(a, b) for a, b in self.edges if a in live or b not in live}
        before: dict[int, set[int]] = {n["node"]: set() for n in self.nodes}
        after: dict[int, set[int]] = {n["node"]: set() for n in self.nodes}
        for a, b in self.edges:
            before[b].add(a)
            after[a].add(b)
        names = {x for n in self.nodes for x in [*(n["reads"] or ()), *(n["binds"] or ())] if "." in x}
        block: dict[int, int] = {}
        for n in self.nodes:  # a node's only predecessor comes before it, but for a loop's header, which has two
            at = n["node"]
            joined = len(before[at]) == 1 and (p := next(iter(before[at]))) < at and len(after[p]) == 1
            block[at] = block[p] if joined else at
            inner = [x for x in names if any(x.startswith(f"{b}.") for b in n["binds"] or ())] if names else []
            n["block"] = block[at]
            n["kills"] = sorted({*n["binds"], *inner}) if inner else None
            yield n
        for a, b in sorted(self.edges):
            if block[a] != block[b] or b == block[b]:
                yield {"path": self.path, "scope": self.scope, "kind": "edge", "block": block[a], "next": block[b]}


def rows_of(path: str, source: str, first: int = 0) -> list[dict]:
    """Rows of one file, its nodes numbered from `first`."""
    try:
        tree = ast.parse(source)
        out: list[dict] = []
        waiting: list[tuple[str, ast.AST]] = [("", tree)]
        while waiting:
            scope, at = waiting.pop()
            graph = Graph(path, scope, first)
            entry: list[int] = []
            if isinstance(at, (ast.FunctionDef, ast.AsyncFunctionDef)):
                params = [a.arg for a in [*at.args.posonlyargs, *at.args.args, *at.args.kwonlyargs, *filter(None, (at.args.vararg, at.args.kwarg))]]
                entry = [graph.add(at, [], None, "entry", strong=params, head=True)]
                graph.nodes[0]["arguments"] = params
            graph.sequence(at.body, entry, None)
            first += len(graph.nodes)
            out += graph.rows()
            # copies of a finally body hold the same scopes
            waiting += [(f"{scope}.{s.name}" if scope else s.name, s) for s in {id(x): x for x in graph.inner}.values()]
        return out
    except (SyntaxError, ValueError, RecursionError) as broken:
        return [{"path": path, "scope": "", "kind": "error", "line": getattr(broken, "lineno", None) or 1, "type": type(broken).__name__}]


def flow_rows(files: DataFrame) -> DataFrame:
    """Rows of every file (path, content); one that does not parse is one row of kind error, a null content an empty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            held: list[dict] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with unhurried():
                    rows = rows_of(path, content or "", first)
                first += len(rows)
                held += rows
                if len(held) > 20_000:
                    yield from pa.Table.from_pylist(held, schema=_ARROW).to_batches()
                    held = []
            yield from pa.Table.from_pylist(held, schema=_ARROW).to_batches()

    return files.select("path", "content").mapInArrow(run, SCHEMA)


def flow_programs(files: DataFrame) -> DataFrame:
    """One row for every file (path, content): the lines of its nodes with the names that they call, and its rows but those of calls, packed.

    For work that stays inside a file, which then needs no rows of its own for statements and edges.  Nodes are numbered within the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # some files at a time, as a program is larger than its text
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                paths, calls, programs = some.column("path"), [], []
                for path, content in zip(paths.to_pylist(), some.column("content").to_pylist(), strict=True):
                    with unhurried():
                        rows = rows_of(path, content or "")
                    calls.append([(r["line"], c) for r in rows if r["kind"] == "node" for c in r["calls"] or ()])
                    programs.append(pickle.dumps([[r.get(c) for c in COLUMNS] for r in rows if r["kind"] != "call"], protocol=5))
                yield pa.record_batch([paths, pa.array(calls, _CALLED), pa.array(programs, pa.binary())], ["path", "calls", "program"])

    return files.select("path", "content").mapInArrow(run, PROGRAMS)
