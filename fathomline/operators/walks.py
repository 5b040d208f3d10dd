"""Walks from reads back to what they come from, scope by scope (DF-05..07).

Bindings hold inside one scope, so Spark deals the rows out by file and a task
needs no rounds of joins over all files: it walks one scope at a time, backward
from what is asked, so it holds a scope's statements and no table of all pairs.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.sources.flow import COLUMNS

SCOPE, KIND, NODE, BLOCK, LINE, END_LINE, TYPE, BINDS, WEAK, KILLS, READS, ARGUMENTS, FLOWS, CONTROL, CALLS, MUTATES, ALIASES, NEXT = range(len(COLUMNS))
#: Rows that leave a task at a time.
HELD = 5_000


def _joined(pairs: Iterable[dict]) -> dict[str, set[str]]:
    """Of each name the names that pairs join it with, directly or through others."""
    group: dict[str, set[str]] = {}
    for p in pairs:
        a, b = (group.setdefault(p[k], {p[k]}) for k in "ab")
        if a is not b:
            small, large = sorted((a, b), key=len)
            large |= small
            for name in small:
                group[name] = large
    return group


class Scope:
    """Nodes (rows by COLUMNS) and edges between blocks of one scope; `also` are reads (place, name) beyond the nodes' own, `whole` says that walks pass through the nodes themselves and what they stand in."""

    def __init__(self, nodes: list[tuple], edges: list[tuple], whole: bool = True):
        nodes.sort(key=lambda n: n[NODE])
        self.nodes, self.also, self.whole = nodes, frozenset(), whole
        self.place = {n[NODE]: k for k, n in enumerate(nodes)}
        group = _joined(p for n in nodes for p in n[ALIASES] or ()) if any(n[WEAK] for n in nodes) else {}
        # of each block and name, in order: the node, whether it binds the name, and whether it ends earlier bindings
        self.events: dict[tuple[int, str], list[tuple[int, bool, bool]]] = {}
        for k, n in enumerate(nodes):
            # a change of an object through one name changes it for all its aliases
            binds = {*(n[BINDS] or ()), *(x for w in n[WEAK] or () for x in group.get(w, (w,)))}
            ends = (n[BINDS] or ()) if n[KILLS] is None else n[KILLS]
            for name in binds.union(ends):
                self.events.setdefault((n[BLOCK], name), []).append((k, name in binds, name in ends))
        self.earlier: dict[int, list[int]] = {}
        for e in edges:
            self.earlier.setdefault(e[NEXT], []).append(e[BLOCK])
        self._entering: dict[tuple[int, str], list[int]] = {}
        self._steps: dict[tuple[int, str], list[tuple[int, str]]] = {}

    def _last(self, block: int, name: str, before: int | None = None) -> tuple[list[int], bool]:
        """Nodes whose bindings of the name leave the block, or hold in it before a node, and whether earlier ones are ended."""
        events = self.events.get((block, name), ())
        at, found = len(events) if before is None else bisect_left(events, (before,)), []
        while at:
            at -= 1
            node, binds, ends = events[at]
            if binds:
                found.append(node)
            if ends:
                return found, True
        return found, False

    def definitions(self, at: int, name: str) -> list[int]:
        """Nodes whose bindings of the name may hold where the node reads it."""
        if name not in (self.nodes[at][READS] or ()) and (at, name) not in self.also:
            return []
        block = self.nodes[at][BLOCK]
        found, ended = self._last(block, name, at)
        if ended:
            return found
        entering = self._entering.get((block, name))
        if entering is None:
            entering, seen, waiting = [], set(), [*self.earlier.get(block, ())]
            while waiting:
                b = waiting.pop()
                if b not in seen:
                    seen.add(b)
                    out, ended = self._last(b, name)
                    entering += out
                    if not ended:
                        waiting += self.earlier.get(b, ())
            self._entering[block, name] = entering
        return found + entering

    def steps(self, at: int, name: str) -> list[tuple[int, str]]:
        """Reads that a read comes from; an empty name stands for the node itself, which comes from what it stands in."""
        found = self._steps.get((at, name))
        if found is None:
            found = []
            if not name:
                control = self.nodes[at][CONTROL]
                if control is not None:
                    c = self.place[control]
                    found = [(c, ""), *((c, r) for r in self.nodes[c][READS] or ())]
            else:
                for d in self.definitions(at, name):
                    flows = self.nodes[d][FLOWS]
                    if self.whole:
                        found.append((d, ""))
                    found += [(d, r) for r in self.nodes[d][READS] or ()] if flows is None else [(d, p["b"]) for p in flows if p["a"] == name]
            self._steps[at, name] = found
        return found

    def walk(self, start: Iterable[tuple[int, str]]) -> set[tuple[int, str]]:
        """All reads that lead to those of `start`, and those."""
        waiting = list(start)
        seen = set(waiting)
        while waiting:
            for x in self.steps(*waiting.pop()):
                if x not in seen:
                    seen.add(x)
                    waiting.append(x)
        return seen


def _batch(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)


def in_programs(programs: DataFrame, solve: Callable[[str, list[tuple], list[tuple]], Iterable[tuple]], arrow: pa.Schema, schema: str) -> DataFrame:
    """What `solve` gives of each packed program (path, program, asked: an array of lines); see `by_file`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, program, asked in zip(*(batch.column(k) for k in range(3)), strict=True):
                out += solve(path.as_py(), pickle.loads(program.as_py()), [(line, None) for line in asked.as_py()])
                if len(out) > HELD:
                    yield _batch(out, arrow)
                    out = []
            yield _batch(out, arrow)

    return programs.where("size(asked) > 0").select("path", "program", "asked").mapInArrow(run, schema)


def by_file(flow: DataFrame, asked: DataFrame, names: tuple[str, ...], solve: Callable[[str, list[tuple], list[tuple]], Iterable[tuple]], arrow: pa.Schema, schema: str, kinds: tuple[str, ...] = ("node", "edge", "error")) -> DataFrame:
    """What `solve` gives of each file with questions: path, its rows of some kinds (by COLUMNS), and its rows of `asked` (by `names`, its columns but path).

    Rows without a path are left out.
    """
    types = {f.name: f.dataType for f in flow.schema}
    rows = flow.where(F.col("kind").isin(*kinds)).select("path", *COLUMNS, *[F.lit(None).cast(asked.schema[n].dataType).alias(f"ask_{n}") for n in names])
    questions = asked.select("path", *[(F.lit("ask") if c == "kind" else F.lit(None).cast(types[c])).alias(c) for c in COLUMNS], *[F.col(n).alias(f"ask_{n}") for n in names])
    dealt = rows.unionByName(questions).where("path is not null").repartition("path").sortWithinPartitions("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        told: list[tuple] = []
        mine: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1 + len(COLUMNS) + len(names))]
            for path, *row in zip(*columns, strict=True):
                if path != at:
                    if mine:
                        out += solve(at, told, mine)
                    at, told, mine = path, [], []
                    if len(out) > HELD:
                        yield _batch(out, arrow)
                        out = []
                if row[KIND] == "ask":
                    mine.append(tuple(row[len(COLUMNS) :]))
                else:
                    told.append(row)
        if mine:  # files without a question need no walk
            out += solve(at, told, mine)
        yield _batch(out, arrow)

    return dealt.mapInArrow(run, schema)


def scopes_of(rows: list[tuple], wanted: set[str], also: Iterable[tuple] = (), whole: bool = True) -> dict[str, Scope]:
    """The wanted scopes of a file; also: reads (node, name) beyond the nodes' own, by the nodes' numbers."""
    nodes: dict[str, list] = {s: [] for s in wanted}
    edges: dict[str, list] = {s: [] for s in wanted}
    for r in rows:
        if r[SCOPE] in wanted and r[KIND] in ("node", "edge"):
            (nodes if r[KIND] == "node" else edges)[r[SCOPE]].append(r)
    out = {}
    for s in wanted:
        scope = out[s] = Scope(nodes[s], edges[s], whole)
        if also:
            scope.also = frozenset((scope.place[n], name) for n, name in also if n in scope.place)
    return out


SLICES = "path string, sink_line int, node array<long>, line array<int>, end_line array<int>, type array<string>, called array<string>, own array<string>, changed array<string>, callees array<string>, broken string"
SLICES_ARROW = pa.schema([("path", pa.string()), ("sink_line", pa.int32()), ("node", pa.list_(pa.int64())), ("line", pa.list_(pa.int32())), ("end_line", pa.list_(pa.int32())), ("type", pa.list_(pa.string())), ("called", pa.list_(pa.string())), ("own", pa.list_(pa.string())), ("changed", pa.list_(pa.string())), ("callees", pa.list_(pa.string())), ("broken", pa.string())])


def slices(named: bool, path: str, rows: list[tuple], asked: list[tuple]) -> Iterator[tuple]:
    """Of each sink of a file (its line and, if `named`, one of the names to track) a row by SLICES: its slice's nodes, the names called there and on the sink's own node, what is changed in place, hazards of callees that are bound here."""
    starting: dict[int, list] = {}
    long: list = []  # nodes of several lines
    broken = None
    for r in rows:
        if r[KIND] == "node":
            starting.setdefault(r[LINE], []).append(r)
            if r[END_LINE] > r[LINE]:
                long.append(r)
        elif r[KIND] == "error":
            broken = min(filter(None, (broken, f"syntax_error: {r[TYPE]}")))
    sinks: dict[int, set[str]] = {}
    for line, name in asked:
        sinks.setdefault(line, set()).update(() if name is None else (name,))
    own: dict[int, list] = {}
    for line in sinks:
        # the narrowest node around the line, with its copies in finally bodies
        around = [r for r in starting.get(line, ()) if r[END_LINE] == line] or [r for r in long if r[LINE] <= line <= r[END_LINE]]
        best = min(((r[END_LINE] - r[LINE], -r[LINE]) for r in around), default=None)
        own[line] = [r for r in around if (r[END_LINE] - r[LINE], -r[LINE]) == best]
    also = frozenset((r[NODE], name) for line, names in sinks.items() for r in own[line] for name in names)
    scopes = scopes_of(rows, {r[SCOPE] for at in own.values() for r in at}, also)
    for line, names in sinks.items():
        if not own[line]:
            yield path, line, None, None, None, None, None, None, None, None, broken
            continue
        picked: dict[int, tuple] = {}
        callees: set[str] = set()
        for r in own[line]:
            scope = scopes[r[SCOPE]]
            at = scope.place[r[NODE]]
            tracked = names if named else r[READS] if r[ARGUMENTS] is None else r[ARGUMENTS]
            for k, name in scope.walk([(at, ""), *((at, n) for n in tracked or ())]):
                if not name:
                    picked[scope.nodes[k][NODE]] = scope.nodes[k]
            for name in r[CALLS] or ():
                for kind in {scope.nodes[d][TYPE] for d in scope.definitions(at, name)} & {"entry", "FunctionDef", "AsyncFunctionDef"}:
                    callees.add(f"{'dynamic_dispatch' if kind == 'entry' else 'interprocedural_call'}:{name}")
        mine = {r[NODE] for r in own[line]}
        nodes = [picked[n] for n in sorted(picked)]
        called = {c for n in nodes if n[NODE] not in mine for c in n[CALLS] or ()}
        here = {c for n in nodes if n[NODE] in mine for c in n[CALLS] or ()}
        changed = {n[MUTATES] for n in nodes if n[MUTATES] is not None}
        yield path, line, [n[NODE] for n in nodes], [n[LINE] for n in nodes], [n[END_LINE] for n in nodes], [n[TYPE] for n in nodes], sorted(called), sorted(here), sorted(changed), sorted(callees), broken


CALL_FACTS = "path string, kind string, scope string, line int, name string, function long, params array<string>, slots array<string>, names array<string>, from_slots array<string>, callers array<long>, from_params array<string>"
CALL_FACTS_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("scope", pa.string()), ("line", pa.int32()), ("name", pa.string()), ("function", pa.int64()), *((c, pa.list_(pa.string())) for c in ("params", "slots", "names", "from_slots")), ("callers", pa.list_(pa.int64())), ("from_params", pa.list_(pa.string()))])


def call_facts(path: str, rows: list[tuple], _: object = None) -> list[tuple]:
    """Of a file (nodes, edges and calls) rows by CALL_FACTS: a function by its entry with its parameters, and a call with the names in each of its arguments (slots, names) and the parameters that those come from (from_slots, callers, from_params)."""
    calls = [r for r in rows if r[KIND] == "call"]
    given = [(r, [(p["a"], p["b"]) for p in r[FLOWS] or ()]) for r in calls]
    scopes = scopes_of(rows, {r[SCOPE] for r, pairs in given if pairs}, {(r[NODE], name) for r, pairs in given for _, name in pairs}, whole=False)
    out = [(path, "function", r[SCOPE], r[LINE], None, r[NODE], r[ARGUMENTS] or [], None, None, None, None, None) for r in rows if r[KIND] == "node" and r[TYPE] == "entry"]
    for r, pairs in given:
        origin: dict[tuple, None] = {}
        for slot, name in pairs:
            scope = scopes[r[SCOPE]]
            for k, read in scope.walk([(scope.place[r[NODE]], name)]):
                for d in scope.definitions(k, read):
                    if scope.nodes[d][TYPE] == "entry":
                        origin[slot, scope.nodes[d][NODE], read] = None
        out.append((path, "call", r[SCOPE], r[LINE], r[TYPE], None, None, [s for s, _ in pairs], [n for _, n in pairs], [s for s, _, _ in origin], [f for _, f, _ in origin], [p for _, _, p in origin]))
    return out
