"""Python files as rows: scopes, imports, calls, and what each statement binds and reads (DF-01..03, DF-11..16).

A statement's `target` is its branch: for each compound statement around it in
its scope `line:arm:arms/`, where arms is how many there are if one surely runs, else 0.

A small helper walks one file's syntax tree and emits rows; everything that
relates rows to each other is done by joins (fathomline.operators.code).
"""

from __future__ import annotations

import ast
import gc
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "path string, kind string, scope string, name string, line int, end_line int, target string, args array<string>, names array<string>, level int"

_STRINGS = pa.list_(pa.string())
_ARROW = pa.schema([("path", pa.string()), ("kind", pa.string()), ("scope", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("end_line", pa.int32()), ("target", pa.string()), ("args", _STRINGS), ("names", _STRINGS), ("level", pa.int32())])
#: Rows that a task holds at a time, beside those of one file.
HELD = 20_000


def _dotted(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _dotted(node.value)
        return f"{base}.{node.attr}" if base else f"?.{node.attr}"
    return ""


def _shape(node: ast.AST) -> str:
    """What an argument is: its literal, or how it is built."""
    if isinstance(node, ast.Constant):
        return repr(node.value)
    if isinstance(node, ast.JoinedStr):
        return "f-string"
    if isinstance(node, ast.BinOp):
        return {ast.Add: "+", ast.Mod: "%"}.get(type(node.op), "operator")
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute) and node.func.attr == "format":
        return ".format"
    return _dotted(node) or "expression"


_APART = (ast.stmt, ast.ExceptHandler, ast.match_case, ast.expr_context)


def _own(statement: ast.stmt) -> Iterator[ast.AST]:
    """A statement's nodes without the statements inside it."""
    queue: list[ast.AST] = [statement]
    while queue:
        node = queue.pop()
        yield node
        for field in node._fields:
            child = getattr(node, field, None)
            if type(child) is list:
                queue += [c for c in child if isinstance(c, ast.AST) and not isinstance(c, _APART)]
            elif isinstance(child, ast.AST) and not isinstance(child, _APART):
                queue.append(child)


@contextmanager
def unhurried() -> Iterator[None]:
    """For one file: its tree is no garbage, so the collector does not search it again and again while it grows."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def rows_of(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as broken:
        return [(path, "error", "", type(broken).__name__, getattr(broken, "lineno", None) or 1, None, None, None, None, None)]
    out: list[tuple] = []

    def visit(body: list[ast.stmt], scope: str, guards: list[str], branch: str) -> None:
        for s in body:
            line, end = s.lineno, s.end_lineno
            if isinstance(s, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{scope}.{s.name}" if scope else s.name
                params = [] if isinstance(s, ast.ClassDef) else [a.arg for a in [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs, *filter(None, (s.args.vararg, s.args.kwarg))]]
                out.append((path, "class" if isinstance(s, ast.ClassDef) else "function", scope, name, line, end, s.name, params, [_dotted(d.func if isinstance(d, ast.Call) else d) for d in s.decorator_list], None))
                visit(s.body, name, [], "")
                continue
            if isinstance(s, (ast.Import, ast.ImportFrom)):
                for a in s.names:
                    module = a.name if isinstance(s, ast.Import) else (s.module or "")
                    out.append((path, "import", scope, module, line, end, a.asname or a.name, None, None if isinstance(s, ast.Import) else [a.name], getattr(s, "level", 0) or 0))
                continue
            loaded: set[str] = set()
            binds: set[str] = set()
            calls: list[ast.Call] = []
            for n in _own(s):
                kind = type(n)
                if kind is ast.Name:
                    (loaded if type(n.ctx) is ast.Load else binds).add(n.id)
                elif kind is ast.Call:
                    calls.append(n)
                # a change inside a container or an object changes its name
                elif kind is ast.Attribute or kind is ast.Subscript:
                    if type(n.ctx) is ast.Store:
                        binds.add(_dotted(n if kind is ast.Attribute else n.value).split(".")[0])
            reads = sorted(loaded)
            binds -= {"", "?"}
            head = end if not hasattr(s, "body") else line
            out.append((path, "statement", scope, type(s).__name__, line, head, branch, sorted(binds), sorted({*reads, *guards}), None))
            for n in calls:
                args = [_shape(a) for a in n.args] + [f"{k.arg or '**'}={_shape(k.value)}" for k in n.keywords]
                used = sorted({m.id for a in [*n.args, *(k.value for k in n.keywords)] for m in _own(a) if type(m) is ast.Name})
                out.append((path, "call", scope, _dotted(n.func) or "?", n.lineno, n.end_lineno, None, args, used, len(n.args)))
            if not hasattr(s, "body") and not hasattr(s, "cases"):
                continue
            inner = [*guards, *reads] if isinstance(s, (ast.If, ast.While)) else guards
            arms = [getattr(s, "body", []), getattr(s, "orelse", []), *[p.body for p in [*getattr(s, "handlers", []), *getattr(s, "cases", [])]]]
            # only the arms of an if with an else are sure to hold one that runs; 0 stands for no such number
            of = 2 if isinstance(s, ast.If) and s.orelse else 0
            for k, arm in enumerate(arms):
                sure = isinstance(s, (ast.With, ast.AsyncWith))
                visit(arm, scope, inner, branch if sure else f"{branch}{line}:{k}:{of}/")
            visit(getattr(s, "finalbody", []), scope, inner, branch)

    visit(tree.body, "", [], "")
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def batches_of(files: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of files (path, content) as they come, a file at a time."""
    held: list[tuple] = []
    for batch in files:
        for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
            with unhurried():
                held += rows_of(path.as_py(), content.as_py() or "")
            if len(held) > HELD:
                yield _batch(held)
                held = []
    yield _batch(held)


def syntax_rows(files: DataFrame) -> DataFrame:
    """Rows of every file (path, content); a file that does not parse is one row of kind error."""
    return files.select("path", "content").mapInArrow(batches_of, SCHEMA)
