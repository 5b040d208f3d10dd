"""Calls of functions that pass an argument on to a dangerous call (DF-04, DF-09, DF-10, DF-13, FLT-11, FLT-12, FLT-16), across files.

A function's summary says which of its parameters reach which category of sink.
Arguments are followed back to parameters through reaching definitions, so a
rebound parameter does not count; calls meet the functions that they name in
their own file, or through imports (JON-17), and arguments meet parameters by
place or keyword.  Summaries then spread from callee to caller until none is new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.operators import walks
from fathomline.operators.code import CALL_RULES, LDAP_METHODS, SHELL_CALLS, XPATH_METHODS, module_names, resolve_symbols
from fathomline.operators.dataflow import fixpoint, inherited
from fathomline.sources import flow as flow_source
from fathomline.sources import syntax
from fathomline.sources.shared import stored

#: Category and names of its calls, most telling first; names of the pinned rules unless others are given.
SIGNATURES: tuple[tuple[str, tuple[str, ...]], ...] = (
    *((rule.removeprefix("python-").upper().replace("-", "_"), names) for rule, _, _, names in CALL_RULES),
    ("INSECURE_SUBPROCESS_SHELL", (*SHELL_CALLS, "os.system", "os.popen")),
    ("SQL_INJECTION", ("cursor.execute", "cursor.executemany", "connection.execute", "session.execute")),
    ("PATH_TRAVERSAL_OPEN", ("open", "os.open", "shutil.*")),
    ("LDAP_INJECTION", tuple(f"ldap.{m}" for m in LDAP_METHODS)),
    ("XPATH_INJECTION", ("etree.XPath", *(f"etree.{m}" for m in XPATH_METHODS))),
    ("WEAK_HASHING", ("hashlib.new",)),
    ("INSECURE_COOKIE", ("response.set_cookie",)),
)


def name_matches(call: Column, signature: str) -> Column:
    """FLT-11: equal, one a dotted ending of the other, or, for a signature that ends in .*, below its prefix anywhere."""
    if signature.endswith(".*"):
        prefix = signature[:-2]
        return (call == prefix) | F.startswith(call, F.lit(f"{prefix}.")) | F.contains(call, F.lit(f".{prefix}."))
    return (call == signature) | F.endswith(call, F.lit(f".{signature}")) | ((call != "") & F.endswith(F.lit(signature), F.concat(F.lit("."), call)))


def heuristic_category(call: Column) -> Column:
    """DF-10: the category that a custom wrapper's object or method stands for, else null; JSON readers and safe calls stand for none."""
    last, dot = F.substring_index(call, ".", -1), F.contains(call, F.lit("."))
    safe = call.isin(*fixed.SAFE_CALLS) | (call == "json.loads") | reduce(lambda a, b: a | b, [F.endswith(call, F.lit(e)) for e in fixed.HEURISTIC_SAFE])
    told = [F.when(reduce(lambda a, b: a | b, [name_matches(call, p) for p in prefixes]), category) for category, prefixes in fixed.HEURISTIC_OBJECTS]
    told += [F.when(last.isin(*methods) & (dot | ~last.isin(*fixed.HEURISTIC_BARE)), category) for category, methods in fixed.HEURISTIC_METHODS]
    return F.when(~safe & (call != ""), F.coalesce(*told))


def sink_category(call: Column, signatures=SIGNATURES) -> Column:
    """FLT-16: the category of a call: by an equal name, then unless it is a safe call by a matching one, then by what a wrapper is called; else null."""
    call = F.trim(F.coalesce(call, F.lit("")))
    equal = F.coalesce(*[F.when(call.isin(*names), category) for category, names in signatures])
    alike = F.coalesce(*[F.when(reduce(lambda a, b: a | b, [name_matches(call, n) for n in names]), category) for category, names in signatures])
    return F.when(call != "", F.coalesce(equal, F.when(~call.isin(*fixed.SAFE_CALLS), F.coalesce(alike, heuristic_category(call)))))


def _met(functions: DataFrame, calls: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of `calls` with the functions that they name: function, params, wrapper (the function's name), by_attribute.

    A call meets the functions of its own file that bear the last part of its
    name; a plain name that the file does not define meets what its imports lead to,
    and a name behind a module's alias that module's function.
    functions, calls: by walks.CALL_FACTS; rows: syntax rows of the same files.
    """
    entries = functions.select("path", "function", "params", F.col("line").alias("at"), F.substring_index("scope", ".", -1).alias("last"))
    held = ["path", "line", "written", "slots", "names", "from_slots", "callers", "from_params", "last", "by_attribute"]
    calls = calls.where("name <> ''").select("*", F.col("name").alias("written"), F.substring_index("name", ".", -1).alias("last"), F.contains("name", F.lit(".")).alias("by_attribute")).select(held)
    # the left join keeps what no function of the file answers to
    both = stored(calls.join(entries.drop("at"), ["path", "last"], "left"))
    own, away = both.where("function is not null"), both.where("function is null").select(held)
    paths = rows.select("path").distinct()
    plain = away.where("not by_attribute")
    found = resolve_symbols(rows, paths, plain.select("path", F.col("written").alias("symbol")).distinct())
    led = plain.join(found.select(F.col("asked").alias("path"), F.col("wanted").alias("written"), F.col("path").alias("there"), F.col("line").alias("at")), ["path", "written"])
    led = led.join(entries.withColumnRenamed("path", "there").withColumnRenamed("last", "bears"), ["there", "at"]).withColumn("last", F.col("bears"))
    imports = rows.where("kind = 'import'").select("path", F.col("target").alias("head"), F.when(F.col("names").isNull(), F.col("name")).otherwise(F.concat_ws(".", F.when(F.col("name") != "", F.col("name")), F.element_at("names", 1))).alias("module"))
    behind = away.where("by_attribute").withColumn("head", F.substr("written", F.lit(1), F.length("written") - F.length("last") - 1))
    behind = behind.join(imports, ["path", "head"]).join(module_names(paths).withColumnRenamed("path", "there"), "module")
    behind = behind.join(entries.withColumnRenamed("path", "there"), ["there", "last"]).withColumn("by_attribute", F.lit(False))
    columns = [*held, "function", "params"]
    return own.select(columns).unionByName(led.select(columns)).unionByName(behind.select(columns)).withColumnRenamed("last", "wrapper")


_FUNCTION = re.compile(r"^(?=def )", re.M)
_SYMBOL = "kind string, scope string, name string, line int, end_line int, target string, args array<string>, names array<string>, level int"
_FACTS = pa.schema([*walks.CALL_FACTS_ARROW, ("row", pa.struct([syntax._ARROW.field(k) for k in range(1, len(syntax._ARROW))]))])
#: Longest text of a function that a worker remembers.
SHORT = 2_000


def _facts(text: str) -> tuple[list[tuple], list[tuple], int] | None:
    """Call facts of a text, what its module binds and imports, and how many nodes it has; None if it does not parse."""
    rows = flow_source.rows_of("", text)
    if any(r["kind"] == "error" for r in rows):
        return None
    names = [r for r in syntax.rows_of("", text) if r[1] == "import" or (r[2] == "" and r[1] in ("function", "class", "statement"))]
    # a statement's branch names lines, and nothing asks for it here
    names = [(*r[1:6], None, r[7], None, None) if r[1] == "statement" else r[1:] for r in names]
    return walks.call_facts("", [[r.get(c) for c in flow_source.COLUMNS] for r in rows]), names, sum(r["kind"] == "node" for r in rows)


_remembered = lru_cache(maxsize=20_000)(_facts)


def facts_of(path: str, source: str, first: int = 0) -> tuple[list[tuple], int]:
    """Rows of one file by `file_facts`, its functions numbered from `first`, and the next free number.

    Bindings and calls of a function stay inside it, so a file is cut before each
    `def` at a line's beginning, and equal pieces of any files are read once by a
    worker.  Pieces that parse by themselves are the file's statements; if one does
    not, the file is read whole.
    """
    pieces = [p for p in _FUNCTION.split(source) if p] if "\r" not in source else [source]
    told = [(_remembered if len(p) <= SHORT else _facts)(p) for p in pieces]
    if None in told:
        pieces, told = [source], [_facts(source)]
    if told == [None]:
        return [(path, "symbol", *[None] * 10, syntax.rows_of(path, source)[0][1:])], first
    out, above = [], 0
    for piece, (facts, names, nodes) in zip(pieces, told, strict=True):
        for _, kind, scope, line, name, function, params, slots, given, from_slots, callers, from_params in facts:
            out.append((path, kind, scope, line + above, name, None if function is None else function + first, params, slots, given, from_slots, callers and [c + first for c in callers], from_params, None))
        out += [(path, "symbol", *[None] * 10, (*r[:3], r[3] + above, r[4] + above, *r[5:])) for r in names]
        above += piece.count("\n")
        first += nodes
    return out, first


def file_facts(files: DataFrame) -> DataFrame:
    """Of every file (path, content) its call facts (walks.CALL_FACTS), and as kind symbol in `row` the syntax rows that say what its names mean: what its module binds, and imports."""
    fields = [f.name for f in _FACTS.field("row").type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for batch in batches:
            held: list[tuple] = []
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                with syntax.unhurried():
                    rows, first = facts_of(path.as_py(), content.as_py() or "", first)
                held += rows
                if len(held) > syntax.HELD:
                    yield taken(held)
                    held = []
            yield taken(held)

    def taken(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(_FACTS)
        symbols = [r and dict(zip(fields, r, strict=True)) for r in columns[-1]]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip([*columns[:-1], symbols], _FACTS, strict=True)], schema=_FACTS)

    return files.select("path", "content").mapInArrow(run, f"{walks.CALL_FACTS}, row struct<{', '.join(x.replace(' ', ': ', 1) for x in _SYMBOL.split(', '))}>")


def symbol_rows(facts: DataFrame) -> DataFrame:
    """The syntax rows in the facts of files."""
    return facts.where("kind = 'symbol'").select("path", "row.*")


def call_site_anchors(flow: DataFrame, rows: DataFrame, signatures=SIGNATURES, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """DF-09: the anchors (path, line, call, wrapper, category, name), a row for each name in an argument that its callee passes on to a sink; and the summaries (path, function, param, category).

    flow: stored control-flow rows; rows: syntax rows of the same files, for imports.
    A function without such a parameter that calls a sink itself passes on its only parameter,
    self and cls aside (as a value read through something else may).  Safe calls
    are no sinks.  `limit` bounds the hops, for those who want no farther wrappers.
    """
    asked = flow.select("path", F.lit(1).alias("one")).distinct()
    return fact_anchors(stored(walks.by_file(flow, asked, ("one",), walks.call_facts, walks.CALL_FACTS_ARROW, walks.CALL_FACTS, ("node", "edge", "call"))), rows, signatures, limit)


def fact_anchors(facts: DataFrame, rows: DataFrame, signatures=SIGNATURES, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`call_site_anchors` from stored facts of functions and calls (walks.CALL_FACTS)."""
    functions, calls = facts.where("kind = 'function'"), facts.where("kind = 'call'")
    # stored first: the category's many conditions are for distinct names, not for calls
    named = stored(stored(calls.select("name").distinct()).select("name", sink_category(F.col("name"), signatures).alias("category")).where("category is not null"))
    direct = calls.join(named, "name")
    met = stored(_met(functions, calls, rows))

    base = direct.select("category", F.inline(F.arrays_zip("callers", "from_params"))).select(F.col("callers").alias("function"), F.col("from_params").alias("param"), "category").distinct()
    plain = F.filter("params", lambda p: ~p.isin("self", "cls"))
    single = functions.where(F.size(plain) == 1).select("path", "scope", "function", F.element_at(plain, 1).alias("param"))
    only = direct.select("path", "scope", "category").distinct().join(single, ["path", "scope"]).join(base.select("function").distinct(), "function", "left_anti").select("function", "param", "category")
    base = stored(base.unionByName(only.distinct()))

    # slot of a call to parameter of its callee: places count on behind self where a method is called by attribute
    shift = (F.col("by_attribute") & F.coalesce(F.get("params", F.lit(0)).isin("self", "cls"), F.lit(False))).cast("int")

    def callee_param(slot: Column) -> Column:
        place = slot.try_cast("int")
        return F.when(place.isNotNull(), F.get("params", place + shift)).when(F.array_contains("params", slot), slot)

    led = met.select("function", "params", "by_attribute", F.inline(F.arrays_zip("from_slots", "callers", "from_params")))
    spread = stored(led.select("function", callee_param(F.col("from_slots")).alias("param"), F.col("callers").alias("caller"), F.col("from_params").alias("of")).where("param is not null").distinct())

    if limit is None:
        node = F.concat_ws(":", F.col("function").cast("string"), "param")
        led = spread.select(F.concat_ws(":", F.col("caller").cast("string"), "of").alias("node"), node.alias("next"))
        marked = inherited(base.select(node.alias("node"), F.col("category").alias("mark")), led)
        parts = F.split("node", ":", 2)
        summaries = stored(marked.select(parts[0].cast("long").alias("function"), parts[1].alias("param"), F.col("mark").alias("category")))
    else:

        def up(some: DataFrame) -> DataFrame:
            return some.join(spread, ["function", "param"]).select(F.col("caller").alias("function"), F.col("of").alias("param"), "category")

        summaries = stored(fixpoint(base, up, limit)[0])
    sites = met.select("path", "line", "written", "wrapper", "function", "params", "by_attribute", F.inline(F.arrays_zip("slots", "names")))
    sites = sites.select("path", "line", F.col("written").alias("call"), "wrapper", "function", callee_param(F.col("slots")).alias("param"), F.col("names").alias("name")).where("param is not null")
    anchors = sites.join(summaries, ["function", "param"]).select("path", "line", "call", "wrapper", "category", "name").distinct()
    told = summaries.join(functions.select("function", "path", "scope"), "function").select("path", F.col("scope").alias("function"), "param", "category")
    return anchors, told
