"""Registered queries over the control flow of code, with their SQL.

Each document becomes a Python file by a fixed rule: six lines in turn become one
function, whose shape (branches, loops, try) follows the first line's length and
whose statements and names follow each line's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import callsites, dataflow
from fathomline.plans.queries import _FILES, files
from fathomline.sources.flow import flow_programs
from fathomline.sources.shared import stored

#: Function shapes: (indent, text), a number standing for that one of six statements, V for the name that the sink gets.
SHAPES = (
    ((1, 0), (1, 1), (1, "if x:"), (2, 2), (1, "else:"), (2, 3), (1, 4), (1, 5), (1, "V")),
    ((1, 0), (1, "while x:"), (2, 1), (2, "if y:"), (3, 2), (3, "break"), (2, 3), (1, 4), (1, 5), (1, "V")),
    ((1, 0), (1, "try:"), (2, 1), (2, 2), (1, "except E:"), (2, 3), (1, "finally:"), (2, 4), (1, 5), (1, "V")),
    ((1, 0), (1, "for y in x:"), (2, 1), (2, "while z:"), (3, 2), (3, "if x:"), (4, "continue"), (3, 3), (2, 4), (1, 5), (1, "V")),
)
NAMES = ("x", "y", "z")


def _name(n: Column, step: int) -> Column:
    return F.get(F.array(*map(F.lit, NAMES)), F.floor(n / step).cast("int") % len(NAMES))


def _statement(n: Column) -> Column:
    """By the line's length: a copy, a sum, a change in place, or a call of an unknown function."""
    a, b, kind = _name(n, 4), _name(n, 12), n % 4
    return F.when(kind == 0, F.concat(a, F.lit(" = "), b)).when(kind == 1, F.concat(a, F.lit(" += "), b)).when(kind == 2, F.concat(a, F.lit(".append("), b, F.lit(")"))).otherwise(F.concat(a, F.lit(" = wash("), b, F.lit(")")))


def _by_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the lengths of each document's lines, taken once: inside a lambda a text would be split again for every line."""
    lengths = F.transform(F.split("content", "\n"), F.length)
    # an explode is a step of its own, so the lengths are not put back into the lambdas that use them
    taken = files(spark, sf_dir).select("doc_id", F.explode(F.array(lengths)).alias("lengths"))
    # the lengths are small, the files made of them are work: they are dealt out anew, however few parts the documents are read in
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return taken.repartition(parts, "doc_id")


def shaped_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a function for each six lines of a document; missing lines count as empty."""

    def function(g: Column) -> Column:
        sizes = [F.coalesce(F.get("lengths", g * 6 + k), F.lit(0)) for k in range(6)]
        bodies = []
        for shape in SHAPES:
            rows = [F.concat(F.lit("    " * depth), _statement(sizes[what]) if isinstance(what, int) else F.concat(F.lit("eval("), _name(sizes[5], 1), F.lit(")")) if what == "V" else F.lit(what)) for depth, what in shape]
            bodies.append(F.concat_ws("\n", F.concat(F.lit("def f"), g.cast("string"), F.lit("(x, y, z):")), *rows))
        kind = sizes[0] % len(SHAPES)
        return F.coalesce(*(F.when(kind == k, b) for k, b in enumerate(bodies)))

    body = F.transform(F.sequence(F.lit(0), F.floor((F.size("lengths") - 1) / 6).cast("int")), function)
    return _by_lines(spark, sf_dir).select(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.array_join(body, "\n").alias("content"))


def flow_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward slices from every sink of the documents' functions, through branches, loops, exceptions and aliases (DF-05..08, DF-20)."""
    programs = flow_programs(shaped_files(spark, sf_dir))
    sinks = F.transform(F.filter("calls", lambda c: c["name"] == "eval"), lambda c: c["line"])
    states = stored(dataflow.program_slices(programs.withColumn("asked", sinks)))
    return states.select("path", "sink_line", F.size("lines").alias("n_lines"), F.aggregate("lines", F.lit(0).cast("long"), lambda a, b: a + b).alias("line_sum"), "status", "reason")


#: What the function of a line does, by the line's length: a sink, the next function by place, a safe call, the next function by keyword.
LINKS = ("    eval(p)", "    NEXT(q, p)", "    print(p)", "    r = q\n    NEXT(q=r)")


def linked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: a function for each line of a document, many of which call the next line's; the last calls the first of the document with the next id."""

    def function(length: Column, i: Column) -> Column:
        after = F.when(i + 1 < F.size("lengths"), F.concat(F.lit("f"), (i + 1).cast("string"))).otherwise(F.lit("onward"))
        body = F.get(F.array(*map(F.lit, LINKS)), length % len(LINKS))
        return F.concat(F.lit("def f"), i.cast("string"), F.lit("(p, q):\n"), F.replace(body, F.lit("NEXT"), after))

    head = F.concat(F.lit("from src.m"), (F.col("doc_id") + 1).cast("string"), F.lit(" import f0 as onward\n"))
    return _by_lines(spark, sf_dir).select(F.concat(F.lit("src/m"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.concat(head, F.array_join(F.transform("lengths", function), "\n")).alias("content"))


def wrapper_call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each file the parameters that reach a sink through any number of calls, and the calls that hand them on (DF-09, DF-13, JON-17)."""
    facts = stored(callsites.file_facts(linked_files(spark, sf_dir)))
    anchors, told = callsites.fact_anchors(facts, callsites.symbol_rows(facts))
    calls = anchors.groupBy("path").agg(F.count(F.lit(1)).alias("anchors"), F.sum("line").alias("anchor_lines"))
    params = told.groupBy("path").agg(F.count(F.lit(1)).alias("params"), F.count_if(F.col("param") == "q").alias("second"))
    return params.join(calls, "path", "full").select("path", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("params", "second", "anchors", "anchor_lines")])


QUERIES = {f.__name__: f for f in (flow_slices, wrapper_call_sites)}

# The shapes as nodes: (shape, node, line after the def's, statement or -1, name read by a test, node it stands in or -1), and as edges between nodes.
# Node 0 binds the parameters; node 20 binds a for's target on the for's line.
_NODES = """(0,0,0,-1,'',-1),(0,1,1,0,'',-1),(0,2,2,1,'',-1),(0,3,3,-1,'x',-1),(0,4,4,2,'',3),(0,6,6,3,'',3),(0,7,7,4,'',-1),(0,8,8,5,'',-1),(0,9,9,-2,'',-1),
(1,0,0,-1,'',-1),(1,1,1,0,'',-1),(1,2,2,-1,'x',-1),(1,3,3,1,'',2),(1,4,4,-1,'y',2),(1,5,5,2,'',4),(1,6,6,-1,'',4),(1,7,7,3,'',2),(1,8,8,4,'',-1),(1,9,9,5,'',-1),(1,10,10,-2,'',-1),
(2,0,0,-1,'',-1),(2,1,1,0,'',-1),(2,3,3,1,'',-1),(2,4,4,2,'',-1),(2,5,5,-1,'',-1),(2,6,6,3,'',-1),(2,8,8,4,'',-1),(2,9,9,5,'',-1),(2,10,10,-2,'',-1),
(3,0,0,-1,'',-1),(3,1,1,0,'',-1),(3,2,2,-1,'x',-1),(3,20,2,-3,'',2),(3,3,3,1,'',2),(3,4,4,-1,'z',2),(3,5,5,2,'',4),(3,6,6,-1,'x',4),(3,7,7,-1,'',6),(3,8,8,3,'',4),(3,9,9,4,'',2),(3,10,10,5,'',-1),(3,11,11,-2,'',-1)"""
_EDGES = """(0,0,1),(0,1,2),(0,2,3),(0,3,4),(0,3,6),(0,4,7),(0,6,7),(0,7,8),(0,8,9),
(1,0,1),(1,1,2),(1,2,3),(1,3,4),(1,4,5),(1,5,6),(1,6,8),(1,4,7),(1,7,2),(1,2,8),(1,8,9),(1,9,10),
(2,0,1),(2,1,3),(2,3,4),(2,1,5),(2,3,5),(2,4,5),(2,5,6),(2,4,8),(2,6,8),(2,8,9),(2,9,10),
(3,0,1),(3,1,2),(3,2,20),(3,20,3),(3,3,4),(3,4,5),(3,5,6),(3,6,7),(3,7,4),(3,6,8),(3,8,4),(3,4,9),(3,9,2),(3,2,10),(3,10,11)"""
_HEIGHTS = "[10, 11, 11, 12]"

SQL: dict[str, str] = {
    "flow_slices": f"""
WITH RECURSIVE {_FILES},
nodes AS MATERIALIZED (SELECT * FROM (VALUES {_NODES}) AS t(shape, node, line, slot, test, control)),
edges AS MATERIALIZED (SELECT * FROM (VALUES {_EDGES}) AS t(shape, a, b)),
l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i FROM files),
g AS (SELECT doc_id, i // 6 AS g, coalesce(max(CASE WHEN i % 6 = 0 THEN length(text) END), 0) AS n0, coalesce(max(CASE WHEN i % 6 = 1 THEN length(text) END), 0) AS n1, coalesce(max(CASE WHEN i % 6 = 2 THEN length(text) END), 0) AS n2,
  coalesce(max(CASE WHEN i % 6 = 3 THEN length(text) END), 0) AS n3, coalesce(max(CASE WHEN i % 6 = 4 THEN length(text) END), 0) AS n4, coalesce(max(CASE WHEN i % 6 = 5 THEN length(text) END), 0) AS n5
  FROM l GROUP BY ALL),
f AS (SELECT doc_id, g, n0 % 4 AS shape, [n0, n1, n2, n3, n4, n5] AS n, sum({_HEIGHTS}[n0 % 4 + 1]) OVER (PARTITION BY doc_id ORDER BY g) - {_HEIGHTS}[n0 % 4 + 1] + 1 AS top FROM g),
s AS (SELECT doc_id, g, f.shape, top, node, line, slot, test, control, CASE WHEN slot >= 0 THEN n[slot + 1] WHEN slot = -2 THEN n[6] END AS n FROM f JOIN nodes USING (shape)),
p AS MATERIALIZED (SELECT *, CASE WHEN slot >= 0 THEN n % 4 END AS kind, CASE WHEN slot >= 0 THEN ['x','y','z'][(n // 4) % 3 + 1] END AS a, CASE WHEN slot >= 0 THEN ['x','y','z'][(n // 12) % 3 + 1] WHEN slot = -2 THEN ['x','y','z'][n % 3 + 1] END AS b FROM s),
pairs AS (SELECT doc_id, g, a, b FROM p WHERE kind IN (0, 2) UNION SELECT doc_id, g, 'y', 'x' FROM p WHERE slot = -3),
met AS (SELECT doc_id, g, bool_or(a || b IN ('xy', 'yx')) AS xy, bool_or(a || b IN ('xz', 'zx')) AS xz, bool_or(a || b IN ('yz', 'zy')) AS yz FROM pairs GROUP BY ALL),
joined AS (SELECT doc_id, g, xy OR (xz AND yz) AS xy, xz OR (xy AND yz) AS xz, yz OR (xy AND xz) AS yz FROM met),
binds AS MATERIALIZED (
  SELECT doc_id, g, shape, node, v AS name, true AS strong FROM p, (VALUES ('x'), ('y'), ('z')) t(v) WHERE node = 0
  UNION ALL SELECT doc_id, g, shape, node, 'y', true FROM p WHERE slot = -3
  UNION ALL SELECT doc_id, g, shape, node, a, true FROM p WHERE kind <> 2
  UNION ALL SELECT doc_id, g, shape, node, a, false FROM p WHERE kind = 2
  UNION ALL SELECT p.doc_id, p.g, shape, node, v, false FROM p JOIN joined j USING (doc_id, g), (VALUES ('x'), ('y'), ('z')) t(v) WHERE kind = 2 AND v <> a AND CASE WHEN v || a IN ('xy', 'yx') THEN j.xy WHEN v || a IN ('xz', 'zx') THEN j.xz ELSE j.yz END),
reads AS MATERIALIZED (
  SELECT doc_id, g, node, b AS name FROM p WHERE b IS NOT NULL
  UNION SELECT doc_id, g, node, a FROM p WHERE kind IN (1, 2)
  UNION SELECT doc_id, g, node, test FROM p WHERE test <> ''
  UNION SELECT doc_id, g, node, 'x' FROM p WHERE slot = -3),
reach AS (
  SELECT b.doc_id, b.g, b.shape, e.b AS node, b.name, b.node AS def FROM binds b JOIN edges e ON e.shape = b.shape AND e.a = b.node
  UNION SELECT r.doc_id, r.g, r.shape, e.b, r.name, r.def FROM reach r JOIN edges e ON e.shape = r.shape AND e.a = r.node
    WHERE NOT EXISTS (SELECT 1 FROM binds k WHERE k.doc_id = r.doc_id AND k.g = r.g AND k.node = r.node AND k.name = r.name AND k.strong)),
steps AS (
  SELECT r.doc_id, r.g, r.node, r.def FROM reach r JOIN reads d USING (doc_id, g, node, name)
  UNION SELECT doc_id, g, node, control FROM p WHERE control >= 0),
slice AS (
  SELECT doc_id, g, node FROM p WHERE slot = -2
  UNION SELECT s.doc_id, s.g, t.def FROM slice s JOIN steps t USING (doc_id, g, node)),
told AS (SELECT p.doc_id, p.g, p.top, p.line, p.slot, p.kind, p.a FROM slice JOIN p USING (doc_id, g, node)),
hazards AS (
  SELECT doc_id, g, 'interprocedural_call:wash' AS h FROM told WHERE kind = 3
  UNION SELECT doc_id, g, 'alias_escape' FROM told WHERE kind = 2
  UNION SELECT doc_id, g, 'alias_escape:' || a FROM told WHERE kind = 2),
why AS (SELECT doc_id, g, string_agg(h, '; ' ORDER BY h) AS reason FROM hazards GROUP BY ALL),
sums AS (SELECT doc_id, g, max(CASE WHEN slot = -2 THEN top + line END) AS sink_line, count(DISTINCT line) AS n_lines, sum(DISTINCT top + line) AS line_sum FROM told GROUP BY ALL)
SELECT 'src/m' || doc_id || '.py' AS path, CAST(sink_line AS INTEGER) AS sink_line, CAST(n_lines AS INTEGER) AS n_lines, CAST(line_sum AS BIGINT) AS line_sum,
  CASE WHEN reason IS NULL THEN 'complete' ELSE 'partial' END AS status, coalesce(reason, 'backward_slice_complete') AS reason
FROM sums LEFT JOIN why USING (doc_id, g)
""",
    "wrapper_call_sites": f"""
WITH RECURSIVE {_FILES},
l AS (SELECT doc_id, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS i, len(string_split(content, chr(10))) AS n FROM files),
f AS MATERIALIZED (SELECT doc_id, i, length(text) % 4 AS k, CASE WHEN i + 1 < n THEN doc_id ELSE doc_id + 1 END AS next_doc, CASE WHEN i + 1 < n THEN i + 1 ELSE 0 END AS next_i,
  1 + sum(CASE WHEN length(text) % 4 = 3 THEN 3 ELSE 2 END) OVER (PARTITION BY doc_id ORDER BY i) AS line FROM l),
bound AS MATERIALIZED (SELECT f.*, param, caller FROM f JOIN (VALUES (1, 'p', 'q'), (1, 'q', 'p'), (3, 'q', 'q')) AS t(kind, param, caller) ON k = kind),
told AS (
  SELECT doc_id, i, 'p' AS param FROM f WHERE k = 0
  UNION SELECT b.doc_id, b.i, b.caller FROM told t JOIN bound b ON b.next_doc = t.doc_id AND b.next_i = t.i AND b.param = t.param),
sites AS (SELECT b.doc_id, b.line FROM bound b JOIN told t ON b.next_doc = t.doc_id AND b.next_i = t.i AND b.param = t.param),
a AS (SELECT doc_id, count(*) AS anchors, sum(line) AS anchor_lines FROM sites GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS params, count(*) FILTER (param = 'q') AS second FROM told GROUP BY doc_id)
SELECT 'src/m' || doc_id || '.py' AS path, coalesce(params, 0)::BIGINT AS params, coalesce(second, 0)::BIGINT AS second, coalesce(anchors, 0)::BIGINT AS anchors, coalesce(anchor_lines, 0)::BIGINT AS anchor_lines
FROM p FULL JOIN a USING (doc_id)
""",
}
