"""Registered queries over what models answer, with their SQL.

The findings of a document stand in for a model's answer: a JSON list under the
names that models use, cut off at a fifth to all of its length by the document's id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.plans.queries import _FINDINGS, findings
from fathomline.sources import responses

#: What the answer calls a detector's type, and the type and CWE that it stands for (none: it goes).
NAMES = (
    (1, "HARD_CODED_CREDENTIALS", "HARDCODED_CREDENTIALS", "CWE-798"),
    (2, "sensitive data-exposure", "SENSITIVE_DATA_EXPOSURE", "CWE-Other"),
    (3, "something odd", None, None),
    (4, "CODEINJ", "CODE_INJECTION", "CWE-94"),
    (5, "SQLi", "SQL_INJECTION", "CWE-89"),
    (6, "walks a path", "PATH_TRAVERSAL", "CWE-22"),
    (51, "INJECTION", "INJECTION", "CWE-Other"),
    (52, "a CWE-798 issue", "HARDCODED_CREDENTIALS", "CWE-798"),
    (53, "eval of input", "CODE_INJECTION", "CWE-94"),
    (54, "EXCESSIVE_DATA_EXPOSURE", "EXCESSIVE_DATA_EXPOSURE", "CWE-Other"),
    (55, "Cross-Site Request Forgery", "CSRF", "CWE-352"),
)
#: Scores as written, and what they mean.
SCORES = (("CVSS:3.1/AV:N/C:H/I:L/A:N", 4.3), ("crit", 9.5), ("7.2", 7.2))
HEAD, TAIL = '{"vulnerabilities": [', "]}"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file, response: each file's findings as an answer, cut at a fifth of its length for each that the document's id modulo 5 has, and one more."""
    f = findings(spark, sf_dir)
    name = F.coalesce(*[F.when(F.col("rule_id") == f"rule-{k}", F.lit(n)) for k, n, _, _ in NAMES])
    score = F.get(F.array(*[F.lit(s) for s, _ in SCORES]), F.col("start_line") % len(SCORES))
    item = F.concat(F.lit('{"type": "'), name, F.lit('", "severity": "high", "location": {"start_line": '), F.col("start_line").cast("string"), F.lit('}, "cvss_score": "'), score, F.lit('"}'))
    doc = F.regexp_extract("file_path", r"/(\d+)\.txt$", 1).try_cast("long")
    # a file's findings are one answer by nature
    whole = f.groupBy(F.col("file_path").alias("file"), doc.alias("doc")).agg(F.array_sort(F.collect_list(F.struct("seq", item.alias("item")))).alias("items"))
    text = F.concat(F.lit(HEAD), F.array_join(F.transform("items", lambda x: x["item"]), ", "), F.lit(TAIL))
    return whole.select("file", F.substr(text, F.lit(1), F.floor(F.length(text) * (F.pmod("doc", F.lit(5)) + 1) / 5).cast("int")).alias("response"))


def cut_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What whole and cut answers still give, by type, CWE and score (PRJ-15..19)."""
    found = responses.findings_of(responses.response_items(answers(spark, sf_dir)))
    return found.groupBy("type", "cwe_id", "severity", "salvaged", "cvss_score").agg(F.count(F.lit(1)).alias("n"), F.sum("start_line").alias("lines"), F.sum("place").cast("long").alias("places"))


QUERIES = {f.__name__: f for f in (cut_answers,)}

_NAMES = ", ".join(f"('rule-{k}', '{n}', {f'{t!r}' if t else 'NULL'}, {f'{c!r}' if c else 'NULL'})" for k, n, t, c in NAMES)
_SCORES = ", ".join(f"({k}, '{s}', {v}::DOUBLE)" for k, (s, v) in enumerate(SCORES))
# An object whose location is whole is closed behind it, so its score may be lost.
SQL: dict[str, str] = {
    "cut_answers": f"""
WITH {_FINDINGS}, names(rule_id, name, told, cwe) AS (VALUES {_NAMES}), scores(k, written, score) AS (VALUES {_SCORES}),
items AS (
  SELECT file_path, seq, start_line, told, cwe, score, length('{{"type": "", "severity": "high", "location": {{"start_line": }}, "cvss_score": ""}}') + length(name) + length(CAST(start_line AS VARCHAR)) + length(written) AS size,
    length('{{"type": "", "severity": "high", "location": {{"start_line": }}') + length(name) + length(CAST(start_line AS VARCHAR)) AS place_size
  FROM findings JOIN names USING (rule_id) JOIN scores ON start_line % {len(SCORES)} = k),
placed AS (
  SELECT *, row_number() OVER w - 1 AS place, {len(HEAD)} + sum(size + 2) OVER w - 2 AS ends, {len(HEAD) + len(TAIL)} + sum(size + 2) OVER (PARTITION BY file_path) - 2 AS total
  FROM items WINDOW w AS (PARTITION BY file_path ORDER BY seq)),
cut AS (SELECT p.*, total * (doc_id % 5 + 1) // 5 AS kept FROM placed p JOIN files ON path = file_path)
SELECT told AS type, cwe AS cwe_id, 'HIGH' AS severity, kept < total AS salvaged, CASE WHEN kept >= ends THEN score ELSE 5 END AS cvss_score, count(*) AS n, sum(start_line)::BIGINT AS lines, sum(place)::BIGINT AS places
FROM cut WHERE ends - size + place_size <= kept AND told IS NOT NULL GROUP BY ALL
""",
}
