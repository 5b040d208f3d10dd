"""Evidence for verdicts: issue, policy, taint paths with their code, patches and definitions (JON-20, FLT-09, PRJ-20..21, PRJ-41, PRJ-48, DF-17, RNK-08, RNK-11)."""

from __future__ import annotations

import ast
import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from fathomline.functions.rules import posix_path
from fathomline.functions.scalars import lines_of

# Words of a type's name that ask for a taint path, and names of step kinds.
TAINT_WORDS = ("sql", "command", "traversal", "xss", "code_injection", "rce")
STEP_KINDS = {"propagator": "propagation", "imported-call": "imported_call", "imported-sink": "imported_sink", "sanitize": "sanitizer", "sanitise": "sanitizer"}
KNOWN_KINDS = ("source", "propagation", "sanitizer", "imported_call", "imported_sink", "sink")


def issue(requests: DataFrame, snapshots: DataFrame, files: DataFrame) -> DataFrame:
    """JON-20: requests with state (valid, or why not) and, where valid, content, content_hash, excerpt_hash and evidence_id.

    requests: request, snapshot_id, path, start_line, end_line, content (may be
    null); snapshots: snapshot_id, path, sha256; files: path, content.  The first
    reason counts: no such snapshot, no such file, not in the snapshot, changed
    since, lines out of range, other text than the file's.
    """
    ids = snapshots.select("snapshot_id").distinct().withColumn("__known", F.lit(True))
    told = requests.withColumnRenamed("content", "__said").join(ids, "snapshot_id", "left").join(snapshots.select("snapshot_id", "path", F.col("sha256").alias("content_hash")), ["snapshot_id", "path"], "left").join(files.select("path", F.col("content").alias("__text")), "path", "left")
    lines = F.split(F.regexp_replace("__text", r"\r\n?", "\n"), "\n")
    lines = F.when(F.endswith("__text", F.lit("\n")), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    told = told.withColumn("__lines", lines)
    total, start, end = F.size("__lines"), F.col("start_line"), F.col("end_line")
    inside = (start >= 1) & (end >= start) & (end <= total)
    told = told.withColumn("__own", F.when(inside, F.array_join(F.slice("__lines", F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0))), "\n")))
    said = F.regexp_replace(F.regexp_replace("__said", r"\r\n?", "\n"), r"\n\z", "")
    state = (
        F.when(F.col("__known").isNull(), "no snapshot")
        .when(F.col("__text").isNull(), "no file")
        .when(F.col("content_hash").isNull(), "not in snapshot")
        .when(F.col("content_hash") != F.sha2("__text", 256), "changed")
        .when(~inside, "out of range")
        .when(said != F.regexp_replace("__own", r"\n\z", ""), "fabricated")
        .otherwise("valid")
    )
    told = told.withColumn("state", state)
    good = F.col("state") == "valid"
    excerpt = F.when(good, F.sha2("__own", 256))
    key = F.concat_ws(":", "snapshot_id", "path", start.cast("string"), end.cast("string"), F.substring(excerpt, 1, 8))
    named = F.when(good, F.concat(F.lit("ev_"), F.substring(F.sha2(key, 256), 1, 14)))
    return told.select("request", "snapshot_id", "path", "start_line", "end_line", "state", F.when(good, F.col("__own")).alias("content"), "content_hash", excerpt.alias("excerpt_hash"), named.alias("evidence_id"))


def step_kind(kind: Column) -> Column:
    """PRJ-20: a taint step's kind by its usual name, null if it is none."""
    low = F.lower(F.trim(kind))
    plain = F.coalesce(*[F.when(low == a, b) for a, b in STEP_KINDS.items()], low)
    return F.when(plain.isin(*KNOWN_KINDS), plain)


def assess(assessments: DataFrame, evidence: DataFrame, snapshots: DataFrame) -> DataFrame:
    """FLT-09: finding_id, status and notes: a supported or refuted verdict is uncertain unless all that it cites is sound.

    assessments: finding_id, type, snapshot_id, verdict, evidence_ids, control,
    control_evidence_id, taint_path (array of kind, file, line, evidence_id);
    evidence: evidence_id, snapshot_id, path, start_line, end_line, state;
    snapshots: snapshot_id.
    """
    a = assessments.withColumn("__verdict", F.lower(F.trim(F.coalesce("verdict", F.lit("")))))
    a = a.withColumn("__verdict", F.when(F.col("__verdict").isin("supported", "refuted"), F.col("__verdict")).otherwise("uncertain"))
    sound = evidence.where("state = 'valid'").select(F.col("evidence_id").alias("e"), "snapshot_id", F.struct("path", "start_line", "end_line").alias("place"))
    cited = a.select("finding_id", "snapshot_id", F.explode(F.array_distinct("evidence_ids")).alias("e")).join(sound, ["snapshot_id", "e"], "left")
    held = cited.groupBy("finding_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull(), F.struct("e", "place")))).alias("__sound"), F.count_if(F.col("place").isNull()).alias("__unsound"))
    known = snapshots.select("snapshot_id").distinct().withColumn("__snapshot", F.lit(True))
    a = a.join(held, "finding_id", "left").join(known, "snapshot_id", "left").withColumn("__unsound", F.coalesce("__unsound", F.lit(0)))
    none = F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0
    control = F.trim(F.coalesce("control", F.lit("")))
    steps = F.coalesce("taint_path", F.expr("cast(array() as array<struct<kind: string, file: string, line: int, evidence_id: string>>)"))

    def fault(s: Column) -> Column:
        at = F.element_at(F.coalesce("__sound", F.expr("cast(map() as map<string, struct<path: string, start_line: int, end_line: int>>)")), F.trim(s["evidence_id"]))
        return (
            F.when(step_kind(s["kind"]).isNull(), "step of no known kind")
            .when(F.trim(F.coalesce(s["evidence_id"], F.lit(""))) == "", "step without evidence")
            .when(at.isNull(), "step on unsound evidence")
            .when((s["file"] != "") & (posix_path(s["file"]) != posix_path(at["path"])), "step in another file")
            .when((s["line"] < at["start_line"]) | (s["line"] > at["end_line"]), "step out of its evidence")
        )

    faults = F.array_compact(F.transform(steps, fault))
    kinds = F.transform(steps, lambda s: step_kind(s["kind"]))
    tainted = F.lit(False)
    for word in TAINT_WORDS:
        tainted = tainted | F.contains(F.lower(F.coalesce("type", F.lit(""))), F.lit(word))
    ends = F.array_contains(kinds, "source") & F.arrays_overlap(kinds, F.array(F.lit("sink"), F.lit("imported_sink")))
    refuted, supported = F.col("__verdict") == "refuted", F.col("__verdict") == "supported"
    tests = [
        (F.coalesce("snapshot_id", F.lit("")) == "", "no snapshot named"),
        ((F.coalesce("snapshot_id", F.lit("")) != "") & F.col("__snapshot").isNull(), "snapshot not found"),
        (refuted & (control == ""), "no mitigating control"),
        ((refuted | supported) & none, "no evidence cited"),
        ((refuted | supported) & ~none & (F.col("__unsound") > 0), "unsound evidence cited"),
        (refuted & ~none & (F.col("__unsound") == 0) & (F.coalesce("control_evidence_id", F.lit("")) != "") & ~F.array_contains("evidence_ids", F.col("control_evidence_id")), "control on other evidence"),
        (supported & tainted & (F.size(steps) == 0), "no taint path"),
        (supported & tainted & (F.size(steps) > 0) & (F.size(faults) == 0) & ~ends, "taint path without source and sink"),
    ]
    notes = F.concat(F.array_compact(F.array(*[F.when(test, F.lit(note)) for test, note in tests])), F.when(supported, faults).otherwise(F.array().cast("array<string>")))
    return a.withColumn("notes", notes).select("finding_id", F.when(F.size("notes") > 0, "uncertain").otherwise(F.col("__verdict")).alias("status"), "notes")


def enriched_taint(steps: DataFrame, lines: DataFrame, around: int = 2) -> DataFrame:
    """PRJ-21, PRJ-48: taint steps with their kind and the code around them.

    steps: seq, pos, kind, file, line, default_file; lines: path, line, text.  A
    kind that is missing follows from the place in the path: first source, last
    sink, else propagation; a blank file is the finding's.
    """
    ends = Window.partitionBy("seq")
    first, last = F.min("pos").over(ends), F.max("pos").over(ends)
    placed = F.when((F.col("pos") == last) & (first != last), "sink").when(F.col("pos") == first, "source").otherwise("propagation")
    told = steps.withColumn("kind", F.coalesce(step_kind(F.col("kind")), placed)).withColumn("file", F.coalesce(F.nullif(F.trim("file"), F.lit("")), "default_file")).drop("default_file")
    near = told.select("seq", "pos", F.col("file").alias("path"), F.col("line").alias("__at"), F.explode(F.sequence(F.col("line") - around, F.col("line") + around)).alias("line"))
    shown = F.concat(F.when(F.col("line") == F.col("__at"), "> ").otherwise("  "), F.col("line").cast("string"), F.lit(": "), F.col("text"))
    code = near.join(lines, ["path", "line"]).groupBy("seq", "pos").agg(F.array_sort(F.collect_list(F.struct("line", shown.alias("s")))).alias("w"))  # 2 * around + 1 lines
    return told.join(code.select("seq", "pos", F.array_join(F.transform("w", lambda x: x["s"]), "\n").alias("code")), ["seq", "pos"], "left")


@F.pandas_udf(StringType())
def unified_diff(original: pd.Series, replacement: pd.Series, label: pd.Series) -> pd.Series:
    """PRJ-41: the difference of two fragments with a line of context; null counts as empty."""

    def one(a: str | None, b: str | None, name: str) -> str:
        a, b = (x or "" for x in (a, b))
        return "".join(difflib.unified_diff(a.splitlines(keepends=True), b.splitlines(keepends=True), f"{name} (current)", f"{name} (proposed)", n=1))

    return pd.Series([one(a, b, n) for a, b, n in zip(original, replacement, label, strict=True)])


@F.pandas_udf(StringType())
def _parse_error(path: pd.Series, source: pd.Series) -> pd.Series:
    def one(name: str | None, text: str | None) -> str | None:
        if not (name or "").lower().endswith(".py"):
            return None
        try:
            ast.parse(text or "")
        except SyntaxError as broken:
            return f"line {broken.lineno}: {broken.msg}"
        except (ValueError, RecursionError) as broken:
            return str(broken)
        return None

    return pd.Series([one(p, s) for p, s in zip(path, source, strict=True)], dtype=object)


def parse_checked(plan: DataFrame, files: DataFrame) -> DataFrame:
    """DF-17: the patch plan with patches rejected that alone would break their Python file.

    plan: seq, file_path, start, end, replacement, rejected; files: path, content.
    """
    told = plan.join(files.select(F.col("path").alias("file_path"), F.col("content").alias("__text")), "file_path", "left")
    lines = lines_of(F.col("__text"))
    spliced = F.array_join(F.concat(F.slice(lines, F.lit(1), F.col("start") - 1), F.split("replacement", "\n"), F.slice(lines, F.col("end") + 1, F.greatest(F.size(lines) - F.col("end"), F.lit(0)))), "\n")
    broken = _parse_error(F.col("file_path"), F.when(F.col("rejected").isNull(), spliced))
    return told.withColumn("rejected", F.coalesce("rejected", F.concat(F.lit("breaks the file, "), broken))).drop("__text")


def first_slices(slices: DataFrame, most: int = 10) -> DataFrame:
    """RNK-08: of each file the distinct slices of its first sinks by line; slices: path, sink_line, line."""
    whole = slices.groupBy("path", "sink_line").agg(F.array_sort(F.collect_set("line")).alias("lines"))
    distinct = whole.groupBy("path", "lines").agg(F.min("sink_line").alias("sink_line"))
    return distinct.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("sink_line"))).where(F.col("place") <= most)


def definitions(rows: DataFrame, lines: DataFrame, name: str, path: str | None = None, most: int = 5, longest: int = 200) -> DataFrame:
    """RNK-11: path, kind, line, end_line, source of the functions and classes of a name, in each file at most `most`, each at most `longest` lines on.

    rows: syntax rows; lines: path, line, text.
    """
    found = rows.where(F.col("kind").isin("function", "class") & (F.col("target") == name))
    found = found if path is None else found.where(F.col("path") == path)
    found = found.select("path", "kind", "line", F.least("end_line", F.col("line") + longest).alias("end_line"))
    found = found.withColumn("__n", F.row_number().over(Window.partitionBy("path").orderBy("line"))).where(F.col("__n") <= most).drop("__n")
    text = lines.select("path", F.col("line").alias("__at"), "text")
    near = found.join(text, "path").where("__at between line and end_line")
    return near.groupBy("path", "kind", "line", "end_line").agg(F.array_sort(F.collect_list(F.struct("__at", "text"))).alias("s")).select("path", "kind", "line", "end_line", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("source"))
