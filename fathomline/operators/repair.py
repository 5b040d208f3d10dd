"""Taint paths and patch plans (PRJ-20, JON-14 without sinks, JON-23, PRJ-39..40, SNK-11..12, RNK-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import fixed

def taint_points(steps: DataFrame) -> DataFrame:
    """Places of taint steps (seq, file, line, kind), each widened by a line to either side; files by their base name."""
    base = F.lower(F.substring_index("file", "/", -1))
    return steps.where("line > 0").select("seq", base.alias("file"), F.explode(F.sequence(F.col("line") - fixed.TAINT_LINES, F.col("line") + fixed.TAINT_LINES)).alias("line")).distinct()


def taint_pairs(steps: DataFrame) -> DataFrame:
    """JON-14 without a sink on the other path: pairs (a < b) of findings whose paths touch.  The join is on the place, so only touching paths meet."""
    p = taint_points(steps)
    q = p.select(F.col("seq").alias("b"), "file", "line")
    return p.withColumnRenamed("seq", "a").join(q, ["file", "line"]).where("a < b").select("a", "b").distinct()


def risk_reasons(original: Column, replacement: Column) -> Column:
    """PRJ-39: why a replacement deserves a second look, as sentences in their order; null texts count as empty."""
    original, replacement = F.coalesce(original, F.lit("")), F.coalesce(replacement, F.lit(""))
    full = lambda c: F.filter(F.split(c, "\n"), lambda x: F.trim(F.replace(x, F.lit("\t"), F.lit(" "))) != "")
    # flow is counted line by line, so a pattern's white space cannot run over a line's end
    flow = lambda c: F.size(F.filter(full(c), lambda x: F.rlike(x, F.lit(fixed.PATCH_CONTROL))))
    some = lambda c, pattern: F.exists(F.split(c, "\n"), lambda x: F.rlike(x, F.lit(pattern)))
    imports = F.transform(F.filter(full(replacement), lambda x: F.rlike(x, F.lit(fixed.PATCH_IMPORT)) & ~F.contains(original, F.trim(x))), F.trim)
    placeholder, expands, brings, control, returns, constant, no_op = fixed.PATCH_REASONS
    before, after = F.size(full(original)), F.size(full(replacement))
    tests = [
        (F.rlike(replacement, F.lit(fixed.PATCH_PLACEHOLDER)), F.lit(placeholder)),
        (after > before + 1, F.format_string(expands.replace("{}", "%d"), before, after)),
        (F.size(imports) > 0, F.format_string(brings.replace("{}", "%s"), F.array_join(F.slice(imports, 1, 2), ", "))),
        (flow(replacement) > flow(original), F.lit(control)),
        (F.contains(replacement, F.lit("return")) & ~F.contains(original, F.lit("return")), F.lit(returns)),
        (some(replacement, fixed.PATCH_CONSTANT) & ~some(original, fixed.PATCH_CONSTANT), F.lit(constant)),
        (some(replacement, fixed.PATCH_NO_OP) & ~some(original, fixed.PATCH_NO_OP), F.lit(no_op)),
    ]
    return F.array_compact(F.array(*[F.when(test, said) for test, said in tests]))


def patch_plan(findings: DataFrame, files: DataFrame, require_baseline: bool = False) -> DataFrame:
    """JON-23: findings (seq, file_path, start_line, end_line, secure_code_example, file_hash) with original, replacement and rejected (null if accepted).

    A file's suggestions are taken from the bottom up; one that overlaps an
    accepted one is rejected, as is one that is missing, stale or no change.
    """
    f = findings.join(files.select(F.col("path").alias("file_path"), "content", F.sha2("content", 256).alias("now")), "file_path", "left")
    lines = F.split("content", "\n")
    f = f.withColumn("start", F.greatest(F.coalesce("start_line", F.lit(1)), F.lit(1))).withColumn("n", F.size(lines))
    f = f.withColumn("end", F.least(F.greatest(F.coalesce("end_line", "start"), F.col("start")), F.col("n")))
    f = f.withColumn("original", F.when(F.col("start") <= F.col("n"), F.array_join(F.slice(lines, F.col("start"), F.greatest(F.col("end") - F.col("start") + 1, F.lit(0))), "\n")))
    code = F.regexp_replace(F.coalesce("secure_code_example", F.lit("")), r"(?m)^\s*```[A-Za-z]*\s*$\n?", "")
    indent, own = F.regexp_extract("original", r"^(\s*)", 1), F.regexp_extract(code, r"^(\s*)", 1)
    moved = F.transform(F.split(F.regexp_replace(code, r"\s+\z", ""), "\n"), lambda x: F.when(F.trim(x) == "", F.lit("")).otherwise(F.concat(indent, F.when(F.startswith(x, own), F.substring(x, F.length(own) + 1, F.length(x))).otherwise(F.ltrim(x)))))
    f = f.withColumn("replacement", F.array_join(moved, "\n"))
    wrong = (
        F.when(F.trim(code) == "", "no suggestion")
        .when(F.col("now").isNull(), "file not found")
        .when(F.col("file_hash") != F.col("now"), "stale")
        .when(F.col("file_hash").isNull() & F.lit(require_baseline), "no baseline")
        .when(F.col("start") > F.col("n"), "past end of file")
        .when(F.trim("replacement") == F.trim("original"), "identical")
    )
    f = f.withColumn("wrong", wrong)
    # the greedy walk over a file's sound suggestions, as a fold: each is accepted if it ends above all accepted ones
    spans = F.sort_array(F.collect_list(F.struct("start", (-F.col("seq")).alias("back"), "end", "seq")), asc=False)
    sound = f.where("wrong is null").groupBy("file_path").agg(spans.alias("s"))
    key = dict(f.dtypes)["seq"]
    fold = f"aggregate(s, named_struct('low', 2147483647, 'ok', cast(array() as array<{key}>)), (a, x) -> if(x.end < a.low, named_struct('low', x.start, 'ok', array_append(a.ok, x.seq)), a), a -> a.ok)"
    f = f.join(sound.select("file_path", F.expr(fold).alias("accepted")), "file_path", "left")
    overlaps = F.when(~F.array_contains("accepted", F.col("seq")), "overlaps")
    return f.select("seq", "file_path", "start", "end", "original", "replacement", F.coalesce("wrong", overlaps).alias("rejected"))


def patched(files: DataFrame, plan: DataFrame) -> DataFrame:
    """SNK-11: path, content with all accepted patches; nothing is written in place."""
    good = plan.where("rejected is null").groupBy(F.col("file_path").alias("path")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "replacement"))).alias("p"))
    f = files.join(good, "path", "left")
    lines = "split(content, '\\n')"
    start = "named_struct('at', 1, 'out', cast(array() as array<string>))"
    step = f"(a, x) -> named_struct('at', x.end + 1, 'out', concat(a.out, slice({lines}, a.at, x.start - a.at), split(x.replacement, '\\n')))"
    rest = f"a -> array_join(concat(a.out, slice({lines}, a.at, greatest(size({lines}) - a.at + 1, 0))), '\\n')"
    return f.select("path", F.expr(f"if(p is null, content, aggregate(p, {start}, {step}, {rest}))").alias("content"))


def reverted(current: DataFrame, backups: DataFrame) -> DataFrame:
    """SNK-12: backups (path, content, written_hash) that may go back: the file is still as it was written."""
    return backups.join(current.select("path", F.sha2("content", 256).alias("written_hash")), ["path", "written_hash"], "left_semi")


def within_budget(entries: DataFrame, most: int = 150) -> DataFrame:
    """RNK-07: slice entries (slice, priority, distance, line, id) in that order while their distinct lines fit."""
    order = Window.partitionBy("slice").orderBy("priority", "distance", "line", "id")
    first = F.row_number().over(Window.partitionBy("slice", "line").orderBy("priority", "distance", "id")) == 1
    lines = F.sum(F.col("__first").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return entries.withColumn("__first", first).withColumn("__lines", lines).where(F.col("__lines") <= most).drop("__first", "__lines")
