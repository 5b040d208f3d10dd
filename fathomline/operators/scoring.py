"""Scoring of detections against labels (FLT-13, JON-06..07, AGG-07..08, AGG-29..30)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.scalars import cwe_marks, cwe_matches, cwe_number
from fathomline.sources.shared import stored

#: A line of distance outweighs any tie-break; pairs that a call of the matching takes together, about.
LINE_COST, ROWS = 100_000_000, 20_000


def _tie(*columns: str) -> Column:
    text = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10000


def candidate_pairs(detections: DataFrame, labels: DataFrame, by_line: bool = True, exact: bool = False, tolerance: int = fixed.LABEL_LINES) -> DataFrame:
    """Pairs (d, l, file, cost, low, high) of one file with matching CWEs, within `tolerance` lines if by_line; low and high are the lines it spans.

    detections: d, file, line, cwe, type, source; labels: l, file, line, cwe, type, note.
    """
    x = detections.select("d", "file", F.col("line").alias("d_line"), F.col("cwe").alias("d_cwe"), _tie("file", "line", "cwe", "type", "source").alias("d_tie"))
    y = labels.select("l", "file", F.col("line").alias("l_line"), F.col("cwe").alias("l_cwe"), _tie("file", "line", "cwe", "type", "note").alias("l_tie"))
    gap = F.abs(F.col("d_line") - F.col("l_line")) if by_line else F.lit(0)
    if by_line:  # near lines are in one block of lines or in neighbours, so a file is many small joins
        block = lambda c: F.floor(F.col(c) / (tolerance + 1))
        x = x.withColumn("block", block("d_line"))
        y = y.withColumn("block", F.explode(F.array(*[block("l_line") + k for k in (-1, 0, 1)])))
    pairs = x.join(y, ["file", "block"] if by_line else ["file"]).where(cwe_matches(F.col("d_cwe"), F.col("l_cwe"), exact)).withColumn("gap", gap)
    if by_line:
        pairs = pairs.where(F.col("gap") <= tolerance)
    return pairs.select("d", "l", "file", (F.col("gap").cast("long") * LINE_COST + F.col("d_tie") * 10000 + F.col("l_tie")).alias("cost"), *([F.least("d_line", "l_line").alias("low"), F.greatest("d_line", "l_line").alias("high")] if by_line else [F.lit(0).alias("low"), F.lit(0).alias("high")]))


def least_cost_matching(pairs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Most pairs (d, l) one to one, of least total cost: shortest augmenting paths with potentials."""
    edges: dict[int, list[tuple[int, int]]] = {}
    for d, label, cost in sorted(pairs):
        edges.setdefault(d, []).append((label, cost))
    of_label: dict[int, int] = {}
    label_of: dict[int, int] = {}
    height: dict[tuple[str, int], int] = {}
    cost_of = {(d, label): c for d, label, c in pairs}
    free = set(edges)
    while free:
        # Dijkstra over reduced costs from all free detections at once
        far = {("d", d): 0 for d in free}
        back: dict[int, int] = {}
        queue = [(0, "d", d) for d in sorted(free)]
        done: set[tuple[str, int]] = set()
        while queue:
            dist, side, at = heapq.heappop(queue)
            if (side, at) in done:
                continue
            done.add((side, at))
            if side == "d":
                steps = [("l", label, c) for label, c in edges[at] if of_label.get(label) != at]
            else:
                steps = [("d", of_label[at], -cost_of[of_label[at], at])] if at in of_label else []
            for to_side, to, c in steps:
                new = dist + c + height.get((side, at), 0) - height.get((to_side, to), 0)
                if new < far.get((to_side, to), float("inf")):
                    far[to_side, to] = new
                    if to_side == "l":
                        back[to] = at
                    heapq.heappush(queue, (new, to_side, to))
        ends = [(far["l", x] + height.get(("l", x), 0), x) for x in back if x not in of_label]
        if not ends:
            break
        for node, dist in far.items():
            height[node] = height.get(node, 0) + dist
        at = min(ends)[1]
        while True:
            d = back[at]
            was = label_of.get(d)
            of_label[at], label_of[d] = d, at
            if d in free:
                free.remove(d)
                break
            at = was
    return sorted((d, label) for label, d in of_label.items())


def match(pairs: DataFrame) -> DataFrame:
    """JON-06: the matched (d, l); the order of rows does not matter.

    Pairs lie within files, and pairs whose spans do not overlap share neither
    side, so each run of overlapping spans is solved alone.
    """
    order = Window.partitionBy("file").orderBy("low", "high", "d", "l")
    new = F.coalesce((F.col("low") > F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(1))
    pairs = pairs.withColumn("__new", new).withColumn("run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        runs: dict[tuple, list[tuple]] = {}
        for file, run, d, label, cost in zip(group["file"], group["run"], group["d"], group["l"], group["cost"], strict=True):
            runs.setdefault((file, run), []).append((d, label, cost))
        found = [x for pairs in runs.values() for x in (least_cost_matching(pairs) if len(pairs) > 1 else [pairs[0][:2]])]
        return pd.DataFrame(found, columns=["d", "l"])

    # most runs are a few pairs: a call takes many runs, each by itself
    pairs = stored(pairs.select("d", "l", "cost", "file", "run"))
    calls = max(pairs.sparkSession.sparkContext.defaultParallelism, pairs.count() // ROWS)
    dealt = pairs.withColumn("g", F.pmod(F.xxhash64("file", "run"), F.lit(calls))).repartition(calls, "g")
    return dealt.groupBy("g").applyInPandas(solved, f"d {dict(pairs.dtypes)['d']}, l {dict(pairs.dtypes)['l']}")


def outcomes(detections: DataFrame, labels: DataFrame, matched: DataFrame, clean_files: DataFrame, exact: bool = False, tolerance: int = fixed.LABEL_LINES) -> DataFrame:
    """JON-07: d, outcome: true_positive, or why it is a false positive (clean, duplicate, wrong_line, wrong_type).

    Whether a label of the kind is near is asked by blocks of lines, whether one
    is in the file at all by the CWEs and classes that the file's labels have, so
    a file's detections never meet all its labels.
    """
    near = candidate_pairs(detections, labels, exact=exact, tolerance=tolerance).select("d").distinct().withColumn("near", F.lit(True))
    marks = labels.select("file", F.explode(cwe_marks(F.col("cwe"), exact)).alias("mark")).distinct()
    alike = detections.select("d", "file", F.explode(cwe_marks(F.col("cwe"), exact)).alias("mark")).join(marks, ["file", "mark"], "left_semi").select("d").distinct().withColumn("alike", F.lit(True))
    out = detections.join(matched.select("d").withColumn("hit", F.lit(True)), "d", "left").join(near, "d", "left").join(alike, "d", "left").join(clean_files.select("file").distinct().withColumn("clean", F.lit(True)), "file", "left")
    why = F.when(F.col("hit"), "true_positive").when(F.col("clean"), "clean").when(F.col("near"), "duplicate").when(F.col("alike"), "wrong_line").otherwise("wrong_type")
    return out.select("d", "file", "cwe", why.alias("outcome"))


def ratios(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """AGG-08, AGG-29, AGG-30: precision, recall and f1, null where undefined."""
    precision = F.when(tp + fp > 0, tp / (tp + fp))
    recall = F.when(tp + fn > 0, tp / (tp + fn))
    return [precision.alias("precision"), recall.alias("recall"), F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).alias("f1")]


def per_cwe(labels: DataFrame, matched: DataFrame) -> DataFrame:
    """AGG-07: total, tp, fn and recall of each labelled CWE."""
    hit = labels.join(matched.select("l").withColumn("hit", F.lit(1)), "l", "left").withColumn("cwe", F.when(cwe_number(F.col("cwe")) == "", "Unknown").otherwise(cwe_number(F.col("cwe"))))
    tp, total = F.count("hit"), F.count(F.lit(1))
    return hit.groupBy("cwe").agg(total.alias("total"), tp.alias("tp"), (total - tp).alias("fn"), (tp / total).alias("recall"), F.count_distinct("type").alias("types"))
