"""Dedup inside a tier and fusion of two tiers (RNK-01..02, JON-01..04).

Both are greedy, so their order matters; `firstcome` deals a file's findings out
by lines and settles the blocks' borders in rounds.  Every finding has a seq of
its own within its tier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.scalars import fingerprint, severity_rank
from fathomline.operators.firstcome import BLOCK, claims, first_come, placed
from fathomline.sources.shared import stored


def _orders() -> list[Column]:
    """The worst first, then the longest described."""
    return [severity_rank(F.col("severity")), -F.length(F.coalesce("description", F.lit("")))]


def deduplicate(findings: DataFrame, window: int = fixed.FUSION_LINES, block_lines: int = BLOCK) -> DataFrame:
    """RNK-01: of findings that agree within the window, the worst (then the longest described, then the first) stays.

    A finding is dropped only for one that was kept, so this is not a merge of
    whole chains of neighbours.  Columns stay as they are.  A null type is a type
    of its own, a null line counts as 0, an unknown severity comes last; a blank path is any file
    where there is only one, else a file of its own; no findings give none.
    """
    kept = first_come(placed(findings), _orders(), window, block_lines).where("kept").select("seq")
    return findings.join(kept, "seq", "left_semi").select(*findings.columns)


_TAKEN = {"cwe_id", "owasp_category", "references", "merged_rule_ids", "rule_id", "severity", "file_path", "start_line", "end_line", "context", "seq"}


def fuse(rules: DataFrame, model: DataFrame, window: int = fixed.FUSION_LINES, drop_unconfirmed: bool = False, block_lines: int = BLOCK) -> DataFrame:
    """JON-03: one row per defect with source, confidence, corroborated, merged_seq and, where findings have a context, fingerprint.

    Each tier is deduplicated; each rule finding, in order, takes the nearest
    unclaimed model finding that agrees.  A pair (JON-04) is the model's finding
    with the rule's seq, rule ids and place, unless the rule's place is an import
    and the model's is not; the worse severity of the two; the rule's CWE and
    OWASP entry where the model has none; and both their references, the
    model's first.  Its fingerprint is that of the place that it got.  Odd values are as in
    `deduplicate`.
    """
    own = list(rules.columns)
    # what the walks need, without the texts; files are told apart over both tiers, so that paths of either meet
    slim = lambda rows, tier: rows.select(F.lit(tier).alias("tier"), "seq", "file_path", "type", "cwe_id", "start_line", "end_line", *[o.alias(f"__o{k}") for k, o in enumerate(_orders())])
    both = stored(placed(stored(slim(rules, 0).unionByName(slim(model, 1)))))
    orders = [F.col("__o0"), F.col("__o1")]
    sides = []
    for tier in (0, 1):
        rows = both.where(F.col("tier") == tier)
        kept = first_come(rows, orders, window, block_lines).where("kept").select("seq")
        sides.append(stored(rows.join(kept, "seq", "left_semi")))
    met = stored(claims(sides[0], sides[1], orders, orders, window, block_lines))
    taken = met.where("merged_seq is not null").select(F.col("merged_seq").alias("seq"))
    r, m = rules.select(*own), model.select(*own)

    told = m.join(taken, "seq", "left_semi").select(F.struct(*own).alias("m"), F.col("seq").alias("merged_seq"))
    pairs = r.select(F.struct(*own).alias("r"), "seq").join(met, "seq").join(told, "merged_seq", "left").drop("seq")
    hit = F.col("m").isNotNull()
    about = lambda side: F.lower(F.coalesce(F.col(f"{side}.context"), F.lit("")))
    imports = lambda side: F.contains(about(side), F.lit("import ")) | F.contains(about(side), F.lit("from "))
    moved = hit & imports("r") & ~imports("m") if "context" in own else F.lit(False)
    place = lambda c: F.when(moved, F.col(f"m.{c}")).otherwise(F.col(f"r.{c}"))
    filled = lambda c: F.when(hit & (F.coalesce(F.col(f"m.{c}"), F.lit("")) != ""), F.col(f"m.{c}")).otherwise(F.col(f"r.{c}"))
    columns: dict[str, Column] = {c: F.when(hit, F.col(f"m.{c}")).otherwise(F.col(f"r.{c}")) for c in own if c not in _TAKEN}
    columns |= {c: place(c) for c in own if c in ("file_path", "start_line", "end_line", "context")}
    columns |= {c: filled(c) for c in own if c in ("cwe_id", "owasp_category")}
    columns |= {c: F.col(f"r.{c}") for c in own if c in ("seq", "rule_id", "merged_rule_ids")}
    columns["severity"] = F.when(hit & (severity_rank(F.col("m.severity")) < severity_rank(F.col("r.severity"))), F.col("m.severity")).otherwise(F.col("r.severity"))
    if "references" in own:
        none = F.array().cast(dict(rules.dtypes)["references"])
        mine, others = F.coalesce(F.col("m.references"), none), F.coalesce(F.col("r.references"), none)
        columns["references"] = F.when(hit, F.concat(mine, F.filter(others, lambda x: ~F.array_contains(mine, x)))).otherwise(F.col("r.references"))
    fused = pairs.select(*[columns[c].alias(c) for c in own], F.when(hit, "CONFIRMED").otherwise("SEMGREP").alias("source"), "merged_seq")
    if drop_unconfirmed:
        fused = fused.where("source = 'CONFIRMED'")
    rest = m.join(sides[1].select("seq").join(taken, "seq", "left_anti"), "seq", "left_semi").select(*own, F.lit("LLM").alias("source"), F.lit(None).cast(dict(rules.dtypes)["seq"]).alias("merged_seq"))
    out = fused.unionByName(rest)
    source = F.col("source")
    out = out.withColumn("confidence", F.coalesce(*(F.when(source == s, F.lit(c)) for s, c in fixed.CONFIDENCE.items()))).withColumn("corroborated", source == "CONFIRMED")
    return out.withColumn("fingerprint", fingerprint(F.col("file_path"), F.col("type"), F.col("context"), F.col("start_line"))) if "context" in own else out


def overlap_merged(findings: DataFrame) -> DataFrame:
    """RNK-02: findings of one file and type whose spans overlap become one, with all their rule ids.

    Islands with no gap allowed are exactly the chains of overlapping spans.
    """
    order = Window.partitionBy("file_path", "type").orderBy("start_line", "end_line", "seq")
    reach = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = findings.withColumn("__new", F.coalesce((F.col("start_line") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    first = F.min(F.struct("start_line", "end_line", "seq"))
    return marked.groupBy("file_path", "type", "__run").agg(first["start_line"].alias("start_line"), F.max("end_line").alias("end_line"), first["seq"].alias("seq"), F.array_sort(F.collect_set("rule_id")).alias("merged_rule_ids")).drop("__run")
