"""Attack chains among findings: JON-12, JON-15, AGG-14 without labels, AGG-15..19, JON-11 without its order, JON-10 without connected files, JON-13 by words alone."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.scalars import severity_rank
from fathomline.sources.shared import stored

# Types that share a security context, words by data category, and prerequisites by type.
CONTEXTS = (
    ("BROKEN_AUTHENTICATION", "HARDCODED_CREDENTIALS", "SENSITIVE_DATA_EXPOSURE"),
    ("SQL_INJECTION", "OS_COMMAND_INJECTION", "CODE_INJECTION"),
    ("BROKEN_ACCESS_CONTROL", "INSECURE_DIRECT_OBJECT_REFERENCE", "CSRF"),
    ("SENSITIVE_DATA_EXPOSURE", "INFORMATION_EXPOSURE_THROUGH_QUERY_STRING", "EXPOSED_SENSITIVE_INFORMATION"),
)
DATA_WORDS = {
    "user_input": ("input", "request", "param", "query", "form"),
    "file_operations": ("file", "path", "directory", "read", "write"),
    "database": ("sql", "query", "db", "database"),
    "authentication": ("auth", "login", "password", "credential"),
    "session": ("session", "token", "cookie"),
}
TYPE_PREREQUISITES = {
    "SQL_INJECTION": ("Database access", "Input injection point"),
    "CROSS_SITE_SCRIPTING": ("Active user session", "Input reflection point"),
    "CSRF": ("Active user session", "Predictable form structure"),
    "PATH_TRAVERSAL": ("File system access", "Directory traversal point"),
    "OS_COMMAND_INJECTION": ("Command execution context", "Input injection point"),
    "INSECURE_DESERIALIZATION": ("Serialized data input", "Custom class definitions"),
}


def _any(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def _when_all(pairs) -> Column:
    return F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in pairs]))


def data_categories(description: Column, impact: Column) -> Column:
    """JON-13 without taint paths: the categories whose words occur in the prose."""
    text = F.lower(F.concat_ws(" ", description, impact))
    return _when_all([(_any(text, words), name) for name, words in DATA_WORDS.items()])


def prerequisites(kind: Column, description: Column, impact: Column, cvss: Column) -> Column:
    """AGG-16: a finding's prerequisites, distinct and sorted."""
    d, i = F.lower(F.coalesce(description, F.lit(""))), F.lower(F.coalesce(impact, F.lit("")))
    by_type = [(kind == t, p) for t, ps in TYPE_PREREQUISITES.items() for p in ps]
    access = _any(d, ("local access", "physical access", "network access", "admin access"))
    config = _any(d, ("configuration", "settings", "environment"))
    score = F.coalesce(cvss, F.lit(0.0))
    rules = [
        *by_type,
        (_any(d, ("authentication", "login", "credentials", "session")), "Valid authentication credentials"),
        (access & F.contains(d, F.lit("local")), "Local system access"),
        (access & F.contains(d, F.lit("physical")), "Physical device access"),
        (access & F.contains(d, F.lit("network")), "Network connectivity"),
        (access & F.contains(d, F.lit("admin")), "Administrative privileges"),
        (_any(d, ("user interaction", "user input", "user-supplied")), "User interaction"),
        (config & F.contains(d, F.lit("debug")), "Debug mode enabled"),
        (config & F.contains(d, F.lit("environment")), "Specific environment configuration"),
        (score >= 7.0, "No special access required (High severity)"),
        ((score > 0) & (score < 7.0) & F.contains(d, F.lit("network")), "Network access"),
        (F.contains(i, F.lit("bypass")), "Knowledge of security mechanism"),
        (F.contains(i, F.lit("memory")), "Memory manipulation capability"),
        (F.contains(d, F.lit("race condition")), "Ability to perform concurrent requests"),
    ]
    return F.array_sort(F.array_distinct(_when_all(rules)))


def related_pairs(findings: DataFrame, threshold: float = 2.0, same_file: bool = True) -> DataFrame:
    """JON-10 without connected files and taint paths: pairs (a < b by seq) of one scope whose relationship score reaches the threshold.

    findings: scope, seq, file_path, type, start_line, description, impact, cvss_score.
    """
    f = findings.withColumn("prereqs", prerequisites(F.col("type"), F.col("description"), F.col("impact"), F.col("cvss_score"))).withColumn("cats", data_categories(F.col("description"), F.col("impact")))
    cols = ["seq", "file_path", "type", "start_line", "prereqs", "cats"]
    a = f.select("scope", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = f.select("scope", *[F.col(c).alias(f"b_{c}") for c in cols])
    p = a.join(b, "scope").where("a_seq < b_seq")
    one_file = F.col("a_file_path") == F.col("b_file_path")
    score = _score(one_file, one_file & (F.abs(F.col("a_start_line") - F.col("b_start_line")) <= fixed.CHAIN_LINES))
    return p.withColumn("score", score).where(F.col("score") >= threshold).select("scope", F.col("a_seq").alias("a"), F.col("b_seq").alias("b"), "score")


def _score(one_file: Column, near: Column) -> Column:
    """The relationship score of two findings a and b by type, prereqs and cats."""
    chain = [(F.col(f"{x}_type") == t) & F.col(f"{y}_type").isin(*to) for t, to in fixed.ATTACK_CHAINS.items() for x, y in (("a", "b"), ("b", "a"))]
    context = [F.col("a_type").isin(*g) & F.col("b_type").isin(*g) for g in CONTEXTS]
    either = lambda tests: reduce(lambda x, y: x | y, tests)
    points = [
        (either(chain), 2.0),
        (one_file, 0.5),
        (F.arrays_overlap("a_prereqs", "b_prereqs"), 1.0),
        (near, 0.5),
        (F.arrays_overlap("a_cats", "b_cats"), 1.5),
        (either(context), 1.0),
    ]
    return reduce(lambda x, y: x + y, [F.when(test, F.lit(v)).otherwise(F.lit(0.0)) for test, v in points])


def related_counts(findings: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(scope, score, pairs): how many of related_pairs' pairs each scope has of each score, without making them.

    A score depends on both findings' kinds (type and prose), on whether they are
    in one file, and on whether they are near there; so counts by kind are
    multiplied, and only near pairs join by lines.
    """
    t, d, i, c = (F.col(x) for x in ("type", "description", "impact", "cvss_score"))
    # a kind is what the score asks about it, found once a finding and not once a pair; read many times, so stored
    kind = F.struct("type", prerequisites(t, d, i, c).alias("prereqs"), F.array_sort(data_categories(d, i)).alias("cats")).alias("kind")
    lines = stored(findings.select("scope", "file_path", kind, "start_line").groupBy("scope", "file_path", "kind", "start_line").agg(F.count(F.lit(1)).alias("n")))
    by_file = lines.groupBy("scope", "file_path", "kind").agg(F.sum("n").alias("n"))
    by_scope = by_file.groupBy("scope", "kind").agg(F.sum("n").alias("n"))

    def pairs(a: DataFrame, b: DataFrame, keys: list[str], first: Column, meet: Column | None = None) -> DataFrame:
        """Pairs by kinds; first: whether the left row of two distinct ones comes first."""
        a, b = (x.select(*keys, *[F.col(c).alias(f"{s}_{c}") for c in x.columns if c not in keys]) for s, x in (("a", a), ("b", b)))
        same = F.col("a_kind") == F.col("b_kind")
        alone = same & (F.col("a_start_line").eqNullSafe(F.col("b_start_line")) if "a_start_line" in a.columns else F.lit(True))
        n = F.when(alone, F.expr("a_n * (a_n - 1) div 2")).otherwise(F.col("a_n") * F.col("b_n"))
        joined = a.join(b, keys).where((F.col("a_kind") < F.col("b_kind")) | alone | (same & first))
        return (joined if meet is None else joined.where(meet)).groupBy("scope", "a_kind", "b_kind").agg(F.sum(n).alias("n"))

    block = F.floor(F.col("start_line") / fixed.CHAIN_LINES)  # near lines are in one block or in neighbours
    around = lines.withColumn("block", F.explode(F.array(block - 1, block, block + 1)))
    apart = F.abs(F.col("a_start_line") - F.col("b_start_line")) <= fixed.CHAIN_LINES
    everywhere = pairs(by_scope, by_scope, ["scope"], F.lit(False))
    filed = pairs(by_file, by_file, ["scope", "file_path"], F.lit(False))
    near = pairs(lines.withColumn("block", block), around, ["scope", "file_path", "block"], F.col("a_start_line") < F.col("b_start_line"), apart)
    signed = [(everywhere, False, False, 1), (filed, False, False, -1), (filed, True, False, 1), (near, True, False, -1), (near, True, True, 1)]
    parts = [d.select("scope", "a_kind", "b_kind", F.lit(o).alias("one_file"), F.lit(c).alias("near"), (F.col("n") * s).alias("n")) for d, o, c, s in signed]
    told = reduce(DataFrame.unionByName, parts).groupBy("scope", "a_kind", "b_kind", "one_file", "near").agg(F.sum("n").alias("n")).where("n > 0")
    for s in ("a", "b"):
        told = told.withColumns({f"{s}_{x}": F.col(f"{s}_kind.{x}") for x in ("type", "prereqs", "cats")})
    scored = told.withColumn("score", _score(F.col("one_file"), F.col("near"))).where(F.col("score") >= threshold)
    return scored.groupBy("scope", "score").agg(F.sum("n").alias("pairs"))


def chains(findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """AGG-18: (scope, chain, seq): each finding not yet seen, in order, takes all that relate to it; chains of two and more stay.

    Not connected components: what relates to a member, but not to the seed, starts anew.
    """
    both = pairs.select("scope", "a", "b").unionByName(pairs.select("scope", F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("scope", "a").agg(F.array_sort(F.collect_list("b")).alias("near")).withColumnRenamed("a", "seq")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        seen, rows = set(), []
        for seq, others in sorted(zip(group["seq"], group["near"], strict=True), key=lambda x: x[0]):
            if seq not in seen:
                members = [seq, *others]
                rows += [(group["scope"].iloc[0], seq, m) for m in members]
                seen.update(members)
        return pd.DataFrame(rows, columns=["scope", "chain", "seq"])

    return near.groupBy("scope").applyInPandas(run, f"scope {dict(findings.dtypes)['scope']}, chain {dict(findings.dtypes)['seq']}, seq {dict(findings.dtypes)['seq']}")


def chain_facts(members: DataFrame) -> DataFrame:
    """AGG-14, AGG-17: per chain its size, weighted severity value and priority (the least severe member's, as observed).

    members: scope, chain, severity.
    """
    weights = {"CRITICAL": 5.0, "HIGH": 4.0, "MEDIUM": 3.0, "LOW": 2.0, "INFO": 1.0}
    weight = F.coalesce(*[F.when(F.col("severity") == s, F.lit(w)) for s, w in weights.items()], F.lit(1.0))
    n = F.count(F.lit(1))
    return members.groupBy("scope", "chain").agg(n.alias("size"), (F.max(weight) * (1 + 0.2 * (n - 1))).alias("value"), (F.max(severity_rank(F.col("severity"))) + 1).alias("priority"))


#: Characters of names beyond which texts are not cut by them.
ALPHABET = 4096


def connected_files(files: DataFrame) -> DataFrame:
    """JON-12 by references: pairs (path, other) of which the text of `path` holds the name of `other` without folder and suffix.

    Files of one folder are connected too; that is an equal folder, so no pairs
    are made for it.  Texts are cut into runs of the characters that names have;
    only distinct runs are cut into pieces of the lengths that names have, and
    pieces meet names by a join, so rows grow with the different runs and with the
    pairs that are found, not with the texts' lengths times those of the names.
    files: path, content.  A name with other characters than letters, digits and
    `_.-` is not looked up.
    """
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"(?<=.)\.[^.]*$", "")
    named = files.select(F.col("path").alias("other"), stem.alias("name")).where(~F.rlike("name", F.lit(r"[^\p{L}\p{N}_.-]")) & (F.col("name") != ""))
    lengths = named.select(F.length("name").alias("n")).distinct()
    letters = named.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name")), lambda k: F.substr("name", k, F.lit(1))))).alias("c")).distinct().limit(ALPHABET + 1).collect()
    inside = "".join(f"\\x{{{ord(r['c']):x}}}" for r in letters) if 0 < len(letters) <= ALPHABET else r"\p{L}\p{N}_.-"
    words = files.select("path", F.explode(F.array_distinct(F.split("content", f"[^{inside}]+"))).alias("word")).where("word <> ''")
    # at most a few hundred lengths, as paths have a bounded length
    runs = words.select("word").distinct().withColumn("size", F.length("word"))
    pieces = runs.join(F.broadcast(lengths), F.col("n") <= F.col("size")).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    told = pieces.select("word", F.substr("word", F.col("at"), F.col("n")).alias("name")).distinct().join(named, "name").select("word", "other")
    return words.join(told, "word").where("path <> other").select("path", "other").distinct()


def likelihood(members: DataFrame, related: DataFrame) -> DataFrame:
    """AGG-15: per chain the likelihood of an attack, in [0, 1] with four places.

    members: scope, chain, severity, type, description, impact, cvss_score,
    references; related: scope, chain, pairs (how many pairs of members relate).
    """
    low = F.lower(F.coalesce("description", F.lit("")))
    factor = reduce(
        lambda a, b: a * b,
        [F.when(F.array_contains(F.coalesce("references", F.array().cast("array<string>")), w) if w == "CVE" else F.contains(low, F.lit(w)), F.lit(x)).otherwise(F.lit(1.0)) for w, x in fixed.LIKELIHOOD_FACTORS.items()],
    )
    weight = F.coalesce(*[F.when(F.col("severity") == s, F.lit(w)) for s, w in fixed.LIKELIHOOD_WEIGHTS.items()])
    told = members.withColumn("w", weight).withColumn("f", factor).withColumn("p", prerequisites(F.col("type"), F.col("description"), F.col("impact"), F.col("cvss_score")))
    n = F.count(F.lit(1))
    facts = told.groupBy("scope", "chain").agg(n.alias("size"), F.avg("w").alias("base"), F.exp(F.sum(F.ln("f"))).alias("factor"))
    needs = told.select("scope", "chain", F.explode("p").alias("need")).groupBy("scope", "chain").agg(F.count_distinct("need").alias("needs"))
    all_ = facts.join(needs, ["scope", "chain"], "left").join(related, ["scope", "chain"], "left").fillna(0, ["needs", "pairs"])
    shape = F.lit(1.0) - (F.col("size") - 1) * 0.1 + F.col("pairs") * 0.05
    value = F.col("base") * F.greatest(F.lit(0.1), shape) * F.greatest(F.lit(0.1), F.lit(1.0) - F.col("needs") * 0.1) * F.col("factor")
    return all_.select("scope", "chain", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), value)), 4).alias("likelihood"))


def attack_paths(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """AGG-19: per chain its steps in words, the worst first, and whether each leads to the next.

    members: scope, chain, seq, type, severity, file_path, start_line, end_line,
    description, impact; pairs: scope, a, b of related findings.
    """
    order = Window.partitionBy("scope", "chain").orderBy(severity_rank(F.col("severity")), "seq")
    both = pairs.select("scope", F.col("a").alias("seq"), F.col("b").alias("next")).unionByName(pairs.select("scope", F.col("b").alias("seq"), F.col("a").alias("next"))).distinct().withColumn("met", F.lit(True))
    placed = members.withColumn("n", F.row_number().over(order)).withColumn("next", F.lead("seq").over(order)).join(both, ["scope", "seq", "next"], "left")
    where = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.when(F.col("end_line") != F.col("start_line"), F.concat(F.lit("-"), F.col("end_line").cast("string"))).otherwise(""))
    first = lambda c: F.substring_index(F.coalesce(c, F.lit("")), ".", 1)
    link = F.when(F.col("next").isNull(), "").when(F.col("met"), "\n   leads to the next").otherwise("\n   stands beside the next")
    step = F.concat(F.lit("Step "), F.col("n").cast("string"), F.lit(": "), "type", F.lit(" ("), "severity", F.lit(") at "), where, F.lit("\n   by: "), first("description"), F.lit("\n   so: "), first("impact"), link)
    # a chain has a seed and what relates to it
    return placed.groupBy("scope", "chain").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", step.alias("t")))), lambda s: s["t"]), "\n").alias("path"))
