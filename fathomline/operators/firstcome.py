"""Greedy choices in a fixed order, dealt out by lines (RNK-01, RNK-03, JON-02).

A greedy step depends on those before it, but only on those nearby.  A file's
rows are therefore dealt into blocks of lines; a block also holds, as guests, the
rows of its neighbours that its own may meet.  Each block walks its rows in
order, at first guests too.  From then on guests take what their own block has
found, and blocks walk again while a guest's answer changes.  The order is total
and each answer follows from earlier ones, so the answers that no longer change
are those of one walk over everything.  A file within one block is done at once;
in a longer one a round settles at least one more block of any chain, and gaps
without findings end chains.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.functions import fixed
from fathomline.functions.scalars import cwe_number
from fathomline.sources.shared import stored

#: Lines of a block; rows that a call of the walk takes together, about.
BLOCK, ROWS = 1 << 14, 20_000


def clean_path(path: Column) -> Column:
    """Forward slashes, no leading dots and slashes; case as it is."""
    return F.regexp_replace(F.trim(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))), r"^[./]+", "")


def file_keys(paths: DataFrame) -> DataFrame:
    """FLT-14: __path and file_key of the clean paths: paths of one key may be one file, those of two never are.

    The key is a path's shortest ending of two or more parts that is listed too
    (so /abs/app/a.py, app/a.py and APP/a.py share app/a.py), else itself in lower
    case.  A blank path stands for any file: it takes the key of the only file
    there is, or one of its own where there are more.
    """
    paths = stored(paths.select("__path").distinct())
    low = paths.select("__path", F.lower("__path").alias("low"))
    parts = F.split("low", "/")
    endings = low.where(F.contains("low", F.lit("/"))).select("__path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).alias("end"))
    listed = endings.join(low.select(F.col("low").alias("end")).distinct(), "end", "left_semi")
    shortest = listed.groupBy("__path").agg(F.min_by("end", F.length("end")).alias("end"))
    keyed = low.join(shortest, "__path", "left").select("__path", F.coalesce("end", "low").alias("file_key"))
    named = keyed.where("file_key <> ''").agg(F.count_distinct("file_key"), F.min("file_key")).first()
    return stored(keyed.withColumn("file_key", F.when((F.col("file_key") == "") & F.lit(named[0] == 1), F.lit(named[1])).otherwise(F.col("file_key"))))


def placed(findings: DataFrame, starts_only: bool = False) -> DataFrame:
    """The findings with file_key, __path, __start, __end and __marks: what two of them must share one of to agree in kind (type, alias group, CWE number)."""
    rows = findings.withColumn("__path", clean_path(F.col("file_path")))
    rows = rows.join(file_keys(rows), "__path")
    kind = F.coalesce("type", F.lit(""))
    groups = [F.when(kind.isin(*g), F.lit(f"g{k}")) for k, g in enumerate(fixed.TYPE_ALIASES)]
    number = cwe_number(F.col("cwe_id"))
    marks = F.array_compact(F.array(F.concat(F.lit("t"), kind), *groups, F.when(number != "", F.concat(F.lit("c"), number))))
    start = F.coalesce("start_line", F.lit(0)).cast("long")
    end = start if starts_only else F.greatest(F.coalesce("end_line", "start_line", F.lit(0)).cast("long"), start)
    return rows.withColumns({"__start": start, "__end": end, "__marks": marks})


class Near:
    """Rows by mark and lines, to find those that agree with a row within the window."""

    def __init__(self, window: int):
        self.window, self.at = window, defaultdict(list)

    def add(self, row) -> None:
        for mark in row.marks:
            for b in range(row.start // (self.window + 1), row.end // (self.window + 1) + 1):
                self.at[mark, b].append(row)

    def of(self, row) -> Iterator[tuple[int, object]]:
        """(distance, row), perhaps more than once."""
        for mark in row.marks:
            for b in range((row.start - self.window) // (self.window + 1), (row.end + self.window) // (self.window + 1) + 1):
                for other in self.at.get((mark, b), ()):
                    gap = max(0, max(row.start, other.start) - min(row.end, other.end))
                    if gap <= self.window and _one_file(row.path, other.path):
                        yield gap, other


def _one_file(a: str, b: str) -> bool:
    if not a or not b or a.lower() == b.lower():
        return True
    return ("/" in b and a.endswith(f"/{b}")) or ("/" in a and b.endswith(f"/{a}"))


def settled(rows: DataFrame, walk, orders: list[str], answer: str, window: int, block_lines: int) -> DataFrame:
    """seq, answer of each row (file_key, path, start, end, marks, orders, seq) by `walk`.

    walk gets a block's rows by `orders` and yields (seq, answer) of those that
    are its own; guests whose answer is known have it as `told`.
    """
    span = rows.agg(F.max(F.col("end") - F.col("start"))).first()[0] or 0
    reach = 2 * (window + span)
    lines = max(block_lines, 4 * reach)
    at = F.floor(F.col("start") / lines)
    around = F.sequence(F.floor((F.col("start") - reach) / lines), F.floor((F.col("end") + reach) / lines))
    dealt = stored(rows.withColumn("home", at).withColumn("block", F.explode(around)).withColumn("own", F.col("home") == F.col("block")).drop("home"))
    seq = dict(rows.dtypes)["seq"]
    schema = f"seq {seq}, answer {answer}"
    # most files have few findings: a call takes many blocks, each by itself
    calls = max(dealt.sparkSession.sparkContext.defaultParallelism, dealt.count() // ROWS)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        in_order = group.sort_values(["file_key", "block", *orders], kind="stable").itertuples(index=False)
        out = [x for _, block in groupby(in_order, key=lambda r: (r.file_key, r.block)) for x in walk(list(block))]
        return pd.DataFrame({"seq": pd.Series([x[0] for x in out], dtype=group["seq"].dtype), "answer": pd.Series([x[1] for x in out], dtype=object)})

    def walked(some: DataFrame) -> DataFrame:
        g = F.pmod(F.xxhash64("file_key", "block"), F.lit(calls))
        return stored(some.withColumn("g", g).repartition(calls, "g").groupBy("g").applyInPandas(run, schema))

    blocks = ["file_key", "block"]
    met = stored(dealt.where("not own").select(*blocks).distinct().join(dealt.where("own").select(*blocks).distinct(), blocks, "left_semi"))
    alone = dealt.join(met, blocks, "left_anti").where("own").withColumn("told", F.lit(None).cast(answer)).withColumn("known", F.lit(False))
    done = walked(alone)
    active, state = met, None
    while not active.isEmpty():
        group = dealt.join(active, blocks, "left_semi")
        if state is None:
            group = group.withColumn("told", F.lit(None).cast(answer)).withColumn("known", F.lit(False))
        else:
            group = group.join(state.select("seq", F.col("answer").alias("told")), "seq", "left").withColumn("known", ~F.col("own"))
        fresh = walked(group)
        if state is None:
            changed, state = fresh, fresh
        else:
            both = fresh.withColumnRenamed("answer", "new").join(state.withColumnRenamed("answer", "old"), "seq")
            changed = stored(both.where("not (new <=> old)").select("seq"))
            state = stored(state.join(fresh.withColumnRenamed("answer", "new").withColumn("again", F.lit(True)), "seq", "left").select("seq", F.when(F.col("again"), F.col("new")).otherwise(F.col("answer")).alias("answer")))
        active = stored(dealt.where("not own").join(changed.select("seq"), "seq", "left_semi").select(*blocks).distinct().join(met, blocks, "left_semi"))
    return done if state is None else done.unionByName(state)


def first_come(findings: DataFrame, orders: list[Column], window: int, block_lines: int = BLOCK) -> DataFrame:
    """seq, kept: whether a placed finding stays, all being taken by `orders`, then seq: it goes if one that stayed agrees with it within the window.

    Of findings alike in path, kind and lines only the first can stay, so each
    such group is one row before anything is dealt out, however large.
    """
    names = [f"o{k}" for k in range(len(orders))]
    ranked = findings.select("file_key", F.col("__path").alias("path"), F.col("__start").alias("start"), F.col("__end").alias("end"), F.col("__marks").alias("marks"), *[o.alias(n) for o, n in zip(orders, names, strict=True)], "seq")
    alike = ["file_key", "path", "start", "end", "marks"]
    first = ranked.groupBy(*alike).agg(F.min(F.struct(*names, "seq")).alias("b")).select(*alike, "b.*")

    def walk(block: list) -> Iterator[tuple]:
        near = Near(window)
        for row in block:
            stays = bool(row.told) if row.known else next(near.of(row), None) is None
            if stays:
                near.add(row)
            if row.own:
                yield row.seq, stays

    return settled(first, walk, [*names, "seq"], "boolean", window, block_lines).select("seq", F.col("answer").alias("kept"))


def claims(rules: DataFrame, models: DataFrame, rule_orders: list[Column], model_orders: list[Column], window: int, block_lines: int = BLOCK) -> DataFrame:
    """seq, merged_seq: for each placed rule finding, in order, the nearest model finding that agrees and that none before it has taken (ties: the earlier in the models' order), or null."""
    names = [f"o{k}" for k in range(max(len(rule_orders), len(model_orders)))]

    def side(rows: DataFrame, orders: list[Column], tier: int) -> DataFrame:
        given = [*orders, *[F.lit(0)] * (len(names) - len(orders))]
        return rows.select("file_key", F.col("__path").alias("path"), F.col("__start").alias("start"), F.col("__end").alias("end"), F.col("__marks").alias("marks"), *[o.alias(n) for o, n in zip(given, names, strict=True)], F.col("seq").alias("of"), F.lit(tier).alias("tier"))

    key = rules.select("seq").schema[0].dataType.simpleString()
    both = side(rules, rule_orders, 0).unionByName(side(models, model_orders, 1)).withColumn("seq", F.concat_ws(":", F.col("tier").cast("string"), F.col("of").cast("string")))

    def walk(block: list) -> Iterator[tuple]:
        near, place, taken = Near(window), {}, set()
        for row in block:
            if row.tier == 1:
                near.add(row)
                place[row.seq] = len(place)
        for row in block:
            if row.tier == 1:
                continue
            if row.known:
                met = row.told if isinstance(row.told, str) else None
            else:
                met = min(((gap, place[m.seq], m.seq) for gap, m in near.of(row) if m.seq not in taken), default=(0, 0, None))[2]
            if met is not None:
                taken.add(met)
            if row.own:
                yield row.seq, met

    out = settled(both, walk, [*names, "of"], "string", window, block_lines)
    return out.select(*[F.substring(c, 3, 1 << 30).cast(key).alias(n) for c, n in (("seq", "seq"), ("answer", "merged_seq"))])
