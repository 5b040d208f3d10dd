"""The suffix array of a corpus by a distributed difference-cover sort, with a row for each suffix.

Suffixes at positions 1 and 2 modulo 3 are the sample: their triples of symbols
are sorted and named, and if a name repeats, the string of names is sorted in the
same way.  The remaining suffixes are merged in by (symbol, rank) against one
half of the sample and by (symbol, symbol, rank) against the other.  Equal
prefixes are then neighbours.  Every step is a sort, a grouping or a join of
Spark's; a sort's places become whole numbers through the counts of its partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathomline.llm.shared import stored
from fathomline.llm.text import column_bytes, mix, slices, window_hashes

#: Suffixes that one task sorts alone, where the recursion ends.
ALONE = 4096


def placed(rows: DataFrame, *order: Column | str, weight: Column | None = None) -> DataFrame:
    """`rows` with index (their places in the order, from 0) and before (the summed weights of the rows before)."""
    weight = F.lit(0) if weight is None else weight
    sorted_ = rows.withColumn("__w", weight.cast("long")).orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_ = stored(sorted_.withColumn("__part", F.shiftright("__at", 33)))
    counts = sorted_.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.sum("__w").alias("w")).collect()  # a row per partition
    offsets, n, w = [], 0, 0
    for r in sorted(counts, key=lambda r: r["__part"]):
        offsets.append((r["__part"], n, w))
        n, w = n + r["n"], w + r["w"]
    told = rows.sparkSession.createDataFrame(offsets, "__part long, __n long, __before long")
    inside = Window.partitionBy("__part").orderBy("__at")
    out = sorted_.withColumn("__sum", F.sum("__w").over(inside.rowsBetween(Window.unboundedPreceding, -1))).join(F.broadcast(told), "__part")
    low = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return out.withColumn("index", low + F.col("__n")).withColumn("before", F.coalesce("__sum", F.lit(0)) + F.col("__before")).drop("__w", "__at", "__part", "__sum", "__n", "__before")


def _alone(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("g")
    rank = np.unique(group["s"].to_numpy(), return_inverse=True)[1].astype(np.int64)
    n, k = len(rank), 1
    while k < n:
        second = np.full(n, -1, dtype=np.int64)
        second[: n - k] = rank[k:]
        order = np.lexsort((second, rank))
        new = np.concatenate(([0], np.cumsum((rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1]))))
        rank[order] = new
        if new[-1] == n - 1:
            break
        k *= 2
    return pd.DataFrame({"g": group["g"], "rank": rank})


def _spread(rows: DataFrame, value: str, names: list[tuple[str, int]]) -> DataFrame:
    """(g, name, v): the value of g told to g - shift under each name."""
    cells = F.array(*[F.struct((F.col("g") - shift).alias("g"), F.lit(name).alias("name"), F.col(value).cast("long").alias("v")) for name, shift in names])
    return rows.select(F.explode(cells).alias("c")).select("c.*").where("g >= 0")


def _gathered(cells: DataFrame, names: list[str]) -> DataFrame:
    return cells.groupBy("g").agg(*[F.max(F.when(F.col("name") == n, F.col("v"))).alias(n) for n in names])


def ranks(text: DataFrame, n: int, alone: int = ALONE) -> DataFrame:
    """(g, rank) of each suffix of a string of n symbols; text: g (0 to n - 1), s (1 or more).

    A suffix that ends first comes first.
    """
    if n <= max(alone, 3):
        return text.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(_alone, "g long, rank long")
    triples = _gathered(_spread(text, "s", [("t0", 0), ("t1", 1), ("t2", 2)]).where("g % 3 <> 0"), ["t0", "t1", "t2"]).fillna(0)
    ended = n % 3 == 1  # a triple of nothing keeps the two halves of the names apart
    if ended:
        triples = triples.unionByName(text.sparkSession.createDataFrame([(n, 0, 0, 0)], "g long, t0 long, t1 long, t2 long"))
    triples = stored(triples)
    key = ["t0", "t1", "t2"]
    names = placed(triples.select(*key).distinct(), *key).drop("before")
    names = stored(names)
    sample, distinct = triples.count(), names.count()
    named = stored(triples.join(names, key).select("g", "index"))
    if distinct == sample:
        known = named.select("g", F.col("index").alias("r"))
    else:
        half = (n - 1) // 3 + 1 if ended else (n + 1) // 3
        reduced = named.select(F.when(F.col("g") % 3 == 1, F.expr("(g - 1) div 3")).otherwise(F.expr("(g - 2) div 3") + half).alias("g"), (F.col("index") + 1).alias("s"))
        back = F.when(F.col("g") < half, F.col("g") * 3 + 1).otherwise((F.col("g") - half) * 3 + 2)
        known = ranks(reduced, sample, alone).select(back.alias("g"), F.col("rank").alias("r"))
    known = stored(known)
    cells = _spread(text, "s", [("s0", 0), ("s1", 1)]).unionByName(_spread(known, "r", [("r0", 0), ("r1", 1), ("r2", 2)]))
    all_ = stored(_gathered(cells, ["s0", "s1", "r0", "r1", "r2"]).where(F.col("g") < n).fillna(-1, ["r1", "r2"]).fillna(0, ["s1"]))
    kind = F.col("g") % 3
    first = placed(all_.where(kind != 2), "s0", "r1", weight=(kind == 1).cast("int")).where("g % 3 = 0").select("g", "s0", "r1", F.col("before").alias("b1"))
    second = placed(all_.where(kind != 1), "s0", "s1", "r2", weight=(kind == 2).cast("int")).where("g % 3 = 0").select("g", F.col("before").alias("b2"))
    rest = first.join(second, "g").select("g", (F.col("b1") + F.col("b2")).alias("p"), F.lit(0).alias("q"), "s0", "r1")
    sampled = all_.where(kind != 0).select("g", (F.col("r0") - int(ended)).alias("p"), F.lit(1).alias("q"), F.lit(0).cast("long").alias("s0"), F.lit(0).cast("long").alias("r1"))
    return placed(rest.unionByName(sampled), "p", "q", "s0", "r1").select("g", F.col("index").alias("rank"))


def _symbols(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            for base, number, text in zip(batch.column("before").to_pylist(), batch.column("index").to_pylist(), batch.column("text"), strict=True):
                data, _ = column_bytes(pa.array([text.as_py()], pa.large_binary()))
                n = len(data)
                keys = [np.zeros(n + 1, np.int64) for _ in range(2)]
                starts = np.arange(max(0, n - length + 1))
                for k in range(2):
                    keys[k][: len(starts)] = mix(window_hashes(data, starts, length, k)).view(np.int64)
                whole = np.arange(n + 1) < len(starts)
                columns = [base + np.arange(n + 1), np.append(data.astype(np.int64) + 2, 1), np.full(n + 1, number), np.arange(n + 1), whole, *keys]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["g", "s", "number", "start", "whole", "high", "low"])

    return run


def later_starts(docs: DataFrame, length: int, alone: int = ALONE) -> DataFrame:
    """doc_id, number, start: the strings of `length` bytes of `docs` that also start earlier, by neighbours in the suffix array.

    number: the document's place by (doc_id, text), null first; null texts are
    empty, and matches never cross documents.  Neighbours' prefixes are compared
    by 128-bit hashes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    numbered = stored(placed(rows, F.asc_nulls_first("doc_id"), "text", weight=F.octet_length("text") + 1))
    size = numbered.agg(F.sum(F.octet_length("text") + 1)).first()[0]
    if not size:
        return numbered.select("doc_id", F.col("index").alias("number"), F.lit(0).cast("long").alias("start")).where("false")
    symbols = stored(numbered.select("before", "index", "text").mapInArrow(_symbols(length), "g long, s long, number long, start long, whole boolean, high long, low long"))
    order = placed(ranks(symbols.select("g", "s"), int(size), alone).join(symbols.where("whole").drop("s"), "g"), "rank").drop("before")
    order = stored(order)
    last = order.select((F.col("index") + 1).alias("index"), F.col("high").alias("h"), F.col("low").alias("l"))
    new = order.join(last, "index", "left").withColumn("new", F.coalesce((F.col("h") != F.col("high")) | (F.col("l") != F.col("low")), F.lit(True)).cast("int"))
    # each run of equal prefixes keeps its first place in the corpus
    runs = stored(placed(new.withColumnRenamed("index", "at"), "at", weight=F.col("new")).withColumn("run", F.col("before") + F.col("new")))
    first = runs.groupBy("run").agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = runs.join(first, "run").where("g > first").select("number", "start")
    return later.join(numbered.select("doc_id", F.col("index").alias("number")), "number").select("doc_id", "number", "start")
