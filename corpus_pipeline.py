"""The corpus pipeline: quality rules, near duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.

In every stage a null or repeated doc_id is a document like others, rows that
repeat are documents of their own, columns that bear an operator's names come
out as they went in, and an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import decontamination, jaccard_join, packing, quality_rules, substring_dedup
from fathomline.llm.shared import checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line labelling rejects go; so do null and empty texts and those of under ten words.  A share of exactly one half stays."""
    return quality_rules.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the least doc_id, null last; among equal ids that of the least row key.  Texts without words all stay."""
    return jaccard_join.keep_one(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from every place; a document that has no word left goes too.  `text` and `n_chars` are those of what is left."""
    left = substring_dedup.remove_repeats(docs).where("kept <> ''")
    cut = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long"), "doc_id": F.col("doc_id")}
    return left.select(*[cut.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's phrase go; texts without words stay."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of training sequences; ties in cost go to the earlier sequence, in length to the earlier document."""
    return packing.pack_documents(docs, packing.default_tokenizer()).drop("ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("benchmark_leaks", benchmark_leaks), ("pack", pack)]

#: SQL can express neither the trained line labelling nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each read from what the one before wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}-{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
