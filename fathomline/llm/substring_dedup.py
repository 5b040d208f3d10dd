"""Substring dedup by difference-cover anchors (operator 3).

A passage of `window` words that occurs twice, in one document or in two, is
removed from every place.  Windows of `window - period + 1` words are hashed at
cover positions only; any repeated passage shares an aligned one, and where one
repeats the match is extended to full windows, which are compared by wide hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import repeats
from fathomline.llm.text import joined, word_hashes, word_spans


def _read(texts: list[bytes]):
    data, offsets = joined(texts)
    starts, ends, words = word_spans(data, offsets)
    return (word_hashes(data, starts, ends, 0), word_hashes(data, starts, ends, 1)), words, (data, starts, ends)


def remove_repeats(docs: DataFrame, window: int = 35, period: int = 21, block_mb: float = 4.0) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space), rest; one row per row of `docs`.

    Null or empty texts have no words; a null doc_id is a document like others;
    rows that repeat a doc_id are separate documents; texts shorter than
    `window` words lose nothing; other columns are in the struct `rest`.  An
    empty table gives an empty result.
    """
    _, size = repeats.volume(docs)
    blocks = max(1, int(size / (block_mb * (1 << 20))))
    plan = repeats.Plan(window, period, blocks, size, False, False, _read)
    others = [c for c in docs.columns if c.lower() not in ("doc_id", "text")]
    rest = F.struct(*[F.col(f"`{c}`") for c in others]) if others else F.struct(F.lit(None).cast("string").alias("none"))
    dealt = docs.select(rest.alias("rest"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"), *repeats.whole_ids(), F.col("text").cast("binary").alias("text"))

    def finish(d: pd.DataFrame, block, starts: np.ndarray, flags: np.ndarray, _) -> pd.DataFrame:
        if block is None:
            return pd.DataFrame({"known": [], "doc_id": [], "n_words": [], "n_removed": [], "kept": [], "rest": []})
        data, first, last = block.extra
        gone = repeats.covered(len(first), starts[flags], window)
        whole, rows, words = data.tobytes(), [], block.offsets
        for k, (known, doc_id, other) in enumerate(zip(d["known"], d["doc_id"], d["rest"], strict=True)):
            lo, hi = words[k], words[k + 1]
            stay = lo + np.flatnonzero(~gone[lo:hi])
            kept = b" ".join([whole[a:b] for a, b in zip(first[stay].tolist(), last[stay].tolist(), strict=True)])
            rows.append((known, doc_id, hi - lo, hi - lo - len(stay), kept.decode("utf-8", "replace"), other))
        return pd.DataFrame(rows, columns=["known", "doc_id", "n_words", "n_removed", "kept", "rest"])

    return repeats.with_nulls(repeats.find(dealt, plan, finish, f"known int, doc_id long, n_words long, n_removed long, kept string, rest {dealt.schema['rest'].dataType.simpleString()}"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
windows AS (SELECT r, i, list_slice(w, i + 1, i + 35) AS run FROM (SELECT r, w, unnest(generate_series(0, len(w) - 35)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT run FROM windows GROUP BY run HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 34)) AS p FROM windows WHERE run IN (FROM again)),
words AS (SELECT r, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS p FROM d WHERE len(w) > 0),
kept AS (SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (r, p) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
}
