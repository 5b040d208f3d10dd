"""Suffix-array dedup by a distributed difference-cover sort (operator 4).

A byte goes when it lies in a string of `length` bytes that also starts
earlier.  Suffixes whose positions lie in a difference cover are sorted by their
first bytes and named; a name that stands alone settles every suffix near it.
The remaining suffixes, within a period before a repeated name, are merged in by
the order of their `length`-byte prefixes, and each is compared with its
neighbour: an equal prefix of an earlier suffix removes it.  As only prefixes of
`length` bytes matter, names are hashes (any order of names serves), and one
level of naming takes the place of the recursion down to single ranks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import repeats
from fathomline.llm.text import joined, slices

LENGTH, PERIOD = 100, 57


def _read(texts: list[bytes]):
    data, offsets = joined(texts)
    return (data, data), offsets, data


def ordered_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """(block, known, doc_id, text, digest): blocks follow the order of doc_id (null first), texts are compressed for the shuffle."""
    shares = [k / blocks for k in range(1, blocks)]
    edges = np.array(sorted(set(docs.approxQuantile("doc_id", shares, 0.25 / blocks)))) if shares else np.empty(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for batch in slices(batches, "text"):
            # rounding to doubles keeps the order, and ids that round to one double share a block
            ids = np.where(batch.column("known").to_numpy() == 1, batch.column("doc_id").to_numpy().astype(np.float64), -np.inf)
            block = np.searchsorted(edges, ids, side="right")
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            digests = [hashlib.md5(x, usedforsecurity=False).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), batch.column("known"), batch.column("doc_id"), pa.array([squeeze(x) for x in texts], pa.binary()), pa.array(digests, pa.binary())], names=["block", "known", "doc_id", "text", "digest"])

    return docs.mapInArrow(run, "block long, known int, doc_id long, text binary, digest binary")


def _open(data: bytes) -> bytes:
    return zstandard.decompress(data)


def remove_later(docs: DataFrame, length: int = LENGTH, period: int = PERIOD, block_mb: float = 2.0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): one row per row of `docs`.

    Matches never cross documents.  Null texts are empty; a null doc_id comes
    before all others; rows that repeat a doc_id are documents of their own, in
    the order of their texts; texts shorter than `length` stay whole; other
    columns are ignored.
    """
    _, size = repeats.volume(docs)
    blocks = max(1, int(size / (block_mb * (1 << 20))))
    plan = repeats.Plan(length, period, blocks, size, True, True, _read, _open)
    docs = docs.select(*repeats.whole_ids(), F.coalesce("text", F.lit("")).cast("binary").alias("text"))

    def finish(d: pd.DataFrame, block, starts: np.ndarray, flags: np.ndarray, copies: np.ndarray) -> pd.DataFrame:
        if block is None:
            return pd.DataFrame({"known": [], "doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []})
        gone = repeats.covered(len(block.extra), starts[flags], length)
        copies, rows = set(copies.tolist()), []
        for k, (known, doc_id, lo, hi) in enumerate(zip(d["known"], d["doc_id"], block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)):
            out = np.full(hi - lo, hi - lo >= length) if k in copies else gone[lo:hi]
            spans = int(out[:1].sum() + (out[1:] & ~out[:-1]).sum())
            rows.append((known, doc_id, hi - lo, int(out.sum()), spans, block.extra[lo:hi][~out].tobytes()))
        return pd.DataFrame(rows, columns=["known", "doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return repeats.with_nulls(repeats.find(ordered_blocks(docs, blocks), plan, finish, "known int, doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_later(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = {
    # bytes are pairs of hex digits; a string is known by its md5
    "op4_suffix_dedup": """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, coalesce(text, '')) AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT r, i, md5_number(substr(h, 2 * i + 1, 200)) AS x FROM (SELECT r, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM d WHERE length(h) >= 200)),
later AS (SELECT r, i FROM s QUALIFY row_number() OVER (PARTITION BY x ORDER BY r, i) > 1),
marked AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 100 THEN 1 ELSE 0 END AS new FROM later),
numbered AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM marked),
spans AS (SELECT r, min(i) AS lo, max(i) + 100 AS hi FROM numbered GROUP BY r, run),
ends AS (SELECT r, lo, hi FROM spans UNION ALL SELECT r, length(h) // 2, length(h) // 2 FROM d),
pieces AS (SELECT r, lo, coalesce(max(hi) OVER (PARTITION BY r ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS since FROM ends),
kept AS (SELECT r, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' ORDER BY lo, since) AS k FROM pieces JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(hi - lo) AS n, count(*) AS spans FROM spans GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k)) AS kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)"""
}
