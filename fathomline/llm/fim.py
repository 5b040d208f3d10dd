"""Fill-in-middle transformation as a pyarrow.compute pipeline (operator 13).

A batch's texts are split into list arrays of lines and flattened with their
parents' indices; a line's ordinal in its text and two cuts decide its role.  The
lines of a role are filtered out of the flat array, rebuilt into lists and joined
into the text's prefix, middle and suffix, which are joined again with marks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.text import slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that are turned, and of these that are written suffix first.
RATE, SPM_RATE, SEED = 100, 50, 7
_SLICE = 2 << 20


def split_lines(texts: pa.Array) -> pa.Array:
    """Lists of the lines ``[^\\n]*\\n|[^\\n]+`` of texts without nulls."""
    pieces = pc.split_pattern(texts.cast(pa.large_string()), "\n")
    flat, parents = pc.list_flatten(pieces), pc.list_parent_indices(pieces).to_numpy()
    last = np.ones(len(flat), dtype=bool)
    last[:-1] = parents[1:] != parents[:-1]
    ended = pc.if_else(pa.array(last), flat, pc.binary_join_element_wise(flat, pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())))
    full = np.array(pc.greater(pc.binary_length(ended), 0))  # what stands behind the last newline may be nothing
    return _lists(ended.filter(pa.array(full)), parents[full], len(texts))


def _lists(values: pa.Array, parents: np.ndarray, n: int) -> pa.Array:
    """The flat values again as n lists, parents ascending."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(parents, minlength=n))))
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def cut(lines: pa.Array, one: np.ndarray, two: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix: the lines before the smaller of the cuts, those up to the larger, the rest."""
    flat, parents = pc.list_flatten(lines), pc.list_parent_indices(lines).to_numpy()
    ordinal = np.arange(len(flat)) - np.asarray(lines.offsets)[:-1][parents]
    low, high = np.minimum(one, two)[parents], np.maximum(one, two)[parents]
    role = (ordinal >= low).astype(np.int8) + (ordinal >= high)
    return [pc.binary_join(_lists(flat.filter(pa.array(role == k)), parents[role == k], len(lines)), pa.scalar("", pa.large_string())) for k in range(3)]


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in parts], pa.scalar("", pa.large_string()))


def draws(seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight digits of the hex SHA-256 of ``<seed>:<doc_id>``; a null doc_id stands as nothing."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def transform(docs: DataFrame, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output: one row for each row of `docs`, nothing shuffled.

    form is plain, psm or spm.  A text without lines (null counts as empty), one
    that holds a mark itself, and those beyond `rate` per cent stay plain: their
    output is the text, and the two lengths are null.  A null doc_id stays null; rows of one
    doc_id are cut by the same numbers, each in its own lines; repeated rows give
    a row each; other columns are ignored.  A task holds a few MB, or one longer text.
    """
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", _SLICE):
            texts = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy() for k in range(1, 5))
            lines = split_lines(texts)
            n = pc.list_value_length(lines).to_numpy()
            prefix, middle, suffix = cut(lines, h1 % (n + 1), h2 % (n + 1))
            marked = np.zeros(len(texts), dtype=bool)
            for mark in (PREFIX, SUFFIX, MIDDLE):
                marked |= np.array(pc.match_substring(texts, mark))
            plain = (n == 0) | marked | (h3 % 100 >= rate)
            spm = ~plain & (h4 % 100 < spm_rate)
            form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")))
            p, s, m = _joined(PREFIX, prefix), _joined(SUFFIX, suffix), _joined(MIDDLE, middle)
            output = pc.if_else(pa.array(plain), texts, pc.if_else(pa.array(spm), _joined(s, p, m), _joined(p, s, m)))
            sizes = [pc.if_else(pa.array(plain), pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), form, *sizes, output.cast(pa.string())], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", *draws(seed)).mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(turned: DataFrame) -> DataFrame:
    """The rows of `transform` with `restored`, the text rebuilt from output and form alone.  Marks stand once each, so the parts between them are the pieces."""

    def between(first: str, second: str) -> list[Column]:
        """What follows the first mark, the second and the middle's."""
        a, b, c = (F.locate(mark, F.col("output")) for mark in (first, second, MIDDLE))
        return [F.substring("output", a + len(first), b - a - len(first)), F.substring("output", b + len(second), c - b - len(second)), F.substring("output", c + len(MIDDLE), F.char_length("output"))]

    (p, s, m), (s2, p2, m2) = between(PREFIX, SUFFIX), between(SUFFIX, PREFIX)
    return turned.withColumn("restored", F.when(F.col("form") == "psm", F.concat(p, m, s)).when(F.col("form") == "spm", F.concat(p2, m2, s2)).otherwise(F.col("output")))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
u AS (
  SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
    ('0x' || substr(digest, 1, 8))::BIGINT AS h1, ('0x' || substr(digest, 9, 8))::BIGINT AS h2, ('0x' || substr(digest, 25, 8))::BIGINT AS h4 FROM d),
c AS (
  SELECT *, len(lines) AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a, greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

ORACLE_SQL: dict[str, str] = {"op13_fim": _SQL}
