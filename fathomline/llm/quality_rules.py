"""Quality rules by line labelling (operator 1).

A conditional random field over a document's lines marks each line as content
or boilerplate; Viterbi decoding gives the best labelling of the whole document,
and the share of words in content lines decides whether the document stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.crf import Crf, fit_latent
from fathomline.llm.sampling import least_hashes
from fathomline.llm.text import column_bytes, range_hashes, slices, symbol_values, window_hashes, word_hashes, word_spans

#: Most labelled documents of each class that training reads, and the longest text among them in bytes and in lines.
TRAIN_DOCUMENTS, TRAIN_BYTES, TRAIN_LINES = 1000, 1 << 16, 512
LEAST_SHARE = 0.5
CHAIN = 40  # training chains are cut to so many lines
WINDOW = 5
FEATURES = 14


def _classes() -> np.ndarray:
    """For each byte, one-hot classes: lower, upper, digit, symbol, end mark, other mark, space, bar, exclamation."""
    out = np.zeros((256, 9), np.float32)
    for k, chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b"#*$%&<>|", b".?:;,", b"\"'()[]{}-_/\\=+@~^`", b" \t", b"|", b"!")):
        out[list(chars), k] = 1
    return out


_CLASSES = _classes()
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]), dtype=np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[ends] - total[starts]


def _again(owner: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose (owner, keys) occurred earlier; rows whose (owner, keys) occur more than once."""
    order = np.lexsort((*keys, owner))
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = True
    for k in (owner, *keys):
        k = k[order]
        same[1:-1] &= k[1:] == k[:-1]
    later, some = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same[:-1]
    some[order] = same[:-1] | same[1:]
    return later, some


def measure(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Base counts of each text; features and words of each line that has a word; the lines' offsets by text."""
    n = len(offsets) - 1
    starts, ends, first = word_spans(data, offsets)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)
    solid = (data & 0xC0) != 0x80
    points = _sums(solid, starts, ends)
    h = word_hashes(data, starts, ends)
    at = np.flatnonzero(np.repeat(first[1:], n_words) - np.arange(len(h)) >= WINDOW)
    _, some = _again(doc[at], window_hashes(h, at, WINDOW, 0))
    depth = np.zeros(len(h) + 1, np.int32)
    np.add.at(depth, at[some], 1)
    np.add.at(depth, at[some] + WINDOW, -1)
    repeat = np.cumsum(depth[:-1]) > 0

    # lines: cut at \n and at the texts' ends
    newline = np.flatnonzero(data == 10)
    begins = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    begins = begins[begins < len(data)]
    stops = np.minimum(np.append(newline, len(data))[np.searchsorted(newline, begins)], offsets[np.searchsorted(offsets, begins, side="right")])
    lo, hi = np.searchsorted(starts, begins), np.searchsorted(starts, stops)
    full = hi > lo
    begins, stops, lo, hi = begins[full], stops[full], lo[full], hi[full]
    owner = np.searchsorted(offsets, begins, side="right") - 1
    keys = [range_hashes(symbol_values(k)[data], begins, stops, k) for k in (0, 1)]
    later, some = _again(owner, *keys)
    line_words = hi - lo
    line_of = np.repeat(np.arange(len(lo)), line_words)
    twice, _ = _again(line_of, h)
    size = np.maximum(stops - begins, 1)
    share = np.stack([_sums(_CLASSES[data, k] > 0, begins, stops) for k in range(_CLASSES.shape[1])], axis=1) / size[:, None]
    place = np.arange(len(lo)) - np.searchsorted(owner, owner)
    count = np.bincount(owner, minlength=n)[owner] if len(owner) else np.zeros(0)
    x = np.concatenate([share, np.stack([np.minimum(line_words, 40) / 40, np.minimum(np.add.reduceat(points, lo) / np.maximum(line_words, 1), 20) / 20 if len(lo) else np.zeros(0), np.add.reduceat(twice, lo) / np.maximum(line_words, 1) if len(lo) else np.zeros(0), some, ((place == 0) | (place == count - 1)) & (count > 2)], axis=1)], axis=1)
    by_doc = lambda v: np.bincount(doc, weights=v, minlength=n).astype(np.int64)
    base = {"n_words": n_words, "word_chars": by_doc(points), "n_symbols": _sums(_SYMBOL[data], offsets[:-1], offsets[1:]), "n_dup_lines": np.bincount(owner, weights=later, minlength=n).astype(np.int64), "n_repeat_words": by_doc(repeat)}
    return base, x, line_words, np.searchsorted(owner, np.arange(n + 1))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        _, x, words, cuts = measure(*column_bytes(batch.column("text")))
        columns = [[v[a:b].astype(kind).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)] for v, kind in ((x, np.float32), (words, np.int32))]
        yield pa.RecordBatch.from_arrays([batch.column("quality"), *(pa.array(c, pa.binary()) for c in columns)], names=["quality", "x", "words"])


def train(docs: DataFrame, labels: DataFrame, documents: int = TRAIN_DOCUMENTS, least_share: float = LEAST_SHARE) -> Crf | None:
    """A field fitted on at most `documents` labelled documents of each quality, chosen by the hash of their id.

    Which lines are content is hidden: a good document is only known to have
    `least_share` of its words in content lines, and a bad one not to.  None
    where a class has no document with a word.
    """
    labels = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).distinct()
    picked = [least_hashes(labels.where(F.col("quality") == q), documents, "doc_id") for q in (0, 1)]
    ids = picked[0].unionByName(picked[1])  # at most 2 * documents rows of two numbers
    short = (F.octet_length("text") <= TRAIN_BYTES) & (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < TRAIN_LINES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(short).join(F.broadcast(ids), "doc_id").select("quality", "text").mapInArrow(_features, "quality int, x binary, words binary").collect()
    found = sorted((r["quality"], bytes(r["x"]), bytes(r["words"])) for r in rows if r["words"])
    if len({q for q, _, _ in found}) < 2:
        return None
    return fit_latent([np.frombuffer(x, np.float32).reshape(-1, FEATURES) for _, x, _ in found], [np.frombuffer(w, np.int32) for _, _, w in found], [q == 1 for q, _, _ in found], least_share, CHAIN)


_NEW = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content_share double, base_failed boolean, kept boolean"


def verdicts(docs: DataFrame, labels: DataFrame, least_share: float = LEAST_SHARE, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """`document` (a struct of the columns of `docs`), the base counts, content_share, base_failed and kept; one row per row.

    base_failed: fewer than 10 words, or more than a fifth of the words in
    five-word windows that repeat.  kept: not base_failed, and at least
    `least_share` of the words lie in lines labelled content.  A null or empty
    text has no words, so it fails; rows are judged alone, so null and repeated
    ids and repeated rows change nothing; a share of exactly `least_share` is
    kept, and ties in decoding go to content.  Without labels of both classes
    every line counts as content.
    """
    field = train(docs, labels, documents, least_share)
    names = [c.split()[0] for c in _NEW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            base, x, words, cuts = measure(*column_bytes(batch.column("text")))
            marks = field.decode(field.scores(x), cuts) if field else np.ones(len(x), np.int8)
            total = np.zeros(len(words) + 1, np.int64)
            np.cumsum(words * marks, out=total[1:])
            share = (total[cuts[1:]] - total[cuts[:-1]]) / np.maximum(base["n_words"], 1)
            failed = (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])
            yield pa.RecordBatch.from_arrays([batch.column("document"), *(pa.array(v) for v in base.values()), pa.array(share), pa.array(failed), pa.array(~failed & (share >= least_share))], names=["document", *names])

    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document"), F.col("text"))
    return whole.mapInArrow(run, f"document {whole.schema['document'].dataType.simpleString()}, {_NEW}")


def judge(docs: DataFrame, labels: DataFrame, least_share: float = LEAST_SHARE, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """`verdicts` with the columns of `docs` side by side; those that clash with the new ones are left out."""
    new = {c.split()[0] for c in _NEW.split(", ")}
    found = verdicts(docs, labels, least_share, documents)
    return found.select(*[F.col(f"document.`{c}`").alias(c) for c in docs.columns if c.lower() not in new], *[c for c in found.columns if c != "document"])


def accepted(docs: DataFrame, labels: DataFrame, least_share: float = LEAST_SHARE, documents: int = TRAIN_DOCUMENTS) -> DataFrame:
    """The rows of `docs` that are kept, with all their columns as they were."""
    return verdicts(docs, labels, least_share, documents).where("kept").select(*[F.col(f"document.`{c}`").alias(c) for c in docs.columns])


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("text")


ORACLE_SQL: dict[str, str] = {}
