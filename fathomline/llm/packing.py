"""Cost-balanced packing of documents into training sequences (operator 2).

A piece of L tokens is estimated to cost linear * L + quadratic * L * L (its
feed-forward and attention work, attention staying inside a document).  Pieces
go, largest first, to the sequence of least cost that still has room for them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from fathomline.llm.text import release, slices
from fathomline.llm.wordpieces import word_pieces

SEQUENCE = 4096
END = 2
#: Tokens that a task packs together.
GROUP = 1 << 20
#: Cost per token and per pair of tokens; equal at 12,288 tokens, as for a width of 2,048.
LINEAR, QUADRATIC = 1.0, 1 / 12288
#: Bytes of text that get their ids together; a worker needs some 36 times as much for it.
SLICE = 2 << 20


def pack(sizes: list[int], sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences, each a list of pieces (document, start, length) in order.

    Whole multiples of `sequence` are cut off first.  The rest goes into as many
    full sequences as it fills, and what is over into sequences of distinct
    powers of two, so every token has a place and no sequence needs padding.
    """
    out = [[(k, lo, sequence)] for k, n in enumerate(sizes) for lo in range(0, n - sequence + 1, sequence)]
    rest = sorted(((n % sequence, k, n - n % sequence) for k, n in enumerate(sizes) if n % sequence), key=lambda x: (-x[0], x[1]))
    total = sum(n for n, _, _ in rest)
    room = [sequence] * (total // sequence) + [1 << b for b in range(sequence.bit_length() - 2, -1, -1) if total % sequence >> b & 1]
    free, cost, held = np.array(room), np.zeros(len(room)), [[] for _ in room]
    late = []

    def put(s: int, piece: tuple[int, int, int]) -> None:
        free[s] -= piece[2]
        cost[s] += linear * piece[2] + quadratic * piece[2] ** 2
        held[s].append(piece)

    for n, k, lo in rest:
        fits = np.where(free >= n, cost, np.inf)
        s = int(np.argmin(fits))
        if fits[s] < np.inf:
            put(s, (k, lo, n))
        else:
            late.append((n, k, lo))
    for n, k, lo in late:  # no sequence holds it whole: the cheapest of those that hold most of it, again and again
        while n:
            most = min(n, int(free.max()))
            s = int(np.argmin(np.where(free >= most, cost, np.inf)))
            put(s, (k, lo, most))
            n, lo = n - most, lo + most
    return out + held


def pack_documents(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, group: int = GROUP, end: int = END, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (as little-endian uint32).

    A task packs documents in groups of about `group` tokens where it reads
    them, so nothing is shuffled and a task holds one group.  A null or empty text
    is its end id alone; a null doc_id stays null; repeated rows are packed each;
    other columns are ignored.  A sequence is full, or holds a power of two.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def emit(held: list[tuple[int | None, bytes]], first: int) -> tuple[pa.RecordBatch, int]:
        rows, made = [], pack([len(x) // 4 for _, x in held], sequence, linear, quadratic)
        for s, pieces in enumerate(made):
            offset = 0
            for k, start, length in pieces:
                ids = held[k][1][4 * start : 4 * (start + length)]
                rows.append((held[k][0], start, length, zlib.crc32(ids), len(held[k][1]) // 4, first + s, offset, ids))
                offset += length
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names), first + len(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what the stage before has left
        pieces, last = word_pieces(tokenizer), np.array([end], "<u4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        waiting, sequence_id = 0, TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", SLICE):
            ids, offsets = pieces.of_texts(batch.column("text"))
            whole = ids.astype("<u4").tobytes()
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                held.append((doc_id, whole[4 * lo : 4 * hi] + last))
                waiting += hi - lo + 1
                if waiting >= group:
                    out, sequence_id = emit(held, sequence_id)
                    held, waiting = [], 0
                    yield out
        if held:
            yield emit(held, sequence_id)[0]

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer()).drop("ids")


ORACLE_SQL: dict[str, str] = {}
