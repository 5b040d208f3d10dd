"""Token ids in files, frequency-ranked and byte-aligned (operator 12).

The most frequent id has rank 0.  A rank is written in as many whole bytes as it
needs, least first; a separate stream of control bytes tells the lengths, two bits
each, four ranks to a byte.  A reader looks control bytes up in a table of
lengths, sums them into offsets and gathers all values of a block at once.

The format is a folder of two Parquet tables.  `ranks` has rank, id and n.  `ids`
has a row per block, whole documents of about 2**18 ids: shard, block, first (ids
in the shard before it), doc_ids, sizes, control, data.  Shards follow the order of
doc_id, so a document's place in the whole stream is its shard's base, the ids of
the shards before it, and its place there.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm.bytepieces import byte_pieces
from fathomline.llm.shared import checkpoint_dir, stored
from fathomline.llm.text import slices

END = 2
#: Ids of a block, at least, unless the shard ends; bytes of text of a shard, about.
BLOCK, SHARD_BYTES = 1 << 18, 48 << 20
#: Bytes of text that get their ids together: the more, the less often a chunk gets its ids again.
_SLICE = 8 << 20
_BLOCKS = "shard long, block long, first long, doc_ids array<long>, sizes array<long>, control binary, data binary"
#: The four lengths that each control byte tells.
LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def encode(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of numbers below 2**32."""
    ranks = ranks.astype(np.uint32)
    more = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    lanes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    lanes[: len(ranks)] = more
    lanes = lanes.reshape(-1, 4)
    control = lanes[:, 0] | lanes[:, 1] << 2 | lanes[:, 2] << 4 | lanes[:, 3] << 6
    ends = np.cumsum(more.astype(np.int64) + 1)
    at = ends - more - 1
    data = np.empty(ends[-1] if len(ends) else 0, np.uint8)
    for k in range(4):
        long = slice(None) if k == 0 else np.flatnonzero(more >= k)
        data[at[long] + k] = (ranks[long] >> np.uint32(8 * k)) & np.uint32(0xFF)
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers again."""
    sizes = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(sizes, dtype=np.int64) - sizes
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, 4):
        long = np.flatnonzero(sizes > k)
        out[long] |= raw[at[long] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _encoded(tokenizer: str, end: int):
    """Sorted texts as blocks whose numbers are ranks in the block; met and times: its ids by rank, and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, last = byte_pieces(tokenizer), np.array([end], np.uint32)
        shard, first, block = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        waiting = 0

        def emit() -> pa.RecordBatch:
            ids = np.concatenate(held)
            times = np.bincount(ids)
            met = np.flatnonzero(times)
            met = met[np.argsort(-times[met], kind="stable")]
            rank = np.empty(len(times), np.uint32)
            rank[met] = np.arange(len(met), dtype=np.uint32)
            control, data = encode(rank[ids])
            return pa.RecordBatch.from_pylist([{"shard": shard, "block": block, "first": first, "doc_ids": doc_ids, "sizes": [len(x) for x in held], "control": control, "data": data, "met": met.astype("<u4").tobytes(), "times": times[met].astype("<i8").tobytes()}], schema=_ENCODED_ARROW)

        for batch in slices(batches, "text", _SLICE):
            ids, offsets = pieces.of_texts(batch.column("text"))
            for doc_id, lo, hi in zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                doc_ids.append(doc_id)
                held.append(np.concatenate((ids[lo:hi], last)))
                waiting += hi - lo + 1
                if waiting >= BLOCK:
                    yield emit()
                    first, block, waiting, doc_ids, held = first + waiting, block + 1, 0, [], []
        if held:
            yield emit()

    return run


_ENCODED = f"{_BLOCKS}, met binary, times binary"
_ENCODED_ARROW = pa.schema([("shard", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("control", pa.binary()), ("data", pa.binary()), ("met", pa.binary()), ("times", pa.binary())])


def count_ids(encoded: DataFrame) -> DataFrame:
    """id, n over all blocks; a task gives a row for each id that it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for met, times in zip(batch.column("met"), batch.column("times"), strict=True):
                met, times = np.frombuffer(met.as_buffer(), "<u4"), np.frombuffer(times.as_buffer(), "<i8")
                total = np.pad(total, (0, max(0, int(met.max()) + 1 - len(total))))
                total[met] += times
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], names=["id", "n"])

    return encoded.select("met", "times").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end: int = END, shard_bytes: int = SHARD_BYTES) -> None:
    """Writes the ids of `docs` (doc_id, text) to the folder `path`, in ascending order of doc_id, null first.

    A null or empty text is its end id alone.  Rows of one doc_id stand in the
    order of a hash of their text, equal rows in that of their place in `docs`;
    the ranges split a doc_id, or a row, that very many rows share.  Other columns
    are ignored; an empty table gives an empty one.  The driver holds a row for
    each id of the vocabulary, never one for each document; a task sorts one
    shard's texts and holds one block, or one longer document.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    volume = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    shards = int(max(1, (volume[0] + 64 * volume[1]) // shard_bytes, min(spark.sparkContext.defaultParallelism, (volume[0] >> 20) + 1)))
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    sorted_docs = placed.repartitionByRange(shards, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row").select("doc_id", "text")
    # texts get their ids once: blocks with ranks of their own wait until those of the corpus are known
    encoded = stored(sorted_docs.mapInArrow(_encoded(tokenizer, end), _ENCODED), "zstd")
    count_ids(encoded).orderBy(F.desc("n"), "id").coalesce(1).select((F.monotonically_increasing_id()).alias("rank"), "id", "n").write.parquet(f"{path}/ranks")
    of_id = _ranks(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = np.zeros(int(of_id.max(initial=0)) + 1, np.uint32)
        rank[of_id] = np.arange(len(of_id), dtype=np.uint32)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name).slice(k, 1) for name in batch.schema.names}
                n = sum(row["sizes"][0].as_py())
                own = rank[np.frombuffer(row["met"][0].as_buffer(), "<u4")]
                control, data = encode(own[decode(row["control"][0].as_buffer(), row["data"][0].as_buffer(), n)])
                yield pa.RecordBatch.from_arrays([*(row[name] for name in batch.schema.names[:5]), pa.array([control], pa.binary()), pa.array([data], pa.binary())], names=batch.schema.names[:7])

    encoded.mapInArrow(run, _BLOCKS).write.option("compression", "zstd").parquet(f"{path}/ids")


def _ranks(spark: SparkSession, path: str) -> np.ndarray:
    """The id of each rank: as many as the vocabulary has, at most."""
    table = spark.read.schema("rank long, id long, n long").parquet(f"{path}/ranks").toArrow().sort_by("rank")
    return table.column("id").to_numpy()


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (binary, little-endian uint32) of each document of a folder that write_ids has written."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/ids")
    of_rank = _ranks(spark, path).astype("<u4")
    held = {r["shard"]: r["n"] for r in blocks.select("shard", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    bases, before = {}, 0  # a row for each shard of some 50 MB
    for shard in sorted(held):
        bases[shard], before = before, before + held[shard]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k] for name in batch.schema.names}
                sizes = row["sizes"].values.to_numpy()
                ends = np.cumsum(sizes)
                ids = of_rank[decode(row["control"].as_buffer(), row["data"].as_buffer(), int(ends[-1]))]
                start = ends - sizes + row["first"].as_py() + bases[row["shard"].as_py()]
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.concatenate(([0], 4 * ends)).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([row["doc_ids"].values, pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), packed], names=["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/token_files/{uuid.uuid4().hex}"
    write_ids(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, default_tokenizer())
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


ORACLE_SQL: dict[str, str] = {}
