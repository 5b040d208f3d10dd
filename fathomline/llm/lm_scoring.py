"""Language-model scoring by causal self-attention (operator 9).

Everything that is learned comes from all training documents: word counts, subword
counts, and an attention model over subword ids.  The model sees every window of
every training document once: documents are dealt into rounds and their chunks into
shards by hash, each shard is trained in one task from its round's common weights,
and the shards' rows are averaged by how often each was used.  Shards and orders
depend on the texts alone, so the result does not depend on the partitions.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.llm import attention
from fathomline.llm.packing import default_tokenizer
from fathomline.llm.shared import stored
from fathomline.llm.text import release, slices
from fathomline.llm.wordpieces import gather, split_words, word_pieces

#: Most words, the commonest, whose counts go to every task; the others are joined.
COMMON = 400_000
#: Averaging rounds of training, ids of a chunk (whole windows) and of a shard.
ROUNDS, CHUNK, SHARD = 3, attention.NEW * 64, 4 << 20
#: Bytes of text or ids that a task holds at once.
SLICE = 8 << 20
#: Slices of the weights that are averaged apart, and parts that one group of a slice sums.
PARTS, FAN = 16, 64
FOLDS, HELD_OUT = 7, 2
END = b""  # the end token's key; no word is empty


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        words, codes, _ = split_words(pc.ascii_lower(batch.column("text")))
        words = pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())])
        n = np.append(np.bincount(codes, minlength=len(words) - 1), batch.num_rows)
        yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over whole texts of all training documents, the end token included."""
    return training.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _subwords(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(tokenizer)
        total = np.zeros(pieces.vocabulary + 1, dtype=np.int64)
        for batch in batches:
            ids, offsets = pieces.of_words(batch.column("word"))
            total += np.bincount(ids, weights=np.repeat(batch.column("n").to_numpy(), np.diff(offsets)), minlength=len(total)).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def kind(size: int) -> str:
    """How ids and places of a vocabulary with its end are written."""
    return "<u2" if size < 1 << 16 else "<u4"


def _places(batch: pa.RecordBatch, known: attention.Vocabulary) -> list[np.ndarray]:
    """Each text's subwords and its end, as places."""
    end = known.place[-1:]
    return [np.concatenate((known.place[np.frombuffer(x.as_buffer(), kind(known.size))], end)) for x in batch.column("ids")]


def _chunks(told, shards: int):
    """Chunks of each training text, each with the places before it: shard, order and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        before = np.full(attention.BEFORE, known.start, dtype=np.int32)
        for batch in slices(batches, "ids", SLICE):
            rows = []
            for text in _places(batch, known):
                whole = np.concatenate((before, text)).astype(kind(known.size))
                key = hashlib.blake2b(whole.tobytes(), digest_size=8).digest()
                for k, at in enumerate(range(0, len(text), CHUNK)):
                    order = hashlib.blake2b(key + k.to_bytes(8, "little"), digest_size=8).digest()
                    rows.append((int.from_bytes(order, "little") % shards, order, whole[at : at + attention.BEFORE + CHUNK].tobytes()))
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["shard", "order", "places"])

    return run


def _train(told, weights):
    def run(shard: pd.DataFrame) -> pd.DataFrame:
        release()  # what the shard before has left
        known = told.value
        shard = shard.sort_values(["order", "places"], kind="stable")
        chunks = [np.frombuffer(x, kind(known.size)).astype(np.int32) for x in shard["places"]]
        begins = np.concatenate(([0], np.cumsum([len(x) for x in chunks])))
        trainer = attention.Trainer(attention.Weights(weights.value, known), known)
        trainer.run(np.concatenate(chunks), begins)
        parts = zip(np.array_split(trainer.w.rows * trainer.used[:, None], PARTS), np.array_split(trainer.used, PARTS), strict=True)
        number = int(shard["shard"].iloc[0])
        return pd.DataFrame([(k, number, r.astype(np.float32).tobytes(), n.tobytes()) for k, (r, n) in enumerate(parts)], columns=["part", "shard", "rows", "used"])

    return run


def _sum(group: pd.DataFrame) -> pd.DataFrame:
    """The sum of a slice's parts, in the order of their shards."""
    group = group.sort_values("shard", kind="stable")
    total = [sum(np.frombuffer(x, t).astype(np.float64) for x in group[c]).astype(t).tobytes() for c, t in (("rows", np.float32), ("used", np.float64))]
    return pd.DataFrame({"part": group["part"].iloc[:1], "shard": group["shard"].iloc[:1] // FAN, "rows": total[:1], "used": total[1:]})


_PARTS = "part int, shard long, rows binary, used binary"


def fit(training: DataFrame, known: attention.Vocabulary, tokens: int, rounds: int = ROUNDS, shard: int = SHARD) -> np.ndarray:
    """The model's weights; training: doc_id, ids (of the text's subwords); tokens: how many subwords and ends the training texts have."""
    context = training.sparkSession.sparkContext
    weights, told = attention.Weights.initial(known).rows, context.broadcast(known)
    shards = max(1, math.ceil(tokens / rounds / shard))
    for r in range(rounds):
        common = context.broadcast(weights)
        part = training.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(rounds)) == r).select("ids")
        made = part.mapInArrow(_chunks(told, shards), "shard long, order binary, places binary").groupBy("shard").applyInPandas(_train(told, common), _PARTS)
        left = shards
        while left > 1:  # a tree, so no group has more than FAN parts
            made, left = made.groupBy("part", F.floor(F.col("shard") / FAN)).applyInPandas(_sum, _PARTS), math.ceil(left / FAN)
        found = sorted(made.collect(), key=lambda x: x["part"])  # the weights once
        if found:
            rows = np.concatenate([np.frombuffer(x["rows"], np.float32) for x in found]).reshape(weights.shape)
            used = np.concatenate([np.frombuffer(x["used"], np.float64) for x in found])[:, None]
            weights = np.where(used > 0, rows / np.maximum(used, 1), weights).astype(np.float32)
    return weights


def _commonest(counts: DataFrame, most: int) -> DataFrame:
    """The words above a count that at most `most` words reach: steps of an eighth of a power of two tell which."""
    step = F.floor(F.log2("n") * 8)
    left, least = most, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # a few hundred rows at most
        left -= r["count"]
        if left < 0:
            break
        least = r["step"]
    return counts.where(step >= F.lit(least)) if least is not None else counts.where("false")


def vocabulary(counts: DataFrame, tokenizer: str) -> tuple[attention.Vocabulary, int]:
    """The subwords' order and classes from the counts of words; how many subwords and ends the training texts have."""
    rows = counts.where("word <> X''").mapInArrow(_subwords(tokenizer), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # one row per id of the vocabulary
    tally = np.zeros(word_pieces(tokenizer).vocabulary + 1, dtype=np.int64)
    for r in rows:
        tally[r["id"]] = r["n"]
    tally[-1] = counts.where("word = X''").agg(F.sum("n")).first()[0] or 0
    return attention.vocabulary(tally), int(tally.sum())


_REST = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def _common_ids(words: pa.Array, tokenizer: str, most: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the words (binary) and their offsets, few words at a time."""
    pieces = word_pieces(tokenizer)
    made = [pieces.of_words(words[lo : lo + most]) for lo in range(0, len(words), most)]
    sizes = np.concatenate([np.diff(offsets) for _, offsets in made]) if made else np.empty(0, np.int64)
    return np.concatenate([ids for ids, _ in made]) if made else np.empty(0, np.uint32), np.concatenate(([0], np.cumsum(sizes)))


def _ids(pieces, words: pa.Array, places: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their offsets and each word's place among them: the common words' are `known`, at `places`; the others (-1) get theirs here."""
    other = np.flatnonzero(places < 0)
    ids, offsets = pieces.of_words(words.take(pa.array(other)))
    at = places.astype(np.int64)
    at[other] = len(known[1]) - 1 + np.arange(len(other))
    return np.concatenate((known[0], ids)), np.concatenate((known[1], known[1][-1] + offsets[1:])), at


def _base(words: pa.Array, codes: np.ndarray, first: np.ndarray, places: np.ndarray, logs: np.ndarray, end: float) -> list[pa.Array]:
    """n_tokens, n_known and the sum of logs over common words; the other words of each text with their counts."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    found = places[codes]
    common_word = found >= 0
    known = np.bincount(owner[common_word], minlength=n)
    total = np.bincount(owner[common_word], weights=logs[found[common_word]], minlength=n)
    pairs, times = np.unique(owner[~common_word] * max(1, len(words)) + codes[~common_word], return_counts=True)
    offsets = np.searchsorted(pairs, np.arange(n + 1) * max(1, len(words)))
    rest = pa.StructArray.from_arrays([words.take(pa.array(pairs % max(1, len(words)))).cast(pa.binary()), pa.array(times, pa.int64())], names=["word", "n"])
    ended = math.isfinite(end)  # the end token is known once there is a training document
    return [pa.array(np.diff(first) + 1), pa.array(known + ended), pa.array(total + (end if ended else 0.0)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest)]


_BASE = ["row", "doc_id", "held_out", "n_tokens", "n_known", "logs"]


def _read(tokenizer: str, told):
    """Each text's base columns and the ids of its subwords, its words split once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, logs, end, known = told.value
        pieces = word_pieces(tokenizer)
        for batch in slices(batches, "text", SLICE):
            split = split_words(pc.ascii_lower(batch.column("text")))
            places = pc.fill_null(pc.index_in(split[0].cast(pa.binary()), common), -1).to_numpy()
            ids, offsets, at = _ids(pieces, split[0], places, known)
            ids, begins = gather(ids, offsets, at[split[1]])
            ids = ids.astype(kind(pieces.vocabulary + 1))
            cuts = (begins[split[2]] * ids.itemsize).astype(np.int32)
            whole = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(cuts), pa.py_buffer(ids)])
            tokens, some, sums, rest = _base(*split, places, logs, end)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _BASE[:3]), tokens, some, sums, rest.cast(_REST), whole], names=[*_BASE, "rest", "ids"])

    return run


def score(docs: DataFrame, tokenizer: str, common: int = COMMON) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of `docs`.

    Null and empty texts are their end token, which `score` counts too; a null
    doc_id is a training document; repeated rows each count, and equal texts get
    equal scores; other columns are ignored.  Without training documents all
    counts are 0 and the model is uniform.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    spark = docs.sparkSession
    counts = stored(word_counts(docs.where(~held_out(F.col("doc_id")))))
    size = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total, distinct = int(size[0] or 0), int(size[1])
    frequent = _commonest(counts.where("word <> X''"), common).select("word", "n").toArrow().sort_by("word")  # at most `common` rows
    ends = counts.where("word = X''").agg(F.sum("n")).first()[0]
    frequent_words = pa.array(frequent["word"].combine_chunks())
    words = spark.sparkContext.broadcast((frequent_words, np.log10(frequent["n"].to_numpy() + 1.0), math.log10(ends + 1) if ends else -math.inf, _common_ids(frequent_words, tokenizer)))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    # written once, so the row numbers stay and texts get their ids once
    read = stored(numbered.mapInArrow(_read(tokenizer, words), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, rest array<struct<word: binary, n: long>>, ids binary"))

    known, subwords = vocabulary(counts, tokenizer)
    told = spark.sparkContext.broadcast((fit(read.where("not held_out").select("doc_id", "ids"), known, subwords), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = told.value
        scorer = attention.Scorer(attention.Weights(weights, known), known)
        for batch in slices(batches, "ids", SLICE):
            scores = scorer.score(*attention.layout(_places(batch, known), known))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _BASE), pa.array(scores, pa.float64())], names=[*_BASE, "score"])

    scored = read.select(*_BASE, "ids").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double")
    rest = read.select("row", F.explode("rest").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    rest = rest.join(counts, "word").groupBy("row").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    out = scored.join(rest, "row", "left")
    zero = F.lit(0)
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", zero)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"), "score")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


ORACLE_SQL: dict[str, str] = {}
