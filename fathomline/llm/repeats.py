"""Windows that occur more than once in a corpus, found through a difference cover.

A difference cover D of a period v holds, for any two positions i and j, a shift
below v that takes both onto positions whose remainder lies in D.  So two equal
windows of `length` symbols share an *aligned* pair of shorter windows of
`length - v + 1` symbols that start on cover positions.  Only those are sorted
first; where one repeats, the windows of the full length that contain it are
sorted too, and neighbours with equal keys are the repeats.

Documents are dealt into blocks of a few MB.  A block sends sorted names
(truncated hashes) to the bucket of each name's range and gets one bit per name
back, so no row per position is ever made, no group meets in one task (a block
sends each name once, however often it holds it) and the answer holds for all
occurrences.  Names of the first round are just wide enough for the corpus: a
chance agreement only adds a candidate.  The second round's keys grow with the
corpus too, so that the chance of any false agreement stays below one in 2000.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import stored
from fathomline.llm.text import mix, release, window_hashes

#: Perfect difference sets: every remainder is the difference of two members.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}

_ANSWER = "block long, kind int, bucket int, bits binary"
_NAMES = "bucket int, block long, names binary"


@dataclass(frozen=True)
class Plan:
    """What to look for, and how widely the work is dealt out."""

    length: int
    period: int
    blocks: int
    #: Symbols (or at least as many bytes) in all texts.
    symbols: int
    first_stays: bool
    #: Whether later copies of a whole text send nothing (their digests are told beforehand, as kind 0).
    skip_copies: bool
    #: texts -> (two families of uint64 symbol values, offsets of the texts, whatever `finish` needs)
    read: Callable[[list[bytes]], tuple[tuple[np.ndarray, np.ndarray], np.ndarray, object]]
    #: Undoes how the texts were packed for the shuffle.
    unpack: Callable[[bytes], bytes] = bytes

    @property
    def cover(self) -> tuple[int, ...]:
        return COVERS[self.period]

    @property
    def anchor(self) -> int:
        return self.length - self.period + 1

    @property
    def name_bytes(self) -> int:
        """Bytes of a first-round name, for about one chance agreement in 64 names."""
        return max(4, min(8, math.ceil((math.log2(self.symbols + 2) + 6) / 8)))

    @property
    def key_bytes(self) -> int:
        """Bytes of a second-round key: at most an eighth of the symbols' windows in pairs, against 2**(8 * key_bytes)."""
        return max(8, min(16, math.ceil((2 * math.log2(self.symbols + 2) + 4) / 8)))

    @property
    def buckets(self) -> int:
        return max(1, self.blocks // 4)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value, byte by byte in planes, which compress when sorted."""
    return values.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - width :].T.tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, 8 - width :] = planes.T
    return out.view(">u8").ravel().astype(np.uint64)


class Block:
    """The symbols of a block's documents, with the same names in every round."""

    def __init__(self, plan: Plan, texts: list[bytes], skip: np.ndarray):
        """skip: places of texts that send nothing."""
        self.plan = plan
        self.values, self.offsets, self.extra = plan.read(texts)
        sizes = np.diff(self.offsets)
        ends = self.offsets.astype(np.int32)
        places = np.arange(len(self.values[0]), dtype=np.int32)
        self.left = np.repeat(ends[1:], sizes) - places
        if len(skip):
            self.left[np.repeat(np.isin(np.arange(len(texts)), skip), sizes)] = 0
        places -= np.repeat(ends[:-1], sizes)
        places %= plan.period
        at = np.zeros(plan.period, dtype=bool)
        at[list(plan.cover)] = True
        self.anchors = np.flatnonzero(at[places] & (self.left >= plan.anchor))

    def anchor_names(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct names, each anchor's place among them, and each name's count here."""
        names = window_hashes(self.values[0], self.anchors, self.plan.anchor, 0) >> np.uint64(64 - 8 * self.plan.name_bytes)
        return np.unique(names, return_inverse=True, return_counts=True)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Starts of full windows that contain an aligned anchor which repeats."""
        n = len(self.left)
        reach = np.zeros(n + 1, dtype=np.int32)
        at = self.anchors[repeated]
        np.add.at(reach, np.maximum(at - self.plan.period + 1, 0), 1)
        np.add.at(reach, at + 1, -1)
        return np.flatnonzero((np.cumsum(reach[:n], dtype=np.int32) > 0) & (self.left >= self.plan.length))

    def window_names(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct keys (high, low), each window's place among them, and which windows are a key's first here."""
        high = window_hashes(self.values[0], starts, self.plan.length, 0)
        low = np.zeros(len(starts), np.uint64)
        if self.plan.key_bytes > 8:
            low = mix(window_hashes(self.values[1], starts, self.plan.length, 1)) >> np.uint64(8 * (16 - self.plan.key_bytes))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.zeros(len(order), dtype=bool)
        first[order[new]] = True
        return high[new], low[new], place, first


def _cuts(high: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Where each bucket's range of sorted names begins."""
    edges = [((b << bits) + buckets - 1) // buckets for b in range(1, buckets)]
    return np.concatenate(([0], np.searchsorted(high, np.array(edges, dtype=np.uint64)), [len(high)])).astype(np.int64)


def _answers(rows: pd.DataFrame, kind: int, same: np.ndarray) -> pd.DataFrame:
    """same: for each name of the rows' names in turn, whether it repeats."""
    ends = np.cumsum(rows["n"].to_numpy())
    return pd.DataFrame({"block": rows["block"].to_numpy(), "kind": kind, "bucket": rows["bucket"].to_numpy(), "bits": [np.packbits(same[e - n : e]).tobytes() for n, e in zip(rows["n"], ends, strict=True)]})


def _bits(told: pd.DataFrame, kind: int, cuts: np.ndarray) -> np.ndarray:
    """One flag per sorted name, from the buckets' answers."""
    out = np.zeros(cuts[-1], dtype=bool)
    told = told[told["kind"] == kind]
    for bucket, bits in zip(told["bucket"], told["bits"], strict=True):
        lo, hi = cuts[bucket], cuts[bucket + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def _copies(plan: Plan, texts: list[bytes], told: pd.DataFrame) -> np.ndarray:
    """Places of texts of which an earlier document, here or in an earlier block, is a copy."""
    if not plan.skip_copies:
        return np.empty(0, np.int64)
    seen = {bytes(x) for x in told.loc[told["kind"] == 0, "bits"]}
    out = []
    for k, text in enumerate(texts):
        digest = hashlib.md5(text, usedforsecurity=False).digest()
        if digest in seen:
            out.append(k)
        seen.add(digest)
    return np.array(out, dtype=np.int64)


def earlier_copies(docs: DataFrame) -> DataFrame:
    """Answers of kind 0: to each block, the digests of its texts that an earlier block holds too; docs: block, digest (md5)."""
    held = stored(docs.select("block", F.col("digest").alias("bits")).distinct())
    first = held.groupBy("bits").agg(F.min("block").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return held.join(first, "bits").where("block > first").select((F.col("block") + 0).alias("block"), F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "bits")


def whole_ids() -> list[Column]:
    """known (0 where doc_id is null) and doc_id without nulls: pandas keeps such a column in whole numbers."""
    doc_id = F.col("doc_id").cast("long")
    return [doc_id.isNotNull().cast("int").alias("known"), F.coalesce(doc_id, F.lit(0)).alias("doc_id")]


def with_nulls(rows: DataFrame) -> DataFrame:
    """Undoes whole_ids."""
    return rows.withColumn("doc_id", F.when(F.col("known") == 1, F.col("doc_id"))).drop("known")


def _ordered(docs: pd.DataFrame) -> pd.DataFrame:
    """A block's documents by id (null first), then text; the same in every round, whatever order the shuffle gave."""
    return docs.sort_values(["known", "doc_id", "text"], kind="stable", ignore_index=True) if len(docs) else docs


def find(docs: DataFrame, plan: Plan, finish: Callable, schema: str) -> DataFrame:
    """Runs both rounds over `docs` (block, known, doc_id, text as binary; for skip_copies also digest).

    `finish(docs, block, starts, flags, copies)` gets a block's documents, the
    candidate windows' starts, which of them repeat (all but the first
    occurrence if `first_stays`) and the places of skipped copies, and returns
    rows of `schema`, known and doc_id among them.
    """
    dealt = docs.groupBy("block")

    def opened(d: pd.DataFrame) -> pd.DataFrame:
        return _ordered(d.assign(text=[b"" if x is None else plan.unpack(bytes(x)) for x in d["text"]]))

    def open_block(d: pd.DataFrame, told: pd.DataFrame) -> tuple[Block, np.ndarray]:
        held = list(d["text"])
        copies = _copies(plan, held, told)
        return Block(plan, held, copies), copies

    def send_anchors(d: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        d = opened(d)
        if not len(d):
            return pd.DataFrame({"bucket": [], "block": [], "names": []})
        b, _ = open_block(d, told)
        names, _, _ = b.anchor_names()
        cuts = _cuts(names, plan.buckets, 8 * plan.name_bytes)
        rows = [(k, int(d["block"].iloc[0]), pack(names[lo:hi], plan.name_bytes)) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        return pd.DataFrame(rows, columns=["bucket", "block", "names"])

    def meet_anchors(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [unpack(x, plan.name_bytes) for x in rows["names"]]
        rows = rows.assign(n=[len(x) for x in lists])
        _, place, counts = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        return _answers(rows, 1, (counts > 1)[place])

    def again(d: pd.DataFrame, told: pd.DataFrame) -> tuple[Block, np.ndarray, np.ndarray]:
        b, copies = open_block(d, told)
        names, place, counts = b.anchor_names()
        elsewhere = _bits(told, 1, _cuts(names, plan.buckets, 8 * plan.name_bytes))
        return b, b.candidates(((counts > 1) | elsewhere)[place]), copies

    def send_windows(d: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        d = opened(d)
        if not len(d):
            return pd.DataFrame({"bucket": [], "block": [], "names": []})
        b, starts, _ = again(d, told)
        high, low, _, _ = b.window_names(starts)
        cuts = _cuts(high, plan.buckets, 64)
        rows = [(k, int(d["block"].iloc[0]), pack(high[lo:hi], 8) + pack(low[lo:hi], plan.key_bytes - 8)) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if lo < hi]
        return pd.DataFrame(rows, columns=["bucket", "block", "names"])

    def meet_windows(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable", ignore_index=True)
        rows = rows.assign(n=[len(x) // plan.key_bytes for x in rows["names"]])
        high = np.concatenate([unpack(bytes(x)[: 8 * n], 8) for x, n in zip(rows["names"], rows["n"], strict=True)])
        low = np.concatenate([unpack(bytes(x)[8 * n :], plan.key_bytes - 8) if plan.key_bytes > 8 else np.zeros(n, np.uint64) for x, n in zip(rows["names"], rows["n"], strict=True)])
        order = np.lexsort((low, high))  # stable, so equal keys stay in the order of their blocks
        high, low = high[order], low[order]
        equal = np.zeros(len(order) + 1, dtype=bool)  # to the one before
        equal[1:-1] = (high[1:] == high[:-1]) & (low[1:] == low[:-1])
        flags = np.empty(len(order), dtype=bool)
        flags[order] = equal[:-1] if plan.first_stays else equal[:-1] | equal[1:]
        return _answers(rows, 2, flags)

    def end(d: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        d = opened(d)
        if not len(d):
            return finish(d, None, np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))
        b, starts, copies = again(d, told)
        high, _, place, first = b.window_names(starts)
        flags = _bits(told, 2, _cuts(high, plan.buckets, 64))[place]
        if plan.first_stays:
            flags |= ~first
        else:
            flags |= (np.bincount(place, minlength=len(high)) > 1)[place]
        return finish(d, b, starts, flags, copies)

    spark = docs.sparkSession
    told0 = earlier_copies(docs) if plan.skip_copies else spark.createDataFrame([], _ANSWER)
    names = dealt.cogroup(told0.groupBy("block")).applyInPandas(_frees(send_anchors), _NAMES)
    told1 = names.groupBy("bucket").applyInPandas(meet_anchors, _ANSWER)
    told = told0.unionByName(told1)
    windows = dealt.cogroup(told.groupBy("block")).applyInPandas(_frees(send_windows), _NAMES)
    told = told.unionByName(windows.groupBy("bucket").applyInPandas(meet_windows, _ANSWER))
    return dealt.cogroup(told.groupBy("block")).applyInPandas(_frees(end), schema)


def _frees(f: Callable) -> Callable:
    """`f`, which leaves a worker no memory but its result's: workers that wait would hold it beside the JVM."""

    def run(d: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        release()
        try:
            return f(d, told)
        finally:
            release()

    return run


def covered(n: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of n places lie in [start, start + length) of any start."""
    depth = np.zeros(n + 1, dtype=np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, starts + length, -1)
    return np.cumsum(depth[:n], dtype=np.int32) > 0


def volume(docs: DataFrame) -> tuple[int, int]:
    """Rows and bytes of text of all documents."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)
