"""Ids of whole texts by a byte-level vocabulary, chunk by chunk, in numpy.

Such a vocabulary's pattern never lets a piece run from a character other than
white space into white space, so a text may be cut before each white space that
follows something else: its ids are its chunks' ids in turn.  A batch's distinct
chunks get their ids once, and those of the last batches are remembered.  Chunks
of a space or none, Latin letters, and marks behind them or none go through the
merges of the tokenizer's file all at once; every other chunk goes to the
tokenizer itself, also where no cut is certain.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa

from fathomline.llm.text import SPACE, column_bytes
from fathomline.llm.wordpieces import _LETTER, _LONGEST, _MARKS, _bytes_of, _distinct, _Merges, gather

#: Distinct chunks that a worker remembers, with their ids some 50 MB.
REMEMBERED = 1 << 18
_GRAPHIC = (np.arange(256) > 32) & (np.arange(256) < 127)


def split_chunks(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct chunks (binary) of a string column, each chunk's place among them, and each text's first chunk; the chunks of a text tile it."""
    data, offsets = column_bytes(column)
    if not len(data):
        return pa.array([], pa.large_binary()), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = _GRAPHIC[data]  # the last byte of a character that is surely no white space
    follow = (data & 0xC0) == 0x80
    solid[1:] |= follow[1:] & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
    solid[2:] |= follow[2:] & follow[1:-1] & (data[:-2] >= 0xE4) & (data[:-2] < 0xF0)
    start = np.zeros(len(data) + 1, dtype=bool)
    start[1:-1] = SPACE[data[1:]] & solid[:-1]
    start[offsets] = True
    edges = np.flatnonzero(start[:-1])
    bounds = np.append(edges, len(data)).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), len(edges), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])
    coded = chunks.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), np.searchsorted(edges, offsets)


class BytePieces:
    """Ids of texts by a tokenizer's file."""

    PROBES = ("The", " the,", " Éénant", " straße.", "MINE!", " x;", " öüß'", " antidisestablish)", " qzxj?", " the***", "é&&&", " a", "Wort--", "zÿ.", " ÀÖØÞ<|", " I")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocabulary = self.model.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.held: tuple[dict[bytes, int], np.ndarray, np.ndarray] = ({}, np.empty(0, np.uint32), np.zeros(1, np.int64))
        self.merges = _Merges(model | {"end_of_word_suffix": model.get("end_of_word_suffix") or ""})
        ids, offsets = self.of_chunks(pa.array([p.encode() for p in self.PROBES], pa.large_binary()))
        if any(ids[a:b].tolist() != self._general([w])[0] for w, a, b in zip(self.PROBES, offsets, offsets[1:], strict=False)):
            raise ValueError(f"{path} is not a byte-level vocabulary")

    def _general(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(chunks, add_special_tokens=False)]

    def of_chunks(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks and their offsets.

        The chunks of the last batches are remembered, up to REMEMBERED of at most
        _LONGEST bytes, so that a worker's memory stays bounded.  A batch that
        would turn over half of them goes past: looking its chunks up would cost
        more than the few that are known save.
        """
        if 2 * len(chunks) > REMEMBERED:
            return self._of_new(chunks)
        known, ids, offsets = self.held
        names = chunks.to_pylist()
        at = np.fromiter(map(known.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        more, ends = self._of_new(chunks.take(pa.array(new)))
        every, bounds = np.concatenate((ids, more)), np.concatenate((offsets, offsets[-1] + ends[1:]))
        at[new] = len(known) + np.arange(len(new))
        short = [k for k, n in enumerate(new.tolist()) if len(names[n]) <= _LONGEST]
        if len(known) + len(short) > REMEMBERED:
            known, ids, offsets = {}, ids[:0], offsets[:1]
        kept, begins = gather(more, ends, np.array(short, dtype=np.int64))
        known.update(zip((names[n] for n in new[short].tolist()), range(len(known), len(known) + len(short)), strict=True))
        self.held = (known, np.concatenate((ids, kept)), np.concatenate((offsets, offsets[-1] + begins[1:])))
        return gather(every, bounds, at)

    def _of_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = column_bytes(chunks)
        n = len(chunks)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        starts, ends = offsets[:-1], offsets[1:]
        last = np.where(_MARKS[data], -1, np.arange(len(data)))  # marks at the end: after the last byte that is no mark
        cut = np.maximum(np.maximum.reduceat(last, starts) + 1, starts)
        follow = np.append(data[1:], 0)
        lead = (data == 0xC3) & (follow != 0x97) & (follow != 0xB7)  # U+00C0 to U+00FF without the signs for times and division
        tail = np.append(False, lead[:-1])
        other = np.concatenate(([0], np.cumsum(~(_LETTER[data] | lead | tail), dtype=np.int64)))
        begin = starts + (data[starts] == 0x20)
        plain = (cut > begin) & (other[cut] == other[np.minimum(begin, cut)]) & (cut - starts <= _LONGEST) & (ends - cut <= _LONGEST)
        at = np.flatnonzero(plain)
        marks = at[cut[at] < ends[at]]
        made = []  # (chunks, ids, offsets, places), in the order within a chunk
        for rows, a, b in ((at, starts[at], cut[at]), (marks, cut[marks], ends[marks])):
            if len(rows):
                parts, codes, _ = _distinct(data, a, b)
                made.append((rows, *self.merges.of(*_bytes_of(parts)), codes))
        rest = np.flatnonzero(~plain)
        whole, general = data.tobytes(), []
        for lo in range(0, len(rest), 4096):
            general += self._general([whole[starts[k] : ends[k]].decode("utf-8", "replace") for k in rest[lo : lo + 4096].tolist()])
        counts = np.zeros(n, dtype=np.int64)
        for rows, _, parts, codes in made:
            counts[rows] += np.diff(parts)[codes]
        counts[rest] = [len(x) for x in general]
        out_at = np.concatenate(([0], np.cumsum(counts)))
        out, used = np.empty(out_at[-1], dtype=np.uint32), out_at[:-1].copy()
        for rows, ids, parts, codes in made:
            got, begins = gather(ids, parts, codes)
            sizes = np.diff(begins)
            out[np.repeat(used[rows] - begins[:-1], sizes) + np.arange(len(got))] = got
            used[rows] += sizes
        for k, ids in zip(rest.tolist(), general, strict=True):
            out[out_at[k] : out_at[k + 1]] = ids
        return out, out_at

    def of_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a string column, one after the other, and their offsets; null counts as empty."""
        chunks, codes, first = split_chunks(column)
        ids, begins = gather(*self.of_chunks(chunks), codes)
        return ids, begins[first]

    def counts(self, column: pa.Array) -> np.ndarray:
        """How often each id occurs in the texts; the chunks' ids are weighted, never written out."""
        chunks, codes, _ = split_chunks(column)
        ids, offsets = self.of_chunks(chunks)
        times = np.bincount(codes, minlength=len(chunks)) if len(chunks) else np.empty(0, np.int64)
        # sums of whole numbers below 2**53 are exact in doubles
        return np.bincount(ids, weights=np.repeat(times, np.diff(offsets)), minlength=self.vocabulary).astype(np.int64)


@lru_cache(maxsize=1)
def byte_pieces(path: str) -> BytePieces:
    return BytePieces(path)
