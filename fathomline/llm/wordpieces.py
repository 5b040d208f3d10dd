"""Ids of whole texts, word by word, in numpy.

White space separates tokens in this kind of vocabulary, so a text's ids are its
words' ids in turn.  A batch's distinct words are numbered by Arrow and get their
ids once; a text is then a gather.  Words of Latin letters, with marks behind them
or none, go through the merges of the tokenizer's file all at once, grouped by
length; every other word goes to the tokenizer itself.  Nothing is remembered
between batches, so a task's memory does not depend on the words seen before.
"""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fathomline.llm.text import column_bytes

_MARKS = np.isin(np.arange(256), list(b"!\"#$%&()*+,-./:;=?@[\\]^_`{|}~"))
_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_LONGEST = 64  # bytes of a part that goes through the merges
_NEVER = np.int32(2**31 - 1)


def split_words(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words ``[^\\x20\\x09-\\x0D]+`` of a string column, each word's place among them, and each text's first word."""
    lists = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.concatenate(([0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)))
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)))
    coded = words.filter(full).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), before[ends]


def gather(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[offsets[c]:offsets[c + 1]] for every code c in turn, and where each begins (with the end)."""
    sizes = np.diff(offsets)[codes]
    begins = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    kind = np.int32 if max(begins[-1], offsets[-1]) < 1 << 31 else np.int64
    at = np.repeat((offsets[:-1][codes] - begins[:-1]).astype(kind), sizes)
    at += np.arange(begins[-1], dtype=kind)
    return values[at], begins


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b if b in shown else next(hidden)) for b in range(256)]


class _Merges:
    """The file's merges as a table of pairs of ids."""

    def __init__(self, model: dict):
        vocabulary, letters, end = model["vocab"], _byte_letters(), model["end_of_word_suffix"]
        self.inner = np.array([vocabulary[c] for c in letters], dtype=np.int32)
        self.last = np.array([vocabulary[c + end] for c in letters], dtype=np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.size = len(vocabulary)
        self.keys = np.array([vocabulary[a] * self.size + vocabulary[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([vocabulary[a + b] for a, b in pairs], dtype=np.int32)
        self.slots, left = [], np.arange(len(pairs), dtype=np.int32)
        for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB):
            slot = np.full(1 << 19, -1, dtype=np.int32)
            at = self._at(self.keys[left], odd)
            slot[at] = left  # of those that share a slot, one stays
            self.slots.append((odd, slot))
            left = left[slot[at] != left]
        if len(left):
            raise ValueError(f"{len(left)} merges found no slot")

    @staticmethod
    def _at(keys: np.ndarray, odd: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(odd)) >> np.uint64(45)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of the merge of each pair, or _NEVER."""
        keys = a.astype(np.int64) * self.size + b
        odd, slot = self.slots[0]
        out = slot[self._at(keys, odd)]
        wrong = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        out = np.where(out < 0, _NEVER, out)
        for odd, slot in self.slots[1:]:
            if not len(wrong):
                break
            found = slot[self._at(keys[wrong], odd)]
            out[wrong] = np.where((found >= 0) & (self.keys[found] == keys[wrong]), found, _NEVER)
            wrong = wrong[(found >= 0) & (out[wrong] == _NEVER)]
        return out

    def _same_length(self, ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Words of one length, a row of ids each: (rows, ids) once no pair of theirs merges; always the least pair, leftmost first."""
        out, rows = [], np.arange(len(ids))
        ranks = self.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while ids.shape[1] > 1:
            place = ranks.argmin(axis=1)
            least = ranks[np.arange(len(ids)), place]
            going = least != _NEVER
            if not going.all():
                out.append((rows[~going], ids[~going]))
                if not going.any():
                    return out
                rows, ids, ranks, place, least = rows[going], ids[going], ranks[going], place[going], least[going]
            n, every = ids.shape[1], np.arange(len(ids))
            ids[every, place] = self.made[least]
            ids = ids[np.arange(n) != place[:, None] + 1].reshape(len(ids), n - 1)
            ranks = ranks[np.arange(n - 1) != place[:, None]].reshape(len(ids), n - 2)
            for shift in (-1, 0):  # the pairs left and right of the new id
                at = np.flatnonzero((place + shift >= 0) & (place + shift < n - 2))
                k = place[at] + shift
                ranks[at, k] = self.ranks(ids[at, k], ids[at, k + 1])
        out.append((rows, ids))
        return out

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their offsets of the parts data[starts:ends], none empty, none over _LONGEST bytes."""
        sizes = ends - starts
        counts, made = np.zeros(len(sizes), dtype=np.int64), []
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            raw = data[starts[at, None] + np.arange(n)]
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            for rows, done in self._same_length(ids):
                counts[at[rows]] = done.shape[1]
                made.append((at[rows], done))
        offsets = np.concatenate(([0], np.cumsum(counts)))
        out = np.empty(offsets[-1], dtype=np.uint32)
        for rows, done in made:
            out[offsets[rows, None] + np.arange(done.shape[1])] = done
        return out, offsets


class WordPieces:
    """Ids of words and texts by a tokenizer's file."""

    PROBES = ("The", "the,", "Éénant", "straße.", "MINE!", "x;", "öüß", "antidisestablish)", "qzxj?", "the***", "é&&&", "ª", "|", "ÀÖØÞ", "a", "Wort--", "zÿ.")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.vocabulary = self.model.get_vocab_size()
        with open(path, encoding="utf-8") as file:
            self.merges = _Merges(json.load(file)["model"])
        probes = pa.array(self.PROBES)
        ids, offsets = self.of_words(probes)
        if any(ids[a:b].tolist() != self._general([w])[0] for w, a, b in zip(self.PROBES, offsets, offsets[1:], strict=False)):
            raise ValueError(f"{path} is not a vocabulary of lower-cased words with ends")

    def _general(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(words, add_special_tokens=False)]

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words and their offsets."""
        data, offsets = column_bytes(words)
        n = len(words)
        if not n:
            return np.empty(0, np.uint32), np.zeros(1, np.int64)
        starts, ends = offsets[:-1], offsets[1:]
        # marks at the end: after the last byte that is no mark
        last = np.where(_MARKS[data], -1, np.arange(len(data)))
        cut = np.maximum(np.maximum.reduceat(last, starts) + 1, starts)
        # letters: ASCII, or a byte pair of U+00C0 to U+00FF without the signs for times and division, or of the three letters below it
        follow = np.append(data[1:], 0)
        lead = ((data == 0xC3) & (follow != 0x97) & (follow != 0xB7)) | ((data == 0xC2) & np.isin(follow, (0xAA, 0xB5, 0xBA)))
        tail = np.append(False, lead[:-1])
        other = np.concatenate(([0], np.cumsum(~(_LETTER[data] | lead | tail), dtype=np.int64)))
        plain = (other[cut] == other[starts]) & (cut - starts <= _LONGEST) & (ends - cut <= _LONGEST)
        low = data + np.where((data >= 65) & (data <= 90), 32, 0).astype(np.uint8)
        low[tail & (np.append(0, data[:-1]) == 0xC3) & (data < 0x9F)] += 0x20
        at = np.flatnonzero(plain)
        head, marks = at[cut[at] > starts[at]], at[cut[at] < ends[at]]
        made = []  # (words, order within the word, ids, offsets)
        for rows, a, b in ((head, starts[head], cut[head]), (marks, cut[marks], ends[marks])):
            parts, codes, _ = _distinct(low, a, b)
            if len(rows):
                made.append((rows, *self.merges.of(*_bytes_of(parts)), codes))
        rest = np.flatnonzero(~plain)
        whole = data.tobytes()
        general = []
        for lo in range(0, len(rest), 4096):
            general += self._general([whole[starts[k] : ends[k]].decode("utf-8", "replace") for k in rest[lo : lo + 4096]])
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
        for k, ids in zip(rest, general, strict=True):
            out[out_at[k] : out_at[k + 1]] = ids
        return out, out_at

    def of_texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a string column, one after the other, and their offsets; null counts as empty."""
        words, codes, first = split_words(column)
        ids, begins = gather(*self.of_words(words), codes)
        return ids, begins[first]


def _bytes_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = column_bytes(parts)
    return data, offsets[:-1], offsets[1:]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray, int]:
    """The distinct ranges of bytes, each range's place among them, and how many there are."""
    sizes = ends - starts
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    at = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data[at]))])
    coded = packed.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(), len(coded.dictionary)


@lru_cache(maxsize=1)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)
