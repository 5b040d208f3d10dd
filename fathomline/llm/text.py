"""Word splitting and rolling hashes over batches of UTF-8 texts, in numpy.

Texts are handled as one byte array with offsets, so that no step loops over
words in Python.  Hashes are polynomials modulo 2**64 over random symbol
values; any window's hash comes from prefix sums in constant time.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_M64 = (1 << 64) - 1


def _spaces() -> np.ndarray:
    flags = np.zeros(256, dtype=bool)
    flags[[0x20, *range(0x09, 0x0E)]] = True
    return flags


SPACE = _spaces()


@lru_cache(maxsize=4)
def symbol_values(family: int) -> np.ndarray:
    """Random 64-bit values of the 256 bytes; the same in every process."""
    return np.random.default_rng(7919 + family).integers(1, 1 << 64, 256, dtype=np.uint64)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _M64, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    size = 1 << max(16, (max(n, 1) - 1).bit_length())
    return _powers(base, size)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (the finaliser of MurmurHash3)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int) -> np.ndarray:
    """Hashes of values[starts:ends] (each of any length), values being uint64."""
    base = BASES[family]
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(base, len(values)), out=sums[1:])
        out = sums[ends]
        out -= sums[starts]
        out *= powers(inverse, len(values) + 1)[starts]
        # the length keeps runs of different lengths apart
        out += (ends - starts).astype(np.uint64)
    return mix(out)


def window_hashes(values: np.ndarray, starts: np.ndarray, length: int, family: int, chunk: int = 1 << 19) -> np.ndarray:
    """Hashes of the windows of a length that begin at starts (ascending), in bounded memory.

    values are uint64 symbols, or bytes, which stand for their random values.
    """
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(values) + chunk, chunk))
    for k in range(len(cuts) - 1):
        lo, hi = cuts[k], cuts[k + 1]
        if lo < hi:
            at = k * chunk
            part = starts[lo:hi] - at
            symbols = values[at : at + chunk + length]
            out[lo:hi] = range_hashes(symbol_values(family)[symbols] if symbols.dtype == np.uint8 else symbols, part, part + length, family)
    return out


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes and int64 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def release() -> None:
    """Gives memory that a task no longer needs back to the system; workers that are used again would hold it beside the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(texts), np.uint8)
    return data, np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and each text's first word."""
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    edge = np.empty(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = space[: n - 1]
    edge[offsets] = True
    starts = np.flatnonzero(~space & edge[:n])
    edge[1:n] = space[1:]
    edge[offsets] = True
    ends = np.flatnonzero(~space & edge[1:]) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0, chunk: int = 1 << 19) -> np.ndarray:
    """Hashes of the ranges, which ascend and don't overlap, in bounded memory (or the longest range's)."""
    out, table = np.empty(len(starts), dtype=np.uint64), symbol_values(family)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + chunk, chunk))
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if lo < hi:
            at, end = starts[lo], ends[hi - 1]
            out[lo:hi] = range_hashes(table[data[at:end]], starts[lo:hi] - at, ends[lo:hi] - at, family)
    return out


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again in pieces of about `most` bytes of text; a longer text stands alone."""
    release()  # what the task before has left
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = (np.cumsum(sizes) - sizes) // most
        edges = np.flatnonzero(np.diff(group)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
            yield batch.slice(lo, hi - lo)
    release()
