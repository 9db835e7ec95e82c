"""Whole Arrow batches of text as flat numpy arrays: slices, words and hashes.

A slice holds the UTF-8 bytes of some rows end to end, so one numpy call works on all their
words. Null texts have no bytes and are told apart by `valid`. Slices are cut by bytes, not by
rows, which bounds a task's memory whatever the batch size; one longer text is a slice of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

LONG = 512  # bytes from which a span is hashed by BLAKE2 instead of block by block
_SEED = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))


@dataclass
class Slice:
    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray
    valid: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, a: int, b: int) -> str:
        return self.data[a:b].tobytes().decode("utf-8", "replace")


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, row offsets and validity of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    valid = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets, valid


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The rows of a string column in runs of about `limit` bytes, at least one row each."""
    data, offsets, valid = flat(column)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Slice(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], valid[lo:hi])
        lo = hi


def runs(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, which no row boundary crosses, and the
    index of each row's first run (one more at the end)."""
    n = len(member)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    begin, end = member.copy(), member.copy()
    begin[1:] &= ~member[:-1]
    end[:-1] &= ~member[1:]
    at = offsets[offsets < n]
    begin[at] |= member[at]
    at = offsets[offsets > 0] - 1
    end[at] |= member[at]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: bool = False) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes wherever they stand. Each eight bytes go
    through a bijection of their own and another of the state, so no sum of bytes can cancel out.
    `other` is a second hash, whose collisions have nothing to do with those of the first."""
    seed, odd = _SEED[other], _ODD[other]
    size = ends - starts
    h = mix(size.astype(np.uint64) * odd + seed)
    blocks = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    todo = np.flatnonzero((size > 0) & (size <= LONG))
    at, left = starts[todo], size[todo]
    while len(todo):
        block = blocks[at]
        short = left < 8
        block[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[todo] = mix((h[todo] ^ mix(block + seed)) * odd)
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, person=b"other" if other else b"one").digest(), "little")
    return h


def word_hashes(data: np.ndarray, offsets: np.ndarray, other: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each white-space separated word and the index of each row's first word."""
    starts, ends, first = runs(~SPACE[data], offsets)
    return span_hash(data, starts, ends, other), first


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a) * _ODD[0] + b)


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of each `size` consecutive words, row boundaries left to the caller. Windows of two, four
    ... words are hashed from halves, and those of `size` from the powers of two in it."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, wide, width = np.full(n, _SEED[0] + np.uint64(size)), 0, h, 1
    while done < size:
        if size & width:
            out = _pair(out, wide[done : done + n])
            done += width
        if done < size:
            wide = _pair(wide[:-width], wide[width:])
        width *= 2
    return out


class Directory:
    """Finds 64-bit keys whose bits are well mixed: sorted, with the places of their top bits."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.order = np.argsort(keys)
        self.keys, self.shift = keys[self.order], np.uint64(64 - bits)
        self.begin = np.searchsorted(self.keys >> self.shift, np.arange(1 << bits, dtype=np.uint64)).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The index of each key among those given at first, -1 where it isn't."""
        if not len(self.keys):
            return np.full(len(h), -1)
        at = np.minimum(self.begin[(h >> self.shift).astype(np.int64)], len(self.keys) - 1)
        got = self.keys[at]
        out = np.where(got == h, self.order[at], -1)
        todo = np.flatnonzero(got < h)  # later entries of the same cell
        at = at[todo] + 1
        while len(todo):
            inside = at < len(self.keys)
            todo, at = todo[inside], at[inside]
            got = self.keys[at]
            hit = got == h[todo]
            out[todo[hit]] = self.order[at[hit]]
            more = got < h[todo]
            todo, at = todo[more], at[more] + 1
        return out


def gather(pool_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes start, start+1, ... of each span, end to end."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(pool_starts - (ends - lengths), lengths)


def row_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each row; `first` has each row's first index and the end."""
    sums = np.zeros(len(values) + 1, values.dtype if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n
