"""Words of Arrow string columns as NumPy arrays.

A batch's texts lie in one UTF-8 buffer. Words are found by a byte class table
and hashed there, so that no Python object is made for a word. All separators
are ASCII, hence a byte class never cuts a code point.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII white space: the separators of `[^\x20\x09-\x0D]+`.
SPACES = b" \t\n\x0b\x0c\r"
SLICE = 4 << 20

SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[list(SPACES)] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased: digits, letters and all beyond ASCII.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = True

#: A-Z as a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
#: Keeps the first 0 to 8 bytes of a little-endian 64-bit piece.
_KEEP = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    data: np.ndarray  #: bytes of all texts
    off: np.ndarray  #: where each text begins, and the end
    start: np.ndarray  #: of each word
    end: np.ndarray
    count: np.ndarray  #: words of each text

    @property
    def n_docs(self) -> int:
        return len(self.count)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.count)

    @property
    def first(self) -> np.ndarray:
        """The first word of each text, and the number of words."""
        return np.concatenate(([0], np.cumsum(self.count)))

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes, taken eight at a time."""
        size = len(self.data)
        padded = np.zeros(size + 8, np.uint8)
        padded[:size] = LOWER[self.data] if lower else self.data
        piece = np.ndarray(size, "<u8", padded, strides=(1,)) if size else np.zeros(0, np.uint64)
        length = self.end - self.start
        # the length has a product of its own: xored with the bytes, "=" with a NUL and ">" would meet
        out = mix(mix(piece[self.start] & _KEEP[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        live, at = np.flatnonzero(length > 8), 8
        while len(live):
            out[live] = mix(out[live] * np.uint64(3) ^ (piece[self.start[live] + at] & _KEEP[np.minimum(length[live] - at, 8)]))
            at += 8
            live = live[length[live] > at]
        return out

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def words(col: pa.Array, classes: np.ndarray = SPACE_WORDS) -> Words:
    data, off = buffer(col)
    if not len(data):
        return Words(data, off, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64))
    w = classes[data]
    edge = np.flatnonzero(w[1:] != w[:-1]) + 1
    if w[0]:
        edge = np.concatenate(([0], edge))
    if w[-1]:
        edge = np.concatenate((edge, [len(data)]))
    start, end = edge[::2], edge[1::2]
    inner = np.unique(off[(off > 0) & (off < len(data))])
    inner = inner[w[inner - 1] & w[inner]]  # texts that meet within what would be one word
    if len(inner):
        start, end = np.insert(start, np.searchsorted(start, inner), inner), np.insert(end, np.searchsorted(end, inner), inner)
    cut = np.searchsorted(start, off)
    return Words(data, off, start, end, np.diff(cut))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about `limit` bytes of text, one row at least."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, i = np.cumsum(size), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, "right")))
            yield b.slice(i, j - i)
            i = j


def windows(h: np.ndarray, count: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows of each text and how many each has.

    short: a text of 1 to k-1 words has one window, all its words.
    """
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    n = np.maximum(count - k + 1, 0)
    m = np.where((n == 0) & (count > 0), 1, n) if short else n
    at = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
    left = np.minimum(np.repeat(first + count, m) - at, k)
    out = np.zeros(len(at), np.uint64)
    for i in range(k):
        live = left > i
        if live.all():
            out = (out ^ h[at + i]) * np.uint64(0xFF51AFD7ED558CCD)
        else:
            out[live] = (out[live] ^ h[at[live] + i]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return mix(out), m


def runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))


def within(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    n = np.asarray(n, np.int64)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
