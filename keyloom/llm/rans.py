"""Static range asymmetric numeral system over integer symbols, interleaved and vectorised.

A block holds up to BLOCK symbols, dealt to LANES coders in turn: symbol i goes to
lane i % LANES. All lanes of a block share one stream of 32-bit words. Many blocks
are coded side by side, one NumPy step for a row of lanes of every block.

State x of a lane lies in [2^31, 2^63). Encoding runs backwards; a lane whose state
would leave that range first gives its low 32 bits to the stream. The decoder starts
from the encoder's last states, which a block keeps as its checkpoint, and takes the
words in the opposite order. Blocks depend on nothing but the frequency table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

BITS = 20
LANES = 32
BLOCK = 1 << 15
SIDE = 128  #: blocks coded at a time
_LOW = np.uint64(1 << 31)
_B, _32 = np.uint64(BITS), np.uint64(32)


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts as frequencies of sum 2^BITS; every symbol that occurs keeps one at least."""
    counts = np.asarray(counts, np.int64)
    used = np.flatnonzero(counts)
    f = np.zeros(len(counts), np.uint64)
    if not len(used):
        return f
    if len(used) > 1 << BITS:
        raise ValueError("more symbols than frequency slots")
    share = counts[used].astype(np.float64) * (1 << BITS) / float(counts[used].sum())
    part = np.maximum(1, np.floor(share)).astype(np.int64)
    order = np.lexsort((used, -counts[used]))
    spare = (1 << BITS) - int(part.sum())
    if spare > 0:
        part[order[0]] += spare
    while spare < 0:
        shrink = order[part[order] > 1][:-spare]
        part[shrink] -= 1
        spare += len(shrink)
    f[used] = part
    return f


@dataclass
class Table:
    freq: np.ndarray
    low: np.ndarray
    slots: np.ndarray | None

    @classmethod
    def of(cls, freq: np.ndarray, decode: bool = False) -> Table:
        low = np.cumsum(freq) - freq
        slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64)) if decode else None
        return cls(freq.astype(np.uint64), low.astype(np.uint64), slots)


def checksum(states: bytes, words: bytes, n: int) -> int:
    return zlib.crc32(words, zlib.crc32(states, n & 0xFFFFFFFF))


def encode(blocks: list[np.ndarray], table: Table) -> list[tuple[bytes, bytes]]:
    """(states, words) of each block of symbols."""
    out: list[tuple[bytes, bytes]] = []
    for i in range(0, len(blocks), SIDE):
        out += _encode(blocks[i : i + SIDE], table)
    return out


def _encode(blocks: list[np.ndarray], t: Table) -> list[tuple[bytes, bytes]]:
    n = len(blocks)
    steps = max((len(b) + LANES - 1) // LANES for b in blocks)
    live = np.zeros((steps, n, LANES), bool)
    sym = np.zeros((steps, n, LANES), np.uint32)
    for j, b in enumerate(blocks):
        flat = np.zeros(steps * LANES, np.uint32)
        flat[: len(b)] = b
        sym[:, j] = flat.reshape(steps, LANES)
        live[:, j] = (np.arange(steps * LANES) < len(b)).reshape(steps, LANES)
    x = np.full((n, LANES), _LOW, np.uint64)
    given = np.zeros((steps, n, LANES), bool)
    words = np.zeros((steps, n, LANES), np.uint32)
    whole = live.reshape(steps, -1).all(1)
    top = np.uint64(63 - BITS)
    for s in range(steps - 1, -1, -1):
        f, c = t.freq[sym[s]], t.low[sym[s]]
        if not whole[s]:
            f = np.where(live[s], f, np.uint64(1 << BITS))
            c = np.where(live[s], c, np.uint64(0))
        out = (x >> top) >= f
        if not whole[s]:
            out &= live[s]
        given[s] = out
        words[s] = x.astype(np.uint32)
        x = np.where(out, x >> _32, x)
        q = x // f
        y = (q << _B) + (x - q * f) + c
        x = y if whole[s] else np.where(live[s], y, x)
    given, words = given.transpose(1, 0, 2), words.transpose(1, 0, 2)
    return [(x[j].astype("<u8").tobytes(), words[j][given[j]].astype("<u4").tobytes()) for j in range(n)]


def decode(blocks: list[tuple[int, bytes, bytes]], table: Table) -> list[np.ndarray]:
    """The symbols of blocks (length, states, words); a table made for decoding."""
    out: list[np.ndarray] = []
    for i in range(0, len(blocks), SIDE):
        out += _decode(blocks[i : i + SIDE], table)
    return out


def _decode(blocks: list[tuple[int, bytes, bytes]], t: Table) -> list[np.ndarray]:
    n = len(blocks)
    steps = max((m + LANES - 1) // LANES for m, _, _ in blocks)
    x = np.stack([np.frombuffer(s, "<u8") for _, s, _ in blocks]).astype(np.uint64)
    stream = [np.frombuffer(w, "<u4") for _, _, w in blocks]
    base = np.concatenate(([0], np.cumsum([len(w) for w in stream])))[:-1]
    words = np.concatenate([*stream, np.zeros(1, np.uint32)]).astype(np.uint64)
    left = np.array([m for m, _, _ in blocks])
    sym = np.zeros((steps, n, LANES), np.uint32)
    mask = np.uint64((1 << BITS) - 1)
    lane = np.arange(LANES)
    ptr = base.astype(np.int64)
    for s in range(steps):
        slot = x & mask
        got = t.slots[slot]
        sym[s] = got
        y = t.freq[got] * (x >> _B) + slot - t.low[got]
        need = y < _LOW
        n_live = left - s * LANES
        if (n_live < LANES).any():
            live = lane < n_live[:, None]
            need &= live
            y = np.where(live, y, x)
        rank = np.cumsum(need, 1)
        at = np.minimum(ptr[:, None] + rank - 1, len(words) - 1)
        x = np.where(need, (y << _32) | words[at], y)
        ptr = ptr + rank[:, -1]
    sym = sym.transpose(1, 0, 2)
    return [sym[j].reshape(-1)[: blocks[j][0]] for j in range(n)]


def _times(m: tuple[int, ...], v: int) -> int:
    out = 0
    while v:
        low = v & -v
        out ^= m[low.bit_length() - 1]
        v ^= low
    return out


def crc_join(a: int, b: int, b_bytes: int) -> int:
    """crc32 of two byte strings in a row from each one's crc32: a is moved on by b_bytes zero bytes, a linear map over GF(2)."""
    shift = tuple([0xEDB88320] + [1 << i for i in range(31)])  # one zero bit
    n = 8 * b_bytes
    while n:
        if n & 1:
            a = _times(shift, a)
        shift = tuple(_times(shift, row) for row in shift)
        n >>= 1
    return a ^ b
