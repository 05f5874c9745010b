"""A bitmap of fixed size that tells which rows of a large table may have a partner in another one.

Rows that it turns away have none and need no shuffle; those that it lets through are joined exactly. Its size doesn't
grow with the data: a fuller one lets more through, and a full one everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 4 MB.
BITS = 1 << 25
_CODEC = pa.Codec("zstd", 1)


def _row(bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([_CODEC.compress(bits.tobytes(), asbytes=True)], pa.binary())], ["bits"])


def _bytes(packed: bytes | pa.Buffer) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(packed, BITS // 8), np.uint8)


def _either(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = np.zeros(BITS // 8, np.uint8)
    for b in batches:
        for x in b.column("bits"):
            out |= _bytes(x.as_buffer())
    yield _row(out)


def bitmap(hashes: DataFrame) -> bytes:
    """Of a table with one BIGINT column of hashes; merged on executors, so that one bitmap comes to the driver, compressed."""
    name = hashes.columns[0]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BITS, bool)
        for b in batches:
            seen[b.column(name).to_numpy() & (BITS - 1)] = True
        yield _row(np.packbits(seen, bitorder="little"))

    # a shuffle between the steps: no task keeps more than one Python worker busy
    some = hashes.mapInArrow(mark, "bits BINARY").repartition(8).mapInArrow(_either, "bits BINARY")
    got = some.repartition(1).mapInArrow(_either, "bits BINARY").head()
    return bytes(got[0]) if got else _CODEC.compress(bytes(BITS // 8), asbytes=True)


_open: dict[int, tuple[bytes, np.ndarray]] = {}


def held(hashes: np.ndarray, bits: bytes) -> np.ndarray:
    """Which hashes the bitmap has. The last bitmaps that a worker met stay unpacked."""
    if _open.get(hash(bits), (None,))[0] != bits:
        if len(_open) > 1:
            _open.clear()
        _open[hash(bits)] = bits, _bytes(bits)
    at = hashes & (BITS - 1)
    return (_open[hash(bits)][1][at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def passes(hashed: Column, bits: bytes) -> Column:
    """Whether the bitmap has a row's hash."""

    @F.arrow_udf("boolean")
    def has(h: pa.Array) -> pa.Array:
        return pa.array(held(h.to_numpy(zero_copy_only=False), bits))

    return has(hashed)
