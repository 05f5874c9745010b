"""Integer bit expressions that stay inside whole-stage codegen.

All of them work on BIGINT columns: ANSI mode throws on INT overflow, so the
32-bit wrap is written out rather than left to a narrowing cast.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 1 << 32
MASK32 = TWO32 - 1

# Fixed values of the 32-bit Murmur3 finalizer.
MURMUR_MUL_1 = 2246822507
MURMUR_MUL_2 = 3266489909
MURMUR_BUCKET_MASK = (1 << 20) - 1


def wrap32(x: Column) -> Column:
    """x reduced to a signed 32-bit integer with wrap-around."""
    half = F.lit(1 << 31).cast("bigint")
    return (F.pmod(x.cast("bigint") + half, F.lit(TWO32)) - half).cast("int")


def digit(key: Column, first_bit: int, bits: int) -> Column:
    """The radix digit of `bits` bits that begins at first_bit; defined for negative keys too."""
    return F.shiftright(key, first_bit).bitwiseAND(F.lit((1 << bits) - 1))


def popcount32(x: Column) -> Column:
    """Set bits among the low 32; bit_count alone counts 64 for negative values."""
    return F.bit_count(x.cast("bigint").bitwiseAND(F.lit(MASK32))).cast("bigint")


def ctz32(x: Column) -> Column:
    """Trailing zero bits; 32 for 0."""
    v = x.cast("bigint")
    return F.when(v == 0, F.lit(32)).otherwise(F.bit_count(v.bitwiseAND(-v) - 1)).cast("bigint")


def _smear(v: Column) -> Column:
    for s in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftrightunsigned(v, s))
    return v


def next_pow2(x: Column) -> Column:
    """Smallest power of two that is at least x; 1 for x below 1."""
    v = x.cast("bigint")
    return F.when(v <= 1, F.lit(1).cast("bigint")).otherwise(_smear(v - 1) + 1)


def lower_pow2(x: Column) -> Column:
    """Largest power of two strictly below x if x is one itself, at most x otherwise; 0 for x below 2."""
    v = x.cast("bigint")
    return F.when(v <= 1, F.lit(0).cast("bigint")).otherwise(F.shiftrightunsigned(_smear(v - 1) + 1, 1))


def mul32(x: Column, c: int) -> Column:
    """x * c mod 2^32 for x in [0, 2^32): two 16-bit halves, as the whole product overflows BIGINT."""
    c_ = F.lit(c).cast("bigint")
    low = x.bitwiseAND(F.lit(65535)) * c_
    high = (F.shiftright(x, 16) * c_).bitwiseAND(F.lit(65535)) * F.lit(65536)
    return (low + high).bitwiseAND(F.lit(MASK32))


def murmur_finalizer(x: Column, mask: int = MURMUR_BUCKET_MASK) -> Column:
    h = x.cast("bigint").bitwiseAND(F.lit(MASK32))
    h = mul32(h.bitwiseXOR(F.shiftright(h, 16)), MURMUR_MUL_1)
    h = mul32(h.bitwiseXOR(F.shiftright(h, 13)), MURMUR_MUL_2)
    return h.bitwiseXOR(F.shiftright(h, 16)).bitwiseAND(F.lit(mask))


def murmur32(x: Column) -> Column:
    """All 32 bits of the finalizer: a bijection of the low 32 bits of x."""
    return murmur_finalizer(x, MASK32)
