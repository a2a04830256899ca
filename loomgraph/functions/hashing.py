"""Integer hash functions and bit helpers as column expressions; 64-bit wrap-around ones as Arrow-batched functions."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

_MASK = 0xFFFFFFFF
#: Fixed values. hash32, one step a row: constant, how it is combined, how and by how much the shifted value is.
HASH32_STEPS = [
    (0x7ED55D16, "+", "+", "<<", 12),
    (0xC761C23C, "^", "^", ">>", 19),
    (0x165667B1, "+", "+", "<<", 5),
    (0xD3A2646C, "+", "^", "<<", 9),
    (0xFD7046C5, "+", "+", "<<", 3),
    (0xB55A4F09, "^", "^", ">>", 16),
]
#: Fixed values of the two other 32-bit hashes.
HASH32_2_ADD, HASH32_2_OR = 0x6D2B79F5, (1, 61)
HASH32_3_ADD, HASH32_3_MULTIPLY = 0x9E3779B9, (0x85EBCA6B, 0xC2B2AE3D)
#: Fixed values of the 64-bit hashes.
HASH64_LINEAR, HASH64_MULTIPLY = (3935559000370003845, 2691343689449507681), 4768777513237032717
#: Right, left, right before the product; left, right, left after it.
HASH64_SHIFTS = (21, 37, 4, 20, 41, 5)
HASH64_2_ROUNDS = [(30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)]
MIX64_MULTIPLY = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Fixed value: how far the seeds of a generator's children lie apart.
GENERATOR_STRIDE = 0x7FFFFFFF


def _cut(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_MASK))


def _both(kind: str, x: Column, y: Column) -> Column:
    return _cut(x + y) if kind == "+" else x.bitwiseXOR(y)


def hash32(x: Column) -> Column:
    """32-bit hash of a LONG column of unsigned 32-bit values."""
    a = _cut(x.cast("long"))
    for constant, first, second, direction, by in HASH32_STEPS:
        moved = _cut(F.shiftleft(a, by)) if direction == "<<" else F.shiftright(a, by)
        a = _both(second, _both(first, a, F.lit(constant)), moved)
    return a


def _times(x: Column, y: Column) -> Column:
    """Product modulo 2**32 without leaving LONG: halves of 16 bits."""
    high, low = F.shiftright(x, 16), x.bitwiseAND(F.lit(0xFFFF))
    return _cut(F.shiftleft((high * y).bitwiseAND(F.lit(0xFFFF)), 16) + low * y)


def hash32_2(x: Column) -> Column:
    z = _cut(x.cast("long") + F.lit(HASH32_2_ADD))
    z = _times(z.bitwiseXOR(F.shiftright(z, 15)), z.bitwiseOR(F.lit(HASH32_2_OR[0])))
    z = z.bitwiseXOR(_cut(z + _times(z.bitwiseXOR(F.shiftright(z, 7)), z.bitwiseOR(F.lit(HASH32_2_OR[1])))))
    return z.bitwiseXOR(F.shiftright(z, 14))


def hash32_3(x: Column) -> Column:
    z = _cut(x.cast("long") + F.lit(HASH32_3_ADD))
    for shift, factor in zip((15, 13), HASH32_3_MULTIPLY):
        z = _times(z.bitwiseXOR(F.shiftright(z, shift)), F.lit(factor))
    return z.bitwiseXOR(F.shiftright(z, 16))


def np_hash64(u: np.ndarray) -> np.ndarray:
    u = np.asarray(u).astype(np.uint64)
    v = u * np.uint64(HASH64_LINEAR[0]) + np.uint64(HASH64_LINEAR[1])
    v ^= v >> np.uint64(HASH64_SHIFTS[0])
    v ^= v << np.uint64(HASH64_SHIFTS[1])
    v ^= v >> np.uint64(HASH64_SHIFTS[2])
    v = v * np.uint64(HASH64_MULTIPLY)
    v ^= v << np.uint64(HASH64_SHIFTS[3])
    v ^= v >> np.uint64(HASH64_SHIFTS[4])
    return v ^ v << np.uint64(HASH64_SHIFTS[5])


def np_hash64_2(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64)
    for by, factor in HASH64_2_ROUNDS:
        x = (x ^ (x >> np.uint64(by))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def np_mix64(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x).astype(np.uint64)
    for factor in MIX64_MULTIPLY:
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _wrapped(f: Callable[[np.ndarray], np.ndarray]):
    @pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series(f(x.to_numpy().astype(np.int64).view(np.uint64)).view(np.int64))

    return run


def hash64(x: Column) -> Column:
    """64-bit hash as the LONG of the same bits."""
    return _wrapped(np_hash64)(x)


def hash64_2(x: Column) -> Column:
    return _wrapped(np_hash64_2)(x)


def mix64(x: Column) -> Column:
    return _wrapped(np_mix64)(x)


def hash_combine(seed: Column, value: Column) -> Column:
    @pandas_udf("long")
    def run(s: pd.Series, v: pd.Series) -> pd.Series:
        s, v = (c.to_numpy().astype(np.int64).view(np.uint64) for c in (s, v))
        return pd.Series((s ^ (v + np.uint64(HASH32_3_ADD) + (s << np.uint64(6)) + (s >> np.uint64(2)))).view(np.int64))

    return run(seed, value)


def log2_up(x: Column) -> Column:
    """Binary logarithm rounded up, exact for whole numbers from 1."""
    return F.when(x == 1, F.lit(0)).otherwise(F.length(F.bin(x - 1)))


def ith_random(i: Column, state: int = 0) -> Column:
    """The i-th number of the generator in that state, as the LONG of the same bits."""
    return hash64(i + F.lit(state))


def fork(i: Column, state: int = 0) -> Column:
    """The state of the i-th generator forked from that state."""
    return hash64(hash64(i + F.lit(state)))


def generator_at(i: Column, state: int = 0) -> Column:
    """The state of a generator's i-th child."""
    return hash64((i + 1) * F.lit(GENERATOR_STRIDE) + F.lit(state))


def random_permutation(n: int) -> np.ndarray:
    """The library-wide default permutation of 0..n-1 for small n: a shuffle that swaps by hash64. Driver side, harness only."""
    if n >= 8192:
        raise ValueError("the exact permutation is for fewer than 8192 values; order by hash64 instead")
    out = np.arange(n)
    at = np_hash64(np.arange(n)) % np.arange(1, n + 1).astype(np.uint64)
    for i in range(n - 1, 0, -1):
        j = int(at[i])
        out[i], out[j] = out[j], out[i]
    return out
