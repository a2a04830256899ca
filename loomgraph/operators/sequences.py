"""Sequences as tables (position, value): positions, searches, comparisons, cuts, grouped and distinct forms, random order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.operators.primitives import numbered, rank


def enumerate_rows(df: DataFrame, pos: str) -> DataFrame:
    """df with place: gapless positions from 0 in order of pos."""
    return numbered(df, pos)


def pack_index(df: DataFrame, flag: Column, pos: str) -> DataFrame:
    """(place): the gapless positions of the rows that have the flag."""
    return numbered(df.select(pos, flag.alias("is_flagged")), pos).where("is_flagged").select("place")


def append(left: DataFrame, right: DataFrame, pos: str, n: int) -> DataFrame:
    """right after the n rows of left."""
    return left.unionByName(right.withColumn(pos, F.col(pos) + n))


def cut(df: DataFrame, pos: str, start: int, end: int) -> DataFrame:
    """Rows at start <= pos < end."""
    return df.where((F.col(pos) >= start) & (F.col(pos) < end))


def head(df: DataFrame, pos: str, count: int) -> DataFrame:
    """The first rows, at most count; a take-ordered of the parts, not a sort of the table."""
    return df.orderBy(pos).limit(count)


def tail(df: DataFrame, pos: str, count: int) -> DataFrame:
    return df.orderBy(F.col(pos).desc()).limit(count)


def find_first_of(df: DataFrame, others: DataFrame, value: str, pos: str, n: int) -> DataFrame:
    """One row, place: the first position whose value stands in others, else n."""
    return df.join(others.select(value).distinct(), value, "left_semi").agg(F.coalesce(F.min(pos), F.lit(n)).alias("place"))


#: Positions of a block of a search; the two primes of its rolling hashes; most distinct pattern values that are broadcast.
SEARCH_BLOCK, PRIMES, SMALL = 1 << 16, (2147483647, 2147483629), 50_000


def occurrences(df: DataFrame, pattern: DataFrame, value: str, pos: str) -> DataFrame:
    """(start): where pattern (gapless positions from 0) stands in df (gapless positions); no row for an empty pattern.

    Values become the pattern's codes. The sequence is cut in blocks that overlap by the pattern's length less one; in a
    block the rolling hashes of all windows are worked out at once and those equal to the pattern's are compared with it,
    sharing what overlapping ones have in common. A block's work is linear, however often a value stands in both.
    The pattern is the question: its codes, 8 bytes an element, go to every task. NULL equals nothing.
    """
    coded = numbered(pattern.select(value).where(F.col(value).isNotNull()).distinct(), value, name="code").withColumnRenamed(value, "p_value")
    asked = pattern.join(coded, F.col(value) == F.col("p_value"), "left").select(pos, F.coalesce("code", F.lit(-2)).alias("code"))
    wanted = np.array([c for _, c in sorted((r[0], r[1]) for r in asked.collect())], np.int64)
    m = len(wanted)
    block = max(SEARCH_BLOCK, m)
    if not m:
        return df.select(F.col(pos).alias("start")).limit(0)
    coded = F.broadcast(coded) if len(set(wanted.tolist())) <= SMALL else coded
    rows = df.join(coded, F.col(value) == F.col("p_value"), "left").select(F.col(pos).cast("long").alias("at"), F.coalesce("code", F.lit(-1)).cast("long").alias("code"))
    own = F.floor(F.col("at") / block)
    # A row is also the tail of a window that starts in the block before.
    tail = F.when(F.col("at") - own * block < m - 1, F.array(own, own - 1)).otherwise(F.array(own))
    find = _finder(wanted, block)
    return rows.withColumn("block", F.explode(tail)).groupBy("block").applyInArrow(find, "start long")


def _finder(wanted: np.ndarray, block: int):
    m = len(wanted)
    repeats = _self_overlaps(wanted)

    def hashes(codes: np.ndarray, prime: int, base: int) -> tuple[np.ndarray, np.ndarray]:
        power = np.ones(len(codes) + 1, np.int64)
        known = 1
        while known < len(power):
            more = power[: min(known, len(power) - known)] * pow(base, known, prime) % prime
            power[known : known + len(more)] = more
            known += len(more)
        return np.concatenate([[0], np.cumsum((codes + 3) * power[:-1] % prime) % prime]), power

    def find(key, table):
        at = table.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        at, codes = at[order], table.column("code").to_numpy()[order]
        ok = np.arange(len(codes) - m + 1) if len(codes) >= m else np.zeros(0, np.int64)
        ok = ok[at[ok] // block == key[0].as_py()]
        for prime, base in zip(PRIMES, (911382323, 972663749), strict=True):
            sums, power = hashes(codes, prime, base)
            own, _ = hashes(wanted, prime, base)
            ok = ok[(sums[ok + m] - sums[ok]) % prime == own[m] * power[ok] % prime]
        starts, last = [], None
        for i in ok.tolist():
            step = m if last is None else i - last
            # The part that the last occurrence covers is known to equal the pattern from step on.
            if step >= m or repeats[step]:
                known = max(0, m - step)
                if np.array_equal(codes[i + known : i + m], wanted[known:]):
                    starts.append(i)
                    last = i
        return pa.table({"start": pa.array(at[starts] if starts else np.zeros(0, np.int64), pa.int64())})

    return find


def _self_overlaps(wanted: np.ndarray) -> np.ndarray:
    """For each step whether the pattern, moved on by it, agrees with itself: from the borders of the whole pattern."""
    codes, m = wanted.tolist(), len(wanted)
    border = [0] * (m + 1)
    k = 0
    for i in range(1, m):
        while k and codes[i] != codes[k]:
            k = border[k]
        k += codes[i] == codes[k]
        border[i + 1] = k
    out, k = np.zeros(m + 1, bool), m
    while k:
        out[m - k] = True
        k = border[k]
    return out


def find_span(df: DataFrame, pattern: DataFrame, value: str, pos: str, n: int, last: bool = False) -> DataFrame:
    """One row, place: the first (last) start of pattern in df of n rows, else n. An empty pattern: 0 (last: n)."""
    found = occurrences(df, pattern, value, pos).agg((F.max if last else F.min)("start").alias("found"))
    size = pattern.agg(F.count(F.lit(1)).alias("size"))
    return found.select(F.coalesce("found", F.when(size.scalar() == 0, F.lit(n if last else 0)), F.lit(n)).cast("long").alias("place"))


def compare(left: DataFrame, right: DataFrame, value: str, pos: str) -> DataFrame:
    """One row: equal, less (left stands before right in dictionary order; a prefix stands before the longer sequence)."""
    a, b = left.select(pos, F.col(value).alias("a"), F.lit(True).alias("has_a")), right.select(pos, F.col(value).alias("b"), F.lit(True).alias("has_b"))
    both = a.join(b, pos, "full").where(F.col("has_a").isNull() | F.col("has_b").isNull() | ~F.col("a").eqNullSafe(F.col("b")))
    less = F.when(F.col("has_a").isNull(), True).when(F.col("has_b").isNull(), False).otherwise(F.coalesce(F.col("a") < F.col("b"), F.col("a").isNull()))
    first = both.agg(F.min(F.struct(pos, less.alias("less"))).alias("m"))
    return first.select(F.col("m").isNull().alias("equal"), F.coalesce("m.less", F.lit(False)).alias("less"))


def is_partitioned(df: DataFrame, flag: Column, pos: str) -> DataFrame:
    """One row, partitioned: whether all flagged rows stand before all others."""
    ends = df.agg(F.max(F.when(flag, F.col(pos))).alias("last"), F.min(F.when(~flag, F.col(pos))).alias("first"))
    return ends.select(F.coalesce(F.col("last") < F.col("first"), F.lit(True)).alias("partitioned"))


def minmax(df: DataFrame, value: str, pos: str) -> DataFrame:
    """One row: (low_pos, low, high_pos, high), the first positions of the smallest and of the largest value."""
    found = df.agg(F.min(F.struct(value, pos)).alias("a"), F.max(F.struct(F.col(value), (-F.col(pos)).alias("back"))).alias("b"))
    return found.select(F.col(f"a.{pos}").alias("low_pos"), F.col(f"a.{value}").alias("low"), (-F.col("b.back")).alias("high_pos"), F.col(f"b.{value}").alias("high"))


def fold_arrays(df: DataFrame, arrays: str, fold) -> DataFrame:
    """(i, value): the fold of the i-th elements of all arrays."""
    return df.select(F.posexplode(arrays).alias("i", "x")).groupBy("i").agg(fold("x").alias("value"))


def distinct_sorted(df: DataFrame, value: str) -> DataFrame:
    """(place, value): the distinct values in order."""
    return numbered(df.select(value).distinct(), value).select("place", value)


def distinct_first(df: DataFrame, value: str, pos: str) -> DataFrame:
    """(place, value, pos): the distinct values in order, each with the first position that has it."""
    return numbered(df.groupBy(value).agg(F.min(pos).alias(pos)), value).select("place", value, pos)


def group_by_index(df: DataFrame, key: str, value: str, pos: str, n: int) -> DataFrame:
    """(idx, i, value): the list of every idx below n, an element a row in order of pos; one row with NULLs for an empty list.

    Elements stay rows: a list of a third of all rows is no task's array.
    """
    listed = rank(df.select(key, pos, value), pos, value, key).select(F.col(key).alias("list_key"), F.col("rank").alias("i"), F.col(value).alias("value"))
    return df.sparkSession.range(n).join(listed, F.col("id") == F.col("list_key"), "left").select(F.col("id").alias("idx"), "i", "value")


#: Fixed value: from that many values on, the random order goes through buckets.
BUCKETS_FROM = 8192


def random_order(spark: SparkSession, n: int) -> DataFrame:
    """(pos, value): the library-wide default permutation of 0..n-1.

    From 8,192 values on, a value's hash deals it to a bucket, and each bucket of some thousand values (131,072 at most, on
    average) is shuffled alone by its own generator. The order is a chain of swaps, each on what the one before left, so the loop
over a bucket's values cannot be a vector operation; buckets run side by side.
    """
    if n < BUCKETS_FROM:
        return spark.createDataFrame(list(enumerate(hashing.random_permutation(n).tolist())), "pos long, value long")
    width = (n - 1).bit_length()
    bits = (width - 7) // 2 if n < 1 << 27 else width - 17
    dealt = spark.range(n).select(F.col("id").alias("value"), hashing.ith_random(F.col("id")).bitwiseAND(F.lit((1 << bits) - 1)).alias("bucket"))
    firsts = numbered(dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "bucket", weight="n").select(F.col("bucket").alias("b"), F.col("place").alias("first"))

    def shuffle(key, rows):
        out = np.sort(rows.column("value").to_numpy())
        state = hashing.np_hash64(hashing.np_hash64(np.array([key[0].as_py()], np.uint64)))[0]
        steps = np.arange(len(out), dtype=np.uint64)
        targets = (hashing.np_hash64(steps + state) % (steps + np.uint64(1))).astype(np.int64)
        for i in range(len(out) - 1, 0, -1):
            j = targets[i]
            out[i], out[j] = out[j], out[i]
        return pa.table({"bucket": pa.array(np.full(len(out), key[0].as_py(), np.int64)), "i": pa.array(np.arange(len(out))), "value": pa.array(out)})

    mixed = dealt.groupBy("bucket").applyInArrow(shuffle, "bucket long, i long, value long")
    return mixed.join(firsts, F.col("bucket") == F.col("b")).select((F.col("first") + F.col("i")).alias("pos"), "value")
