"""Sequence primitives over tables: filters, keyed and dense aggregates, scans, ranks, sorts, searches.

A sequence is a table with a position column; by names columns that split it into independent sequences, so that no
operation needs one task for the whole table unless the sequence itself is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.session import materialize

MONOIDS: dict[str, tuple[Callable[[Column], Column], object]] = {
    "plus": (F.sum, 0), "multiplies": (F.product, 1.0), "logical_and": (F.bool_and, True), "logical_or": (F.bool_or, False),
    "bit_and": (F.bit_and, -1), "bit_or": (F.bit_or, 0), "bit_xor": (F.bit_xor, 0), "maximum": (F.max, None), "minimum": (F.min, None),
}


#: Rows of a block of a long sequence, as a power of two.
BLOCK_BITS = 16


def tabulate(spark: SparkSession, n: int, **columns: Column) -> DataFrame:
    return spark.range(n).withColumns(columns)


def numbered(df: DataFrame, *order: str | Column, weight: str | None = None, name: str = "place") -> DataFrame:
    """df with place (or name): how many rows (or the sum of weight over the rows) stand before, in the order of those columns.

    order must settle ties. The range-partitioned sort is written once, since a second run could cut its parts elsewhere;
    a part then counts as one row, so no task orders more than its part or one row for each part.
    """
    rows = materialize(df.orderBy(*order).withColumn("sort_at", F.monotonically_increasing_id()), "sorted")
    rows = rows.withColumn("sort_part", F.shiftright("sort_at", 33))
    sums = rows.groupBy(F.col("sort_part").alias("sum_part")).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("sum_n"))
    ahead = sums.select("sum_part", (F.sum("sum_n").over(Window.orderBy("sum_part")) - F.col("sum_n")).alias("ahead"))
    if weight is None:
        inside = F.col("sort_at") - F.shiftleft("sort_part", 33)
    else:
        inside = F.sum(weight).over(Window.partitionBy("sort_part").orderBy("sort_at")) - F.col(weight)
    # Broadcast: one row for each shuffle partition.
    joined = rows.join(F.broadcast(ahead), F.col("sort_part") == F.col("sum_part"))
    return joined.withColumn(name, F.col("ahead") + inside).drop("sort_at", "sort_part", "sum_part", "ahead")


def _ranked(df: DataFrame, name: str, order: list[str], by: tuple[str, ...]) -> DataFrame:
    """Places in the global order by (by, order), less the first place of each group: no group is one task's."""
    rows = numbered(df, *by, *order)
    if not by:
        return rows.withColumnRenamed("place", name)
    first = rows.groupBy(*[F.col(c).alias(f"group_{c}") for c in by]).agg(F.min("place").alias("first_place"))
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"group_{c}"))
    return rows.join(first, same).withColumn(name, F.col("place") - F.col("first_place")).drop("place", "first_place", *[f"group_{c}" for c in by])


def partition(df: DataFrame, flag: Column, pos: str, *by: str) -> DataFrame:
    """New positions: rows without the flag first, each side in its old order."""
    return _ranked(df.withColumn("side_flag", flag.cast("int")), "new_pos", ["side_flag", pos], by).drop("side_flag")


def reduce(df: DataFrame, value: Column, monoid: str, identity=None) -> DataFrame:
    fold, zero = MONOIDS[monoid]
    zero = zero if identity is None else identity
    out = fold(value)
    return df.agg((F.coalesce(out, F.lit(zero)) if zero is not None else out).alias("value"))


def reduce_by_key(df: DataFrame, key: str, value: Column, monoid: str) -> DataFrame:
    return df.groupBy(key).agg(MONOIDS[monoid][0](value).alias("value"))


def reduce_by_index(df: DataFrame, key: str, value: Column, monoid: str, n: int) -> DataFrame:
    """(idx, value) for every idx below n; the identity where no row has the key."""
    fold, zero = MONOIDS[monoid]
    found = df.groupBy(key).agg(fold(value).alias("found"))
    return df.sparkSession.range(n).join(found, F.col("id") == F.col(key), "left").select(F.col("id").alias("idx"), F.coalesce("found", F.lit(zero)).alias("value"))


def histogram_by_key(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def histogram_by_index(df: DataFrame, key: str, n: int) -> DataFrame:
    return reduce_by_index(df, key, F.lit(1), "plus", n).select("idx", F.col("value").cast("long").alias("n"))


def group_by_key(df: DataFrame, key: str, value: str, most: int | None = None) -> DataFrame:
    """(key, values): the values of a key in any order; most: several rows for a key that has more, each with about that many."""
    if most is None:
        return df.groupBy(key).agg(F.collect_list(value).alias("values"))
    counts = df.groupBy(F.col(key).alias("of_key")).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts")).where("parts > 1")
    dealt = df.join(counts, F.col(key) == F.col("of_key"), "left")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*df.columns, F.monotonically_increasing_id()), F.col("parts")))
    return dealt.withColumn("part", part).groupBy(key, "part").agg(F.collect_list(value).alias("values")).drop("part")


def group_by_key_ordered(df: DataFrame, key: str, value: str, pos: str) -> DataFrame:
    """(key, values): the values of a key in order of position. A key's values become one array."""
    rows = F.array_sort(F.collect_list(F.struct(pos, value)))
    return df.groupBy(key).agg(F.transform(rows, lambda r: r[value]).alias("values"))


def first_min(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """(by, pos, value): the first position of the smallest value."""
    return df.groupBy(*by).agg(F.min(F.struct(value, pos)).alias("m")).select(*by, F.col(f"m.{pos}"), F.col(f"m.{value}"))


def first_max(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.max(F.struct(F.col(value), (-F.col(pos)).alias("back"))).alias("m")).select(*by, (-F.col("m.back")).alias(pos), F.col(f"m.{value}"))


#: How two folds of neighbouring stretches make one, NULL standing for a stretch without values.
_JOIN: dict[Callable, Callable[[Column, Column], Column]] = {
    F.sum: lambda a, b: a + b, F.product: lambda a, b: a * b, F.min: F.least, F.max: F.greatest, F.bool_and: lambda a, b: a & b, F.bool_or: lambda a, b: a | b,
    F.bit_and: Column.bitwiseAND, F.bit_or: Column.bitwiseOR, F.bit_xor: Column.bitwiseXOR,
}


def scan(df: DataFrame, value: str, pos: str, *by: str, fold: Callable = F.sum, identity=0, inclusive: bool = False, backwards: bool = False) -> DataFrame:
    """prefix: fold of the values before (inclusive: up to) each position, from the end if backwards.

    fold is one of Spark's aggregates in MONOIDS; monoids.scan takes any other. Positions settle the order of a sequence, and
    a sequence may hold all rows: windows run inside blocks of BLOCK rows, and over one row for each block.
    """
    rows = numbered(df, *by, F.col(pos).desc() if backwards else F.col(pos), name="seq_place").withColumn("scan_block", F.shiftright("seq_place", BLOCK_BITS))
    keys = ["scan_block", *by]
    folds = rows.groupBy(*keys).agg(fold(value).alias("own"))
    ahead = fold("own").over(Window.partitionBy(*by).orderBy("scan_block").rowsBetween(Window.unboundedPreceding, -1))
    ahead = folds.select(*[F.col(c).alias(f"ahead_{c}") for c in keys], ahead.alias("ahead"))
    frame = Window.partitionBy(*keys).orderBy("seq_place").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(c).eqNullSafe(F.col(f"ahead_{c}"))
    joined = rows.withColumn("inside", fold(value).over(frame)).join(ahead, same)
    whole = F.coalesce(_JOIN[fold](F.col("ahead"), F.col("inside")), F.col("ahead"), F.col("inside"), F.lit(identity))
    return joined.withColumn("prefix", whole).select(*df.columns, "prefix")


def long_scan(df: DataFrame, value: str, pos: str, block: int = 1 << 16) -> DataFrame:
    """The exclusive running sum of one long sequence, two-level: inside blocks of positions, and over block sums."""
    rows = df.withColumn("scan_block", F.floor(F.col(pos) / block))
    sums = rows.groupBy(F.col("scan_block").alias("sum_block")).agg(F.sum(value).alias("n"))
    ahead = sums.select("sum_block", (F.sum("n").over(Window.orderBy("sum_block")) - F.col("n")).alias("ahead"))
    inside = F.sum(value).over(Window.partitionBy("scan_block").orderBy(pos)) - F.col(value)
    return rows.join(ahead, F.col("scan_block") == F.col("sum_block")).withColumn("prefix", F.col("ahead") + inside).drop("scan_block", "sum_block", "ahead")


def rank(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """rank: position from 0 in the stable sort by value."""
    return _ranked(df, "rank", [value, pos], by)


def with_previous(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """df with last_value, the value at the position before, and is_first, whether the sequence starts here.

    The sorted sequence is cut in blocks of BLOCK rows; each block gets the last row of the one before, so nothing but
    those ends is exchanged between blocks and no sequence is one task's.
    """
    rows = numbered(df, *by, pos, name="seq_place").withColumn("in_block", F.shiftright("seq_place", BLOCK_BITS))
    ends = rows.where(F.col("seq_place") % (1 << BLOCK_BITS) == (1 << BLOCK_BITS) - 1).withColumn("in_block", F.col("in_block") + 1)
    both = rows.withColumn("is_end", F.lit(False)).unionByName(ends.withColumn("is_end", F.lit(True)))
    before = Window.partitionBy("in_block").orderBy("seq_place")
    first = F.lag("seq_place").over(before).isNull()
    for c in by:
        first = first | ~F.col(c).eqNullSafe(F.lag(c).over(before))
    marked = both.withColumns({"is_first": first, "last_value": F.lag(value).over(before)}).where("not is_end")
    return marked.withColumn("last_value", F.when(~F.col("is_first"), F.col("last_value"))).drop("in_block", "is_end", "seq_place")


def unique(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """Rows that differ from the row before."""
    marked = with_previous(df, value, pos, *by)
    return marked.where(F.col("is_first") | ~F.col(value).eqNullSafe(F.col("last_value"))).drop("last_value", "is_first")


def adjacent_equal(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """(by, pos): the first position whose value equals the next one."""
    # The position before the first row that equals its predecessor.
    marked = with_previous(df.withColumn("value_at", F.struct(F.col(value).alias("v"), F.col(pos).alias("p"))), "value_at", pos, *by)
    return marked.where(F.col(value) == F.col("last_value.v")).groupBy(*by).agg(F.min("last_value.p").alias(pos))


def is_sorted(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """(by, sorted, upto): whether the values rise, and the first position where they fall (NULL if never)."""
    marked = with_previous(df, value, pos, *by).withColumn("falls", F.coalesce(F.col(value) < F.col("last_value"), F.lit(False)))
    return marked.groupBy(*by).agg((~F.bool_or("falls")).alias("sorted"), F.min(F.when(F.col("falls"), F.col(pos))).alias("upto"))


def stable_sort(df: DataFrame, key: str, pos: str) -> DataFrame:
    return df.orderBy(key, pos)


def counting_sort(df: DataFrame, key: str, pos: str) -> DataFrame:
    """new_pos: place in the stable sort by key."""
    return _ranked(df, "new_pos", [key, pos], ())


def bucket_offsets(df: DataFrame, key: str) -> DataFrame:
    """(key, first, n): where the rows of a key start in the sort by it, and how many there are."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return numbered(counts, key, weight="n").select(key, F.col("place").alias("first"), "n")


def kth_smallest(df: DataFrame, value: str, k: int) -> DataFrame:
    return df.select(value).orderBy(value).offset(k).limit(1)


def merge(left: DataFrame, right: DataFrame, value: str, pos: str) -> DataFrame:
    """Both sequences in one stable order: by value, left before right, then position."""
    both = left.select(value, pos, F.lit(0).alias("side")).unionByName(right.select(value, pos, F.lit(1).alias("side")))
    return both.orderBy(value, "side", pos)


def lower_bound(df: DataFrame, value: str, probes: DataFrame, probe: str) -> DataFrame:
    """(probe, place): how many values are smaller. Counts by value are merged with the probes in one order."""
    values = df.groupBy(F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n")).select("v", "n", F.lit(1).alias("kind"))
    asked = probes.select(F.col(probe).alias("v"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind")).distinct()
    return numbered(values.unionByName(asked), "v", "kind", weight="n").where("kind = 0").select(F.col("v").alias(probe), "place")


def find_if(df: DataFrame, predicate: Column, pos: str, n: int) -> DataFrame:
    """One row, place: the first position where predicate holds, else n."""
    return df.agg(F.coalesce(F.min(F.when(predicate, F.col(pos))), F.lit(n)).alias("place"))


def mismatch(left: DataFrame, right: DataFrame, value: str, pos: str) -> DataFrame:
    """One row, place: the first position at which the sequences differ (NULL if one is a prefix of the other or equal)."""
    a, b = left.select(F.col(pos), F.col(value).alias("a")), right.select(F.col(pos), F.col(value).alias("b"))
    return a.join(b, pos).where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min(pos).alias("place"))


def rotate(df: DataFrame, pos: str, n: int, by: int) -> DataFrame:
    return df.withColumn("new_pos", F.pmod(F.col(pos) - by, F.lit(n)))


def reverse(df: DataFrame, pos: str, n: int) -> DataFrame:
    return df.withColumn("new_pos", F.lit(n - 1) - F.col(pos))


def zip_with(left: DataFrame, right: DataFrame, pos: str) -> DataFrame:
    return left.join(right, pos)


def search(haystack: Column, needle: Column) -> Column:
    """First place of an array inside another, NULL if nowhere."""
    starts = F.sequence(F.lit(0), F.size(haystack) - F.size(needle))
    hits = F.filter(starts, lambda i: F.slice(haystack, i + 1, F.size(needle)) == needle)
    return F.when(F.size(haystack) >= F.size(needle), F.get(hits, F.lit(0)))
