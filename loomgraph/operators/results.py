"""Result tables: coverage, fingerprints, comparison, and the statistics of benchmark tables."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from loomgraph.functions.hashing import np_mix64
from loomgraph.operators.primitives import numbered, rank, scan
from loomgraph.operators.sequences import random_order

#: Fixed values of the fingerprint.
FNV_OFFSET, FNV_PRIME, GOLDEN = 0xCBF29CE484222325, 0x100000001B3, 0x9E3779B97F4A7C15
SENTINELS = (4294967295, 2147483647)


def reached(value: Column) -> Column:
    return value.isNotNull() & ~value.isin(*SENTINELS)


def coverage(result: DataFrame) -> DataFrame:
    """One row: n, n_reached, farthest (the largest value reached)."""
    hit = reached(F.col("value"))
    return result.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("n_reached"), F.max(F.when(hit, F.col("value"))).alias("farthest"))


def is_available(result: DataFrame, share: float) -> bool:
    row = coverage(result).first()
    return row["n_reached"] >= share * row["n"] if row["n"] else share <= 0


def pick_sources(spark: SparkSession, n: int, query: Callable[[int], DataFrame], wanted: int, share: float = 0.1) -> list[int]:
    """The first sources of the default random order whose result reaches that share of the vertices."""
    found: list[int] = []
    order = random_order(spark, n).orderBy("pos").toLocalIterator()
    while len(found) < wanted and (row := next(order, None)) is not None:
        if is_available(query(row["value"]), share):
            found.append(row["value"])
    return found


@pandas_udf(LongType())
def _mixed(value: pd.Series, place: pd.Series, stride: pd.Series) -> pd.Series:
    value, place, stride = (c.to_numpy().astype(np.int64).view(np.uint64) for c in (value, place, stride))
    return pd.Series(np_mix64(value + stride * place).view(np.int64))


def fingerprint(result: DataFrame, missing: int = SENTINELS[0]) -> str:
    """The order-dependent 32-bit fingerprint of (id, value), as 8 hex digits.

    Order, mixing, sum and maximum are Spark's. The last step is a chain that no two parts can share: its numbers, 8 bytes
    a row, stream by in order of id, a partition at a time.
    """
    rows = numbered(result.select("id", F.coalesce("value", F.lit(missing)).cast("long").alias("value")), "id")
    strides = [F.lit(GOLDEN - 2**64).cast("long"), F.lit(2).cast("long")]
    own, linked = (_mixed("value", "place", stride) for stride in strides)
    row = rows.select("value", own.cast("decimal(20,0)").alias("own")).agg(F.max("value").alias("top"), F.sum("own").alias("total")).first()
    top, total, chain = int(row["top"] or 0), int(row["total"] or 0) % 2**64, FNV_OFFSET
    for row in rows.select("place", linked.alias("linked")).orderBy("place").toLocalIterator():
        chain = (chain ^ (row["linked"] % 2**64)) * FNV_PRIME % 2**64
    return f"{(top ^ total ^ total >> 32 ^ chain ^ chain >> 32) & 0xFFFFFFFF:08x}"


def record_result(result: DataFrame, seconds: float, timings: DataFrame, checks: DataFrame, row: str, column: str, dump: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables of timings and of fingerprints, keyed by name, with this result's cell set; dump names a folder for (id, value)."""
    spark = result.sparkSession
    if dump:
        result.orderBy("id").write.mode("overwrite").csv(dump)
    cell = lambda value, kind: spark.createDataFrame([(row, value)], f"name string, `{column}` {kind}")
    return upsert_cells(timings, cell(float(seconds), "double"), "name"), upsert_cells(checks, cell(fingerprint(result), "string"), "name")


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def geometric_mean(df: DataFrame, value: str, *by: str) -> DataFrame:
    """For each group of by and each roll-up of it."""
    return df.rollup(*by).agg(F.exp(F.avg(F.log(value))).alias("geomean"))


def relative(df: DataFrame, base: str, own: str, cap: float = 5.0) -> DataFrame:
    return df.withColumn("ratio", F.least(F.col(base) / F.col(own), F.lit(cap)))


def fill_forward(df: DataFrame, value: str, pos: str, *by: str) -> DataFrame:
    """NULLs take the last value before them in their sequence: a scan, in blocks, of the place that has it."""
    own = df.withColumn("filled_at", F.when(F.col(value).isNotNull(), F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return scan(own, "filled_at", pos, *by, fold=F.max, identity=None, inclusive=True).withColumn(value, F.col("prefix.v")).drop("filled_at", "prefix")


def significant(value: Column, digits: int = 3) -> Column:
    """Rounded to that many significant digits."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.abs(value))) - F.lit(digits - 1))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.round(value / unit) * unit)


def upsert_cells(table: DataFrame, cells: DataFrame, key: str) -> DataFrame:
    """table with the columns of cells(key, ...) set or added, and a row for each new key."""
    new = cells.select(F.col(key).alias("new_key"), *[F.col(c).alias(f"new_{c}") for c in cells.columns if c != key])
    joined = table.join(new, F.col(key) == F.col("new_key"), "full")
    names = dict.fromkeys([*table.columns, *cells.columns])
    out = [F.coalesce(F.col(key), F.col("new_key")).alias(key)]
    for c in names:
        if c != key:
            out.append((F.coalesce(f"new_{c}", c) if c in table.columns and c in cells.columns else F.col(f"new_{c}") if c in cells.columns else F.col(c)).alias(c))
    return joined.select(*out)


def best_of(df: DataFrame, *names: str) -> DataFrame:
    """best: the smallest of those columns in a row; best_name: the first of them that has it."""
    kept = F.filter(F.array(*[F.struct(F.col(c).alias("v"), F.lit(c).alias("name")) for c in names]), lambda x: x["v"].isNotNull())
    return df.withColumn("best", F.least(*names)).withColumn("best_name", F.get(F.filter(kept, lambda x: x["v"] == F.col("best")), F.lit(0))["name"])


def binned_medians(df: DataFrame, x: str, y: str, bins: int = 16) -> DataFrame:
    """(bin, n, median): the median of y in bins of equal width of log10 x; rows where either is not above 0 are left out."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).withColumn("log_x", F.log10(x))
    ends = rows.agg(F.min("log_x").alias("low"), F.max("log_x").alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.floor((F.col("log_x") - F.col("low")) / (F.col("high") - F.col("low")) * bins)).otherwise(F.lit(0))
    binned = rows.join(F.broadcast(ends)).select(F.least(place, F.lit(bins - 1)).alias("bin"), F.col(y).alias("y"))
    # The middle rows by rank, so that no bin's values are gathered.
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).select(F.col("bin").alias("of_bin"), "n")
    middle = rank(binned, "y", "y", "bin").join(F.broadcast(counts), F.col("bin") == F.col("of_bin")).where((2 * F.col("rank") >= F.col("n") - 2) & (2 * F.col("rank") <= F.col("n")))
    return middle.groupBy("bin", "n").agg(F.avg("y").alias("median"))


def log_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope and intercept of the line through (log10 x, log10 y), by least squares over all rows."""
    rows = df.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(x).alias("a"), F.log10(y).alias("b"))
    return rows.agg(F.regr_slope("b", "a").alias("slope"), F.regr_intercept("b", "a").alias("intercept"))
