"""Token and number functions over string columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The white space that separates tokens.
SPACE = r"[ \f\n\r\t\x0B]+"


def tokens(text: Column) -> Column:
    """Non-empty runs between white space, as an array."""
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def explode_tokens(df: DataFrame, text: str, *keep: str) -> DataFrame:
    return df.select(*keep, F.posexplode(tokens(F.col(text))).alias("pos", "token"))


def split_at(df: DataFrame, position: str, flag: Column, *by: str) -> DataFrame:
    """Number the runs of rows that end with a flagged row, in order of position."""
    before = Window.partitionBy(*by).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("part", F.coalesce(F.sum(flag.cast("long")).over(before), F.lit(0)))


def to_long(text: Column) -> Column:
    return text.try_cast("long")


def to_double(text: Column) -> Column:
    return text.try_cast("double")


def to_chars(*values: Column, separator: str = ", ") -> Column:
    return F.concat_ws(separator, *[v.cast("string") for v in values])
