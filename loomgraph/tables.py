"""Bucketed tables in the shared folder: state of loops that joins and groups read as it lies.

A join or group on the bucket key moves no row of such a table, so what many rounds read is dealt out once. A Log is such
a table that only grows: a round appends the rows that changed and rewrites nothing; what holds for an id is the fold of its
rows, which needs no exchange either. Files are written by Spark's own writer, so a lost executor costs a retried task.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from loomgraph.session import keep_until_exit, materialize, scratch_dir, shuffle_partitions


def _observed(df: DataFrame, measures: dict[str, Column]):
    """df, and a function that gives its number of rows (n) and the measures once df has been written."""
    seen = Observation()

    def measured() -> dict:
        try:
            return seen.get
        except Py4JJavaError:  # the write has ended well; of a plan that Spark finds to be empty nothing is measured
            return {"n": 0} | dict.fromkeys(measures)

    return df.observe(seen, F.count(F.lit(1)).alias("n"), *[m.alias(k) for k, m in measures.items()]), measured


def materialize_measured(df: DataFrame, label: str, **measures: Column) -> tuple[DataFrame, dict]:
    """materialize(), with the number of rows (n) and the measures from the job that writes."""
    rows, measured = _observed(df, measures)
    return materialize(rows, label), measured()


class Log:
    """A bucketed table in the shared folder to which rounds append."""

    def __init__(self, key: str, label: str, n: int | None = None):
        """n: the number of buckets, else that of shuffle partitions."""
        self.key, self.path, self.name, self.n, self.spark = key, "", f"loomgraph_{label}_{uuid.uuid4().hex}", n, None

    def append(self, df: DataFrame, dealt: bool = False, **measures: Column) -> dict:
        """Appends df in one job; the number of rows (n) and the measures come from that job.

        dealt: df lies by the key already, as after a grouping by it, and is not dealt out again.
        """
        if self.spark is None:
            self.spark, self.n = df.sparkSession, self.n or shuffle_partitions(df.sparkSession)
            self.path = f"{scratch_dir(self.spark)}/{self.name}"
            keep_until_exit(self.spark, self.path)
        rows, measured = _observed(df, measures)
        # A task has one bucket, so it can write without sorting by bucket.
        self.spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")
        (rows if dealt else rows.repartition(self.n, self.key)).write.mode("append").format("parquet").bucketBy(self.n, self.key).option("path", self.path).saveAsTable(self.name)
        return measured()

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def least(self) -> DataFrame:
        """(id, value, turn): the row with the smallest value of each id; no exchange, as the table lies by id."""
        low = self.read().groupBy("id").agg(F.min(F.struct("value", "turn")).alias("low"))
        return low.select("id", "low.value", "low.turn")


def stored_by(df: DataFrame, key: str, label: str, dealt: bool = False) -> DataFrame:
    """df written once, bucketed by key; dealt: see Log.append()."""
    log = Log(key, label)
    log.append(df, dealt)
    out = log.read()
    out._loomgraph_key = key
    return out


def lies_by(df: DataFrame, key: str) -> bool:
    return getattr(df, "_loomgraph_key", None) == key
