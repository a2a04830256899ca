"""Vertex sets as id tables: set algebra, folds over members, and the double-buffered frontier."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.operators.primitives import numbered
from loomgraph.session import materialize


class VertexSet:
    """A set of LONG ids. Every operation is bulk and lazy; a set never changes."""

    def __init__(self, ids: DataFrame):
        self.ids = ids.select(F.col("id").cast("long").alias("id"))

    @classmethod
    def full(cls, spark: SparkSession, n: int) -> VertexSet:
        return cls(spark.range(n))

    @classmethod
    def none(cls, spark: SparkSession) -> VertexSet:
        return cls(spark.range(0))

    def is_empty(self) -> bool:
        return self.ids.isEmpty()

    def contains(self, others: DataFrame) -> DataFrame:
        """others(id, ...) that are members."""
        return others.join(self.ids, "id", "left_semi")

    def insert(self, others: VertexSet) -> VertexSet:
        return VertexSet(self.ids.unionByName(others.ids).distinct())

    def remove(self, others: VertexSet) -> VertexSet:
        return VertexSet(self.ids.join(others.ids, "id", "left_anti"))

    def intersect(self, others: VertexSet) -> VertexSet:
        return VertexSet(self.ids.join(others.ids, "id", "left_semi").distinct())

    def newly(self, others: VertexSet) -> VertexSet:
        """Members that insert(others) would add."""
        return VertexSet(others.ids.distinct().join(self.ids, "id", "left_anti"))

    def newly_removed(self, others: VertexSet) -> VertexSet:
        """Members that remove(others) would take away."""
        return self.intersect(others)

    def each(self, attributes: DataFrame, **columns: Column) -> DataFrame:
        """Members with columns computed from attributes(id, ...)."""
        return self.ids.join(attributes, "id").withColumns(columns)

    def reduce(self, attributes: DataFrame, fold: Callable[[Column], Column], value: Column, identity) -> DataFrame:
        """One row, value: fold (an aggregate) of value over the members; identity if there are none."""
        return self.ids.join(attributes, "id").agg(F.coalesce(fold(value), F.lit(identity)).alias("value"))

    def count(self) -> DataFrame:
        return self.ids.agg(F.count(F.lit(1)).alias("value"))

    def blocks64(self) -> DataFrame:
        """One row, value: how many aligned blocks of 64 ids have a member."""
        return self.ids.agg(F.count_distinct(F.shiftright("id", 6)).alias("value"))

    def edge_sum(self, degrees: DataFrame) -> DataFrame:
        return self.reduce(degrees, F.sum, F.col("deg"), 0)

    def min_of(self, attributes: DataFrame, name: str, identity) -> DataFrame:
        return self.reduce(attributes, F.min, F.col(name), identity)

    def max_of(self, attributes: DataFrame, name: str, identity) -> DataFrame:
        return self.reduce(attributes, F.max, F.col(name), identity)

    def bitmap(self) -> DataFrame:
        """(bucket, bits, n): the dense form, 32,768 ids to a bucket."""
        rows = self.ids.distinct()
        return rows.groupBy(F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bits")).withColumn("n", F.bitmap_count("bits"))


    def words(self) -> DataFrame:
        """(word, bits, n, before): the members of each run of 64 ids as bits of a number, and how many stand before the run.

        Popcounts are summed in two levels, inside runs of 1,024 words and over one row for each of these.
        """
        bit = F.expr("shiftleft(1L, cast(id & 63 as int))")
        words = self.ids.groupBy(F.shiftright("id", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).withColumns({"n": F.bit_count("bits").cast("long"), "run": F.shiftright("word", 10)})
        runs = words.groupBy(F.col("run").alias("of_run")).agg(F.sum("n").alias("in_run"))
        ahead = runs.select("of_run", (F.sum("in_run").over(Window.orderBy("of_run")) - F.col("in_run")).alias("ahead"))
        inside = F.sum("n").over(Window.partitionBy("run").orderBy("word")) - F.col("n")
        return words.withColumn("inside", inside).join(ahead, F.col("run") == F.col("of_run")).select("word", "bits", "n", (F.col("ahead") + F.col("inside")).alias("before"))

    def rank(self, asked: DataFrame) -> DataFrame:
        """(id, rank): how many members are smaller than each asked id, a member or not."""
        words, asked = self.words(), asked.select(F.col("id").cast("long").alias("id")).distinct()
        # A word that has no member gets its sum from the order of words; one that has, its own bits below the id as well.
        both = words.select("word", F.lit(1).alias("kind"), "n").unionByName(asked.select(F.shiftright("id", 6).alias("word"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("n")).distinct())
        ahead = numbered(both, "word", "kind", weight="n").where("kind = 0").select(F.col("word").alias("a_word"), F.col("place").alias("ahead"))
        below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))")
        joined = asked.withColumn("in_word", F.shiftright("id", 6)).join(ahead, F.col("in_word") == F.col("a_word")).join(words.select("word", "bits"), F.col("in_word") == F.col("word"), "left")
        return joined.select("id", (F.col("ahead") + F.coalesce(below, F.lit(0))).cast("long").alias("rank"))

    def select(self, asked: DataFrame) -> DataFrame:
        """(k, id): the member with k smaller ones, for each asked k that has one.

        A word's members have at most two different k >> 6, by which words and questions are joined.
        """
        words = self.words().withColumn("near", F.explode(F.expr("sequence(shiftright(before, 6), shiftright(before + n - 1, 6))")))
        asked = asked.select(F.col("k").cast("long").alias("k")).distinct()
        hit = asked.join(words, F.shiftright("k", 6) == F.col("near")).where("k >= before and k < before + n")
        place = F.expr("filter(sequence(0, 63), i -> shiftright(bits, i) & 1 = 1)[cast(k - before as int)]")
        return hit.select("k", (F.shiftleft("word", 6) + place).alias("id"))


class Frontier:
    """Two sets: members of this round and of the next. Empty at first; for_each clears unless told not to."""

    def __init__(self, spark: SparkSession):
        self.now, self.next = VertexSet.none(spark), VertexSet.none(spark)

    def insert_next(self, others: VertexSet) -> None:
        self.next = self.next.insert(others)

    def remove_next(self, others: VertexSet) -> None:
        self.next = self.next.remove(others)

    def contains_next(self, others: DataFrame) -> DataFrame:
        return self.next.contains(others)

    def empty_next(self) -> bool:
        return self.next.is_empty()

    def advance(self) -> bool:
        """Swap; False if the new round has no member."""
        self.now = VertexSet(materialize(self.next.ids, "frontier"))
        self.next = VertexSet(self.now.ids.limit(0))
        return not self.now.is_empty()

    def for_each(self, attributes: DataFrame, remove: bool = True, **columns: Column) -> DataFrame:
        out = self.now.each(attributes, **columns)
        if remove:
            self.now = VertexSet(self.now.ids.limit(0))
        return out


class PriorityMap:
    """Open members with a priority: decrease-key and extract-all-up-to as bulk operations."""

    def __init__(self, entries: DataFrame):
        self.entries = entries.select(F.col("id").cast("long").alias("id"), "prio")

    def decrease(self, offers: DataFrame) -> tuple[PriorityMap, DataFrame]:
        """The map after offers(id, prio), and the offers that improve a member or add one (the best of each id)."""
        best = offers.groupBy("id").agg(F.min("prio").alias("prio"))
        old = self.entries.select(F.col("id").alias("o_id"), F.col("prio").alias("o_prio"))
        better = best.join(old, F.col("id") == F.col("o_id"), "left").where(F.col("o_id").isNull() | (F.col("prio") < F.col("o_prio"))).select("id", "prio")
        return PriorityMap(self.entries.unionByName(best).groupBy("id").agg(F.min("prio").alias("prio"))), better

    def lowest(self) -> DataFrame:
        return self.entries.agg(F.min("prio").alias("value"))

    def extract(self, threshold) -> tuple[DataFrame, PriorityMap]:
        """Members with a priority of at most threshold, and the map of the others."""
        return self.entries.where(F.col("prio") <= F.lit(threshold)), PriorityMap(self.entries.where(F.col("prio") > F.lit(threshold)))


def edge_map(front: DataFrame, edges: DataFrame, keep: Column | None = None, message: Column | None = None, fold: Callable = F.min) -> DataFrame:
    """(id, value): messages along the out-edges of front(id, ...), folded for each destination.

    message and keep may use the columns of front and src, dst, wgh of the edge.
    """
    hit = front.withColumnRenamed("id", "front_id").join(edges, F.col("front_id") == F.col("src"))
    if keep is not None:
        hit = hit.where(keep)
    return hit.groupBy(F.col("dst").alias("id")).agg(fold(message if message is not None else F.lit(1)).alias("value"))


def pull(targets: DataFrame, edges: DataFrame, visited: DataFrame) -> DataFrame:
    """targets(id) that have an in-neighbour in visited(id); a semi-join stops at the first."""
    touched = edges.join(visited.select(F.col("id").alias("v_id")), F.col("src") == F.col("v_id"), "left_semi").select(F.col("dst").alias("id"))
    return targets.join(touched, "id", "left_semi")


def neighbour_count(edges: DataFrame, attributes: DataFrame, predicate: Column) -> DataFrame:
    """(id, value): neighbours for which predicate holds; it may use s_* and d_* columns of both ends."""
    s, d = (attributes.select(*[F.col(c).alias(f"{e}_{c}") for c in attributes.columns]) for e in "sd")
    both = edges.join(s, F.col("src") == F.col("s_id")).join(d, F.col("dst") == F.col("d_id"))
    return both.groupBy(F.col("src").alias("id")).agg(F.count_if(predicate).alias("value"))
