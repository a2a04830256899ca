"""Graphs as DataFrames: vertices(id) and directed edges(src, dst[, wgh])."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.hashing import hash32
from loomgraph.session import shuffle_partitions
from loomgraph.tables import stored_by


@dataclass(frozen=True)
class Graph:
    """ids are LONG from 0; parallel edges and self-loops count, as loaded. symmetric: every edge has its reverse."""

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False

    @staticmethod
    def from_edges(edges: DataFrame, n: int | None = None, vertices: DataFrame | None = None, symmetric: bool = False) -> Graph:
        """Vertices are 0..n-1, or the given ones, or else those that have edges."""
        edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"), *[c for c in edges.columns if c == "wgh"])
        if vertices is None:
            spark = edges.sparkSession
            both = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
            vertices = both if n is None else spark.range(n).select(F.col("id"))
        return Graph(vertices.select(F.col("id").cast("long").alias("id")), edges, symmetric)

    @property
    def weighted(self) -> bool:
        return "wgh" in self.edges.columns

    def stored(self, dealt: bool = False) -> Graph:
        """Written once to the shared folder, edges by source: loops read them in every round as they lie.

        dealt: edges lie by source already, as once_by_source() leaves them.
        """
        return replace(self, vertices=stored_by(self.vertices, "id", "vertices"), edges=stored_by(self.edges, "src", "edges", dealt))

    def degrees(self) -> DataFrame:
        """(id, deg) of every vertex, isolated ones with 0."""
        counted = self.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
        return self.vertices.join(counted, F.col("id") == F.col("src"), "left").select("id", F.coalesce("deg", F.lit(0)).cast("long").alias("deg"))

    def offsets(self) -> DataFrame:
        """(id, first, deg): where a vertex's edges start when edges are sorted by source.

        Two-level prefix sums over ranges of 65,536 ids, so no task sums up more than one range or all ranges.
        """
        rows = self.degrees().withColumn("range", F.shiftright("id", 16))
        ranges = rows.groupBy("range").agg(F.sum("deg").alias("n"))
        ahead = ranges.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("ahead"))
        inside = F.sum("deg").over(Window.partitionBy("range").orderBy("id")) - F.col("deg")
        return rows.join(ahead, F.col("range") == F.col("r")).select("id", (F.col("ahead") + inside).alias("first"), "deg")

    def transpose(self) -> Graph:
        if self.symmetric:
            return self
        more = ["wgh"] if self.weighted else []
        return replace(self, edges=self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more))

    def symmetrize(self) -> Graph:
        """Both directions, without self-loops and parallel edges; of parallel edges the smallest weight stays."""
        more = ["wgh"] if self.weighted else []
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *more)
        both = self.edges.unionByName(back).where("src <> dst")
        once = both.groupBy("src", "dst").agg(F.min("wgh").alias("wgh")) if self.weighted else both.distinct()
        return replace(self, edges=once, symmetric=True)

    def loops_and_parallel(self) -> DataFrame:
        """One row: n_loops, n_parallel (edges beyond the first of their ends)."""
        pairs = self.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
        return pairs.agg(F.coalesce(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n"))), F.lit(0)).alias("n_loops"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_parallel"))

    def validate(self) -> DataFrame:
        """One row: edges with an end that is no vertex, self-loops, parallel edges, edges without their reverse."""
        ends = self.edges.select("src", "dst", F.explode(F.array_distinct(F.array("src", "dst"))).alias("end"))
        foreign = ends.join(self.vertices, F.col("end") == F.col("id"), "left_anti").select("src", "dst").agg(F.count(F.lit(1)).alias("n_foreign"))
        back = self.edges.select(F.col("dst").alias("b_src"), F.col("src").alias("b_dst"))
        one_way = self.edges.join(back, (F.col("src") == F.col("b_src")) & (F.col("dst") == F.col("b_dst")), "left_anti").agg(F.count(F.lit(1)).alias("n_one_way"))
        return self.loops_and_parallel().withColumns({"n_foreign": foreign.scalar(), "n_one_way": one_way.scalar()})

    def with_generated_weights(self, n: int, limit: int = 0) -> Graph:
        """1 + (hash32(src) xor hash32(dst)) mod limit; limit 0 stands for floor(log2 n), at least 1."""
        return replace(self, edges=self.edges.withColumn("wgh", generated_weight(F.col("src"), F.col("dst"), 1, limit or max(1, int(math.log2(max(n, 2)))))))

    def with_weights_between(self, low: int, high: int) -> Graph:
        """low + (hash32(src) xor hash32(dst)) mod (high - low + 1): both ends included."""
        return replace(self, edges=self.edges.withColumn("wgh", generated_weight(F.col("src"), F.col("dst"), low, high - low + 1)))

    def with_unit_weights(self, kind: str = "float") -> Graph:
        return replace(self, edges=self.edges.withColumn("wgh", F.lit(1).cast(kind)))


def once_by_source(edges: DataFrame) -> DataFrame:
    """(src, dst) without parallel edges, dealt out by source: one exchange serves both."""
    return edges.repartition(shuffle_partitions(edges.sparkSession), "src").distinct()


def generated_weight(src: Column, dst: Column, low: int, count: int) -> Column:
    return (F.lit(low) + hash32(src).bitwiseXOR(hash32(dst)) % F.lit(count)).cast("int")


def random_graph(spark: SparkSession, n: int, m: int, symmetric: bool = True) -> Graph:
    """Hash-random edges: pair i joins hash32(2i) mod n with hash32(2i + 1) mod n, m / 2 pairs.

    Symmetric: both directions of each pair; else the second edge joins the hashes of the two ends.
    """
    pairs = spark.range(m // 2).select((hash32(F.col("id") * 2) % n).alias("src"), (hash32(F.col("id") * 2 + 1) % n).alias("dst"))
    if symmetric:
        other = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    else:
        other = pairs.select((hash32(F.col("src")) % n).alias("src"), (hash32(F.col("dst")) % n).alias("dst"))
    return Graph.from_edges(pairs.unionByName(other), n, symmetric=symmetric)
