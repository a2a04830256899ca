"""Greedy coloring in largest-degree-first order."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.hashing import log2_up
from loomgraph.graph import Graph
from loomgraph.plans.packed import Part, Parts, arrow_schema, deal_arrays, iterate, runs
from loomgraph.plans.superstep import Supersteps
from loomgraph.session import materialize

#: Edges of a part: parts settle one after the other, so there are fewer and larger ones; 16 MB as slots, as half of the edges count.
COLOR_EDGES = 1 << 23
#: Cells of the table in which free colors are looked up.
CELLS = 1 << 24


def greedy_coloring(graph: Graph, order: str = "degree", ties: DataFrame | None = None, steps: Supersteps | None = None, size: int | None = None) -> DataFrame:
    """(id, value): the smallest color below the degree that no neighbour of higher priority has, else degree + 1.

    Priority is the degree (order "degree") or its rounded-up logarithm ("log_degree"), then ties(id, rank), then the
    smaller id. Isolated vertices have color 0.

    Vertices get places in the order of priority; parts of the graph by id tell each other the places of their vertices and
    deal the edges to neighbours of higher priority to parts by place. A round settles in each of these all vertices whose
    higher neighbours have colors, level by level, and tells the parts that wait for them: every color once. The first part
    is settled by the first round, the second by the next at the latest, so there are no more rounds than parts, nor than levels.
    """
    ranked = graph.degrees().withColumn("back_weight", -(F.col("deg") if order == "degree" else log2_up(F.col("deg") + 1)))
    if ties is not None:
        ranked = ranked.join(ties.select(F.col("id").alias("t_id"), "rank"), F.col("id") == F.col("t_id")).drop("t_id")
    else:
        ranked = ranked.withColumn("rank", F.col("id"))
    placed, names, first = runs(ranked, ["back_weight", "rank", "id"], ("deg",), size or COLOR_EDGES, "place")
    by_id = Parts.build(placed.select("id", "deg", F.col("place").alias("spot")), graph.edges, ("spot",), size)
    places = iterate(by_id, lambda part: part.more[0], lambda part, values, news: np.zeros(0, np.int64))
    by_place = placed.select("part", F.col("place").alias("id"), "deg")
    parts = Parts.of(by_place, by_id.spread(places, edges_before(names, first), "part long, src binary, dst binary"), names, first, ("deg",))
    places.discard()
    colors = iterate(parts, lambda part: np.full(part.n, -1, np.int64), settle_colors, steps=steps)
    return placed.join(colors.values().select(F.col("id").alias("c_place"), "value"), F.col("place") == F.col("c_place")).select("id", "value")


def edges_before(names: np.ndarray, first: np.ndarray):
    """The edges of a part to neighbours of higher priority, from place to place, for the parts by place."""

    def work(part: Part, places: np.ndarray):
        source, near = places[: part.n].repeat(part.degrees), places[part.slots]
        kept = (near >= 0) & (near < source)
        return deal_arrays(source[kept].astype(np.int64), near[kept].astype(np.int64), names, first)

    return work


def settle_colors(part: Part, values: np.ndarray, news: np.ndarray | None) -> np.ndarray:
    """Colors of the vertices that can have one now."""
    source = np.repeat(np.arange(part.n, dtype=np.int32), part.degrees)
    lacks = np.bincount(source[values[part.slots] < 0], minlength=part.n)
    going, settled = np.flatnonzero((values[: part.n] < 0) & (lacks == 0)), []
    inside = np.flatnonzero(part.slots < part.n)
    inside = inside[np.argsort(part.slots[inside])]
    waiting, bounds = source[inside], np.concatenate([[0], np.cumsum(np.bincount(part.slots[inside], minlength=part.n))])
    while len(going):
        values[going] = free_colors(part, values, going)
        settled.append(going)
        n = bounds[going + 1] - bounds[going]
        hit = waiting[np.arange(n.sum()) + np.repeat(bounds[going] - (np.cumsum(n) - n), n)]
        np.subtract.at(lacks, hit, 1)
        hit = np.unique(hit)
        going = hit[lacks[hit] == 0]
    return np.concatenate(settled) if settled else going


def free_colors(part: Part, values: np.ndarray, vertices: np.ndarray) -> np.ndarray:
    degrees, n = part.more[0][vertices], part.degrees[vertices]
    of, edges = part.edges_of(vertices)
    near, ends = values[part.slots[edges]], np.cumsum(n)
    # As many candidates as there are neighbours, plus one, hold a free color.
    width = min(int(near.max(initial=0)) + 2, int(n.max(initial=0)) + 1)
    free = np.zeros(len(vertices), np.int64)
    step = max(1, CELLS // width)
    for a in range(0, len(vertices), step):
        b = min(a + step, len(vertices))
        own = slice(int(ends[a] - n[a]), int(ends[b - 1]))
        low = near[own] < width
        taken = np.zeros((b - a, width), bool)
        taken[of[own][low] - a, near[own][low]] = True
        free[a:b] = np.argmin(taken, 1)
    return np.where((free < degrees) | (degrees == 0), free, degrees + 1)


def conflicts(graph: Graph, colors: DataFrame) -> DataFrame:
    """One row, n_conflicts: vertices with a neighbour of their own color (self-loops aside)."""
    a, b = (colors.select(F.col("id").alias(f"{e}_id"), F.col("value").alias(f"{e}_value")) for e in "ab")
    same = graph.edges.where("src <> dst").join(a, F.col("src") == F.col("a_id")).join(b, F.col("dst") == F.col("b_id")).where("a_value = b_value")
    return same.agg(F.count_distinct("src").alias("n_conflicts"))
