"""Hop distances and shortest paths."""

from __future__ import annotations

import heapq
import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.plans.partitioned import Adjacency, Blocks, local_search
from loomgraph.plans.superstep import Supersteps
from loomgraph.tables import Log, lies_by, stored_by

#: Fixed values at the compatibility boundary.
UNREACHED_HOPS, UNREACHED_DISTANCE = 4294967295, 2147483647


def _result(graph: Graph, reached: DataFrame) -> DataFrame:
    own = reached.select(F.col("id").alias("r_id"), "dist")
    return graph.vertices.join(own, F.col("id") == F.col("r_id"), "left").select("id", F.col("dist").cast("long").alias("value"))


def _by_source(graph: Graph, *columns: str) -> DataFrame:
    """The edges, stored by source: each round's join reads them where they lie."""
    return (graph.edges if lies_by(graph.edges, "src") else stored_by(graph.edges, "src", "edges")).select("src", "dst", *columns)


def _source(graph: Graph, source: int) -> DataFrame:
    return graph.vertices.where(F.col("id") == source).distinct().select("id", F.lit(0).cast("long").alias("value"), F.lit(0).alias("turn"))


def bfs(graph: Graph, source: int, direction: str = "auto", steps: Supersteps | None = None) -> DataFrame:
    """(id, value): hops from source along edges, NULL where it cannot be reached.

    A round expands the frontier by push (frontier join edges) or, if its out-edges are more than an eighth of all, by
    pull (vertices not yet reached that have an in-neighbour in the frontier); direction fixes one of them. Levels are
    appended to a log with their out-degrees, so a round is one job, which also counts what the next one decides by.
    """
    edges, steps = _by_source(graph), steps or Supersteps()
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    m = edges.count() if direction == "auto" else 0
    load = F.coalesce(F.sum("deg"), F.lit(0))
    levels = Log("id", "levels")

    def add(found: DataFrame, dealt: bool) -> dict:
        return levels.append(found.join(degrees, F.col("id") == F.col("src"), "left").select("id", "value", "turn", "deg"), dealt, load=load)

    size, turn = add(_source(graph, source), False), 0
    while size["n"] and turn != steps.max_rounds:
        began = time.time()
        reached = levels.read()
        front = reached.where(F.col("turn") == turn).select(F.col("id").alias("f_id"))
        found = front.join(edges, F.col("f_id") == F.col("src")).select(F.col("dst").alias("id"))
        if direction == "pull" or (direction == "auto" and 8 * (size["load"] or 0) > m):
            found = graph.vertices.join(reached.select("id"), "id", "left_anti").join(found, "id", "left_semi")
        else:
            found = found.distinct().join(reached.select("id"), "id", "left_anti")
        turn += 1
        size = add(found.select("id", F.lit(turn).cast("long").alias("value"), F.lit(turn).alias("turn")), True)
        steps.log.append((turn - 1, size["n"], time.time() - began))
    return _result(graph, levels.read().select("id", F.col("value").alias("dist")))


def bellman_ford(graph: Graph, source: int, steps: Supersteps | None = None) -> DataFrame:
    """(id, value): shortest distance from source; weights may be negative. Synchronous rounds, at most n of them.

    Without weights each edge counts 1. A round relaxes the out-edges of vertices that improved in the round before and
    appends what they improve; nothing that stands is written again.
    """
    graph = graph if graph.weighted else graph.with_unit_weights("int")
    edges, steps = _by_source(graph, "wgh"), steps or Supersteps(graph.vertices.count())
    dist = Log("id", "distances")
    size, turn = dist.append(_source(graph, source))["n"], 0
    while size and turn != steps.max_rounds:
        began = time.time()
        front = dist.read().where(F.col("turn") == turn)
        turn += 1
        size = dist.append(relax(front, edges, dist).withColumn("turn", F.lit(turn)), True)["n"]
        steps.log.append((turn - 1, size, time.time() - began))
    return _result(graph, dist.least().select("id", F.col("value").alias("dist")))


def relax(front: DataFrame, edges: DataFrame, dist: Log) -> DataFrame:
    """(id, value) of the vertices whose distance the frontier improves: one minimum for each destination."""
    offered = front.select(F.col("id").alias("f_id"), F.col("value").alias("f_value")).join(edges, F.col("f_id") == F.col("src"))
    best = offered.groupBy(F.col("dst").alias("id")).agg(F.min(F.col("f_value") + F.col("wgh")).cast("long").alias("value"))
    old = dist.least().select(F.col("id").alias("o_id"), F.col("value").alias("o_value"))
    return best.join(old, F.col("id") == F.col("o_id"), "left").where(F.col("o_value").isNull() | (F.col("value") < F.col("o_value"))).select("id", "value")


def weighted_bfs(graph: Graph, source: int, width: int = 1, steps: Supersteps | None = None) -> DataFrame:
    """(id, value): shortest distance from source for weights of at least 0, settled in order of distance.

    Each round relaxes all open vertices with less than the smallest open distance plus width. Open is a vertex whose
    distance came in the last round or is not below any bound so far; bounds never fall, so the last one tells.
    """
    graph = graph if graph.weighted else graph.with_unit_weights("int")
    edges, steps = _by_source(graph, "wgh"), steps or Supersteps()
    dist = Log("id", "distances")
    dist.append(_source(graph, source))
    turn, bound = 0, 0
    while turn != steps.max_rounds:
        began = time.time()
        opened = dist.least().where((F.col("turn") == turn) | (F.col("value") >= bound))
        low = opened.agg(F.min("value")).first()[0]
        if low is None:
            break
        bound, turn = low + width, turn + 1
        size = dist.append(relax(opened.where(F.col("value") < bound), edges, dist).withColumn("turn", F.lit(turn)), True)["n"]
        steps.log.append((turn - 1, size, time.time() - began))
    return _result(graph, dist.least().select("id", F.col("value").alias("dist")))


def local_distances(graph: Graph, source: int, hops: int | None = None, queue: int | None = None, steps: Supersteps | None = None, size: int | None = None) -> DataFrame:
    """(id, value): shortest distance from source for weights of at least 0 (without weights: hops), by local search.

    A round follows improvements inside each block, at most so many hops far and through a queue of so many vertices (None:
    until nothing improves), and offers distances to vertices of other blocks; what a bound left waits for the next round.
    """
    graph = graph if graph.weighted else graph.with_unit_weights("int")
    blocks = Blocks.build(graph.degrees(), graph.edges.select("src", "dst", "wgh"), ["id"], size=size)
    rows = local_search(blocks, relax_block(hops, queue), _source(graph, source), listening=False, steps=steps)
    return _result(graph, rows.groupBy("id").agg(F.min("value").alias("dist")))


def relax_block(hops: int | None, queue: int | None):
    """A kernel: rows that are no news are the block's vertices with the distances at which their edges were followed."""

    def kernel(block: Adjacency, mail: dict):
        never = np.iinfo(np.int64).max
        best, followed = np.full(len(block.ids), never), np.full(len(block.ids), never)
        at = block.index(mail["id"])
        np.minimum.at(best, at, mail["value"])
        np.minimum.at(followed, at[~mail["news"]], mail["value"][~mail["news"]])
        best, followed = best.tolist(), followed.tolist()
        inside, targets, weights, bounds = (x.tolist() for x in (block.index(block.targets), block.targets, block.of_edges("wgh"), block.bounds))
        heap = [(d, 0, i) for i, d in enumerate(best) if d < followed[i]]
        heapq.heapify(heap)
        done, waiting, offers = set(), set(), {}
        while heap:
            d, far, i = heapq.heappop(heap)
            if d > best[i] or d >= followed[i]:
                continue
            if (hops is not None and far >= hops) or (queue is not None and len(done) >= queue and i not in done):
                waiting.add(i)
                continue
            followed[i] = d
            done.add(i)
            for e in range(bounds[i], bounds[i + 1]):
                there, j = d + weights[e], inside[e]
                if j < 0:
                    if there < offers.get(targets[e], never):
                        offers[targets[e]] = there
                elif there < best[j]:
                    best[j] = there
                    heapq.heappush(heap, (there, far + 1, j))
        waiting = [i for i in waiting if best[i] < followed[i]]
        own = [*done, *waiting]
        values = [followed[i] for i in done] + [best[i] for i in waiting] + list(offers.values())
        again = np.zeros(len(values), bool)
        again[len(done) : len(own)] = True
        return np.concatenate([block.ids[own], np.array(list(offers), np.int64)]), np.array(values, np.int64), again

    return kernel


def with_sentinels(result: DataFrame, sentinel: int = UNREACHED_HOPS) -> DataFrame:
    return result.withColumn("value", F.coalesce("value", F.lit(sentinel)))
