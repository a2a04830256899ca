"""Core numbers and peel orders of symmetric graphs."""

from __future__ import annotations

import time

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.operators.primitives import numbered
from loomgraph.plans.packed import Part, Parts, iterate
from loomgraph.plans.superstep import Supersteps
from loomgraph.session import materialize


def core_numbers(graph: Graph, steps: Supersteps | None = None, size: int | None = None) -> DataFrame:
    """(id, value): the core number.

    Numbers fall, from the degrees, until every vertex has as many neighbours with at least its number as that says. A round
    lets them fall inside each part of the graph as far as they can with what neighbours in other parts have at most, and
    tells these parts.
    """
    return iterate(Parts.build(graph.degrees(), graph.edges, size=size), part_degrees, fall, steps=steps).values()


def part_degrees(part: Part) -> np.ndarray:
    return part.degrees if not len(part.more) else np.maximum(part.degrees + part.more[0], 0)


def fall(part: Part, values: np.ndarray, news: np.ndarray | None) -> np.ndarray:
    """Numbers fall to the largest k for which so many neighbours (more[0]: plus those that never go) have at least k."""
    spare = part.more[0] if len(part.more) else np.zeros(part.n, np.int64)
    moved = np.zeros(part.n, bool)
    if news is None and part.owners:
        return np.flatnonzero(moved)  # numbers of neighbours in other parts come first
    # The second call is the first with numbers of all neighbours.
    open_ = np.arange(part.n) if news is None or (values[: part.n] == part_degrees(part)).all() else part.next_to(news)
    while len(open_):
        least = _supported(part, values, open_, spare[open_])
        less = least < values[open_]
        open_, least = open_[less], least[less]
        values[open_] = least
        moved[open_] = True
        near = part.slots[part.edges_of(open_)[1]]
        open_ = np.unique(near[near < part.n])
    return np.flatnonzero(moved)


def _supported(part: Part, values: np.ndarray, vertices: np.ndarray, spare: np.ndarray) -> np.ndarray:
    most = values[vertices].astype(np.int64)
    of, edges = part.edges_of(vertices)
    near, top = values[part.slots[edges]], most[of]
    # Neighbours of unknown number outlast all.
    near = np.where((near < 0) | (near > top), top, near)
    short = np.bincount(of[near == top], minlength=len(vertices)) + spare < most
    kept = short[of]
    of, near = of[kept], near[kept]
    # Of each vertex that falls, the neighbours' numbers from the largest on.
    width = int(near.max(initial=0)) + 1
    key = np.sort(of * width + (width - 1 - near))
    of, near = key // width, width - 1 - key % width
    first = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
    rank = np.arange(1, len(of) + 1) - np.repeat(first, np.diff(np.append(first, len(of))))
    out = np.where(short, np.minimum(np.maximum(spare, 0), most), most)
    if len(first):
        best = np.maximum.reduceat(np.minimum(near, spare[of] + rank), first)
        out[of[first]] = np.maximum(out[of[first]], best)
    return out


def peel(graph: Graph, load: DataFrame | None = None, steps: Supersteps | None = None, size: int | None = None) -> DataFrame:
    """(id, value, turn): core number and the round in which the vertex goes, bucket by bucket.

    load: (id, deg) to start from instead of the degrees. Each round removes all vertices whose count is at most k, the
    smallest count left or the k before if that is larger, and lowers the counts of their neighbours.

    The rounds are not gone through one by one. First come the numbers k, as core numbers do. Then all buckets run side by
    side: a vertex goes one step after as many neighbours of its own bucket have gone as it takes to bring its count to k.
    Both are local, so parts follow them as far as they can and tell each other. Rounds are the (k, step) in their order.
    """
    began, steps = time.time(), steps or Supersteps()
    degrees = graph.degrees()
    more = load.select(F.col("id").alias("l_id"), F.col("deg").alias("l_deg")) if load is not None else None
    if more is not None:
        degrees = degrees.join(more, F.col("id") == F.col("l_id")).select("id", "deg", (F.col("l_deg") - F.col("deg")).cast("long").alias("spare"))
    parts = Parts.build(degrees, graph.edges, ("spare",) if more is not None else (), size)
    numbers = iterate(parts, part_degrees, fall)
    depths = iterate(parts.change(numbers, own_bucket), lambda part: np.zeros(part.n, np.int64), wait, unknown=0)
    gone = numbers.values().join(depths.values().select(F.col("id").alias("d_id"), F.col("value").alias("step")), F.col("id") == F.col("d_id")).drop("d_id")
    gone = materialize(gone, "peeled")
    for used in (numbers, depths):
        used.discard()
    # One row for each round.
    rounds = sorted(tuple(r) for r in gone.groupBy("value", "step").agg(F.count(F.lit(1)).alias("n")).collect())
    steps.log += [(turn, n, (time.time() - began) / len(rounds)) for turn, (*_, n) in enumerate(rounds)]
    places = gone.sparkSession.createDataFrame([(k, step, turn) for turn, (k, step, _) in enumerate(rounds)], "r_value long, r_step long, turn int")
    return gone.join(F.broadcast(places), (F.col("value") == F.col("r_value")) & (F.col("step") == F.col("r_step"))).select("id", "value", "turn")


def own_bucket(part: Part, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to other vertices of the same number, and how many of these have to go before a vertex does."""
    source = np.repeat(np.arange(part.n), part.degrees)
    own, near = numbers[: part.n].astype(np.int64), numbers[part.slots]
    same = (near == own[source]) & (part.slots != source)
    # Neighbours of unknown number stay, and so does a vertex to itself.
    stays = ((near < 0) | (near > own[source]) | (part.slots == source)) & ~same
    left = np.bincount(source[same | stays], minlength=part.n) - own
    return same, left + (part.more[0] if len(part.more) else 0)


def wait(part: Part, values: np.ndarray, news: np.ndarray | None) -> np.ndarray:
    """Steps in which vertices go, if those of other parts go in the steps known so far, which are never too late.

    more[0]: how many neighbours must have gone in earlier steps.
    """
    before = values[: part.n].copy()
    lacks = part.more[0].copy()
    source = np.repeat(np.arange(part.n), part.degrees)
    away = np.flatnonzero(part.slots >= part.n)
    when = values[part.slots[away]]
    # Small numbers are sorted by their digits.
    order = away[np.argsort(when.astype(np.uint16) if when.max(initial=0) < 1 << 16 else when, kind="stable")]
    when, leaving = values[part.slots[order]], source[order]
    gone, step, at = np.zeros(part.n, bool), 0, 0
    going = np.flatnonzero(lacks <= 0)
    while True:
        values[going] = step
        gone[going] = True
        if at == len(when) and not len(going):
            break
        end = int(np.searchsorted(when, step, "right"))
        near = part.slots[part.edges_of(going)[1]]
        hit = np.concatenate([near[near < part.n], leaving[at:end]])
        at, step = end, step + 1
        if len(hit):
            np.subtract.at(lacks, hit, 1)
            hit = np.unique(hit)
            going = hit[(lacks[hit] <= 0) & ~gone[hit]]
        else:
            going = hit
            if at < len(when):
                step = max(step, int(when[at]))
    return np.flatnonzero(values[: part.n] != before)


def degeneracy_order(graph: Graph, load: DataFrame | None = None) -> DataFrame:
    """(pos, id): vertices in peel order, by id inside a round."""
    return numbered(peel(graph, load).select("turn", "id"), "turn", "id").select(F.col("place").alias("pos"), "id")
