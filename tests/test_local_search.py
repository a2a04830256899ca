"""Coloring, core numbers and distances by local search in blocks, and append-only state, against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph
from loomgraph.plans import coloring, cores, traversal
from loomgraph.plans.superstep import Supersteps
from loomgraph.tables import Log, stored_by

from .test_graph import both, color, dijkstra, graph, peel, values


def some_graph(n, m, seed):
    rng = random.Random(seed)
    pairs = {(min(a, b), max(a, b)) for a, b in ((rng.randrange(n), min(rng.randrange(n), rng.randrange(n))) for _ in range(m)) if a != b}
    return both(sorted(pairs))


EDGES = some_graph(60, 400, 1)


@pytest.fixture(scope="module")
def dense(spark):
    return graph(spark, EDGES, 62)


def test_coloring_in_blocks_of_any_size(dense):
    want = color(EDGES, 62)
    for size in (10**6, 200):
        steps = Supersteps()
        assert values(coloring.greedy_coloring(dense, steps=steps, size=size)) == want
        blocks = math.ceil((len(EDGES) + 62) / size)
        assert len(steps.log) <= blocks + 1


def test_log_degree_order_differs(dense):
    near = {v: [b for a, b in EDGES if a == v] for v in range(62)}
    weight, want = {v: math.ceil(math.log2(1 + len(x))) for v, x in near.items()}, {}
    for v in sorted(near, key=lambda v: (-weight[v], v)):
        used = {want[u] for u in near[v] if u in want}
        free = next(c for c in range(len(used) + 1) if c not in used)
        want[v] = free if free < len(near[v]) or not near[v] else len(near[v]) + 1
    got = values(coloring.greedy_coloring(dense, order="log_degree", size=150))
    assert got == want != values(coloring.greedy_coloring(dense, size=150))


def test_core_numbers_in_blocks(spark, dense):
    want = peel(EDGES, 62)
    few, many = Supersteps(), Supersteps()
    assert values(cores.core_numbers(dense, steps=few, size=300)) == want
    assert values(cores.peel(dense, steps=many).select("id", "value")) == want
    assert 3 * len(few.log) <= len(many.log)
    path = both([(i, i + 1) for i in range(12)])
    assert values(cores.core_numbers(graph(spark, path, 13), size=9)) == peel(path, 13)


def test_local_distances_with_bounds(spark):
    rng = random.Random(2)
    edges = some_graph(50, 90, 3) + [(i, i + 1) for i in range(50, 80)] + [(3, 50)]
    weights = [rng.randrange(5) for _ in edges]
    g = graph(spark, edges, 82, weights)
    near = dijkstra(edges, weights, 0)
    want = {v: near.get(v) for v in range(82)}
    for hops, queue, size in ((None, None, 60), (4, 8, 80)):
        assert values(traversal.local_distances(g, 0, hops, queue, size=size)) == want, (hops, queue, size)
    assert values(traversal.weighted_bfs(g, 0, width=2)) == values(traversal.bellman_ford(g, 0)) == want
    steps = Supersteps()
    assert set(values(traversal.local_distances(g, 99, steps=steps)).values()) == {None} and not steps.log


def test_large_ids_and_no_edges(spark):
    big = 1 << 60
    edges = spark.createDataFrame([(big, big + 1), (big + 1, big)], "src long, dst long")
    g = Graph.from_edges(edges, vertices=spark.range(big, big + 3).select("id"), symmetric=True).stored()
    assert values(coloring.greedy_coloring(g)) == {big: 0, big + 1: 2, big + 2: 0}
    assert values(cores.core_numbers(g)) == {big: 1, big + 1: 1, big + 2: 0}
    assert values(traversal.local_distances(g, big)) == {big: 0, big + 1: 1, big + 2: None}
    none = Graph.from_edges(edges.limit(0), 3).stored()
    assert values(coloring.greedy_coloring(none)) == values(cores.core_numbers(none)) == {0: 0, 1: 0, 2: 0}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange")


def test_rounds_read_edges_and_state_where_they_lie(spark, dense):
    log = Log("id", "test")
    assert log.append(spark.range(5).select("id", F.lit(7).cast("long").alias("value"), F.lit(0).alias("turn")))["n"] == 5
    assert log.append(spark.range(2).select("id", F.lit(3).cast("long").alias("value"), F.lit(1).alias("turn")), most=F.max("id")) == {"n": 2, "most": 1}
    assert {r.id: (r.value, r.turn) for r in log.least().collect()} == {0: (3, 1), 1: (3, 1), 2: (7, 0), 3: (7, 0), 4: (7, 0)}
    assert log.append(spark.range(0).select("id", F.lit(3).cast("long").alias("value"), F.lit(2).alias("turn")))["n"] == 0
    # Neither the log nor the edges move: only the offers are dealt out, once.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(log.least()) == 0
        better = traversal.relax(log.read(), stored_by(dense.edges.withColumn("wgh", F.lit(1)), "src", "edges"), log)
        assert exchanges(better) == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
