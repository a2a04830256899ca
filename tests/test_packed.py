"""Coloring, core numbers and peel rounds on packed parts, against plain Python."""

import pytest
from pyspark.sql import functions as F

from loomgraph.graph import Graph, once_by_source
from loomgraph.plans import coloring, cores
from loomgraph.plans.superstep import Supersteps

from .test_graph import both, color, graph, values
from .test_local_search import EDGES, dense, exchanges  # noqa: F401 - a fixture


def jobs(spark, name, f):
    spark.sparkContext.setJobGroup(name, name)
    try:
        f()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_coloring_keeps_a_part_in_one_row_and_tells_each_color_once(dense):  # noqa: F811
    from loomgraph.plans.packed import Parts, iterate, runs

    parts = Parts.build(dense.degrees(), dense.edges, size=200)
    assert parts.table.count() == len(parts.names) > 2
    told = iterate(parts, lambda part: part.ids, lambda part, values, news: part.ids[:0], steps=Supersteps(1)).tables[0].where("giver >= 0")
    assert 0 < told.count() <= len(parts.names) * (len(parts.names) - 1)
    placed, names, first = runs(dense.degrees(), ["deg", "id"], ("deg",), 200, "place")
    assert len(names) == len(first) == placed.select("part").distinct().count()
    assert values(coloring.greedy_coloring(dense, size=120)) == color(EDGES, 62)


def test_ends_that_are_no_vertices(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 9), (9, 2), (5, 1), (1, 5)], "src long, dst long")
    g = Graph.from_edges(edges, vertices=spark.range(1, 4).select("id"), symmetric=True).stored()
    assert values(coloring.greedy_coloring(g, size=2)) == {1: 0, 2: 1, 3: 0}
    assert values(cores.core_numbers(g, size=2)) == values(cores.peel(g, size=2).select("id", "value")) == {1: 2, 2: 2, 3: 0}


def test_edges_once_by_source(spark):
    rows = once_by_source(spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 3)], "src long, dst long"))
    assert exchanges(rows) == 1
    assert sorted(map(tuple, rows.collect())) == [(1, 2), (2, 1), (3, 3)]


def peel_rounds(edges, n, load=None):
    """{id: (k, turn)}, round by round."""
    near = {v: [b for a, b in edges if a == v] for v in range(n)}
    left, k, turn, out = dict(load or {v: len(x) for v, x in near.items()}), 0, 0, {}
    while left:
        k = max(k, min(left.values()))
        going = [v for v, d in left.items() if d <= k]
        for v in going:
            del left[v]
            out[v] = (k, turn)
        for v in going:
            for u in near[v]:
                if u in left:
                    left[u] -= 1
        turn += 1
    return out


@pytest.mark.parametrize("size", [10**6, 150])
def test_peel_rounds_and_loads(spark, dense, size):  # noqa: F811
    for edges, n, load in ((EDGES, 62, None), (EDGES, 62, {v: 7 * v % 31 - 2 for v in range(62)}), ([(0, 0), (0, 1), (1, 0), (1, 2), (2, 1), (1, 2), (2, 1)], 4, None)):
        g, want, steps = dense if n == 62 else graph(spark, edges, n), peel_rounds(edges, n, load), Supersteps()
        start = spark.createDataFrame(sorted(load.items()), "id long, deg long") if load else None
        got = {r["id"]: (r["value"], r["turn"]) for r in cores.peel(g, start, steps, size).collect()}
        assert got == want
        assert [n for _, n, _ in steps.log] == [sum(t == i for _, t in want.values()) for i in range(len(steps.log))]


def test_long_peel_takes_few_jobs(spark):
    """A path of 120 vertices goes from both ends in 60 rounds."""
    edges = both([(i, i + 1) for i in range(119)])
    g = graph(spark, edges, 120)
    got = []
    assert jobs(spark, "peel", lambda: got.extend(cores.peel(g).collect())) < 60
    assert {r["id"]: r["turn"] for r in got} == {i: min(i, 119 - i) for i in range(120)}


def test_significant_digits_are_multiples_of_the_last_one(spark):
    """As in SQL: the number of units of the last digit, times the unit."""
    from loomgraph.operators.results import significant

    rows = spark.createDataFrame([(x,) for x in (62.3, -62.34, 0.0, 1234.5, 999.5, 0.30012, None)], "x double").select("x", significant(F.col("x")).alias("v"))
    want = {62.3: 623 * 0.1, -62.34: -623 * 0.1, 0.0: 0.0, 1234.5: 123 * 10.0, 999.5: 1000.0, 0.30012: 300 * 0.001, None: None}
    assert {r.x: r.v for r in rows.collect()} == want
