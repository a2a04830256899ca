"""The graph engine on small literal graphs and hash-random graphs, against plain Python."""

import heapq
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import hashing
from loomgraph.graph import Graph, random_graph
from loomgraph.operators import results as R
from loomgraph.operators import vertexset as V
from loomgraph.plans import coloring, components, cores, traversal
from loomgraph.sources import csr


def graph(spark, edges, n, weights=None):
    rows = [(a, b, *([weights[i]] if weights else [])) for i, (a, b) in enumerate(edges)]
    schema = "src long, dst long" + (", wgh int" if weights else "")
    return Graph.from_edges(spark.createDataFrame(rows, schema).coalesce(1), n).stored()


def both(edges):
    return [*edges, *[(b, a) for a, b in edges]]


def values(df):
    return {r["id"]: r["value"] for r in df.collect()}


def peel(edges, n):
    near, deg = defaultdict(list), [0] * n
    for a, b in edges:
        near[a].append(b)
        deg[a] += 1
    left, core, k = set(range(n)), {}, 0
    while left:
        v = min(left, key=lambda x: deg[x])
        k = max(k, deg[v])
        core[v] = k
        left.remove(v)
        for u in near[v]:
            deg[u] -= u in left
    return core


def color(edges, n):
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
    out = {}
    for v in sorted(range(n), key=lambda v: (-len(near[v]), v)):
        used = {out[u] for u in near[v] if u in out}
        free = [c for c in range(len(near[v])) if c not in used]
        out[v] = free[0] if free else (len(near[v]) + 1 if near[v] else 0)
    return out


def dijkstra(edges, weights, s):
    near = defaultdict(list)
    for (a, b), w in zip(edges, weights):
        near[a].append((b, w))
    dist, heap = {s: 0}, [(0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for u, w in near[v]:
            if d + w < dist.get(u, 1 << 60):
                dist[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return dist


def test_triangle_colors_take_degree_plus_one(spark):
    g = graph(spark, both([(0, 1), (0, 2), (1, 2)]), 3)
    assert values(coloring.greedy_coloring(g)) == {0: 0, 1: 1, 2: 3}
    assert values(cores.core_numbers(g)) == {0: 2, 1: 2, 2: 2}


def test_isolated_vertices_and_paths(spark):
    g = graph(spark, both([(0, 1)]), 4)
    assert values(traversal.bfs(g, 0)) == {0: 0, 1: 1, 2: None, 3: None}
    assert values(cores.core_numbers(g)) == {0: 1, 1: 1, 2: 0, 3: 0}
    assert values(coloring.greedy_coloring(g)) == {0: 0, 1: 2, 2: 0, 3: 0}
    assert values(traversal.with_sentinels(traversal.bfs(g, 0)))[3] == 4294967295


def test_star_loop_and_parallel_edges(spark):
    assert values(coloring.greedy_coloring(graph(spark, both([(0, i) for i in range(1, 5)]), 5))) == {0: 0, 1: 2, 2: 2, 3: 2, 4: 2}
    loop = graph(spark, [(0, 0), (0, 1), (1, 0)], 2)
    assert values(cores.core_numbers(loop)) == {0: 1, 1: 1} == {r["id"]: r["value"] for r in cores.peel(loop).collect()}
    twice = graph(spark, both([(0, 1), (0, 1)]), 2)
    assert values(cores.core_numbers(twice)) == {0: 2, 1: 2}
    assert values(cores.core_numbers(twice.symmetrize())) == {0: 1, 1: 1}
    assert tuple(twice.loops_and_parallel().first()) == (0, 2)


def test_shortest_paths(spark):
    negative = graph(spark, [(0, 1), (0, 2), (2, 1)], 3, [4, 1, -3])
    assert values(traversal.bellman_ford(negative, 0)) == {0: 0, 1: -2, 2: 1}
    tie = graph(spark, [(0, 1), (0, 2), (1, 2)], 3, [1, 2, 1])
    assert values(traversal.bellman_ford(tie, 0)) == values(traversal.weighted_bfs(tie, 0)) == {0: 0, 1: 1, 2: 2}


def test_no_edges(spark):
    g = graph(spark, [], 3)
    assert values(cores.core_numbers(g)) == values(coloring.greedy_coloring(g)) == {0: 0, 1: 0, 2: 0}
    assert values(components.connected_components(g)) == {0: 0, 1: 1, 2: 2}
    assert values(traversal.bfs(g, 1)) == {0: None, 1: 0, 2: None}


def test_directed_chain_by_push_pull_and_hops(spark):
    g = graph(spark, [(i, i + 1) for i in range(11)], 12)
    want = {i: i - 2 if i >= 2 else None for i in range(12)}
    assert values(traversal.bfs(g, 2)) == values(traversal.bfs(g, 2, direction="pull")) == values(traversal.local_distances(g, 2, hops=3)) == values(traversal.local_distances(g, 2, hops=1, queue=1, size=4)) == want


def test_random_graph_against_plain_python(spark):
    n = 60
    g = random_graph(spark, n, 240).with_generated_weights(n, 6).stored()
    rows = [(r["src"], r["dst"], r["wgh"]) for r in g.edges.collect()]
    edges, weights = [(a, b) for a, b, _ in rows], [w for *_, w in rows]
    dist = dijkstra(edges, weights, 0)
    want = {i: dist.get(i) for i in range(n)}
    assert values(traversal.bellman_ford(g, 0)) == values(traversal.weighted_bfs(g, 0, width=3)) == want
    assert values(cores.core_numbers(g)) == peel(edges, n)
    once = sorted({(a, b) for a, b in edges if a != b})
    simple = graph(spark, once, n)
    assert values(coloring.greedy_coloring(simple)) == color(once, n)
    order = [r["id"] for r in cores.degeneracy_order(simple).orderBy("pos").collect()]
    assert sorted(order) == list(range(n))


def test_vertex_sets(spark):
    s = V.VertexSet(spark.createDataFrame([(63,), (64,), (128,)], "id long"))
    assert s.blocks64().first()[0] == 3 and s.count().first()[0] == 3
    assert V.VertexSet.none(spark).max_of(spark.createDataFrame([(1, 2.0)], "id long, x double"), "x", -9.0).first()[0] == -9.0
    front = V.Frontier(spark)
    front.insert_next(s)
    assert front.advance() and front.for_each(spark.range(200)).count() == 3 and not front.advance()


def plain_hash32(a):
    m = 0xFFFFFFFF
    a = ((a + 0x7ED55D16) + (a << 12)) & m
    a = (a ^ 0xC761C23C) ^ (a >> 19)
    a = ((a + 0x165667B1) + (a << 5)) & m
    a = ((a + 0xD3A2646C) & m) ^ ((a << 9) & m)
    a = ((a + 0xFD7046C5) + (a << 3)) & m
    return (a ^ 0xB55A4F09) ^ (a >> 16)


def test_hashes(spark):
    got = {r["id"]: r["h"] for r in spark.range(500).select("id", hashing.hash32(F.col("id")).alias("h")).collect()}
    assert got[0] == 1800329511 and got[1] == 3028713910
    assert all(got[i] == plain_hash32(i) for i in got)
    z = (5 + 0x9E3779B9) & 0xFFFFFFFF
    z ^= z >> 15
    z = z * 0x85EBCA6B & 0xFFFFFFFF
    z ^= z >> 13
    z = z * 0xC2B2AE3D & 0xFFFFFFFF
    assert spark.range(5, 6).select(hashing.hash32_3(F.col("id"))).first()[0] == z ^ z >> 16
    assert sorted(hashing.random_permutation(100).tolist()) == list(range(100))


@pytest.mark.parametrize("weighted", [False, True])
def test_files_round_trip(spark, tmp_path, weighted):
    g = random_graph(spark, 40, 100)
    g = g.with_generated_weights(40) if weighted else g
    want = sorted(map(tuple, g.edges.collect()))
    path = str(tmp_path / "g_sym.bin")
    csr.write_binary(g, path)
    back = csr.read_graph(spark, path, "int" if weighted else None)
    assert back.symmetric and back.vertices.count() == 40 and sorted(map(tuple, back.edges.collect())) == want
    text = str(tmp_path / "h.adj")
    csr.write_adjacency(g, text)
    back = csr.read_adjacency(spark, text, "int" if weighted else None)
    assert not back.symmetric and sorted(map(tuple, back.edges.collect())) == want
    if not weighted:
        raw = open(path, "rb").read()
        with open(tmp_path / "two.bin", "wb") as out:
            out.write(raw * 2)
        assert all(sorted(map(tuple, x.edges.collect())) == want for x in csr.read_double(spark, str(tmp_path / "two.bin")))
    with pytest.raises(ValueError):
        csr.read_graph(spark, "x.txt")


def test_fingerprint_is_order_dependent(spark):
    a = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "id long, value long")
    b = spark.createDataFrame([(0, 2), (1, 1), (2, None)], "id long, value long")
    assert R.fingerprint(a) != R.fingerprint(b) and len(R.fingerprint(a)) == 8
    assert R.is_available(a, 0.5) and not R.is_available(a, 0.9)
    assert R.differences(a, b).count() == 4


def test_co_purchase_queries_see_all_suppliers(spark, tmp_path):
    """Lines of suppliers from 20 on: all cores, colors and components would be those of isolated vertices without them."""
    from loomgraph import queries
    from loomgraph.plans import coloring

    n, baskets = 9, [(0, 1, 2, 3), (3, 4), (5, 6, 7), (0, 1)]
    lines = [(o, p, 15 + 3 * i) for o, ps in enumerate(baskets) for i, p in enumerate(ps)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in range(n)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    edges = sorted({(a, b) for ps in baskets for a in ps for b in ps if a != b})
    run = lambda name: queries.QUERIES[name](spark, str(tmp_path))
    core, label = peel(edges, n), [0, 0, 0, 0, 0, 5, 5, 5, 8]
    assert values(run("kcore_peel")) == core
    assert values(run("coloring_lf_all")) == color(edges, n)
    log = values(run("coloring_llf_all"))
    assert log.keys() == set(range(n)) and log[8] == 0 and all(log[a] != log[b] for a, b in edges)
    assert values(run("cc_labels")) == dict(enumerate(label))
    assert {tuple(r) for r in run("cc_sizes").collect()} == {(0, 5), (5, 3), (8, 1)}
    assert {r.id for r in run("cc_largest").collect()} == {0, 1, 2, 3, 4}
    order = [r.id for r in sorted(run("degeneracy_order").collect())]
    assert sorted(order) == list(range(n))
    place = {v: i for i, v in enumerate(order)}
    later = [sum(place[b] > place[a] for x, b in edges if x == a) for a in order]
    assert max(later) == max(core.values()) == 3
    graph = queries.co_purchases(spark, str(tmp_path))
    assert coloring.conflicts(graph, run("coloring_lf_all")).first().n_conflicts == 0
    assert coloring.conflicts(graph, graph.vertices.selectExpr("id", "0L as value")).first().n_conflicts == 8


def test_ranks_over_sorted_parts(spark):
    """Hot groups, ties by position, null groups, and an empty table."""
    from loomgraph.operators import primitives as P

    rows = [(i, (i * 37) % 11, "a" if i % 3 else None, i % 5 == 0) for i in range(400)]
    df = spark.createDataFrame(rows, "pos long, v long, g string, flag boolean").repartition(7)
    got = {r.pos: r["rank"] for r in P.rank(df, "v", "pos", "g").collect()}
    for g in ("a", None):
        want = sorted((v, p) for p, v, h, _ in rows if h == g)
        assert [got[p] for _, p in want] == list(range(len(want)))
    side = {r.pos: r.new_pos for r in P.partition(df, F.col("flag"), "pos").collect()}
    assert side == {p: i for i, (_, p) in enumerate(sorted((f, p) for p, _, _, f in rows))}
    assert P.rank(df.where("false"), "v", "pos").count() == 0
    bound = {r.p: r.place for r in P.lower_bound(df, "v", spark.createDataFrame([(-1,), (4,), (4,), (99,)], "p long"), "p").collect()}
    assert bound == {-1: 0, 4: sum(v < 4 for _, v, _, _ in rows), 99: 400}
    assert {tuple(r) for r in P.bucket_offsets(df, "v").collect()} == {(k, sum(v < k for _, v, _, _ in rows), sum(v == k for _, v, _, _ in rows)) for k in range(11)}


def plain_hash64(x):
    m = 2**64 - 1
    v = (x * 3935559000370003845 + 2691343689449507681) & m
    v ^= v >> 21
    v ^= v << 37 & m
    v ^= v >> 4
    v = v * 4768777513237032717 & m
    v ^= v << 20 & m
    v ^= v >> 41
    return v ^ v << 5 & m


@pytest.mark.parametrize("n", [0, 1, 50, 9000])
def test_random_order(spark, n):
    from loomgraph.operators import sequences as S

    def knuth(xs, state):
        for i in range(len(xs) - 1, 0, -1):
            j = plain_hash64((i + state) % 2**64) % (i + 1)
            xs[i], xs[j] = xs[j], xs[i]
        return xs

    want = knuth(list(range(n)), 0)
    if n >= 8192:
        bits = (14 - 7) // 2
        want = [x for b in range(1 << bits) for x in knuth([i for i in range(n) if plain_hash64(i) % (1 << bits) == b], plain_hash64(plain_hash64(b)))]
    got = [r.value for r in S.random_order(spark, n).orderBy("pos").collect()]
    assert got == want


def test_sequence_edges(spark):
    from loomgraph.operators import sequences as S

    seq = lambda xs: spark.createDataFrame(list(enumerate(xs)), "pos long, v string")
    text, none = seq("abcabcab"), seq("")
    one = lambda df: tuple(df.first())
    assert one(S.find_span(text, seq("abc"), "v", "pos", 8)) == (0,) and one(S.find_span(text, seq("abc"), "v", "pos", 8, last=True)) == (3,)
    assert one(S.find_span(text, seq("ba"), "v", "pos", 8)) == (8,)
    assert one(S.find_span(text, none, "v", "pos", 8)) == (0,) and one(S.find_span(text, none, "v", "pos", 8, last=True)) == (8,)
    for a, b in [("abc", "abc"), ("ab", "abc"), ("abc", "ab"), ("abd", "abc"), ("", ""), ("", "a")]:
        assert one(S.compare(seq(a), seq(b), "v", "pos")) == (a == b, a < b)
    assert one(S.is_partitioned(none, F.col("v") == "a", "pos")) == (True,)
    assert one(S.find_first_of(text, seq("xcb"), "v", "pos", 8)) == (1,)


def test_results_are_recorded(spark, tmp_path):
    result = spark.createDataFrame([(0, 1), (1, 2), (2, None)], "id long, value long")
    empty = [spark.createDataFrame([], "name string")] * 2
    times, checks = R.record_result(result, 1.5, *empty, "g1", "bfs", dump=str(tmp_path / "dump"))
    assert tuple(times.first()) == ("g1", 1.5) and checks.first()["bfs"] == R.fingerprint(result)
    again, _ = R.record_result(result, 0.5, times, checks, "g1", "bfs")
    assert tuple(again.first()) == ("g1", 0.5) and spark.read.csv(str(tmp_path / "dump")).count() == 3


def test_two_block_file_and_weighing_tool(spark, tmp_path):
    g = random_graph(spark, 30, 80, symmetric=False)
    want = sorted(map(tuple, g.edges.collect()))
    one, two = str(tmp_path / "one.bin"), str(tmp_path / "two.bin")
    csr.write_binary(g, one)
    back = str(tmp_path / "back.bin")
    csr.write_binary(g.transpose(), back)
    with open(two, "wb") as out:
        out.write(open(one, "rb").read() + open(back, "rb").read())
    for path in (one, two):
        there, inverse = csr.read_both(spark, path)
        assert sorted(map(tuple, there.edges.collect())) == want and sorted((b, a) for a, b in inverse.edges.collect()) == want
    named = csr.write_weighted(spark, one, str(tmp_path), 5)
    assert named.endswith("one_wgh5.bin") and sorted(map(tuple, csr.read_graph(spark, named, "int").edges.collect())) == sorted(map(tuple, g.with_generated_weights(30, 5).edges.collect()))


def test_ranges_and_faults_of_binary_files(spark, tmp_path):
    """Ranges of seven edges cut the hub's edges and skip runs of vertices without any; spoilt files are told."""
    edges = [(0, 3), *[(50, i) for i in range(40)], (50, 3), (199, 0)]
    g, path = graph(spark, edges, 200), str(tmp_path / "g.bin")
    csr.write_binary(g, path)
    for split in (1, 7, 10**6):
        back = csr.read_binary(spark, path, split=split)
        assert sorted(map(tuple, back.edges.collect())) == sorted(edges) and back.vertices.count() == 200
    assert tuple(csr.check_layout(spark, path).first()) == (0, 0, 0)
    raw = np.fromfile(path, "<u8", 3 + 201)
    rest = np.fromfile(path, "<u4")[2 * len(raw) :]
    raw[3 + 10] = 999  # beyond the edges, and the next one is smaller
    rest[5], rest[-1] = 1, 777
    with open(path, "wb") as out:
        out.write(raw.tobytes() + rest.tobytes())
    assert tuple(csr.check_layout(spark, path).first()) == (1, 2, 1)
    with open(path, "wb") as out:
        out.write(np.array([5, 5, 5], "<u8").tobytes())
    with pytest.raises(ValueError):
        csr.read_binary(spark, path)
    none = str(tmp_path / "none.bin")
    csr.write_binary(graph(spark, [(0, 1)], 2).symmetrize().transpose(), none)
    assert sorted(map(tuple, csr.read_graph(spark, none).edges.collect())) == [(0, 1), (1, 0)]
    spread = [i["id"] for i in spark.range(3).select((F.col("id") * 2).alias("id")).collect()]
    holes = Graph.from_edges(spark.createDataFrame([(0, 2)], "src long, dst long"), vertices=spark.createDataFrame([(i,) for i in spread], "id long"))
    with pytest.raises(ValueError):
        csr.write_binary(holes, none)
