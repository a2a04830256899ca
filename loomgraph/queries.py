"""The registered queries of the graph engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import hashing, strings
from loomgraph.graph import Graph, once_by_source, random_graph
from loomgraph.operators import monoids as M
from loomgraph.operators import primitives as P
from loomgraph.operators import results as R
from loomgraph.operators import vertexset as V
from loomgraph.plans import coloring, components, cores, traversal
from loomgraph.plans.superstep import Supersteps
from loomgraph.session import ensure_importable, shuffle_partitions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- graphs of the driver's tables


def customer_parts(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Graph:
    """Customers and the parts that they ordered, both directions; parts follow the customers."""
    customers, parts = (table(spark, sf_dir, t).count() for t in ("customer", "part"))
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("src"), (F.col("l_partkey") + customers).alias("dst"))
    n = customers + parts
    both = pairs.select(F.inline(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))))
    graph = Graph.from_edges(once_by_source(both), n, symmetric=True)
    return (graph.with_generated_weights(n, 8) if weighted else graph).stored(dealt=True)


def co_purchases(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts that stand in one order."""
    n, lines = table(spark, sf_dir, "part").count(), table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    lines = lines.repartition(shuffle_partitions(spark), "l_orderkey").distinct()  # for the join, too
    a, b = lines.select("l_orderkey", F.col("l_partkey").alias("src")), lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return Graph.from_edges(once_by_source(a.join(b, "l_orderkey").where("src <> dst").select("src", "dst")), n, symmetric=True).stored(dealt=True)


def event_chains(spark: SparkSession, sf_dir: str) -> Graph:
    events = table(spark, sf_dir, "events")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    edges = events.select(F.col("event_id").alias("src"), after.alias("dst")).where("dst is not null")
    return Graph.from_edges(edges, vertices=events.select(F.col("event_id").alias("id"))).stored()


def event_neighbours(spark: SparkSession, sf_dir: str) -> Graph:
    """Consecutive events of one user, both directions."""
    return event_chains(spark, sf_dir).symmetrize().stored()


def hash32_sql(source: str, column: str, name: str) -> str:
    """Nested selects that add name, the 32-bit hash of column."""
    out, mask = f"select *, ({column})::bigint & 4294967295 as {name} from ({source})", 4294967295
    for constant, first, second, direction, by in hashing.HASH32_STEPS:
        moved = f"(({name} << {by}) & {mask})" if direction == "<<" else f"({name} >> {by})"
        one = f"(({name} + {constant}) & {mask})" if first == "+" else f"xor({name}, {constant}::bigint)"
        both = f"(({one} + {moved}) & {mask})" if second == "+" else f"xor({one}, {moved})"
        out = f"select * replace ({both} as {name}) from ({out})"
    return out


F1 = """nc as (select count(*) n from customer),
 pr as (select distinct o.o_custkey a, nc.n + l.l_partkey b from orders o join lineitem l on l.l_orderkey = o.o_orderkey, nc),
 e as (select a src, b dst from pr union all select b, a from pr),
 vs as (select unnest(range((select count(*) from customer) + (select count(*) from part))) id)"""
F2 = """ln as (select distinct l_orderkey o, l_partkey p from lineitem),
 e as (select distinct x.p src, y.p dst from ln x join ln y on x.o = y.o where x.p <> y.p),
 vs as (select unnest(range((select count(*) from part))) id)"""
F3 = """e as (select src, dst from (select event_id src, lead(event_id) over (partition by user_id order by ts, event_id) dst from events) where dst is not null),
 vs as (select event_id id from events)"""
F3S = """c as (select event_id src, lead(event_id) over (partition by user_id order by ts, event_id) dst from events),
 e as (select src, dst from c where dst is not null union select dst, src from c where dst is not null), vs as (select event_id id from events)"""
W1 = f"""{F1}, w as (select src, dst, (1 + xor(hs, hd) % 8)::int wgh from ({hash32_sql(hash32_sql("select * from e", "src", "hs"), "dst", "hd")}))"""
BFS = """b(v, d) using key (v) as (select 0::bigint, 0 union select e.dst, min(b.d + 1) from b join e on e.src = b.v
 left join recurring.b r on r.v = e.dst where r.v is null group by e.dst)"""
SSSP = """b(v, d) using key (v) as (select 0::bigint, 0::bigint union select w.dst, min(b.d + w.wgh) from b join w on w.src = b.v
 left join recurring.b r on r.v = w.dst group by w.dst, r.d having r.d is null or min(b.d + w.wgh) < r.d)"""
CORE = """k(v, c) using key (v) as (select src, count(*)::bigint from e group by 1 union select v, h from (
 select x.src v, max(least(rk, nc)) h, any_value(oc) oc from (select e.src, n.c nc, o.c oc, row_number() over (partition by e.src order by n.c desc) rk
 from e join recurring.k n on n.v = e.dst join recurring.k o on o.v = e.src where (select count(*) from k) > 0) x group by 1) where h < oc)"""
CC = """k(v, l) using key (v) as (select distinct src, src from e union select e.dst, min(k.l) from k join e on e.src = k.v
 join recurring.k r on r.v = e.dst group by e.dst, r.l having min(k.l) < r.l)"""
ALL_BFS = "select vs.id::bigint id, b.d::bigint value from vs left join b on b.v = vs.id"


#: An odd factor: ranks modulo 2**32 that differ for ids below that and have no order along a chain.
RANK = 2654435761


def ranks(graph: Graph) -> DataFrame:
    return graph.vertices.select("id", (F.col("id") * F.lit(RANK) % F.lit(1 << 32)).alias("rank"))


def color_sql(weight: str, rank: str = f"(src * {RANK}) % 4294967296") -> str:
    return f"""dg as (select src v, count(*) d, {weight} wt, {rank} rk from e group by 1),
 p as (select e.src, e.dst from e join dg a on a.v = e.src join dg b on b.v = e.dst where b.wt > a.wt or (b.wt = a.wt and b.rk < a.rk)),
 np as (select dg.v, dg.d, count(p.dst) n from dg left join p on p.src = dg.v group by 1, 2),
 col(v, c) using key (v) as (select v, 0::bigint from np where n = 0 union
 select v, coalesce(list_min(list_filter(range(d), lambda x: not list_contains(cs, x))), d + 1) from (select np.v, np.d, list(distinct r.c) cs
 from np join p on p.src = np.v join recurring.col r on r.v = p.dst left join recurring.col self on self.v = np.v
 where self.v is null and (select count(*) from col) > 0 group by np.v, np.d, np.n having count(*) = np.n))"""


# ---------------------------------------------------------------- traversal


@query(f"with recursive {F1}, {BFS} {ALL_BFS}")
def bfs_hops(spark, sf_dir):
    return traversal.bfs(customer_parts(spark, sf_dir), 0)


@query(f"with recursive {F1}, {BFS} {ALL_BFS}")
def bfs_pull(spark, sf_dir):
    return traversal.bfs(customer_parts(spark, sf_dir), 0, direction="pull")


@query(f"with recursive {F3}, {BFS} {ALL_BFS}")
def bfs_multihop(spark, sf_dir):
    return traversal.local_distances(event_chains(spark, sf_dir), 0, hops=8, queue=4096)


@query(f"with recursive {F1}, {BFS} select coalesce(d, -1)::bigint hops, count(*) n from vs left join b on b.v = vs.id group by 1")
def bfs_levels_hist(spark, sf_dir):
    return P.histogram_by_key(traversal.bfs(customer_parts(spark, sf_dir), 0).select(F.coalesce("value", F.lit(-1)).alias("hops")), "hops")


@query(f"with recursive {F1}, {BFS} select count(*) n, count(d) n_reached, max(d)::bigint farthest from vs left join b on b.v = vs.id")
def bfs_coverage(spark, sf_dir):
    return R.coverage(traversal.bfs(customer_parts(spark, sf_dir), 0))


@query(f"with recursive {W1}, {SSSP} select vs.id::bigint id, b.d value from vs left join b on b.v = vs.id")
def sssp_bellman_ford(spark, sf_dir):
    return traversal.bellman_ford(customer_parts(spark, sf_dir, weighted=True), 0)


@query(f"with recursive {F1}, {BFS} {ALL_BFS}")
def sssp_unit_weights(spark, sf_dir):
    return traversal.bellman_ford(customer_parts(spark, sf_dir).with_unit_weights("int"), 0)


@query(f"with recursive {W1}, {SSSP} select vs.id::bigint id, b.d value from vs left join b on b.v = vs.id")
def sssp_local(spark, sf_dir):
    return traversal.local_distances(customer_parts(spark, sf_dir, weighted=True), 0)


@query(f"with recursive {W1}, {SSSP} select vs.id::bigint id, b.d value from vs left join b on b.v = vs.id")
def wbfs_min_bucket(spark, sf_dir):
    return traversal.weighted_bfs(customer_parts(spark, sf_dir, weighted=True), 0)


@query(f"with recursive {W1}, {SSSP} select vs.id::bigint id, b.d value from vs left join b on b.v = vs.id")
def wbfs_delta(spark, sf_dir):
    return traversal.weighted_bfs(customer_parts(spark, sf_dir, weighted=True), 0, width=4)


# ---------------------------------------------------------------- cores, colors, components


@query(f"with recursive {F1}, {CORE} select vs.id::bigint id, coalesce(k.c, 0)::bigint value from vs left join k on k.v = vs.id")
def kcore(spark, sf_dir):
    return cores.core_numbers(customer_parts(spark, sf_dir))


@query(f"with recursive {F2}, {CORE} select vs.id::bigint id, coalesce(k.c, 0)::bigint value from vs left join k on k.v = vs.id")
def kcore_peel(spark, sf_dir):
    return cores.peel(co_purchases(spark, sf_dir)).select("id", "value")


@query(f"with recursive {F2}, {CORE} select vs.id::bigint id, coalesce(k.c, 0)::bigint value from vs left join k on k.v = vs.id")
def kcore_local(spark, sf_dir):
    """Local search in small blocks, so that there are several at any size."""
    return cores.core_numbers(co_purchases(spark, sf_dir), size=1 << 16)


@query(f"with recursive {F1}, {CORE} select coalesce(k.c, 0)::bigint core, count(*) n from vs left join k on k.v = vs.id group by 1")
def kcore_hist(spark, sf_dir):
    return P.histogram_by_key(cores.core_numbers(customer_parts(spark, sf_dir)).select(F.col("value").alias("core")), "core")


def peel_sql(load: str) -> str:
    """p(v, d, t, k): the round t in which v goes, with bound k, if counts start with load (c: the degree)."""
    bound = "(select greatest(max(k), min(d) filter (where t is null)) kk, coalesce(max(t), -1) + 1 tt from recurring.p)"
    return f"""p(v, d, t, k) using key (v) as (select vs.id, {load}, null::int, 0::bigint from vs left join (select src, count(*)::bigint c from e group by 1) on src = vs.id union
 select a.v, a.d - coalesce(l.n, 0), case when a.d <= g.kk then g.tt end, case when a.d <= g.kk then g.kk else 0 end from recurring.p a cross join {bound} g
 left join (select e.src, count(*)::bigint n from e join recurring.p x on x.v = e.dst cross join {bound} y where x.t is null and x.d <= y.kk group by 1) l on l.src = a.v
 where a.t is null and (a.d <= g.kk or l.n > 0) and (select count(*) from p) > 0)"""


@query(f"with recursive {F2}, {peel_sql('coalesce(c, 0)')} select (row_number() over (order by t, v) - 1)::bigint pos, v::bigint id from p")
def degeneracy_order(spark, sf_dir):
    return cores.degeneracy_order(co_purchases(spark, sf_dir))


@query(f"with recursive {F2}, {peel_sql('coalesce(c, 0) + p_size')} select (row_number() over (order by t, v) - 1)::bigint pos, v::bigint id from p".replace("from vs left join", "from vs join part on p_partkey = vs.id left join"))
def degeneracy_order_load(spark, sf_dir):
    """Counts start at the degree plus the part's size: large parts go later."""
    graph = co_purchases(spark, sf_dir)
    sizes = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return cores.degeneracy_order(graph, graph.degrees().join(sizes, "id").select("id", (F.col("deg") + F.col("p_size")).alias("deg")))


@query(f"with recursive {F1}, {peel_sql('coalesce(c, 0)')} select t round, count(*) frontier_size from p group by 1")
def kcore_round_log(spark, sf_dir):
    steps = Supersteps()
    cores.peel(customer_parts(spark, sf_dir), steps=steps)
    return steps.rounds(spark).select("round", "frontier_size")


COLORS = "select vs.id::bigint id, coalesce(col.c, 0)::bigint value from vs left join col on col.v = vs.id"
LOG_DEGREE = "ceil(log2(1 + count(*)))"


@query(f"with recursive {F2}, {color_sql('count(*)')} {COLORS}")
def coloring_lf(spark, sf_dir):
    graph = co_purchases(spark, sf_dir)
    return coloring.greedy_coloring(graph, ties=ranks(graph))


@query(f"with recursive {F2}, {color_sql(LOG_DEGREE)} {COLORS}")
def coloring_llf(spark, sf_dir):
    graph = co_purchases(spark, sf_dir)
    return coloring.greedy_coloring(graph, order="log_degree", ties=ranks(graph))


@query(f"with recursive {F2}, {color_sql('count(*)', 'src')} {COLORS}")
def coloring_lf_all(spark, sf_dir):
    return coloring.greedy_coloring(co_purchases(spark, sf_dir))


@query(f"with recursive {F2}, {color_sql(LOG_DEGREE, 'src')} {COLORS}")
def coloring_llf_all(spark, sf_dir):
    return coloring.greedy_coloring(co_purchases(spark, sf_dir), order="log_degree")


@query(f"with recursive {F2}, {color_sql('count(*)')}, cs as ({COLORS}) select count(distinct src) filter (where a.value = b.value)::bigint n_conflicts from e join cs a on a.id = src join cs b on b.id = dst")
def coloring_verify(spark, sf_dir):
    graph = co_purchases(spark, sf_dir)
    return coloring.conflicts(graph, coloring.greedy_coloring(graph, ties=ranks(graph)))


@query(f"with {F3S} select count(distinct src)::bigint n_conflicts from e where src % 3 = dst % 3")
def coloring_conflicts(spark, sf_dir):
    """A coloring that is not one: ids modulo 3."""
    graph = event_neighbours(spark, sf_dir)
    return coloring.conflicts(graph, graph.vertices.select("id", (F.col("id") % 3).alias("value")))


@query(f"with recursive {F2}, {CC} select vs.id::bigint id, coalesce(k.l, vs.id)::bigint value from vs left join k on k.v = vs.id")
def cc_labels(spark, sf_dir):
    return components.connected_components(co_purchases(spark, sf_dir))


@query(f"with recursive {F2}, {CC}, lb as (select vs.id, coalesce(k.l, vs.id) l from vs left join k on k.v = vs.id) select l::bigint component, count(*) n from lb group by 1")
def cc_sizes(spark, sf_dir):
    return components.component_sizes(co_purchases(spark, sf_dir))


@query(
    f"""with recursive {F2}, {CC}, lb as (select vs.id, coalesce(k.l, vs.id) l from vs left join k on k.v = vs.id)
 select id::bigint id from lb where l = (select l from lb group by l order by count(*) desc, l limit 1)"""
)
def cc_largest(spark, sf_dir):
    return components.largest_component(co_purchases(spark, sf_dir))


# ---------------------------------------------------------------- graph construction


@query(f"with {F1} select vs.id::bigint id, count(e.src) deg from vs left join e on e.src = vs.id group by 1")
def graph_degrees(spark, sf_dir):
    return customer_parts(spark, sf_dir).degrees()


@query(f"with {F1}, d as (select vs.id, count(e.src) deg from vs left join e on e.src = vs.id group by 1) select id::bigint id, (sum(deg) over (order by id) - deg)::bigint as \"first\", deg from d")
def graph_csr_offsets(spark, sf_dir):
    return customer_parts(spark, sf_dir).offsets()


@query(f"with {F3} select dst src, src dst from e")
def graph_transpose(spark, sf_dir):
    return event_chains(spark, sf_dir).transpose().edges


@query(f"with {F3} select src, dst from e where src <> dst union select dst, src from e where src <> dst")
def graph_symmetrize(spark, sf_dir):
    return event_chains(spark, sf_dir).symmetrize().edges


@query(f"with {W1} select src::bigint src, dst::bigint dst, wgh from w")
def graph_weights(spark, sf_dir):
    return customer_parts(spark, sf_dir, weighted=True).edges


@query("select count(case when l_partkey = l_suppkey then 1 end) n_loops, count(*) - count(distinct (l_partkey, l_suppkey)) n_parallel from lineitem")
def graph_loops_parallel(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return Graph.from_edges(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))).loops_and_parallel()


@query(f"with {F3}, c as (select count(*) m from e) select 0::bigint n_loops, 0::bigint n_parallel, 0::bigint n_foreign, m n_one_way from c")
def graph_validate(spark, sf_dir):
    return event_chains(spark, sf_dir).validate()


_RANDOM = hash32_sql(hash32_sql("select unnest(range((select count(*) // 2 from orders)))::bigint i", "2 * i", "a"), "2 * i + 1", "b")


@query(f"with n as (select count(*) n from customer), r as (select (a % n)::bigint src, (b % n)::bigint dst from ({_RANDOM}), n) select src, dst from r union all select dst, src from r")
def graph_random(spark, sf_dir):
    """As many vertices as customers and edges as orders, to compare with the real graph of that size."""
    return random_graph(spark, table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "orders").count()).edges


_DIRECTED = hash32_sql(hash32_sql(f"select *, (a % n)::bigint s, (b % n)::bigint t from ({_RANDOM}), (select count(*) n from customer)", "s", "sh"), "t", "th")


@query(f"with r as ({_DIRECTED}) select s src, t dst from r union all select (sh % n)::bigint, (th % n)::bigint from r")
def graph_random_directed(spark, sf_dir):
    return random_graph(spark, table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "orders").count(), symmetric=False).edges


@query(f"with {F1} select src::bigint src, dst::bigint dst, 1::float wgh from e")
def graph_unit_weights(spark, sf_dir):
    return customer_parts(spark, sf_dir).with_unit_weights().edges


_LOG = f"""{F1}, w as (select src, dst, (1 + xor(hs, hd) % (select greatest(1, floor(log2(count(*))))::bigint from vs))::int wgh from ({hash32_sql(hash32_sql("select * from e", "src", "hs"), "dst", "hd")}))"""


@query(f"with {_LOG} select src::bigint src, dst::bigint dst, wgh from w")
def graph_weights_log(spark, sf_dir):
    graph = customer_parts(spark, sf_dir)
    return graph.with_generated_weights(graph.vertices.count()).edges


# ---------------------------------------------------------------- vertex sets and priority maps


def _customers(spark, sf_dir, where: str = "true") -> V.VertexSet:
    return V.VertexSet(table(spark, sf_dir, "customer").where(where).select(F.col("c_custkey").alias("id")))


def _balance(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", "c_nationkey")


@query("select count(*) \"value\" from customer where c_nationkey < 10")
def vs_count(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey < 10").count()


@query("select count(distinct c_custkey >> 6) \"value\" from customer where c_nationkey = 3")
def vs_blocks64(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey = 3").blocks64()


@query(f"with {F1}, d as (select src, count(*) deg from e group by 1) select coalesce(sum(deg), 0)::bigint \"value\" from customer left join d on src = c_custkey where c_nationkey = 3")
def vs_edge_sum(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey = 3").edge_sum(customer_parts(spark, sf_dir).degrees())


@query("select c_custkey id, (count(*) filter (where c_nationkey < 10) over (order by c_custkey) - (c_nationkey < 10)::int)::bigint rank from customer")
def vs_rank(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey < 10").rank(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")))


@query("select k, c_custkey id from (select c_custkey, row_number() over (order by c_custkey) - 1 k from customer where c_nationkey < 10) where k in (select s_suppkey from supplier)")
def vs_select(spark, sf_dir):
    """The customer of each supplier's number, among those of the first ten nations."""
    return _customers(spark, sf_dir, "c_nationkey < 10").select(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


@query("select min(c_acctbal) \"value\" from customer where c_nationkey = 3")
def vs_min_attr(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey = 3").min_of(_balance(spark, sf_dir), "c_acctbal", 1.7976931348623157e308)


@query("select -1.5::double \"value\"")
def vs_max_attr_of_none(spark, sf_dir):
    return _customers(spark, sf_dir, "false").max_of(_balance(spark, sf_dir), "c_acctbal", -1.5)


@query("select bit_xor(c_nationkey::bigint) \"value\" from customer where c_custkey % 3 = 0")
def vs_reduce_custom(spark, sf_dir):
    return _customers(spark, sf_dir, "c_custkey % 3 = 0").reduce(_balance(spark, sf_dir), F.bit_xor, F.col("c_nationkey").cast("long"), 0)


@query("select c_custkey id from customer where c_nationkey < 5 union select c_custkey from customer where c_nationkey in (3, 9)")
def vs_union(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey < 5").insert(_customers(spark, sf_dir, "c_nationkey in (3, 9)")).ids


@query("select c_custkey id from customer where c_nationkey < 5 except select c_custkey from customer where c_custkey % 2 = 0")
def vs_diff(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey < 5").remove(_customers(spark, sf_dir, "c_custkey % 2 = 0")).ids


@query("select c_custkey id from customer where c_nationkey < 5 intersect select c_custkey from customer where c_custkey % 2 = 0")
def vs_intersect(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey < 5").intersect(_customers(spark, sf_dir, "c_custkey % 2 = 0")).ids


@query("select o_orderkey id from orders where o_orderkey in (select c_custkey from customer where c_nationkey < 5)")
def vs_contains(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey < 5").contains(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")))


@query("select c_custkey id from customer where c_nationkey in (7, 9) and c_nationkey <> 9")
def vs_newly_inserted(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey = 9").newly(_customers(spark, sf_dir, "c_nationkey in (7, 9)")).ids


@query("select case when c_custkey = 0 then 0 else 1 + (c_custkey - 1) // 32768 end::bigint + 0 bucket, count(*) n from customer where c_nationkey < 5 group by 1")
def vs_bitmap(spark, sf_dir):
    return _customers(spark, sf_dir, "c_nationkey < 5").bitmap().select("bucket", "n")


@query(f"with {F1} select e.dst id, min(c_nationkey) \"value\" from customer join e on e.src = c_custkey where c_nationkey % 2 = 1 group by 1")
def edge_map_min(spark, sf_dir):
    front = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 1").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return V.edge_map(front, customer_parts(spark, sf_dir).edges, message=F.col("c_nationkey"))


@query(f"with {F1} select e.src::bigint id, sum(case when b.c_nationkey = 3 then 1 else 0 end)::bigint \"value\" from e join customer b on b.c_custkey = e.dst group by 1")
def edge_neighbour_count(spark, sf_dir):
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    graph = customer_parts(spark, sf_dir)
    both = graph.vertices.join(nations, "id", "left")
    customers = table(spark, sf_dir, "customer").count()
    return V.neighbour_count(graph.edges.where(F.col("dst") < customers), both, F.col("d_c_nationkey") == 3)


@query("select id, min(p) prio from (select o_custkey id, o_totalprice p from orders where o_orderkey % 2 = 0 union all select o_custkey, o_totalprice - 1000 from orders where o_orderkey % 2 = 1) group by 1")
def pq_decrease(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    first = orders.where("o_orderkey % 2 = 0").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_totalprice").alias("prio"))
    offers = orders.where("o_orderkey % 2 = 1").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") - 1000).alias("prio"))
    return V.PriorityMap(first).decrease(offers)[0].entries


@query("select c_custkey id, c_acctbal prio from customer where c_acctbal <= 500")
def pq_extract_min(spark, sf_dir):
    return V.PriorityMap(_balance(spark, sf_dir).select("id", F.col("c_acctbal").alias("prio"))).extract(500)[0]


# ---------------------------------------------------------------- primitives


def _orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders")


@query("select o_orderkey, row_number() over (partition by o_orderstatus order by (o_totalprice > 100000)::int, o_orderkey) - 1 new_pos from orders")
def prim_partition(spark, sf_dir):
    return P.partition(_orders(spark, sf_dir), F.col("o_totalprice") > 100000, "o_orderkey", "o_orderstatus").select("o_orderkey", F.col("new_pos").cast("long"))


@query("select o_orderkey pos from orders where o_totalprice > 300000")
def prim_pack_index(spark, sf_dir):
    return _orders(spark, sf_dir).where("o_totalprice > 300000").select(F.col("o_orderkey").alias("pos"))


@query("select o_orderkey, o_totalprice * 2 v from orders where o_orderstatus <> 'F' and o_custkey % 2 = 0")
def prim_map_maybe(spark, sf_dir):
    mapped = F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") * 2)
    return _orders(spark, sf_dir).where("o_orderstatus <> 'F'").select("o_orderkey", mapped.alias("v")).dropna(subset=["v"])


@query("select bool_and(o_totalprice > 0) all_of, bool_or(o_totalprice > 400000) any_of, not bool_or(o_custkey < 0) none_of from orders")
def prim_predicates(spark, sf_dir):
    return _orders(spark, sf_dir).agg(F.bool_and(F.col("o_totalprice") > 0).alias("all_of"), F.bool_or(F.col("o_totalprice") > 400000).alias("any_of"), (~F.bool_or(F.col("o_custkey") < 0)).alias("none_of"))


@query(
    """select 'bit_and' monoid, bit_and(l_partkey)::bigint "value" from lineitem union all select 'bit_or', bit_or(l_partkey)::bigint from lineitem
 union all select 'bit_xor', bit_xor(l_partkey)::bigint from lineitem union all select 'maximum', max(l_partkey) from lineitem
 union all select 'minimum', min(l_partkey) from lineitem union all select 'plus', sum(l_partkey)::bigint from lineitem"""
)
def agg_reduce_monoids(spark, sf_dir):
    lines, out = table(spark, sf_dir, "lineitem"), None
    for name in ("bit_and", "bit_or", "bit_xor", "maximum", "minimum", "plus"):
        one = P.reduce(lines, F.col("l_partkey"), name).select(F.lit(name).alias("monoid"), F.col("value").cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


@query("select l_suppkey, max(l_linenumber) \"value\" from lineitem group by 1")
def agg_by_key(spark, sf_dir):
    return P.reduce_by_key(table(spark, sf_dir, "lineitem"), "l_suppkey", F.col("l_linenumber"), "maximum")


@query("select n.i::bigint idx, coalesce(sum(c_custkey), 0)::bigint \"value\" from (select unnest(range(40)) i) n left join customer on c_nationkey = n.i group by 1")
def agg_by_index(spark, sf_dir):
    return P.reduce_by_index(table(spark, sf_dir, "customer"), "c_nationkey", F.col("c_custkey"), "plus", 40)


@query("select n.i::bigint idx, count(c_custkey) n from (select unnest(range(40)) i) n left join customer on c_nationkey = n.i group by 1")
def agg_hist_index(spark, sf_dir):
    return P.histogram_by_index(table(spark, sf_dir, "customer"), "c_nationkey", 40)


@query("select o_orderpriority, count(*) n from orders group by 1")
def agg_hist_key(spark, sf_dir):
    return P.histogram_by_key(_orders(spark, sf_dir), "o_orderpriority")


@query("select o_custkey, array_to_string(list_sort(list(o_orderkey)), ',') \"values\" from orders group by 1")
def agg_group(spark, sf_dir):
    listed = P.group_by_key(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")
    return listed.select("o_custkey", F.array_join(F.transform(F.array_sort("values"), lambda x: x.cast("string")), ",").alias("values"))


@query("select c_nationkey, array_to_string(list(c_custkey order by c_acctbal, c_custkey), ',') \"values\" from customer group by 1")
def agg_group_ordered(spark, sf_dir):
    ranked = table(spark, sf_dir, "customer").withColumn("place", F.struct("c_acctbal", "c_custkey"))
    return P.group_by_key_ordered(ranked, "c_nationkey", "c_custkey", "place").select("c_nationkey", F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("values"))


@query("select distinct l_suppkey, l_linenumber from lineitem")
def agg_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()


@query("select o_custkey, arg_min(o_orderkey, (o_totalprice, o_orderkey)) o_orderkey, min(o_totalprice) o_totalprice from orders group by 1")
def agg_argmin(spark, sf_dir):
    return P.first_min(_orders(spark, sf_dir), "o_totalprice", "o_orderkey", "o_custkey")


@query("select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) o_orderkey, max(o_totalprice) o_totalprice from orders group by 1")
def agg_argmax(spark, sf_dir):
    return P.first_max(_orders(spark, sf_dir), "o_totalprice", "o_orderkey", "o_custkey")


@query("select o_custkey, o_orderkey, coalesce(sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint prefix from orders")
def win_scan_excl(spark, sf_dir):
    return P.scan(_orders(spark, sf_dir), "o_orderkey", "o_orderkey", "o_custkey").select("o_custkey", "o_orderkey", "prefix")


@query("select o_custkey, o_orderkey, sum(o_orderkey) over (partition by o_custkey order by o_orderkey rows unbounded preceding)::bigint prefix from orders")
def win_scan_incl(spark, sf_dir):
    return P.scan(_orders(spark, sf_dir), "o_orderkey", "o_orderkey", "o_custkey", inclusive=True).select("o_custkey", "o_orderkey", "prefix")


@query("select o_custkey, o_orderkey, min(o_totalprice) over (partition by o_custkey order by o_orderkey desc rows unbounded preceding) prefix from orders")
def win_suffix_min(spark, sf_dir):
    return P.scan(_orders(spark, sf_dir), "o_totalprice", "o_orderkey", "o_custkey", fold=F.min, identity=None, inclusive=True, backwards=True).select("o_custkey", "o_orderkey", "prefix")


@query("select o_orderkey, (sum(o_custkey) over (order by o_orderkey) - o_custkey)::bigint prefix from orders")
def win_long_scan(spark, sf_dir):
    return P.long_scan(_orders(spark, sf_dir), "o_custkey", "o_orderkey", block=1000).select("o_orderkey", "prefix")


@query("select o_orderkey, min(o_totalprice) over (order by o_orderkey desc rows between unbounded preceding and 1 preceding) prefix from orders")
def win_scan_min_all(spark, sf_dir):
    """One sequence of the whole table, from its end."""
    return P.scan(_orders(spark, sf_dir), "o_totalprice", "o_orderkey", fold=F.min, identity=None, backwards=True).select("o_orderkey", "prefix")


@query(
    """select o_orderkey, coalesce(sum(o_custkey) over w, 0)::bigint total, coalesce(max(o_totalprice) over w, 0) top from orders
 window w as (order by o_orderkey rows between unbounded preceding and 1 preceding)"""
)
def win_scan_pair_all(spark, sf_dir):
    both = M.pair(M.simple("total", "long", 0, np.add), M.simple("top", "double", 0.0, np.maximum))
    return M.scan(_orders(spark, sf_dir), both, (F.col("o_custkey"), F.col("o_totalprice")), "o_orderkey").select("o_orderkey", "total", "top")


@query("select event_id, event_type from (select *, lag(event_type) over (order by event_id) p from events) where p is null or p <> event_type")
def win_unique_all(spark, sf_dir):
    return P.unique(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "event_type")


@query("select not bool_or(f) sorted, min(case when f then event_id end) upto from (select *, coalesce(ts < lag(ts) over (order by event_id), false) f from events)")
def win_is_sorted_all(spark, sf_dir):
    return P.is_sorted(table(spark, sf_dir, "events"), "ts", "event_id")


@query("select o_orderkey, (row_number() over (partition by o_orderstatus order by o_custkey, o_orderkey) - 1)::bigint rank from orders")
def win_rank(spark, sf_dir):
    return P.rank(_orders(spark, sf_dir), "o_custkey", "o_orderkey", "o_orderstatus").select("o_orderkey", F.col("rank").cast("long"))


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) p from events) where p is null or p <> event_type")
def win_unique(spark, sf_dir):
    return P.unique(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id").select("event_id", "user_id", "event_type")


@query("select user_id, min(event_id) event_id from (select *, lead(event_type) over (partition by user_id order by event_id) n from events) where n = event_type group by 1")
def win_adjacent(spark, sf_dir):
    return P.adjacent_equal(table(spark, sf_dir, "events"), "event_type", "event_id", "user_id")


@query("select user_id, not bool_or(f) sorted, min(case when f then event_id end) upto from (select *, coalesce(ts < lag(ts) over (partition by user_id order by event_id), false) f from events) group by 1")
def win_is_sorted(spark, sf_dir):
    return P.is_sorted(table(spark, sf_dir, "events"), "ts", "event_id", "user_id")


@query("select o_orderkey, (row_number() over (order by o_orderpriority, o_orderkey) - 1)::bigint new_pos from orders")
def sort_counting(spark, sf_dir):
    return P.counting_sort(_orders(spark, sf_dir), "o_orderpriority", "o_orderkey").select("o_orderkey", F.col("new_pos").cast("long"))


@query("select o_totalprice from orders order by o_totalprice limit 1 offset 99")
def topk_kth(spark, sf_dir):
    return P.kth_smallest(_orders(spark, sf_dir), "o_totalprice", 99)


@query("select c_acctbal v, c_custkey pos, 0 side from customer union all select s_acctbal, s_suppkey, 1 from supplier")
def sort_merge(spark, sf_dir):
    sides = [table(spark, sf_dir, t).select(F.col(f"{c}_acctbal").alias("v"), F.col(k).alias("pos")) for t, c, k in (("customer", "c", "c_custkey"), ("supplier", "s", "s_suppkey"))]
    return P.merge(*sides, "v", "pos")


@query("select distinct s_acctbal, (select count(*) from customer where c_acctbal < s_acctbal) place from supplier")
def search_lower_bound(spark, sf_dir):
    return P.lower_bound(table(spark, sf_dir, "customer"), "c_acctbal", table(spark, sf_dir, "supplier"), "s_acctbal")


@query("select coalesce(min(case when o_totalprice > 450000 then o_orderkey end), -1)::bigint place from orders")
def seq_find(spark, sf_dir):
    return P.find_if(_orders(spark, sf_dir), F.col("o_totalprice") > 450000, "o_orderkey", -1)


@query("select min(a.o_orderkey) place from orders a join (select o_orderkey, case when o_orderkey > 700 then o_custkey + 1 else o_custkey end c from orders) b using (o_orderkey) where a.o_custkey <> b.c")
def seq_mismatch(spark, sf_dir):
    orders = _orders(spark, sf_dir)
    other = orders.select("o_orderkey", F.when(F.col("o_orderkey") > 700, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return P.mismatch(orders, other, "o_custkey", "o_orderkey")


@query("select p_partkey, ((p_partkey - 17 + 2 * (select count(*) from part)) % (select count(*) from part))::bigint new_pos from part")
def seq_rotate(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return P.rotate(part, "p_partkey", part.count(), 17).select("p_partkey", F.col("new_pos").cast("long"))


@query("select p_partkey, ((select count(*) from part) - 1 - p_partkey)::bigint new_pos from part")
def seq_reverse(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return P.reverse(part, "p_partkey", part.count()).select("p_partkey", F.col("new_pos").cast("long"))


@query("select c_custkey pos, c_name a, p_name b from customer join part on p_partkey = c_custkey")
def seq_zip(spark, sf_dir):
    return P.zip_with(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.col("c_name").alias("a")), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("b")), "pos")


@query("select doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\f\\n\\r\\t\\v]+'), lambda x: x <> '')) token from documents")
def str_tokens(spark, sf_dir):
    return strings.explode_tokens(table(spark, sf_dir, "documents"), "text", "doc_id").select("doc_id", "token")


@query("select user_id, event_id, coalesce(sum((event_type = 'click')::int) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), 0)::bigint part from events")
def str_split_at(spark, sf_dir):
    return strings.split_at(table(spark, sf_dir, "events"), "event_id", F.col("event_type") == "click", "user_id").select("user_id", "event_id", "part")


@query("select try_cast(regexp_replace(c_name, '[^0-9]', '', 'g') as bigint) n, c_custkey from customer")
def str_parse(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(strings.to_long(F.regexp_replace("c_name", "[^0-9]", "")).alias("n"), "c_custkey")


@query(f"select o_orderkey, h from ({hash32_sql('select o_orderkey from orders', 'o_orderkey', 'h')})")
def hash_hash32(spark, sf_dir):
    return _orders(spark, sf_dir).select("o_orderkey", hashing.hash32(F.col("o_orderkey")).alias("h"))


@query()
def hash_hash64(spark, sf_dir):
    key = F.col("o_orderkey")
    return _orders(spark, sf_dir).select(key, hashing.hash64(key).alias("h64"), hashing.hash64_2(key).alias("h64_2"), hashing.mix64(key).alias("mix"), hashing.hash32_2(key).alias("h2"), hashing.hash32_3(key).alias("h3"))


@query("select p_partkey, ceil(log2(p_partkey + 1))::bigint l from part")
def hash_log2up(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", hashing.log2_up(F.col("p_partkey") + 1).cast("long").alias("l"))


@query("select c_mktsegment, c_nationkey, round(exp(avg(ln(abs(c_acctbal) + 1))), 6) geomean from customer group by rollup (c_mktsegment, c_nationkey)")
def stat_geomean(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").withColumn("x", F.abs("c_acctbal") + 1)
    return R.geometric_mean(rows, "x", "c_mktsegment", "c_nationkey").withColumn("geomean", F.round("geomean", 6))


@query("select l_orderkey, l_linenumber, round(least(l_extendedprice / l_quantity, 5.0), 9) ratio from lineitem")
def stat_ratio(spark, sf_dir):
    return R.relative(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_quantity").select("l_orderkey", "l_linenumber", F.round("ratio", 9).alias("ratio"))


@query("select coalesce(n_nationkey, s_nationkey) n_nationkey, n_name, n_regionkey, s.n_sup from nation full join (select s_nationkey, count(*) n_sup from supplier group by 1) s on n_nationkey = s_nationkey")
def stat_upsert(spark, sf_dir):
    cells = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n_sup"))
    return R.upsert_cells(table(spark, sf_dir, "nation"), cells, "n_nationkey")


@query("select user_id, event_id, last_value(case when value > 50 then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) v from events")
def stat_fill_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("value") > 50, F.col("value")).alias("v"))
    return R.fill_forward(rows, "v", "event_id", "user_id")
