"""Registered queries of files, hashes, sequences, random order and result tables; they join those of loomgraph.queries."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from loomgraph import queries as Q
from loomgraph.functions import hashing, strings
from loomgraph.graph import Graph
from loomgraph.operators import monoids as M
from loomgraph.operators import primitives as P
from loomgraph.operators import results as R
from loomgraph.operators import sequences as S
from loomgraph.operators import vertexset as V
from loomgraph.plans import coloring, cores, traversal
from loomgraph.plans.superstep import Supersteps
from loomgraph.queries import query, table
from loomgraph.session import scratch_dir
from loomgraph.sources import csr

WORD, HALF = 2**64, 2**63


def times_sql(x: str, factor: int) -> str:
    return f"((({x})::uhugeint * {factor}::uhugeint) % {WORD}::uhugeint)::ubigint"


def hash64_sql(source: str, column: str, name: str) -> str:
    """Nested selects that add name, the 64-bit hash of column, as UBIGINT."""
    low, high = hashing.HASH64_LINEAR
    out = f"select *, (((({column})::uhugeint * {low}::uhugeint) % {WORD}::uhugeint + {high}::uhugeint) % {WORD}::uhugeint)::ubigint as {name} from ({source})"
    for i, by in enumerate(hashing.HASH64_SHIFTS):
        if i == 3:
            out = f"select * replace ({times_sql(name, hashing.HASH64_MULTIPLY)} as {name}) from ({out})"
        moved = times_sql(name, 2**by) if i in (1, 3, 5) else f"{name} // {2**by}::ubigint"
        out = f"select * replace (xor({name}, {moved}) as {name}) from ({out})"
    return out


def rounds_sql(source: str, column: str, name: str, rounds: list[tuple[int, int]], last: int) -> str:
    """Nested selects that add name: for each round xor with the value shifted right, times a factor; then one last shift."""
    out = f"select *, ({column})::ubigint as {name} from ({source})"
    for by, factor in rounds:
        out = f"select * replace ({times_sql(f'xor({name}, {name} // {2**by}::ubigint)', factor)} as {name}) from ({out})"
    return f"select * replace (xor({name}, {name} // {2**last}::ubigint) as {name}) from ({out})"


def signed_sql(x: str) -> str:
    return f"case when {x} >= {HALF}::ubigint then ({x}::hugeint - {WORD}::hugeint)::bigint else {x}::bigint end"


MIX = [(33, factor) for factor in hashing.MIX64_MULTIPLY]


# ---------------------------------------------------------------- graph files


def _file(spark, extension: str) -> str:
    return f"{scratch_dir(spark)}/loomgraph-graph-{uuid.uuid4().hex}{extension}"


@query(f"with {Q.F1} select src::bigint src, dst::bigint dst from e")
def io_binary_roundtrip(spark, sf_dir):
    path = _file(spark, "_sym.bin")
    csr.write_binary(Q.customer_parts(spark, sf_dir), path)
    return csr.read_graph(spark, path).edges


@query(f"with {Q.W1} select src::bigint src, dst::bigint dst, wgh from w")
def io_weighted_roundtrip(spark, sf_dir):
    path = _file(spark, "_sym.bin")
    csr.write_binary(Q.customer_parts(spark, sf_dir, weighted=True), path)
    return csr.read_graph(spark, path, "int").edges


@query(f"with {Q.F1} select src::bigint src, dst::bigint dst from e")
def io_pbbs_roundtrip(spark, sf_dir):
    path = _file(spark, "_sym.adj")
    csr.write_adjacency(Q.customer_parts(spark, sf_dir), path)
    return csr.read_graph(spark, path).edges


@query(f"with {Q.F3} select src::bigint src, dst::bigint dst, 0 side from e union all select dst, src, 1 from e")
def io_two_blocks(spark, sf_dir):
    """A directed graph and its inverse from one file."""
    path = _file(spark, ".bin")
    csr.write_double(Q.event_chains(spark, sf_dir), path)
    there, back = csr.read_both(spark, path)
    return there.edges.withColumn("side", F.lit(0)).unionByName(back.edges.withColumn("side", F.lit(1)))


@query(f"with {Q.F3} select src::bigint src, dst::bigint dst, 0 side from e union all select dst, src, 1 from e")
def io_text_and_inverse(spark, sf_dir):
    path = _file(spark, ".adj")
    csr.write_adjacency(Q.event_chains(spark, sf_dir), path)
    there, back = csr.read_both(spark, path)
    return there.edges.withColumn("side", F.lit(0)).unionByName(back.edges.withColumn("side", F.lit(1)))


@query(f"""with {Q.F3}, w as ({Q.hash32_sql(Q.hash32_sql("select * from e", "src", "hs"), "dst", "hd")}) select src::bigint src, dst::bigint dst, (1 + xor(hs, hd) % 5)::int wgh from w""")
def io_weighing_tool(spark, sf_dir):
    path = _file(spark, ".bin")
    csr.write_binary(Q.event_chains(spark, sf_dir), path)
    return csr.read_graph(spark, csr.write_weighted(spark, path, path.rpartition("/")[0], 5), "int").edges


@query("select 0::bigint n_bad_targets, 0::bigint n_bad_offsets, 0::bigint n_unsorted")
def io_check_layout(spark, sf_dir):
    path = _file(spark, ".bin")
    csr.write_binary(Q.customer_parts(spark, sf_dir), path)
    return csr.check_layout(spark, path)


@query("select page_id, regexp_replace(regexp_extract(regexp_replace(url, '/+$', ''), '[^/]*$'), '\\.[^.]*$', '') name from pages")
def io_graph_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", csr.graph_name_of(F.col("url")).alias("name"))


# ---------------------------------------------------------------- graph algorithms


@query(f"with recursive {Q.F3}, {Q.BFS} select vs.id::bigint id from vs left join b on b.v = vs.id where b.d is null")
def bfs_unreachable(spark, sf_dir):
    return traversal.local_distances(Q.event_chains(spark, sf_dir), 0).where("value is null").select("id")


@query(f"with recursive {Q.F1}, {Q.BFS}, l as (select d, count(*)::bigint n from b group by 1) select d::int round, coalesce((select n from l x where x.d = l.d + 1), 0)::bigint frontier_size from l")
def bfs_round_log(spark, sf_dir):
    steps = Supersteps()
    traversal.bfs(Q.customer_parts(spark, sf_dir), 0, steps=steps)
    return steps.rounds(spark).select("round", "frontier_size")


_TREE = """n as (select n_nationkey k, n_regionkey r, (n_nationkey % 7) - 3 w from nation), c as (select c_custkey k, c_nationkey p, (c_custkey % 7) - 3 w from customer),
 dn as (select k, case when r = 0 then w end d from n), dc as (select c.k, least(case when c.k % 5 = 0 then 1 end, dn.d + c.w) d from c join dn on dn.k = c.p)"""


@query(f"with {_TREE} select 10 + k id, d::bigint \"value\" from dn union all select 1000 + k, d::bigint from dc union all select 0, 0 ")
def sssp_negative_weights(spark, sf_dir):
    """Region 0, its nations and their customers, with weights from -3 to 3 and a shortcut to every fifth customer."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    weight = lambda key: (F.col(key) % 7 - 3).cast("int").alias("wgh")
    down = nation.where("n_regionkey = 0").select(F.lit(0).alias("src"), (F.col("n_nationkey") + 10).alias("dst"), weight("n_nationkey"))
    more = customer.select((F.col("c_nationkey") + 10).alias("src"), (F.col("c_custkey") + 1000).alias("dst"), weight("c_custkey"))
    short = customer.where("c_custkey % 5 = 0").select(F.lit(0).alias("src"), (F.col("c_custkey") + 1000).alias("dst"), F.lit(1).alias("wgh"))
    ids = nation.select((F.col("n_nationkey") + 10).alias("id")).unionByName(customer.select((F.col("c_custkey") + 1000).alias("id")))
    ids = ids.unionByName(spark.range(1))
    return traversal.bellman_ford(Graph.from_edges(down.unionByName(more).unionByName(short), vertices=ids).stored(), 0)


@query(f"with recursive {Q.F1}, {Q.CORE} select max(c)::bigint \"value\" from k")
def kcore_max(spark, sf_dir):
    return cores.core_numbers(Q.customer_parts(spark, sf_dir)).agg(F.max("value").alias("value"))


@query(f"with recursive {Q.F2}, {Q.color_sql('count(*)')} select count(distinct coalesce(col.c, 0))::bigint n_colors from vs left join col on col.v = vs.id")
def coloring_num_colors(spark, sf_dir):
    graph = Q.co_purchases(spark, sf_dir)
    return coloring.greedy_coloring(graph, ties=Q.ranks(graph)).agg(F.count_distinct("value").alias("n_colors"))


_BETWEEN = Q.hash32_sql(Q.hash32_sql("select l_partkey src, l_suppkey dst from lineitem", "src", "hs"), "dst", "hd")


@query(f"select src, dst, (3 + xor(hs, hd) % 7)::int wgh from ({_BETWEEN})")
def graph_weights_range(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return Graph.from_edges(lines).with_weights_between(3, 9).edges


_ODD = "select l_partkey src, l_suppkey dst from lineitem union all select l_suppkey, l_suppkey from lineitem where l_linenumber = 1"


@query(f"with e as ({_ODD}) select src, dst from e where src <> dst union select dst, src from e where src <> dst")
def graph_symmetrize_loops(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    loops = lines.where("l_linenumber = 1").select(F.col("l_suppkey").alias("src"), F.col("l_suppkey").alias("dst"))
    return Graph.from_edges(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).unionByName(loops)).symmetrize().edges


@query(
    """with e as (select l_partkey src, l_suppkey dst from lineitem), v as (select s_suppkey id from supplier) select (select count(*) from e where src = dst) n_loops,
 (select count(*) - count(distinct (src, dst)) from e) n_parallel, (select count(*) from e where src not in (select id from v) or dst not in (select id from v)) n_foreign,
 (select count(*) from e where not exists (select 1 from e x where x.src = e.dst and x.dst = e.src)) n_one_way"""
)
def graph_validate_broken(spark, sf_dir):
    """Parts joined to suppliers, of which only suppliers are vertices: every count is above 0."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    return Graph.from_edges(lines.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), vertices=suppliers.select(F.col("s_suppkey").alias("id"))).validate()


# ---------------------------------------------------------------- vertex sets


@query("select max(c_acctbal) \"value\" from customer where c_nationkey = 3")
def vs_max_attr(spark, sf_dir):
    return Q._customers(spark, sf_dir, "c_nationkey = 3").max_of(Q._balance(spark, sf_dir), "c_acctbal", -1.5)


@query("select c_custkey id from customer where c_nationkey = 9 and c_custkey % 2 = 0")
def vs_newly_removed(spark, sf_dir):
    return Q._customers(spark, sf_dir, "c_nationkey = 9").newly_removed(Q._customers(spark, sf_dir, "c_custkey % 2 = 0")).ids


@query("select c_custkey id, c_acctbal * 2 twice from customer where c_nationkey in (4, 5) and c_custkey % 3 <> 0")
def vs_frontier(spark, sf_dir):
    front = V.Frontier(spark)
    front.insert_next(Q._customers(spark, sf_dir, "c_nationkey = 4"))
    front.insert_next(Q._customers(spark, sf_dir, "c_nationkey = 5"))
    front.remove_next(Q._customers(spark, sf_dir, "c_custkey % 3 = 0"))
    front.advance()
    return front.for_each(Q._balance(spark, sf_dir), twice=F.col("c_acctbal") * 2).select("id", "twice")


# ---------------------------------------------------------------- positions, searches, comparisons


def _part(spark, sf_dir):
    return table(spark, sf_dir, "part")


@query("select o_orderkey, row_number() over (order by o_orderkey) - 1 place from orders where o_custkey % 3 = 0")
def prim_enumerate(spark, sf_dir):
    return S.enumerate_rows(table(spark, sf_dir, "orders").where("o_custkey % 3 = 0").select("o_orderkey"), "o_orderkey")


@query("select place from (select o_totalprice, row_number() over (order by o_orderkey) - 1 place from orders) where o_totalprice > 300000")
def prim_pack_positions(spark, sf_dir):
    return S.pack_index(table(spark, sf_dir, "orders"), F.col("o_totalprice") > 300000, "o_orderkey")


@query("select i::bigint id, (i * i % 101)::bigint v from (select unnest(range((select count(*) from lineitem))) i)")
def prim_tabulate(spark, sf_dir):
    """As many elements as there are order lines."""
    return P.tabulate(spark, table(spark, sf_dir, "lineitem").count(), v=F.col("id") * F.col("id") % 101)


@query("select p_partkey pos, p_name v from part union all select (select count(*) from part) + s_suppkey, s_name from supplier")
def seq_append(spark, sf_dir):
    part, supplier = _part(spark, sf_dir), table(spark, sf_dir, "supplier")
    return S.append(part.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("v")), supplier.select(F.col("s_suppkey").alias("pos"), F.col("s_name").alias("v")), "pos", part.count())


@query("select p_partkey from part where p_partkey between 20 and 59")
def seq_cut(spark, sf_dir):
    return S.cut(_part(spark, sf_dir), "p_partkey", 20, 60).select("p_partkey")


@query("(select p_partkey, 'head' side from part order by 1 limit 7) union all (select p_partkey, 'tail' from part order by 1 desc limit 5)")
def seq_head_tail(spark, sf_dir):
    part = _part(spark, sf_dir).select("p_partkey")
    return S.head(part, "p_partkey", 7).withColumn("side", F.lit("head")).unionByName(S.tail(part, "p_partkey", 5).withColumn("side", F.lit("tail")))


@query("select min(case when not (o_totalprice < 300000) then o_orderkey end)::bigint place from orders")
def seq_find_if_not(spark, sf_dir):
    return P.find_if(table(spark, sf_dir, "orders"), ~(F.col("o_totalprice") < 300000), "o_orderkey", -1)


@query("select min(o_orderkey)::bigint place from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)")
def seq_find_first_of(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return S.find_first_of(table(spark, sf_dir, "orders"), wanted, "o_custkey", "o_orderkey", -1)


_KINDS = "select event_type t, row_number() over (order by event_id) - 1 i from events"


def _kinds(spark, sf_dir):
    return S.enumerate_rows(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id").select("event_type", "place")


@query(f"with e as ({_KINDS}) select min(a.i)::bigint first, max(a.i)::bigint last from e a join e b on b.i = a.i + 1 join e c on c.i = a.i + 2 where a.t = 'click' and b.t = 'click' and c.t = 'view'")
def seq_search(spark, sf_dir):
    events, pattern = _kinds(spark, sf_dir), spark.createDataFrame([("click", 0), ("click", 1), ("view", 2)], "event_type string, place long")
    first, last = (S.find_span(events, pattern, "event_type", "place", -1, last=b) for b in (False, True))
    return first.select(F.col("place").alias("first")).withColumn("last", last.scalar())


@query(
    """with e as (select (row_number() over (order by event_id) - 1)::bigint i, event_type = 'click' t from events), n as (select least(1000, count(*)) m, count(*) // 2 half from e),
 p as (select string_agg(t::int::varchar, '' order by i) s from e), w as (select substr(s, half + 1, m) x from p, n)
 select i as start from e, p, w, n where substr(s, i + 1, m) = x and i + m <= length(s)"""
)
def seq_search_long(spark, sf_dir):
    """A pattern of 1,000 elements out of the middle of a sequence that has two values."""
    events = S.enumerate_rows(table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "click").alias("t")), "event_id").select("place", "t")
    n = events.count()
    pattern = S.cut(events, "place", n // 2, n // 2 + min(1000, n)).select((F.col("place") - n // 2).alias("place"), "t")
    return S.occurrences(events, pattern, "t", "place")


@query("select false equal, (select o_custkey from orders where o_orderkey = 701) < (select o_custkey + 1 from orders where o_orderkey = 701) less")
def seq_compare(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    other = orders.select("o_orderkey", F.when(F.col("o_orderkey") > 700, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")).alias("o_custkey"))
    return S.compare(orders, other, "o_custkey", "o_orderkey")


@query("select 'key' how, (select max(o_orderkey) from orders where o_orderkey < 900) < (select min(o_orderkey) from orders where o_orderkey >= 900) partitioned union all select 'price', (select max(o_orderkey) from orders where o_totalprice < 200000) < (select min(o_orderkey) from orders where o_totalprice >= 200000)")
def win_is_partitioned(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    both = [S.is_partitioned(orders, flag, "o_orderkey").withColumn("how", F.lit(how)) for how, flag in (("key", F.col("o_orderkey") < 900), ("price", F.col("o_totalprice") < 200000))]
    return both[0].unionByName(both[1])


# ---------------------------------------------------------------- aggregates, distinct values, sorts


@query("select arg_min(o_orderkey, (o_totalprice, o_orderkey)) low_pos, min(o_totalprice) low, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) high_pos, max(o_totalprice) high from orders")
def agg_minmax(spark, sf_dir):
    return S.minmax(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey")


@query("select o_custkey, sum(o_orderkey)::bigint a, min(o_totalprice) b from orders group by 1")
def agg_pair_monoid(spark, sf_dir):
    both = M.pair(M.simple("a", "long", 0, np.add), M.simple("b", "double", float("inf"), np.minimum))
    return M.aggregate(table(spark, sf_dir, "orders"), both, (F.col("o_orderkey"), F.col("o_totalprice")), "o_custkey")


@query(
    """select l_returnflag, low.q q, low.k k, n, round(mean, 6) mean, round(variance, 3) variance from (select l_returnflag, min({'q': l_quantity::double, 'k': l_orderkey}) low,
 count(*)::bigint n, avg(l_extendedprice::double) mean, var_pop(l_extendedprice::double) variance from lineitem group by 1)"""
)
def agg_custom_monoid(spark, sf_dir):
    """A merge of one's own beside a lexicographic one: count, mean and squared deviations of stretches of rows."""

    def merge(a, b):
        (n, mean, dev), (m, other, more) = a, b
        total = np.maximum(n + m, 1)
        return n + m, (n * mean + m * other) / total, dev + more + (other - mean) ** 2 * n * m / total

    moments = M.Monoid({"n": "long", "mean": "double", "dev": "double"}, (0, 0.0, 0.0), merge)
    first = M.lexicographic({"q": "double", "k": "long"}, (float("inf"), 2**62))
    lines, price = table(spark, sf_dir, "lineitem"), F.col("l_extendedprice").cast("double")
    out = M.aggregate(lines, M.pair(first, moments), (F.col("l_quantity"), F.col("l_orderkey"), F.lit(1), price, F.lit(0.0)), "l_returnflag")
    return out.select("l_returnflag", "q", "k", "n", F.round("mean", 6).alias("mean"), F.round(F.col("dev") / F.col("n"), 3).alias("variance"))


@query("select 0 i, sum(l_quantity) \"value\" from lineitem union all select 1, sum(l_linenumber) from lineitem")
def agg_array_monoid(spark, sf_dir):
    pairs = table(spark, sf_dir, "lineitem").select(F.array(F.col("l_quantity").cast("double"), F.col("l_linenumber").cast("double")).alias("xs"))
    return S.fold_arrays(pairs, "xs", F.sum)


@query("select bool_and(o_custkey % 2 = 0) a, bool_or(o_custkey % 2 = 0) b, (select round(product(1 + n_nationkey * 0.01), 9) from nation) p from orders")
def agg_logical_monoids(spark, sf_dir):
    orders, even = table(spark, sf_dir, "orders"), F.col("o_custkey") % 2 == 0
    product = P.reduce(table(spark, sf_dir, "nation"), 1 + F.col("n_nationkey") * 0.01, "multiplies").select(F.round("value", 9).alias("p"))
    return P.reduce(orders, even, "logical_and").select(F.col("value").alias("a")).withColumns({"b": P.reduce(orders, even, "logical_or").scalar(), "p": product.scalar()})


@query("select n.i::bigint idx, case when c_custkey is not null then (row_number() over (partition by n.i order by c_custkey) - 1)::bigint end i, c_custkey \"value\" from (select unnest(range(40)) i) n left join customer on c_nationkey = n.i")
def agg_group_by_index(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").withColumn("at", F.col("c_custkey"))
    return S.group_by_index(customer, "c_nationkey", "c_custkey", "at", 40)


@query("select row_number() over (order by l_partkey) - 1 place, l_partkey from (select distinct l_partkey from lineitem)")
def agg_distinct_sorted(spark, sf_dir):
    return S.distinct_sorted(table(spark, sf_dir, "lineitem"), "l_partkey")


@query("select row_number() over (order by o_custkey) - 1 place, o_custkey, o_orderkey from (select o_custkey, min(o_orderkey) o_orderkey from orders group by 1)")
def win_distinct_ordered(spark, sf_dir):
    return S.distinct_first(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey")


@query("select o_orderkey, row_number() over (order by o_totalprice, o_orderkey) - 1 rank from orders")
def sort_stable(spark, sf_dir):
    return P.rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "rank")


@query("select o_orderkey, row_number() over (order by o_custkey, o_orderkey) - 1 rank from orders")
def sort_integer(spark, sf_dir):
    return P.rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey").select("o_orderkey", "rank")


@query("select o_orderpriority, (sum(n) over (order by o_orderpriority) - n)::bigint \"first\", n from (select o_orderpriority, count(*) n from orders group by 1)")
def sort_bucket_offsets(spark, sf_dir):
    return P.bucket_offsets(table(spark, sf_dir, "orders"), "o_orderpriority")


# ---------------------------------------------------------------- strings, hashes, random numbers


@query("select p_partkey, try_cast('-' || p_partkey || '.25e1' as double) d from part")
def str_to_double(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", strings.to_double(F.concat(F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".25e1"))).alias("d"))


@query("select p_partkey, p_partkey || ', ' || p_name chars from part")
def str_to_chars(spark, sf_dir):
    return _part(spark, sf_dir).select("p_partkey", strings.to_chars(F.col("p_partkey"), F.col("p_name")).alias("chars"))


_H64 = hash64_sql("select o_orderkey from orders", "o_orderkey", "x")
_H642 = rounds_sql(_H64, "o_orderkey", "y", hashing.HASH64_2_ROUNDS, 31)


@query(f"select o_orderkey, {signed_sql('x')} h64, {signed_sql('y')} h64_2, {signed_sql('z')} mix from ({rounds_sql(_H642, 'o_orderkey', 'z', MIX, 33)})")
def hash_words(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key, hashing.hash64(key).alias("h64"), hashing.hash64_2(key).alias("h64_2"), hashing.mix64(key).alias("mix"))


_A, _B = hashing.HASH32_3_MULTIPLY
_32 = 2**32
_H3 = f"select o_orderkey, ((o_orderkey + {hashing.HASH32_3_ADD}) % {_32})::ubigint z from orders"
_H3 = f"select o_orderkey, (xor(z, z // 32768::ubigint) * {_A}::ubigint) % {_32}::ubigint z from ({_H3})"
_H3 = f"select o_orderkey, (xor(z, z // 8192::ubigint) * {_B}::ubigint) % {_32}::ubigint z from ({_H3})"
_H2 = f"select o_orderkey, ((o_orderkey + {hashing.HASH32_2_ADD}) % {_32})::ubigint y from orders"
_H2 = f"select o_orderkey, (xor(y, y // 32768::ubigint) * (y | 1::ubigint)) % {_32}::ubigint y from ({_H2})"
_H2 = f"select o_orderkey, xor(y, (y + (xor(y, y // 128::ubigint) * (y | 61::ubigint)) % {_32}::ubigint) % {_32}::ubigint) y from ({_H2})"


@query(f"select o_orderkey, xor(y, y // 16384::ubigint)::bigint h2, xor(z, z // 65536::ubigint)::bigint h3 from ({_H2}) join ({_H3}) using (o_orderkey)")
def hash_hash32_others(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(key, hashing.hash32_2(key).alias("h2"), hashing.hash32_3(key).alias("h3"))


@query(f"select o_orderkey, xor(o_orderkey::bigint, o_custkey + {hashing.HASH32_3_ADD} + o_orderkey * 64 + o_orderkey // 4) h from orders")
def hash_combined(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.hash_combine(F.col("o_orderkey"), F.col("o_custkey")).alias("h"))


_I = "select o_orderkey::bigint i from orders"
_RAND = hash64_sql(hash64_sql(hash64_sql(hash64_sql(_I, "i + 7", "r"), "i", "f"), "f", "g"), f"(i + 1) * {hashing.GENERATOR_STRIDE} + 7", "c")


@query(f"select i, {signed_sql('r')} r, {signed_sql('g')} fork, {signed_sql('c')} child from ({_RAND})")
def random_numbers(spark, sf_dir):
    """The draws of a generator by the numbers of the orders, and the generators that fork off there."""
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(i.alias("i"), hashing.ith_random(i, 7).alias("r"), hashing.fork(i).alias("fork"), hashing.generator_at(i, 7).alias("child"))


@query()
def shuffle_hash(spark, sf_dir):
    """Beyond the size of one task: dealt to buckets by hash, each shuffled alone."""
    return S.random_order(spark, table(spark, sf_dir, "lineitem").count())


# ---------------------------------------------------------------- result tables


_FP = "select row_number() over (order by o_orderkey) - 1 pl, o_custkey v from orders"
_FP1 = f"select *, (v::uhugeint + {R.GOLDEN}::uhugeint * pl::uhugeint) % {WORD}::uhugeint a, v + 2 * pl b from ({_FP})"
_FP2 = rounds_sql(rounds_sql(_FP1, "a", "ma", MIX, 33), "b", "mb", MIX, 33)


@query(
    f"""with f as ({_FP2}), t as (select max(v)::ubigint top, (sum(ma::hugeint) % {WORD}::hugeint)::ubigint tot,
 list_reduce(list_prepend({R.FNV_OFFSET}::ubigint, list(mb order by pl)), lambda c, x: {times_sql('xor(c, x)', R.FNV_PRIME)}) ch from f)
 select printf('%08x', (xor(xor(xor(top, tot), tot // {_32}::ubigint), xor(ch, ch // {_32}::ubigint)) % {_32}::ubigint)::bigint) fingerprint from t"""
)
def stat_fingerprint(spark, sf_dir):
    result = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"))
    return spark.createDataFrame([(R.fingerprint(result),)], "fingerprint string")


@query(
    "select n_name as name, n_regionkey::double as other, null::double as own from nation union all select 'orders', null, 1.5"
)
def stat_record(spark, sf_dir):
    """The sink of a run: its time goes to the table of times, a row by name; its fingerprint likewise."""
    result = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("value"))
    times = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("other"))
    return R.record_result(result, 1.5, times, times.select("name"), "orders", "own")[0]


@query("select s_suppkey, case when s_acctbal = 0 then 0 else round(s_acctbal / pow(10, floor(log10(abs(s_acctbal))) - 2)) * pow(10, floor(log10(abs(s_acctbal))) - 2) end v from supplier")
def stat_significant(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", R.significant(F.col("s_acctbal").cast("double")).alias("v"))


@query("select l_orderkey, l_linenumber, least(l_discount, l_tax) best, case when l_discount <= l_tax then 'l_discount' else 'l_tax' end best_name from lineitem")
def stat_best_of(spark, sf_dir):
    return R.best_of(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax"), "l_discount", "l_tax").select("l_orderkey", "l_linenumber", "best", "best_name")


@query(
    """with r as (select log10(l_quantity) x, l_extendedprice y from lineitem where l_quantity > 0 and l_extendedprice > 0), e as (select min(x) low, max(x) high from r)
 select least(floor((x - low) / (high - low) * 16), 15)::bigint bin, count(*) n, median(y) median from r, e group by 1"""
)
def stat_binned_medians(spark, sf_dir):
    return R.binned_medians(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


@query("select round(regr_slope(log10(l_extendedprice), log10(l_quantity)), 6) slope, round(regr_intercept(log10(l_extendedprice), log10(l_quantity)), 6) intercept from lineitem where l_quantity > 0 and l_extendedprice > 0")
def stat_log_fit(spark, sf_dir):
    return R.log_fit(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice").select(F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))
