"""Connected components, by repeated contraction of a link table; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import discard, materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b); component is the smallest node that can be reached.

    Each round points every node at its smallest neighbour, follows the pointers to their roots and contracts the
    links to roots; as every root merges with another one, the nodes left at least halve.
    """
    live = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    label: DataFrame | None = None
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(live.select(F.col("b").alias("node"), F.col("a").alias("other")))
        root = materialize(both.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("root")), "roots")
        while True:
            up = root.select(F.col("node").alias("up_node"), F.col("root").alias("up_root"))
            jumped = materialize(root.join(up, F.col("root") == F.col("up_node")).select("node", F.col("up_root").alias("root"), (F.col("up_root") != F.col("root")).alias("moved")), "roots")
            done = jumped.where("moved").isEmpty()
            discard(root)
            root = jumped.select("node", "root")
            root._loomgraph_path = jumped._loomgraph_path
            if done:
                break
        to_a, to_b = (root.select(F.col("node").alias(f"n_{c}"), F.col("root").alias(f"r_{c}")) for c in "ab")
        contracted = materialize(
            live.join(to_a, F.col("a") == F.col("n_a")).join(to_b, F.col("b") == F.col("n_b"))
            .select(F.least("r_a", "r_b").alias("a"), F.greatest("r_a", "r_b").alias("b")).where("a < b").distinct(), "links",
        )
        discard(live)
        live = contracted
        if label is None:
            label = root.select("node", F.col("root").alias("component"))
        else:
            to = root.select(F.col("node").alias("t_node"), F.col("root").alias("t_root"))
            label = materialize(label.join(to, F.col("component") == F.col("t_node"), "left").select("node", F.coalesce("t_root", "component").alias("component")), "labels")
    if label is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return label


def connected_components(graph) -> DataFrame:
    """(id, value) for every vertex: the smallest id that can be reached, edges taken as undirected."""
    found = components(graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return graph.vertices.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("value"))


def component_sizes(graph) -> DataFrame:
    return connected_components(graph).groupBy(F.col("value").alias("component")).agg(F.count(F.lit(1)).alias("n"))


def largest_component(graph) -> DataFrame:
    """Ids of the largest component; of equally large ones, that with the smallest id."""
    labels = materialize(connected_components(graph), "components")
    best = labels.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(1).select(F.col("value").alias("best"))
    return labels.join(F.broadcast(best), F.col("value") == F.col("best")).select("id")
