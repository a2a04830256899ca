"""Local search on adjacency that is kept by blocks.

Blocks hold the adjacency of runs of vertices, about BLOCK_EDGES edges each, whole in one task. local_search() is the
table function on them: each round a kernel gets a block's adjacency and its mail, follows as many hops inside the block as
it likes, and gives back any number of rows; what other blocks need of them is sent there as mail. Only blocks with new
mail run. A vertex with more edges than a block is a block of its own, as a kernel works on whole neighbourhoods.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.primitives import numbered
from loomgraph.plans.superstep import Supersteps
from loomgraph.session import ensure_importable, materialize
from loomgraph.tables import Log, stored_by

#: Edges of a block: 32 MB as arrays, a few seconds of a kernel's time.
BLOCK_EDGES = 1 << 21


@dataclass(frozen=True)
class Blocks:
    """Vertices in runs of an order, with the edges of each run.

    edges: (block, pos, src, dst, more...) bucketed by block; a vertex without edges has one row whose dst is NULL.
    owners: (id, block) and audience: (id, block), the other blocks that have an edge to id; both bucketed by id.
    """

    edges: DataFrame
    owners: DataFrame
    audience: DataFrame

    @staticmethod
    def build(vertices: DataFrame, edges: DataFrame, order: list[str], more: tuple[str, ...] = (), size: int | None = None) -> Blocks:
        """vertices: (id, deg) and the columns of order, which settle ties; more: columns of vertices that a kernel needs.

        A block ends with the vertex whose edges fill it up. edges: (src, dst, ...), of which a kernel sees those of its sources.
        """
        placed = numbered(vertices.withColumn("load", F.col("deg") + 1), *order, weight="load")
        block = F.floor((F.col("place") + F.col("load") - 1) / F.lit(size or BLOCK_EDGES))
        placed = materialize(placed.select("id", block.alias("block"), F.col("place").alias("pos"), *more), "placed")
        owners = stored_by(placed.select("id", "block"), "id", "owners")
        to = owners.select(F.col("id").alias("to_id"), F.col("block").alias("to_block"))
        kept = placed.withColumnRenamed("id", "src").join(edges, "src", "left").join(to, F.col("dst") == F.col("to_id"), "left").drop("to_id")
        kept = stored_by(kept, "block", "blocks")
        audience = stored_by(kept.where("to_block <> block").select(F.col("dst").alias("id"), "block").distinct(), "id", "audience")
        return Blocks(kept.drop("to_block"), owners, audience)


#: What a kernel gives: ids, values, and whether its own block shall go on with that row in the next round.
Kernel = Callable[["Adjacency", dict], tuple[np.ndarray, np.ndarray, np.ndarray]]


def local_search(blocks: Blocks, kernel: Kernel, start: DataFrame | None = None, listening: bool = True, steps: Supersteps | None = None) -> DataFrame:
    """(id, value, turn): all rows that the kernel gave, and those of start (turn -1).

    kernel(adjacency, mail): mail holds arrays id, value, turn, own (the id is the block's), news (not its own doing), of all
    rows that the block has had so far, by turn, and now, the turn. A row goes to the block of its id and, if listening, to
    the other blocks that have an edge to the id. start: rows (id, value) that wake their blocks; without it all blocks run
    in the first round. A round reads edges, owners and mail where they lie; only new rows are dealt out and written.
    """
    steps = steps or Supersteps()
    ensure_importable(blocks.edges.sparkSession)
    mail, readers = Log("block", "mail"), blocks.owners.select("id", "block", F.lit(True).alias("own"))
    if listening:
        readers = readers.unionByName(blocks.audience.select("id", "block", F.lit(False).alias("own")))

    def send(rows: DataFrame, turn: int) -> int:
        """Rows (id, value, giver) become mail; the number of those that wake a block."""
        post = rows.join(readers, "id").select("block", "id", "value", F.lit(turn).alias("turn"), "own", (F.col("block") != F.col("giver")).alias("news"))
        return mail.append(post, news=F.count_if("news"))["news"] or 0

    def run(now: int):
        def work(key, edges: pa.Table, rows: pa.Table) -> pa.Table:
            order = np.argsort(rows.column("turn").to_numpy(), kind="stable")
            ids, values, again = kernel(Adjacency(edges), {c: rows.column(c).to_numpy(zero_copy_only=False)[order] for c in ("id", "value", "turn", "own", "news")} | {"now": now})
            givers = np.where(again, -1, key[0].as_py())
            return pa.table({"id": pa.array(ids, pa.int64()), "value": pa.array(values, pa.int64()), "giver": pa.array(givers, pa.int64())})

        return work

    everybody = start is None
    if everybody:
        start = blocks.owners.select("id", F.lit(0).cast("long").alias("value")).limit(0)
    awake, turn = send(start.select("id", "value", F.lit(-1).cast("long").alias("giver")), -1), 0
    while (awake or (everybody and not turn)) and turn != steps.max_rounds:
        began, edges, post = time.time(), blocks.edges, mail.read()
        if turn or not everybody:
            # Both sides lie by block, so neither this nor the grouping moves a row.
            news = post.where((F.col("turn") == turn - 1) & F.col("news")).select("block").distinct()
            edges, post = (x.join(news, "block", "left_semi") for x in (edges, post))
        given = edges.groupBy("block").cogroup(post.groupBy("block")).applyInArrow(run(turn), "id long, value long, giver long")
        awake = send(given, turn)
        steps.log.append((turn, awake, time.time() - began))
        turn += 1
    return mail.read().where("own").select("id", "value", "turn")


class Adjacency:
    """A block as arrays: vertex i is ids[i], in the order of the blocks; its edges go to targets[bounds[i]:bounds[i + 1]]."""

    def __init__(self, edges: pa.Table):
        self._edges, pos = edges, edges.column("pos").to_numpy()
        order = np.argsort(pos, kind="stable")
        pos = pos[order]
        self._first = order[np.flatnonzero(np.append(True, pos[1:] != pos[:-1]))]
        real = edges.column("dst").is_valid().to_numpy()[order]
        self._real = order[real]
        self.ids = edges.column("src").to_numpy()[self._first]
        self.targets = self.of_edges("dst")
        self.bounds = np.concatenate([[0], np.cumsum(real)])[np.append(np.flatnonzero(np.append(True, pos[1:] != pos[:-1])), len(pos))]
        self._sorted = np.argsort(self.ids, kind="stable")

    def of_edges(self, name: str) -> np.ndarray:
        return self._edges.column(name).take(pa.array(self._real)).to_numpy()

    def of_vertices(self, name: str) -> np.ndarray:
        return self._edges.column(name).take(pa.array(self._first)).to_numpy()

    def index(self, ids: np.ndarray) -> np.ndarray:
        """Which vertices of the block ids are; -1 for others."""
        found = self._sorted[np.minimum(np.searchsorted(self.ids, ids, sorter=self._sorted), len(self.ids) - 1)]
        return np.where(self.ids[found] == ids, found, -1)


def last_values(ids: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: int) -> np.ndarray:
    """For each wanted id the value of its last row, else missing."""
    if not len(ids):
        return np.full(len(wanted), missing, np.int64)
    order = np.argsort(ids, kind="stable")
    at = np.searchsorted(ids[order], wanted, "right") - 1
    found = order[np.maximum(at, 0)]
    return np.where((at >= 0) & (ids[found] == wanted), values[found], missing)
