"""Approximate nearest neighbours by Euclidean distance: multiprobe p-stable hashing.

A table hashes a vector with several functions floor((a.x + b) / W), a of normal (2-stable) numbers and W a multiple of
the projections' spread; the tuple is the vector's cell. A query visits its own cell and perturbed ones (up to two steps in
each function) in the order of the squared distance from its projections to the cell, which is the order of estimated
success, until it has visited as many cells as the index asks for. Candidates of all tables are merged and
ranked by their exact distance.

The number of functions grows with the logarithm of the number of vectors, so cells keep their size. The number of visits
is fitted: a bounded sample of queries (ASKED) is answered exactly by a pass over all vectors, and the visits are the least
with which the tables would have found RECALL of those neighbours. All vectors are indexed.

Layout: the first functions alone name a coarse cell of some thousand vectors. Vectors and queries go to the coarse cells
that they lie in or visit, are packed there in blocks of bounded size, and blocks meet in a join; a task scores a block of
queries against the visited rows of a block of vectors as matrices and keeps the nearest of each query. A coarse cell that
holds a third of all vectors is many blocks, which Spark's rebalancing deals to many tasks. Of equal vectors only the
k + 1 smallest ids can be among anybody's k nearest; the others are not indexed as candidates, though they ask.

The exact way for the rest: queries that found fewer than k vectors, and all if the sample says that no number of visits
reaches LEAST_RECALL, are held against all vectors in passes of at most PASS queries.

Defined results: vectors that are null, empty, zero or hold null or non-finite components take no part, nor do null ids;
vectors of different length never meet; of repeated ids each vector counts, the nearest one for its id, and none is a
neighbour of its own id; ties go to the smaller id; with fewer than k candidates all are returned; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.session import ensure_importable, materialize

NEAREST, TABLES, SEED = 10, 2, 20250611
#: Cell width in standard deviations of a projection; such a function splits the vectors in about e ** CUT parts of one size.
WIDTH, CUT = 2.0, 1.03
CELL_ROWS, COARSE_ROWS, BLOCK_ROWS, BLOCK_QUERIES = 16, 4096, 2048, 256
#: Vectors that measure the spread, queries that fit the visits; most visits to a table.
SAMPLE, ASKED, MOST_VISITS = 4096, 128, 1 << 16
RECALL, LEAST_RECALL = 0.97, 0.92
PASS = 2048
#: Most rows of a table that is broadcast.
SMALL = 50_000
#: Pairs that a task holds before it keeps the nearest only.
HELD = 200_000
STEPS = np.array([0, 1, -1, 2, -2], np.int64)
_FOLD = np.uint64(0x9E3779B97F4A7C15)

CLEAN = "vec_id long, dim int, vector binary, asked boolean"
PAIRS = "query_id long, vec_id long, score double"


def _binary(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binaries."""
    size = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column, dim: int, kind: str) -> np.ndarray:
    data, _ = _bytes(column)
    return np.frombuffer(data, kind).reshape(-1, dim)


def _bytes(column) -> tuple[memoryview, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]] if len(column) else memoryview(b""), offsets


def _clean(kind: str):
    """Batches of (vec_id, embedding, asked): the vectors that take part, as bytes; negative zeros become zeros."""

    def run(batches):
        for batch in batches:
            ids, lists, asked = batch.columns
            lists = lists.filter(keep := pc.and_(ids.is_valid(), lists.is_valid()))
            ids, asked = (np.asarray(x.filter(keep)) for x in (ids, asked))
            values = np.asarray(pc.fill_null(lists.flatten(), math.nan), np.dtype(kind)) + np.dtype(kind).type(0)
            sizes = np.asarray(pc.list_value_length(lists), np.int64)
            firsts = np.cumsum(sizes) - sizes
            for dim in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == dim)
                rows = values[firsts[at][:, None] + np.arange(dim)]
                good = np.isfinite(rows).all(1) & (rows != 0).any(1)
                at, rows = at[good], rows[good]
                yield pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(np.full(len(at), dim, np.int32)), _binary(rows), pa.array(asked[at], pa.bool_())], names=["vec_id", "dim", "vector", "asked"])

    return run


@dataclass(frozen=True)
class Hashes:
    """Tables of hash functions for vectors of one length."""

    kind: str
    dim: int
    directions: np.ndarray  # table, dim, function
    shifts: np.ndarray  # table, function
    widths: np.ndarray
    coarse: int  # functions that name the coarse cell

    @staticmethod
    def fit(sample: np.ndarray, n: int, kind: str, tables: int = TABLES) -> Hashes:
        functions = max(1, round(math.log(max(2, n / CELL_ROWS)) / CUT))
        coarse = min(functions, max(0, int(math.log(max(1, n / COARSE_ROWS)) / CUT)))
        rng = np.random.default_rng(SEED)
        directions = rng.standard_normal((tables, sample.shape[1], functions))
        spread = np.std(sample.astype(np.float64) @ directions, axis=1)
        widths = np.where(spread > 0, WIDTH * spread, 1.0)
        return Hashes(kind, sample.shape[1], directions, rng.uniform(0, 1, widths.shape) * widths, widths, coarse)

    def places(self, rows: np.ndarray, table: int) -> np.ndarray:
        """Where the rows' projections lie, in cell widths."""
        return (rows.astype(np.float64) @ self.directions[table] + self.shifts[table]) / self.widths[table]

    @staticmethod
    def extend(names: np.ndarray, steps: np.ndarray) -> np.ndarray:
        return T.mix(names * _FOLD + steps.astype(np.int64).view(np.uint64))

    def cells(self, rows: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """The names of the rows' coarse cells and cells."""
        at = np.floor(self.places(rows, table)).astype(np.int64)
        names = np.zeros(len(rows), np.uint64)
        coarse = names
        for j in range(at.shape[1]):
            names = self.extend(names, np.ascontiguousarray(at[:, j]))
            if j + 1 == self.coarse:
                coarse = names
        return coarse, names

    def visits(self, place: np.ndarray, table: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Coarse cells and cells of one query's first visits, in order.

        Function by function the best partial sums are kept: a step of nought costs nothing, so what is among the best
        sums at the end has been among the best of every beginning.
        """
        at = np.floor(place)
        inside = place - at
        sums, names = np.zeros(1), np.zeros(1, np.uint64)
        coarse = names
        for j in range(len(place)):
            gaps = np.array([0.0, 1 - inside[j], inside[j], 2 - inside[j], 1 + inside[j]]) * self.widths[table, j]
            total = (sums[:, None] + (gaps * gaps)[None, :]).ravel()
            new = self.extend(np.repeat(names, len(STEPS)), np.tile(int(at[j]) + STEPS, len(sums)))
            own = np.repeat(coarse, len(STEPS))
            if len(total) > most:
                best = np.argpartition(total, most - 1)[:most]
                total, new, own = total[best], new[best], own[best]
            sums, names, coarse = total, new, own
            if j + 1 == self.coarse:
                coarse = names
        order = np.lexsort((names, sums))
        return coarse[order], names[order]

    def find_visits(self, asked: np.ndarray, found: list[np.ndarray]) -> tuple[int, float]:
        """(visits, recall): the least with which the tables hold RECALL of the vectors found of each query."""
        limit = 1 << 10
        most = min(MOST_VISITS, len(STEPS) ** min(self.widths.shape[1], 12))
        places = [self.places(asked, t) for t in range(len(self.widths))]
        while True:
            ranks = []
            for i, rows in enumerate(found):
                best = np.full(len(rows), limit)
                for t in range(len(self.widths)):
                    _, names = self.visits(places[t][i], t, limit)
                    order = np.argsort(names)
                    own = self.cells(rows, t)[1]
                    at = np.minimum(np.searchsorted(names[order], own), len(names) - 1)
                    best = np.minimum(best, np.where(names[order][at] == own, order[at], limit))
                ranks.append(best)
            ranked = np.sort(np.concatenate(ranks)) if ranks else np.zeros(0, int)
            need = math.ceil(RECALL * len(ranked)) - 1
            if not len(ranked) or ranked[need] < limit or limit >= most:
                recall = float(np.mean(ranked < limit)) if len(ranked) else 1.0
                return (int(ranked[need]) + 1, RECALL) if len(ranked) and ranked[need] < limit else (limit, recall)
            limit *= 4


def _nearest(queries: np.ndarray, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, seen: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(query ids, vec ids, scores) of the k nearest rows of each query, of those it sees; ties at the end stay in."""
    q, x = queries.astype(np.float64), rows.astype(np.float64)
    squares = (x * x).sum(1)
    near = (q * q).sum(1)[:, None] + squares[None, :] - 2 * (q @ x.T)
    hidden = own[:, None] == ids[None, :]
    near[hidden if seen is None else hidden | ~seen] = np.inf
    if len(rows) > k:
        last = np.partition(near, k - 1, axis=1)[:, k - 1]
    else:
        last = np.full(len(q), np.inf)
    # Rounding of the matrix form must not decide: what is as near within it is measured again.
    slack = 1e-9 * (squares.max(initial=0) + (q * q).sum(1))
    i, j = np.nonzero((near <= (last + slack)[:, None]) & (near < np.inf))
    gap = q[i] - x[j]
    return own[i], ids[j], np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _keep(query: np.ndarray, vec: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k nearest different ids of each query."""
    order = np.lexsort((score, vec, query))
    query, vec, score = query[order], vec[order], score[order]
    first = np.ones(len(query), bool)
    first[1:] = (query[1:] != query[:-1]) | (vec[1:] != vec[:-1])
    query, vec, score = query[first], vec[first], score[first]
    order = np.lexsort((vec, score, query))
    query, vec, score = query[order], vec[order], score[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, int)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[place < k], vec[place < k], score[place < k]


class _Best:
    """Pairs of a task; those that cannot be among the k nearest go when many are held."""

    def __init__(self, k: int):
        self.k, self.parts, self.n = k, [], 0

    def add(self, part: tuple[np.ndarray, ...]):
        self.parts.append(part)
        self.n += len(part[0])
        if self.n > HELD:
            kept = self._merged()
            self.parts, self.n = [kept], len(kept[0])
            if self.n > HELD // 2:
                yield from self.out()

    def _merged(self) -> tuple[np.ndarray, ...]:
        return _keep(*(np.concatenate(x) for x in zip(*self.parts, strict=True)), self.k)

    def out(self):
        if self.parts:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in self._merged()], names=["query_id", "vec_id", "score"])
        self.parts, self.n = [], 0


def _scan(vectors: DataFrame, ids: np.ndarray, queries: np.ndarray, kind: str, k: int) -> DataFrame:
    """The nearest of all vectors for a bounded number of queries, at most k of each from a task."""
    dim = queries.shape[1]

    def run(batches):
        best = _Best(k)
        for batch in batches:
            rows, names = _matrix(batch.column("vector"), dim, kind), np.asarray(batch.column("vec_id"))
            for a in range(0, len(rows), BLOCK_ROWS):
                for b in range(0, len(queries), BLOCK_QUERIES):
                    yield from best.add(_nearest(queries[b : b + BLOCK_QUERIES], ids[b : b + BLOCK_QUERIES], rows[a : a + BLOCK_ROWS], names[a : a + BLOCK_ROWS], k))
        yield from best.out()

    return vectors.select("vec_id", "vector").mapInArrow(run, PAIRS)


def _top(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest ids of each query: a query's pairs are few, as every task sends at most k."""
    once = pairs.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _taken(rows: DataFrame, n: int, kind: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of at most n rows, by a hash of the id and the bytes."""
    got = rows.orderBy(F.xxhash64("vec_id"), F.xxhash64("vector")).limit(n).select("vec_id", "vector").collect()
    return np.array([r["vec_id"] for r in got], np.int64), np.frombuffer(b"".join(bytes(r["vector"]) for r in got), kind).reshape(-1, dim)


def without_copies(clean: DataFrame, k: int) -> DataFrame:
    """clean without those of equal vectors whose id is not among the k + 1 smallest of them."""
    named = clean.withColumns({"k1": F.xxhash64("vector"), "k2": F.hash("vector")})
    heavy = named.groupBy("dim", "k1", "k2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).drop("n")
    ids = named.select("dim", "k1", "k2", "vec_id").join(heavy, ["dim", "k1", "k2"], "left_semi").distinct()
    place = F.row_number().over(Window.partitionBy("dim", "k1", "k2").orderBy("vec_id"))
    last = materialize(ids.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("dim", "k1", "k2").agg(F.max("vec_id").alias("last_id")), "copies")
    n = last.count()
    if not n:
        return clean
    joined = named.join(F.broadcast(last) if n <= SMALL else last, ["dim", "k1", "k2"], "left")
    return joined.where(F.col("last_id").isNull() | (F.col("vec_id") <= F.col("last_id"))).select(*clean.columns)


def _packed(rows: DataFrame, most: int, schema: str) -> DataFrame:
    """Rows of one coarse cell packed in blocks of at most most rows: binaries of their columns, sorted by cell.

    Spark deals the rows by coarse cell, splits partitions that get too large, and sorts each.
    """
    columns = [c for c in rows.columns if c not in ("table", "coarse")]

    def run(batches):
        key, held, n = None, [], 0

        def block():
            out = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64())]
            for c in range(len(columns)):
                out.append(pa.array([b"".join(part[c] for part in held)], pa.binary()))
            sizes = np.concatenate([part[-1] for part in held])
            return pa.RecordBatch.from_arrays([*out, pa.array([sizes.tobytes()], pa.binary())], names=["table", "coarse", *columns, "sizes"])

        for batch in batches:
            tables, coarse = (np.asarray(batch.column(c)) for c in ("table", "coarse"))
            new = np.flatnonzero((tables[1:] != tables[:-1]) | (coarse[1:] != coarse[:-1])) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(tables)], strict=True):
                if a == b:
                    continue
                here = (int(tables[a]), int(coarse[a]))
                while a < b:
                    if held and (here != key or n >= most):
                        yield block()
                        held, n = [], 0
                    key, m = here, min(b - a, most - n)
                    part = []
                    sizes = np.zeros(m, np.int32)
                    for c in columns:
                        column = batch.column(c).slice(a, m)
                        if pa.types.is_binary(column.type):
                            data, offsets = _bytes(column)
                            part.append(bytes(data))
                            sizes = np.diff(offsets).astype(np.int32)
                        else:
                            part.append(np.asarray(column).tobytes())
                    held.append([*part, sizes])
                    n += m
                    a += m
        if held:
            yield block()

    order = [c for c in ("table", "coarse", "cell") if c in rows.columns]
    return rows.hint("rebalance", "table", "coarse").sortWithinPartitions(*order).mapInArrow(run, schema)


def _index(vectors: DataFrame, hashes: Hashes) -> DataFrame:
    """Blocks of vectors by table and coarse cell: every vector once in each table."""

    def place(batches):
        for batch in batches:
            rows = _matrix(batch.column("vector"), hashes.dim, hashes.kind)
            for t in range(len(hashes.widths)):
                coarse, cells = hashes.cells(rows, t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), t, np.int32)), pa.array(coarse.view(np.int64)), pa.array(cells.view(np.int64)), batch.column("vec_id"), batch.column("vector")],
                    names=["table", "coarse", "cell", "vec_id", "vector"],
                )

    placed = vectors.select("vec_id", "vector").mapInArrow(place, "table int, coarse long, cell long, vec_id long, vector binary")
    return _packed(placed, BLOCK_ROWS, "table int, coarse long, cell binary, vec_id binary, vector binary, sizes binary").drop("sizes")


def _asked(queries: DataFrame, hashes: Hashes, visits: int) -> DataFrame:
    """Blocks of queries by table and coarse cell that they visit, each with the cells that it visits there."""

    def place(batches):
        for batch in batches:
            rows, ids = _matrix(batch.column("vector"), hashes.dim, hashes.kind), np.asarray(batch.column("vec_id"))
            for t in range(len(hashes.widths)):
                places, out = hashes.places(rows, t), []
                for i in range(len(rows)):
                    coarse, cells = hashes.visits(places[i], t, visits)
                    order = np.argsort(coarse, kind="stable")  # the order of visits stays inside a coarse cell
                    names, firsts = np.unique(coarse[order], return_index=True)
                    for name, part in zip(names.view(np.int64).tolist(), np.split(cells[order], firsts[1:]), strict=True):
                        out.append((t, name, ids[i], rows[i].tobytes(), part.tobytes()))
                    if len(out) > 4096:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    def batch_of(out):
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["table", "coarse", "query_id", "query", "visited"])

    placed = queries.select("vec_id", "vector").mapInArrow(place, "table int, coarse long, query_id long, query binary, visited binary")
    return _packed(placed, BLOCK_QUERIES, "table int, coarse long, query_id binary, query binary, visited binary, sizes binary")


def _meet(hashes: Hashes, k: int):
    """Joined blocks: the nearest of the rows whose cells a query visits."""

    def run(batches):
        best = _Best(k)
        for batch in batches:
            for row in batch.to_pylist():
                cells, firsts, cell = np.unique(np.frombuffer(row["cell"], np.uint64), return_index=True, return_inverse=True)
                visited = np.frombuffer(row["visited"], np.uint64)
                query = np.repeat(np.arange(len(row["sizes"]) // 4), np.frombuffer(row["sizes"], np.int32) // 8)
                at = np.minimum(np.searchsorted(cells, visited), len(cells) - 1)
                hit = cells[at] == visited
                sees = np.zeros((len(row["sizes"]) // 4, len(cells)), bool)
                sees[query[hit], at[hit]] = True
                some, some_cells = sees.any(1), sees.any(0)
                if some.any():
                    near = some_cells[cell]
                    rows, queries = (np.frombuffer(row[c], hashes.kind).reshape(-1, hashes.dim) for c in ("vector", "query"))
                    ids, own = (np.frombuffer(row[c], np.int64) for c in ("vec_id", "query_id"))
                    yield from best.add(_nearest(queries[some], own[some], rows[near], ids[near], k, sees[some][:, cell[near]]))
        yield from best.out()

    return run


def _of_length(clean: DataFrame, dim: int, n: int, kind: str, k: int) -> DataFrame:
    """The result for the vectors of one length."""
    clean = clean.where(F.col("dim") == dim)
    queries, vectors = clean.where("asked"), without_copies(clean, k)
    hashes = Hashes.fit(_taken(vectors, SAMPLE, kind, dim)[1], n, kind)
    ids, asked = _taken(queries, ASKED, kind, dim)
    truth = _top(_scan(vectors, ids, asked, kind, k), k).select("query_id", "vec_id").collect()  # at most ASKED * k rows
    wanted = sorted({r["vec_id"] for r in truth})
    there = vectors.join(F.broadcast(vectors.sparkSession.createDataFrame([(x,) for x in wanted], "vec_id long")), "vec_id", "left_semi").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    of = {r["vec_id"]: np.frombuffer(bytes(r["vector"]), kind) for r in there.collect()} if wanted else {}
    found = {int(i): [] for i in ids}
    for r in truth:
        found[r["query_id"]].append(of[r["vec_id"]])
    visits, recall = hashes.find_visits(asked, [np.array(found[int(i)], dtype=kind).reshape(-1, dim) for i in ids])
    if recall < LEAST_RECALL:
        return _rest(queries, vectors, kind, dim, k)
    joined = _index(vectors, hashes).join(_asked(queries, hashes, visits), ["table", "coarse"]).drop("table", "coarse")
    result = materialize(_top(joined.mapInArrow(_meet(hashes, k), PAIRS), k), "nearest")
    full = result.where(F.col("rank") == k).select(F.col("query_id").alias("full_id"))
    lacking = queries.join(full, F.col("vec_id") == F.col("full_id"), "left_anti")
    return result.join(full, F.col("query_id") == F.col("full_id"), "left_semi").unionByName(_rest(lacking, vectors, kind, dim, k))


def _rest(queries: DataFrame, vectors: DataFrame, kind: str, dim: int, k: int) -> DataFrame:
    """The exact result, in passes of about PASS queries over all vectors."""
    queries = materialize(queries.select("vec_id", "vector"), "queries")
    passes = math.ceil(queries.count() / PASS)
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i in range(passes):
        ids, rows = _taken(queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == i), 1 << 30, kind, dim)
        out = out.unionByName(materialize(_top(_scan(vectors, ids, rows, kind, k), k), "nearest"))
    return out


def nearest(vectors: DataFrame, asked: Column, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of vectors(vec_id, embedding) for each row that asked holds for."""
    ensure_importable(vectors.sparkSession)
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if kind == "<f4" else "array<double>"), F.coalesce(asked, F.lit(False)).alias("asked"))
    clean = materialize(own.mapInArrow(_clean(kind), CLEAN), "vectors")
    out = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # Vectors have few lengths, most often one.
    for r in clean.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.count_if("asked").alias("asked")).where("asked > 0").orderBy("dim").collect():
        out = out.unionByName(_of_length(clean, r["dim"], r["n"], kind, k))
    return out
