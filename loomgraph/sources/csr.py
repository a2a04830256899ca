"""Graph files: binary CSR (one block or two) and adjacency text."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from pathlib import PurePosixPath

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from loomgraph.functions.strings import tokens
from loomgraph.graph import Graph
from loomgraph.operators.primitives import numbered
from loomgraph.session import ensure_importable

#: Fixed values of the formats.
HEADER_BYTES, PLAIN, WEIGHTED = 24, "AdjacencyGraph", "WeightedAdjacencyGraph"
#: Edges that a task hands over at once, and edges of a partition of a file.
BATCH, SPLIT_EDGES = 1 << 18, 1 << 24


def graph_name(path: str) -> str:
    return re.sub(r"\.[^.]*$", "", PurePosixPath(path).name)


def graph_name_of(path: Column) -> Column:
    """graph_name() of a column of paths: the last part without its last extension."""
    return F.regexp_replace(F.regexp_extract(F.regexp_replace(path, "/+$", ""), "[^/]*$", 0), r"\.[^.]*$", "")


def is_symmetric_name(path: str) -> bool:
    """A name with _sym marks a graph whose edges stand in both directions."""
    return "_sym" in PurePosixPath(path).name


def weighted_name(path: str, limit: int = 0, extension: str = ".bin") -> str:
    return f"{graph_name(path)}_wgh{limit or 'log'}{extension}"


@dataclass(frozen=True)
class Layout:
    """Where the sections of a block stand in its file: three counts, n + 1 offsets, m records of a target (and a weight)."""

    at: int
    n: int
    m: int
    size: int

    @property
    def weighted(self) -> bool:
        return self.size > HEADER_BYTES + 8 * (self.n + 1) + 4 * self.m

    @property
    def records(self) -> int:
        return self.at + HEADER_BYTES + 8 * (self.n + 1)

    @property
    def end(self) -> int:
        return self.at + self.size

    @staticmethod
    def read(file, at: int = 0) -> Layout:
        file.seek(at)
        n, m, size = (int(x) for x in np.frombuffer(file.read(HEADER_BYTES), "<u8", 3))
        plain = HEADER_BYTES + 8 * (n + 1) + 4 * m
        if size not in (plain, plain + 4 * m):
            raise ValueError(f"{size} bytes for {n} vertices and {m} edges is no CSR layout")
        return Layout(at, n, m, size)

    def offsets(self, file, first: int, count: int) -> np.ndarray:
        file.seek(self.at + HEADER_BYTES + 8 * first)
        return np.frombuffer(file.read(8 * min(count, self.n + 1 - first)), "<u8").astype(np.int64)

    def source_of(self, file, edge: int) -> int:
        """The vertex that has the edge, by bisecting the offsets in the file."""
        low, high = 0, self.n
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self.offsets(file, middle, 1)[0] <= edge else (low, middle)
        return low


def _open(path: str):
    """A file that Arrow's file systems can open: a local path or a URI such as hdfs:// or s3://."""
    system, inside = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inside)


def _layout(path: str, part: int = 0) -> Layout:
    with _open(path) as file:
        layout = Layout.read(file)
        for _ in range(part):
            layout = Layout.read(file, layout.end)
        return layout


class CsrEdges(DataSource):
    """Spark data source "loomgraph_csr": the edges of a binary CSR file, a partition for each range of about SPLIT_EDGES edges.

    Options: path, weight ("int", "float" or none), part (which block of the file). A task reads its range of the records and
    the offsets that it needs, so neither the file's size nor a vertex's degree meets a limit.
    """

    @classmethod
    def name(cls) -> str:
        return "loomgraph_csr"

    def schema(self) -> str:
        return "src long, dst long" + (f", wgh {weight}" if (weight := self.options.get("weight")) else "")

    def reader(self, schema) -> CsrReader:
        return CsrReader(self.options["path"], self.options.get("weight") or None, int(self.options.get("part", 0)), int(self.options.get("split", SPLIT_EDGES)))


class CsrReader(DataSourceReader):
    def __init__(self, path: str, weight: str | None, part: int, split: int):
        self.path, self.weight, self.split, self.layout = path, weight, split, _layout(path, part)

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(a) for a in range(0, self.layout.m, self.split)] or [InputPartition(0)]

    def read(self, partition: InputPartition):
        layout, a = self.layout, partition.value
        end = min(a + self.split, layout.m)
        if a >= end:
            return
        weight = "<f4" if self.weight == "float" else "<i4"
        record = np.dtype(([("wgh", weight)] if layout.weighted else []) + [("dst", "<u4")])
        with _open(self.path) as file:
            vertex = layout.source_of(file, a)
            while a < end:
                offsets = layout.offsets(file, vertex, BATCH)
                # The edges of the vertices whose ends are known.
                b = min(end, a + BATCH, int(offsets[-1]))
                if b > a:
                    file.seek(layout.records + record.itemsize * a)
                    rows = np.frombuffer(file.read(record.itemsize * (b - a)), record)
                    source = vertex + np.searchsorted(offsets, np.arange(a, b), "right") - 1
                    columns = [pa.array(source, pa.int64()), pa.array(rows["dst"].astype(np.int64))]
                    if self.weight:
                        kind = pa.float32() if self.weight == "float" else pa.int32()
                        columns.append(pa.array(np.ascontiguousarray(rows["wgh"]) if layout.weighted else np.ones(b - a), kind))
                    yield pa.RecordBatch.from_arrays(columns, names=["src", "dst", "wgh"][: len(columns)])
                    vertex, a = int(source[-1]), b
                else:
                    vertex += len(offsets) - 1


def read_binary(spark: SparkSession, path: str, weight: str | None = None, symmetric: bool | None = None, part: int = 0, split: int | None = None) -> Graph:
    """A binary CSR file of any size; weight: None, "int" or "float". part 1 is the second of two blocks, the in-edges of a double file."""
    ensure_importable(spark)
    spark.dataSource.register(CsrEdges)
    options = {"path": path, "weight": weight or "", "part": str(part), "split": str(split or SPLIT_EDGES)}
    known = is_symmetric_name(path) if symmetric is None else symmetric
    return Graph.from_edges(spark.read.format("loomgraph_csr").options(**options).load(), _layout(path, part).n, symmetric=known)


def read_double(spark: SparkSession, path: str) -> tuple[Graph, Graph]:
    """Out-edges and in-edges of a file with two blocks."""
    return read_binary(spark, path, part=0, symmetric=False), read_binary(spark, path, part=1, symmetric=False)


def _write_ranges(rows: DataFrame, kind: np.dtype, base: int, path: str) -> DataFrame:
    """(start, bytes): runs of rows (at, columns of kind) that tasks wrote, the row of position at to byte base + at * its size.

    A local (or mounted) file is written in place, so running a task again writes the same bytes to the same place; on
    other file systems a run is a part file named by its start.
    """
    local = "://" not in path or path.startswith("file:")

    def sink(start: int):
        if local:
            out = open(path.removeprefix("file://"), "r+b")
            out.seek(start)
            return out
        system, inside = fs.FileSystem.from_uri(path)
        return system.open_output_stream(f"{inside}.parts/{start:020d}")

    def write(batches):
        out, start, end = None, 0, 0
        for batch in batches:
            at = batch.column("at").to_numpy()
            order = np.argsort(at, kind="stable")
            at, records = at[order], np.empty(len(at), kind)
            for name in kind.names:
                records[name] = batch.column(name).to_numpy()[order]
            cuts = np.flatnonzero(np.diff(at) != 1) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True):
                if a == b:
                    continue
                if out is None or base + int(at[a]) * kind.itemsize != end:
                    if out:
                        out.close()
                        yield pa.RecordBatch.from_pydict({"start": [start], "bytes": [end - start]})
                    start = end = base + int(at[a]) * kind.itemsize
                    out = sink(start)
                out.write(records[a:b].tobytes())
                end += (b - a) * kind.itemsize
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"start": [start], "bytes": [end - start]})

    return rows.mapInArrow(write, "start long, bytes long")


def _join(spark: SparkSession, path: str, starts: list[int]) -> None:
    """Makes one file of the part files: by the file system where it can (HDFS), else as one copied stream."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    parts = [jvm.org.apache.hadoop.fs.Path(f"{path}.parts/{start:020d}") for start in starts]
    out = system.create(target, True)
    if path.startswith("hdfs:"):
        out.close()
        system.concat(target, _java_array(spark, parts))
    else:
        for part in parts:
            source = system.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
            source.close()
        out.close()
    system.delete(jvm.org.apache.hadoop.fs.Path(f"{path}.parts"), True)


def _java_array(spark: SparkSession, paths: list):
    out = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Path, len(paths))
    for i, x in enumerate(paths):
        out[i] = x
    return out


def write_binary(graph: Graph, path: str, *more: Graph) -> None:
    """One CSR file, edges by source and target; more graphs follow as blocks of their own. Tasks write their ranges of it;
    only ranges' starts reach the driver.

    Vertices are 0..n-1. A local path must be one that all executors see, such as a mounted folder.
    """
    spark = graph.edges.sparkSession
    ensure_importable(spark)
    base, blocks, counts = 0, [], np.dtype([("first", "<u8")])
    for one in (graph, *more):
        n, m = one.vertices.count(), one.edges.count()
        weight = "<f4" if dict(one.edges.dtypes).get("wgh") == "float" else "<i4"
        record = np.dtype(([("wgh", weight)] if one.weighted else []) + [("dst", "<u4")])
        size = HEADER_BYTES + 8 * (n + 1) + record.itemsize * m
        head = spark.createDataFrame([(i, x) for i, x in enumerate((n, m, size))] + [(3 + n, m)], "at long, first long").coalesce(1)
        firsts = one.offsets().select((F.col("id") + 3).alias("at"), "first").repartitionByRange("at").sortWithinPartitions("at")
        edges = numbered(one.edges, "src", *record.names[::-1]).select(F.col("place").alias("at"), *record.names)
        blocks += [(head, counts, base), (firsts, counts, base), (edges, record, base + HEADER_BYTES + 8 * (n + 1))]
        base += size
    if local := "://" not in path or path.startswith("file:"):
        with open(path.removeprefix("file://"), "wb") as out:
            out.truncate(base)
    written = reduce(DataFrame.unionByName, [_write_ranges(rows, kind, start, path) for rows, kind, start in blocks])
    ranges = sorted((r["start"], r["bytes"]) for r in written.collect())  # a row for each sorted part
    if sum(count for _, count in ranges) != base or any(a + count != b for (a, count), (b, _) in zip(ranges, ranges[1:], strict=False)):
        raise ValueError(f"vertices are not 0 to n - 1, or {path} was not written whole")
    if not local:
        _join(spark, path, [start for start, _ in ranges])


def write_double(graph: Graph, path: str) -> None:
    """A file of two blocks, the out-edges and the in-edges."""
    write_binary(graph, path, graph.transpose())


def check_layout(spark: SparkSession, path: str, part: int = 0) -> DataFrame:
    """One row: n_bad_targets (no vertex), n_bad_offsets (smaller than the one before, or beyond the edges), n_unsorted
    (a target below the one before it of the same source).

    Tasks read ranges of the sections as the reader does; each looks at the element before its range as well.
    """
    ensure_importable(spark)
    layout = _layout(path, part)
    record = np.dtype(([("wgh", "<i4")] if layout.weighted else []) + [("dst", "<u4")])

    def look(batches):
        for batch in batches:
            for kind, first, end in zip(*(batch.column(c).to_pylist() for c in ("kind", "first", "end")), strict=True):
                before = max(first - 1, 0)
                with _open(path) as file:
                    if kind == "offsets":
                        rows = layout.offsets(file, before, end - before)
                        found = (0, int((np.diff(rows) < 0).sum() + (rows[first - before :] > layout.m).sum()), 0)
                    else:
                        file.seek(layout.records + record.itemsize * before)
                        rows = np.frombuffer(file.read(record.itemsize * (end - before)), record)["dst"].astype(np.int64)
                        falls = before + 1 + np.flatnonzero(np.diff(rows) < 0)
                        # A fall is no fault where a source's edges begin.
                        begins = np.array([layout.offsets(file, layout.source_of(file, int(i)), 1)[0] == i for i in falls], bool)
                        found = (int((rows[first - before :] >= layout.n).sum()), 0, int((~begins).sum()))
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in found], names=["n_bad_targets", "n_bad_offsets", "n_unsorted"])

    step = SPLIT_EDGES
    ranges = [("offsets", a, min(a + step, layout.n + 1)) for a in range(0, layout.n + 1, step)] + [("targets", a, min(a + step, layout.m)) for a in range(0, layout.m, step)]
    rows = spark.createDataFrame(ranges, "kind string, first long, end long").repartition(len(ranges))
    names = ("n_bad_targets", "n_bad_offsets", "n_unsorted")
    return rows.mapInArrow(look, ", ".join(f"{c} long" for c in names)).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def write_weighted(spark: SparkSession, path: str, folder: str, limit: int = 0) -> str:
    """Reads a graph file, generates its weights and writes the binary file with the weights' name to folder."""
    out = f"{folder.rstrip('/')}/{weighted_name(path, limit)}"
    write_binary(read_graph(spark, path, weight_limit=limit), out)
    return out


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token) of a text file: positions from counts of file blocks, then of lines in a block.

    Of a folder, the files follow each other by name.
    """
    lines = spark.read.text(path).select("value", F.struct("_metadata.file_path", "_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    counted = lines.select("block", "line", tokens(F.col("value")).alias("t")).withColumn("n", F.size("t"))
    blocks = counted.groupBy(F.col("block").alias("b")).agg(F.sum("n").alias("n"))
    ahead = blocks.select("b", (F.sum("n").over(Window.orderBy("b")) - F.col("n")).alias("ahead"))
    before = F.sum("n").over(Window.partitionBy("block").orderBy("line")) - F.col("n")
    placed = counted.withColumn("before", before).join(ahead, F.col("block") == F.col("b"))
    return placed.select((F.col("ahead") + F.col("before")).alias("first"), F.posexplode("t").alias("i", "token")).select((F.col("first") + F.col("i")).alias("pos"), "token")


def read_adjacency(spark: SparkSession, path: str, weight: str | None = None, symmetric: bool | None = None) -> Graph:
    """Adjacency text: kind, n, m, n offsets, m targets, then m weights if the kind says so. weight None drops weights."""
    rows = _numbered(spark, path)
    head = {r["pos"]: r["token"] for r in rows.where("pos < 3").collect()}
    kind, n, m = head.get(0), int(head.get(1, 0)), int(head.get(2, 0))
    size = rows.agg(F.max("pos")).first()[0] + 1
    if kind not in (PLAIN, WEIGHTED) or size != 3 + n + m * (2 if kind == WEIGHTED else 1):
        raise ValueError(f"{path}: {size} tokens do not make a graph of kind {kind} with {n} vertices and {m} edges")
    offsets = rows.where((F.col("pos") >= 3) & (F.col("pos") < 3 + n)).select((F.col("pos") - 3).alias("id"), F.col("token").cast("long").alias("first"))
    following = offsets.select((F.col("id") - 1).alias("f_id"), F.col("first").alias("end"))
    spans = offsets.join(following, F.col("id") == F.col("f_id"), "left").select("id", "first", F.coalesce("end", F.lit(m)).alias("end")).where("end > first")
    own = spans.select(F.col("id").alias("src"), F.explode(F.sequence("first", F.col("end") - 1)).alias("i"))
    targets = rows.where((F.col("pos") >= 3 + n) & (F.col("pos") < 3 + n + m)).select((F.col("pos") - 3 - n).alias("t"), F.col("token").cast("long").alias("dst"))
    edges = own.join(targets, F.col("i") == F.col("t"))
    if weight is not None and kind == WEIGHTED:
        weights = rows.where(F.col("pos") >= 3 + n + m).select((F.col("pos") - 3 - n - m).alias("w"), F.col("token").cast(weight).alias("wgh"))
        edges = edges.join(weights, F.col("i") == F.col("w"))
    elif weight is not None:
        edges = edges.withColumn("wgh", F.lit(1).cast(weight))
    known = is_symmetric_name(path) if symmetric is None else symmetric
    return Graph.from_edges(edges.select("src", "dst", *(["wgh"] if weight is not None else [])), n, symmetric=known)


def read_both(spark: SparkSession, path: str, symmetric: bool | None = None) -> tuple[Graph, Graph]:
    """A graph and its inverse: itself if symmetric, the second block of a binary file that has two, else the transpose."""
    if path.endswith(".bin") and not (is_symmetric_name(path) if symmetric is None else symmetric):
        with _open(path) as file:
            two = file.size() > Layout.read(file).end
        if two:
            return read_double(spark, path)
    graph = read_graph(spark, path, symmetric=symmetric)
    return graph, graph.transpose()


def write_adjacency(graph: Graph, path: str) -> None:
    """A folder of text parts, one token a line, that read in order (and as a folder) as the file."""
    spark = graph.edges.sparkSession
    n, m = graph.vertices.count(), graph.edges.count()
    head = spark.createDataFrame([(0, i, 0, t) for i, t in enumerate([WEIGHTED if graph.weighted else PLAIN, str(n), str(m)])], "part int, a long, b long, token string")
    offsets = graph.offsets().select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("first").cast("string").alias("token"))
    parts = [offsets, graph.edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("token"))]
    if graph.weighted:
        parts.append(graph.edges.select(F.lit(3).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("wgh").cast("string").alias("token")))
    rows = head
    for part in parts:
        rows = rows.unionByName(part)
    rows.orderBy("part", "a", "b", "token").select("token").write.text(path)


def read_graph(spark: SparkSession, path: str, weight: str | None = None, weight_limit: int | None = None, symmetric: bool | None = None) -> Graph:
    """By extension .bin or .adj. weight_limit: generate weights up to it (0: the logarithm of n)."""
    if path.endswith(".bin"):
        graph = read_binary(spark, path, None if weight_limit is not None else weight, symmetric)
    elif path.endswith(".adj"):
        graph = read_adjacency(spark, path, None if weight_limit is not None else weight, symmetric)
    else:
        raise ValueError(f"neither .bin nor .adj: {path}")
    return graph if weight_limit is None else graph.with_generated_weights(graph.vertices.count(), weight_limit)
