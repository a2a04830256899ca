"""Mixture-controlled packing: windows of WINDOW tokens filled from source queues in target token proportions.

Every source is a queue; beyond QUEUES sources, which bounds what the driver holds, sources are hashed to QUEUES queues
whose targets are the sums of their sources'. The documents of a queue form one token stream, and every window takes
each queue's quota from the front of its stream. Quotas are those of deficit round-robin in closed form: a queue's
tokens up to a window are the difference of two floors of cumulative shares, so its deficit stays below one token, is
carried from window to window and from partition to partition, and all quotas of a window add up to its length. A queue
whose share is less than a token a window gives one now and then. Proportions hold until a queue runs dry; the others
then go on in their own proportions, and queues without a target come last.

Positions in a stream are two-level prefix sums over (queue, salt) blocks of bounded size, so a hot source is never one
task's work; each document then finds its own pieces from the small table of quotas. Only the last window is not full.

Defined results: null text is empty and holds the end id only; equal rows are different documents, told apart by copy
(ties stand in any order, as their ids are the same); null source is a queue of its own; a very long text is encoded
whole and cut over as many windows as it needs; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.llm import tokens
from loomgraph.session import ensure_importable, materialize, shuffle_partitions

WINDOW = 2048
END_ID = 1
QUEUES = 512
#: Tokens of a (queue, salt) block, about.
BLOCK_TOKENS = 1 << 22
#: Target proportions of the sources in the order of their names, null last, repeating.
WEIGHTS = (3, 1, 2)
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, copy long"


def encode(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, source, n_tokens, ids: the ids of each document with its end id, as little-endian integers."""
    ensure_importable(docs.sparkSession)
    path = tokenizer or tokens.default_tokenizer()

    def run(batches):
        model = tokens.encoder(path)
        end = np.array([end_id], model.dtype).tobytes()
        for batch in batches:
            for first, part in tokens.encoded(batch.column("text"), model):
                rows = batch.slice(first, len(part))
                n = [len(x) // model.dtype.itemsize + 1 for x in part]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc_id"), rows.column("source"), pa.array(n, pa.int64()), pa.array([x + end for x in part], pa.binary())],
                    names=["doc_id", "source", "n_tokens", "ids"],
                )

    own = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text").cast("string"))
    return own.mapInArrow(run, "doc_id long, source string, n_tokens long, ids binary")


def share(part: np.ndarray, at: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """floor(part * at / whole) for part, at <= whole < 2**62, whose products have 128 bits.

    An estimate with 64 bits of mantissa is off by a few at most; the remainder, right modulo 2**64, tells by how many.
    """
    out = np.floor(part.astype(np.longdouble) * at.astype(np.longdouble) / whole.astype(np.longdouble)).astype(np.int64)
    product = part.astype(np.uint64) * at.astype(np.uint64)
    rest = (product - out.astype(np.uint64) * whole.astype(np.uint64)).view(np.int64)
    for _ in range(4):
        step = (rest >= whole).astype(np.int64) - (rest < 0)
        out, rest = out + step, rest - step * whole
    return out


class Quotas:
    """What each queue gives to each window. sizes: tokens of each queue; weights: target proportions, sizes if None."""

    def __init__(self, sizes: list[int], weights: list[float] | None = None, window: int = WINDOW):
        self.window = window
        wanted = [float(x) for x in (sizes if weights is None else weights)]
        #: of each phase, its global start and length, and for each queue the tokens before and the running sum inside
        at, taken, begins, lengths, before, running = 0, [0] * len(sizes), [], [], [], []
        for active in ([w if s else 0.0 for s, w in zip(sizes, wanted)], [0.0 if w > 0 else float(s) for s, w in zip(sizes, wanted)]):
            dry = sorted({s / w for s, w in zip(sizes, active) if w > 0}) if weights is not None or not any(w > 0 for w in wanted) else [1.0] * any(active)
            for t in dry:
                upto = [u if w <= 0 else s if weights is None or s / w <= t else max(u, min(s, int(w * t))) for s, w, u in zip(sizes, active, taken)]
                sums = np.cumsum([0, *[b - a for a, b in zip(taken, upto)]])
                if sums[-1]:
                    begins.append(at)
                    lengths.append(int(sums[-1]))
                    before.append(taken)
                    running.append(sums)
                    at += int(sums[-1])
                taken = upto
        self.begins, self.lengths = np.array(begins, np.int64), np.array(lengths, np.int64)
        self.before = np.array([*before, taken], np.int64).reshape(len(before) + 1, len(sizes))
        self.running = np.array(running, np.int64).reshape(len(running), len(sizes) + 1)

    def pieces(self, queue: np.ndarray, first: np.ndarray, n: np.ndarray):
        """(document, start, length, sequence, offset) arrays for documents at [first, first + n) of their queues."""
        low, count = np.zeros(len(queue), np.int64), np.zeros(len(queue), np.int64)
        for q in np.unique(queue):
            own = np.flatnonzero(queue == q)
            ends = self.before[1:, q]
            low[own] = np.searchsorted(ends, first[own], "right")
            count[own] = np.searchsorted(ends, first[own] + n[own], "left") - low[own] + 1
        doc = np.repeat(np.arange(len(queue)), count)
        phase = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + low[doc]
        base = self.before[phase, queue[doc]]
        under, over = self.running[phase, queue[doc]], self.running[phase, queue[doc] + 1]
        a = np.maximum(first[doc] - base, 0)
        b = np.minimum(first[doc] + n[doc] - base, over - under)
        some = b > a
        doc, phase, base, under, over, a, b = (x[some] for x in (doc, phase, base, under, over, a, b))
        at, length = self.begins[phase], self.lengths[phase]
        scale = length / (over - under)
        w0 = np.maximum((at + a * scale).astype(np.int64) // self.window - 2, at // self.window)
        w1 = np.minimum((at + b * scale).astype(np.int64) // self.window + 2, (at + length - 1) // self.window)
        many = w1 - w0 + 1
        row = np.repeat(np.arange(len(doc)), many)
        w = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + w0[row]
        at, length, under, over = at[row], length[row], under[row], over[row]
        g0 = np.maximum(w * self.window, at) - at
        g1 = np.minimum((w + 1) * self.window, at + length) - at
        under0 = share(under, g0, length)
        q0, q1 = share(over, g0, length) - under0, share(over, g1, length) - share(under, g1, length)
        s, e = np.maximum(q0, a[row]), np.minimum(q1, b[row])
        keep = e > s
        start = s + base[row] - first[doc[row]]
        offset = at + g0 - w * self.window + (share(under, g1, length) - under0) + (s - q0)
        return tuple(x[keep] for x in (doc[row], start, e - s, w, offset))


def pack(docs: DataFrame, targets: dict | tuple | None = None, tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document; see PIECES.

    targets: proportions by source, or a cycle of proportions for the sources in order; those of the input if None.
    """
    spark = docs.sparkSession
    width = 2 if tokens.encoder(tokenizer or tokens.default_tokenizer()).dtype.itemsize == 2 else 4
    encoded = materialize(encode(docs, tokenizer, end_id), "packing")
    by_source = materialize(encoded.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), "sources")
    if by_source.count() <= QUEUES:
        names = [r["source"] for r in by_source.orderBy(F.col("source").asc_nulls_last()).collect()]
        own = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "queue_source string, own_queue int")
        queued = encoded.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("queue_source")), "left").withColumn("queue", F.col("own_queue"))
        weights = None if targets is None else [float(targets.get(s, 0.0)) for s in names] if isinstance(targets, dict) else [float(targets[i % len(targets)]) for i in range(len(names))]
        hashed = by_source.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("queue_source"))).withColumn("queue", F.col("own_queue"))
    else:
        queue = F.pmod(F.xxhash64("source"), F.lit(QUEUES)).cast("int")
        queued, hashed, weights = encoded.withColumn("queue", queue), by_source.withColumn("queue", queue), None
        if targets is not None:
            if isinstance(targets, dict):
                wanted = spark.createDataFrame([(k, float(v)) for k, v in targets.items()], "w_source string, weight double")
                weighed = hashed.join(wanted, F.col("source").eqNullSafe(F.col("w_source")))
            else:
                place = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(targets)))
                weighed = hashed.withColumn("weight", F.get(F.array(*[F.lit(float(x)) for x in targets]), place))
            found = dict(weighed.groupBy("queue").agg(F.sum("weight")).collect())
            weights = [found.get(q, 0.0) for q in range(QUEUES)]
    sizes = dict(hashed.groupBy("queue").agg(F.sum("tokens")).collect())  # at most QUEUES rows
    sizes = [sizes.get(q, 0) for q in range(max(sizes, default=-1) + 1)]
    quotas = Quotas(sizes, None if weights is None else weights[: len(sizes)], window)
    salts = max(shuffle_partitions(spark), sum(sizes) // BLOCK_TOKENS + 1)
    queued = queued.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("long"))
    blocks = queued.groupBy("queue", "salt").agg(F.sum("n_tokens").alias("block_tokens"))
    before = Window.partitionBy("queue").orderBy("salt")
    placed = blocks.withColumn("block_start", F.sum("block_tokens").over(before) - F.col("block_tokens")).select(
        F.col("queue").alias("b_queue"), F.col("salt").alias("b_salt"), "block_start"
    )
    order = Window.partitionBy("queue", "salt").orderBy("doc_id", "n_tokens")
    located = (
        queued.join(placed, (F.col("queue") == F.col("b_queue")) & (F.col("salt") == F.col("b_salt")))
        .withColumns(
            {
                "first": F.col("block_start") + F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"),
                "copy": F.row_number().over(order) - F.rank().over(Window.partitionBy("queue", "salt").orderBy("doc_id")) + 1,
            }
        )
        .select("doc_id", "queue", "first", "n_tokens", "ids", F.col("copy").cast("long").alias("copy"))
    )
    kind = np.dtype(f"<u{width}")

    def cut(batches):
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            doc, start, length, sequence, offset = quotas.pieces(batch.column("queue").to_numpy(), batch.column("first").to_numpy(), n)
            if not len(doc):
                continue
            order = np.lexsort((start, doc))
            doc, start, length, sequence, offset = (x[order] for x in (doc, start, length, sequence, offset))
            raw = batch.column("ids")
            crc = np.zeros(len(doc), np.int64)
            bounds = np.searchsorted(doc, np.arange(len(n) + 1))
            for d in range(len(n)):
                ids = memoryview(np.frombuffer(raw[d].as_buffer(), kind).astype("<u4")).cast("B")
                for p in range(bounds[d], bounds[d + 1]):
                    crc[p] = zlib.crc32(ids[4 * start[p] : 4 * (start[p] + length[p])])
            at = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(at), *(pa.array(x, pa.int64()) for x in (start, length, crc, n[doc], sequence, offset)), batch.column("copy").take(at)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "copy"],
            )

    return located.mapInArrow(cut, PIECES)
