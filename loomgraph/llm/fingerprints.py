"""Document fingerprints: invertible Bloom lookup sketches of hashed paragraph digests.

A paragraph is a line; long lines are split after a word at which the hash of the last ROLL words falls into one of
SPLIT classes, so a change moves cuts only near itself, and paragraphs are no longer for long texts. Paragraphs keep
their white space, and equal ones of one text are told apart by rank. The digest of each goes to one cell in each of
three parts of the sketch; a cell holds a count, the xor of its digests and the xor of their 64-bit checks.

All fingerprints have CELLS cells, so any two subtract. Peeling cells of one digest recovers the digests that differ;
if it gets stuck, both texts are sketched again with twice the cells, until it succeeds. Likeness is 1 - differing
digests / digests of both (two texts without paragraphs: 1).

Documents are dealt to ranges of doc_id of about equal weight, and each range gets the first document of the next one as
a follower, so a task streams its range in order and holds a slice of texts at a time.

Defined results: null text is empty; a text that has no word is one paragraph, an empty one none; among rows of one
doc_id the order is by text, rows without doc_id come first; a table of one row has itself as the next document; very
long texts are sketched whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.session import ensure_importable

#: Bytes of a range of documents, and the most ranges, which bounds what the driver holds.
BLOCK_BYTES = 8 << 20
MOST_BLOCKS = 1 << 16
ROLL, SPLIT = 4, 16
CELLS = 24
FIRST_ID = -(1 << 63)
_U = np.uint64
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
CELL = np.dtype([("count", "<u4"), ("xor", "<u8"), ("check", "<u8")])


def paragraphs(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, digest) of every paragraph of texts."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=offsets[1:])
    data = np.frombuffer(b"".join(texts), np.uint8)
    words = T.words(data, offsets)
    prefix = T.prefix_hash(data)
    n = len(words.starts)
    cut = np.zeros(n, bool)
    if n:
        line = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=line[1:])
        at = line[words.starts]
        cut[1:] = at[1:] != at[:-1]
        rolling = T.ngrams(T.span_hash(prefix, words.starts, words.ends), ROLL)
        ends = np.flatnonzero(T.window_starts(words.bounds, ROLL) & (rolling % _U(SPLIT) == 0)) + ROLL
        cut[ends[ends < n]] = True
        # a text starts its first paragraph itself, with the white space before its first word
        cut[words.bounds[:-1][np.diff(words.bounds) > 0]] = False
    starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], words.starts[cut])
    ends = np.append(starts[1:], len(data))[: len(starts)]
    of = np.searchsorted(offsets, starts, "right") - 1
    keys = T.span_hash(prefix, starts, ends)
    order = np.lexsort((keys, of))
    place = np.arange(len(order))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (of[order][1:] != of[order][:-1])
    rank = np.zeros(len(order), np.int64)
    rank[order] = place - np.maximum.accumulate(np.where(new, place, 0)) if len(order) else 0
    return of, T.mix(keys + rank.astype(_U) * _U(T._BASE))


def check_of(keys: np.ndarray) -> np.ndarray:
    return T.mix(keys ^ _U(0x5851F42D4C957F2D))


def cells_of(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    part = cells // 3
    return [(i * part + (T.mix(keys + _U(i + 1)) % _U(part)).astype(np.int64)) for i in range(3)]


def sketch(n: int, of: np.ndarray, keys: np.ndarray, cells: int = CELLS):
    """count, xor of digests, xor of checks: each of n rows of cells."""
    count, xor, check = np.zeros(n * cells, np.int64), np.zeros(n * cells, _U), np.zeros(n * cells, _U)
    checks = check_of(keys)
    for cell in cells_of(keys, cells):
        at = of * cells + cell
        np.add.at(count, at, 1)
        np.bitwise_xor.at(xor, at, keys)
        np.bitwise_xor.at(check, at, checks)
    return count, xor, check


def peel(n: int, cells: int, count: np.ndarray, xor: np.ndarray, check: np.ndarray):
    """(row, digest) recovered from rows of a subtracted sketch, each once, and which rows are recovered in full."""
    rows, digests, part = [], [], cells // 3
    for _ in range(cells):  # a row that can be recovered gives at least one digest a turn
        at = np.flatnonzero(np.abs(count) == 1)
        at = at[check_of(xor[at]) == check[at]]
        # a digest must stand in the cell that it falls to
        at = at[(T.mix(xor[at] + ((at % cells) // part + 1).astype(_U)) % _U(part)).astype(np.int64) == (at % cells) % part]
        if not len(at):
            break
        at = at[np.unique(np.stack([(at // cells).astype(_U), xor[at]], 1), axis=0, return_index=True)[1]]
        of, keys, sign = at // cells, xor[at], count[at]
        rows.append(of)
        digests.append(keys)
        checks = check_of(keys)
        for cell in cells_of(keys, cells):
            np.subtract.at(count, of * cells + cell, sign)
            np.bitwise_xor.at(xor, of * cells + cell, keys)
            np.bitwise_xor.at(check, of * cells + cell, checks)
    left = ((count != 0) | (xor != 0) | (check != 0)).reshape(n, cells).any(axis=1)
    row, digest = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((rows, np.int64), (digests, _U)))
    pairs, times = np.unique(np.stack([row.astype(_U), digest], 1), axis=0, return_counts=True)
    left[pairs[times > 1, 0].astype(np.int64)] = True  # it went round in a circle
    return pairs[:, 0].astype(np.int64), pairs[:, 1], ~left


def differing(n: int, a: tuple, b: tuple, cells: int = CELLS) -> np.ndarray:
    """Number of digests by which text i of a differs from text i of b, by subtracting sketches and peeling."""
    out, todo = np.zeros(n, np.int64), np.arange(n)
    enough = 8 * (max(np.bincount(a[0], minlength=1).max(), np.bincount(b[0], minlength=1).max()) + CELLS)
    while len(todo):
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        (fa, ka), (fb, kb) = ((place[of][place[of] >= 0], keys[place[of] >= 0]) for of, keys in (a, b))
        if cells > 2 * enough:  # two digests share all their cells at every size: compare the sets
            for i, d in enumerate(todo):
                out[d] = len(np.setxor1d(ka[fa == i], kb[fb == i]))
            return out
        x, y = sketch(len(todo), fa, ka, cells), sketch(len(todo), fb, kb, cells)
        row, _, done = peel(len(todo), cells, x[0] - y[0], x[1] ^ y[1], x[2] ^ y[2])
        out[todo[done]] = np.bincount(row, minlength=len(todo))[done]
        todo, cells = todo[~done], 2 * cells
    return out


def likeness(n: int, a: tuple, b: tuple) -> np.ndarray:
    both = np.bincount(a[0], minlength=n) + np.bincount(b[0], minlength=n)
    return np.where(both > 0, 1 - differing(n, a, b) / np.maximum(both, 1), 1.0)


def encode(n: int, digests: tuple) -> list[str]:
    cells = np.zeros((n, CELLS), CELL)
    for name, x in zip(CELL.names, sketch(n, *digests)):
        cells[name] = x.reshape(n, CELLS)
    return [base64.b64encode(row.tobytes()).decode() for row in cells]


def compare(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """What the result has of each text, given the next one."""
    n = len(texts)
    edited = [(t[: len(t) - len(t) // 2] + f[: len(t) // 2]).encode() for t, f in zip(texts, following)]
    own, other, after = paragraphs([t.encode() for t in texts]), paragraphs(edited), paragraphs([f.encode() for f in following])
    columns = [
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in edited], pa.string()),
        pa.array(encode(n, own), pa.string()), pa.array(encode(n, other), pa.string()), pa.array(likeness(n, own, other)), pa.array(likeness(n, own, after)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[c.split(" ")[0] for c in RESULT.split(", ")])


def _stream(batches):
    """Own documents of a range in order, then the follower; every text is compared with the one after it."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for own, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("own", "doc_id", "text"))):
            text = text or ""
            if not own:
                if ids:
                    yield compare(ids, texts, [*texts[1:], text])
                return
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
            if size >= T.SLICE_BYTES and len(ids) > 1:
                yield compare(ids[:-1], texts[:-1], texts[1:])
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])


def _block_of(at, bounds: list[int]):
    """How many of the sorted bounds are at most `at`, by binary search."""
    if not bounds:
        return F.lit(0)
    have = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get(have, low + step - 1) <= at, low + step).otherwise(low))


def fingerprints(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The fingerprint of every row of docs, of its edited text, and their likeness; see RESULT."""
    spark = docs.sparkSession
    ensure_importable(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("at", F.coalesce("doc_id", F.lit(FIRST_ID)))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(max(spark.sparkContext.defaultParallelism, min(total // block_bytes + 1, MOST_BLOCKS)))
    found = rows.agg(F.percentile_approx("at", [i / blocks for i in range(1, blocks)], 20 * blocks)).first()[0] if blocks > 1 else []
    block = _block_of(F.col("at"), sorted(set(found or [])))
    rows = rows.withColumn("block", block)
    # At most MOST_BLOCKS rows, so this window and the broadcast are bounded.
    heads = rows.groupBy("block").agg(F.min("at").alias("head"))
    previous = F.coalesce(F.lag("block").over(Window.orderBy("block")), F.first("block").over(Window.orderBy(F.col("block").desc())))
    heads = heads.select("head", previous.alias("previous"))
    places = F.array(F.struct(F.col("block"), F.lit(True).alias("own")), F.struct(F.col("previous").alias("block"), F.lit(False).alias("own")))
    placed = rows.join(F.broadcast(heads), F.col("at") == F.col("head"), "left").select(
        "doc_id", "text", "at", F.explode(F.filter(places, lambda p: p["block"].isNotNull())).alias("place")
    )
    ordered = placed.select("doc_id", "text", "at", "place.block", "place.own").repartitionById(blocks, F.col("block")).sortWithinPartitions(F.col("own").desc(), "at", "text")
    return ordered.mapInArrow(_stream, RESULT)
