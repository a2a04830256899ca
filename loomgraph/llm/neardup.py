"""Near duplicates: banded MinHash candidates, sequential Bayesian pruning, exact verification.

Documents with equal shingle sets form one class; its key is a 128-bit digest of the set, so the order of rows plays no
part. Signatures of the classes are cut into bands; classes that share a band meet.

First every shared band picks a centre, and its members are compared with that (a star). Bands whose members then lie in
one component are settled. Of the others, each sends its members once, with signatures and sets, to the task that
compares them. A band that weighs more than CHUNK_BYTES is dealt as chunks: its largest component cannot link within
itself, so chunks of it meet only the chunks of the other members, and these meet each other. Inside a task only pairs
of different components are looked at, and only in the first band that they share, so each pair is compared once in
all. A pair's signatures are compared in batches, and after each batch the pair is dropped if the posterior probability
(uniform prior) of a similarity of PERCENT / 100 or more is below MISS; survivors are verified on their full sets,
unless links found before have joined them already. What leaves the task are the links of a spanning forest, at most as
many as members came in.

A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS, 5e-6 at 0.75; hashes have 64 bits.

Defined results: documents without words have no shingles and are linked with nothing; documents of fewer than five
words have one shingle, their whole sequence; rows that share a doc_id are one document and share a verdict (linked
through any of its rows that have words); a row without doc_id takes part in linking but never represents a group,
and deduplicate() keeps it; very long texts are compared whole; an empty table gives an empty result; extra columns are
ignored, and kept by deduplicate() whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.plans.components import components
from loomgraph.session import discard, ensure_importable, materialize

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BATCH = 16
MISS = 1e-7
#: Signatures and sets that one side of a comparison holds at once.
CHUNK_BYTES = 8 << 20
PAIRS = 1 << 15
_U = np.uint64
_CLOSE = f"100 * common >= {PERCENT} * together"
_MULTIPLIERS = np.random.RandomState(20240305).randint(1, 2**63 - 1, HASHES).astype(_U) * _U(2) + _U(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted within each document, and their bounds."""
    data = T.LOWER[data]
    words = T.words(data, offsets)
    hashes = T.span_hash(T.prefix_hash(data), words.starts, words.ends)
    n_words = np.diff(words.bounds)
    at = np.flatnonzero(T.window_starts(words.bounds, SHINGLE))
    keys, docs = [T.ngrams(hashes, SHINGLE)[at]], [words.docs[at]]
    for n in range(1, SHINGLE):
        short = np.flatnonzero(n_words == n)
        keys.append(T.mix(T.ngrams(hashes, n)[words.bounds[short]] + _U(n)) if len(short) else np.zeros(0, _U))
        docs.append(short)
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    order = np.lexsort((keys, docs))
    keys, docs = keys[order], docs[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])
    return keys[new], np.searchsorted(docs[new], np.arange(len(offsets)))


def signatures(keys: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of HASHES minima for each document that has shingles."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), HASHES), np.uint32)
    scratch = np.empty_like(keys)
    for i, m in enumerate(_MULTIPLIERS):
        np.multiply(keys, m, out=scratch)
        out[:, i] = np.minimum.reduceat(scratch, starts) >> _U(32)
    return out


def _digests(keys: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which documents have shingles, and a 16-byte digest of the set of each; null for none."""
    some = np.diff(bounds) > 0
    digest = np.zeros((len(some), 2), _U)
    if some.any():
        starts = bounds[:-1][some]
        digest[some, 0] = T.mix(np.add.reduceat(keys, starts) + np.diff(bounds)[some].astype(_U))
        digest[some, 1] = np.bitwise_xor.reduceat(T.mix(keys), starts)
    return some, _binary(digest.tobytes(), 16).filter(pa.array(some)).take(pa.array(np.where(some, np.cumsum(some) - 1, 0), mask=~some))


def _binary(raw: bytes, width: int) -> pa.Array:
    """A binary array of values of one width."""
    n = len(raw) // width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()), pa.py_buffer(raw)])


def _bytes(column, kind, width: int) -> np.ndarray:
    """The values of a binary column of one width as rows of numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def _labels(column) -> np.ndarray:
    return _bytes(column, "V16", 1).reshape(-1)


def _sign(batches):
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        for a, b in T.slices(offsets):
            keys, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            some, digest = _digests(keys, bounds)
            rows = [None] * (b - a)
            if some.any():
                for d, row in zip(np.flatnonzero(some), signatures(keys, bounds)):
                    rows[d] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(bounds).astype(np.int64)), digest, pa.array(rows, pa.binary())], names=["doc_id", "n_shingles", "class", "signature"]
            )


def band_keys(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(_U)
    key = np.zeros((len(signature), BANDS), _U)
    for i in range(ROWS):
        key = key * _U(T._BASE) + rows[:, :, i]
    return T.mix(key + T.mix(np.arange(BANDS, dtype=_U) + _U(77)))


def _bands(batches):
    for batch in batches:
        n = len(batch)
        if n:
            key = band_keys(_bytes(batch.column("signature"), np.uint32, HASHES))
            at = pa.array(np.repeat(np.arange(n), BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), batch.column("class").take(at), batch.column("n_shingles").take(at)],
                names=["band", "nth", "class", "n_shingles"],
            )


def least_matches(compared: int, miss: float = MISS, percent: int = PERCENT) -> int:
    """The fewest equal values among `compared` with which a similarity of the threshold stays possible.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1); its tail above t is P(Binomial(n + 1, t) <= m).
    """
    t, below = percent / 100, 0.0
    for m in range(compared + 1):
        below += math.comb(compared + 1, m) * t**m * (1 - t) ** (compared + 1 - m)
        if below >= miss:
            return m
    return compared + 1


_LEAST = [(n, least_matches(n)) for n in range(BATCH, HASHES + 1, BATCH)]


def plausible(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (x[a], y[b]) of signatures survive all batches, and with how many equal values."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for upto, least in _LEAST:
        part = slice(upto - BATCH, upto)
        matches[alive] += (x[a[alive], part] == y[b[alive], part]).sum(1)
        alive = alive[matches[alive] >= least]
    return alive, matches[alive]


def _prune(batches):
    for batch in batches:
        n = len(batch)
        if n:
            every = np.arange(n)
            alive, _ = plausible(*(_bytes(batch.column(c), np.uint32, HASHES) for c in ("signature_a", "signature_b")), every, every)
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(alive)) for c in ("a", "b")], names=["a", "b"])


def _sets(batches):
    for batch in batches:
        data, offsets = T.utf8(batch.column("text"))
        for a, b in T.slices(offsets):
            keys, bounds = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            some, digest = _digests(keys, bounds)
            rows = [keys[s:e].tobytes() for s, e in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([digest, pa.array(rows, pa.binary())], names=["class", "shingles"]).filter(pa.array(some))


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _verify(batches):
    for batch in batches:
        left, right = batch.column("shingles_a"), batch.column("shingles_b")
        close = np.zeros(len(batch), bool)
        for i in range(len(batch)):
            x, y = (np.frombuffer(c[i].as_buffer(), _U) for c in (left, right))
            common = overlap(x, y)
            close[i] = 100 * common >= PERCENT * (len(x) + len(y) - common)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(close))


class Forest:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def roots(self) -> np.ndarray:
        while not np.array_equal(flat := self.up[self.up], self.up):
            self.up = flat
        return self.up


def compare(group: np.ndarray, part: np.ndarray, label: np.ndarray, nth: np.ndarray, signature: np.ndarray, sets: list) -> list[tuple[int, int]]:
    """Links (i, j) of a spanning forest over the rows of each group, from pairs of different labels.

    Rows are ordered by group. Rows of part -1 meet all rows of their group, others those of another part. A pair is
    compared in the first band that it shares; nth is the band of a row's group.
    """
    n = len(group)
    end = np.searchsorted(group, group, "right")
    later = end - np.arange(n) - 1
    sizes = np.array([len(x) for x in sets])
    # A label in one group says nothing about another group, so links are found in each group by itself.
    forest = Forest(0)
    _, code = np.unique(np.stack([group, label], 1), axis=0, return_inverse=True)
    forest.up = np.arange(int(code.max()) + 1) if n else forest.up
    links, first, upto = [], 0, np.cumsum(later)
    while first < n:
        done = int(upto[first - 1]) if first else 0
        last = max(int(np.searchsorted(upto, done + PAIRS, "right")), first + 1)
        rows = np.arange(first, min(last, n))
        a = np.repeat(rows, later[rows])
        b = np.arange(len(a)) - np.repeat(np.cumsum(later[rows]) - later[rows], later[rows]) + a + 1
        root = forest.roots()[code]
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        open_ = (root[a] != root[b]) & ((part[a] < 0) | (part[a] != part[b])) & (100 * small >= PERCENT * large)
        a, b = a[open_], b[open_]
        alive, matches = plausible(signature, signature, a, b)
        a, b = a[alive], b[alive]
        if len(a):
            bands = (signature[a] == signature[b]).reshape(len(a), BANDS, ROWS).all(2)
            mine = bands.argmax(1) == nth[a]
            a, b, matches = a[mine], b[mine], matches[mine]
            for i in np.argsort(-matches, kind="stable"):
                x, y = int(a[i]), int(b[i])
                p, q = forest.root(code[x]), forest.root(code[y])
                if p != q:
                    common = overlap(sets[x], sets[y])
                    if 100 * common >= PERCENT * (sizes[x] + sizes[y] - common):
                        forest.up[max(p, q)] = min(p, q)
                        links.append((x, y))
        first = int(rows[-1]) + 1
    return links


def _compare(batches):
    """Streams rows sorted by (band, x, y); groups that go on in the next batch wait for it."""
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        keys = np.stack([rows.column(c).to_numpy() for c in ("band", "x", "y")], 1)
        if not len(keys):
            continue
        new = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        cut = int(new[-1]) if len(new) else 0
        waiting = rows.slice(cut)
        if cut:
            yield from _links(rows.slice(0, cut), keys[:cut])
    if waiting is not None and len(waiting):
        yield from _links(waiting, np.stack([waiting.column(c).to_numpy() for c in ("band", "x", "y")], 1))


def _links(rows: pa.Table, keys: np.ndarray):
    group = np.concatenate([[0], np.cumsum((keys[1:] != keys[:-1]).any(1))])
    _, label = np.unique(_labels(rows.column("component")), return_inverse=True)
    sets = [np.frombuffer(x, _U) for x in rows.column("shingles").to_pylist()]
    found = compare(group, rows.column("part").to_numpy(), label, rows.column("nth").to_numpy(), _bytes(rows.column("signature"), np.uint32, HASHES), sets)
    if found:
        a, b = (pa.array([x[i] for x in found]) for i in (0, 1))
        classes = pc.cast(rows.column("class").combine_chunks(), pa.binary())
        yield pa.RecordBatch.from_arrays([classes.take(a), classes.take(b)], names=["a", "b"])


def _attach(pairs: DataFrame, side: DataFrame, value: str) -> DataFrame:
    for end in "ab":
        pairs = pairs.join(side.select(F.col("class").alias(f"of_{end}"), F.col(value).alias(f"{value}_{end}")), F.col(end) == F.col(f"of_{end}")).drop(f"of_{end}")
    return pairs


class NearDuplicates:
    """The stages over one table of documents; links() and verdicts() are what callers read."""

    def __init__(self, docs: DataFrame):
        ensure_importable(docs.sparkSession)
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        self.signed = materialize(self.texts.mapInArrow(_sign, "doc_id long, n_shingles long, class binary, signature binary"), "signatures")
        self.members = self.signed.select("doc_id", "n_shingles", "class")

    def shared_bands(self) -> DataFrame:
        """(band, nth, class, n_shingles) of the bands that several classes share."""
        heads = self.signed.where("class is not null").groupBy("class").agg(*[F.first(c).alias(c) for c in ("n_shingles", "signature")])
        heads = materialize(heads, "heads")
        bands = heads.mapInArrow(_bands, "band long, nth int, class binary, n_shingles long")
        shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("band").alias("in_band"))
        out = materialize(bands.join(shared, F.col("band") == F.col("in_band")).drop("in_band"), "bands")
        # Classes that share no band are done with.
        wanted = out.select("class").distinct().select(F.col("class").alias("of_class"))
        self.heads = materialize(heads.join(wanted, F.col("class") == F.col("of_class"), "left_semi"), "heads")
        discard(heads)
        return out

    def with_sets(self) -> DataFrame:
        """(class, signature, shingles) of the classes that share a band."""
        wanted = self.heads.select(F.col("class").alias("of_class"))
        ids = self.members.join(wanted, F.col("class") == F.col("of_class"), "left_semi").groupBy("class").agg(F.min("doc_id").alias("of_doc")).select("of_doc").distinct()
        sets = self.texts.join(ids, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left_semi").mapInArrow(_sets, "class binary, shingles binary")
        sets = sets.groupBy("class").agg(F.first("shingles").alias("shingles")).withColumnRenamed("class", "of_class")
        return materialize(self.heads.select("class", "signature").join(sets, F.col("class") == F.col("of_class")).drop("of_class"), "sets")

    def stars(self, bands: DataFrame, full: DataFrame) -> DataFrame:
        """Links between the members of each band and its centre."""
        centres = bands.groupBy("band").agg(F.min_by("class", F.xxhash64("class")).alias("a")).withColumnRenamed("band", "c_band")
        pairs = bands.join(centres, F.col("band") == F.col("c_band")).where("a <> class").select(F.least("a", "class").alias("a"), F.greatest("a", "class").alias("b")).distinct()
        likely = _attach(pairs, full, "signature").mapInArrow(_prune, "a binary, b binary")
        return materialize(_attach(likely, full, "shingles").mapInArrow(_verify, "a binary, b binary"), "stars")

    def dealt(self, bands: DataFrame, labels: DataFrame) -> DataFrame:
        """(band, x, y, part, nth, class, component): who meets whom of the bands that hold several components."""
        placed = materialize(
            bands.join(labels, F.col("class") == F.col("node"), "left").select("band", "nth", "class", "n_shingles", F.coalesce("component", "class").alias("component")), "placed"
        )
        weight = F.sum(8 * F.col("n_shingles") + 4 * HASHES + 64)
        sizes = placed.groupBy("band", "component").agg(weight.alias("bytes")).groupBy(F.col("band").alias("in_band")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("main_bytes"), F.max_by("component", F.struct("bytes", "component")).alias("main")
        )
        chunks = lambda x: F.ceil(x / F.lit(CHUNK_BYTES)).cast("int")
        plan = sizes.where("n > 1").withColumns({"one": F.col("bytes") <= CHUNK_BYTES, "others": chunks(F.col("bytes") - F.col("main_bytes")), "mains": chunks(F.col("main_bytes"))}).drop("n", "bytes", "main_bytes")
        rows = placed.join(plan, F.col("band") == F.col("in_band")).withColumn("in_main", F.col("component") == F.col("main"))
        own = F.pmod(F.xxhash64("class"), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("others"))).cast("int")
        rows = rows.withColumn("own", own)
        upto = lambda n: F.sequence(F.lit(0), n - 1)
        cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
        among = F.transform(upto(F.col("others")), lambda j: cell(F.least(F.col("own"), j), F.greatest(F.col("own"), j)))
        to_main = F.transform(upto(F.col("mains")), lambda j: cell(F.col("own"), F.col("others") + j))
        from_main = F.transform(upto(F.col("others")), lambda i: cell(i, F.col("others") + F.col("own")))
        cells = F.when(F.col("one"), F.array(cell(F.lit(0), F.lit(0)))).when(F.col("in_main"), from_main).otherwise(F.concat(among, to_main))
        part = F.when(F.col("cell.x") == F.col("cell.y"), -1).when(F.col("in_main"), F.col("others") + F.col("own")).otherwise(F.col("own"))
        return rows.withColumn("cell", F.explode(cells)).select("band", "cell.x", "cell.y", part.cast("int").alias("part"), "nth", F.col("class").alias("of_class"), "component")

    def links(self) -> DataFrame:
        """(a, b): verified links between classes that connect all classes that are linked at all."""
        bands = self.shared_bands()
        full = self.with_sets()
        stars = self.stars(bands, full)
        dealt = self.dealt(bands, components(stars))
        rows = dealt.join(full, F.col("class") == F.col("of_class")).drop("of_class")
        ordered = rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
        return stars.unionByName(materialize(ordered.mapInArrow(_compare, "a binary, b binary"), "links"))

    def verdicts(self) -> DataFrame:
        """doc_id, n_shingles, component_id, kept for every row of docs."""
        links = self.links()
        # Rows of one doc_id with different texts connect their classes.
        held = self.members.where("class is not null and doc_id is not null").select("doc_id", "class").distinct()
        split = held.groupBy(F.col("doc_id").alias("of_doc")).agg(F.min("class").alias("a"), F.max("class").alias("z")).where("a < z")
        split = held.join(split, F.col("doc_id") == F.col("of_doc")).where("a <> class").select("a", F.col("class").alias("b"))
        found = components(links.unionByName(split))
        classes = self.members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
        labelled = classes.join(found, F.col("class") == F.col("node"), "left").select(F.col("class").alias("of_class"), "least", F.coalesce("component", "class").alias("label"))
        labelled = materialize(labelled, "labelled")
        least = labelled.groupBy(F.col("label").alias("of_label")).agg(F.min("least").alias("component_id"))
        verdict = labelled.join(least, F.col("label") == F.col("of_label")).select("of_class", "component_id")
        out = self.members.join(verdict, F.col("class") == F.col("of_class"), "left").withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    return NearDuplicates(docs).verdicts()


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs without the near duplicates of a document with a smaller doc_id, with all their columns."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    left = whole.join(gone, F.col("row.doc_id").cast("long") == F.col("gone_id"), "left_anti")
    return left.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
