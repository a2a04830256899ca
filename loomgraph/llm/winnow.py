"""Windows of a fixed length that also start in a document with a smaller id, found through content anchors.

A window's anchor is the smallest of its k-gram hashes, the first one among equals. Consecutive windows with one anchor
form a phrase; where its windows start and end follows from the content, so equal passages consist of equal phrases
apart from those at their ends, and two equal windows always have the same anchor.

Round one: each block of documents sends every distinct anchor once to the shard that its hash falls to, and learns
which anchors stand in other documents. A window whose anchor stands nowhere else cannot repeat. Round two: the block
sends the content of its phrases with shared anchors, each distinct phrase once with the smallest document that has it.
A shard so holds all the text that can match. The operator's index (resolve) decides about every window of it: of the
copies of a phrase within a block, that of the smallest document is asked about and one that stands for the others.
Where an operator says so (settle), a phrase that a smaller document has whole is a repeat by its hash, and the index
sees only phrases that differ around one anchor. The answer is one bit for each window, in the order of asking.

Messages are bounded by the entries they carry, however many blocks there are, and a passage in a third of all
documents weighs as much as the number of blocks, not as the number of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.session import ensure_importable

_U = np.uint64
_PLACE = _U((1 << 32) - 1)
_SIGN = _U(1 << 63)
BLOCK_BYTES = 8 << 20
#: doc_id of rows that have none: they come after all others.
LAST_ID = (1 << 63) - 1
MESSAGE = "shard long, block long, payload binary"
ANSWER = "block long, shard long, payload binary"


class Phrases:
    """The phrases of one slice of documents. prefix: running hash of the symbols; bounds: of the documents."""

    def __init__(self, prefix: np.ndarray, bounds: np.ndarray, length: int, k: int):
        self.prefix, self.bounds, self.length = prefix, bounds, length
        total = len(prefix) - 1
        windows = T.window_starts(bounds, length)
        if not windows.any():
            self.first = self.count = self.offset = self.doc = np.zeros(0, np.int64)
            self.anchor = self.key = np.zeros(0, _U)
            return
        grams = hash_of(prefix, np.arange(total - k + 1), k)
        # Grams that leave a document belong to no window inside one. The high half decides, then the place.
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=_U)
        span, have = length - k + 1, 1
        while 2 * have <= span:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < span:
            low = np.minimum(low[: len(low) - (span - have)], low[span - have :])
        at = (low & _PLACE).astype(np.int64)
        new = windows.copy()
        new[1:] &= (at[1:] != at[:-1]) | ~windows[:-1]
        self.first = np.flatnonzero(new)
        stop = np.append(self.first[1:], len(new))
        upto = np.zeros(len(new) + 1, np.int64)
        np.cumsum(windows, out=upto[1:])
        self.count = upto[stop] - upto[self.first]
        self.offset = at[self.first] - self.first
        self.anchor = T.mix(grams[at[self.first]])  # smallest hashes: mixed anew, so that shards are even
        self.key = phrase_key(prefix, self.first, self.count + length - 1, self.offset)
        self.doc = np.searchsorted(bounds, self.first, "right") - 1


def hash_of(prefix: np.ndarray, starts: np.ndarray, n) -> np.ndarray:
    _, down = T.powers(len(prefix))
    return T.mix((prefix[starts + n] - prefix[starts]) * down[starts] + np.asarray(n).astype(_U))


def phrase_key(prefix: np.ndarray, starts: np.ndarray, n: np.ndarray, offset: np.ndarray) -> np.ndarray:
    return T.mix(hash_of(prefix, starts, n) + offset.astype(_U))


class ByteUnits:
    """Every byte is a symbol."""

    @staticmethod
    def symbols(content: np.ndarray) -> np.ndarray:
        return content

    @staticmethod
    def prefix(symbols: np.ndarray) -> np.ndarray:
        return T.prefix_hash(symbols)

    @staticmethod
    def phrases(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Phrases:
        return Phrases(T.prefix_hash(data), offsets, length, k)

    @staticmethod
    def content(data: np.ndarray, phrases: Phrases, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the chosen phrases one after the other, and how many each has."""
        starts, n = phrases.first[chosen], phrases.count[chosen] + phrases.length - 1
        return data[ranges(starts, n)], n


class WordUnits:
    """Every word is a symbol, known by its hash; contents are words with one space after each."""

    @staticmethod
    def symbols(content: np.ndarray) -> np.ndarray:
        words = T.words(content, np.array([0, len(content)]))
        return T.span_hash(T.prefix_hash(content), words.starts, words.ends)

    @staticmethod
    def prefix(symbols: np.ndarray) -> np.ndarray:
        out = np.zeros(len(symbols) + 1, _U)
        np.cumsum(symbols * T.powers(len(symbols))[0][: len(symbols)], out=out[1:])
        return out

    @staticmethod
    def phrases(data: np.ndarray, offsets: np.ndarray, length: int, k: int) -> Phrases:
        words = T.words(data, offsets)
        out = Phrases(WordUnits.prefix(T.span_hash(T.prefix_hash(data), words.starts, words.ends)), words.bounds, length, k)
        out.words = words
        return out

    @staticmethod
    def content(data: np.ndarray, phrases: Phrases, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = phrases.count[chosen] + phrases.length - 1
        word = ranges(phrases.first[chosen], m)
        starts, n = phrases.words.starts[word], phrases.words.ends[word] - phrases.words.starts[word] + 1
        out = data[np.minimum(ranges(starts, n), len(data) - 1)]
        out[np.cumsum(n) - 1] = 32
        total = np.concatenate([[0], np.cumsum(n)])
        ends = np.cumsum(m)
        return out, total[ends] - total[ends - m]


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., starts[0] + n[0] - 1, starts[1], ..."""
    return np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def least_by(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the least of each value array among the rows of a key."""
    if not len(keys):
        return (keys, *values)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return (keys[starts], *[np.minimum.reduceat(v[order], starts) for v in values])


def planes(values: np.ndarray) -> bytes:
    """The bytes of all values plane by plane: high bytes of sorted keys and of small numbers compress in the shuffle."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(raw, n: int, at: int = 0, kind=_U) -> np.ndarray:
    kind = np.dtype(kind)
    part = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
    return np.ascontiguousarray(part.T).view(kind).reshape(-1)


def shard_of(anchors: np.ndarray, shards: int) -> np.ndarray:
    return (((anchors >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


def cuts(shard: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(shard, first, end) of the runs of sorted shard numbers."""
    at = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])) if len(shard) else []
    for a, b in zip(at, [*at[1:], len(shard)]):
        yield int(shard[a]), int(a), int(b)


def table(rows: list, names: tuple[str, ...]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    kinds = [pa.binary() if n == "payload" else pa.int64() for n in names]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=list(names))


def blocks_of(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks follow the bytes of the texts, with at least one for each core."""
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return int(max(docs.sparkSession.sparkContext.defaultParallelism, total // block_bytes + 1))


@dataclass
class Reference:
    """Phrases of one shard with their documents: all that were asked about, or with settle distinct ones whose anchor has several."""

    symbols: np.ndarray  # of all phrases, one after the other
    first: np.ndarray  # where each phrase starts; phrases of one content in one block start at one place
    count: np.ndarray  # windows of each phrase
    doc: np.ndarray


class Block:
    """The slices of one block of documents, ordered by id, with what the rounds ask about them."""

    def __init__(self, docs: pa.Table, units, length: int, k: int):
        rank = docs.column("rank").to_numpy()
        order = np.argsort(rank, kind="stable")
        docs, rank = docs.take(pa.array(order)), rank[order].astype(np.int64).view(_U) ^ _SIGN
        self.ids = docs.column("doc_id")
        data, offsets = T.utf8(docs.column("text"))
        self.slices, doc = [], []
        for a, b in T.slices(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            p = units.phrases(part, own, length, k)
            self.slices.append((a, b, part, own, p))
            doc.append(rank[a:b][p.doc])
        join = lambda c, kind: np.concatenate([getattr(s[4], c) for s in self.slices]) if self.slices else np.zeros(0, kind)
        self.doc = np.concatenate(doc) if doc else np.zeros(0, _U)
        self.anchor, self.key, self.count, self.offset = join("anchor", _U), join("key", _U), join("count", np.int64), join("offset", np.int64)

    def shared(self, answers: pa.Table, shards: int) -> np.ndarray:
        """Which phrases have an anchor that another document has too."""
        distinct, low, high = least_by(self.anchor, self.doc, ~self.doc)
        flags, shard = low != ~high, shard_of(distinct, shards)
        for s, payload in zip(answers.column("shard").to_pylist(), answers.column("payload")):
            if s < shards:
                a, b = np.searchsorted(shard, [s, s + 1])
                flags[a:b] |= np.unpackbits(np.frombuffer(payload.as_buffer(), np.uint8), count=b - a).astype(bool)
        return flags[np.searchsorted(distinct, self.anchor)] if len(distinct) else np.zeros(0, bool)

    def asked(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One phrase for each distinct content among the shared ones, that of the smallest document, by anchor.

        Also the greatest document of the block that has the content: if it is another one, it stands for all the others.
        """
        at = np.flatnonzero(shared)
        order = at[np.lexsort((self.doc[at], self.key[at], self.anchor[at]))]
        new = np.ones(len(order), bool)
        new[1:] = self.key[order[1:]] != self.key[order[:-1]]
        return order[new], self.doc[order[np.append(new[1:], True)]] if len(order) else self.doc[order]


class FirstOccurrences:
    """docs: doc_id, text. units: ByteUnits or WordUnits.

    resolve(reference): for each window of its phrases in order, whether a smaller document in it has that window.
    settle: phrases that a smaller document has whole are repeats by their hash, and resolve() sees the rest.
    """

    def __init__(self, docs: DataFrame, length: int, k: int, units, resolve: Callable[[Reference], np.ndarray], settle: bool = False, block_bytes: int = BLOCK_BYTES):
        ensure_importable(docs.sparkSession)
        self.length, self.k, self.units, self.resolve, self.settle = length, k, units, resolve, settle
        self.shards = blocks_of(docs, block_bytes)
        doc_id = F.col("doc_id").cast("long")
        self.placed = docs.select(
            doc_id.alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(doc_id, F.lit(LAST_ID)).alias("rank"),
            F.pmod(F.xxhash64(doc_id), F.lit(self.shards)).alias("block"),
        )

    def __getstate__(self) -> dict:
        """What workers need: everything but the table."""
        return {k: v for k, v in self.__dict__.items() if k != "placed"}

    def _block(self, docs: pa.Table) -> Block:
        return Block(docs, self.units, self.length, self.k)

    def _ask_anchors(self, key, docs):
        anchors = np.unique(self._block(docs).anchor)
        rows = [(s, key[0].as_py(), planes(anchors[a:b])) for s, a, b in cuts(shard_of(anchors, self.shards))]
        return table(rows, ("shard", "block", "payload"))

    def _answer_anchors(self, key, asked):
        parts = [unplanes(x.as_buffer(), len(x.as_buffer()) // 8) for x in asked.column("payload")]
        distinct, n = np.unique(np.concatenate(parts), return_counts=True)
        rows = []
        for block, part in zip(asked.column("block").to_pylist(), parts):
            rows.append((block, key[0].as_py(), np.packbits(n[np.searchsorted(distinct, part)] > 1).tobytes()))
        return table(rows, ("block", "shard", "payload"))

    def _ask_phrases(self, key, docs, answers):
        block = self._block(docs)
        chosen, last = block.asked(block.shared(answers, self.shards))
        starts = np.cumsum([0, *[len(s[4].key) for s in block.slices]])
        contents, sizes = [None] * len(chosen), np.zeros(len(chosen), np.int64)
        for i, (_, _, data, _, phrases) in enumerate(block.slices):
            own = np.flatnonzero((chosen >= starts[i]) & (chosen < starts[i + 1]))
            if len(own):
                raw, n = self.units.content(data, phrases, chosen[own] - starts[i])
                raw, ends, sizes[own] = raw.tobytes(), np.cumsum(n), n
                for j, e, m in zip(own.tolist(), ends.tolist(), n.tolist()):
                    contents[j] = raw[e - m : e]
        rows = []
        for s, a, b in cuts(shard_of(block.anchor[chosen], self.shards)):
            at = chosen[a:b]
            head = np.array([b - a], np.int64).tobytes() + planes(block.doc[at]) + planes(block.count[at].astype("<u2")) + planes(block.offset[at].astype("<u2"))
            if not self.settle:
                head += planes(last[a:b])
            rows.append((s, key[0].as_py(), head + b"".join(contents[a:b])))
        return table(rows, ("shard", "block", "payload"))

    def _answer_phrases(self, key, asked):
        """One bit for each window of each phrase: does a smaller document have it?"""
        blocks, symbols, known = [], [], []
        head = 12 if self.settle else 20
        for block, payload in sorted(zip(asked.column("block").to_pylist(), asked.column("payload")), key=lambda r: r[0]):
            raw = payload.as_buffer()
            n = int(np.frombuffer(raw, np.int64, 1)[0])
            doc, count, offset = unplanes(raw, n, 8), *(unplanes(raw, n, 8 + at * n, "<u2").astype(np.int64) for at in (8, 10))
            own = self.units.symbols(np.frombuffer(raw, np.uint8, len(raw) - 8 - head * n, 8 + head * n))
            symbols.append(own)
            size = count + self.length - 1
            first = np.cumsum(size) - size
            if not self.settle:
                others = unplanes(raw, n, 8 + 12 * n)
                again = np.flatnonzero(others != doc)
                first, count, offset, doc = (np.concatenate(x) for x in ((first, first[again]), (count, count[again]), (offset, offset[again]), (doc, others[again])))
            blocks.append((block, len(doc)))
            known.append((doc, count, offset, first))
        flags = (self._settled if self.settle else self._resolved)(symbols, known)
        ends = np.cumsum(np.concatenate([x[1] for x in known]))
        rows, at = [], 0
        for (block, n), last in zip(blocks, np.cumsum([n for _, n in blocks])):
            end = int(ends[last - 1])
            if flags[at:end].any():
                rows.append((block, self.shards + key[0].as_py(), np.packbits(flags[at:end]).tobytes()))
            at = end
        return table(rows, ("block", "shard", "payload"))

    def _resolved(self, symbols: list, known: list) -> np.ndarray:
        """All phrases go to the index."""
        base = np.cumsum([0, *[len(x) for x in symbols]])
        first = np.concatenate([x[3] + b for x, b in zip(known, base)])
        return self.resolve(Reference(np.concatenate(symbols), first, np.concatenate([x[1] for x in known]), np.concatenate([x[0] for x in known])))

    def _settled(self, symbols: list, known: list) -> np.ndarray:
        """Whole phrases by their hash, the index for the rest."""
        keys, anchors = [], []
        for own, (_, count, offset, first) in zip(symbols, known):
            prefix = self.units.prefix(own)
            keys.append(phrase_key(prefix, first, count + self.length - 1, offset))
            anchors.append(hash_of(prefix, first + offset, self.k))
        keys, anchors = np.concatenate(keys), np.concatenate(anchors)
        doc, count = (np.concatenate([x[i] for x in known]) for i in (0, 1))
        distinct, owner = least_by(keys, doc)
        flags = np.repeat(owner[np.searchsorted(distinct, keys)] < doc, count)
        # Of each content, the copy of the smallest document stands in the index; anchors with one content settle nothing.
        order = np.lexsort((doc, keys))
        new = np.ones(len(order), bool)
        new[1:] = keys[order[1:]] != keys[order[:-1]]
        holders = np.sort(order[new])
        several, of = np.unique(anchors[holders], return_inverse=True)
        open_ = holders[np.bincount(of, minlength=len(several))[of] > 1]
        if len(open_):
            ends, size = np.cumsum(count), count + self.length - 1
            parts, base, at = [], 0, np.cumsum(size) - size
            for own, last in zip(symbols, np.cumsum([len(x[0]) for x in known])):
                chosen = open_[(open_ >= base) & (open_ < last)]
                parts.append(own[ranges(at[chosen] - at[base], size[chosen])])
                base = last
            first = np.cumsum(size[open_]) - size[open_]
            reference = Reference(np.concatenate(parts), first, count[open_], doc[open_])
            flags[ranges(ends[open_] - count[open_], count[open_])] = self.resolve(reference)
        return flags

    def run(self, finish: Callable, schema: str) -> DataFrame:
        """finish(ids, data, offsets, phrases, windows): an Arrow table; windows: sorted starts of repeated windows."""

        def close(key, docs, answers):
            block = self._block(docs)
            chosen, last = block.asked(block.shared(answers, self.shards))
            count = block.count[chosen]
            again = count * (last != block.doc[chosen]) if not self.settle else np.zeros(len(count), np.int64)
            starts, shard = np.cumsum(count) - count, shard_of(block.anchor[chosen], self.shards)
            more = np.cumsum(again) - again
            flags, others = np.zeros(int(count.sum()), bool), np.zeros(int(again.sum()), bool)
            for s, payload in zip(answers.column("shard").to_pylist(), answers.column("payload")):
                if s >= self.shards:
                    a, b = np.searchsorted(shard, [s - self.shards, s - self.shards + 1])
                    n, m = int(count[a:b].sum()), int(again[a:b].sum())
                    bits = np.unpackbits(np.frombuffer(payload.as_buffer(), np.uint8), count=n + m).astype(bool)
                    flags[starts[a] : starts[a] + n], others[more[a] : more[a] + m] = bits[:n], bits[n:]
            # Phrases of one content: that of the smallest document takes the first answer, those of others the second.
            by_key = np.argsort(block.key[chosen])
            place = np.searchsorted(block.key[chosen], block.key, sorter=by_key) if len(chosen) else np.zeros(len(block.key), np.int64)
            place = by_key[np.minimum(place, len(chosen) - 1)] if len(chosen) else place
            known = block.key[chosen][place] == block.key if len(chosen) else np.zeros(len(block.key), bool)
            out, base = [], 0
            for a, b, data, offsets, p in block.slices:
                own = np.flatnonzero(known[base : base + len(p.key)])
                at = place[base + own]
                n = p.count[own]
                later = np.repeat(block.doc[chosen][at] < block.doc[base + own], n)
                gone = flags[ranges(starts[at], n)] if len(own) else np.zeros(0, bool)
                if self.settle:
                    gone |= later
                elif later.any():
                    gone[later] = others[ranges(more[at], n)[later]]
                windows = ranges(p.first[own], n)[gone]
                out.append(finish(block.ids.slice(a, b - a), data, offsets, p, windows))
                base += len(p.key)
            return pa.concat_tables(out)

        asked = self.placed.groupBy("block").applyInArrow(lambda key, docs: self._ask_anchors(key, docs), MESSAGE)
        answered = asked.groupBy("shard").applyInArrow(lambda key, rows: self._answer_anchors(key, rows), ANSWER)
        named = self.placed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(lambda key, docs, rows: self._ask_phrases(key, docs, rows), MESSAGE)
        answered = answered.unionByName(named.groupBy("shard").applyInArrow(lambda key, rows: self._answer_phrases(key, rows), ANSWER))
        return self.placed.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(close, schema)
