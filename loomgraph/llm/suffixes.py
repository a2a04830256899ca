"""Substring dedup on bytes: a logarithmic family of suffix arrays for each content shard.

Texts are routed to shards by content anchors (see winnow), so all copies of a passage that can match meet in one
shard. The shard takes its text in batches of ascending doc_id. Every new batch gets a suffix array in byte order, is
merge-scanned against each existing level for matches of LENGTH bytes or more, which by the order are matches with
smaller documents, and becomes a level itself; levels of equal size merge geometrically. A family of n suffixes thus
has at most log2(n) levels, and a suffix is merged at most log2(n) times.

Suffixes are compared on their first LENGTH bytes, byte for byte: matches have one minimum length, and longer ones are
runs of adjacent matches. The end of a match is so the end of the last run.

Defined results: null text is empty; texts of fewer than LENGTH bytes lose nothing; rows that share a doc_id are judged
against smaller ids only, never against each other; rows without doc_id come after all others; very long texts are cut
into phrases like all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomgraph.llm import winnow
from loomgraph.llm.substrings import factors

LENGTH = 50
ANCHOR = 24
#: Suffixes in a batch, at least; a batch ends with a document.
BATCH = 1 << 17
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class SuffixArray:
    """Suffixes of a text in byte order of their first `length` bytes, equal ones once."""

    def __init__(self, suffixes: np.ndarray):
        self.suffixes = suffixes

    @staticmethod
    def view(text: np.ndarray, length: int) -> np.ndarray:
        """The first `length` bytes of the suffix at each position, without a copy."""
        return np.ndarray(max(len(text) - length + 1, 0), f"S{length}", np.ascontiguousarray(text), strides=(1,))

    def __len__(self) -> int:
        return len(self.suffixes)

    def holds(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes match one of this array over the whole length."""
        if not len(self.suffixes):
            return np.zeros(len(suffixes), bool)
        at = np.searchsorted(self.suffixes, suffixes)
        return self.suffixes[np.minimum(at, len(self.suffixes) - 1)] == suffixes

    def merged(self, other: SuffixArray) -> SuffixArray:
        both = np.concatenate([self.suffixes, other.suffixes])
        both = both[np.argsort(both, kind="stable")]  # two sorted runs: a merge
        return SuffixArray(both[distinct(both)])


def distinct(ordered: np.ndarray) -> np.ndarray:
    """Where sorted values differ from the one before."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return new


class SuffixFamily:
    """Levels of suffix arrays whose sizes fall at least by half from level to level."""

    def __init__(self, length: int = LENGTH):
        self.length, self.levels = length, []

    def add(self, text: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Scan a batch, then keep it: which of the suffixes at starts match an earlier batch or a smaller document.

        The documents of a batch must not be smaller than those of earlier batches.
        """
        suffixes = SuffixArray.view(text, self.length)[starts]
        order = np.lexsort((docs, suffixes)) if len(starts) else np.zeros(0, np.int64)
        ordered, new = suffixes[order], distinct(suffixes[order])
        group = np.cumsum(new) - 1
        batch = SuffixArray(ordered[new])
        seen = np.zeros(len(batch), bool)
        for level in self.levels:
            seen |= level.holds(batch.suffixes)
        found = np.zeros(len(starts), bool)
        found[order] = seen[group] | (docs[order[new]][group] < docs[order])
        self._keep(SuffixArray(batch.suffixes[~seen]))
        return found

    def _keep(self, level: SuffixArray) -> None:
        while self.levels and len(self.levels[-1]) < 2 * len(level):
            level = self.levels.pop().merged(level)
        if len(level):
            self.levels.append(level)


def repeats(reference: winnow.Reference) -> np.ndarray:
    """Feeds the phrases of a shard to a family, batch by batch in the order of their documents."""
    order = np.argsort(reference.doc, kind="stable")
    upto = np.cumsum(reference.count[order])
    doc = reference.doc[order]
    flags, place = np.zeros(int(upto[-1]), bool), np.cumsum(reference.count) - reference.count
    family, first = SuffixFamily(LENGTH), 0
    while first < len(order):
        done = int(upto[first - 1]) if first else 0
        end = min(int(np.searchsorted(upto, done + BATCH)) + 1, len(order))
        end = int(np.searchsorted(doc, doc[end - 1], "right"))
        own = order[first:end]
        count = reference.count[own]
        starts = winnow.ranges(reference.first[own], count)
        flags[winnow.ranges(place[own], count)] = family.add(reference.symbols, starts, np.repeat(doc[first:end], count))
        first = end
    return flags


def occurrences(docs: DataFrame) -> winnow.FirstOccurrences:
    return winnow.FirstOccurrences(docs, LENGTH, ANCHOR, winnow.ByteUnits, repeats, settle=True)


def _finish(ids, data, offsets, phrases, windows) -> pa.Table:
    spans = factors(windows, LENGTH, offsets)
    text = data.tobytes()
    doc = np.searchsorted(offsets, spans[:, 0], "right") - 1
    bounds = np.searchsorted(doc, np.arange(len(ids) + 1))
    removed, digests = np.zeros(len(ids), np.int64), []
    np.add.at(removed, doc, spans[:, 1] - spans[:, 0])
    pairs = spans.tolist()
    for d in range(len(ids)):
        at, parts = offsets[d], []
        for s, e in pairs[bounds[d] : bounds[d + 1]]:
            parts.append(text[at:s])
            at = e
        parts.append(text[at : offsets[d + 1]])
        digests.append(hashlib.sha256(b"".join(parts)).hexdigest())
    return pa.table(
        {"doc_id": ids, "n_bytes": pa.array(np.diff(offsets), pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(np.diff(bounds), pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    )


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """One row for each row of docs; see RESULT."""
    return occurrences(docs).run(_finish, RESULT)


def _spans(ids, data, offsets, phrases, windows) -> pa.Table:
    found = factors(windows, LENGTH, offsets)
    doc = np.searchsorted(offsets, found[:, 0], "right") - 1
    return pa.table({"doc_id": ids.take(pa.array(doc)), "first_byte": pa.array(found[:, 0] - offsets[doc], pa.int64()), "n_bytes": pa.array(found[:, 1] - found[:, 0], pa.int64())})


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first_byte, n_bytes) of every maximal run of bytes that repeats a smaller document."""
    return occurrences(docs).run(_spans, "doc_id long, first_byte long, n_bytes long")
