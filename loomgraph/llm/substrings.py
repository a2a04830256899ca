"""Substring dedup on words: relative Lempel-Ziv parsing against indexed reference blocks.

The reference text is spread over reference blocks by content anchors (see winnow): the block of an anchor indexes
every phrase that has it and that another document may share, and a document meets just the blocks of its own anchors.
There every phrase is factored greedily, whole copies like all others: at a position, the window of LENGTH words is
looked up in the index, which knows the smallest document that has it; if a
smaller document has it, the factor is extended word by word along that reference as far as both agree, and covers all
windows up to its end. The parse goes on at the factor's boundary, with the first window that reaches beyond it, so
windows across two factors are looked up too. Factors that meet or overlap join to duplicate spans in the document;
these have LENGTH words or more, and their words are removed.

Defined results: null and empty texts have no words; documents of fewer than LENGTH words lose nothing; rows that
share a doc_id are judged against smaller ids only, never against each other; rows without doc_id come after all
others; very long texts are parsed whole; an empty table gives an empty result; extra columns are ignored, and kept
by remove_duplicates() whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.llm import winnow

LENGTH = 13
ANCHOR = 7
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def parse(reference: winnow.Reference, length: int = LENGTH) -> np.ndarray:
    """Factors all phrases of a reference block against it, in step; which windows lie in a factor."""
    first, count, doc, symbols = reference.first, reference.count, reference.doc, reference.symbols
    starts = winnow.ranges(first, count)
    of = np.repeat(np.arange(len(first)), count)
    hashes = winnow.hash_of(winnow.WordUnits.prefix(symbols), starts, length)
    order = np.lexsort((doc[of], hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order[1:]] != hashes[order[:-1]]
    # The index: of each window, the place in the smallest document.
    index = order[new]
    entry = np.empty(len(order), np.int64)
    entry[order] = index[np.cumsum(new) - 1]
    end = first + count + length - 1
    base = np.cumsum(count) - count
    flags, at, active = np.zeros(len(starts), bool), np.zeros(len(first), np.int64), np.arange(len(first))
    while len(active):
        window = base[active] + at[active]
        source = entry[window]
        hit = doc[of[source]] < doc[active]
        reach = np.full(len(active), length)
        growing = np.flatnonzero(hit)
        here, there = starts[window], starts[source]
        while len(growing):
            inside = (here[growing] + reach[growing] < end[active[growing]]) & (there[growing] + reach[growing] < end[of[source[growing]]])
            growing = growing[inside]
            growing = growing[symbols[here[growing] + reach[growing]] == symbols[there[growing] + reach[growing]]]
            reach[growing] += 1
        covered = np.where(hit, reach - length + 1, 0)
        flags[winnow.ranges(window, covered)] = True
        at[active] += np.maximum(covered, 1)
        active = active[at[active] < count[active]]
    return flags


def occurrences(docs: DataFrame) -> winnow.FirstOccurrences:
    return winnow.FirstOccurrences(docs, LENGTH, ANCHOR, winnow.WordUnits, parse)


def factors(starts: np.ndarray, length: int, bounds: np.ndarray) -> np.ndarray:
    """(first, end) of the factors made by sorted window starts; a factor ends with its document."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    doc = np.searchsorted(bounds, starts, "right")
    new = np.ones(len(starts), bool)
    new[1:] = (starts[1:] > starts[:-1] + length) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return np.stack([starts[first], starts[last] + length], 1)


def _finish(ids, data, offsets, phrases, windows) -> pa.Table:
    words = phrases.words
    removed = T.covered(windows, LENGTH, len(words.starts)) if len(windows) else np.zeros(len(words.starts), bool)
    text = data.tobytes()
    digests = []
    touched = T.per_doc(removed, words.bounds)
    for d in range(len(ids)):
        a, b = words.bounds[d], words.bounds[d + 1]
        kept = text[offsets[d] : offsets[d + 1]].split()  # bytes split at the separators of words
        if touched[d]:
            gone = removed[a:b].tolist()
            kept = [w for w, g in zip(kept, gone) if not g]
        digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
    return pa.table(
        {"doc_id": ids, "n_words": pa.array(np.diff(words.bounds), pa.int64()), "n_removed": pa.array(touched, pa.int64()), "kept_sha256": pa.array(digests, pa.string())}
    )


def repeated_words(docs: DataFrame) -> DataFrame:
    """One row for each row of docs; see RESULT."""
    return occurrences(docs).run(_finish, RESULT)


def _spans(ids, data, offsets, phrases, windows) -> pa.Table:
    words = phrases.words
    found = factors(windows, LENGTH, words.bounds)
    doc = np.searchsorted(words.bounds, found[:, 0], "right") - 1
    return pa.table(
        {"doc_id": ids.take(pa.array(doc)), "first_word": pa.array(found[:, 0] - words.bounds[doc], pa.int64()), "n_words": pa.array(found[:, 1] - found[:, 0], pa.int64())}
    )


def duplicate_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, first_word, n_words) of every factor that is a duplicate span."""
    return occurrences(docs).run(_spans, "doc_id long, first_word long, n_words long")


def _cut(ids, data, offsets, phrases, windows) -> pa.Table:
    """The texts that lose words, without those words and the white space after them; None where no word is left."""
    words = phrases.words
    removed = T.covered(windows, LENGTH, len(words.starts)) if len(windows) else np.zeros(len(words.starts), bool)
    touched = np.flatnonzero(T.per_doc(removed, words.bounds))
    rows = []
    for d in touched:
        a, b = words.bounds[d], words.bounds[d + 1]
        stops = [*words.starts[a + 1 : b].tolist(), int(offsets[d + 1])]
        kept = [data[s:e].tobytes() for s, e, g in zip(words.starts[a:b], stops, removed[a:b]) if not g]
        rows.append(b"".join([data[offsets[d] : words.starts[a]].tobytes(), *kept]).decode() if kept else None)
    return pa.table({"cut_id": ids.take(pa.array(touched)), "cut_text": pa.array(rows, pa.string())})


def remove_duplicates(docs: DataFrame) -> DataFrame:
    """docs with the duplicate spans cut out of text and n_chars counted anew, with all their columns.

    Documents of which no word is left go; untouched documents stay as they are. Rows that share a doc_id must share
    their text, as after near-duplicate removal; rows without doc_id stay as they are.
    """
    cut = occurrences(docs).run(_cut, "cut_id long, cut_text string").where("cut_id is not null").dropDuplicates(["cut_id"])
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    joined = whole.join(cut, F.col("row.doc_id").cast("long") == F.col("cut_id"), "left").where(F.col("cut_id").isNull() | F.col("cut_text").isNotNull())
    new = {"text": F.when(F.col("cut_id").isNull(), F.col("row.text")).otherwise(F.col("cut_text")).alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("cut_id").isNull(), F.col("row.n_chars")).otherwise(F.length("cut_text").cast(kind)).alias("n_chars")
    return joined.select(*[new.get(c, F.col(f"row.`{c}`").alias(c)) for c in docs.columns])
