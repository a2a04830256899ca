"""Maximal runs (periodic stretches of words) of every text, after Kolpakov and Kucherov.

The words of a text are numbered. A suffix automaton that keeps the first end of each state gives the factorisation: each
factor is the longest stretch that also starts earlier (overlaps count), or one new word. Main's algorithm finds the runs
that touch or cross the start of a factor, by longest common extensions (Z functions) of the factor and of at most twice
the factor before plus the factor's length; a run that starts further left would make the factor before longer. Every
other run lies strictly inside a factor and is copied from where the factor's words stood earlier. Everything is linear in
the length of the text.

A run of at least 2 g words repeats g words at its period, whatever the period. So stretches of a text that no repeated
g-gram covers hold no run and are left out before, by hashes in numpy over a whole batch: a collision can only add
stretches. Runs end where a stretch ends, since a run is covered from end to end.

Rows of any length stay in their own task and no row meets another: nothing is shuffled, and a lost executor costs its own
batches only. Memory grows with the longest covered stretch of one text, some hundred bytes a word.

Defined results: null is the empty text, without words or runs; a null doc_id has no number, so such a text is never
rewritten by plant; ties for the longest run go to the smaller start, then the smaller period; repeated rows are treated
alike, each by itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm import text as T
from loomgraph.session import ensure_importable

LEAST_WORDS = 12


def factorise(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, source) of each factor: w[start:end] also stands at source < start; source -1 for a new word."""
    following: list[dict[int, int]] = [{}]
    link, length, first = [-1], [0], [-1]
    last = 0
    for i, c in enumerate(w):
        current = len(following)
        following.append({})
        length.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = current
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[q] == length[p] + 1:
                link[current] = q
            else:
                clone = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                first.append(first[q])
                link.append(link[q])
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = clone
                    p = link[p]
                link[q] = link[current] = clone
        last = current
    out, i, n = [], 0, len(w)
    while i < n:
        state, j = 0, i
        while j < n:
            to = following[state][w[j]]
            if first[to] >= j:  # w[i:j + 1] ends here for the first time
                break
            state, j = to, j + 1
        out.append((i, j, first[state] - (j - i) + 1) if j > i else (i, i + 1, -1))
        i = max(j, i + 1)
    return out


def z_function(s: list[int]) -> list[int]:
    """How long s and its suffix from each position agree."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        if i + k >= right:
            while i + k < n and s[k] == s[i + k]:
                k += 1
            left, right = i, i + k
        z[i] = k
    return z


def _touching(w: list[int], before: int, s: int, e: int, least: int) -> dict[tuple[int, int], int]:
    """{(start, last): period} of the runs that touch or cross s, the start of the factor w[s:e], and end before e."""
    size, n = e - s, len(w)
    low = max(0, s - 2 * before - size)
    t = s - low
    v, tail = w[s:e], w[low:s]
    back = tail[::-1]
    z1 = np.array(z_function([*v, -1, *tail, *v]), np.int64)
    z2 = np.array(z_function([*back, -1, *v[::-1], *back]), np.int64)
    # At least a period of the run stands right of s: the factor agrees with itself a period later.
    p = np.arange(1, size + 1)
    right, left = np.append(z1[1:size], 0)[:size], z2[t + 1 + size - p]
    starts, ends = [s - left], [s + p + right - 1]
    periods = [p]
    # At least a period stands left of s.
    p = np.arange(1, t + 1)
    right, left = np.minimum(z1[size + 1 + t - p], size), np.append(z2[1:t], 0)[:t]
    starts.append(s - p - left)
    ends.append(s + right - 1)
    periods.append(p)
    b, f, p = np.concatenate(starts), np.concatenate(ends), np.concatenate(periods)
    length = f - b + 1
    keep = (length >= 2 * p) & (length >= least)
    found: dict[tuple[int, int], int] = {}
    for b, f, p in zip(b[keep].tolist(), f[keep].tolist(), p[keep].tolist(), strict=True):
        # What the window cut off is found at another factor.
        if (f + 1 < n and w[f + 1] == w[f + 1 - p]) or (b and w[b - 1] == w[b - 1 + p]):
            continue
        if found.get((b, f), p) >= p:
            found[b, f] = p
    return found


def maximal_runs(w: list[int], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of at least max(least, 2 * period) elements, by start, then period."""
    n = len(w)
    runs: dict[tuple[int, int], int] = {}
    at: dict[int, list[tuple[int, int]]] = {}

    def add(b: int, f: int, p: int) -> None:
        if (b, f) not in runs:
            runs[b, f] = p
            at.setdefault(b, []).append((f, p))

    before = 0
    for s, e, source in [*factorise(w), (n, n, -1)]:
        # A run here has fewer than 2 * (before + size) elements, so short factors have none.
        if 2 * (before + e - s) > least:
            for (b, f), p in _touching(w, before, s, e, least).items():
                add(b, f, p)
        if source >= 0 and e - s > least + 1:
            moved, end = s - source, source + e - s - 1
            for b in range(source + 1, end - least + 1):
                for f, p in at.get(b, ()):
                    if f < end:
                        add(b + moved, f + moved, p)
        before = e - s
    return sorted((b, f - b + 1, p) for (b, f), p in runs.items())


def runs_of_words(words: list[bytes], least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """maximal_runs() of the stretches that repeated grams cover."""
    n, gram = len(words), max(1, least // 2)
    if n < least:
        return []
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(x, len(seen)) for x in words], np.int64)
    grams = T.ngrams(T.mix(ids.astype(np.uint64)), gram)
    order = np.sort(grams)
    repeated = np.flatnonzero(np.isin(grams, order[1:][order[1:] == order[:-1]]))
    edge = np.diff(np.concatenate([[False], T.covered(repeated, gram, n), [False]]).astype(np.int8))
    out = []
    for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if b - a >= least:
            out += [(start + a, length, period) for start, length, period in maximal_runs(ids[a:b].tolist(), least)]
    return out


def plant(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """One text in ten, by a hash of its doc_id, gets a tail that repeats with a period that the hash gives."""
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def _may_repeat(column, gram: int) -> np.ndarray:
    """Which texts hold some gram of words twice, or might."""
    data, offsets = T.utf8(column)
    out = np.zeros(len(column), bool)
    for a, b in T.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        spans = T.words(part, offsets[a : b + 1] - offsets[a])
        grams = T.ngrams(T.span_hash(T.prefix_hash(part), spans.starts, spans.ends), gram)
        inside = T.window_starts(spans.bounds, gram)
        docs = spans.docs[: len(grams)][inside]
        keyed = grams[inside] ^ T.mix(docs.astype(np.uint64) + np.uint64(1))
        order = np.argsort(keyed, kind="stable")
        keyed, docs = keyed[order], docs[order]
        same = (keyed[1:] == keyed[:-1]) & (docs[1:] == docs[:-1])
        out[a + docs[1:][same]] = True
    return out


SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
RUN = "doc_id long, start long, length long, period long"
COLLAPSED = "doc_id long, text string"


def _map(docs: DataFrame, least: int, planted: bool, schema: str, rows_of) -> DataFrame:
    """rows_of(doc_id, words, runs) for every row of docs."""
    ensure_importable(docs.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def find(batches):
        kinds = None
        for batch in batches:
            ids, column = batch.column("doc_id").to_pylist(), batch.column("text")
            repeats = _may_repeat(column, max(1, least // 2))
            rows: list[tuple] = []
            for i, doc_id in enumerate(ids):
                words = (column[i].as_py() or "").encode("utf-8", "surrogatepass").split()  # bytes split at exactly these six
                runs: list = []
                if planted and (other := plant(words, doc_id)) is not words:
                    words, repeats[i] = other, True
                if repeats[i]:
                    runs = runs_of_words(words, least)
                rows += rows_of(doc_id, words, runs)
            kinds = kinds or [pa.string() if "string" in c else pa.int64() for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(find, schema)


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]


def word_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, start, length, period): every run of every text, in words."""
    return _map(docs, least, False, RUN, lambda doc_id, words, runs: [(doc_id, *r) for r in runs])


def collapse(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, text): each text's words joined by one space, of every run only the first period."""
    joined = lambda doc_id, words, runs: [(doc_id, b" ".join(kept_words(words, runs)).decode("utf-8", "surrogatepass"))]
    return _map(docs, least, False, COLLAPSED, joined)


def _summary(doc_id, words, runs) -> list[tuple]:
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{b},{m},{p}\n" for b, m, p in runs)
    return [(
        doc_id, len(runs), start, length, period, None if length is None else 1000 * length // period,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, runs))).hexdigest(),
    )]


def summaries(docs: DataFrame, least: int = LEAST_WORDS, planted: bool = False) -> DataFrame:
    """A row for each row of docs: how many runs, the longest one, digests of all runs and of the collapsed text.

    planted: plant() rewrites the words before.
    """
    return _map(docs, least, planted, SCHEMA, _summary)
