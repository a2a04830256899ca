"""Scans, neighbours, folds and searches of sequences that are cut in small blocks, and ranks in vertex sets, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import monoids as M
from loomgraph.operators import primitives as P
from loomgraph.operators import results as R
from loomgraph.operators import sequences as S
from loomgraph.operators import vertexset as V

RNG = random.Random(7)
#: (place, key, x): one key has most rows, one a NULL key, some values are NULL.
ROWS = [(i, RNG.choice(["a", "a", "a", "b", None]), RNG.choice([None, *range(6)])) for i in range(150)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "place long, key string, x long").repartition(5)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(P, "BLOCK_BITS", 3)
    monkeypatch.setattr(M, "BLOCK_BITS", 3)
    monkeypatch.setattr(M, "GROUP_BITS", 2)
    monkeypatch.setattr(S, "SEARCH_BLOCK", 16)


def sequences(by_key):
    out = {}
    for i, key, x in ROWS:
        out.setdefault(key if by_key else 0, []).append((i, x))
    return out.values()


def scanned(fold, by_key, inclusive, backwards, empty):
    out = {}
    for rows in sequences(by_key):
        rows = rows[::-1] if backwards else rows
        for n, (i, _) in enumerate(rows):
            values = [x for _, x in rows[: n + inclusive] if x is not None]
            out[i] = fold(values) if values else empty
    return out


@pytest.mark.parametrize(("fold", "plain", "identity"), [(F.sum, sum, 0), (F.max, max, None), (F.bit_xor, lambda v: int(np.bitwise_xor.reduce(v)), 0)])
def test_scans_over_blocks(rows, fold, plain, identity):
    for by, inclusive, backwards in ((("key",), False, False), ((), True, False), (("key",), True, True), ((), False, True)):
        got = {r.place: r.prefix for r in P.scan(rows, "x", "place", *by, fold=fold, identity=identity, inclusive=inclusive, backwards=backwards).collect()}
        assert got == scanned(plain, bool(by), inclusive, backwards, identity), (by, inclusive, backwards)


#: Joins texts of digits: neither commutes nor has inverses; a state is (number, its digits).
CONCAT = M.Monoid({"digits": "double", "length": "long"}, (0.0, 0), lambda a, b: (np.fmod(a[0] * 10.0 ** np.minimum(b[1], 6) + b[0], 1e6), a[1] + b[1]))


def test_scan_of_a_monoid_that_does_not_commute(rows):
    plain = lambda values: float(int("".join(map(str, values))) % 10**6)
    state = (F.col("x"), F.when(F.col("x").isNotNull(), 1))
    for by, inclusive, backwards in ((("key",), False, False), ((), True, False), ((), False, True), (("key",), True, True)):
        out = M.scan(rows, CONCAT, state, "place", *by, inclusive=inclusive, backwards=backwards)
        assert out.columns == ["place", "key", "x", "digits", "length"]
        assert {r.place: r.digits for r in out.collect()} == scanned(plain, bool(by), inclusive, backwards, 0.0), (by, inclusive, backwards)
    assert M.scan(rows.limit(0), CONCAT, state, "place").collect() == []


def test_folds(rows, monkeypatch):
    both = M.pair(M.simple("total", "long", 0, np.add), M.lexicographic({"low": "long", "at": "long"}, (99, 999)), M.lexicographic({"high": "long", "last": "long"}, (-1, -1), largest=True))
    state = (F.col("x"), F.col("x"), F.when(F.col("x").isNotNull(), F.col("place")), F.col("x"), F.when(F.col("x").isNotNull(), F.col("place")))
    want = {}
    for key in ("a", "b", None):
        own = [(x, i) for i, k, x in ROWS if k == key and x is not None]
        want[key] = (sum(x for x, _ in own), *min(own), *max(own))
    for held in (100_000, 1):
        monkeypatch.setattr(M, "HELD", held)
        assert {r[0]: tuple(r)[1:] for r in M.aggregate(rows, both, state, "key").collect()} == want
    own = [(x, i) for i, _, x in ROWS if x is not None]
    assert tuple(M.aggregate(rows, both, state).first()) == (sum(x for x, _ in own), *min(own), *max(own))
    assert tuple(M.aggregate(rows.limit(0), both, state).first()) == (0, 99, 999, -1, -1)


def test_neighbours_over_blocks(rows):
    for by in (("key",), ()):
        unique, adjacent, falls, filled = set(), [], [], {}
        for own in sequences(bool(by)):
            before, kept = None, None
            for n, (i, x) in enumerate(own):
                if not n or x != before:
                    unique.add(i)
                if n and x is not None and x == before:
                    adjacent.append(own[n - 1][0])
                if n and x is not None and before is not None and x < before:
                    falls.append(i)
                kept = kept if x is None else x
                filled[i], before = kept, x
        assert {r.place for r in P.unique(rows, "x", "place", *by).collect()} == unique
        assert min(r.place for r in P.adjacent_equal(rows, "x", "place", *by).collect() if r.place is not None) == min(adjacent)
        found = P.is_sorted(rows, "x", "place", *by).collect()
        assert min(r.upto for r in found if r.upto is not None) == min(falls) and not any(r.sorted for r in found if r.upto is not None)
        assert {r.place: r.x for r in R.fill_forward(rows, "x", "place", *by).collect()} == filled


def test_occurrences_of_repetitive_patterns(spark):
    cases = [("ab" * 30 + "aab" * 9, "abab"), ("a" * 70, "a" * 33), ("a" * 70, "a"), ("abaababaab" * 6, "abaab"), ("ab" * 20, "ba" * 25), ("ab" * 20, "ac"), ("ab" * 5, "")]
    cases += [("".join(RNG.choice("ab") for _ in range(90)), "".join(RNG.choice("ab") for _ in range(n))) for n in (1, 2, 3, 4)]
    make = lambda text: spark.createDataFrame([(i, None if c == "_" else c) for i, c in enumerate(text)], "pos long, c string")
    for text, pattern in [*cases, ("a_a_a", "a_"), ("a_aa", "aa")]:
        want = [i for i in range(len(text) - len(pattern) + 1) if pattern and "_" not in pattern and text[i : i + len(pattern)] == pattern]
        assert sorted(r.start for r in S.occurrences(make(text), make(pattern), "c", "pos").collect()) == want, (text, pattern)


def test_rank_and_select(spark):
    members = sorted({*range(60, 70), 0, 63, 64, 127, 128, *[RNG.randrange(200_000) for _ in range(60)], (1 << 40) + 63})
    asked = [*range(0, 140), *members, 70_000, 199_999, 1 << 40, (1 << 40) + 63, (1 << 41)]
    own = V.VertexSet(spark.createDataFrame([(m,) for m in members], "id long"))
    got = {r.id: r["rank"] for r in own.rank(spark.createDataFrame([(a,) for a in asked], "id long")).collect()}
    assert got == {a: sum(m < a for m in members) for a in asked}
    ks = spark.range(len(members) + 3).select(F.col("id").alias("k"))
    assert {r.k: r.id for r in own.select(ks).collect()} == dict(enumerate(members))
    assert V.VertexSet.none(spark).rank(spark.range(3)).collect() and not V.VertexSet.none(spark).select(ks).collect()
