"""Monoids of one's own: folds by key and scans of long sequences with any associative merge.

A Monoid's states are tuples of columns, and merge works on whole numpy columns at once, so a batch of rows is folded in a
logarithmic number of steps. Lifting a row to a state is Spark expressions. Folds merge inside each batch and each task
before the shuffle, so a key that holds a third of all rows reaches its last group as a few states from each task. Scans cut
the sorted sequence into blocks of positions, fold the blocks, scan the folds, and start each block with what stands before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.primitives import numbered

#: Rows of a block of a scan and blocks of a group of blocks, as powers of two; states that a task holds before it sends them on.
BLOCK_BITS, GROUP_BITS, HELD = 16, 12, 100_000

State = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Monoid:
    """columns: names and Spark types (numbers or booleans) of a state; zero: the neutral state; merge(a, b), a standing before b."""

    columns: dict[str, str]
    zero: tuple
    merge: Callable[[State, State], State]

    def lifted(self, values: tuple[Column, ...]) -> list[Column]:
        """A row's state; a NULL counts as that column's zero."""
        return [F.coalesce(v.cast(kind), F.lit(zero).cast(kind)).alias(name) for v, (name, kind), zero in zip(values, self.columns.items(), self.zero, strict=True)]

    @property
    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in self.columns.items())


def simple(name: str, kind: str, zero, ufunc) -> Monoid:
    return Monoid({name: kind}, (zero,), lambda a, b: (ufunc(a[0], b[0]),))


def pair(*monoids: Monoid) -> Monoid:
    """The monoids side by side; their columns need different names."""
    cuts = np.cumsum([0, *[len(m.columns) for m in monoids]]).tolist()

    def merge(a: State, b: State) -> State:
        return tuple(x for m, i, j in zip(monoids, cuts, cuts[1:], strict=False) for x in m.merge(a[i:j], b[i:j]))

    return Monoid({k: v for m in monoids for k, v in m.columns.items()}, tuple(z for m in monoids for z in m.zero), merge)


def lexicographic(columns: dict[str, str], zero: tuple, largest: bool = False) -> Monoid:
    """The smallest (largest) state, its first column compared first."""

    def merge(a: State, b: State) -> State:
        better, equal = np.zeros(len(a[0]), bool), np.ones(len(a[0]), bool)
        for x, y in zip(a, b, strict=True):
            better |= equal & (y > x if largest else y < x)
            equal &= x == y
        return tuple(np.where(better, y, x) for x, y in zip(a, b, strict=True))

    return Monoid(columns, zero, merge)


def _columns(table: pa.Table | pa.RecordBatch, names) -> State:
    return tuple(table.column(n).to_numpy(zero_copy_only=False) for n in names)


def _reduce(monoid: Monoid, codes: np.ndarray, state: State) -> tuple[np.ndarray, State]:
    """(positions, states): a merged state for each run of equal codes, and where the run starts."""
    at = np.arange(len(codes))
    while True:
        first = np.ones(len(codes), bool)
        first[1:] = codes[1:] != codes[:-1]
        if first.all():
            return at, state
        starts = np.flatnonzero(first)
        even = (np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))) % 2 == 0
        left = np.flatnonzero(even)
        paired = left[(left + 1 < len(codes)) & ~first[np.minimum(left + 1, len(codes) - 1)]]
        merged = monoid.merge(tuple(x[paired] for x in state), tuple(x[paired + 1] for x in state))
        state = tuple(x.copy() for x in state)
        for x, y in zip(state, merged, strict=True):
            x[paired] = y
        codes, at, state = codes[left], at[left], tuple(x[left] for x in state)


def _fold(monoid: Monoid, by: tuple[str, ...], table: pa.Table) -> pa.Table:
    """A row for each key of the table."""
    if not by:
        codes = np.zeros(table.num_rows, np.int64)
    else:
        codes = pd.DataFrame({i: table.column(c).to_pandas() for i, c in enumerate(by)}).groupby(list(range(len(by))), dropna=False, sort=False).ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    at, state = _reduce(monoid, codes[order], tuple(x[order] for x in _columns(table, monoid.columns)))
    keys = table.select(list(by)).take(pa.array(order[at]))
    types = [table.schema.field(n).type for n in monoid.columns]
    return pa.table([*keys.columns, *[pa.array(x, t) for x, t in zip(state, types, strict=True)]], names=[*by, *monoid.columns])


def aggregate(df: DataFrame, monoid: Monoid, values: tuple[Column, ...], *by: str) -> DataFrame:
    """(by, the monoid's columns): the merged state of each key, without keys one row. Rows come in any order, so merge must commute."""
    rows = df.select(*by, *monoid.lifted(values))
    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by], monoid.schema])

    def partial(batches):
        held = None
        for batch in batches:
            own = _fold(monoid, by, pa.Table.from_batches([batch]))
            held = own if held is None else _fold(monoid, by, pa.concat_tables([held, own]))
            if held.num_rows > HELD:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    out = rows.mapInArrow(partial, schema).groupBy(*by).applyInArrow(lambda table: _fold(monoid, by, table), schema)
    if by:
        return out
    one = df.sparkSession.range(1).select(F.lit(1).alias("one")).join(out, F.lit(True), "left")
    return one.select(*[F.coalesce(F.col(n), F.lit(z).cast(k)).alias(n) for (n, k), z in zip(monoid.columns.items(), monoid.zero, strict=True)])


ENDS = ("first_1", "first_2", "last_1", "last_2")


class _Runs:
    """Stretches of a sorted sequence: hashes of their first and last keys, and the state of the last key's part."""

    def __init__(self, monoid: Monoid, ends: State, state: State):
        self.monoid, self.ends, self.state = monoid, ends, state

    @staticmethod
    def of(monoid: Monoid, table: pa.Table) -> _Runs:
        return _Runs(monoid, _columns(table, ENDS), _columns(table, monoid.columns))

    def take(self, at) -> _Runs:
        return _Runs(self.monoid, tuple(x[at] for x in self.ends), tuple(x[at] for x in self.state))

    def then(self, other: _Runs) -> _Runs:
        (a1, a2, b1, b2), (c1, c2, d1, d2) = self.ends, other.ends
        joins = (c1 == d1) & (c2 == d2) & (b1 == c1) & (b2 == c2)
        merged = self.monoid.merge(self.state, other.state)
        return _Runs(self.monoid, (a1, a2, d1, d2), tuple(np.where(joins, x, y) for x, y in zip(merged, other.state, strict=True)))

    def scanned(self) -> _Runs:
        """Each with all before it."""
        out, n, step = self, len(self.ends[0]), 1
        while step < n:
            more = out.take(slice(None, -step)).then(out.take(slice(step, None)))
            out = _Runs(self.monoid, *(tuple(np.concatenate([x[:step], y]) for x, y in zip(old, new, strict=True)) for old, new in ((out.ends, more.ends), (out.state, more.state))))
            step *= 2
        return out

    def arrays(self) -> list[np.ndarray]:
        return [*self.ends, *self.state]


def scan(df: DataFrame, monoid: Monoid, values: tuple[Column, ...], pos: str, *by: str, inclusive: bool = False, backwards: bool = False) -> DataFrame:
    """df with the monoid's columns: the merge of the states before (inclusive: up to) each position, from the end if backwards.

    One sequence for each key of by; positions settle the order. A key may hold all rows: no task sees more than a block.
    """
    keys = [F.col(c) for c in by] or [F.lit(0)]
    order = [*by, F.col(pos).desc() if backwards else F.col(pos)]
    names, columns = list(monoid.columns), df.columns
    lifted = df.withColumns(dict(zip([f"own_{n}" for n in names], monoid.lifted(values), strict=True)) | {"key_1": F.xxhash64(*keys), "key_2": F.hash(*keys).cast("long")})
    rows = numbered(lifted, *order, name="scan_place").withColumn("scan_block", F.shiftright("scan_place", BLOCK_BITS))
    summary = f"block long, {', '.join(f'{e} long' for e in ENDS)}, {monoid.schema}"
    types = [kind for kind in monoid.columns.values()]

    def sorted_runs(table: pa.Table) -> tuple[np.ndarray, _Runs]:
        at = np.argsort(table.column("scan_place").to_numpy(), kind="stable")
        k1, k2 = (table.column(c).to_numpy()[at] for c in ("key_1", "key_2"))
        return at, _Runs(monoid, (k1, k2, k1, k2), tuple(x[at] for x in _columns(table, [f"own_{n}" for n in names])))

    def table_of(blocks: np.ndarray, runs: _Runs) -> pa.Table:
        return pa.table([pa.array(blocks, pa.int64()), *[pa.array(x, pa.int64()) for x in runs.ends], *[pa.array(x, arrow(k)) for x, k in zip(runs.state, types, strict=True)]], names=["block", *ENDS, *names])

    def fold_block(key, table):
        _, runs = sorted_runs(table)
        return table_of(np.array([key[0].as_py()]), runs.scanned().take(slice(-1, None)))

    def before(table):
        """For each block of the table but the first what stands before it in the table."""
        table = table.sort_by("block")
        runs = _Runs.of(monoid, table).scanned()
        return table_of(table.column("block").to_numpy()[1:], runs.take(slice(None, -1)))

    def fold_group(key, table):
        return table_of(np.array([key[0].as_py()]), _Runs.of(monoid, table.sort_by("block")).scanned().take(slice(-1, None)))

    def carry(table, ahead):
        """What stands before each block of a group, the groups before it included."""
        own = before(table)
        if not ahead.num_rows:
            return own
        first = _Runs.of(monoid, ahead).take(np.zeros(own.num_rows, np.int64))
        joined = table_of(own.column("block").to_numpy(), first.then(_Runs.of(monoid, own)))
        start = table_of(np.array([table.column("block").to_numpy().min()]), _Runs.of(monoid, ahead))
        return pa.concat_tables([start, joined])

    def finish(table, ahead):
        at, runs = sorted_runs(table)
        n, done = len(at), runs.scanned()
        if ahead.num_rows:
            done = _Runs.of(monoid, ahead).take(np.zeros(n, np.int64)).then(done)
        state = done.state
        if not inclusive:
            zero = tuple(np.full(n, z, x.dtype) for z, x in zip(monoid.zero, state, strict=True))
            k1, k2 = runs.ends[:2]
            same = np.zeros(n, bool)
            same[1:] = (k1[1:] == k1[:-1]) & (k2[1:] == k2[:-1])
            shifted = tuple(np.concatenate([z[:1], x[:-1]]) for x, z in zip(state, zero, strict=True))
            if ahead.num_rows:
                old = _Runs.of(monoid, ahead)
                same[0] = old.ends[2][0] == k1[0] and old.ends[3][0] == k2[0]
                for x, y in zip(shifted, old.state, strict=True):
                    x[0] = y[0]
            state = tuple(np.where(same, x, z) for x, z in zip(shifted, zero, strict=True))
        kept = table.select(columns).take(pa.array(at))
        return pa.table([*kept.columns, *[pa.array(x, arrow(k)) for x, k in zip(state, types, strict=True)]], names=[*columns, *names])

    slim = rows.select("scan_block", "scan_place", "key_1", "key_2", *[f"own_{n}" for n in names])
    blocks = slim.groupBy("scan_block").applyInArrow(fold_block, summary).withColumn("in_group", F.shiftright("block", GROUP_BITS))
    groups = blocks.groupBy("in_group").applyInArrow(fold_group, summary)
    # One row for each group of 2 ** (BLOCK_BITS + GROUP_BITS) rows.
    ahead = groups.groupBy().applyInArrow(before, summary)
    carries = blocks.groupBy("in_group").cogroup(ahead.withColumnRenamed("block", "of_group").withColumn("block", F.col("of_group")).groupBy("of_group")).applyInArrow(lambda a, b: carry(a.drop_columns(["in_group"]), b), summary)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], monoid.schema])
    return rows.groupBy("scan_block").cogroup(carries.groupBy("block")).applyInArrow(finish, schema)


def arrow(kind: str) -> pa.DataType:
    return {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(), "boolean": pa.bool_()}[kind]
