"""The loop all iterative plans share: one job a round, state in the shared folder, a log of rounds."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from loomgraph.session import discard, materialize


class Supersteps:
    """run() repeats step(round, state) -> (state, frontier rows) until no row is left or max_rounds are over.

    A state is a dict of DataFrames. Each round's frames are written to the shared folder, which cuts the lineage and
    survives lost executors; frames of the round before that no name holds any more are deleted.
    """

    def __init__(self, max_rounds: int | None = None):
        self.max_rounds = max_rounds
        self.log: list[tuple[int, int, float]] = []

    def run(self, state: dict[str, DataFrame], step: Callable[[int, dict[str, DataFrame]], tuple[dict[str, DataFrame], str]]) -> dict[str, DataFrame]:
        turn = 0
        while self.max_rounds is None or turn < self.max_rounds:
            began = time.time()
            new, frontier = step(turn, state)
            new = {k: v if any(v is old for old in state.values()) or hasattr(v, "_loomgraph_path") else materialize(v, k) for k, v in new.items()}
            size = new[frontier].count()
            for k, old in state.items():
                if all(old is not v for v in new.values()) and k in new and turn:
                    discard(old)
            state = new
            self.log.append((turn, size, time.time() - began))
            turn += 1
            if not size:
                break
        return state

    def rounds(self, spark) -> DataFrame:
        return spark.createDataFrame(self.log or [], "round int, frontier_size long, seconds double")
