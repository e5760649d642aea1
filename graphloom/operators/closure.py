"""Least fixpoints of a step over rows, also on cyclic data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from graphloom.session import materialize

MOST_ROUNDS = 10_000


def closure(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """All rows that ``step`` yields from ``seed`` on, each once.

    A round sees only the rows that the round before has found, and keeps what
    none has found before, so it ends on cycles. Rounds are written tables: the
    plan of a round does not grow, lost executors read files, and the difference
    to what is known is an anti-join on all columns, nulls equal to each other.
    """
    fresh = materialize(seed.distinct(), "closure")
    known = fresh
    for _ in range(most_rounds):
        if fresh.isEmpty():
            return known
        found = step(fresh).toDF(*seed.columns).distinct()
        fresh = materialize(found.subtract(known), "closure")
        known = known.unionAll(fresh)
    raise RuntimeError(f"no fixpoint within {most_rounds} rounds")
