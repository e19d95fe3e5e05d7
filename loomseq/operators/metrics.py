"""Counters of stages: rows that pass, counted while the rows are computed anyway."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Counters:
    """``stage("name")`` is a transform that counts what passes it, with further aggregates if given; after an action on its result, ``totals()`` tells the numbers.

    Counting is part of the stage's own tasks: no further pass, shuffle or stored table. What Spark measures itself
    (time, bytes, spill, waiting) stays in its own metrics. Rows of tasks that were run again after a loss count once.
    """

    def __init__(self):
        self._seen: dict[str, Observation] = {}

    def stage(self, name: str, **aggregates: Column) -> Callable[[DataFrame], DataFrame]:
        if name in self._seen:
            raise ValueError(f"a stage {name} is counted already")
        seen = self._seen[name] = Observation(name)
        return lambda rows: rows.observe(seen, F.count(F.lit(1)).alias("items"), *[c.alias(k) for k, c in aggregates.items()])

    def totals(self) -> dict[str, dict[str, int]]:
        """Numbers by stage. Waits for the action of a stage that hasn't run yet."""
        return {name: dict(seen.get) for name, seen in self._seen.items()}
