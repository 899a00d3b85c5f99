"""Table functions: rows of counters for scenario grids and bootstrap draws, to be joined laterally."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="scenario int, step int")
class ScenarioGrid:
    """(scenario, step) of a number of scenarios over a horizon."""

    def eval(self, scenarios: int, horizon: int) -> Iterator[tuple]:
        for s in range(scenarios):
            for h in range(horizon):
                yield s, h


@udtf(returnType="draw int, k int, pos int")
class CircularBlocks:
    """(draw, k, pos): places 0 .. n - 1 covered by circular blocks from the given starts, cut to n a draw."""

    def eval(self, starts: list, n: int, block: int) -> Iterator[tuple]:
        for draw, own in enumerate(starts):
            for k in range(n):
                yield draw, k, (own[k // block] + k % block) % n


def register(spark: SparkSession) -> None:
    spark.udtf.register("scenario_grid", ScenarioGrid)
    spark.udtf.register("circular_blocks", CircularBlocks)
