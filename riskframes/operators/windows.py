"""Windows over ordered rows: forward outcomes, origins, history and future slices, recursions and ranks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def forward_cumulative(returns: DataFrame, horizon: int) -> DataFrame:
    """(date, series, g): compounded return over the next ``horizon`` rows from this one on, complete windows only."""
    ahead = Window.partitionBy("series").orderBy("date").rowsBetween(0, horizon - 1)
    out = returns.withColumn("g", F.expm1(F.sum(F.log1p("r")).over(ahead))).withColumn("_n", F.count("r").over(ahead))
    return out.filter(F.col("_n") == horizon).select("date", "series", "g")


def positions(dates: DataFrame) -> DataFrame:
    """(date, pos): distinct dates counted from 0."""
    return dates.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)


def forecast_origins(dates: DataFrame, train_end: str, validation_end: str, horizon: int, stride: int) -> DataFrame:
    """(origin_date, origin_pos, horizon_end): every ``stride`` rows from the last training row on, whole horizon within validation."""
    at = positions(dates)
    ends = at.withColumn("horizon_end", F.lead("date", horizon).over(Window.orderBy("pos")))
    first = at.filter(F.col("date") <= F.lit(train_end).cast("date")).agg(F.max("pos").alias("first"))  # one row
    out = ends.crossJoin(F.broadcast(first))
    on = (F.col("pos") >= F.col("first")) & ((F.col("pos") - F.col("first")) % stride == 0) & (F.col("horizon_end") <= F.lit(validation_end).cast("date"))
    return out.filter(on).select(F.col("date").alias("origin_date"), F.col("pos").alias("origin_pos"), "horizon_end")


def eligible_origins(spark, first: int, last_target: int, history: int, horizon: int, stride: int) -> DataFrame:
    """(origin_pos): from max(first, history - 1) to last_target - horizon, both included."""
    start, stop = max(first, history - 1), last_target - horizon
    return spark.range(start, stop + 1, stride).select(F.col("id").alias("origin_pos"))


def split_origins(origins: DataFrame, fraction: float, thin: int = 1, most: int | None = None) -> DataFrame:
    """``origins`` with ``part``: the first floor(n * fraction), at least one and not all, are ``tuning``; of the others every ``thin``-th is ``evaluation``."""
    k = F.row_number().over(Window.orderBy("origin_pos")) - 1
    n = F.count("*").over(Window.partitionBy(F.lit(0)))
    out = origins.withColumn("_k", k).withColumn("_n", n)
    head = F.greatest(F.lit(1), F.least(F.floor(F.col("_n") * F.lit(fraction)), F.col("_n") - 1))
    out = out.withColumn("_h", head).withColumn("part", F.when(F.col("_k") < F.col("_h"), "tuning").otherwise("evaluation"))
    out = out.filter((F.col("part") == "tuning") | ((F.col("_k") - F.col("_h")) % thin == 0))
    if most is not None:
        out = out.withColumn("_j", F.row_number().over(Window.partitionBy("part").orderBy("origin_pos"))).filter((F.col("part") == "tuning") | (F.col("_j") <= most)).drop("_j")
    return out.drop("_k", "_n", "_h")


def history_slices(rows: DataFrame, origins: DataFrame, length: int) -> DataFrame:
    """Rows of the last ``length`` positions up to each origin: (origin_pos, offset, columns of ``rows``).

    Each row is dealt to the origins that see it through a block key, so the join is an equi-join whatever the stride.
    """
    block = lambda p: F.floor(p / length).cast("bigint")
    keyed = rows.withColumn("_b", block(F.col("pos")))
    wanted = origins.select("origin_pos").withColumn("_b", F.explode(F.array(block(F.col("origin_pos")), block(F.col("origin_pos")) - 1)))
    joined = wanted.join(keyed, "_b").filter(F.col("pos").between(F.col("origin_pos") - length + 1, F.col("origin_pos")))
    return joined.withColumn("offset", F.col("pos") - F.col("origin_pos") + length - 1).drop("_b")


def window_pairs(rows: DataFrame, values: list[str], length: int, horizon: int) -> DataFrame:
    """(pos, past, future): arrays of value arrays over [t - length + 1, t] and [t + 1, t + horizon], complete ones only.

    ``rows`` has ``pos`` and a partition column ``series``.
    """
    w = Window.partitionBy("series").orderBy("pos")
    cell = F.array(*[F.col(v) for v in values])
    out = rows.withColumn("past", F.collect_list(cell).over(w.rowsBetween(1 - length, 0))).withColumn("future", F.collect_list(cell).over(w.rowsBetween(1, horizon)))
    return out.filter((F.size("past") == length) & (F.size("future") == horizon)).select("series", "pos", "past", "future")


def window_boundaries(dates: DataFrame, origins: DataFrame, length: int, horizon: int) -> DataFrame:
    """Positions and dates of each window: context from, origin, target from and to."""
    at = positions(dates)
    out = origins.select("origin_pos").withColumn("context_start", F.col("origin_pos") - length + 1).withColumn("target_start", F.col("origin_pos") + 1).withColumn("target_end", F.col("origin_pos") + horizon)
    for c in ("context_start", "origin_pos", "target_start", "target_end"):
        out = out.join(at.select(F.col("pos").alias(c), F.col("date").alias(c.replace("_pos", "") + "_date")), c)
    return out


def ewma_variance(returns: DataFrame, decay: float, floor: float = 1e-12) -> DataFrame:
    """(date, series, log_return, variance, residual): the variance before each update, from the sample variance of log returns on.

    With v0 the start, v_t = decay * v_{t-1} + (1 - decay) * x_{t-1}^2 is an ordered recursion: one pass over a series, which is one task's group.
    """
    log = returns.filter(F.col("r").isNotNull()).select("date", "series", F.log1p("r").alias("log_return"))
    kind = dict(log.dtypes)["date"]

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("date")
        x = rows["log_return"].to_numpy(float)
        v = np.empty(len(x))
        now = max(x.var(ddof=1) if len(x) > 1 else floor, floor)
        for t, value in enumerate(x):
            v[t] = now
            now = decay * now + (1 - decay) * value * value
        return rows.assign(variance=v, residual=x / np.sqrt(v))

    return log.groupBy("series").applyInPandas(one, f"date {kind}, series string, log_return double, variance double, residual double")


def pit_ranks(rows: DataFrame, value: str, group: str = "series") -> DataFrame:
    """``rows`` with ``pit`` = (average rank - 0.5) / n within the group."""
    first = F.rank().over(Window.partitionBy(group).orderBy(value))
    ties = F.count("*").over(Window.partitionBy(group, value))
    n = F.count("*").over(Window.partitionBy(group))
    return rows.withColumn("pit", (first + (ties - 1) / 2 - 0.5) / n)


def state_switches(paths: DataFrame) -> DataFrame:
    """(scenario, switches): changes of state along each path."""
    before = F.lag("state").over(Window.partitionBy("scenario").orderBy("step"))
    return paths.withColumn("_c", (F.col("state") != before).cast("int")).groupBy("scenario").agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("switches"))


def keep_last(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key in the order given."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).filter("_k = 1").drop("_k")


def equal_bins(rows: DataFrame, order: list[Column], bins: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``bin`` 0 .. bins - 1 of near-equal counts within each key, the first ones one longer."""
    return rows.withColumn("bin", F.ntile(bins).over(Window.partitionBy(*by).orderBy(*order)) - 1)
