"""Scenario generators that stay in the engine: draws are a table of counters joined with the panel by position."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import integer
from .windows import history_slices


def panel_positions(returns: DataFrame) -> DataFrame:
    """(pos, date, asset, r): dates that all rows share, counted from 0."""
    rows = returns.filter("r is not null")
    dates = rows.select("date").distinct().withColumn("pos", (F.row_number().over(Window.orderBy("date")) - 1).cast("bigint"))
    return rows.join(dates, "date").select("pos", "date", F.col("series").alias("asset"), "r")


def draws(origins: DataFrame, scenarios: int, horizon: int) -> DataFrame:
    """(origin_pos, scenario, step) for all of them."""
    out = origins.select(F.col("origin_pos").cast("bigint").alias("origin_pos")).withColumn("scenario", F.explode(F.sequence(F.lit(0), F.lit(scenarios - 1))))
    return out.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))


def historical(panel: DataFrame, origins: DataFrame, lookback: int, scenarios: int, horizon: int, seed: int) -> DataFrame:
    """(origin_pos, scenario, step, asset, r): each step takes one day of the last ``lookback``, the same for all assets."""
    at = draws(origins, scenarios, horizon).withColumn("pos", F.col("origin_pos") - lookback + 1 + integer(lookback, seed, "origin_pos", "scenario", "step"))
    return at.join(panel, "pos").select("origin_pos", "scenario", "step", "asset", "r")


def moving_block(panel: DataFrame, origins: DataFrame, lookback: int, scenarios: int, horizon: int, block: int, seed: int) -> DataFrame:
    """As ``historical``, in contiguous blocks of days, the last one cut to the horizon."""
    at = draws(origins, scenarios, horizon).withColumn("k", F.floor(F.col("step") / block).cast("int"))
    start = F.col("origin_pos") - lookback + 1 + integer(lookback - block + 1, seed, "origin_pos", "scenario", "k")
    at = at.withColumn("pos", start + F.col("step") % block)
    return at.join(panel, "pos").select("origin_pos", "scenario", "step", "asset", "r")


def filtered_historical(panel: DataFrame, origins: DataFrame, lookback: int, scenarios: int, horizon: int, decay: float, seed: int, floor: float = 1e-12) -> DataFrame:
    """Standardised residuals of an EWMA variance, drawn jointly by day and scaled by a variance that the path itself updates.

    An origin's window of an asset is a fit of its own; the paths are ordered aggregates over the steps to draw.
    """
    window = history_slices(panel.select("pos", "asset", F.log1p("r").alias("x")), origins, lookback)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("offset")["x"].to_numpy(float)
        v, z = max(x.var(ddof=1), floor), np.empty(len(x))
        for t, value in enumerate(x):
            z[t] = value / math.sqrt(v)
            v = decay * v + (1 - decay) * value * value
        return pd.DataFrame({"origin_pos": [int(key[0])], "asset": [key[1]], "v": [v], "z": [(z - z.mean()).tolist()]})

    fits = window.select("origin_pos", "asset", "offset", "x").groupBy("origin_pos", "asset").applyInPandas(fit, "origin_pos bigint, asset string, v double, z array<double>")
    at = draws(origins, scenarios, horizon).withColumn("i", integer(lookback, seed, "origin_pos", "scenario", "step").cast("int"))
    at = at.groupBy("origin_pos", "scenario").agg(F.transform(F.array_sort(F.collect_list(F.struct("step", "i"))), lambda e: e["i"]).alias("i"))
    both = at.join(fits, "origin_pos")
    begin = F.struct(F.col("v").alias("v"), F.array().cast("array<double>").alias("x"))

    def move(s, i):
        x = F.get(F.col("z"), i) * F.sqrt(s["v"])
        return F.struct((decay * s["v"] + (1 - decay) * x * x).alias("v"), F.concat(s["x"], F.array(x)).alias("x"))

    both = both.withColumn("x", F.aggregate("i", begin, move, lambda s: s["x"]))
    return both.select("origin_pos", "scenario", "asset", F.posexplode("x").alias("step", "x")).select("origin_pos", "scenario", "step", "asset", F.expm1("x").alias("r"))
