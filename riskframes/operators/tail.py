"""Tail tools: window severity and weights, peaks over thresholds, and rolling conformal corrections in event order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import gpd_fit

DIRECTIONS = ("two_sided", "downside", "upside")


def severity(cells: DataFrame, direction: str = "two_sided", floor: float = 1e-6) -> DataFrame:
    """(w, severity) of cells (w, step, feature, x): shocks in robust scales, root mean square over features, largest over steps."""
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction}")
    centre = cells.groupBy("feature").agg(F.median("x").alias("m"), F.stddev_pop("x").alias("sd"))
    spread = cells.join(centre, "feature").groupBy("feature").agg((1.4826 * F.median(F.abs(F.col("x") - F.col("m")))).alias("mad"), F.first("m").alias("m"), F.first("sd").alias("sd"))
    scale = F.when(F.col("mad") > floor, F.col("mad")).otherwise(F.greatest("sd", F.lit(floor)))
    z = (F.col("x") - F.col("m")) / scale
    shock = {"two_sided": F.abs(z), "downside": F.greatest(-z, F.lit(0.0)), "upside": F.greatest(z, F.lit(0.0))}[direction]
    each = cells.join(spread, "feature").groupBy("w", "step").agg(F.sqrt(F.avg(F.pow(shock, F.lit(2)))).alias("s"))
    return each.groupBy("w").agg(F.max("s").alias("severity"))


def importance_weights(severities: DataFrame, q: float = 0.9, strength: float = 3.0, most: float = 8.0, floor: float = 1e-6) -> DataFrame:
    """(w, severity, weight): 1 below the quantile, more beyond it, of mean one and at most ``most`` times."""
    one = severities.agg(F.percentile("severity", F.lit(q)).alias("cut"), F.stddev_pop("severity").alias("sd"))
    rows = severities.crossJoin(F.broadcast(one)).withColumn("e", F.greatest(F.col("severity") - F.col("cut"), F.lit(0.0)))  # one row
    scale = rows.agg(F.median(F.when(F.col("e") > 0, F.col("e"))).alias("me"), F.max("sd").alias("s"))
    rows = rows.crossJoin(F.broadcast(scale)).withColumn("raw", F.least(1 + strength * F.col("e") / F.greatest(F.coalesce("me", F.lit(0.0)), "s", F.lit(floor)), F.lit(most)))
    for name, source in (("w1", "raw"), ("w2", "clipped")):
        if source == "clipped":
            rows = rows.withColumn("clipped", F.least(F.col("w1"), F.lit(most)))
        mean = rows.agg(F.avg(source).alias(f"mean_{name}"))
        rows = rows.crossJoin(F.broadcast(mean)).withColumn(name, F.col(source) / F.col(f"mean_{name}"))
    return rows.select("w", "severity", F.col("w2").alias("weight"))


def exceedances(losses: DataFrame, q: float, by: list[str]) -> DataFrame:
    """(by..., loss, threshold, excess) beyond the linear quantile, strictly."""
    cut = losses.groupBy(*by).agg(F.percentile("loss", F.lit(q)).alias("threshold"))
    return losses.join(cut, by).filter("loss > threshold").withColumn("excess", F.col("loss") - F.col("threshold"))


@dataclass(frozen=True)
class Pareto:
    """Peaks over a threshold, or the sample itself where they are too few."""

    threshold: float
    probability: float  # of being at or below the threshold
    shape: float
    scale: float
    sample: np.ndarray
    method: str

    def quantile(self, p: float) -> float:
        if self.method == "empirical" or p <= self.probability:
            return float(np.quantile(self.sample, p, method="higher"))
        tail = (1 - p) / (1 - self.probability)
        grown = -np.log(tail) if abs(self.shape) < 1e-12 else (tail**-self.shape - 1) / self.shape
        return float(self.threshold + self.scale * grown)

    def shortfall(self, p: float) -> float:
        q = self.quantile(p)
        if self.method == "empirical" or p <= self.probability:
            return float(self.sample[self.sample >= q].mean())
        return float("inf") if self.shape >= 1 else float((q + self.scale - self.shape * self.threshold) / (1 - self.shape))


def fit_pareto(losses: np.ndarray, q: float = 0.95, least: int = 25, sparse: str = "raise") -> Pareto:
    losses = np.asarray(losses, float)
    if losses.ndim != 1 or not len(losses) or not np.isfinite(losses).all():
        raise ValueError("losses are a finite vector")
    u = float(np.quantile(losses, q))
    over = losses[losses > u] - u
    probability = 1 - len(over) / len(losses)
    if len(over) < least:
        if sparse == "raise":
            raise ValueError(f"{len(over)} exceedances, {least} are needed")
        return Pareto(u, probability, 0.0, 0.0, losses, "empirical")
    shape, scale = gpd_fit(over)
    return Pareto(u, probability, float(shape), float(scale), losses, "pareto")


def pareto_by_group(losses: DataFrame, by: list[str], grid: list[float], level: float, least: int = 25) -> DataFrame:
    """(by..., threshold_quantile, threshold, exceedances, shape, scale, quantile, shortfall, method) on a grid of thresholds, a group a task."""
    keys = losses.select(*by).schema

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, out = rows["loss"].to_numpy(float), []
        for q in grid:
            m = fit_pareto(x, q, least, "empirical")
            out.append((*key, q, m.threshold, int((x > m.threshold).sum()), m.shape, m.scale, m.quantile(level), m.shortfall(level), m.method))
        return pd.DataFrame(out, columns=[*keys.fieldNames(), "threshold_quantile", "threshold", "exceedances", "shape", "scale", "quantile", "shortfall", "method"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", threshold_quantile double, threshold double, exceedances bigint, shape double, scale double, quantile double, shortfall double, method string"
    return losses.groupBy(*by).applyInPandas(one, schema)


def conformal(events: DataFrame, coverage: float, window: int, minimum: int, cold: float = 0.0) -> DataFrame:
    """(series, seq, forecast_id, base, correction, adjusted) of the issues among events in order.

    Events: (series, seq, kind, forecast_id, value); an issue has its base, an observation what came true. A correction is the order
    statistic at ceil((n + 1) * coverage) of the last ``window`` scores (came true less base) observed before the issue, or ``cold``
    with fewer than ``minimum``. Observing what wasn't issued before, or issuing twice, is an error.
    """
    issued = events.filter("kind = 'issue'").select("series", "forecast_id", F.col("seq").alias("issue_seq"), F.col("value").alias("base"))
    twice = issued.withColumn("_n", F.count("*").over(Window.partitionBy("series", "forecast_id")))
    issued = twice.withColumn("base", F.when(F.col("_n") == 1, F.col("base")).otherwise(F.raise_error(F.lit("a forecast is issued once")).cast("double"))).drop("_n")
    rows = events.join(issued, ["series", "forecast_id"], "left")
    seen = F.col("issue_seq").isNotNull() & (F.col("issue_seq") <= F.col("seq"))
    score = F.when(F.col("kind") == "observe", F.when(seen, F.col("value") - F.col("base")).otherwise(F.raise_error(F.lit("an observation needs its issue")).cast("double")))
    rows = rows.withColumn("score", score).withColumn("k", F.sum((F.col("kind") == "observe").cast("long")).over(Window.partitionBy("series").orderBy("seq")))
    scores = rows.filter("kind = 'observe'").select("series", F.col("k"), "score")
    last = scores.withColumn("recent", F.sort_array(F.collect_list("score").over(Window.partitionBy("series").orderBy("k").rowsBetween(1 - window, 0))))
    out = rows.filter("kind = 'issue'").select("series", "seq", "forecast_id", "base", "k").join(last.select("series", "k", "recent"), ["series", "k"], "left")
    n = F.coalesce(F.size("recent"), F.lit(0))
    rank = F.greatest(F.lit(1), F.least(n, F.ceil((n + 1) * F.lit(coverage)).cast("int")))
    correction = F.when(F.col("recent").isNull() | (n < minimum), F.lit(cold)).otherwise(F.get("recent", rank - 1))
    return out.select("series", "seq", "forecast_id", "base", correction.alias("correction"), (F.col("base") + correction).alias("adjusted"))
