"""Rolling features of a return panel, all within windows of rows; a null within a window gives a null."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rows(n: int) -> Window:
    return Window.partitionBy("series").orderBy("date").rowsBetween(1 - n, 0)


def whole(value: Column, of: Column, n: int) -> Column:
    """``value`` where the window has n values of ``of``."""
    return F.when(F.count(of).over(rows(n)) == n, value)


def cross_section(returns: DataFrame) -> DataFrame:
    """(date, mean, dispersion): mean and sample deviation over the series of a date, nulls skipped."""
    return returns.groupBy("date").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("dispersion"))


def rolling_mean(frame: DataFrame, value: str, n: int, name: str) -> DataFrame:
    return frame.withColumn(name, whole(F.avg(value).over(rows(n)), F.col(value), n))


def rolling_volatility(frame: DataFrame, n: int, name: str = "volatility", per_year: int | None = None, years: str = "interval_years") -> DataFrame:
    """Deviation of returns a year: by elapsed time, sqrt(sum log(1+r)^2 / sum years), or with ``per_year`` the sample deviation scaled."""
    if per_year:
        return frame.withColumn(name, whole(F.stddev_samp("r").over(rows(n)) * math.sqrt(per_year), F.col("r"), n))
    square = F.pow(F.log1p("r"), 2)
    both = F.when(F.col("r").isNotNull(), F.col(years))
    return frame.withColumn(name, whole(F.sqrt(F.sum(square).over(rows(n)) / F.sum(F.col(years)).over(rows(n))), both, n))


def rolling_downside(frame: DataFrame, n: int, name: str = "downside", per_year: int | None = None, years: str = "interval_years") -> DataFrame:
    """As ``rolling_volatility`` of the negative part of log returns (root mean square in the second form)."""
    loss = F.pow(F.least(F.log1p("r"), F.lit(0.0)), 2)
    if per_year:
        return frame.withColumn(name, whole(F.sqrt(F.avg(loss).over(rows(n)) * per_year), F.col("r"), n))
    both = F.when(F.col("r").isNotNull(), F.col(years))
    return frame.withColumn(name, whole(F.sqrt(F.sum(loss).over(rows(n)) / F.sum(F.col(years)).over(rows(n))), both, n))


def rolling_drawdown(frame: DataFrame, n: int, name: str = "drawdown") -> DataFrame:
    """Wealth over its peak of n rows, less one; wealth is null where the return is."""
    so_far = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = F.when(F.col("r").isNotNull(), F.exp(F.sum(F.log1p("r")).over(so_far)))
    with_wealth = frame.withColumn("_w", wealth)
    return with_wealth.withColumn(name, whole(F.col("_w") / F.max("_w").over(rows(n)) - 1, F.col("_w"), n)).drop("_w")


def max_drawdown(frame: DataFrame, value: str = "r") -> DataFrame:
    """(series, max_drawdown): the deepest fall of compounded wealth from its peak, which starts at one; as a positive share."""
    so_far = Window.partitionBy("series").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    wealth = frame.filter(F.col(value).isNotNull()).withColumn("_w", F.exp(F.sum(F.log1p(value)).over(so_far)))
    peak = F.greatest(F.lit(1.0), F.max("_w").over(so_far))
    return wealth.withColumn("_d", 1 - F.col("_w") / peak).groupBy("series").agg(F.max("_d").alias("max_drawdown"))


OPERATIONS = ("cross_section_mean", "mean_dispersion", "volatility", "downside", "drawdown")


def derive(market: DataFrame, specs: list[dict]) -> DataFrame:
    """Feature specs in order over (date, r per series) rows; a later spec may read what an earlier one has made.

    The result is (date, one column a feature). Specs: name, operation, and ``source`` (a column made before) or none for the
    panel's equal-weight mean, ``lookback``, ``per_year``.
    """
    section = cross_section(market)
    out = section.select("date", "mean", "dispersion").withColumn("series", F.lit("market"))
    years = F.datediff("date", F.lag("date").over(Window.partitionBy("series").orderBy("date"))) / 365.25
    out = out.withColumn("interval_years", years)
    names = []
    for spec in specs:
        name, kind, n = spec["name"], spec["operation"], spec.get("lookback", 1)
        if kind not in OPERATIONS:
            raise ValueError(f"unknown operation {kind}")
        own = out.withColumn("r", F.col(spec.get("source", "mean")))
        if kind == "cross_section_mean":
            own = own.withColumn(name, F.col("mean"))
        elif kind == "mean_dispersion":
            own = rolling_mean(own, "dispersion", n, name)
        elif kind == "volatility":
            own = rolling_volatility(own, n, name, spec.get("per_year"))
        elif kind == "downside":
            own = rolling_downside(own, n, name, spec.get("per_year"))
        else:
            own = rolling_drawdown(own, n, name)
        out = own.drop("r")
        names.append(name)
    return out.select("date", *names)
