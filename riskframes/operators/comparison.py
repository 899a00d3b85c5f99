"""Paired comparison of forecasts by a circular block bootstrap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import integer


def block_bootstrap(differences: DataFrame, by: list[str], replications: int, block: int, level: float, seed: int) -> DataFrame:
    """(by..., n, mean_difference, ci_lower, ci_upper, bootstrap_standard_error) of rows (by..., pos, d), pos from 0.

    Each draw takes ceil(n / block) circular blocks, cut to n. The draws are a table of counters joined with the differences by position, so they
    spread over tasks; only sums by draw are exchanged.
    """
    if replications < 100 or block < 1 or not 0 < level < 1:
        raise ValueError("a bootstrap needs 100 draws, a block length and a level in (0, 1)")
    w = Window.partitionBy(*by)
    rows = differences.withColumn("n", F.count("*").over(w))
    sizes = rows.select(*by, "n").distinct()
    draws = sizes.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replications - 1))))
    draws = draws.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / block) - 1)))
    draws = draws.withColumn("start", integer("n", seed, *by, "rep", "k"))
    draws = draws.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(block - 1)))).filter(F.col("k") * block + F.col("j") < F.col("n"))
    draws = draws.withColumn("pos", F.pmod(F.col("start") + F.col("j"), F.col("n"))).select(*by, "rep", "pos")
    means = draws.join(rows.select(*by, F.col("pos").cast("bigint").alias("pos"), "d"), [*by, "pos"]).groupBy(*by, "rep").agg(F.avg("d").alias("_m"))
    tail = (1 - level) / 2
    spread = means.groupBy(*by).agg(F.percentile("_m", F.lit(tail)).alias("ci_lower"), F.percentile("_m", F.lit(1 - tail)).alias("ci_upper"), F.stddev_samp("_m").alias("bootstrap_standard_error"))
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference")).join(spread, by)


def leaderboard(detail: DataFrame) -> DataFrame:
    """One row a model from forecast rows: mean scores, violation rate, Brier score, in order of the mean energy score."""
    out = detail.groupBy("model_id").agg(F.count("*").alias("forecast_origins"), F.avg("energy_score").alias("mean_energy_score"), F.avg("variogram_score").alias("mean_variogram_score"),
        F.avg("joint_score").alias("joint_var_es_score"), F.avg(F.col("var_violation").cast("double")).alias("var_violation_rate"),
        F.avg(F.pow(F.col("predicted_co_crash_probability") - F.col("actual_co_crash").cast("double"), F.lit(2))).alias("co_crash_brier_score"), F.avg("actual_loss").alias("mean_realized_loss"))
    return out.orderBy("mean_energy_score", "model_id")
