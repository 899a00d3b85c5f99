"""Data quality: profiles, flags, coverage, freshness, and the gates that a panel must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite


def out_of_bounds(returns: DataFrame, most: float) -> DataFrame:
    """(date, series, value, threshold) of values beyond the bound; the rows themselves stay in the panel."""
    return returns.filter(F.abs("r") > most).select("date", "series", F.col("r").alias("value"), F.lit(float(most)).alias("threshold"))


def frame_profile(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, columns, first and last date, repeated dates, and the null share of each column."""
    nulls = [F.avg(F.col(c).isNull().cast("double")).alias(f"null_rate__{c}") for c in columns]
    return frame.agg(F.count("*").alias("rows"), F.lit(len(columns)).alias("columns"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        (F.count("date") - F.count_distinct("date")).alias("duplicate_dates"), *nulls)


def finite_fraction(frame: DataFrame, columns: list[str]) -> DataFrame:
    """One row: share of finite cells; 1 where there is none."""
    cells = [F.sum(finite(F.col(c)).cast("long")) for c in columns]
    total = cells[0]
    for c in cells[1:]:
        total = total + c
    return frame.agg(F.coalesce(F.try_divide(total.cast("double"), F.count("*") * len(columns)), F.lit(1.0)).alias("finite_fraction"))


def duplicate_dates(rows: DataFrame, key: str = "series") -> DataFrame:
    return rows.groupBy(key, "date").agg(F.count("*").alias("times")).filter("times > 1")


def in_range(rows: DataFrame, start: str, end: str) -> DataFrame:
    """Rows from start to end, both included."""
    return rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def target_quality(returns: DataFrame) -> DataFrame:
    """(series, observed, missing_rate, first_valid, last_valid)."""
    valid = F.when(F.col("r").isNotNull(), F.col("date"))
    return returns.groupBy("series").agg(F.count("r").alias("observed"), (1 - F.count("r") / F.count("*")).alias("missing_rate"), F.min(valid).alias("first_valid"), F.max(valid).alias("last_valid"))


def calendar_quality(sources: DataFrame, requested_start: str) -> DataFrame:
    """(source, rows, first_date, last_date, max_gap_days, start_delay_days, overlap_rows, relative_density) of rows (source, date).

    The overlap runs from the latest first to the earliest last date; density is against the source with most rows in it.
    """
    days = sources.select("source", "date").distinct()
    gaps = days.withColumn("gap", F.datediff("date", F.lag("date").over(Window.partitionBy("source").orderBy("date"))))
    each = gaps.groupBy("source").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.max("gap").alias("max_gap_days"))
    span = each.agg(F.max("first_date").alias("lo"), F.min("last_date").alias("hi"))  # one row
    inside = days.join(F.broadcast(span), F.col("date").between(F.col("lo"), F.col("hi"))).groupBy("source").agg(F.count("*").alias("overlap_rows"))
    most = F.max("overlap_rows").over(Window.partitionBy(F.lit(0)))  # one row a source
    out = each.join(inside, "source", "left").withColumn("overlap_rows", F.coalesce("overlap_rows", F.lit(0)))
    return out.withColumn("relative_density", F.try_divide(F.col("overlap_rows").cast("double"), most)).withColumn(
        "start_delay_days", F.datediff("first_date", F.lit(requested_start).cast("date")))


def context_coverage(calendar: DataFrame, aligned: DataFrame) -> DataFrame:
    """(feature, usable_share, max_gap_days) of rows (feature, date, value) against the calendar.

    A gap is the number of days between dates that follow each other with a value, the calendar's ends included.
    """
    ends = calendar.agg(F.min("date").alias("lo"), F.max("date").alias("hi"), F.count_distinct("date").alias("n"))
    usable = aligned.filter(F.col("value").isNotNull()).select("feature", "date")
    step = F.datediff("date", F.lag("date").over(Window.partitionBy("feature").orderBy("date")))
    each = usable.withColumn("gap", step).groupBy("feature").agg(F.count("*").alias("m"), F.max("gap").alias("inner_gap"), F.min("date").alias("a"), F.max("date").alias("b"))
    out = aligned.select("feature").distinct().join(each, "feature", "left").crossJoin(F.broadcast(ends))  # one row of ends
    gap = F.greatest(F.col("inner_gap"), F.datediff("a", "lo"), F.datediff("hi", "b"))
    return out.select("feature", (F.coalesce("m", F.lit(0)) / F.col("n")).alias("usable_share"), gap.alias("max_gap_days"))


def freshness(sources: DataFrame, as_of: str, warn_days: int, fail_days: int) -> DataFrame:
    """(source, last_date, age_days, status): fails beyond ``fail_days`` or with a date after ``as_of``."""
    last = sources.groupBy("source").agg(F.max("date").alias("last_date"))
    age = F.datediff(F.lit(as_of).cast("date"), "last_date")
    status = F.when(age.isNull() | (age < 0) | (age > fail_days), "fail").when(age > warn_days, "warn").otherwise("fresh")
    return last.select("source", "last_date", age.alias("age_days"), status.alias("status"))


def price_quality(prices: DataFrame, minimum_coverage: float, expected: DataFrame) -> DataFrame:
    """(series, rows, duplicate_dates, non_positive, coverage, passed) against the expected dates."""
    n = expected.agg(F.count_distinct("date").alias("expected"))
    each = prices.groupBy("series").agg(F.count("*").alias("rows"), (F.count("date") - F.count_distinct("date")).alias("duplicate_dates"),
        F.sum((F.col("price") <= 0).cast("long")).alias("non_positive"), F.count_distinct(F.when(F.col("price").isNotNull(), F.col("date"))).alias("filled"))
    out = each.crossJoin(F.broadcast(n)).withColumn("coverage", F.col("filled") / F.col("expected"))
    passed = (F.col("duplicate_dates") == 0) & (F.col("non_positive") == 0) & (F.col("coverage") >= minimum_coverage)
    return out.select("series", "rows", "duplicate_dates", "non_positive", "coverage", passed.alias("passed"))


def allowlist(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(path, problem): files that aren't expected, and expected ones that are missing."""
    unexpected = actual.select("path").exceptAll(expected.select("path")).withColumn("problem", F.lit("unexpected"))
    return unexpected.unionByName(expected.select("path").exceptAll(actual.select("path")).withColumn("problem", F.lit("missing")))


class DataQualityError(ValueError):
    """Gates that failed, by name."""

    def __init__(self, failed: list[str]) -> None:
        super().__init__(f"failed gates: {', '.join(failed)}")
        self.failed = failed


def _share(frame: DataFrame, prefix: str) -> Column:
    shares = [F.avg(F.col(c).isNotNull().cast("double")) for c in frame.columns if c.startswith(prefix)]
    return F.least(*shares) if len(shares) > 1 else shares[0]


def gates(
    panel: DataFrame,
    matrix: DataFrame,
    audit: DataFrame,
    calendars: DataFrame,
    context: DataFrame,
    validation: DataFrame | None,
    lineage: DataFrame,
    fresh: DataFrame,
    files: DataFrame,
    splits: tuple[str, str],
    limits: dict,
) -> DataFrame:
    """(gate, passed): all 23 gates, each input reduced to one row first.

    panel: wide returns, with ``pos`` the place of each row as it was stored, by which the order of dates is judged; matrix: complete cases; audit: ``interval_audit`` rows; calendars: ``calendar_quality``; context and validation:
    ``context_coverage``; lineage: (date, source_date, available_date); fresh: ``freshness``; files: ``allowlist`` rows.
    """
    ahead = panel.select("date", (F.col("pos") - 1).alias("pos")).withColumnRenamed("date", "next")
    out_of_order = panel.select("date", "pos").join(ahead, "pos").filter("next < date")  # neighbours meet by their places; no global order
    in_order = F.count("*") == 0
    shape = panel.agg(_share(panel, "asset__").alias("coverage"), F.count("*").alias("panel_rows"), (F.count("date") == F.count_distinct("date")).alias("panel_unique"))
    order = out_of_order.agg(in_order.alias("panel_ordered"))
    step = F.datediff("date", F.lag("date").over(Window.orderBy("date")))  # one row a date
    numeric = [c for c in matrix.columns if c.split("__")[0] in ("asset", "macro")]
    good = [F.min(finite(F.col(c)).cast("int")) for c in numeric]
    good = F.least(*good) if len(good) > 1 else good[0]
    split = lambda d: F.when(d <= F.lit(splits[0]).cast("date"), 0).when(d <= F.lit(splits[1]).cast("date"), 1).otherwise(2)
    model = matrix.withColumn("_step", step).withColumn("_s", split(F.col("date"))).agg(
        F.count("*").alias("rows"), (F.count("date") == F.count_distinct("date")).alias("unique"), F.max("_step").alias("gap"), good.alias("finite"), F.count_distinct("_s").alias("parts"))
    per = audit.groupBy("date").agg(F.min("endpoint_present").alias("present"), F.max("calendar_days").alias("days"), (F.max("observations") - F.min("observations")).alias("spread"))
    ends = per.agg(F.min("present").alias("all_present"), F.min("days").alias("least_days"), F.max("days").alias("most_days"), F.max("spread").alias("spread"))
    cal = calendars.agg(F.max("max_gap_days").alias("cal_gap"), F.max("start_delay_days").alias("cal_delay"), F.min("relative_density").alias("cal_density"))
    ctx = context.agg(F.min("usable_share").alias("ctx_share"), F.max(F.coalesce("max_gap_days", F.lit(10**6))).alias("ctx_gap"))
    blank = panel.sparkSession.range(1)
    val = (validation.agg(F.min("usable_share").alias("val_share"), F.max(F.coalesce("max_gap_days", F.lit(10**6))).alias("val_gap"))
        if validation is not None else blank.select(F.lit(1.0).alias("val_share"), F.lit(0).alias("val_gap")))
    late = lineage.agg(F.max((F.col("source_date") > F.col("date")).cast("int")).alias("src_late"), F.max((F.col("available_date") > F.col("date")).cast("int")).alias("avail_late"))
    old = fresh.agg(F.max((F.col("status") == "fail").cast("int")).alias("old"))
    bad = files.agg(F.count("*").alias("bad_files"))
    row = shape
    for part in (order, model, ends, cal, ctx, val, late, old, bad):  # each is one row
        row = row.crossJoin(part)
    c, no = F.col, F.lit(0)
    checks = {
        "raw_cache_matches_catalog_allowlist": c("bad_files") == 0,
        "minimum_asset_coverage": c("coverage") >= limits["asset_coverage"],
        "target_index_unique": c("panel_unique"),
        "target_index_increasing": c("panel_ordered"),
        "common_interval_endpoints_aligned": c("all_present") & (c("least_days") > 0),
        "target_source_internal_gaps_within_limit": c("cal_gap") <= limits["gap_days"],
        "target_source_start_delays_within_limit": c("cal_delay") <= limits["delay_days"],
        "relative_target_calendar_density": c("cal_density") >= limits["density"],
        "model_context_source_coverage": c("ctx_share") >= limits["context_coverage"],
        "model_context_source_internal_gaps_within_limit": c("ctx_gap") <= limits["gap_days"],
        "validation_source_coverage": c("val_share") >= limits["context_coverage"],
        "validation_source_internal_gaps_within_limit": c("val_gap") <= limits["gap_days"],
        "model_index_relative_density": c("rows") >= limits["model_density"] * c("panel_rows"),
        "model_index_internal_gap_within_limit": c("gap") <= limits["gap_days"],
        "common_interval_calendar_gap_within_limit": c("most_days") <= limits["gap_days"],
        "interval_source_observation_count_gap_within_limit": c("spread") <= limits["count_gap"],
        "model_matrix_finite": c("finite") == 1,
        "model_index_unique": c("unique"),
        "source_dates_not_after_model_date": F.coalesce("src_late", no) == 0,
        "availability_dates_not_after_model_date": F.coalesce("avail_late", no) == 0,
        "strict_chronological_splits": c("parts") == 3,
        "validation_only_features_excluded": F.lit(not any(x.startswith("validation__") for x in matrix.columns)),
        "source_freshness_within_failure_limit": c("old") == 0,
    }
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("gate"), F.coalesce(v, F.lit(False)).alias("passed")) for k, v in checks.items()])).alias("g")
    return row.select(each).select("g.*")


def require(passed: DataFrame) -> None:
    """An error that names the gates that failed."""
    failed = [r["gate"] for r in passed.filter(~F.col("passed")).orderBy("gate").collect()]  # at most 23 rows
    if failed:
        raise DataQualityError(failed)


def markdown(gates_: dict[str, bool], splits: list, warnings: list[str]) -> str:
    """The quality report: gates, splits (split, rows, first, last) and warnings."""
    lines = ["# Data quality", "", f"{sum(gates_.values())} of {len(gates_)} gates passed.", "", "| gate | passed |", "|-|-|"]
    lines += [f"| {k} | {'yes' if v else 'no'} |" for k, v in sorted(gates_.items())]
    lines += ["", "| split | rows | first | last |", "|-|-|-|-|", *[f"| {a} | {n} | {b} | {c} |" for a, n, b, c in splits], ""]
    lines += ["Warnings:", *[f"- {w}" for w in warnings]] if warnings else ["No warnings."]
    return "\n".join(lines) + "\n"
