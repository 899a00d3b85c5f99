"""Panel, window and quality queries over the proxies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import features, panel, quality, windows
from .proxies import MACRO, MARKET, PRICES, RETURNS, SERIES, TRAIN_END, VALIDATION_END, daily, macro, market, prices, returns, table

H, STRIDE, LOOK = 4, 20, 20


def _date():
    return F.col("date").cast("string").alias("date")


def _r(name: str, places: int = 8, alias: str | None = None):
    return F.round(name, places).alias(alias or name)


def _eligible(spark, d, step):
    """Origins of the market's rows: from row 7 on, with 20 rows of history and a whole horizon ahead."""
    last = windows.positions(market(spark, d)).agg(F.max("pos")).first()[0]
    return windows.eligible_origins(spark, 7, last, 20, H, step)


def panel_wide(spark: SparkSession, d: str) -> DataFrame:
    out = panel.wide(returns(spark, d), SERIES)
    return out.select(_date(), *[_r(f"asset__{s}") for s in SERIES])


def log_returns(spark, d):
    return panel.log_returns(prices(spark, d)).select(_date(), "series", _r("r"))


def macro_transforms(spark, d):
    out = None
    for kind in panel.TRANSFORMS:
        one = panel.macro_transform(macro(spark, d).withColumn("series", F.lit("m")), kind).select(_date(), F.lit(kind).alias("transform"), _r("value", 6))
        out = one if out is None else out.unionByName(one)
    return out


def duration_convexity(spark, d):
    rows = macro(spark, d).select("date", F.lit("y").alias("series"), (2 + F.col("value") / 100000).alias("value"))
    return panel.duration_convexity(rows, F.lit(10.0)).select(_date(), _r("r", 10))


def _two_calendars(spark, d):
    sources = daily(spark, d, "orders").withColumn("source", F.lit("orders")).unionByName(daily(spark, d, "lineitem").withColumn("source", F.lit("lineitem")))
    sources = sources.filter((F.col("source") == "orders") | (F.dayofweek("date") != 4))
    return sources, panel.common_dates([sources.filter(f"source = '{s}'") for s in ("orders", "lineitem")])


def common_endpoints(spark, d):
    return _two_calendars(spark, d)[1].select(_date())


def endpoint_compounding(spark, d):
    ends = table(spark, d, "orders").select(F.last_day(F.col("o_orderdate").cast("date")).alias("date")).distinct()
    rows = returns(spark, d).filter("r is not null").select("date", "series", "r")
    return panel.compound_between(rows, ends).select(_date(), "series", _r("r"))


def interval_audit(spark, d):
    sources, ends = _two_calendars(spark, d)
    out = panel.interval_audit(sources, ends)
    return out.select(_date(), F.col("start").cast("string").alias("start"), "calendar_days", "source", "observations", "endpoint_present")


def _asof(spark, d):
    calendar = daily(spark, d, "lineitem")
    return panel.asof_align(calendar, macro(spark, d).filter("day(date) % 7 < 3"), 2, 5)


def asof_lagged(spark, d):
    return _asof(spark, d).select(_date(), _r("value", 6), F.col("source_date").cast("string").alias("source_date"), F.col("available_date").cast("string").alias("available_date"), "stale")


def asof_stale_flags(spark, d):
    return _asof(spark, d).groupBy("stale").agg(F.count("*").alias("n"), F.count("value").alias("filled"))


def derived_spread(spark, d):
    out = panel.subtract(panel.wide(returns(spark, d), SERIES), "asset__s0", "asset__s1", "spread")
    return out.select(_date(), _r("spread"))


def complete_case_matrix(spark, d):
    frame = panel.wide(returns(spark, d), SERIES).join(_asof(spark, d).select("date", F.col("value").alias("macro__m")), "date", "left")
    targets = [f"asset__{s}" for s in SERIES]
    return panel.complete_cases(frame, targets, ["macro__m"]).select(_date(), *[_r(c) for c in targets], _r("macro__m", 6))


def chronological_split_profile(spark, d):
    rows = market(spark, d).withColumn("split", panel.split_of(F.col("date"), TRAIN_END, VALIDATION_END))
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"))


def bad_tick_flags(spark, d):
    return quality.out_of_bounds(returns(spark, d), 0.2).select(_date(), "series", _r("value"), "threshold")


def frame_profile(spark, d):
    columns = [f"asset__{s}" for s in SERIES]
    out = quality.frame_profile(panel.wide(returns(spark, d), SERIES), columns)
    return out.select("rows", "columns", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), "duplicate_dates", *[_r(f"null_rate__{c}", 10) for c in columns])


def finite_fraction(spark, d):
    out = quality.finite_fraction(panel.wide(returns(spark, d), SERIES), [f"asset__{s}" for s in SERIES])
    return out.select(_r("finite_fraction", 10))


def target_quality(spark, d):
    out = quality.target_quality(returns(spark, d))
    return out.select("series", "observed", _r("missing_rate", 10), F.col("first_valid").cast("string").alias("first_valid"), F.col("last_valid").cast("string").alias("last_valid"))


def calendar_quality(spark, d):
    out = quality.calendar_quality(_two_calendars(spark, d)[0], "1995-01-01")
    return out.select("source", "rows", F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"), "max_gap_days", "overlap_rows", _r("relative_density", 10), "start_delay_days")


def context_coverage(spark, d):
    aligned = _asof(spark, d).select("date", "value", F.lit("m").alias("feature"))
    return quality.context_coverage(daily(spark, d, "lineitem"), aligned).select("feature", _r("usable_share", 10), "max_gap_days")


def freshness(spark, d):
    out = quality.freshness(_two_calendars(spark, d)[0], "2002-01-01", 45, 180)
    return out.select("source", F.col("last_date").cast("string").alias("last_date"), "age_days", "status")


def duplicate_dates(spark, d):
    rows = table(spark, d, "orders").select(F.concat(F.lit("c"), (F.col("o_custkey") % 50).cast("string")).alias("series"), F.col("o_orderdate").cast("date").alias("date"))
    return quality.duplicate_dates(rows).select("series", _date(), "times")


def allowlist_diff(spark, d):
    actual = table(spark, d, "nation").select(F.col("n_name").alias("path")).unionByName(spark.sql("select 'extra.csv' as path"))
    expected = table(spark, d, "nation").filter("n_nationkey > 2").select(F.col("n_name").alias("path")).unionByName(table(spark, d, "region").select(F.concat("r_name", F.lit(".csv")).alias("path")))
    return quality.allowlist(actual, expected)


def price_quality(spark, d):
    p = prices(spark, d)
    out = quality.price_quality(p, 0.97, p.select("date").distinct())
    return out.select("series", "rows", "duplicate_dates", "non_positive", _r("coverage", 10), "passed")


def quality_gates(spark, d):
    wide = panel.wide(returns(spark, d), SERIES)
    wide = wide.join(windows.positions(wide), "date")
    aligned = _asof(spark, d)
    targets = [f"asset__{s}" for s in SERIES]
    matrix = panel.complete_cases(wide.join(aligned.select("date", F.col("value").alias("macro__m")), "date", "left"), targets, ["macro__m"])
    sources, ends = _two_calendars(spark, d)
    none = spark.createDataFrame([], "path string, problem string")
    limits = {"asset_coverage": 0.97, "gap_days": 10, "delay_days": 10, "density": 0.9, "context_coverage": 0.97, "model_density": 0.97, "count_gap": 5}
    return quality.gates(wide, matrix, panel.interval_audit(sources, ends), quality.calendar_quality(sources, "1995-01-01"),
        quality.context_coverage(daily(spark, d, "lineitem"), aligned.select("date", "value", F.lit("m").alias("feature"))), None, aligned,
        quality.freshness(sources, "2002-01-01", 45, 180), none, (TRAIN_END, VALIDATION_END), limits)


def xs_mean_dispersion(spark, d):
    rows = features.cross_section(returns(spark, d).filter("r is not null"))
    return rows.select(_date(), _r("mean"), _r("dispersion"))


def _with_years(spark, d):
    years = F.datediff("date", F.lag("date").over(Window.partitionBy("series").orderBy("date"))) / 365.25
    return market(spark, d).withColumn("series", F.lit("m")).withColumn("interval_years", years)


def rolling_vol_elapsed(spark, d):
    return features.rolling_volatility(_with_years(spark, d), LOOK).select(_date(), _r("volatility"))


def rolling_vol_annualised(spark, d):
    return features.rolling_volatility(_with_years(spark, d), LOOK, per_year=52).select(_date(), _r("volatility"))


def downside_semivol(spark, d):
    out = features.rolling_downside(features.rolling_downside(_with_years(spark, d), LOOK, "elapsed"), LOOK, "annual", 52)
    return out.select(_date(), _r("elapsed"), _r("annual"))


def rolling_drawdown(spark, d):
    return features.rolling_drawdown(market(spark, d).withColumn("series", F.lit("m")), LOOK).select(_date(), _r("drawdown"))


def max_drawdown(spark, d):
    return features.max_drawdown(returns(spark, d)).select("series", _r("max_drawdown"))


def derived_features(spark, d):
    specs = [
        {"name": "mean", "operation": "cross_section_mean"},
        {"name": "mean_dispersion", "operation": "mean_dispersion", "lookback": 8},
        {"name": "vol", "operation": "volatility", "lookback": 8, "per_year": 52},
        {"name": "drawdown", "operation": "drawdown", "lookback": 8},
    ]
    out = features.derive(returns(spark, d).filter("r is not null"), specs)
    return out.select(_date(), *[_r(s["name"]) for s in specs])


def forward_cumulative(spark, d):
    return windows.forward_cumulative(returns(spark, d), H).select(_date(), "series", _r("g"))


def origins(spark, d):
    out = windows.forecast_origins(market(spark, d), TRAIN_END, VALIDATION_END, H, STRIDE)
    return out.select(F.col("origin_date").cast("string").alias("origin_date"), F.col("origin_pos").cast("long").alias("origin_pos"), F.col("horizon_end").cast("string").alias("horizon_end"))


def eligible_origins(spark, d):
    return _eligible(spark, d, 9)


def origin_split(spark, d):
    return windows.split_origins(_eligible(spark, d, 9), 0.3, 2, 5).select("origin_pos", "part")


def window_boundaries(spark, d):
    out = windows.window_boundaries(market(spark, d), _eligible(spark, d, 9), 20, H)
    return out.select("origin_pos", *[F.col(c).cast("string").alias(c) for c in ("context_start_date", "origin_date", "target_start_date", "target_end_date")])


def history_slice(spark, d):
    rows = market(spark, d).withColumn("pos", F.row_number().over(Window.orderBy("date")) - 1)
    out = windows.history_slices(rows, _eligible(spark, d, 40), 20)
    return out.select("origin_pos", F.col("offset").cast("long").alias("offset"), _r("r"))


def window_pairs(spark, d):
    rows = returns(spark, d).filter("r is not null").withColumn("pos", F.row_number().over(Window.partitionBy("series").orderBy("date")) - 1)
    out = windows.window_pairs(rows, ["r"], 6, 2)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x[0]), 8)
    return out.select("series", F.col("pos").cast("long").alias("pos"), total("past").alias("past_sum"), total("future").alias("future_sum"))


def ewma_variance(spark, d):
    return windows.ewma_variance(returns(spark, d), 0.94).select(_date(), "series", _r("variance"), _r("residual", 6))


def pit_ranks(spark, d):
    rows = returns(spark, d).filter("r is not null").withColumn("r", F.round("r", 1))
    return windows.pit_ranks(rows, "r").select(_date(), "series", _r("pit", 10))


def pushed_scan(spark, d):
    """Scan with the date predicate at the source: the plan's PushedFilters hold it."""
    rows = table(spark, d, "orders").filter(F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz"))
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderdate").cast("date").cast("string").alias("last"))


def reindexed(spark, d):
    return panel.reindex(macro(spark, d), daily(spark, d, "lineitem")).select(_date(), _r("value", 6))


def unpivoted(spark, d):
    return panel.long(panel_wide(spark, d), "asset__").select("date", "series", "value")


def keep_last(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("string").alias("date"))
    return windows.keep_last(rows, ["o_custkey"], F.struct("date", "o_orderkey"))


NAMES = """panel_wide log_returns macro_transforms duration_convexity common_endpoints endpoint_compounding interval_audit asof_lagged asof_stale_flags derived_spread
complete_case_matrix chronological_split_profile bad_tick_flags frame_profile finite_fraction target_quality calendar_quality context_coverage freshness duplicate_dates allowlist_diff
price_quality quality_gates xs_mean_dispersion rolling_vol_elapsed rolling_vol_annualised downside_semivol rolling_drawdown max_drawdown derived_features forward_cumulative origins
eligible_origins origin_split window_boundaries history_slice window_pairs ewma_variance pit_ranks pushed_scan reindexed unpivoted keep_last""".split()
QUERIES = {n: globals()[n] for n in NAMES}

DAYS = """days AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)"""
CALENDARS = """sources AS (
  SELECT DISTINCT CAST(o_orderdate AS DATE) AS date, 'orders' AS source FROM orders
  UNION SELECT DISTINCT CAST(l_shipdate AS DATE), 'lineitem' FROM lineitem WHERE dayofweek(l_shipdate) <> 3
), ends AS (
  SELECT date FROM sources GROUP BY date HAVING count(DISTINCT source) = 2
)"""
WIDE = RETURNS + ", wide AS (SELECT date, " + ", ".join(f"max(r) FILTER (WHERE series = '{s}') AS asset__{s}" for s in SERIES) + " FROM returns GROUP BY date)"
ASOF = DAYS + ", " + MACRO + """, src AS (
  SELECT date AS source_date, value FROM macro WHERE day(date) % 7 < 3
), cal AS (
  SELECT date, row_number() OVER (ORDER BY date) AS pos FROM days
), due AS (
  SELECT source_date, value, (SELECT count(*) FROM cal WHERE cal.date < s.source_date) + 1 + 2 AS pos FROM src s
), known AS (
  SELECT cal.date AS available_date, source_date, value FROM due JOIN cal USING (pos) QUALIFY row_number() OVER (PARTITION BY pos ORDER BY source_date DESC) = 1
), aligned AS (
  SELECT cal.date, CASE WHEN date_diff('day', k.source_date, cal.date) <= 5 THEN k.value END AS value, k.source_date, k.available_date,
    k.source_date IS NOT NULL AND date_diff('day', k.source_date, cal.date) > 5 AS stale
  FROM cal ASOF LEFT JOIN known k ON cal.date >= k.available_date
)"""
W20 = "OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
YEARS = MARKET + ", m AS (SELECT date, r, date_diff('day', lag(date) OVER (ORDER BY date), date) / 365.25 AS y FROM market)"
POS = MARKET + ", placed AS (SELECT date, r, row_number() OVER (ORDER BY date) - 1 AS pos FROM market)"
ELIGIBLE = "o AS (SELECT unnest(generate_series(19, (SELECT max(pos) FROM placed) - 4, {step})) AS origin_pos)"
_FIVE = ", ".join(f"round(asset__{s}, 8) AS asset__{s}" for s in SERIES)
_ALL = " AND ".join(f"asset__{s} IS NOT NULL" for s in SERIES)

ORACLES = {
    "panel_wide": f"WITH {WIDE} SELECT CAST(date AS VARCHAR) AS date, {_FIVE} FROM wide",
    "log_returns": f"WITH {PRICES} SELECT CAST(date AS VARCHAR) AS date, series, round(ln(price) - lag(ln(price)) OVER (PARTITION BY series ORDER BY date), 8) AS r FROM prices",
    "macro_transforms": f"""WITH {MACRO}, l AS (SELECT date, value, lag(value) OVER (ORDER BY date) AS p FROM macro)
      SELECT CAST(date AS VARCHAR) AS date, k AS transform, round(CASE k WHEN 'level' THEN value WHEN 'difference' THEN value - p WHEN 'bps_difference' THEN (value - p) * 100
        WHEN 'log_difference' THEN ln(value) - ln(p) ELSE value / p - 1 END, 6) AS value
      FROM l, (SELECT unnest(['level', 'difference', 'bps_difference', 'log_difference', 'pct_change']) AS k)""",
    "duration_convexity": f"""WITH {MACRO}, y AS (SELECT date, (2 + value / 100000) / 100 AS y, lag((2 + value / 100000) / 100) OVER (ORDER BY date) AS p, date_diff('day', lag(date) OVER (ORDER BY date), date) / 365.25 AS t FROM macro)
      SELECT CAST(date AS VARCHAR) AS date, round(p * t - 10.0 / (1 + p) * (y - p) + 0.5 * 110.0 / ((1 + p) * (1 + p)) * (y - p) * (y - p), 10) AS r FROM y""",
    "common_endpoints": f"WITH {CALENDARS} SELECT CAST(date AS VARCHAR) AS date FROM ends",
    "endpoint_compounding": f"""WITH {RETURNS}, e AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS date FROM orders), s AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM e), n AS (SELECT DISTINCT series FROM returns)
      SELECT CAST(s.date AS VARCHAR) AS date, n.series, round(coalesce(product(1 + r.r), 1) - 1, 8) AS r FROM s CROSS JOIN n LEFT JOIN returns r ON r.series = n.series AND r.date > s.prev AND r.date <= s.date AND r.r IS NOT NULL
      WHERE prev IS NOT NULL GROUP BY s.date, n.series""",
    "interval_audit": f"""WITH {CALENDARS}, s AS (SELECT date, lag(date) OVER (ORDER BY date) AS start FROM ends)
      SELECT CAST(s.date AS VARCHAR) AS date, CAST(start AS VARCHAR) AS start, CAST(date_diff('day', start, s.date) AS DOUBLE) AS calendar_days, c.source, CAST(count(*) AS BIGINT) AS observations, bool_or(c.date = s.date) AS endpoint_present
      FROM s JOIN sources c ON c.date > start AND c.date <= s.date GROUP BY s.date, start, c.source""",
    "asof_lagged": f"WITH {ASOF} SELECT CAST(date AS VARCHAR) AS date, round(value, 6) AS value, CAST(source_date AS VARCHAR) AS source_date, CAST(available_date AS VARCHAR) AS available_date, stale FROM aligned",
    "asof_stale_flags": f"WITH {ASOF} SELECT stale, count(*) AS n, count(value) AS filled FROM aligned GROUP BY stale",
    "derived_spread": f"WITH {WIDE} SELECT CAST(date AS VARCHAR) AS date, round(asset__s0 - asset__s1, 8) AS spread FROM wide",
    "complete_case_matrix": f"WITH {WIDE}, {ASOF} SELECT CAST(wide.date AS VARCHAR) AS date, {_FIVE}, round(value, 6) AS macro__m FROM wide JOIN aligned USING (date) WHERE value IS NOT NULL AND {_ALL}",
    "chronological_split_profile": f"""WITH {MARKET} SELECT CASE WHEN date <= '{TRAIN_END}' THEN 'train' WHEN date <= '{VALIDATION_END}' THEN 'validation' ELSE 'test' END AS split,
      count(*) AS rows, CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last FROM market GROUP BY 1""",
    "bad_tick_flags": f"WITH {RETURNS} SELECT CAST(date AS VARCHAR) AS date, series, round(r, 8) AS value, 0.2::DOUBLE AS threshold FROM returns WHERE abs(r) > 0.2",
    "frame_profile": f"WITH {WIDE} SELECT count(*) AS rows, 5 AS columns, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date, count(date) - count(DISTINCT date) AS duplicate_dates, "
    + ", ".join(f"round(avg(CASE WHEN asset__{s} IS NULL THEN 1.0 ELSE 0.0 END), 10) AS null_rate__asset__{s}" for s in SERIES) + " FROM wide",
    "finite_fraction": f"WITH {WIDE} SELECT round(({' + '.join(f'count(asset__{s})' for s in SERIES)}) / (5.0 * count(*)), 10) AS finite_fraction FROM wide",
    "target_quality": f"WITH {RETURNS} SELECT series, count(r) AS observed, round(1 - count(r) / count(*), 10) AS missing_rate, CAST(min(date) FILTER (r IS NOT NULL) AS VARCHAR) AS first_valid, CAST(max(date) FILTER (r IS NOT NULL) AS VARCHAR) AS last_valid FROM returns GROUP BY series",
    "calendar_quality": f"""WITH {CALENDARS}, g AS (SELECT *, date_diff('day', lag(date) OVER (PARTITION BY source ORDER BY date), date) AS gap FROM sources),
      e AS (SELECT source, count(*) AS rows, min(date) AS a, max(date) AS b, CAST(max(gap) AS INTEGER) AS max_gap_days FROM g GROUP BY source), sp AS (SELECT max(a) AS lo, min(b) AS hi FROM e),
      n AS (SELECT source, count(*) AS overlap_rows FROM sources, sp WHERE date BETWEEN lo AND hi GROUP BY source)
      SELECT source, rows, CAST(a AS VARCHAR) AS first_date, CAST(b AS VARCHAR) AS last_date, max_gap_days, overlap_rows, round(overlap_rows / max(overlap_rows) OVER (), 10) AS relative_density, CAST(date_diff('day', DATE '1995-01-01', a) AS INTEGER) AS start_delay_days FROM e JOIN n USING (source)""",
    "context_coverage": f"""WITH {ASOF}, u AS (SELECT date FROM aligned WHERE value IS NOT NULL), z AS (SELECT date FROM u UNION SELECT min(date) FROM days UNION SELECT max(date) FROM days),
      g AS (SELECT date_diff('day', lag(date) OVER (ORDER BY date), date) AS gap FROM z)
      SELECT 'm' AS feature, round((SELECT count(*) FROM u) / (SELECT count(*) FROM days), 10) AS usable_share, CAST(max(gap) AS INTEGER) AS max_gap_days FROM g""",
    "freshness": f"""WITH {CALENDARS}, l AS (SELECT source, max(date) AS d FROM sources GROUP BY source) SELECT source, CAST(d AS VARCHAR) AS last_date, CAST(date_diff('day', d, DATE '2002-01-01') AS INTEGER) AS age_days,
      CASE WHEN date_diff('day', d, DATE '2002-01-01') NOT BETWEEN 0 AND 180 THEN 'fail' WHEN date_diff('day', d, DATE '2002-01-01') > 45 THEN 'warn' ELSE 'fresh' END AS status FROM l""",
    "duplicate_dates": "SELECT 'c' || CAST(o_custkey % 50 AS VARCHAR) AS series, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, count(*) AS times FROM orders GROUP BY 1, 2 HAVING count(*) > 1",
    "allowlist_diff": "SELECT n_name AS path, 'unexpected' AS problem FROM nation WHERE n_nationkey <= 2 UNION ALL SELECT 'extra.csv', 'unexpected' UNION ALL SELECT r_name || '.csv', 'missing' FROM region",
    "price_quality": f"WITH {PRICES} SELECT series, count(*) AS rows, count(*) - count(DISTINCT date) AS duplicate_dates, CAST(sum(CASE WHEN price <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS non_positive, round(count(price) / (SELECT count(DISTINCT date) FROM prices), 10) AS coverage, count(price) / (SELECT count(DISTINCT date) FROM prices) >= 0.97 AND min(price) > 0 AS passed FROM prices GROUP BY series",
    "xs_mean_dispersion": f"WITH {RETURNS} SELECT CAST(date AS VARCHAR) AS date, round(avg(r), 8) AS mean, round(stddev_samp(r), 8) AS dispersion FROM returns WHERE r IS NOT NULL GROUP BY date",
    "rolling_vol_elapsed": f"WITH {YEARS} SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN count(y) {W20} = 20 THEN sqrt(sum(pow(ln(1 + r), 2)) {W20} / sum(y) {W20}) END, 8) AS volatility FROM m",
    "rolling_vol_annualised": f"WITH {YEARS} SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN count(r) {W20} = 20 THEN stddev_samp(r) {W20} * sqrt(52) END, 8) AS volatility FROM m",
    "downside_semivol": f"""WITH {YEARS} SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN count(y) {W20} = 20 THEN sqrt(sum(pow(least(ln(1 + r), 0), 2)) {W20} / sum(y) {W20}) END, 8) AS elapsed,
      round(CASE WHEN count(r) {W20} = 20 THEN sqrt(avg(pow(least(ln(1 + r), 0), 2)) {W20} * 52) END, 8) AS annual FROM m""",
    "rolling_drawdown": f"""WITH {YEARS}, w AS (SELECT date, exp(sum(ln(1 + r)) OVER (ORDER BY date)) AS w FROM m) SELECT CAST(date AS VARCHAR) AS date, round(CASE WHEN count(w) {W20} = 20 THEN w / max(w) {W20} - 1 END, 8) AS drawdown FROM w""",
    "max_drawdown": f"""WITH {RETURNS}, w AS (SELECT series, date, exp(sum(ln(1 + r)) OVER (PARTITION BY series ORDER BY date)) AS w FROM returns WHERE r IS NOT NULL),
      p AS (SELECT series, 1 - w / greatest(1, max(w) OVER (PARTITION BY series ORDER BY date)) AS d FROM w) SELECT series, round(max(d), 8) AS max_drawdown FROM p GROUP BY series""",
    "derived_features": f"""WITH {RETURNS}, c AS (SELECT date, avg(r) AS mean, stddev_samp(r) AS disp FROM returns WHERE r IS NOT NULL GROUP BY date), w AS (SELECT *, exp(sum(ln(1 + mean)) OVER (ORDER BY date)) AS w FROM c)
      SELECT CAST(date AS VARCHAR) AS date, round(mean, 8) AS mean, round(CASE WHEN count(disp) OVER e = 8 THEN avg(disp) OVER e END, 8) AS mean_dispersion, round(CASE WHEN count(mean) OVER e = 8 THEN stddev_samp(mean) OVER e * sqrt(52) END, 8) AS vol,
      round(CASE WHEN count(w) OVER e = 8 THEN w / max(w) OVER e - 1 END, 8) AS drawdown FROM w WINDOW e AS (ORDER BY date ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)""",
    "forward_cumulative": f"""WITH {RETURNS}, f AS (SELECT date, series, count(r) OVER w AS n, product(1 + r) OVER w - 1 AS g FROM returns WINDOW w AS (PARTITION BY series ORDER BY date ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
      SELECT CAST(date AS VARCHAR) AS date, series, round(g, 8) AS g FROM f WHERE n = 4""",
    "origins": f"""WITH {POS}, f AS (SELECT date, pos, lead(date, 4) OVER (ORDER BY pos) AS e, (SELECT max(pos) FROM placed WHERE date <= '{TRAIN_END}') AS p0 FROM placed)
      SELECT CAST(date AS VARCHAR) AS origin_date, pos AS origin_pos, CAST(e AS VARCHAR) AS horizon_end FROM f WHERE pos >= p0 AND (pos - p0) % 20 = 0 AND e <= '{VALIDATION_END}'""",
    "eligible_origins": f"WITH {POS}, {ELIGIBLE.format(step=9)} SELECT origin_pos FROM o",
    "origin_split": f"""WITH {POS}, {ELIGIBLE.format(step=9)}, k AS (SELECT origin_pos, row_number() OVER (ORDER BY origin_pos) - 1 AS k, greatest(1, least(floor(count(*) OVER () * 0.3), count(*) OVER () - 1)) AS h FROM o)
      SELECT origin_pos, CASE WHEN k < h THEN 'tuning' ELSE 'evaluation' END AS part FROM k WHERE k < h OR ((k - h) % 2 = 0 AND (k - h) / 2 < 5)""",
    "window_boundaries": f"""WITH {POS}, {ELIGIBLE.format(step=9)} SELECT origin_pos, CAST(a.date AS VARCHAR) AS context_start_date, CAST(b.date AS VARCHAR) AS origin_date, CAST(c.date AS VARCHAR) AS target_start_date, CAST(e.date AS VARCHAR) AS target_end_date
      FROM o JOIN placed a ON a.pos = origin_pos - 19 JOIN placed b ON b.pos = origin_pos JOIN placed c ON c.pos = origin_pos + 1 JOIN placed e ON e.pos = origin_pos + 4""",
    "history_slice": f"WITH {POS}, {ELIGIBLE.format(step=40)} SELECT origin_pos, pos - origin_pos + 19 AS \"offset\", round(r, 8) AS r FROM o JOIN placed ON pos BETWEEN origin_pos - 19 AND origin_pos",
    "window_pairs": f"""WITH {RETURNS}, p AS (SELECT series, r, row_number() OVER (PARTITION BY series ORDER BY date) - 1 AS pos FROM returns WHERE r IS NOT NULL),
      s AS (SELECT series, pos, sum(r) OVER a AS x, count(*) OVER a AS n, sum(r) OVER b AS y, count(*) OVER b AS m FROM p WINDOW a AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), b AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING))
      SELECT series, pos, round(x, 8) AS past_sum, round(y, 8) AS future_sum FROM s WHERE n = 6 AND m = 2""",
    "ewma_variance": f"""WITH RECURSIVE {RETURNS}, x AS (SELECT series, date, ln(1 + r) AS x, row_number() OVER (PARTITION BY series ORDER BY date) AS k FROM returns WHERE r IS NOT NULL),
      v AS (SELECT series, 1::BIGINT AS k, greatest(var_samp(x), 1e-12) AS v FROM x GROUP BY series UNION ALL SELECT v.series, v.k + 1, 0.94 * v.v + 0.06 * x.x * x.x FROM v JOIN x ON x.series = v.series AND x.k = v.k)
      SELECT CAST(date AS VARCHAR) AS date, series, round(v, 8) AS variance, round(x / sqrt(v), 6) AS residual FROM x JOIN v USING (series, k)""",
    "pit_ranks": f"""WITH {RETURNS}, q AS (SELECT date, series, round(r, 1) AS r FROM returns WHERE r IS NOT NULL)
      SELECT CAST(date AS VARCHAR) AS date, series, round((rank() OVER (PARTITION BY series ORDER BY r) + (count(*) OVER (PARTITION BY series, r) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY series), 10) AS pit FROM q""",
    "pushed_scan": "SELECT o_orderstatus, count(*) AS n, CAST(CAST(max(o_orderdate) AS DATE) AS VARCHAR) AS last FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30' GROUP BY 1",
    "reindexed": f"WITH {DAYS}, {MACRO} SELECT CAST(days.date AS VARCHAR) AS date, round(value, 6) AS value FROM days LEFT JOIN macro USING (date)",
    "unpivoted": f"WITH {RETURNS}, k AS (SELECT DISTINCT date FROM returns), n AS (SELECT DISTINCT series FROM returns) SELECT CAST(k.date AS VARCHAR) AS date, n.series, round(r, 8) AS value FROM k CROSS JOIN n LEFT JOIN returns r ON r.date = k.date AND r.series = n.series",
    "keep_last": "SELECT o_custkey, o_orderkey, CAST(o_orderdate AS VARCHAR) AS date FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
}
