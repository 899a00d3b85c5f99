"""Panels: transforms on native rows, alignment of calendars, and as-of joins with availability lags.

Long form is (date, series, value); wide form has a column a series. Windows run within a series, so series are the unit of
parallel work; cross-sections are grouped by date.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import checked

TRANSFORMS = ("level", "difference", "bps_difference", "log_difference", "pct_change")


def by_date(series: str = "series") -> Window:
    return Window.partitionBy(series).orderBy("date")


def log_returns(prices: DataFrame) -> DataFrame:
    """(date, series, r): log price differences; a price that isn't positive is an error."""
    log = checked((F.col("price") > 0) | F.col("price").isNull(), F.log("price"), "prices must be positive")
    return prices.withColumn("_l", log).select("date", "series", (F.col("_l") - F.lag("_l").over(by_date())).alias("r"))


def simple_returns(prices: DataFrame) -> DataFrame:
    return prices.select("date", "series", "price", (F.col("price") / F.lag("price").over(by_date()) - 1).alias("r"))


def macro_transform(values: DataFrame, transform: str, value: str = "value") -> DataFrame:
    """``values`` with the transformed column in place; changes are from the previous row, filled or not."""
    if transform not in TRANSFORMS:
        raise ValueError(f"unknown transform {transform}")
    x = F.col(value).cast("double")
    before = F.lag(x).over(by_date())
    if transform == "log_difference":
        x = checked((x > 0) | x.isNull(), F.log(x), "log differences need positive values")
        out = x - F.lag(x).over(by_date())
    else:
        out = {"level": x, "difference": x - before, "bps_difference": (x - before) * 100, "pct_change": F.try_divide(x, before) - 1}[transform]
    return values.withColumn(value, out)


def duration_convexity(yields: DataFrame, maturity: Column, value: str = "value") -> DataFrame:
    """(date, series, r): carry, duration and convexity of a par yield in percent over the elapsed days; first null."""
    w = by_date()
    y = F.col(value) / 100
    last = F.lag(y).over(w)
    years = F.datediff("date", F.lag("date").over(w)) / 365.25
    duration, convexity = maturity / (1 + last), maturity * (maturity + 1) / ((1 + last) * (1 + last))
    move = y - last
    return yields.select("date", "series", (last * years - duration * move + 0.5 * convexity * move * move).alias("r"))


def subtract(frame: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """A derived column: left minus right."""
    return frame.withColumn(name, F.col(left) - F.col(right))


def wide(long: DataFrame, series: list[str], value: str = "r", prefix: str = "asset__") -> DataFrame:
    """One column a series, in the order given, missing cells null."""
    out = long.groupBy("date").pivot("series", series).agg(F.first(value))
    return out.select("date", *[F.col(s).alias(prefix + s) for s in series])


def long(frame: DataFrame, prefix: str, value: str = "value") -> DataFrame:
    """Columns with a prefix as (date, series, value)."""
    columns = [c for c in frame.columns if c.startswith(prefix)]
    out = frame.unpivot(["date"], columns, "series", value)
    return out.withColumn("series", F.substring("series", len(prefix) + 1, 1_000_000))


def inner_panel(frames: list[DataFrame]) -> DataFrame:
    """Frames joined on the dates that all of them have."""
    return reduce(lambda a, b: a.join(b, "date"), frames)


def reindex(frame: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows for exactly the keys' dates; others are null."""
    return keys.select("date").join(frame, "date", "left")


def common_dates(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.intersect(b), [f.select("date") for f in frames])


def compound_between(returns: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(date, series, r): simple returns compounded over (previous endpoint, endpoint], from the second endpoint on.

    Each return is dealt to the next endpoint by one ordered pass a series over the union of both (no range join); an endpoint without the
    series' own row on that day still closes its interval. A null return within an interval makes it null.
    """
    ends = returns.select("series").distinct().crossJoin(F.broadcast(endpoints.select("date").distinct()))  # series x endpoints: the size of the result
    marks = ends.select("date", "series", F.lit(None).cast("double").alias("r"), F.lit(1).alias("is_end"))
    rows = returns.select("date", "series", "r", F.lit(0).alias("is_end"))
    ahead = Window.partitionBy("series").orderBy("date", "is_end").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    dealt = rows.unionByName(marks).withColumn("end", F.first(F.when(F.col("is_end") == 1, F.col("date")), ignorenulls=True).over(ahead))
    growth = F.when(F.count(F.when((F.col("is_end") == 0) & F.col("r").isNull(), 1)) > 0, F.lit(None)).otherwise(F.expm1(F.coalesce(F.sum(F.when(F.col("is_end") == 0, F.log1p("r"))), F.lit(0.0))))
    closed = dealt.filter("end is not null").groupBy("series", F.col("end").alias("date")).agg(growth.alias("r"))
    first = closed.withColumn("_k", F.row_number().over(by_date()))
    return first.filter("_k > 1").select("date", "series", "r")


def interval_audit(sources: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(date, start, calendar_days, source, observations, endpoint_present) of each interval and source of rows (source, date)."""
    ends = endpoints.select(F.col("date").alias("end")).distinct()
    spans = ends.withColumn("start", F.lag("end").over(Window.orderBy("end")))  # one row an endpoint
    marks = sources.select("source").distinct().crossJoin(F.broadcast(ends)).select("source", F.col("end").alias("date"), F.lit(1).alias("is_end"))
    ahead = Window.partitionBy("source").orderBy("date", "is_end").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = sources.select("source", "date", F.lit(0).alias("is_end")).unionByName(marks)
    dealt = rows.withColumn("end", F.first(F.when(F.col("is_end") == 1, F.col("date")), ignorenulls=True).over(ahead)).filter("end is not null")
    counts = dealt.groupBy("end", "source").agg(F.sum(1 - F.col("is_end")).alias("observations"), F.max((F.col("is_end") == 0) & (F.col("date") == F.col("end"))).alias("endpoint_present"))
    out = counts.join(spans, "end").filter("start is not null")
    return out.select(F.col("end").alias("date"), "start", F.datediff("end", "start").cast("double").alias("calendar_days"), "source", "observations", "endpoint_present")


def asof_align(calendar: DataFrame, source: DataFrame, lag_sessions: int, max_stale_days: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., date, value, source_date, available_date, stale) for each calendar date, for each key of ``by`` in ``source``.

    A source row becomes known ``lag_sessions`` sessions after the first session on or after its date. Of the rows that become known on one
    session the latest source date counts. As that session is a date of the calendar, the as-of join is an equi-join with the days of the calendar's
    span (one row a day, sent to all tasks) and a forward fill of each key's own sessions. A value whose source is older than ``max_stale_days`` is
    nulled and flagged; its lineage stays.
    """
    w = Window.orderBy("date")  # one row a session
    sessions = calendar.select("date").distinct().withColumn("pos", F.row_number().over(w)).withColumn("before", F.lag("date").over(w))
    days = sessions.select(F.explode(F.sequence(F.coalesce(F.date_add("before", 1), F.col("date")), F.col("date"))).alias("day"), F.col("pos").alias("base"))
    first = sessions.agg(F.min("date").alias("first"))
    clean = source.filter(F.col("date").isNotNull() & F.col("value").isNotNull()).select(*by, F.col("date").alias("source_date"), "value")
    placed = clean.crossJoin(F.broadcast(first)).join(F.broadcast(days), F.col("source_date") == F.col("day"), "left")
    base = F.when(F.col("source_date") <= F.col("first"), F.lit(1)).otherwise(F.col("base"))
    due = placed.withColumn("pos", base + lag_sessions).filter("pos is not null").groupBy(*by, "pos").agg(F.max(F.struct("source_date", "value")).alias("v"))
    grid = sessions.select("date", "pos")
    if by:
        grid = source.select(*by).distinct().crossJoin(F.broadcast(grid))
    known = grid.join(due, [*by, "pos"], "left")
    known = known.withColumn("v", F.when(F.col("v").isNotNull(), F.struct(F.col("v.source_date").alias("source_date"), F.col("v.value").alias("value"), F.col("date").alias("available_date"))))
    filled = known.withColumn("v", F.last("v", ignorenulls=True).over(Window.partitionBy(*by).orderBy("pos")))
    stale = F.col("v").isNotNull() & (F.datediff("date", F.col("v.source_date")) > max_stale_days)
    return filled.select(*by, "date", F.when(~stale, F.col("v.value")).alias("value"), F.col("v.source_date").alias("source_date"), F.col("v.available_date").alias("available_date"), stale.alias("stale"))


def complete_cases(frame: DataFrame, targets: list[str], context: list[str]) -> DataFrame:
    return frame.na.drop("any", subset=targets).na.drop("any", subset=context) if context else frame.na.drop("any", subset=targets)


def split_of(date: Column, train_end: str, validation_end: str) -> Column:
    return F.when(date <= F.lit(train_end).cast("date"), "train").when(date <= F.lit(validation_end).cast("date"), "validation").otherwise("test")


def chronological_split(frame: DataFrame, train_end: str, validation_end: str) -> dict[str, DataFrame]:
    """The three parts; an empty part, or parts out of order, are an error."""
    marked = frame.withColumn("_split", split_of(F.col("date"), train_end, validation_end))
    spans = {r["_split"]: r for r in marked.groupBy("_split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    names = ("train", "validation", "test")
    if set(spans) != set(names):
        raise ValueError("every split needs rows")
    if not all(spans[x]["b"] < spans[y]["a"] for x, y in zip(names, names[1:], strict=False)):
        raise ValueError("splits overlap")
    return {n: marked.filter(F.col("_split") == n).drop("_split") for n in names}


def exact_join(left: DataFrame, right: DataFrame, key: str, suffixes: tuple[str, str]) -> DataFrame:
    """One-to-one join; duplicate keys or keys of one side only are an error. Other columns get the suffixes."""
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in left.columns if c != key}).withColumn("_a", F.lit(1))
    b = right.withColumnsRenamed({c: c + suffixes[1] for c in right.columns if c != key}).withColumn("_b", F.lit(1))
    joined = a.join(b, key, "full").withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    fine = (F.col("_n") == 1) & F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return joined.withColumn("_ok", checked(fine, F.lit(1.0), "keys must match one to one")).filter("_ok = 1").drop("_a", "_b", "_n", "_ok")
