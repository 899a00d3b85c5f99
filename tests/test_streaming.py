"""Streams in several micro-batches give what the batch forms give."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskframes.operators import panel, quality
from riskframes.streaming import conformal, monitors


def streamed(spark, tmp_path, df, order, parts, build, name):
    """The stream's output over ``parts`` files in order."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    step = (high - low) / parts
    for k in range(parts):
        a, b = low + step * k, low + step * (k + 1) if k < parts - 1 else high
        part = df.filter((F.col(order) >= F.lit(a)) & ((F.col(order) < F.lit(b)) if k < parts - 1 else F.lit(True)))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_asof(spark, tmp_path):
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(40)]
    sessions = spark.createDataFrame([(d,) for d in days if d.weekday() < 5], "date date")
    source = spark.createDataFrame([(d, float(k)) for k, d in enumerate(days) if k % 6 == 0 and not 12 < k < 25], "date date, value double")
    both = sessions.select(F.lit("s").alias("series"), "date", F.lit("session").alias("kind"), F.lit(None).cast("double").alias("value"))
    both = both.unionByName(source.select(F.lit("s").alias("series"), "date", F.lit("source").alias("kind"), "value"))
    got = streamed(spark, tmp_path, both, "date", 1, lambda s: monitors.asof_stream(s, 2, 7), "asof")
    want = {str(r["date"]): (r["value"], str(r["source_date"]) if r["source_date"] else None, r["stale"]) for r in panel.asof_align(sessions, source, 2, 7).collect()}
    assert {r["date"]: (r["value"], r["source_date"], r["stale"]) for r in got} == want


def test_freshness(spark, tmp_path):
    rows = [("a", "2020-01-01", "seen"), ("a", "2020-03-01", "check"), ("b", "2020-01-01", "check"), ("a", "2020-08-01", "check")]
    df = spark.createDataFrame(rows, "source string, date string, kind string").withColumn("n", F.lit(1))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = monitors.freshness_stream(stream, 45, 180).writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["source"], r["date"]): (r["age_days"], r["status"]) for r in spark.table("fresh").collect()}
    assert got == {("a", "2020-03-01"): (60, "warn"), ("a", "2020-08-01"): (213, "fail"), ("b", "2020-01-01"): (None, "fail")}
    seen = spark.createDataFrame([("a", dt.date(2020, 1, 1))], "source string, date date")
    assert quality.freshness(seen, "2020-03-01", 45, 180).first()["status"] == "warn"


def test_holdings_and_ewma(spark, tmp_path):
    blocks = spark.createDataFrame([("e", k, [0.5, 0.5], [0.1, -0.1]) for k in range(4)] + [("x", 0, [0.5, 0.4], [0.0, 0.0]), ("x", 1, [0.5, 0.5], [0.0, 0.0])], "strategy string, seq long, target array<double>, returns array<double>")
    got = sorted(streamed(spark, tmp_path / "h", blocks, "seq", 2, lambda s: monitors.holdings_stream(s, 0.01), "held"))
    assert [r["strategy"] for r in got] == ["e"] * 4
    assert got[0]["turnover"] == 0 and got[1]["turnover"] == pytest.approx(0.1) and got[1]["net"] == pytest.approx(-0.001)
    r = spark.createDataFrame([("s", k, 0.01 * k) for k in range(6)], "series string, seq long, r double")
    got = sorted(streamed(spark, tmp_path / "v", r, "seq", 3, lambda s: conformal.ewma_stream(s, 0.9, 0.04), "var"))
    assert got[0]["variance"] == 0.04 and got[1]["variance"] == pytest.approx(0.036) and len(got) == 6
