"""Reference properties of panels, windows, quality, risk, models, tails, decisions and the simulator on literal fixtures."""

import datetime as dt
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframes.functions import special
from riskframes.functions.scalars import chi2_1_tail, inverse_softplus, softplus
from riskframes.operators import comparison, counterfactual, diffusion, factors, features, generators, panel, portfolio, quality, risk, tail, windows
from riskframes.plans import runners
from riskframes.sources import readers, snapshots
from riskframes.streaming import conformal


def day(text):
    return dt.date.fromisoformat(text)


def business_days(first, last):
    d, out = day(first), []
    while d <= day(last):
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(1)
    return out


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_log_returns_and_transforms(spark):
    p = spark.createDataFrame([(day(f"2020-01-0{k + 1}"), "SPY", v) for k, v in enumerate((100.0, 101.0, 99.0))], "date date, series string, price double")
    got = [r["r"] for r in panel.log_returns(p).orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([math.log(1.01), math.log(99 / 101)])
    m = spark.createDataFrame([(day(f"2020-01-0{k + 1}"), "y", v) for k, v in enumerate((4.0, 4.25, 4.1))], "date date, series string, value double")
    got = [r["value"] for r in panel.macro_transform(m, "bps_difference").orderBy("date").collect()]
    assert got[0] is None and got[1:] == pytest.approx([25, -15])
    with pytest.raises(ValueError):
        panel.macro_transform(m, "cube")
    with pytest.raises(Exception, match="positive"):
        panel.log_returns(p.withColumn("price", F.lit(0.0))).collect()


def test_lagged_asof(spark):
    source = spark.createDataFrame([(day("2020-01-01"), 1.0), (day("2020-01-08"), 2.0)], "date date, value double")
    calendar = spark.createDataFrame([(d,) for d in business_days("2020-01-01", "2020-01-17")], "date date")
    got = {r["date"].isoformat(): r["value"] for r in panel.asof_align(calendar, source, 5, 14).collect()}
    assert got["2020-01-07"] is None and got["2020-01-08"] == 1.0 and got["2020-01-15"] == 2.0
    stale = {r["date"].isoformat(): r for r in panel.asof_align(calendar, source.limit(1), 0, 3).collect()}["2020-01-06"]
    assert stale["stale"] and stale["value"] is None and stale["source_date"] == day("2020-01-01")


def test_split_and_carry(spark):
    frame = spark.createDataFrame([(day("2017-12-27") + dt.timedelta(k), k) for k in range(10)], "date date, x int")
    parts = panel.chronological_split(frame, "2017-12-29", "2018-01-02")
    assert [parts[n].count() for n in ("train", "validation", "test")] == [3, 4, 3]
    with pytest.raises(ValueError):
        panel.chronological_split(frame, "2017-12-29", "2018-02-01")
    y = spark.createDataFrame([(day("2020-01-01"), "y", 5.0), (day("2020-01-02"), "y", 5.0)], "date date, series string, value double")
    assert panel.duration_convexity(y, F.lit(5.0)).orderBy("date").collect()[1]["r"] == pytest.approx(0.05 / 365.25)


def test_holiday_mismatch_and_audit(spark):
    r = spark.createDataFrame([(day(f"2020-01-0{k}"), "e", v) for k, v in ((1, 0.01), (2, 0.02), (3, -0.01))], "date date, series string, r double")
    ends = spark.createDataFrame([(day("2020-01-01"),), (day("2020-01-03"),)], "date date")
    assert [x["r"] for x in panel.compound_between(r, ends).collect()] == pytest.approx([1.02 * 0.99 - 1])
    s = spark.createDataFrame([("equity", day(f"2020-01-0{k}")) for k in (1, 2, 3)] + [("rates", day("2020-01-01")), ("rates", day("2020-01-03"))], "source string, date date")
    got = {x["source"]: (x["observations"], x["endpoint_present"], x["calendar_days"]) for x in panel.interval_audit(s, ends).collect()}
    assert got == {"equity": (2, True, 2.0), "rates": (1, True, 2.0)}


def test_features(spark):
    x = spark.createDataFrame([(day(f"2020-01-0{k + 1}"), s, v) for s, vs in (("a", (0.01, 0.02)), ("b", (0.03, -0.08))) for k, v in enumerate(vs)], "date date, series string, r double")
    out = features.derive(x, [{"name": "m", "operation": "cross_section_mean"}, {"name": "v", "operation": "volatility", "lookback": 2, "per_year": 252}]).orderBy("date").collect()
    assert out[0]["m"] == pytest.approx(0.02) and out[0]["v"] is None
    assert out[1]["v"] == pytest.approx(np.std([0.02, -0.03], ddof=1) * math.sqrt(252))
    one = spark.createDataFrame([(day("2020-01-01"), "m", 0.01, 1 / 365.25), (day("2020-01-04"), "m", 0.01, 3 / 365.25)], "date date, series string, r double, interval_years double")
    got = features.rolling_volatility(one, 2).orderBy("date").collect()[1]["volatility"]
    assert got == pytest.approx(math.sqrt(2 * math.log(1.01) ** 2 / (4 / 365.25)))


def test_quality(spark):
    cal = spark.createDataFrame([(d,) for d in business_days("2008-01-02", "2010-12-31")], "date date")
    hole = cal.filter("year(date) != 2009").select(F.lit("f").alias("feature"), "date", F.lit(1.0).alias("value"))
    got = quality.context_coverage(cal, hole).first()
    assert got["usable_share"] < 0.7 and got["max_gap_days"] > 360
    files = lambda *x: spark.createDataFrame([(f,) for f in x], "path string")
    assert sorted(rows(quality.allowlist(files("a", "vix"), files("a", "b")), "path", "problem")) == [("b", "missing"), ("vix", "unexpected")]
    passed = spark.createDataFrame([("x", True), ("y", False)], "gate string, passed boolean")
    with pytest.raises(quality.DataQualityError, match="y"):
        quality.require(passed)


def test_risk_measures(spark):
    losses = spark.createDataFrame([("f", float(k)) for k in range(1, 11)], "m string, loss double")
    got = risk.risk_summary(losses, 0.8, ["m"]).first()
    assert got["value_at_risk"] == 9.0 and got["expected_shortfall"] == pytest.approx(9.5)
    paths = spark.createDataFrame([("f", s, t, a, r) for s, t, a, r in ((0, 0, "x", 0.1), (0, 1, "x", -0.05), (0, 0, "y", 0.0), (0, 1, "y", 0.02))], "m string, scenario int, step int, asset string, r double")
    cum = risk.aggregate_paths(paths, ["m"])
    assert {r["asset"]: r["g"] for r in cum.collect()} == pytest.approx({"x": 0.045, "y": 0.02})
    w = spark.createDataFrame([("x", 0.5), ("y", 0.5)], "asset string, weight double")
    assert risk.portfolio_losses(cum, w, ["m"]).first()["loss"] == pytest.approx(-0.0325)
    hits = spark.createDataFrame([("f", k, k >= 95) for k in range(100)], "m string, origin_date int, hit boolean")
    assert risk.kupiec(hits, 0.95, ["m"]).first()["p_value"] > 0.99
    ten = spark.createDataFrame([("f", k, k in (3, 7)) for k in range(10)], "m string, origin_date int, hit boolean")
    ind, cc = risk.christoffersen(ten, ["m"]).first(), risk.conditional_coverage(ten, 0.95, ["m"]).first()
    assert ind["lr"] >= 0 and 0 <= ind["p_value"] <= 1 and cc["lr_cc"] >= cc["lr_uc"]
    bad = spark.createDataFrame([("f", 1.2, 0.0)], "m string, probability double, outcome double")
    with pytest.raises(Exception, match="probabilities"):
        risk.brier(bad, ["m"]).collect()


def test_scores_prefer_the_truth(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = spark.createDataFrame([("f", a, float(v)) for a, v in zip("abc", (0.0, 0.0, 0.0), strict=True)], "m string, asset string, g double")
    frame = lambda z: spark.createDataFrame([("f", s, a, float(z[s, k])) for s in range(60) for k, a in enumerate("abc")], "m string, scenario int, asset string, g double")
    assert risk.energy_score(frame(x), y, ["m"]).first()[1] < risk.energy_score(frame(x + 0.5), y, ["m"]).first()[1]
    assert risk.variogram_score(frame(x), y, ["m"]).first()[1] == pytest.approx(  # differences of assets: a common shift has no say
        risk.variogram_score(frame(x + 0.5), y, ["m"]).first()[1])


def test_bootstrap_and_joins(spark):
    d = spark.createDataFrame([("m", k, float(v)) for k, v in enumerate(np.linspace(-0.2, -0.1, 40))], "m string, pos int, d double")
    a, b = (comparison.block_bootstrap(d, ["m"], 500, 4, 0.95, 7).first() for _ in range(2))
    assert a.asDict() == pytest.approx(b.asDict()) and a["ci_upper"] < 0  # sums in another order
    with pytest.raises(ValueError):
        comparison.block_bootstrap(d, ["m"], 50, 4, 0.95, 7)
    left = spark.createDataFrame([(1, 2.0)], "k int, v double")
    with pytest.raises(Exception, match="one to one"):
        panel.exact_join(left, left.union(left), "k", ("_a", "_b")).collect()


def test_generators():
    r = np.random.default_rng(7).normal(0, 0.01, (250, 3))
    for kind in generators.KINDS:
        paths = generators.build({"kind": kind}).fit(r).sample(25, 20, np.random.default_rng(1))
        assert paths.shape == (25, 20, 3) and np.isfinite(paths).all() and (paths > -1).all()
    blocks = generators.MovingBlock(4).fit(np.arange(30.0).reshape(15, 2)).sample(5, 8, np.random.default_rng(1))
    assert (np.diff(blocks[:, :4, 0], axis=1) == 2).all()
    crash = np.array([[0.01, 0.0], [-0.9, 0.02], [0.02, -0.01], [0.0, 0.01]])
    for kind in ("gaussian", "student_t"):
        assert (generators.build({"kind": kind}).fit(crash).sample(50, 5, np.random.default_rng(1)) > -1).all()
    with pytest.raises(ValueError):
        generators.build({"kind": "other"})


def test_special_functions(spark):
    assert special.t_cdf(np.array([0.0, 1.0, -3.0]), 1.0) == pytest.approx(0.5 + np.arctan([0, 1, -3]) / np.pi)
    assert special.t_quantile(np.array([0.975]), 6)[0] == pytest.approx(2.446911848791681, rel=1e-8)
    x = spark.createDataFrame([(float(v),) for v in (0.0, 0.5, 3.841458820694124, 30.0)], "x double")
    got = [r[0] for r in x.select(chi2_1_tail(F.col("x"))).collect()]
    assert got == pytest.approx([1.0, math.erfc(0.5), 0.05, math.erfc(math.sqrt(15))], rel=1e-9)
    assert [r[0] for r in x.filter("x > 0").select(softplus(inverse_softplus(F.col("x")))).collect()] == pytest.approx([0.5, 3.841458820694124, 30.0])


def test_regimes(spark):
    rng = np.random.default_rng(3)
    z = np.zeros(500, int)
    for t in range(1, 500):
        z[t] = z[t - 1] if rng.random() < 0.95 else 1 - z[t - 1]
    x = np.array([[-1.2, -0.6], [1.1, 0.8]])[z] + rng.normal(0, 0.4, (500, 2))
    frame = spark.createDataFrame([("s", t, float(a), float(b)) for t, (a, b) in enumerate(x)], "series string, date int, f0 double, f1 double")
    model = factors.fit_regimes(frame, ["f0", "f1"], 2, 3, 11, iterations=60)
    _, filtered, smoothed, counts = factors.forward_backward(factors.log_density(x, model.means, model.covariances), model.start, model.transitions)
    assert filtered.sum(1) == pytest.approx(np.ones(500)) and (smoothed.argmax(1) == z).mean() > 0.9 and np.diag(model.transitions).mean() > 0.8
    got = np.array([r["pi"] for r in factors.filter_regimes(frame, ["f0", "f1"], model).orderBy("date").collect()])
    assert got == pytest.approx(filtered, abs=1e-9)
    prefix = np.array([r["pi"] for r in factors.filter_regimes(frame.filter("date < 50"), ["f0", "f1"], model).orderBy("date").collect()])
    assert prefix == pytest.approx(got[:50])
    explosive = 1.05 ** np.arange(60)[:, None]
    assert np.abs(factors.fit_regime_var(explosive, np.ones((60, 1)), radius=0.8).matrix).max() <= 0.8 + 1e-9
    mapping = factors.Mapping(np.array([[0.0, 1.0], [10.0, 20.0]]), np.zeros((2, 2, 1)), np.ones((2, 2)), np.array([np.eye(2)] * 2))
    assert (mapping.expected(np.zeros((1, 1, 1)), np.array([[1]])) == [10, 20]).all()


def test_factors_round_trip(spark):
    rng = np.random.default_rng(2)
    r = rng.normal(0, 0.02, (40, 3))
    frame = spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(r)], "date int, a double, b double, c double")
    model = factors.fit_factors(frame, ["a", "b", "c"], 3)
    back = model.restore(model.project(frame)).orderBy("date").collect()
    assert np.array([[x["fit__a"], x["fit__b"], x["fit__c"]] for x in back]) == pytest.approx(r, abs=1e-12)
    assert (model.loadings[np.abs(model.loadings).argmax(0), range(3)] > 0).all()
    with pytest.raises(ValueError):
        model.project(frame.select("date", "b", "a", "c"))


def test_tail(spark):
    rng = np.random.default_rng(1)
    losses = 0.02 / 0.15 * ((1 - rng.random(2000)) ** -0.15 - 1)
    m = tail.fit_pareto(losses)
    assert m.quantile(0.99) > m.threshold and m.shortfall(0.99) > m.quantile(0.99)
    few = np.linspace(-0.02, 0.08, 40)
    with pytest.raises(ValueError):
        tail.fit_pareto(few)
    assert tail.fit_pareto(few, sparse="empirical").method == "empirical"
    events = [(1, "issue", "t0", 1.0), (2, "issue", "t1", 2.0), (3, "observe", "t0", 2.5), (4, "issue", "t2", 1.0)]
    df = spark.createDataFrame([("s", *e) for e in events], "series string, seq long, kind string, forecast_id string, value double")
    assert sorted(rows(tail.conformal(df, 0.9, 10, 1), "forecast_id", "correction")) == [("t0", 0.0), ("t1", 0.0), ("t2", 1.5)]
    with pytest.raises(Exception, match="issue"):
        tail.conformal(df.withColumn("forecast_id", F.concat("kind", "forecast_id")), 0.9, 10, 1).collect()


def test_conformal_stream_is_the_batch(spark, tmp_path):
    events = [("s", k * 2, "issue", f"f{k}", float(k % 5)) for k in range(30)] + [("s", k * 2 + 7, "observe", f"f{k}", float(k % 5 + k % 3)) for k in range(25)]
    schema = "series string, seq long, kind string, forecast_id string, value double"
    df = spark.createDataFrame(events, schema)
    for part in range(3):
        df.filter(F.col("seq").between(part * 25, part * 25 + 24)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = conformal.conformal_stream(stream, 0.8, 6, 2).writeStream.format("memory").queryName("issued").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted(rows(spark.table("issued"), "forecast_id", "correction"))
    assert got == sorted(rows(tail.conformal(df, 0.8, 6, 2), "forecast_id", "correction"))


def test_portfolio(spark):
    rng = np.random.default_rng(0)
    r = rng.normal(0.001, 0.02, (120, 3))
    grid = [np.array([a, b, 1 - a - b]) for a in np.arange(0, 0.81, 0.02) for b in np.arange(0, 0.81, 0.02) if -1e-9 <= 1 - a - b <= 0.8]
    plain = portfolio.solve_cvar(r, 0.9, 0, 0.8)
    assert plain.cvar <= min(portfolio.decomposed(r, w, 0.9, None, 0, 0).cvar for w in grid) + 1e-9
    before = np.array([0.4, 0.4, 0.2])
    costly = portfolio.solve_cvar(r, 0.9, 0, 0.8, before, 0.3, 0.001, 0.01)
    best = min(portfolio.decomposed(r, w, 0.9, before, 0.001, 0.01).objective for w in grid if np.abs(w - before).sum() <= 0.3 + 1e-9)
    assert costly.objective <= best + 1e-7 and costly.turnover <= 0.3 + 1e-6 and costly.weights.sum() == pytest.approx(1)
    values = [portfolio.solve_cvar(r, 0.9, 0, 0.8, radius=x).objective for x in (0.0, 0.001, 0.01)]
    assert values == sorted(values) and values[0] == pytest.approx(plain.objective, abs=1e-7)
    with pytest.raises(ValueError):
        portfolio.solve_cvar(r, 0.9, 0, 0.2)
    one = spark.createDataFrame([("o", "a", 0.6, 0.5, 0.1, 0.01), ("o", "b", 0.4, 0.5, -0.1, 0.01)], "origin string, asset string, target double, previous double, g double, rate double")
    got = {x["asset"]: x for x in portfolio.realized(one, ["origin"]).collect()}
    assert got["a"]["turnover"] == pytest.approx(0.2) and got["a"]["cost"] == pytest.approx(0.002) and got["a"]["drifted"] == pytest.approx(0.66 / 1.02)


def test_historical_scenarios_see_no_future(spark):
    days = business_days("2020-01-01", "2020-01-16")
    base = [(k, days[k], a, 0.01 * (k + 1) * s) for k in range(12) for a, s in (("a", 1), ("b", -1))]
    frame = lambda x: spark.createDataFrame(x, "pos long, date date, asset string, r double")
    origin = spark.createDataFrame([(7,)], "origin_pos long")
    a = sorted(map(tuple, runners.historical_scenarios(frame(base), origin, 8, 3).collect()))
    b = sorted(map(tuple, runners.historical_scenarios(frame([(*x[:3], x[3] if x[0] <= 7 else 9.0) for x in base]), origin, 8, 3).collect()))
    assert a == b and len(a) == 12


def test_simulator(spark):
    model = counterfactual.Structure()
    exo = counterfactual.regimes(counterfactual.exogenous(spark, 30, 6, model, 5), model)
    seen = counterfactual.simulate(exo, model).join(exo.select("path", "z"), "path")
    back = counterfactual.abduct(seen, model).join(exo.select("path", F.col("e").alias("true")), "path").collect()
    assert max(abs(a[v] - b[v]) for r in back for a, b in zip(r["e"], r["true"], strict=True) for v in counterfactual.VARIABLES) < 2e-12
    with pytest.raises(ValueError):
        counterfactual.Intervention({}, {"equity": {0: 1.0}})
    zero = counterfactual.simulate(exo.withColumn("e", F.transform("e", lambda e: F.struct(*[F.lit(0.0).alias(v) for v in counterfactual.VARIABLES]))).withColumn("z", F.transform("z", lambda z: F.lit(0))), model, counterfactual.Intervention({}, {"yield": {0: 1.0}}))
    first = zero.first()["x"][0]
    assert first["yield"] == 1.0 and first["liquidity"] == pytest.approx(0.28) and first["credit"] == pytest.approx(0.22 + 0.44 * 0.28)


def test_denoiser_gradient():
    rng = np.random.default_rng(0)
    m = diffusion.Denoiser(2, 3, 2, 8, 2, 4, 1)
    inputs = (rng.normal(size=(5, 4, 2)), np.arange(5), rng.normal(size=(5, 6, 3)), rng.dirichlet([1, 1], 5))
    noise, weight = rng.normal(size=(5, 4, 2)), rng.random(5) + 0.5
    _, grad = m.loss(noise, weight, *inputs)
    for name, w in m.weights.items():
        at = tuple(rng.integers(n) for n in w.shape)
        old, values = w[at], []
        for step in (1e-6, -1e-6):
            w[at] = old + step
            values.append(m.loss(noise, weight, *inputs)[0])
        w[at] = old
        assert grad[name][at] == pytest.approx((values[0] - values[1]) / 2e-6, abs=1e-7, rel=1e-5)


def test_origins_and_windows(spark):
    days = spark.createDataFrame([(day("2020-01-01") + dt.timedelta(k),) for k in range(40)], "date date")
    got = windows.forecast_origins(days, "2020-01-10", "2020-01-30", 5, 5).orderBy("origin_pos").collect()
    assert [r["origin_pos"] for r in got] == [9, 14, 19, 24]
    assert [r[0] for r in windows.eligible_origins(spark, 2, 20, 5, 4, 4).collect()] == [4, 8, 12, 16]


def test_snapshots_and_provenance(spark, tmp_path):
    frame = spark.createDataFrame([(day("2020-01-01"), 1.0), (day("2020-01-02"), 2.0)], "date date, value double")
    path = tmp_path / "raw" / "s.csv"
    snapshots.write_snapshot(frame, path, "s", "p")
    read = lambda a="2020-01-01", b="2020-01-02": snapshots.read_snapshot(spark, path, "s", "p", ["value"], a, b)
    assert read("2020-01-02").count() == 1
    with pytest.raises(ValueError):
        snapshots.read_snapshot(spark, path, "other", "p", ["value"], "2020-01-01", "2020-01-02")
    files = snapshots.manifest(spark, tmp_path / "raw")
    assert [f["path"] for f in files] == ["s.csv", "s.meta.json"]
    snapshots.check_manifest({"files": files}, "s.csv", path)
    meta = json.loads(snapshots.meta_path(path).read_text())
    snapshots.write_json(snapshots.meta_path(path), meta | {"row_count": 3})
    with pytest.raises(ValueError, match="row count"):
        read()
    path.write_text(path.read_text().replace("2.0", "3.0"))
    with pytest.raises(ValueError, match="hash"):
        read()
    with pytest.raises(ValueError):
        snapshots.check_manifest({"files": files}, "s.csv", path)
    with pytest.raises(ValueError):
        snapshots.sealed("test")
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    (a / "x").write_text("old")
    with pytest.raises(RuntimeError), snapshots.published(a, b) as (x, y):
        (x / "x").write_text("new")
        raise RuntimeError
    assert (a / "x").read_text() == "old" and not b.exists()
    with snapshots.published(a, b) as (x, y):
        (x / "x").write_text("new")
    assert (a / "x").read_text() == "new" and b.exists()


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("DAY,v,w\n2020-01-01,1.5,\n2020-01-02,.,\n2020-01-03,2,x\n")
    got = readers.read_source("csv", spark, str(tmp_path / "c.csv"), "DAY", ["v", "w"], "2020-01-01", "2020-12-31")
    assert sorted(rows(got, "v", "w")) == [(1.5, None), (2.0, None)]
    with pytest.raises(ValueError):
        readers.read_csv(spark, str(tmp_path / "c.csv"), "DAY", ["nope"], "2020-01-01", "2020-12-31")
    (tmp_path / "y.xml").write_text('<feed><entry><content><m:properties><d:NEW_DATE m:type="x">2020-01-02T00:00:00</d:NEW_DATE><d:BC_10YEAR>1.88</d:BC_10YEAR></m:properties></content></entry></feed>')
    assert rows(readers.read_yield_xml(spark, [str(tmp_path / "y.xml")], ["BC_10YEAR"], "2020-01-01", "2020-12-31"), "BC_10YEAR") == [(1.88,)]
    (tmp_path / "r.json").write_text('{"refRates": [{"effectiveDate": "2020-01-03", "percentRate": 1.55}]}')
    assert rows(readers.read_rates_json(spark, str(tmp_path / "r.json"), "rate", "2020-01-01", "2020-12-31"), "rate") == [(1.55,)]
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("i.CSV", "intro\n\nValue Weighted\n,Food , Oil\n20200101, 1.0,-99.99\n20200102,-2.5, 0.5\nEqual Weighted\n,Food\n20200101,9\n")
    got = readers.read_sectioned_zip(spark, str(tmp_path / "z.zip"), "value weighted", ["Food", "Oil"], "2020-01-01", "2020-12-31")
    assert sorted(rows(got, "Food", "Oil")) == [(-0.025, 0.005), (0.01, None)]
    with pytest.raises(ValueError):
        readers.read_source("other")
    spark.createDataFrame([(day("2019-12-27"), 0.01), (day("2020-01-02"), 999.0)], "date date, asset__a double").write.parquet(str(tmp_path / "m"))
    sealed = readers.read_matrix(spark, str(tmp_path / "m"), "2019-12-31")
    assert rows(sealed, "asset__a") == [(0.01,)]
    assert "PushedFilters: [IsNotNull(date), LessThanOrEqual(date,2019-12-31)]" in sealed._jdf.queryExecution().toString()
