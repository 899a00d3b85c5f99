"""Catalog loading, the snapshot data source, table functions, archives, and checks of pairing and specifications."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from riskframes.functions import tables
from riskframes.operators import comparison, factors, panel, portfolio
from riskframes.operators import counterfactual as cf
from riskframes.plans import runners
from riskframes.sources import catalog, readers, snapshots


@pytest.fixture
def raw(tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.csv").write_text("day,x\n2020-01-01,1.5\n2020-01-02,oops\n2020-01-03,2\n")
    return tmp_path


SOURCES = [{"id": "a", "role": "macro", "provider": "csv", "columns": ["x"], "arguments": ["day"]}, {"id": "d", "role": "macro", "provider": "derived", "columns": ["y"]}]


def test_catalog_reuses_refreshes_and_requires(spark, raw):
    load = lambda **o: catalog.load_catalog(spark, SOURCES, raw / "snap", "2020-01-01", "2020-12-31", **o)
    with pytest.raises(FileNotFoundError):
        load()
    fetched = []
    fetch = lambda s: (fetched.append(s["id"]), str(raw / "raw/a.csv"))[1]
    assert set(load(fetch=fetch)) == {"a"} and fetched == ["a"]
    assert [r["x"] for r in load()["a"].orderBy("date").collect()] == [1.5, 2.0]
    load(fetch=fetch)
    assert fetched == ["a"]
    load(fetch=fetch, refresh=True)
    assert fetched == ["a", "a"]
    with pytest.raises(FileNotFoundError):
        load(refresh=True)
    with pytest.raises(ValueError, match="unknown"):
        catalog.route("returns", "rates_json")
    with pytest.raises(ValueError, match="repeat"):
        catalog.load_catalog(spark, [SOURCES[0], SOURCES[0]], raw, "2020-01-01", "2020-12-31")


def test_snapshot_data_source(spark, raw):
    catalog.load_catalog(spark, SOURCES, raw / "snap", "2020-01-01", "2020-12-31", fetch=lambda s: str(raw / "raw/a.csv"))
    spark.dataSource.register(catalog.SnapshotSource)
    rows = spark.read.format("snapshots").load(str(raw / "snap"))
    assert sorted(tuple(r) for r in rows.collect()) == [("a", "2020-01-01", "x", 1.5), ("a", "2020-01-03", "x", 2.0)]
    with open(raw / "snap/a.csv", "a") as file:
        file.write("2020-01-09,9\n")
    with pytest.raises(PySparkException):
        rows.collect()


def test_a_stopped_snapshot_keeps_the_old_one(spark, tmp_path, monkeypatch):
    frame = lambda v: spark.createDataFrame([("2020-01-01", v), ("2020-01-02", v)], "date string, x double").withColumn("date", F.to_date("date"))
    path = tmp_path / "a.csv"
    read = lambda: [r["x"] for r in snapshots.read_snapshot(spark, path, "a", "csv", ["x"], "2020-01-01", "2020-01-02").collect()]
    span = {"requested_start": "2020-01-01", "requested_end": "2020-01-02"}
    snapshots.write_snapshot(frame(1.0), path, "a", "csv", **span)
    assert read() == [1.0, 1.0]
    replace, done = snapshots.os.replace, []

    def stop(a, b):
        if str(b) == str(path):
            raise OSError("stopped")
        done.append(b)
        return replace(a, b)

    monkeypatch.setattr(snapshots.os, "replace", stop)
    with pytest.raises(OSError, match="stopped"):
        snapshots.write_snapshot(frame(2.0), path, "a", "csv", **span)
    monkeypatch.undo()
    assert read() == [1.0, 1.0]
    snapshots.write_snapshot(frame(3.0), path, "a", "csv", **span)
    assert read() == [3.0, 3.0] and "previous" not in snapshots.json.loads(snapshots.meta_path(path).read_text())


def test_table_functions(spark):
    tables.register(spark)
    assert spark.sql("select count(*) as n, max(step) as s from scenario_grid(5, 4)").first() == (20, 3)
    got = spark.sql("select o.id, g.scenario, g.step from range(2) o, lateral scenario_grid(2, 1) g").count()
    assert got == 4
    rows = spark.sql("select * from circular_blocks(array(array(3, 0), array(1, 2)), 4, 2)").collect()
    assert [r["pos"] for r in rows if r["draw"] == 0] == [3, 0, 0, 1] and [r["pos"] for r in rows if r["draw"] == 1] == [1, 2, 2, 3]


def test_archives(spark, tmp_path):
    rows = spark.createDataFrame([("2020-01-01", s, a, 0.1 * s) for s in range(3) for a in "xy"], "origin_date string, scenario int, asset string, g double")
    readers.write_archive(rows, str(tmp_path / "a"), ["y", "x"])
    assert readers.read_archive(spark, str(tmp_path / "a"), ["y", "x"], ["2020-01-01"]).count() == 3
    with pytest.raises(PySparkException):
        readers.write_archive(rows.filter("not (scenario = 1 and asset = 'x')"), str(tmp_path / "b"), ["x", "y"])
    arrays = {"w": np.arange(6.0).reshape(2, 3), "b": np.zeros(0)}
    readers.write_arrays(spark, arrays, str(tmp_path / "m"))
    back = readers.read_arrays(spark, str(tmp_path / "m"), ["w", "b"])
    assert (back["w"] == arrays["w"]).all() and back["b"].shape == (0,)
    with pytest.raises(ValueError):
        readers.read_arrays(spark, str(tmp_path / "m"), ["w"])


def test_comparison_needs_the_same_origins(spark):
    rows = [("m", k, 0.1 * k) for k in range(12)] + [("b", k, 0.2 * k) for k in range(12)]
    df = lambda rows: spark.createDataFrame(rows, "model_id string, origin_pos long, energy_score double")
    run = lambda rows: runners.paired_comparison(df(rows), "m", ["energy_score"], 100, 2, 0.9, 1).collect()
    assert run(rows)[0]["mean_difference"] == pytest.approx(-0.55)
    for bad in (rows[1:], rows[:-1], [*rows, rows[0]]):
        with pytest.raises(PySparkException, match="one to one"):
            run(bad)
    assert comparison.block_bootstrap


def test_asof_by_feature(spark):
    days = [f"2020-01-{k:02d}" for k in (6, 7, 8, 9, 10, 13)]
    calendar = spark.createDataFrame([(d,) for d in days], "date string").select(F.to_date("date").alias("date"))
    rows = [("u", "2020-01-05", 1.0), ("u", "2020-01-09", 2.0), ("v", "2020-01-11", 7.0), ("v", "2020-01-20", 9.0), ("u", "2020-01-07", None)]
    source = spark.createDataFrame(rows, "feature string, date string, value double").withColumn("date", F.to_date("date"))
    both = panel.asof_align(calendar, source, 1, 30, by=("feature",))
    got = {(r["feature"], str(r["date"])): r["value"] for r in both.collect()}
    assert [got["u", d] for d in days] == [None, 1.0, 1.0, 1.0, 2.0, 2.0] and [got["v", d] for d in days] == [None] * 6
    for f in "uv":
        alone = panel.asof_align(calendar, source.filter(F.col("feature") == f).drop("feature"), 1, 30)
        assert {str(r["date"]): r["value"] for r in alone.collect()} == {d: got[f, d] for d in days}


def test_pairing_checks_regimes(spark):
    model = cf.Structure()
    exo = cf.regimes(cf.exogenous(spark, 4, 3, model, 1), model)
    long = cf.long_paths(cf.simulate(exo, model, None))
    z = exo.select("path", "z")
    assert cf.paired(long, long, (z, z), (model, model)).count() == 4 * 3 * 6
    with pytest.raises(PySparkException, match="regimes"):
        cf.paired(long, long, (z, z.withColumn("z", F.transform("z", lambda x: 2 - x))), (model, model)).collect()
    from dataclasses import replace

    with pytest.raises(ValueError, match="different states"):
        cf.paired(long, long, (z, z), (model, replace(model, initial={**model.initial, "equity": 1.0})))


def test_specification_has_no_defaults():
    full = {"factors": 2, "states": 2, "restarts": 1, "iterations": 5, "tolerance": 1e-6, "pseudo": 0.5, "sticky": 8.0, "seed": 1}
    assert factors.SwitchingSpec.of(full).states == 2
    with pytest.raises(ValueError, match="missing: \\['seed'\\]"):
        factors.SwitchingSpec.of({k: v for k, v in full.items() if k != "seed"})
    with pytest.raises(ValueError, match="unknown: \\['x'\\]"):
        factors.SwitchingSpec.of(full | {"x": 1})


def test_cvar_program_is_no_worse_than_any_neighbour(spark):
    """The solved weights against a grid of all weights in steps of 0.1, with bounds, costs and a radius."""
    r = np.random.default_rng(2)
    g = r.normal(0.01, 0.05, (60, 3)) + np.array([0.0, 0.005, -0.003])
    for radius in (0.0, 0.02):
        found = portfolio.solve_cvar(g, 0.9, upper=0.7, previous=np.full(3, 1 / 3), cost=0.001, radius=radius)
        for a in range(8):
            for b in range(8):
                w = np.array([a, b, 10 - a - b]) / 10
                if 0 <= w[2] <= 0.7 + 1e-9:
                    assert found.objective <= portfolio.decomposed(g, w, 0.9, np.full(3, 1 / 3), 0.001, radius).objective + 1e-6
