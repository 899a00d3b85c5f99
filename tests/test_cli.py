"""All runners from configuration to receipt, on a small offline project."""

import datetime as dt
import random

import pytest

from riskframes.operators.quality import DataQualityError
from riskframes.plans import cli
from riskframes.sources import readers, snapshots


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root, r = tmp_path_factory.mktemp("project"), random.Random(2)
    (root / "raw").mkdir()
    days = [d for k in range(700) if (d := dt.date(2009, 1, 1) + dt.timedelta(k)).weekday() < 5]
    (root / "raw/a.csv").write_text("date,x,y\n" + "".join(f"{d},{r.gauss(0, 0.01):.6f},{r.gauss(0, 0.02):.6f}\n" for d in days))
    (root / "raw/b.csv").write_text("date,z\n" + "".join(f"{d},{r.gauss(0, 0.015):.6f}\n" for d in days if d.day != 17))
    for name in ("m", "k", "c"):
        (root / f"raw/{name}.csv").write_text("date,v\n" + "".join(f"{d},{2 + r.random():.4f}\n" for d in days))
    return root


LIMITS = {"asset_coverage": 0.97, "gap_days": 10, "delay_days": 10, "density": 0.9, "context_coverage": 0.97, "model_density": 0.9, "count_gap": 5}
SPLITS = {"train_end": "2010-03-31", "validation_end": "2010-08-31", "horizon": 5, "stride": 10}
PANEL = SPLITS | {
    "output": "panel", "raw": "raw", "start": "2009-01-01", "end": "2010-12-31", "limits": LIMITS,
    "targets": [{"path": "raw/a.csv", "columns": ["x", "y"]}, {"path": "raw/b.csv", "columns": ["z"]}],
    "contexts": [
        {"name": "m", "path": "raw/m.csv", "columns": ["v"], "transform": "bps_difference", "lag_sessions": 1, "stale_days": 6},
        {"name": "k", "path": "raw/k.csv", "columns": ["v"], "transform": "level", "lag_sessions": 1, "stale_days": 6},
        {"name": "c", "path": "raw/c.csv", "columns": ["v"], "lag_sessions": 2, "stale_days": 6, "role": "validation"},
    ],
    "derived": [{"name": "m_less_k", "left": "m", "right": "k"}],
    "features": [{"name": "vol", "operation": "volatility", "lookback": 10, "per_year": 252}],
}


def test_runners(spark, project):
    run = lambda name, **config: cli.execute(spark, name, config, project)
    assert run("panel", **PANEL)["status"] in ("passed", "passed_with_warnings")
    made = {f.name for f in (project / "panel").iterdir()}
    assert made >= {"matrix", "targets", "returns", "context", "lineage", "intervals", "calendars", "coverage", "freshness", "flags", "splits", "report.md"}
    matrix = spark.read.parquet(str(project / "panel/matrix"))
    assert [c for c in matrix.columns if c.startswith("macro__")] == ["macro__m", "macro__k", "macro__m_less_k", "macro__vol"]
    assert matrix.filter("abs(macro__m - macro__k - macro__m_less_k) > 1e-12").isEmpty()
    assert spark.read.parquet(str(project / "panel/coverage")).groupBy("role").count().count() == 2
    assert "23 of 23 gates passed" in (project / "panel/report.md").read_text()
    base = SPLITS | {"panel": "panel", "seed": 3}
    models = [{"model_id": "h", "kind": "historical"}, {"model_id": "n", "kind": "gaussian"}]
    found = run("baselines", output="base", lookback=60, scenarios=40, models=models, confidence=0.9, co_crash_fraction=0.4, **base)
    assert found["status"] == "passed" and {f["path"].split("/")[0] for f in found["files"]} == {"detail", "summary", "failures"}
    run("comparison", output="cmp", baselines="base", model="h", metrics=["energy_score", "joint_score"], replications=100, block=2, level=0.9, seed=1)
    assert spark.read.parquet(str(project / "cmp/intervals")).count() == 2
    assert run("switching", output="sw", factors=2, states=2, restarts=2, scenarios=30, iterations=30, **base)["iterations"] > 1
    origins = spark.read.parquet(str(project / "base/detail")).select("origin_pos").distinct().count()
    assert spark.read.parquet(str(project / "sw/detail")).count() == origins
    dates = [str(x[0]) for x in spark.read.parquet(str(project / "sw/archive")).select("origin_date").distinct().collect()]
    assert readers.read_archive(spark, str(project / "sw/archive"), ["x", "y", "z"], dates).count() == 30 * origins
    run("comparison", output="cmp2", baselines=["base", "sw"], model="switching_factor", metrics=["energy_score"], replications=100, block=2, level=0.9, seed=1)
    assert spark.read.parquet(str(project / "cmp2/intervals")).count() == 2
    run("decisions", output="dec", scenarios="sw", lookback=60, confidence=0.9, radii=[0.001], turnover_cap=None, cost=0.001, upper=0.8, **base)
    assert spark.read.parquet(str(project / "dec/summary")).count() == 4
    run("diffusion", output="ddpm", length=12, channels=8, blocks=1, steps=6, epochs=2, scenarios=20, **base)
    drawn = spark.read.parquet(str(project / "ddpm/scenarios"))
    assert drawn.count() == 20 * 3 * origins and drawn.filter("g <= -1 or isnan(g)").isEmpty()
    assert spark.read.parquet(str(project / "ddpm/detail")).count() == origins
    kept = readers.read_arrays(spark, str(project / "ddpm/checkpoint"))
    assert {"gru_x", "out", "out_b"} <= set(kept) and readers.read_arrays(spark, str(project / "ddpm/standardizer"), ["mean", "scale", "n_fit_rows"])["mean"].shape == (2,)
    run("counterfactual", output="cf", paths=20, horizon=4, seed=1, outcomes=["equity"], treated_steps=2)
    assert spark.read.parquet(str(project / "cf/effects")).count() == 8
    file = next((project / "panel/matrix").glob("part-*.parquet"))
    file.write_bytes(file.read_bytes() + b"x")
    with pytest.raises(ValueError):
        run("baselines", output="again", lookback=60, scenarios=40, models=models, confidence=0.9, co_crash_fraction=0.4, **base)
    assert not (project / "again").exists()


def test_gates_stop_publication(spark, project):
    (project / "raw/extra.csv").write_text("date,q\n")
    with pytest.raises(DataQualityError, match="allowlist"):
        cli.execute(spark, "panel", PANEL | {"output": "other"}, project)
    assert not (project / "other").exists() and (project / "quality_failure.json").exists()
    (project / "raw/extra.csv").unlink()
    with pytest.raises(ValueError, match="sealed"):
        cli.execute(spark, "baselines", {"output": "x", "split": "test"}, project)
    assert snapshots.load_yaml
