"""Command line of the registered evaluations: ``python -m riskframes.plans.cli RUNNER --config FILE --root FOLDER``.

A configuration is a YAML mapping. Inputs and outputs are Parquet below the root; each run publishes its folder at once, with a receipt that names
status, parameters, files and their hashes, and later runs refuse inputs whose receipt doesn't hold. Only the validation split is evaluated.
"""

from __future__ import annotations

import argparse
import json
import time
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparison, diffusion, factors, panel, quality, scenarios, tail, windows
from ..sources import readers, snapshots
from . import runners


def _matrix(spark: SparkSession, config: dict, root: Path) -> DataFrame:
    """Panel rows up to the end of validation, after the receipt of the panel run has been checked."""
    folder = root / config["panel"]
    receipt = json.loads((folder / "receipt.json").read_text())
    if receipt["status"] not in ("passed", "passed_with_warnings"):
        raise ValueError(f"the panel run has status {receipt['status']}")
    for record in receipt["files"]:
        snapshots.check_manifest(receipt, record["path"], folder / record["path"])
    return readers.read_matrix(spark, str(folder / "matrix"), str(config["validation_end"]))


def _rows(matrix: DataFrame) -> DataFrame:
    """(pos, date, asset, r) of a matrix's assets."""
    return scenarios.panel_positions(panel.long(matrix, "asset__", "r"))


def _origins(matrix: DataFrame, config: dict) -> DataFrame:
    return windows.forecast_origins(matrix, str(config["train_end"]), str(config["validation_end"]), config["horizon"], config["stride"])


def _load(spark: SparkSession, source: dict, root: Path, start: str, end: str) -> DataFrame:
    """Rows of one cataloged source: a CSV file, or what its ``provider`` reads."""
    options = source.get("options", {})
    if "provider" in source:
        return readers.read_source(source["provider"], spark, str(root / source["path"]), *source.get("arguments", ()), start=start, end=end, **options)
    return readers.read_csv(spark, str(root / source["path"]), source.get("date_column", "date"), source["columns"], start, end, **options)


def run_panel(spark: SparkSession, config: dict, root: Path, out: Path) -> dict:
    """Read the cataloged sources, build the model matrix, and check all gates before anything is published.

    ``contexts``: sources with a transform, a lag, a limit of age and a role (``model``, or ``validation``: checked, and kept out of the matrix); ``derived``:
    spreads of two contexts. Outputs: matrix, targets, returns, context, lineage, intervals, calendars, coverage, freshness, flags, splits and report.md.
    """
    start, end = str(config["start"]), str(config["end"])
    targets = [_load(spark, s, root, start, end) for s in config["targets"]]
    names = [c for s in config["targets"] for c in s["columns"]]
    ends = panel.common_dates(targets)
    rows = sources = None
    for frame, spec in zip(targets, config["targets"], strict=True):
        one = frame.unpivot(["date"], spec["columns"], "series", "r")
        rows = one if rows is None else rows.unionByName(one)
        seen = frame.select("date").withColumn("source", F.lit(spec["path"]))
        sources = seen if sources is None else sources.unionByName(seen)
    returns = panel.compound_between(rows.filter("r is not null"), ends)
    calendar = returns.select("date").distinct()
    contexts = [{"name": "context"} | s for s in (config["contexts"] if "contexts" in config else [config["context"]])]
    native = None
    for s in contexts:
        one = _load(spark, s, root, start, end).select("date", F.lit(s["name"]).alias("feature"), F.col(s["columns"][0]).alias("value"))
        native = one if native is None else native.unionByName(one)
    aligned = runners.align_contexts(calendar, native, contexts)
    derived = config.get("derived", [])
    if derived:
        aligned = aligned.unionByName(runners.spreads(aligned, derived))
    role = {s["name"]: s.get("role", "model") for s in [*contexts, *derived]}
    model = [k for k, v in role.items() if v == "model"]
    aligned = aligned.withColumn("role", F.create_map(*[F.lit(x) for kv in role.items() for x in kv])[F.col("feature")])
    matrix = runners.build_panel(returns, aligned, names, model, config.get("features", []))
    wide = panel.wide(returns, names)
    audit, calendars = panel.interval_audit(sources, ends), quality.calendar_quality(sources, start)
    fresh = quality.freshness(sources, end, config["limits"].get("warn_days", 45), config["limits"].get("fail_days", 180))
    actual = spark.createDataFrame([(str(p.relative_to(root)),) for p in sorted((root / config["raw"]).rglob("*")) if p.is_file() and not p.name.endswith((".meta.json", ".crc"))], "path string")
    expected = spark.createDataFrame([(s["path"],) for s in [*config["targets"], *contexts]], "path string").distinct()
    cover = {v: quality.context_coverage(calendar, aligned.filter(F.col("role") == v)) for v in sorted(set(role.values()))}
    passed = quality.gates(wide.join(windows.positions(wide), "date"), matrix, audit, calendars, cover["model"], cover.get("validation"), aligned.filter("role = 'model'"), fresh,
        quality.allowlist(actual, expected), (str(config["train_end"]), str(config["validation_end"])), config["limits"])
    found = {r["gate"]: r["passed"] for r in passed.collect()}
    if not all(found.values()):
        snapshots.write_json(root / "quality_failure.json", {"gates": found})
        raise quality.DataQualityError(sorted(k for k, v in found.items() if not v))
    flags = quality.out_of_bounds(returns, config["limits"].get("return_bound", 0.25))
    part = panel.split_of(F.col("date"), str(config["train_end"]), str(config["validation_end"]))
    splits = matrix.groupBy(part.alias("split")).agg(F.count("*").alias("rows"), F.min("date").cast("string").alias("first"), F.max("date").cast("string").alias("last"))
    coverage = None
    for v, frame in cover.items():
        one = frame.withColumn("role", F.lit(v))
        coverage = one if coverage is None else coverage.unionByName(one)
    outputs = {"targets": wide, "returns": returns, "context": aligned.select("feature", "role", "date", "value", "stale"), "lineage": aligned.select("feature", "date", "source_date", "available_date"),
        "intervals": audit, "calendars": calendars, "coverage": coverage, "freshness": fresh, "flags": flags, "splits": splits}
    matrix.orderBy("date").coalesce(1).write.parquet(str(out / "matrix"))
    for name, frame in outputs.items():
        frame.write.parquet(str(out / name))
    warnings = [f"{r['source']} is {r['age_days']} days old" for r in fresh.filter("status = 'warn'").collect()]  # a row a source
    extreme = flags.count()
    warnings += [f"{extreme} returns are out of bounds"] if extreme else []
    parts = [tuple(r) for r in splits.orderBy("first").collect()]
    (out / "report.md").write_text(quality.markdown(found, parts, warnings))
    return {"status": "passed_with_warnings" if warnings else "passed", "gates": found}


def run_baselines(spark: SparkSession, config: dict, root: Path, out: Path) -> dict:
    matrix = _matrix(spark, config, root)
    detail, board, failures = runners.rolling_baselines(_rows(matrix), _origins(matrix, config), config["models"], config["lookback"], config["scenarios"], config["horizon"], config["seed"],
        config["confidence"], config["co_crash_fraction"], str(config["train_end"]), config.get("co_crash_quantile", 0.05))
    detail.write.parquet(str(out / "detail"))
    board.coalesce(1).write.parquet(str(out / "summary"))
    failures.coalesce(1).write.parquet(str(out / "failures"))
    failed = spark.read.parquet(str(out / "failures")).count()
    return {"status": "passed_with_failures" if failed else "passed", "failures": failed}


def _scored(cum: DataFrame, matrix: DataFrame, config: dict) -> DataFrame:
    return runners.score_scenarios(cum, _rows(matrix), _origins(matrix, config), config["horizon"], config.get("confidence", 0.95), config.get("co_crash_fraction", 0.4), str(config["train_end"]), config.get("co_crash_quantile", 0.05))


def _publish_scenarios(spark: SparkSession, cum: DataFrame, matrix: DataFrame, config: dict, out: Path, model_id: str) -> None:
    """Scenarios as rows and as an archive, their scores by origin, and the summary."""
    cum.write.parquet(str(out / "scenarios"))
    cum = spark.read.parquet(str(out / "scenarios"))
    dates = windows.positions(matrix).select(F.col("pos").cast("bigint").alias("origin_pos"), F.col("date").alias("origin_date"))
    assets = [c.removeprefix("asset__") for c in matrix.columns if c.startswith("asset__")]
    readers.write_archive(cum.join(F.broadcast(dates), "origin_pos").select("origin_date", "scenario", "asset", "g"), str(out / "archive"), assets)
    _scored(cum.withColumn("model_id", F.lit(model_id)), matrix, config).write.parquet(str(out / "detail"))
    comparison.leaderboard(spark.read.parquet(str(out / "detail"))).coalesce(1).write.parquet(str(out / "summary"))


def _starts(matrix: DataFrame, config: dict, model: factors.Switching) -> tuple[DataFrame, DataFrame, list[str]]:
    """(origin_pos, date, pi, f) at the origins, all rows with their factors and beliefs, and the factor columns."""
    columns = [f"f{k}" for k in range(config["factors"])]
    scored = model.factors.project(matrix).withColumn("series", F.lit("m"))
    beliefs = factors.filter_regimes(scored, columns, model.regimes)
    rows = scored.join(beliefs.select("date", "pi"), "date").join(windows.positions(matrix), "date")
    origin = _origins(matrix, config).select(F.col("origin_pos").cast("bigint").alias("origin_pos"))
    return rows.join(origin, F.col("pos") == F.col("origin_pos")).select("origin_pos", "date", "pi", F.array(*columns).alias("f")), rows, columns


def run_switching(spark: SparkSession, config: dict, root: Path, out: Path) -> dict:
    """Fit once on training rows; at each origin filter the whole history from the fitted start, sample, and score against what came true."""
    matrix = _matrix(spark, config, root)
    names = [c for c in matrix.columns if c.startswith("asset__")]
    train = matrix.filter(F.col("date") <= F.lit(str(config["train_end"])).cast("date"))
    model = factors.fit_switching(train, names, config["factors"], config["states"], config["restarts"], config["seed"], iterations=config.get("iterations", 300))
    starts, rows, _ = _starts(matrix, config, model)
    count, horizon, seed = config["scenarios"], config["horizon"], config["seed"]

    def sample(batches):
        import pandas as pd

        for frame in batches:
            for r in frame.itertuples():
                rng = np.random.Generator(np.random.Philox(key=[seed, int(r.origin_pos)]))
                g = np.expm1(np.log1p(model.sample(np.array(r.pi), np.array(r.f), count, horizon, rng)).sum(1))
                yield pd.DataFrame({"origin_pos": r.origin_pos, "scenario": np.repeat(np.arange(count), len(names)), "asset": np.tile([n.removeprefix("asset__") for n in names], count), "g": g.ravel()})

    cum = starts.select("origin_pos", "pi", "f").repartition("origin_pos").mapInPandas(sample, "origin_pos bigint, scenario int, asset string, g double")
    _publish_scenarios(spark, cum, matrix, config, out, "switching_factor")
    rows.select("series", "date", "pi").write.parquet(str(out / "beliefs"))
    profiles = factors.state_profiles(rows.filter(F.col("date") <= F.lit(str(config["train_end"])).cast("date")), names)
    profiles.coalesce(1).write.parquet(str(out / "state_profiles"))
    regimes = model.regimes
    readers.write_arrays(spark, {"start": regimes.start, "transitions": regimes.transitions, "means": regimes.means, "covariances": regimes.covariances, "loadings": model.factors.loadings,
        "centre": model.factors.centre, "scale": model.factors.scale, "explained": model.factors.explained}, str(out / "model"))
    least = min(float(np.linalg.eigvalsh(c).min()) for c in regimes.covariances)
    return {"status": "passed", "iterations": regimes.iterations, "explained": model.factors.explained.tolist(), "persistence": np.diag(regimes.transitions).tolist(), "least_eigenvalue": least}


def run_diffusion(spark: SparkSession, config: dict, root: Path, out: Path) -> dict:
    """A denoiser of factor windows under the filtered belief, weighted towards tails; at each origin factor paths are sampled, held within bounds and mapped to assets along regime paths of their own."""
    matrix = _matrix(spark, config, root)
    names = [c for c in matrix.columns if c.startswith("asset__")]
    train = matrix.filter(F.col("date") <= F.lit(str(config["train_end"])).cast("date"))
    seed, length, horizon, count = config["seed"], config["length"], config["horizon"], config["scenarios"]
    model = factors.fit_switching(train, names, config.get("factors", 2), config.get("states", 2), config.get("restarts", 2), seed, iterations=config.get("iterations", 60))
    config = config | {"factors": config.get("factors", 2)}
    starts, rows, columns = _starts(matrix, config, model)
    within = F.col("date") <= F.lit(str(config["train_end"])).cast("date")
    fitted = factors.fit_standardizer(rows.filter(within), columns)
    scaled = fitted.transform(rows)
    pairs = windows.window_pairs(scaled.filter(within), columns, length, horizon).join(rows.select("pos", "pi"), "pos")
    cells = pairs.select(F.col("pos").alias("w"), F.posexplode("future").alias("step", "v")).select("w", "step", F.posexplode("v").alias("feature", "x"))
    weights = tail.importance_weights(tail.severity(cells, config.get("direction", "two_sided"))).select(F.col("w").alias("pos"), "weight")
    fit = factors.series_rows(pairs.join(weights, "pos"), ["past", "future", "pi", "weight"], "pos")
    past, future = (np.array([[list(r) for r in w] for w in fit[c]], float) for c in ("past", "future"))
    belief, weight = np.array(fit["pi"].tolist(), float), fit["weight"].to_numpy(float)
    cut = max(1, int(config.get("training_fraction", 0.9) * len(past)))
    net = diffusion.Denoiser(len(columns), len(columns), belief.shape[1], config["channels"], config["blocks"], seed=seed)
    tuning = (past[cut:], future[cut:], belief[cut:]) if cut < len(past) else None
    history = diffusion.train(net, past[:cut], future[:cut], belief[:cut], weight[:cut], config["steps"], config["epochs"], seed, tuning)
    spark.createDataFrame(history).coalesce(1).write.parquet(str(out / "history"))
    readers.write_arrays(spark, net.weights, str(out / "checkpoint"))
    readers.write_arrays(spark, {"mean": fitted.mean, "scale": fitted.scale, "n_fit_rows": np.array([fitted.n_fit_rows])}, str(out / "standardizer"))
    ahead = windows.history_slices(scaled.select("pos", F.array(*columns).alias("x")), starts.select("origin_pos"), length)
    ahead = ahead.groupBy("origin_pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", "x"))), lambda s: s["x"]).alias("past"))
    steps, bound = config["steps"], config.get("clip", 8.0)

    def sample(batches):
        import pandas as pd

        for frame in batches:
            for r in frame.itertuples():
                origin = int(r.origin_pos)
                history_ = np.array([list(x) for x in r.past], float)
                z = diffusion.sample(net, np.repeat(history_[None], count, 0), np.repeat(np.array(r.pi, float)[None], count, 0), horizon, steps, np.random.Generator(np.random.Philox(key=[seed, origin])))
                clipped = float((np.abs(z) > bound).mean())
                f = np.clip(z, -bound, bound) * fitted.scale + fitted.mean
                rng = np.random.Generator(np.random.Philox(key=[seed + 10_000, origin]))
                states = factors.state_paths(np.array(r.pi, float), model.regimes.transitions, count, horizon, rng)
                g = np.expm1(np.log1p(np.maximum(np.expm1(model.mapping.sample(f, states, rng)), -1 + 1e-15)).sum(1))
                yield pd.DataFrame({"origin_pos": origin, "scenario": np.repeat(np.arange(count), len(names)), "asset": np.tile([n.removeprefix("asset__") for n in names], count), "g": g.ravel(), "clip_fraction": clipped})

    drawn = starts.select("origin_pos", "pi").join(ahead, "origin_pos").repartition("origin_pos").mapInPandas(sample, "origin_pos bigint, scenario int, asset string, g double, clip_fraction double")
    _publish_scenarios(spark, drawn, matrix, config, out, "factor_diffusion")
    worst = spark.read.parquet(str(out / "scenarios")).agg(F.max("clip_fraction")).first()[0]
    return {"status": "passed", "windows": len(past), "clip_fraction": worst}


def run_comparison(spark: SparkSession, config: dict, root: Path, out: Path) -> dict:
    """Paired intervals of one model against all others of the named runs; origins must match one to one."""
    detail = None
    for folder in [config["baselines"]] if isinstance(config["baselines"], str) else config["baselines"]:
        receipt = json.loads((root / folder / "receipt.json").read_text())
        if receipt["status"] not in ("passed", "completed"):
            raise ValueError(f"the run {folder} has status {receipt['status']}")
        one = spark.read.parquet(str(root / folder / "detail"))
        detail = one if detail is None else detail.unionByName(one)
    found = runners.paired_comparison(detail, config["model"], config["metrics"], config["replications"], config["block"], config["level"], config["seed"])
    found.coalesce(1).write.parquet(str(out / "intervals"))
    return {"status": "passed"}


def run_decisions(spark: SparkSession, config: dict, root: Path, out: Path) -> dict:
    matrix = _matrix(spark, config, root)
    model = spark.read.parquet(str(root / config["scenarios"] / "scenarios"))
    held, summary = runners.decision_evaluation(_rows(matrix), _origins(matrix, config), model, config["lookback"], config["horizon"], config["confidence"], config["radii"], config.get("turnover_cap"), config["cost"], config["upper"], config.get("split", "validation"))
    held.write.parquet(str(out / "weights"))
    summary.coalesce(1).write.parquet(str(out / "summary"))
    return {"status": "passed"}


def run_counterfactual(spark: SparkSession, config: dict, root: Path, out: Path) -> dict:
    runners.counterfactual_evaluation(spark, config["paths"], config["horizon"], config["seed"], tuple(config.get("outcomes", ("equity", "volatility"))), config.get("treated_steps", 5)).coalesce(1).write.parquet(str(out / "effects"))
    return {"status": "passed"}


RUNNERS = {"panel": run_panel, "baselines": run_baselines, "switching": run_switching, "diffusion": run_diffusion, "comparison": run_comparison, "decisions": run_decisions, "counterfactual": run_counterfactual}


def execute(spark: SparkSession, name: str, config: dict, root: str | Path) -> dict:
    """Run, then publish the run's folder with its receipt; after an error nothing is published."""
    root, began = Path(root), time.time()
    if config.get("split", "validation") != "validation":
        snapshots.sealed(config["split"])
    with snapshots.published(root / config["output"]) as (stage,):
        found = RUNNERS[name](spark, config, root, stage)
        files = [f for f in snapshots.manifest(spark, stage) if not f["path"].endswith(".crc")]
        receipt = found | {"runner": name, "parameters": config, "files": files, "seconds": round(time.time() - began, 3), "code": snapshots.git_state(Path(__file__).parent)}
        snapshots.write_json(stage / "receipt.json", receipt)
    return receipt


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="riskframes", description=__doc__)
    parser.add_argument("runner", choices=sorted(RUNNERS))
    parser.add_argument("--config", required=True)
    parser.add_argument("--root", default=".")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName(f"riskframes-{given.runner}").getOrCreate()
    receipt = execute(spark, given.runner, snapshots.load_yaml(given.config), given.root)
    print(json.dumps(snapshots.plain({k: receipt[k] for k in ("runner", "status", "seconds")})))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
