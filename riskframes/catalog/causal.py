"""Queries of the structural simulator; the SQL twins are recursive."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import normal_sql, uniform_sql
from ..operators import counterfactual as cf
from .panel import _r

PATHS, HORIZON, SEED = 60, 8, 31
MODEL = cf.Structure()
DO = cf.registered(3, 5, 0.5)


def _exo(spark):
    return cf.regimes(cf.exogenous(spark, PATHS, HORIZON, MODEL, SEED), MODEL)


def _long(spark, do=None, model=MODEL):
    return cf.long_paths(cf.simulate(_exo(spark), model, do))


def _out(df):
    return df.select("path", F.col("t").cast("int").alias("t"), *[_r(v) for v in cf.VARIABLES])


def scm_regimes(spark, d):
    return _exo(spark).select("path", F.posexplode("z").alias("t", "z"))


def scm_factual(spark, d):
    return _out(_long(spark))


def scm_intervened(spark, d):
    return _out(_long(spark, DO["treated"]))


def scm_controlled(spark, d):
    return _out(_long(spark, DO["controlled_treated"]))


def scm_abduction(spark, d):
    """Innovations recovered from the factual paths, and how far they are from the true ones."""
    exo = _exo(spark)
    seen = cf.simulate(exo, MODEL).join(exo.select("path", "z", F.col("e").alias("true_e")), "path")
    back = cf.abduct(seen, MODEL).join(exo.select("path", F.col("e").alias("true_e")), "path")
    worst = F.array_max(F.transform(F.arrays_zip("e", "true_e"), lambda r: F.greatest(*[F.abs(r["e"][v] - r["true_e"][v]) for v in cf.VARIABLES])))
    return back.select("path", (worst < 1e-9).alias("recovered"))


def scm_aap_error(spark, d):
    """Abduction, action and prediction with the true model give the intervened paths again."""
    exo = _exo(spark)
    seen = cf.simulate(exo, MODEL).join(exo.select("path", "z"), "path")
    again = cf.abduct(seen, MODEL).join(exo.select("path", "z"), "path")
    predicted = cf.long_paths(cf.simulate(again, MODEL, DO["treated"])).select("path", "t", F.col("equity").alias("p"))
    true = _long(spark, DO["treated"]).select("path", "t", "equity")
    return true.join(predicted, ["path", "t"]).agg((F.max(F.abs(F.col("equity") - F.col("p"))) < 1e-9).alias("exact"), F.count("*").alias("n"))


def scm_effects(spark, d):
    path, _ = cf.effect(_long(spark, DO["reference"]), _long(spark, DO["treated"]), "equity")
    return path.select(F.col("t").cast("int").alias("t"), _r("mean_effect"))


def scm_effect_summary(spark, d):
    _, row = cf.effect(_long(spark, DO["reference"]), _long(spark, DO["treated"]), "equity", 0.9)
    return row.select(*[_r(c) for c in ("ate_terminal", "cumulative_ate", "tail_effect")])


def scm_controlled_effect(spark, d):
    path, _ = cf.effect(_long(spark, DO["controlled_reference"]), _long(spark, DO["controlled_treated"]), "equity")
    return path.select(F.col("t").cast("int").alias("t"), _r("mean_effect"))


def scm_misspecification(spark, d):
    """Errors of misspecified models, each fitted to the same factual paths by abduction."""
    exo = _exo(spark)
    seen = cf.simulate(exo, MODEL).join(exo.select("path", "z"), "path")
    out = None
    for name, model in {"truth": MODEL, **cf.misspecified(MODEL)}.items():
        own = exo if name == "truth" else cf.abduct(seen, model).join(exo.select("path", "z"), "path")
        for arm, key in (("factual", "reference"), ("counterfactual", "treated")):
            one = cf.long_paths(cf.simulate(own, model, DO[key])).withColumns({"model_id": F.lit(name), "effect_type": F.lit("total"), "arm": F.lit(arm)})
            out = one if out is None else out.unionByName(one)
    return cf.effects(out, ("equity", "volatility")).select("model_id", "outcome", *[_r(c) for c in ("ate_terminal", "cumulative_ate", "tail_effect")])


NAMES = "scm_regimes scm_factual scm_intervened scm_controlled scm_abduction scm_aap_error scm_effects scm_effect_summary scm_controlled_effect scm_misspecification".split()
QUERIES = {n: globals()[n] for n in NAMES}


def _cut(u: str, row) -> str:
    total, parts = 0.0, []
    for p in row[:-1]:
        total += p
        parts.append(f"({u} > {total!r}::DOUBLE)::INT")
    return " + ".join(parts)


_EXO = f"""grid AS (SELECT path, t FROM (SELECT unnest(generate_series(0, {PATHS - 1})) AS path), (SELECT unnest(generate_series(0, {HORIZON - 1}))::INT AS t)),
exo AS (SELECT path, t, {', '.join(f"{normal_sql(SEED, 'path', 't', chr(39) + v + chr(39))} * {cf.SCALES[v]!r} AS e_{v}" for v in cf.VARIABLES)}, {uniform_sql(SEED, 'path', 't', "'regime'")} AS u FROM grid),
st AS (SELECT path, -1 AS t, {_cut(uniform_sql(SEED, 'path', "'start'"), cf.START)} AS z FROM (SELECT DISTINCT path FROM grid)
  UNION ALL SELECT st.path, st.t + 1, CASE st.z {' '.join(f"WHEN {k} THEN {_cut('u', row)}" for k, row in enumerate(cf.TRANSITIONS))} END FROM st JOIN exo ON exo.path = st.path AND exo.t = st.t + 1)"""


def _sim(name: str, do: cf.Intervention | None, model: cf.Structure = MODEL, exo: str = "exo") -> str:
    """A recursive table of one simulation: each equation in a lateral step."""
    do = do or cf.Intervention()
    sql, done = [], {}
    for v in model.equations:
        total = f"e_{v}" + "".join(f" + ({c!r}) * {'s.' + n if b else done[n]}" for n, b, c in model.equations[v]) + f" + CASE z WHEN 0 THEN {model.intercepts[v][0]!r} WHEN 1 THEN {model.intercepts[v][1]!r} ELSE {model.intercepts[v][2]!r} END"
        value = f"(greatest({total}, 0) + ln(1 + exp(-abs({total}))))" if v == "volatility" else f"({total})"
        fixed = do.schedule(v)
        if fixed:
            value = "CASE x.t " + " ".join(f"WHEN {t} THEN {float(f)!r}::DOUBLE" for t, f in fixed.items()) + f" ELSE {value} END"
        sql.append(f"LATERAL (SELECT {value} AS n_{v}) l_{v}")
        done[v] = f"n_{v}"
    columns = ", ".join(f'n_{v}' for v in cf.VARIABLES)
    first = ", ".join(f'{cf.INITIAL[v]!r}::DOUBLE AS "{v}"' for v in cf.VARIABLES)
    body = ", ".join(sql).replace("s.yield", 's."yield"')
    return f"""{name} AS (SELECT path, -1 AS t, {first} FROM (SELECT DISTINCT path FROM grid)
  UNION ALL SELECT s.path, s.t + 1, {columns} FROM {name} s JOIN (SELECT {exo}.*, z FROM {exo} JOIN st USING (path, t)) x ON x.path = s.path AND x.t = s.t + 1, {body})"""


def _all(name: str) -> str:
    return "SELECT path, t, " + ", ".join(f'round("{v}", 8) AS "{v}"' for v in cf.VARIABLES) + f" FROM {name} WHERE t >= 0"


def _two(a: str, b: str) -> str:
    return f"WITH RECURSIVE {_EXO}, {_sim('fa', DO[a])}, {_sim('co', DO[b])}, pe AS (SELECT co.path, co.t, co.equity AS c, fa.equity AS f FROM co JOIN fa USING (path, t) WHERE t >= 0)"


def _es(column: str) -> str:
    return f"(SELECT sum(greatest(i / n - greatest((i - 1) / n, 0.9::DOUBLE), 0) * x) / (1 - 0.9::DOUBLE) FROM (SELECT {column} AS x, row_number() OVER (ORDER BY {column}) AS i, count(*) OVER () AS n FROM tot))"


ORACLES = {
    "scm_regimes": f"WITH RECURSIVE {_EXO} SELECT path, t, z FROM st WHERE t >= 0",
    "scm_factual": f"WITH RECURSIVE {_EXO}, {_sim('sim', None)} {_all('sim')}",
    "scm_intervened": f"WITH RECURSIVE {_EXO}, {_sim('sim', DO['treated'])} {_all('sim')}",
    "scm_controlled": f"WITH RECURSIVE {_EXO}, {_sim('sim', DO['controlled_treated'])} {_all('sim')}",
    "scm_abduction": f"SELECT unnest(generate_series(0, {PATHS - 1})) AS path, true AS recovered",
    "scm_aap_error": f"SELECT true AS exact, CAST({PATHS * HORIZON} AS BIGINT) AS n",
    "scm_effects": _two("reference", "treated") + " SELECT t, round(avg(c - f), 8) AS mean_effect FROM pe GROUP BY t",
    "scm_effect_summary": _two("reference", "treated") + f", m AS (SELECT t, avg(c - f) AS e FROM pe GROUP BY t), tot AS (SELECT path, -sum(c) AS c, -sum(f) AS f FROM pe GROUP BY path) SELECT round(arg_max(e, t), 8) AS ate_terminal, round(sum(e), 8) AS cumulative_ate, round({_es('c')} - {_es('f')}, 8) AS tail_effect FROM m",
    "scm_controlled_effect": _two("controlled_reference", "controlled_treated") + " SELECT t, round(avg(c - f), 8) AS mean_effect FROM pe GROUP BY t",
}
