"""The driver's contract: names, SQL twins, and a few queries against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__


def test_every_twin_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["panel_wide", "asof_lagged", "interval_audit", "origins", "gen_moving_block", "es_fractional", "scm_factual", "conformal_batch", "importance_weights", "pca_loadings", "regime_em_step", "gpd_quantile_es", "standardized"])
def test_twins_agree(spark, sf, name):
    con = duckdb.connect()
    for file in os.listdir(sf):
        con.execute(f"create view {file[:-8]} as select * from '{sf}/{file}'")
    mine = __spark_entry__.queries()[name](spark, sf).toPandas()
    other = con.execute(__spark_entry__.oracle_sql()[name]).df()
    key = lambda df: sorted(tuple("" if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else str(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))
    assert key(mine) == key(other)
