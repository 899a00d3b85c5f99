"""Registered queries cover all forecast origins. At sf0.001 some weeks lack a series and holdings stop there; sf0.01 has all."""

import pytest

from riskframes.catalog import models, risk


@pytest.mark.parametrize("name", ["gen_all_models", "gen_ewma_fhs", "cvar_weights"])
def test_all_origins(spark, name):
    sf = "/root/testdata/sf0.01"
    every = {x["origin_pos"] for x in risk._origins(spark, sf).collect()}
    query = risk.QUERIES.get(name) or models.QUERIES[name]
    assert len(every) > 4
    assert {x["origin_pos"] for x in query(spark, sf).select("origin_pos").distinct().collect()} == every


def test_decisions_run_over_all_origins(spark):
    sf = "/root/testdata/sf0.01"
    rows = models.QUERIES["decision_sequence"](spark, sf).collect()
    assert rows and {x["blocks"] for x in rows} == {risk._origins(spark, sf).count()}
