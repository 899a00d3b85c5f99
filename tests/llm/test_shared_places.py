"""The shared folder, tables in it, and the order of token files."""

from types import SimpleNamespace

import pytest

from riskframes.llm import _common, token_files


def test_a_cluster_needs_a_shared_folder():
    context = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda name, other: other), sparkContext=context)
    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        _common.shared_dir(spark)


def test_tables_are_removed(spark):
    kept = _common.written(spark.range(5))
    assert kept.count() == 5
    _common.discard(kept)
    place, system = _common._folder(spark, kept._written)
    assert not system.exists(place)


def test_files_are_in_order_of_their_numbers(spark):
    rows = [("f/part-100000-x.parquet", 0, 7), ("f/part-99999-x.parquet", 0, 5), ("f/part-99999-x.parquet", 1, 2), ("f/part-00003-x.parquet", 0, 1)]
    df = spark.createDataFrame(rows, "file string, row long, n_tokens long")
    got = {(r["file"][7:12], r["row"]): r["start"] for r in token_files.starts(df).collect()}
    assert got == {("00003", 0): 0, ("99999", 0): 1, ("99999", 1): 6, ("10000", 0): 8}
