"""Readers of source files into (date, columns) rows; network fetches stay with the caller, who hands over files.

All return strictly parsed dates, numbers parsed leniently (null where they aren't), rows that are null in all requested columns dropped, and
dates within the range.
"""

from __future__ import annotations

import io
import math
import re
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _shaped(rows: DataFrame, columns: list[str], start: str, end: str) -> DataFrame:
    wanted = rows.select("date", *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in columns])
    return wanted.na.drop("all", subset=columns).filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def _required(found: list[str], wanted: list[str]) -> None:
    missing = sorted(set(wanted) - set(found))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def read_csv(spark: SparkSession, path: str, date_column: str, columns: list[str], start: str, end: str) -> DataFrame:
    head = spark.read.option("header", True).csv(path)
    _required(head.columns, [date_column, *columns])
    return _shaped(head.withColumn("date", F.to_date(date_column)), columns, start, end)


def read_yield_xml(spark: SparkSession, paths: list[str], columns: list[str], start: str, end: str) -> DataFrame:
    """Feed entries, a file a year: date NEW_DATE and a node for each column."""
    names = ["NEW_DATE", *columns]
    files = spark.read.option("wholetext", True).text(paths)
    entries = files.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?s)<(?:\w+:)?properties\b[^>]*>(.*?)</(?:\w+:)?properties>"), F.lit(1))).alias("e"))
    node = lambda n: F.nullif(F.regexp_extract("e", rf"(?s)<(?:\w+:)?{re.escape(n)}\b[^>]*>\s*([^<]*?)\s*</", 1), F.lit(""))
    rows = entries.select(*[node(n).alias(n) for n in names])
    return _shaped(rows.withColumn("date", F.to_date(F.substring("NEW_DATE", 1, 10))), columns, start, end)


def read_rates_json(spark: SparkSession, path: str, column: str, start: str, end: str) -> DataFrame:
    """Records refRates[] with effectiveDate and percentRate."""
    record = "struct<refRates:array<struct<effectiveDate:string,percentRate:string>>>"
    rows = spark.read.option("wholetext", True).text(path).select(F.explode(F.from_json("value", record)["refRates"]).alias("r"))
    return _shaped(rows.select(F.to_date("r.effectiveDate").alias("date"), F.col("r.percentRate").alias(column)), [column], start, end)


def _section(payload: bytes, marker: str) -> list[tuple]:
    """(date, name, value) of the section after the marker: a header with a blank first cell, then rows that begin with eight digits."""
    with zipfile.ZipFile(io.BytesIO(payload)) as archive:
        names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
        if len(names) != 1:
            raise ValueError("the archive must hold one CSV file")
        lines = archive.read(names[0]).decode("latin-1").splitlines()
    at = next((k for k, line in enumerate(lines) if marker.lower() in line.lower()), None)
    if at is None:
        raise ValueError(f"no section {marker}")
    head = next((k for k in range(at + 1, len(lines)) if lines[k].strip()), None)
    if head is None or lines[head].split(",")[0].strip():
        raise ValueError("the section's header must begin with a blank cell")
    columns, out = [c.strip() for c in lines[head].split(",")[1:]], []
    for line in lines[head + 1 :]:
        cells = [c.strip() for c in line.split(",")]
        if not re.fullmatch(r"\d{8}", cells[0]):
            break
        out += [(cells[0], n, float(v)) for n, v in zip(columns, cells[1:], strict=False) if v]
    return out


def read_sectioned_zip(spark: SparkSession, path: str, marker: str, columns: list[str], start: str, end: str) -> DataFrame:
    """Percent returns of one section of a zipped CSV as fractions; -99.99 and -999 are null. A file a task."""

    def run(batches):
        for frame in batches:
            for payload in frame["content"]:
                yield pd.DataFrame(_section(bytes(payload), marker), columns=["day", "name", "value"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "day string, name string, value double")
    _required([r["name"] for r in rows.select("name").distinct().collect()], columns)  # header names
    value = F.when(F.col("value").isin(-99.99, -999.0), None).otherwise(F.col("value") / 100)
    wide = rows.groupBy(F.to_date("day", "yyyyMMdd").alias("date")).pivot("name", columns).agg(F.first(value))
    return _shaped(wide, columns, start, end)


PROVIDERS: dict[str, Callable[..., DataFrame]] = {"csv": read_csv, "yield_xml": read_yield_xml, "rates_json": read_rates_json, "sectioned_zip": read_sectioned_zip}


def read_source(provider: str, *args, **options) -> DataFrame:
    """A reader by its provider's name; others are an error."""
    if provider not in PROVIDERS:
        raise ValueError(f"unknown provider {provider}")
    return PROVIDERS[provider](*args, **options)


def read_matrix(spark: SparkSession, path: str, cutoff: str) -> DataFrame:
    """A panel up to the cutoff, filtered at the scan; dates must be unique, none after the cutoff is read."""
    rows = spark.read.parquet(path).filter(F.col("date") <= F.lit(cutoff).cast("date"))
    n, distinct, last = rows.agg(F.count("*"), F.count_distinct("date"), F.max("date").cast("string")).first()
    if n != distinct or n == 0 or last > cutoff:
        raise ValueError("dates must be unique and within the cutoff")
    return rows


def read_archive(spark: SparkSession, path: str, assets: list[str], origins: list[str]) -> DataFrame:
    """A scenario archive (origin_date, scenario, g array) checked against assets and origins: complete, finite and above -1."""
    rows = spark.read.parquet(path)
    if rows.schema.fieldNames() != ["origin_date", "scenario", "g"]:
        raise ValueError("an archive has origin_date, scenario and g")
    bad = F.exists("g", lambda x: x.isNull() | F.isnan(x) | (x < -1) | (F.abs(x) == float("inf")))
    checks = rows.agg(F.max((F.size("g") != len(assets)) | bad).alias("bad"), F.sort_array(F.collect_set(F.col("origin_date").cast("string"))).alias("origins")).first()
    per = rows.groupBy("origin_date").agg(F.count("*").alias("n"), F.count_distinct("scenario").alias("d")).agg(F.min("n"), F.max("n"), F.min(F.col("n") == F.col("d"))).first()
    if checks["bad"] or checks["origins"] != sorted(origins) or per[0] != per[1] or per[0] < 2 or not per[2]:
        raise ValueError("the archive doesn't match its origins and assets")
    return rows


def write_archive(scenarios: DataFrame, path: str, assets: list[str]) -> None:
    """Scenarios (origin_date, scenario, asset, g) as an archive of one array a row, in order of ``assets``; a missing cell is an error."""
    cells = scenarios.groupBy("origin_date", "scenario").agg(F.map_from_entries(F.collect_list(F.struct("asset", "g"))).alias("m"))
    g = F.array(*[F.coalesce(F.col("m")[a], F.raise_error(F.lit(f"{a} is missing")).cast("double")) for a in assets])
    cells.select("origin_date", "scenario", g.alias("g")).write.parquet(path)


def write_arrays(spark: SparkSession, arrays: dict[str, np.ndarray], path: str) -> None:
    """Named arrays (a model's weights, a standardizer) as rows (name, shape, values)."""
    rows = [(k, list(map(int, v.shape)), v.ravel().astype(float).tolist()) for k, v in sorted(arrays.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").coalesce(1).write.parquet(path)


def read_arrays(spark: SparkSession, path: str, names: list[str] | None = None) -> dict[str, np.ndarray]:
    """The arrays of ``write_arrays``; other names than those asked for, or a shape that doesn't hold, are an error."""
    out = {}
    for r in spark.read.parquet(path).collect():  # a model's own size
        if math.prod(r["shape"]) != len(r["values"]) or r["name"] in out:
            raise ValueError(f"{r['name']} isn't an array")
        out[r["name"]] = np.array(r["values"], float).reshape(r["shape"])
    if names is not None and sorted(out) != sorted(names):
        raise ValueError("the archive has other arrays")
    return out


RETURN_SCHEMA = T.StructType([T.StructField("date", T.DateType()), T.StructField("series", T.StringType()), T.StructField("r", T.DoubleType())])
