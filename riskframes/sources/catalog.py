"""Catalog-driven loading: snapshots are reused, refreshed or required, source by source; and a Python data source over verified snapshots."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import readers, snapshots

#: Readers by role and provider. ``derived`` sources are made from others and are never fetched.
ROUTERS: dict[str, dict[str, Callable[..., DataFrame]]] = {
    "returns": {"csv": readers.read_csv, "sectioned_zip": readers.read_sectioned_zip},
    "macro": {"csv": readers.read_csv, "yield_xml": readers.read_yield_xml, "rates_json": readers.read_rates_json},
}
DERIVED = "derived"


def route(role: str, provider: str) -> Callable[..., DataFrame]:
    """The reader of a role's provider; an unknown one is an error."""
    if role not in ROUTERS or provider not in ROUTERS[role]:
        raise ValueError(f"unknown {role} provider {provider}")
    return ROUTERS[role][provider]


def load_catalog(
    spark: SparkSession, sources: list[dict], root: str | Path, start: str, end: str, fetch: Callable[[dict], str] | None = None, refresh: bool = False
) -> dict[str, DataFrame]:
    """Rows of each source by its id, from a verified snapshot below ``root``.

    sources: {"id", "role", "provider", "columns", "arguments"}. A snapshot that is there is reused unless ``refresh``; else ``fetch`` gives the path of a
    raw file, which is read by the role's provider and kept as a snapshot. Without ``fetch`` (offline) a missing snapshot, or a refresh, is an
    error. Derived sources are left out, ids must be distinct.
    """
    if len({s["id"] for s in sources}) != len(sources):
        raise ValueError("source ids repeat")
    out = {}
    for s in sources:
        if s["provider"] == DERIVED:
            continue
        path = Path(root) / f"{s['id']}.csv"
        reader = route(s["role"], s["provider"])
        if refresh or not path.exists():
            if fetch is None:
                raise FileNotFoundError(f"{s['id']} has no snapshot and nothing may be fetched")
            rows = reader(spark, fetch(s), *s.get("arguments", ()), s["columns"], start, end)
            snapshots.write_snapshot(rows.select("date", *s["columns"]), path, s["id"], s["provider"], requested_start=start, requested_end=end)
        out[s["id"]] = snapshots.read_snapshot(spark, path, s["id"], s["provider"], s["columns"], start, end)
    return out


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class SnapshotSource(DataSource):
    """``spark.read.format("snapshots").load(folder)``: (source_id, date, series, value) of all snapshots in a folder whose hash holds, a file a task.

    The folder must be one that driver and executors share.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshots"

    def schema(self) -> str:
        return "source_id string, date string, series string, value double"

    def reader(self, schema) -> DataSourceReader:
        return _SnapshotReader(self.options["path"])


class _SnapshotReader(DataSourceReader):
    def __init__(self, folder: str) -> None:
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        return [_File(str(p)) for p in sorted(Path(self.folder).glob("*.csv"))]

    def read(self, partition: _File):
        import csv

        meta = snapshots.snapshot_meta(partition.path)
        if meta["sha256"] != snapshots.file_hash(partition.path):
            raise ValueError(f"{partition.path} isn't what its metadata says")
        with open(partition.path, newline="") as file:
            for row in csv.DictReader(file):
                for name in meta["columns"][1:]:
                    yield meta["source_id"], row["date"], name, float(row[name]) if row[name] else None
