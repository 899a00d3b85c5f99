"""Verified snapshots and provenance: hashes, metadata, manifests, receipts, and all-or-nothing publication.

These are small files beside the data and are kept by the driver; hashes of many files come from one distributed scan.
"""

from __future__ import annotations

import hashlib
import json
import math
import os
import shutil
import subprocess
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

META = ("source_id", "provider", "sha256", "row_count", "columns", "first_date", "last_date")


def plain(value):
    """A value that JSON can hold: dates as text, numbers that aren't finite as null."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [plain(v) for v in (sorted(value) if isinstance(value, set) else value)]
    if hasattr(value, "tolist"):
        return plain(value.tolist())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def write_json(path: str | Path, document: dict) -> None:
    """Sorted keys, through a temporary file that takes the place of the old one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(f".{path.name}.{uuid.uuid4().hex}")
    part.write_text(json.dumps(plain(document), sort_keys=True, indent=2, allow_nan=False) + "\n")
    os.replace(part, path)


def load_yaml(path: str | Path) -> dict:
    found = yaml.safe_load(Path(path).read_text())
    if not isinstance(found, dict):
        raise ValueError(f"{path} must hold a mapping")
    return found


def project_root(start: str | Path, marker: str = "configs") -> Path:
    """The nearest folder from ``start`` upwards that holds ``marker``."""
    start = Path(start).resolve()
    for folder in (start, *start.parents):
        if (folder / marker).exists():
            return folder
    raise FileNotFoundError(marker)


def file_hash(path: str | Path) -> str:
    with open(path, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def write_snapshot(frame: DataFrame, path: str | Path, source_id: str, provider: str, **extra) -> dict:
    """One CSV file in order of date and its metadata beside it.

    The new metadata is put in place first and holds the old one until the file has followed, so whenever this is stopped, the file that is there has its metadata.
    """
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    stage = path.parent / f".stage-{uuid.uuid4().hex}"
    frame.orderBy("date").coalesce(1).write.option("header", True).csv(str(stage))
    file = next(stage.glob("part-*.csv"))
    n, first, last = frame.agg(F.count("*"), F.min("date").cast("string"), F.max("date").cast("string")).first()
    meta = {"source_id": source_id, "provider": provider, "sha256": file_hash(file), "row_count": n, "columns": frame.columns, "first_date": first, "last_date": last} | extra
    if path.exists() and meta_path(path).exists():
        write_json(meta_path(path), meta | {"previous": snapshot_meta(path)})
        os.replace(file, path)
        write_json(meta_path(path), meta)
    else:
        write_json(meta_path(path), meta)
        os.replace(file, path)
    shutil.rmtree(stage)
    return meta


def meta_path(path: str | Path) -> Path:
    return Path(path).with_suffix(".meta.json")


def snapshot_meta(path: str | Path) -> dict:
    """The metadata of the file that is there: that of the snapshot before where its successor's file hasn't come."""
    meta = json.loads(meta_path(path).read_text())
    before = meta.pop("previous", None)
    return before if before and before.get("sha256") == file_hash(path) else meta


def read_snapshot(spark: SparkSession, path: str | Path, source_id: str, provider: str, columns: list[str], start: str, end: str) -> DataFrame:
    """A snapshot that is what its metadata says and covers the range, filtered to it. Anything else is an error."""
    meta = snapshot_meta(path)
    missing = [k for k in META if k not in meta]
    if missing:
        raise ValueError(f"metadata lacks {', '.join(missing)}")
    if (meta["source_id"], meta["provider"]) != (source_id, provider):
        raise ValueError("the snapshot is of another source")
    if meta["sha256"] != file_hash(path):
        raise ValueError("hash mismatch")
    rows = spark.read.option("header", True).csv(str(path))
    if rows.columns != meta["columns"] or rows.columns != ["date", *columns]:
        raise ValueError("columns differ from the metadata or the catalog")
    rows = rows.select(F.to_date("date").alias("date"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in columns])
    facts = rows.agg(F.count("*"), F.count_distinct("date"), F.min("date").cast("string"), F.max("date").cast("string")).first()
    if facts[0] != meta["row_count"]:
        raise ValueError("row count mismatch")
    if facts[0] != facts[1] or (facts[2], facts[3]) != (meta["first_date"], meta["last_date"]):
        raise ValueError("dates differ from the metadata or repeat")
    if meta.get("requested_start", start) > start or meta.get("requested_end", end) < end:
        raise ValueError("the snapshot doesn't cover the request")
    rows = rows.filter(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    if rows.isEmpty():
        raise ValueError("no row in the range")
    return rows


def manifest(spark: SparkSession, root: str | Path) -> list[dict]:
    """(path, bytes, sha256) of all files below a folder, hashed by one distributed scan, in order of path."""
    root = Path(root).resolve()
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(root)).select("path", F.length("content").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    out = [{"path": str(Path(r["path"].split(":", 1)[1]).resolve().relative_to(root)), "bytes": r["bytes"], "sha256": r["sha256"]} for r in rows.collect()]  # a row a file
    return sorted(out, key=lambda r: r["path"])


def check_manifest(document: dict, path: str, file: str | Path) -> None:
    """The manifest has one record of the path, and its hash is the file's."""
    found = [r for r in document["files"] if r["path"] == path]
    if len(found) != 1 or found[0]["sha256"] != file_hash(file):
        raise ValueError(f"{path} isn't what the manifest says")


def check_receipt(document: dict, key: str, file: str | Path, allowed: tuple[str, ...] = ("passed", "completed")) -> None:
    if document.get("status") not in allowed:
        raise ValueError(f"status {document.get('status')} isn't accepted")
    if document["outputs"][key]["sha256"] != file_hash(file):
        raise ValueError(f"{key} isn't what the receipt says")


def git_state(root: str | Path) -> dict:
    """Commit and whether files are changed; unknown outside a repository."""
    run = lambda *a: subprocess.run(["git", "-C", str(root), *a], capture_output=True, text=True)
    head = run("rev-parse", "HEAD")
    return {"commit": head.stdout.strip(), "dirty": bool(run("status", "--porcelain").stdout.strip())} if head.returncode == 0 else {"commit": None, "dirty": None}


@contextmanager
def published(*targets: str | Path) -> Iterator[list[Path]]:
    """Stages for several trees. At the end all take their targets' places, or after any error none does."""
    targets = [Path(t) for t in targets]
    mark = uuid.uuid4().hex
    stages, backs = [t.with_name(f".{t.name}.new-{mark}") for t in targets], [t.with_name(f".{t.name}.old-{mark}") for t in targets]
    moved: list[tuple[Path, Path, bool]] = []
    for s in stages:
        s.mkdir(parents=True)
    try:
        yield stages
        for t, s, b in zip(targets, stages, backs, strict=True):
            had = t.exists()
            if had:
                os.rename(t, b)
            moved.append((t, b, had))
            os.rename(s, t)
    except BaseException:
        for t, b, had in reversed(moved):
            if t.exists():
                shutil.rmtree(t)
            if had:
                os.rename(b, t)
        raise
    finally:
        for path in (*stages, *backs):
            shutil.rmtree(path, ignore_errors=True)


def sealed(split: str) -> None:
    """Only the validation split may be evaluated."""
    if split != "validation":
        raise ValueError("the test split is sealed")
