"""Runs on disk: versions of a run's tables, grids and similarity, of which one is current.

A version's tables are written first, then its manifest, then the file ``current`` names it: a save
that breaks off leaves the version before it current. Saves side by side take different versions.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict

from pyspark.sql import SparkSession

from skyraster.operators.control import similarity_from
from skyraster.plans.pipeline import Run
from skyraster.schema import RasterMeta
from skyraster.sources import files
from skyraster.sources.project import Survey


def _read(spark: SparkSession, path: str) -> dict:
    where = files.local(path)
    if where is not None:
        with open(where, encoding="utf-8") as f:
            return json.load(f)
    return json.loads(files.Store(spark, path).read(path))


def _exists(spark: SparkSession, path: str) -> bool:
    return files.Store(spark, path).exists(path)


def save(run: Run, folder: str) -> str:
    """Write a run as a new version and make it the current one; returns the version. Models (names with _) stay out."""
    spark, version = run.spark, uuid.uuid4().hex
    names = [n for n in run.tables if not n.startswith("_")]
    for name in names:
        run.tables[name].write.parquet(f"{folder}/{version}/{name}")
    sim = None if run.sim is None else [run.sim.s, *run.sim.R.reshape(-1).tolist(), *run.sim.t.tolist()]
    before = _read(spark, f"{folder}/current")["version"] if _exists(spark, f"{folder}/current") else None
    manifest = {"version": version, "before": before, "tables": names, "schemas": {n: run.tables[n].schema.jsonValue() for n in names}, "grids": {n: asdict(m) for n, m in run.grids.items()}, "similarity": sim, "survey": run.survey.to_dict()}
    files.write(spark, f"{folder}/{version}/manifest.json", json.dumps(manifest).encode())
    files.write(spark, f"{folder}/current", json.dumps({"version": version}).encode())
    return version


def versions(spark: SparkSession, folder: str) -> list[str]:
    """Versions from the current one back."""
    out: list[str] = []
    version = _read(spark, f"{folder}/current")["version"] if _exists(spark, f"{folder}/current") else None
    while version is not None:
        out.append(version)
        version = _read(spark, f"{folder}/{version}/manifest.json")["before"]
    return out


def load(spark: SparkSession, folder: str, version: str | None = None) -> Run | None:
    """The current (or another) version of a run; None if there is none."""
    from pyspark.sql.types import StructType

    if version is None:
        if not _exists(spark, f"{folder}/current"):
            return None
        version = _read(spark, f"{folder}/current")["version"]
    found = _read(spark, f"{folder}/{version}/manifest.json")
    tables = {n: spark.read.schema(StructType.fromJson(found["schemas"][n])).parquet(f"{folder}/{version}/{n}") for n in found["tables"]}
    run = Run(spark, Survey.from_dict(found["survey"]), tables, {n: RasterMeta(**m) for n, m in found["grids"].items()})
    if found["similarity"] is not None:
        run.sim = similarity_from(found["similarity"])
    return run
