"""Surveys on disk: projects, similarities and product exports as JSON and files."""

from __future__ import annotations

import json
import os
import shutil
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster import schema
from skyraster.operators.control import Similarity, similarity_from

PRODUCTS = ("sparse_cloud", "dense_cloud", "classified_cloud", "mesh", "dsm", "dtm", "orthomosaic")


def _names(kind: str) -> list[str]:
    return [part.split()[0] for part in kind.split(",")]


@dataclass
class Survey:
    """One chunk of a project: small catalog rows and settings; products are paths."""

    name: str = "Chunk 1"
    cameras: list[dict] = field(default_factory=list)
    gcps: list[dict] = field(default_factory=list)
    observations: list[dict] = field(default_factory=list)
    crs_mode: str = "local"
    epsg: int | None = None
    vertical_datum: str = "ellipsoidal"
    geoid_separation: float = 0.0
    optimized: bool = False
    outputs: dict[str, str] = field(default_factory=dict)
    stats: dict = field(default_factory=dict)
    settings: schema.Settings = field(default_factory=schema.Settings)
    next_camera: int = 1
    next_gcp: int = 1

    def to_dict(self) -> dict:
        return {**{k: v for k, v in self.__dict__.items() if k != "settings"}, "settings": self.settings.to_dict()}

    @classmethod
    def from_dict(cls, values: dict) -> Survey:
        """Unknown settings are dropped; unknown camera, point or output keys are errors."""
        for rows, kind in ((values.get("cameras", []), schema.CAMERAS), (values.get("gcps", []), schema.GCPS), (values.get("observations", []), schema.OBSERVATIONS)):
            for row in rows:
                if odd := set(row) - set(_names(kind)):
                    raise ValueError(f"unknown keys: {sorted(odd)}")
        if odd := set(values.get("outputs", {})) - set(PRODUCTS):
            raise ValueError(f"unknown outputs: {sorted(odd)}")
        return cls(**{**values, "settings": schema.Settings.from_dict(values.get("settings", {}))})

    def table(self, spark: SparkSession, which: str) -> DataFrame:
        kind = {"cameras": schema.CAMERAS, "gcps": schema.GCPS, "observations": schema.OBSERVATIONS}[which]
        names = _names(kind)
        return spark.createDataFrame([tuple(row.get(n) for n in names) for row in getattr(self, which)], kind)

    def z_offset(self) -> float:
        """What heights lose on the way to an orthometric product."""
        return self.geoid_separation if self.vertical_datum == "orthometric" else 0.0


def save(path: str, surveys: list[Survey], active: int = 0) -> None:
    text = json.dumps({"format": 1, "app": "skyraster", "active": active, "chunks": [s.to_dict() for s in surveys]}, indent=2)
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(f"{path}.part", path)


def load(path: str) -> tuple[list[Survey], int]:
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    return [Survey.from_dict(c) for c in doc.get("chunks", [])] or [Survey()], doc.get("active", 0)


def project_rows(spark: SparkSession, path: str) -> DataFrame:
    """A project file as one row a chunk."""
    return spark.read.json(path, multiLine=True).select(F.explode("chunks").alias("c")).select("c.*")


def save_similarity(path: str, sim: Similarity, method: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"s": sim.s, "R": sim.R.reshape(-1).tolist(), "t": sim.t.tolist(), "method": method}, f)


def load_similarity(path: str) -> tuple[Similarity, str] | None:
    """None if the file is missing or broken."""
    try:
        with open(path, encoding="utf-8") as f:
            doc = json.load(f)
        return similarity_from([doc["s"], *doc["R"], *doc["t"]]), doc.get("method", "")
    except (OSError, ValueError, KeyError, TypeError):
        return None


def export(outputs: dict[str, str], folder: str) -> list[tuple[str, str, str]]:
    """(product, path, problem) of every product copied to a folder; missing ones are left out."""
    os.makedirs(folder, exist_ok=True)
    done = []
    for name in PRODUCTS:
        path = outputs.get(name)
        if not path or not os.path.exists(path):
            continue
        try:
            target = os.path.join(folder, os.path.basename(path.rstrip("/")))
            if os.path.isdir(path):
                shutil.copytree(path, target, dirs_exist_ok=True)
            else:
                base = os.path.splitext(path)[0]
                for extra in [path] + [p for p in (f"{base}.mtl", f"{base}_offset.txt") if name == "mesh" and os.path.exists(p)]:
                    shutil.copy2(extra, folder)
            done.append((name, target, ""))
        except OSError as problem:
            done.append((name, "", str(problem)))
    return done


# External engines with the programs that show them.
ENGINES = [
    ("colmap", "COLMAP", ["colmap"]),
    ("openmvs", "OpenMVS", ["DensifyPointCloud"]),
    ("pdal", "PDAL", ["pdal"]),
    ("gdal", "GDAL", ["gdal_translate", "gdalwarp"]),
    ("odm", "OpenDroneMap", ["odm", "run.py"]),
]


def engines(spark: SparkSession) -> DataFrame:
    """(key, name, path, available) of the external engines on this machine."""
    rows = [(k, n, next((p for x in names if (p := shutil.which(x))), "")) for k, n, names in ENGINES]
    return spark.createDataFrame([(k, n, p, bool(p)) for k, n, p in rows], "key string, name string, path string, available boolean")
