"""The processing stages over a survey's tables, and their runner.

External engines are not rebuilt: align and dense take their output (sparse model tables, a dense
cloud) or, without it, a simulation. Every stage reads and writes tables by name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.functions import geo, photo
from skyraster.operators import cloud, control, grid, ml, morph, ortho, terrain
from skyraster.plans.tables import cut
from skyraster.schema import RasterMeta
from skyraster.sources import text_models
from skyraster.sources.project import Survey


class StageError(RuntimeError):
    pass


@dataclass
class Run:
    spark: SparkSession
    survey: Survey
    tables: dict[str, DataFrame] = field(default_factory=dict)
    grids: dict[str, RasterMeta] = field(default_factory=dict)
    sim: control.Similarity | None = None
    log: Callable[[str], None] = print
    cancelled: Callable[[], bool] = lambda: False

    def need(self, *names: str) -> DataFrame:
        """The first of the tables that is there."""
        for n in names:
            if n in self.tables:
                return self.tables[n]
        raise StageError(f"run an earlier stage first: no {' or '.join(names)}")


def align(run: Run) -> None:
    cams = run.need("cameras").where("enabled")
    if cams.isEmpty():
        raise StageError("no enabled photos")
    stats = run.survey.stats
    stats["cameras_total"] = cams.count()
    if "poses" in run.tables:
        views = cut(control.solved(run.tables["poses"], cams, run.need("intrinsics")), "views")
        run.tables["views"] = views
        stats |= {"cameras_aligned": views.count(), "align_engine": "model", "mean_reproj_px": run.tables["tie_points"].agg(F.avg("err")).first()[0] if "tie_points" in run.tables else None}
    else:
        # Without an engine: cameras keep their position or get one from a hash, as a rehearsal.
        spread = lambda k, size: F.pmod(F.xxhash64("cam_id", F.lit(k)), F.lit(100_000)) / 100_000 * size
        placed = run.tables["cameras"].withColumn("est_x", F.coalesce("est_x", spread(1, 200.0))).withColumn("est_y", F.coalesce("est_y", spread(2, 200.0))).withColumn("est_z", F.coalesce("est_z", 60 + spread(3, 5.0)))
        run.tables["cameras"] = cut(placed.withColumn("aligned", F.col("enabled")), "cameras")
        stats |= {"cameras_aligned": stats["cameras_total"], "align_engine": "simulation"}


def georef(run: Run) -> None:
    stats, cams = run.survey.stats, run.need("cameras")
    epsg = run.survey.epsg if run.survey.crs_mode != "local" else None
    pairs = None
    if "views" in run.tables and "observations" in run.tables:
        views = run.tables["views"].withColumns(control.projection_columns())
        found = control.triangulate(control.rays(run.tables["observations"], views))
        world = run.need("gcps").where("enabled").select("gcp_id", "is_check", F.col("x").alias("dx"), F.col("y").alias("dy"), F.col("z").alias("dz"))
        pairs = cut(found.select("gcp_id", *[F.col(c).alias(f"s{c}") for c in "xyz"]).join(world, "gcp_id"), "control-pairs")
    if pairs is not None and pairs.where("not is_check").count() >= 3:
        run.sim = control.fit_similarity(pairs.where("not is_check"))
        found = control.residuals(pairs, run.sim)
        errors = {r.is_check: r for r in control.rmse(found, "is_check").collect()}  # two rows
        stats |= {"georef_method": "gcp", "control_rmse_m": errors[False].rmse, "gcp_control": errors[False].n, "gcp_check": errors[True].n if True in errors else 0}
        stats["georef_rmse_xyz_m"] = [errors[False][f"rmse_{c}"] for c in "xyz"]
        by_id = found.select("gcp_id", F.col("error").alias("_error"))
        run.tables["gcps"] = cut(run.tables["gcps"].join(control.small(by_id), "gcp_id", "left").withColumn("error", F.coalesce("_error", "error")).drop("_error"), "gcps")
        if True in errors:
            stats["check_rmse_m"] = errors[True].rmse
    else:
        x, y = geo.forward("lon", "lat", epsg)
        tagged = cams.where(photo.has_geotag()).select("cam_id", x.alias("dx"), y.alias("dy"), F.coalesce("alt", F.lit(0.0)).alias("dz"), *[F.col(f"est_{c}").alias(f"s{c}") for c in "xyz"])
        if "views" in run.tables:
            centre = run.tables["views"].select("cam_id", F.col("cx").alias("sx"), F.col("cy").alias("sy"), F.col("cz").alias("sz"))
            tagged = tagged.drop("sx", "sy", "sz").join(centre, "cam_id")
        tagged = cut(tagged.where("sx is not null"), "gps-pairs")
        if tagged.limit(3).count() < 3:
            raise StageError("georeferencing needs three control points or geotagged photos")
        run.sim = control.fit_similarity(tagged)
        fit = control.rmse(control.residuals(tagged, run.sim)).first()
        stats |= {"georef_method": "gps", "georef_rmse_m": fit.rmse, "georef_rmse_xyz_m": [fit[f"rmse_{c}"] for c in "xyz"]}
    if "views" in run.tables:
        _place(run)
    run.survey.optimized = True


def _place(run: Run) -> None:
    """World positions of the solved cameras: by the similarity, then by bundle adjustment if there are marks and tracks for it."""
    x, y, z = run.sim.columns("cx", "cy", "cz")
    at = run.tables["views"].select("cam_id", x.alias("_x"), y.alias("_y"), z.alias("_z"))
    if all(t in run.tables for t in ("tracks", "tie_points", "observations", "gcps")):
        try:
            found = control.refine(run.tables["views"], run.tables["tie_points"], run.tables["tracks"], run.tables["gcps"], run.tables["observations"], run.sim)
        except np.linalg.LinAlgError as problem:  # the fit stands without it
            run.log(f"no bundle adjustment: {problem}")
            found = None
        if found is not None:
            stats = run.survey.stats
            stats |= {"ba_rmse_px": found.rmse_after, "ba_rmse_before_px": found.rmse_before, "ba_observations": found.n_obs}
            if found.lens is not None:
                stats["calibration"] = dict(zip(("focal_px", "cx", "cy", "k1"), map(float, found.lens), strict=True)) | {"source": "bundle adjustment"}
            at = run.spark.createDataFrame([(k, *map(float, p)) for k, p in found.centres.items()], "cam_id long, _x double, _y double, _z double")
    moved = run.need("cameras").join(control.small(at), "cam_id", "left")
    moved = moved.withColumns({f"est_{c}": F.coalesce(F.col(f"_{c}"), F.col(f"est_{c}")) for c in "xyz"}).drop("_x", "_y", "_z")
    run.tables["cameras"] = cut(moved, "cameras")


def dense(run: Run) -> None:
    if "dense_local" in run.tables:
        points = run.tables["dense_local"]
        points = run.sim.apply(points) if run.sim is not None else points
        points = cloud.thin(points, run.survey.settings.dense_target_density)
    else:
        points = ml.scene(run.spark, [7]).drop("seed", "cls")
    run.tables["dense"] = cut(points.withColumn("cls", F.lit(1)), "dense")
    e = grid.extent(run.tables["dense"]).first()
    run.survey.stats |= {"dense_points": e.n, "dense_density_ppm2": e.n / max((e.maxx - e.minx) * (e.maxy - e.miny), 1e-6)}


def mesh(run: Run) -> None:
    if "engine_obj" in run.tables:  # lines of a textured mesh: moved into the survey's system, with a round offset
        lines = run.tables["engine_obj"]
        first = text_models.first_vertex(lines).first()
        if first is None:
            raise StageError("the mesh has no vertices")
        at = run.spark.createDataFrame([first])
        x, y, z = run.sim.columns() if run.sim is not None else (F.col("x"), F.col("y"), F.col("z"))
        offset = tuple(map(float, at.select(x.alias("x"), y.alias("y"), z.alias("z")).select(*terrain.offset(F.col("x"), F.col("y"))).first()))
        run.tables["mesh_lines"] = cut(text_models.transform_obj(lines, run.sim, offset), "mesh-lines")
        counts = text_models.obj_counts(run.tables["mesh_lines"]).first()
        run.survey.stats |= {"mesh_vertices": counts.vertices, "mesh_faces": counts.faces, "mesh_offset": list(offset), "mesh_engine": "model"}
        return
    points = run.need("dense")
    e = grid.extent(points).first()
    cell = max(max(e.maxx - e.minx, e.maxy - e.miny) / 400, 0.05)
    run.tables["mesh_vertices"], run.tables["mesh_faces"] = terrain.heightfield(points, cell)
    run.survey.stats |= {"mesh_vertices": run.tables["mesh_vertices"].count(), "mesh_faces": run.tables["mesh_faces"].count()}


def classify(run: Run) -> None:
    points, model = run.need("dense"), run.tables.get("_model")
    use_model = run.survey.settings.classifier == "ml" and model is not None
    run.tables["classified"] = cut(ml.predict(model, points) if use_model else cloud.classify(points), "classified")
    run.survey.stats["class_counts"] = {str(r.cls): r.n for r in cloud.histogram(run.tables["classified"]).collect()}


def _cell(run: Run, points: DataFrame, kind: str) -> float:
    s = run.survey.settings
    mode, custom = (s.ortho_gsd_mode, s.ortho_gsd) if kind == "ortho" else (s.surface_gsd_mode, s.surface_gsd)
    ground = cloud.ground_height(points).first().ground_z if run.survey.optimized else None
    gsd = photo.median_gsd(run.tables["cameras"], ground).first().gsd if "cameras" in run.tables else None
    if gsd:
        run.survey.stats["image_gsd_m"] = gsd
    return grid.target_cell(points, gsd, mode, custom, s.max_raster_dim)


def _surface(run: Run, points: DataFrame, name: str, how: str) -> None:
    cell = _cell(run, points, "surface")
    native = grid.plan(points, grid.native_cell(points, cell))
    filled = cut(grid.native(points, native, how), name)
    target = grid.plan(points, cell)
    run.grids[name] = target
    run.tables[name] = cut(grid.bilinear(filled, native, target, run.survey.z_offset()), name)
    run.survey.stats[name] = {"w": target.nx, "h": target.ny, "gsd_m": cell}


def dsm(run: Run) -> None:
    _surface(run, cloud.drop_noise(run.need("classified", "dense")), "dsm", "max")


def dtm(run: Run) -> None:
    ground = run.need("classified").where("cls = 2")
    if ground.isEmpty():
        raise StageError("no ground points")
    _surface(run, ground, "dtm", "min")


def orthomosaic(run: Run) -> None:
    points = cloud.drop_noise(run.need("classified", "dense"))
    target = grid.plan(points, _cell(run, points, "ortho"))
    run.grids["ortho"] = target
    if "site_views" in run.tables and "photos" in run.tables and run.sim is not None:
        ground = points.where("cls = 2")
        frame = (target.minx, target.maxy - (target.ny - 1) * target.cell, target.minx + (target.nx - 1) * target.cell, target.maxy)
        surface, meta = morph.projection_surface(points if ground.isEmpty() else ground, grid.native_cell(points, target.cell), frame)
        if not ground.isEmpty():
            surface = cut(morph.gaussian(surface, meta, 2.0), "smooth-ground")
        gains = ortho.estimate_gains(points, run.tables["site_views"], run.tables["photos"], run.sim)
        out = ortho.true_ortho(surface, meta, target, run.tables["site_views"], run.tables["photos"], run.sim, gains)
        engine = "true"
    else:
        native = grid.plan(points, grid.native_cell(points, target.cell))
        colors = cut(ortho.splat(points, native), "splat")
        out = grid.scaffold(run.spark, target)
        for c in ("red", "green", "blue"):
            band = grid.bilinear(colors.select("row", "col", F.col(c).alias("value")), native, target)
            out = out.join(band.select("row", "col", F.least(F.greatest(F.rint("value"), F.lit(0.0)), F.lit(255.0)).cast("int").alias(c)), ["row", "col"])
        out, engine = out.withColumn("alpha", F.lit(255)), "splat"
    run.tables["ortho"] = cut(out, "ortho")
    stats = {"w": target.nx, "h": target.ny, "gsd_m": target.cell, "engine": engine}
    if engine == "true":
        covered = run.tables["ortho"].where("alpha > 0").count()
        stats |= {"cameras": run.tables["site_views"].select("site").distinct().count(), "blend_views": 2, "coverage_pct": round(100 * covered / (target.nx * target.ny), 1)}
    run.survey.stats["ortho"] = stats


STAGES: dict[str, Callable[[Run], None]] = {"align": align, "georef": georef, "dense": dense, "mesh": mesh, "classify": classify, "dsm": dsm, "dtm": dtm, "ortho": orthomosaic}


def plan(survey: Survey) -> list[str]:
    """The stages of a full run; the mesh only where settings ask for it."""
    return [k for k in STAGES if k != "mesh" or survey.settings.build_mesh]


def execute(run: Run, stages: list[str] | None = None) -> tuple[bool, str]:
    """Run stages in order; stop at the first failure. Each is a job group that can be cancelled."""
    seconds = run.survey.stats.setdefault("stage_seconds", {})
    for name in stages if stages is not None else plan(run.survey):
        if name not in STAGES:
            return False, f"unknown stage {name}"
        if run.cancelled():
            return False, "cancelled"
        run.spark.sparkContext.setJobGroup(f"skyraster-{name}", name, interruptOnCancel=True)
        began = time.time()
        try:
            STAGES[name](run)
        except Exception as problem:  # a stage's failure is a result, not a crash
            run.log(f"{name}: {problem}")
            return False, f"{name}: {problem}"
        finally:
            for key in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
                run.spark.sparkContext.setLocalProperty(key, None)
        seconds[name] = round(time.time() - began, 3)
    return True, ""
