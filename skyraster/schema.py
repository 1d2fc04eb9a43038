"""Data model: schemas of the tables, raster geometry and processing settings."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

CAMERAS = (
    "cam_id long, path string, width int, height int, make string, model string, datetime string, focal_mm double, focal35_mm double,"
    " lat double, lon double, alt double, rel_alt double, yaw double, pitch double, roll double,"
    " est_x double, est_y double, est_z double, aligned boolean, enabled boolean"
)
GCPS = "gcp_id long, label string, x double, y double, z double, is_check boolean, enabled boolean, accuracy double, error double"
OBSERVATIONS = "gcp_id long, cam_id long, px double, py double"
POINTS = "pt_id long, x double, y double, z double, r short, g short, b short, cls byte"
RASTER = "band int, row long, col long, value double"
POSES = "name string, qw double, qx double, qy double, qz double, tx double, ty double, tz double, cx double, cy double, cz double, camera_id long"
INTRINSICS = "camera_id long, fx double, fy double, cx double, cy double"
TRACKS = "name string, pid long, u double, v double"
TIE_POINTS = "pid long, x double, y double, z double, r int, g int, b int, err double"

# Point classes with their display colours.
CLASSES = [
    (0, "Never classified", 170, 170, 170),
    (1, "Unclassified", 200, 200, 200),
    (2, "Ground", 160, 110, 60),
    (3, "Low vegetation", 120, 200, 120),
    (4, "Medium vegetation", 70, 170, 70),
    (5, "High vegetation", 30, 130, 30),
    (6, "Building", 210, 120, 90),
    (7, "Noise", 230, 60, 180),
    (9, "Water", 70, 140, 220),
    (17, "Bridge deck", 200, 200, 90),
]

# Sensor widths in mm by a part of the lower-case camera name, in order of search.
SENSORS = [
    ("m3e", 17.3),
    ("m3t", 6.4),
    ("m3m", 17.3),
    ("mavic 3", 17.3),
    ("fc220", 6.17),
    ("fc300", 6.17),
    ("fc330", 6.17),
    ("fc6310", 13.2),
    ("fc6360", 13.2),
    ("fc7303", 6.17),
    ("zenmusep1", 35.9),
    ("p1", 35.9),
    ("l1", 8.8),
    ("l2", 17.3),
    ("fc3411", 13.2),
    ("fc3170", 6.4),
    ("evo ii", 13.2),
    ("xt701", 13.2),
    ("anafi", 7.22),
    ("wingtraone", 23.5),
    ("aeria x", 23.5),
]


@dataclass(frozen=True)
class RasterMeta:
    """A north-up grid: row 0 is the north edge, cells are square."""

    minx: float
    maxy: float
    cell: float
    nx: int
    ny: int
    epsg: int | None = None
    nodata: float | None = None

    @property
    def maxx(self) -> float:
        return self.minx + self.nx * self.cell

    @property
    def miny(self) -> float:
        return self.maxy - self.ny * self.cell


@dataclass(frozen=True)
class Settings:
    """Processing settings of a survey; ``check`` enforces the ranges of the options dialog."""

    ortho_gsd_mode: str = "auto"
    ortho_gsd: float = 0.05
    surface_gsd_mode: str = "auto"
    surface_gsd: float = 0.05
    max_raster_dim: int = 20000
    dense_quality: str = "high"
    dense_target_density: float = 0
    classifier: str = "rules"
    sfm_max_features: int = 8192
    build_mesh: bool = False
    mesh_max_faces: int = 2_000_000

    @classmethod
    def from_dict(cls, values: dict) -> Settings:
        """Unknown keys are dropped."""
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in values.items() if k in known})

    def to_dict(self) -> dict:
        return asdict(self)

    def check(self) -> Settings:
        limits = {"ortho_gsd": (0.005, 10), "surface_gsd": (0.005, 10), "max_raster_dim": (2000, 100_000), "dense_target_density": (0, 100_000),
                  "sfm_max_features": (1024, 65_536), "mesh_max_faces": (0, 50_000_000)}
        for name, (low, high) in limits.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie in {low}..{high}")
        return self
