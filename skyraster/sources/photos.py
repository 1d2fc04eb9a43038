"""Photo pixels: Spark's own image reader, as the tables that projection wants."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyraster.functions import photo

EXTENSIONS = (".jpg", ".jpeg", ".tif", ".tiff", ".png")


def read_photos(spark: SparkSession, path: str) -> DataFrame:
    """(site, path, h, w, data): site is the file name, data is RGB; unreadable files are left out."""
    images = spark.read.format("image").option("dropInvalid", True).load(path).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data")

    def rgb(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for h, w, n, data in zip(b["height"], b["width"], b["nChannels"], b["data"], strict=True):
                pixels = np.frombuffer(data, np.uint8).reshape(h, w, n)
                out.append((np.repeat(pixels, 3, axis=2) if n == 1 else pixels[:, :, 2::-1]).tobytes())  # stored blue first
            yield pd.DataFrame({"path": b["origin"], "h": b["height"], "w": b["width"], "data": out})

    rows = images.mapInPandas(rgb, "path string, h int, w int, data binary")
    return rows.select(photo.file_name().alias("site"), "path", "h", "w", "data")


def find_photos(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the photo files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")
    return files.where(F.lower(F.regexp_extract("path", r"\.[^./]+$", 0)).isin(*EXTENSIONS))


def camera_set(plain: DataFrame, undistorted: DataFrame | None) -> DataFrame:
    """Views by name, the undistorted ones where there are any."""
    if undistorted is None or undistorted.isEmpty():
        return plain
    return undistorted


def image_sizes(photos: DataFrame) -> DataFrame:
    return photos.select("site", F.col("w").alias("width"), F.col("h").alias("height"))
