"""Named images with ground truth, and where results go.

An image is a Parquet table ``(r, c, channels or x array<double>, label)``; labels are
stored from 1 with 0 unlabelled and read from 0 with -1 unlabelled.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tangentia.operators import evaluation, images


@dataclass(frozen=True)
class ImageInfo:
    name: str
    bands: int
    resolution: tuple[float, float] = (1.0, 1.0)


#: Bands of the public hyperspectral scenes.
REGISTRY = {"Pavia": ImageInfo("Pavia", 103), "Indian_Pines": ImageInfo("Indian_Pines", 200), "Salinas": ImageInfo("Salinas", 204)}


class Dataset:
    """A named image below ``root``, as ``<root>/<name>.parquet``."""

    def __init__(self, name: str, root: str):
        if name not in REGISTRY:
            raise NotImplementedError(f"no image is called {name!r}")
        self.info, self.path = REGISTRY[name], f"{root}/{name}.parquet"
        self.channels = [f"b{i}" for i in range(self.info.bands)]

    def load(self, spark: SparkSession, crop: bool = False, border: int = 0, center: str | None = "column", bands: int | None = None, crop_size: int = 30) -> DataFrame:
        """Pixels ``(r, c, channels, label)``: cropped, border labels blanked, centred, reduced by PCA, as asked."""
        raw = spark.read.parquet(self.path)
        if "x" in raw.columns:
            raw = raw.select("r", "c", *[F.get("x", F.lit(i)).alias(b) for i, b in enumerate(self.channels)], "label")
        return prepare(raw, self.channels, crop, border, center, bands, crop_size)


def prepare(pixels: DataFrame, channels: list[str], crop: bool = False, border: int = 0, center: str | None = "column", bands: int | None = None, crop_size: int = 30) -> DataFrame:
    """The steps of loading, on any pixels with labels stored from 1."""
    pixels = pixels.withColumn("label", F.col("label") - 1)
    height, width = images.extent(pixels) if crop or border else (0, 0)
    if crop:
        pixels = images.crop_center(pixels, height, width, crop_size)
        height, width = min(height, crop_size), min(width, crop_size)
    if border:
        pixels = images.blank_border(pixels, height, width, border)
    if center:
        pixels = images.remove_mean(pixels, channels, center)
    return images.pca(pixels, channels, bands) if bands else pixels


def save_segmentation(labels: DataFrame, path: str) -> None:
    """Write ``(r, c, k)`` as Parquet."""
    labels.select("r", "c", "k").write.mode("overwrite").parquet(path)


def evaluate_and_save(labels: DataFrame, truth: DataFrame, path: str, normalize: bool = False) -> dict[str, float]:
    """Write ``(r, c, k)`` with clusters renamed to the classes they match, and return the scores.

    ``truth`` has ``(r, c, label)``; pixels without a label count for nothing.
    """
    rows = labels.join(truth.select("r", "c", F.col("label").alias("gt")), ["r", "c"], "left").withColumn("gt", F.coalesce("gt", F.lit(-1)))
    named = evaluation.assign(rows, "k", "gt", normalize, out="k")
    save_segmentation(named, path)
    return evaluation.evaluate(rows, "k", "gt", normalize)


def result_path(root: str, name: str, now: dt.datetime | None = None) -> str:
    """``<root>/results/<name>/<time>``, for a run's outputs."""
    return f"{root}/results/{name}/{(now or dt.datetime.now()):%Y-%m-%d_%H-%M-%S}"
