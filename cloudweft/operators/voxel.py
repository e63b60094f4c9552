"""Voxel averages: one mean per occupied cell, by plain aggregates with map-side combine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def voxel_average_trunc(pts: DataFrame, size: float, limit: int | None = None) -> DataFrame:
    """(cloud_id, place, x, y, z): means of cells int(p / size), which truncates (cells beside 0 are twice as wide).

    ``place`` orders the cells of a cloud by their first point; ``limit`` keeps the first so many.
    """
    cells = [(F.col(c) / size).cast("long").alias(f"i{c}") for c in XYZ]
    means = pts.groupBy("cloud_id", *cells).agg(*[F.avg(c).alias(c) for c in XYZ], F.min("point_idx").alias("__first"))
    ranked = means.withColumn("place", F.row_number().over(Window.partitionBy("cloud_id").orderBy("__first")) - 1)
    out = ranked.select("cloud_id", "place", *XYZ)
    return out if limit is None else out.filter(F.col("place") < limit)


def voxel_down_sample(pts: DataFrame, size: float) -> DataFrame:
    """(cloud_id, ix, iy, iz, n, x, y, z): means of floor cells; the grid starts half a cell below the cloud's least corner."""
    origin = pts.groupBy("cloud_id").agg(*[(F.min(c) - size / 2).alias(f"o{c}") for c in XYZ])
    cells = pts.join(origin, "cloud_id").select("cloud_id", *XYZ, *[F.floor((F.col(c) - F.col(f"o{c}")) / size).alias(f"i{c}") for c in XYZ])
    return cells.groupBy("cloud_id", *[f"i{c}" for c in XYZ]).agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in XYZ])


def sweep_down_sample(pts: DataFrame, sizes: Sequence[float] = (), strides: Sequence[int] = ()) -> DataFrame:
    """(method, setting, cloud_id, n_points): points that each cell size and each every-k stride keeps of each cloud.

    Every point meets every setting in one pass; the settings are the caller's few numbers.
    """
    settings = F.explode(F.array(*[F.struct(F.lit("voxel").alias("method"), F.lit(float(s)).alias("setting")) for s in sizes], *[F.struct(F.lit("every").alias("method"), F.lit(float(k)).alias("setting")) for k in strides]))
    origin = pts.groupBy("cloud_id").agg(*[F.min(c).alias(f"o{c}") for c in XYZ])
    rows = pts.join(origin, "cloud_id").withColumn("s", settings).select("cloud_id", "point_idx", "s.method", "s.setting", *XYZ, "ox", "oy", "oz")
    at = [F.when(F.col("method") == "voxel", F.floor((F.col(c) - (F.col(f"o{c}") - F.col("setting") / 2)) / F.col("setting"))).alias(f"i{c}") for c in XYZ]
    stride = F.when(F.col("method") == "every", F.col("point_idx"))
    kept = rows.filter((F.col("method") == "voxel") | (F.col("point_idx") % F.col("setting").cast("long") == 0))
    cells = kept.select("method", "setting", "cloud_id", *at, stride.alias("k")).distinct()
    return cells.groupBy("method", "setting", "cloud_id").agg(F.count("*").alias("n_points"))
