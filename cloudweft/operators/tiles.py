"""Tiles of a bounded number of points each, whatever the density: runs of equal length along a space-filling curve."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import ranked

XYZ = ("x", "y", "z")
#: Steps of the curve each way are two to this, at each of two levels.
BITS = 21


def _spread(v: Column) -> Column:
    """Two zero bits after each of the ``BITS`` bits: groups of 16, 8, 4, 2 and 1 bits move apart in turn."""
    for g in (16, 8, 4, 2, 1):
        mask = sum(((1 << min(g, BITS - at)) - 1) << 3 * at for at in range(0, BITS, g))
        v = v.bitwiseOR(F.shiftleft(v, 2 * g)).bitwiseAND(mask)
    return v


def curve_places(lows: dict[str, Column], side: Column) -> list[Column]:
    """Place along a Z curve of the cube that starts at ``lows`` and is ``side`` wide, and along that of the step that it falls into."""
    at = {c: F.when(side > 0, (F.col(c) - lows[c]) / side * ((1 << BITS) - 1)).otherwise(F.lit(0.0)) for c in XYZ}
    steps = [{c: F.floor(v) for c, v in at.items()}, {c: F.floor((v - F.floor(v)) * (1 << BITS)) for c, v in at.items()}]
    return [reduce(lambda x, y: x.bitwiseOR(y), [F.shiftleft(_spread(s[c].cast("bigint")), k) for k, c in enumerate(XYZ)]) for s in steps]


def tiled(pts: DataFrame, size: int = 1024, most: int = 16_384, more: Sequence[str] = ()) -> DataFrame:
    """(cloud_id, point_idx, x, y, z, ``more``, tile, tiles): each cloud cut into ``tiles`` runs along its curve.

    A tile has ``size`` points, or more where a cloud would have more than ``most`` tiles. Points are put in order by ranges, so no
    task sees a whole cloud; equal positions are told apart by their index.
    """
    rows = pts.select("cloud_id", "point_idx", *XYZ, *more)
    box = rows.groupBy("cloud_id").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{c}") for c in XYZ for name, f in (("lo", F.min), ("hi", F.max))])
    side = F.greatest(*[F.col(f"hi{c}") - F.col(f"lo{c}") for c in XYZ])
    placed = rows.join(box, "cloud_id")
    curve, finer = curve_places({c: F.col(f"lo{c}") for c in XYZ}, side)
    placed = placed.select(*rows.columns, "n", curve.alias("curve"), finer.alias("finer"))
    placed = ranked(placed, "cloud_id", "curve", "finer", "point_idx", name="at")
    first = placed.groupBy("cloud_id").agg(F.min("at").alias("first"))
    each = F.greatest(F.lit(size), F.ceil(F.col("n") / most))
    return placed.join(first, "cloud_id").select(*rows.columns, F.floor((F.col("at") - F.col("first")) / each).cast("int").alias("tile"), F.ceil(F.col("n") / each).cast("int").alias("tiles"))
