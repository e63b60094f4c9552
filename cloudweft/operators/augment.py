"""Augmentation of clouds by keyed random numbers: the same seed gives the same clouds, without a shuffle."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keyed import gaussian, uniform
from .order import ranked

XYZ, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")


def _u(seed: int, salt: int) -> Column:
    return uniform(F.col("cloud_id"), 0, seed, salt)


def _angle(seed: int) -> Column:
    return _u(seed, 0) * (2 * math.pi)


def _turn_y(pts: DataFrame, a: Column, cols: Sequence[str] = XYZ) -> DataFrame:
    x, z = F.col(cols[0]), F.col(cols[2])
    return pts.withColumns({cols[0]: x * F.cos(a) - z * F.sin(a), cols[2]: x * F.sin(a) + z * F.cos(a)})


def rotate_y(pts: DataFrame, seed: int = 0) -> DataFrame:
    """Each cloud turned about y by its own random angle: x' = x cos - z sin, z' = x sin + z cos."""
    return _turn_y(pts, _angle(seed))


def rotate_y_by(pts: DataFrame, angle: float) -> DataFrame:
    return _turn_y(pts, F.lit(float(angle)))


def rotate_z(pts: DataFrame, seed: int = 0) -> DataFrame:
    """Each cloud turned about z: x' = x cos - y sin, y' = x sin + y cos."""
    a, x, y = _angle(seed), F.col("x"), F.col("y")
    return pts.withColumns({"x": x * F.cos(a) - y * F.sin(a), "y": x * F.sin(a) + y * F.cos(a)})


def rotate_with_normals(pts: DataFrame, angle: float | None = None, seed: int = 0) -> DataFrame:
    """Points and normals turned about y together, by a given angle or each cloud's random one."""
    a = _angle(seed) if angle is None else F.lit(float(angle))
    return _turn_y(_turn_y(pts, a), a, NORMAL)


def perturb_rotation(pts: DataFrame, sigma: float = 0.06, clip: float = 0.18, normals: bool = False, seed: int = 0) -> DataFrame:
    """Each cloud (and its normals) times Rz Ry Rx of three small normal angles, cut at ``clip``."""
    a = [F.greatest(F.least(gaussian(F.col("cloud_id"), 0, seed, k) * sigma, F.lit(clip)), F.lit(-clip)) for k in range(3)]
    pts = pts.withColumns({f"__{n}{k}": f(a[k]) for k in range(3) for n, f in (("c", F.cos), ("s", F.sin))})
    (cx, sx), (cy, sy), (cz, sz) = [(F.col(f"__c{k}"), F.col(f"__s{k}")) for k in range(3)]
    m = [
        [cy * cz, sx * sy * cz - cx * sz, cx * sy * cz + sx * sz],
        [cy * sz, sx * sy * sz + cx * cz, cx * sy * sz - sx * cz],
        [-sy, sx * cy, cx * cy],
    ]
    for cols in (XYZ, NORMAL) if normals else (XYZ,):
        pts = pts.withColumns({c: F.col(cols[0]) * m[0][k] + F.col(cols[1]) * m[1][k] + F.col(cols[2]) * m[2][k] for k, c in enumerate(cols)})
    return pts.drop(*[f"__{n}{k}" for k in range(3) for n in "cs"])


def jitter(pts: DataFrame, sigma: float = 0.01, clip: float = 0.05, seed: int = 0) -> DataFrame:
    """Every coordinate moved by a normal number times ``sigma``, cut at ``clip`` (above 0)."""
    if clip <= 0:
        raise ValueError("clip must be above 0")
    noise = [gaussian(F.col("cloud_id"), F.col("point_idx"), seed, k) * sigma for k in range(3)]
    return pts.withColumns({c: F.col(c) + F.greatest(F.least(n, F.lit(clip)), F.lit(-clip)) for c, n in zip(XYZ, noise)})


def random_shift(pts: DataFrame, r: float = 0.1, seed: int = 0) -> DataFrame:
    """Each cloud moved by a vector uniform in (-r, r)^3."""
    return pts.withColumns({c: F.col(c) + (_u(seed, k) * (2 * r) - r) for k, c in enumerate(XYZ)})


def random_scale(pts: DataFrame, lo: float = 0.8, hi: float = 1.25, seed: int = 0) -> DataFrame:
    """Each cloud times a number uniform in (lo, hi)."""
    s = _u(seed, 0) * (hi - lo) + lo
    return pts.withColumns({c: F.col(c) * s for c in XYZ})


def point_dropout(pts: DataFrame, max_ratio: float = 0.875, seed: int = 0) -> DataFrame:
    """Points whose number is at most the cloud's ratio (uniform up to ``max_ratio``) are replaced by its first point."""
    ratio = _u(seed, 0) * max_ratio
    gone = uniform(F.col("cloud_id"), F.col("point_idx"), seed, 1) <= ratio
    first = pts.groupBy("cloud_id").agg(F.min_by(F.struct(*XYZ), "point_idx").alias("__first"))
    return pts.join(first, "cloud_id").withColumns({c: F.when(gone, F.col(f"__first.{c}")).otherwise(F.col(c)) for c in XYZ}).select(*pts.columns)


def noise_points(pts: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """floor(N * ratio) indices, the same for all clouds (of one size), replaced by points uniform in (-1, 1)^3."""
    if not 0 <= ratio < 1:
        raise ValueError("ratio must be in [0, 1)")
    order = pts.select("point_idx").distinct().withColumn("__u", uniform(F.lit(0), F.col("point_idx"), seed, 0))
    places = ranked(order, "__u", "point_idx", name="__k")
    n = places.agg(F.count("*").alias("__n"))
    noisy = places.join(F.broadcast(n)).filter(F.col("__k") < F.floor(F.col("__n") * ratio)).select("point_idx", F.lit(True).alias("__noise"))
    both = pts.join(noisy, "point_idx", "left")
    u = [uniform(F.col("cloud_id"), F.col("point_idx"), seed, k + 1) * 2 - 1 for k in range(3)]
    return both.withColumns({c: F.when(F.col("__noise"), v).otherwise(F.col(c)) for c, v in zip(XYZ, u)}).drop("__noise")


#: The chains that training runs use, by task.
CHAINS: dict[str, Callable[[int], list]] = {
    "classification": lambda seed: [partial(point_dropout, seed=seed), partial(random_scale, seed=seed + 1), partial(random_shift, seed=seed + 2)],
    "part_segmentation": lambda seed: [partial(random_scale, seed=seed + 1), partial(random_shift, seed=seed + 2)],
    "scene_segmentation": lambda seed: [partial(rotate_z, seed=seed)],
}


def augment(pts: DataFrame, steps: str | Sequence[Callable[[DataFrame], DataFrame]] = "classification", seed: int = 0) -> DataFrame:
    """The named chain, or the given steps, one after the other."""
    for step in CHAINS[steps](seed) if isinstance(steps, str) else steps:
        pts = pts.transform(step)
    return pts
