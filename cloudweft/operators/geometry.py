"""Per-cloud statistics, normalisation, rooms and boxes, volumes, rigid transforms, normals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from .catalog import EASY_VIEW, encode_class
from .in_task import MOST_PAIRS, each_cloud, large_clouds, nearest
from .order import ranked

XYZ = ("x", "y", "z")


def _sq(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c * c for c in cols])


def normalize_unit(pts: DataFrame) -> DataFrame:
    """Points minus their cloud's centroid, over its largest norm; null where that is 0. Both come from partial aggregates, one row a cloud."""
    centred = pts.join(pts.groupBy("cloud_id").agg(*[F.avg(c).alias(f"__{c}") for c in XYZ]), "cloud_id")
    centred = centred.withColumns({c: F.col(c) - F.col(f"__{c}") for c in XYZ}).select(*pts.columns)
    norm = centred.groupBy("cloud_id").agg(F.max(F.sqrt(_sq([F.col(c) for c in XYZ]))).alias("__m"))
    return centred.join(norm, "cloud_id").withColumns({c: F.try_divide(F.col(c), F.col("__m")) for c in XYZ}).select(*pts.columns)


def cloud_bounds(pts: DataFrame) -> DataFrame:
    """(cloud_id, min_*, max_*, extent, voxel_size): axis-aligned bounds, the largest extent and a thirtieth of it."""
    b = pts.groupBy("cloud_id").agg(*[f(c).alias(f"{n}_{c}") for c in XYZ for n, f in (("min", F.min), ("max", F.max))])
    extent = F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ])
    return b.withColumn("extent", extent).withColumn("voxel_size", F.col("extent") / 30)


def shift_to_origin(pts: DataFrame, by: str = "cloud_id") -> DataFrame:
    """Points minus the least corner of their room: a small aggregate joined back."""
    low = pts.groupBy(by).agg(*[F.min(c).alias(f"__{c}") for c in XYZ])
    return pts.join(low, by).withColumns({c: F.col(c) - F.col(f"__{c}") for c in XYZ}).drop(*[f"__{c}" for c in XYZ])


def collect_rooms(instances: DataFrame) -> DataFrame:
    """Annotated instances (cloud_id, instance_id, class_name, x, y, z, ...) as one labelled room each, shifted to its origin."""
    return shift_to_origin(encode_class(instances).withColumnRenamed("class_id", "label").drop("class_name"))


def instance_boxes(pts: DataFrame, instance: str = "instance_id") -> DataFrame:
    """(cloud_id, instance, label, x1..z2): bounds of each instance, from the room's least corner."""
    boxes = pts.groupBy("cloud_id", instance).agg(F.min("label").alias("label"), *[f(c).alias(f"{c}{k}") for c in XYZ for k, f in ((1, F.min), (2, F.max))])
    room = Window.partitionBy("cloud_id")
    low = boxes.withColumns({f"__{c}": F.min(f"{c}1").over(room) for c in XYZ})
    return low.withColumns({f"{c}{k}": F.col(f"{c}{k}") - F.col(f"__{c}") for c in XYZ for k in (1, 2)}).drop(*[f"__{c}" for c in XYZ])


def points_with_boxes(pts: DataFrame, instance: str = "instance_id") -> DataFrame:
    """Points shifted to the room's origin, with the offset to their instance's box centre and its half sizes."""
    box = pts.groupBy("cloud_id", instance).agg(*[f(c).alias(f"__{n}{c}") for c in XYZ for n, f in (("lo", F.min), ("hi", F.max))])
    both = pts.join(box, ["cloud_id", instance])
    both = both.withColumns({f"d{c}": (F.col(f"__lo{c}") + F.col(f"__hi{c}")) / 2 - F.col(c) for c in XYZ} | {f"h{c}": (F.col(f"__hi{c}") - F.col(f"__lo{c}")) / 2 for c in XYZ})
    return shift_to_origin(both.drop(*[f"__{n}{c}" for c in XYZ for n in ("lo", "hi")]))


def box_corners(boxes: DataFrame, permute: Sequence[int] | None = None, center: bool = False, skip: Sequence[int] = (), easy_view: bool = False, instance: str = "instance_id") -> DataFrame:
    """(cloud_id, instance, label, corner, x, y, z): the eight corners of each box, upper face first.

    ``permute`` reorders the axes, ``center`` moves all boxes of a room by half its largest corner and scales by the largest of
    the halves, ``skip`` leaves out labels, ``easy_view`` keeps that view's labels.
    """
    axes = [XYZ[k] for k in (permute or (0, 1, 2))]
    b = boxes.select("cloud_id", instance, "label", *[F.col(f"{a}{k}").alias(f"{c}{k}") for c, a in zip(XYZ, axes) for k in (1, 2)])
    if center:
        room = Window.partitionBy("cloud_id")
        b = b.withColumns({f"__{c}": F.max(f"{c}2").over(room) / 2 for c in XYZ}).withColumn("__s", F.greatest(*[F.col(f"__{c}") for c in XYZ]))
        b = b.withColumns({f"{c}{k}": F.try_divide(F.col(f"{c}{k}") - F.col(f"__{c}"), F.col("__s")) for c in XYZ for k in (1, 2)})
    if easy_view:
        b = b.filter(F.col("label").isin(*EASY_VIEW))
    if skip:
        b = b.filter(~F.col("label").isin(*skip))
    order = [(x, y, z) for z in (2, 1) for x, y in ((1, 1), (1, 2), (2, 2), (2, 1))]
    corners = F.array(*[F.struct(F.lit(k).alias("corner"), F.col(f"x{i}").alias("x"), F.col(f"y{j}").alias("y"), F.col(f"z{m}").alias("z")) for k, (i, j, m) in enumerate(order)])
    return b.select("cloud_id", instance, "label", F.explode(corners).alias("c")).select("cloud_id", instance, "label", "c.*")


def to_volume(pts: DataFrame, v: int = 12, r: float = 1.0) -> DataFrame:
    """(cloud_id, a, b, c): occupied cells int((p + r) / (2 r / v)) of a v x v x v grid; points outside are left out."""
    at = [((F.col(c) + r) / (2 * r / v)).cast("long").alias(n) for c, n in zip(XYZ, "abc")]
    cells = pts.select("cloud_id", *at).distinct()
    return cells.filter(reduce(lambda p, q: p & q, [F.col(n).between(0, v - 1) for n in "abc"]))


def from_volume(cells: DataFrame) -> DataFrame:
    """Occupied cells as points, numbered in order of a, b, c."""
    w = Window.partitionBy("cloud_id").orderBy("a", "b", "c")
    return cells.select("cloud_id", (F.row_number().over(w) - 1).cast("long").alias("point_idx"), *[F.col(n).cast("double").alias(c) for n, c in zip("abc", XYZ)])


def merge_clouds(clouds: Sequence[DataFrame], into: int) -> DataFrame:
    """Clouds one after the other as cloud ``into``; points are renumbered by list, cloud and index."""
    each = [c.withColumn("__part", F.lit(k)) for k, c in enumerate(clouds)]
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), each)
    sizes = both.groupBy("__part", "cloud_id").agg((F.max("point_idx") + 1).alias("__n"))
    before = ranked(sizes, "__part", "cloud_id", name="__before", of="__n").drop("__n")
    out = both.join(before, ["__part", "cloud_id"]).withColumn("point_idx", F.col("point_idx") + F.col("__before"))
    return out.withColumn("cloud_id", F.lit(into).cast("long")).drop("__part", "__before")


def _linear(m: Sequence[Sequence[Column]], p: Sequence[Column], t: Sequence[Column] | None = None) -> list[Column]:
    """m p + t."""
    rows = [reduce(lambda a, b: a + b, [m[i][k] * p[k] for k in range(3)]) for i in range(3)]
    return [r + t[i] for i, r in enumerate(rows)] if t else rows


def transform_points(pts: DataFrame, transforms: DataFrame) -> DataFrame:
    """Points moved by their cloud's 4 x 4 matrix (cloud_id, m: 16 numbers by row). Clouds without one stay."""
    m = [[F.get("m", F.lit(4 * i + k)) for k in range(4)] for i in range(4)]
    both = pts.join(transforms.select("cloud_id", "m"), "cloud_id", "left")
    moved = _linear(m, [F.col(c) for c in XYZ], [m[i][3] for i in range(3)])
    return both.withColumns({c: F.when(F.col("m").isNull(), F.col(c)).otherwise(v) for c, v in zip(XYZ, moved)}).drop("m")


def quat_to_matrix(w: Column, x: Column, y: Column, z: Column) -> list[list[Column]]:
    """Rotation matrix of a quaternion of any length but 0."""
    s = F.lit(2.0) / (w * w + x * x + y * y + z * z)
    one = F.lit(1.0)
    return [
        [one - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y)],
        [s * (x * y + w * z), one - s * (x * x + z * z), s * (y * z - w * x)],
        [s * (x * z - w * y), s * (y * z + w * x), one - s * (x * x + y * y)],
    ]


def apply_poses(pts: DataFrame, poses: DataFrame) -> DataFrame:
    """Scans moved into one frame: R p + t by (cloud_id, tx, ty, tz, qx, qy, qz, qw), Hamilton convention. Clouds without a pose go."""
    both = pts.join(poses.select("cloud_id", "tx", "ty", "tz", "qx", "qy", "qz", "qw"), "cloud_id")
    moved = _linear(quat_to_matrix(*[F.col(f"q{c}") for c in "wxyz"]), [F.col(c) for c in XYZ], [F.col(f"t{c}") for c in XYZ])
    return both.withColumns(dict(zip(XYZ, moved))).drop("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def euler_to_matrix(z: Column, y: Column, x: Column) -> list[list[Column]]:
    """Rx Ry Rz: turns about z first, then y, then x."""
    (cz, sz), (cy, sy), (cx, sx) = [(F.cos(a), F.sin(a)) for a in (z, y, x)]
    return [
        [cy * cz, -cy * sz, sy],
        [sx * sy * cz + cx * sz, cx * cz - sx * sy * sz, -sx * cy],
        [sx * sz - cx * sy * cz, cx * sy * sz + sx * cz, cx * cy],
    ]


def matrix_to_euler(m: Sequence[Sequence[Column]]) -> Column:
    """struct(z, y, x) of a rotation matrix; near the poles, where cos y is below 4 eps, x is 0."""
    cy = F.sqrt(m[2][2] * m[2][2] + m[1][2] * m[1][2])
    fine = cy > 4 * np.finfo(float).eps
    return F.struct(
        F.when(fine, F.atan2(-m[0][1], m[0][0])).otherwise(F.atan2(m[1][0], m[1][1])).alias("z"),
        F.atan2(m[0][2], cy).alias("y"),
        F.when(fine, F.atan2(-m[1][2], m[2][2])).otherwise(F.lit(0.0)).alias("x"),
    )


def euler_to_quat(z: Column, y: Column, x: Column) -> Column:
    """struct(w, x, y, z) of the same turn, by half angles."""
    (cz, sz), (cy, sy), (cx, sx) = [(F.cos(a / 2), F.sin(a / 2)) for a in (z, y, x)]
    return F.struct(
        (cx * cy * cz - sx * sy * sz).alias("w"), (cx * sy * sz + cy * cz * sx).alias("x"), (cx * cz * sy - sx * cy * sz).alias("y"), (cx * cy * sz + sx * cz * sy).alias("z")
    )


def quat_to_euler(w: Column, x: Column, y: Column, z: Column) -> Column:
    return matrix_to_euler(quat_to_matrix(w, x, y, z))


def quat_to_axis_angle(w: Column, x: Column, y: Column, z: Column) -> Column:
    """struct(angle, x, y, z) of a unit quaternion; no turn is about the x axis."""
    n = F.sqrt(x * x + y * y + z * z)
    zero = n < 1e-12
    return F.struct((2 * F.acos(F.greatest(F.least(w, F.lit(1.0)), F.lit(-1.0)))).alias("angle"), *[F.when(zero, F.lit(d)).otherwise(c / n).alias(k) for k, c, d in (("x", x, 1.0), ("y", y, 0.0), ("z", z, 0.0))])


def _least(n: np.ndarray, xx: np.ndarray, xy: np.ndarray, xz: np.ndarray, yy: np.ndarray, yz: np.ndarray, zz: np.ndarray) -> np.ndarray:
    """Directions of least spread of covariances, the largest component positive (the first of equal ones); up where there are fewer than three points."""
    m = np.stack([np.stack(r, axis=-1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], axis=-2)
    v = np.linalg.eigh(m)[1][:, :, 0]
    size = np.abs(v)
    big = (size > size.max(axis=1, keepdims=True) - 1e-9).argmax(axis=1)  # rounding doesn't choose among equal ones
    v = v * np.sign(v[np.arange(len(v)), big])[:, None]
    v[n < 3] = (0.0, 0.0, 1.0)
    return v


_UPPER = [(i, j) for i in range(3) for j in range(i, 3)]


def normals_of(xyz: np.ndarray, radius: float, max_nn: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, normal, number of neighbours) of the points of one cloud that have a neighbour, some at a time."""
    for row, col, _, _ in nearest(xyz, xyz, max_nn, radius):
        if not len(row):
            continue
        low, n = row[0], np.bincount(row - row[0])
        here = np.flatnonzero(n)
        at, n = np.searchsorted(here, row - low), n[here]
        d = xyz[col] - xyz[row]
        d -= np.stack([np.bincount(at, d[:, i]) / n for i in range(3)], axis=1)[at]
        yield low + here, _least(n, *[np.bincount(at, d[:, i] * d[:, j]) / n for i, j in _UPPER]), n


def estimate_normals(pts: DataFrame, radius: float, max_nn: int = 50, pairs: int = MOST_PAIRS) -> DataFrame:
    """(cloud_id, point_idx, nx, ny, nz, n): direction of least spread of at most ``max_nn`` nearest neighbours within ``radius``.

    The largest component is positive. Points with fewer than three neighbours, themselves included, point up. Clouds of at most ``pairs``
    pairs are worked on within a task, so that no neighbour is shuffled; in larger ones covariances are aggregates over the neighbours.
    """
    rows = written(pts.select("cloud_id", "point_idx", *[F.col(c).cast("double").alias(c) for c in XYZ]), "normals-points")
    large = large_clouds(rows, pairs)
    schema = StructType([*[rows.schema[c] for c in ("cloud_id", "point_idx")], *StructType.fromDDL("nx double, ny double, nz double, n long").fields])

    def work(c):
        for at, v, n in normals_of(np.stack([c[k] for k in XYZ], axis=1), radius, max_nn):
            yield {"point_idx": c["point_idx"][at], "nx": v[:, 0], "ny": v[:, 1], "nz": v[:, 2], "n": n}

    if large is None:
        return each_cloud(rows, work, schema, "point_idx")
    few = each_cloud(rows.join(large, "cloud_id", "left_anti"), work, schema, "point_idx")
    return few.unionByName(_normals_of_large(rows.join(large, "cloud_id", "left_semi"), radius, max_nn))


def _normals_of_large(pts: DataFrame, radius: float, max_nn: int) -> DataFrame:
    from .neighbors import hybrid

    near = hybrid(pts, pts, radius, max_nn, pairs=0).withColumnRenamed("a_idx", "point_idx")
    cov = near.groupBy("cloud_id", "point_idx").agg(F.count("*").alias("n"), *[F.covar_pop(f"b{XYZ[i]}", f"b{XYZ[j]}").alias(f"c{i}{j}") for i, j in _UPPER])

    @F.pandas_udf("nx double, ny double, nz double")
    def least(n: pd.Series, xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_least(*[c.to_numpy() for c in (n, xx, xy, xz, yy, yz, zz)]), columns=["nx", "ny", "nz"])

    return cov.withColumn("v", least("n", *[f"c{i}{j}" for i, j in _UPPER])).select("cloud_id", "point_idx", "v.*", "n")
