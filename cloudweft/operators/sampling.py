"""Splits, samples, limits and orders. Random choices come from keyed uniforms, so they repeat whatever the partitions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keyed import uniform
from .order import ranked, ranked_inside


def cloud():
    """The window of a cloud's points."""
    return Window.partitionBy("cloud_id")


def head_points(pts: DataFrame, n: int, dense: bool = True) -> DataFrame:
    """The first ``n`` points of each cloud; without dense indices by rank."""
    if dense:
        return pts.filter(F.col("point_idx") < n)
    return pts.withColumn("__k", F.row_number().over(cloud().orderBy("point_idx"))).filter(F.col("__k") <= n).drop("__k")


def _ranked(pts: DataFrame, seed: int, salt: int = 0) -> DataFrame:
    """Points with their cloud's size __n and place __k, from 0, in a random order of the cloud."""
    u = uniform(F.col("cloud_id"), F.col("point_idx"), seed, salt)
    return ranked_inside(pts, "cloud_id", u, "point_idx", name="__k", size="__n")


def random_down_sample(pts: DataFrame, ratio: float, seed: int = 0) -> DataFrame:
    """floor(N * ratio) points of each cloud, without replacement."""
    return _ranked(pts, seed).filter(F.col("__k") < F.floor(F.col("__n") * ratio)).drop("__n", "__k")


def uniform_down_sample(pts: DataFrame, k: int) -> DataFrame:
    """Points 0, k, 2k, ..."""
    return pts.filter(F.col("point_idx") % k == 0)


def uniform_to_n(pts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` points: every k-th with k = max(N div n, 1), and of those that are left over ``n`` at random. Clouds with fewer go."""
    sized = pts.join(pts.groupBy("cloud_id").agg(F.count("*").alias("__size")).filter(F.col("__size") >= n), "cloud_id")
    strided = sized.filter(F.col("point_idx") % F.greatest(F.floor(F.col("__size") / n), F.lit(1)) == 0)
    return _ranked(strided, seed).filter(F.col("__k") < n).select(*pts.columns)


def _drawn(sizes: DataFrame, count: Column, seed: int, salt: int = 0) -> DataFrame:
    """(cloud_id, slot, point_idx): ``count`` draws with replacement from clouds of __n points."""
    slots = sizes.filter(count > 0).select("cloud_id", "__n", F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("slot"))
    at = F.floor(uniform(F.col("cloud_id"), F.col("slot"), seed, salt) * F.col("__n")).cast("long")
    return slots.select("cloud_id", "slot", at.alias("point_idx"))


def bootstrap_points(pts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` points of each cloud with replacement; ``slot`` is the place of the draw. Indices must be dense."""
    sizes = pts.groupBy("cloud_id").agg(F.count("*").alias("__n"))
    return _drawn(sizes, F.lit(n), seed).join(pts, ["cloud_id", "point_idx"])


def fit_to_n(pts: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Exactly ``n`` rows of each cloud, with ``slot``: N = n as they are; N > n ``n`` draws with replacement; N < n all points and
    n - N draws. Labels stay with their points."""
    sizes = pts.groupBy("cloud_id").agg(F.count("*").alias("__n"))
    size = F.col("__n")
    kept = pts.join(sizes.filter(size <= n).select("cloud_id"), "cloud_id", "left_semi").withColumn("slot", F.col("point_idx"))
    drawn = _drawn(sizes, F.when(size > n, F.lit(n)).otherwise(n - size), seed).join(pts, ["cloud_id", "point_idx"])
    drawn = drawn.join(sizes, "cloud_id").withColumn("slot", F.when(size < n, F.col("slot") + size).otherwise(F.col("slot"))).drop("__n")
    return kept.unionByName(drawn.select(*kept.columns))


def split_by_list(shapes: DataFrame, lists: Mapping[str, Sequence[int]], split: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Shapes whose id is on the list of ``split``; ``trainval`` is train and val together. ``classes`` chooses categories."""
    names = ("train", "val") if split == "trainval" else (split,)
    ids = sorted({i for name in names for i in lists.get(name, ())})
    listed = shapes.sparkSession.createDataFrame([(i,) for i in ids], "cloud_id long")
    out = shapes.join(listed, "cloud_id", "left_semi")
    return out.filter(F.col("class_name").isin(*classes)) if classes else out


def split_by_area(rooms: DataFrame, k: int, train: bool = False) -> DataFrame:
    """Rooms whose name holds ``Area_k`` (test), or the others (train)."""
    test = F.col("room_name").contains(f"Area_{k}")
    return rooms.filter(~test if train else test)


def split_head_tail(df: DataFrame, by: str, order: Sequence[str], share: float = 0.8) -> DataFrame:
    """Adds ``part``: head for the first round(share * n) rows of each class in order (half to even), tail for the rest."""
    rows = ranked_inside(df, by, *order, name="__k", size="__n")
    head = F.col("__k") < F.bround(F.col("__n") * F.lit(share), 0)
    return rows.withColumn("part", F.when(head, "head").otherwise("tail")).drop("__k", "__n")


def shuffle_clouds(df: DataFrame, seed: int = 0) -> DataFrame:
    """Clouds (cloud_id, ...) with ``place``, their place in a random order of all of them.

    Places are ranks in buckets of the uniform plus what the buckets before hold, so no task sees all clouds.
    """
    buckets = 1024
    u = df.withColumn("__u", uniform(F.col("cloud_id"), 0, seed)).withColumn("__b", F.floor(F.col("__u") * buckets).cast("int"))
    sizes = u.groupBy("__b").agg(F.count("*").alias("__n"))
    before = sizes.select("__b", (F.sum("__n").over(Window.orderBy("__b")) - F.col("__n")).alias("__before"))
    inside = u.withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy("__u", "cloud_id")))
    return inside.join(F.broadcast(before), "__b").withColumn("place", F.col("__before") + F.col("__k") - 1).drop("__u", "__b", "__k", "__before")


def shuffle_points(pts: DataFrame, seed: int = 0) -> DataFrame:
    """Points with ``place``: one permutation of the indices, the same for every cloud (all of one size)."""
    order = pts.select("point_idx").distinct()
    order = order.withColumn("__u", uniform(F.lit(0), F.col("point_idx"), seed))
    return pts.join(ranked(order, "__u", "point_idx", name="place").drop("__u"), "point_idx")


def assign_batches(df: DataFrame, size: int, order: Sequence[str], drop_last: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``batch``, runs of ``size`` rows in order (within ``by``); the incomplete last one is dropped unless told otherwise."""
    rows = ranked(df, *by, *order, name="__k")
    groups = rows.groupBy(*by).agg(F.min("__k").alias("__first"), F.count("*").alias("__n"))
    rows = rows.join(groups, list(by)) if by else rows.join(F.broadcast(groups))  # one row
    rows = rows.withColumn("batch", F.floor((F.col("__k") - F.col("__first")) / size))
    if drop_last:
        rows = rows.filter((F.col("batch") + 1) * size <= F.col("__n"))
    return rows.drop("__k", "__first", "__n")


def sampling_plan(rooms: DataFrame, num_point: int, rate: float = 1.0) -> DataFrame:
    """(cloud_id, rep): each room (cloud_id, n_points) round(share * int(total * rate / num_point)) times, half to even."""
    total = rooms.agg(F.sum("n_points").alias("__total"))
    times = F.bround(F.col("n_points") / F.col("__total") * F.floor(F.col("__total") * rate / num_point), 0).cast("int")
    plan = rooms.join(F.broadcast(total)).select("cloud_id", times.alias("__times")).filter("__times > 0")
    return plan.select("cloud_id", F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("rep"))
