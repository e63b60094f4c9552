"""Neighbours within clouds, matching and comparison.

Radius searches join on cells of the radius: each point of the smaller side goes to the 27 cells around it, and pairs are filtered by
their true distance, so work follows the number of close pairs. Nearest-neighbour searches stay within a task for clouds of few pairs
(``in_task``), and search larger clouds in tiles (``nearest``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from . import farthest
from .in_task import MOST_PAIRS, each_cloud, large_clouds, nearest, two_sides
from .nearest import knn_tiles
from .order import ranked

XYZ = ("x", "y", "z")


def _sq(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, [c * c for c in cols])


def _side(df: DataFrame, name: str, idx: str = "point_idx") -> DataFrame:
    return df.select("cloud_id", F.col(idx).alias(f"{name}_idx"), *[F.col(c).alias(f"{name}{c}") for c in XYZ])



def _between() -> Column:
    return _sq([F.col(f"a{c}") - F.col(f"b{c}") for c in XYZ])


def cell_join(a: DataFrame, b: DataFrame, r: float, a_idx: str = "point_idx", b_idx: str = "point_idx", replicate: str = "a") -> DataFrame:
    """(cloud_id, a_idx, ax, ay, az, b_idx, bx, by, bz, d2): all pairs of a cloud within ``r``. Side ``replicate``, the smaller one, goes to 27 cells."""
    around = F.explode(F.expr("flatten(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> struct(i, j, k))))))")).alias("o")

    def placed(df: DataFrame, name: str, idx: str) -> DataFrame:
        side = _side(df, name, idx)
        cells = [F.floor(F.col(f"{name}{c}") / r) for c in XYZ]
        if name != replicate:
            return side.select("*", *[v.alias(f"c{c}") for c, v in zip(XYZ, cells)])
        return side.select("*", around).select(*side.columns, *[(v + F.col(f"o.{o}")).alias(f"c{c}") for c, v, o in zip(XYZ, cells, "ijk")])

    pairs = placed(a, "a", a_idx).join(placed(b, "b", b_idx), ["cloud_id", "cx", "cy", "cz"]).withColumn("d2", _between())
    return pairs.filter(F.col("d2") <= r * r).drop("cx", "cy", "cz")


def square_distance(a: DataFrame, b: DataFrame, a_idx: str = "point_idx", b_idx: str = "point_idx") -> DataFrame:
    """(cloud_id, a_idx, b_idx, d2) for every pair of a cloud: the output is that large, so one side should be few points."""
    return _side(a, "a", a_idx).join(_side(b, "b", b_idx), "cloud_id").select("cloud_id", "a_idx", "b_idx", _between().alias("d2"))


def vector_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays; -1 if their lengths differ."""
    d2 = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.sqrt(d2)).otherwise(F.lit(-1.0))


def index_points(pts: DataFrame, idx: DataFrame) -> DataFrame:
    """Rows of ``pts`` for every (cloud_id, point_idx) of ``idx``, whose other columns stay; repeats give repeats."""
    return idx.join(pts, ["cloud_id", "point_idx"])


def ball_query(pts: DataFrame, centres: DataFrame, r: float, nsample: int) -> DataFrame:
    """(cloud_id, centre, slot, point_idx): the first ``nsample`` points by index within ``r`` of each centre (cloud_id, centre, x, y, z).

    Free slots repeat the first point. A centre without points has no rows.
    """
    near = cell_join(centres, pts, r, a_idx="centre").select("cloud_id", F.col("a_idx").alias("centre"), F.col("b_idx").alias("point_idx"))
    return _slots(near, nsample)


def _slots(near: DataFrame, nsample: int | Column, keys: Sequence[str] = ("cloud_id", "centre"), most: int | None = None) -> DataFrame:
    """The first ``nsample`` (at most ``most``) by index of each group, cut before they are shuffled, free slots filled with the first."""
    w = Window.partitionBy(*keys)
    limit = F.lit(nsample) if isinstance(nsample, int) else nsample
    first = near.withColumn("slot", F.row_number().over(w.orderBy("point_idx"))).filter(F.col("slot") <= (nsample if most is None else most))
    kept = first.filter(F.col("slot") <= limit).withColumns({"slot": F.col("slot") - 1, "__n": F.count(F.lit(1)).over(w)})
    pad = F.when((F.col("slot") == 0) & (F.col("__n") < limit), F.concat(F.array(F.lit(0)), F.sequence(F.col("__n").cast("int"), limit.cast("int") - 1))).otherwise(F.array(F.col("slot")))
    return kept.select(*keys, F.explode(pad).alias("slot"), "point_idx")


def sample_and_group(pts: DataFrame, n: int, r: float, k: int, features: Sequence[str] = (), start: int = 0) -> DataFrame:
    """(cloud_id, centre, slot, point_idx, x, y, z, features): ``n`` farthest points as centres, the ball of each, coordinates from it."""
    centres = farthest.farthest_point_sample(pts, n, start).select("cloud_id", F.col("place").alias("centre"), *XYZ)
    groups = index_points(pts.select("cloud_id", "point_idx", *XYZ, *features), ball_query(pts, centres, r, k))
    own = centres.select("cloud_id", "centre", *[F.col(c).alias(f"__{c}") for c in XYZ])
    both = groups.join(own, ["cloud_id", "centre"])
    return both.select("cloud_id", "centre", "slot", "point_idx", *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in XYZ], *features)


def group_all(pts: DataFrame, features: Sequence[str] = ()) -> DataFrame:
    """The whole cloud as one group around the origin."""
    return pts.select("cloud_id", F.lit(0).alias("centre"), F.col("point_idx").alias("slot"), "point_idx", *XYZ, *features)


#: Radius and group size of the usual multi-scale setting.
SCALES = ((0.1, 16), (0.2, 32), (0.4, 128))


def multi_scale_group(pts: DataFrame, centres: DataFrame, scales: Sequence[tuple[float, int]] = SCALES) -> DataFrame:
    """(cloud_id, centre, scale, slot, point_idx): ball queries of several radii from one join at the largest."""
    near = cell_join(centres, pts, max(r for r, _ in scales), a_idx="centre")
    fit = F.explode(F.array(*[F.struct(F.lit(k).alias("scale"), F.lit(float(r * r)).alias("r2"), F.lit(n).alias("n")) for k, (r, n) in enumerate(scales)]))
    rows = near.select("cloud_id", F.col("a_idx").alias("centre"), F.col("b_idx").alias("point_idx"), "d2", fit.alias("s")).filter(F.col("d2") <= F.col("s.r2"))
    limit = F.get(F.array(*[F.lit(n) for _, n in scales]), F.col("scale"))
    return _slots(rows.select("cloud_id", "centre", "s.scale", "point_idx"), limit, ("cloud_id", "centre", "scale"), max(n for _, n in scales))


def group_max(groups: DataFrame, cols: Sequence[str], keys: Sequence[str] = ("cloud_id", "centre")) -> DataFrame:
    """The largest value of each column in each group."""
    return groups.groupBy(*keys).agg(*[F.max(c).alias(c) for c in cols])


def _in_tasks(rows: DataFrame, k: int, radius: float | None = None, both: bool = False) -> DataFrame:
    """(cloud_id, way, a_idx, b_idx, d2, bx, by, bz, rank) of the clouds of ``two_sides``, each within a task; with ``both`` way 1 is from side 1 to side 0."""
    idx = rows.schema["point_idx"].dataType.simpleString()
    schema = StructType([rows.schema["cloud_id"], *StructType.fromDDL(f"way int, a_idx {idx}, b_idx {idx}, d2 double, bx double, by double, bz double, rank int").fields])

    def work(c):
        idx, xyz = c["point_idx"], np.stack([c[n] for n in XYZ], axis=1)
        sides = [np.flatnonzero(c["side"] == s) for s in (0, 1)]
        for way in range(1 + both):
            a, b = sides[way], sides[1 - way]
            for row, col, d2, rank in nearest(xyz[a], xyz[b], k, radius):
                at = b[col]
                yield {"way": np.full(len(row), way, np.int32), "a_idx": idx[a[row]], "b_idx": idx[at], "d2": d2, "bx": xyz[at, 0], "by": xyz[at, 1], "bz": xyz[at, 2], "rank": rank}

    return each_cloud(rows, work, schema, "side", "point_idx")


def _folded(rows: DataFrame, k: int, fields: Sequence[tuple[str, str]], fold: Callable) -> DataFrame:
    """(cloud_id, point_idx, ``fields``): one row for each point of side 0, made within the task of its ``k`` nearest of side 1, so that no
    neighbour is shuffled. ``fold`` gets the cloud's columns, the places of the neighbours in them, their squared distances, nearest first,
    and where each point's neighbours begin; it gives out names and values."""
    schema = StructType([rows.schema["cloud_id"], rows.schema["point_idx"], *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in fields)).fields])

    def work(c):
        xyz = np.stack([c[n] for n in XYZ], axis=1)
        a, b = (np.flatnonzero(c["side"] == s) for s in (0, 1))
        for row, col, d2, _ in nearest(xyz[a], xyz[b], k):
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                yield {"point_idx": c["point_idx"][a[row[first]]]} | dict(fold(c, b[col], d2, first))

    return each_cloud(rows, work, schema, "side", "point_idx")


def _indexed(df: DataFrame, idx: str) -> DataFrame:
    return df.select("cloud_id", F.col(idx).alias("point_idx"), *[F.col(c).cast("double").alias(c) for c in XYZ])


def _side_of(rows: DataFrame, side: int, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    return rows.filter(F.col("side") == side).drop("side").join(ids, "cloud_id", how)


def knn(a: DataFrame, b: DataFrame, k: int, a_idx: str = "point_idx", b_idx: str = "point_idx", pairs: int = MOST_PAIRS) -> DataFrame:
    """(cloud_id, a_idx, b_idx, d2, rank): the ``k`` nearest of ``b`` for each of ``a``, the lower index first on ties.

    Clouds of at most ``pairs`` pairs are searched within a task, so that no pair is shuffled; larger ones in tiles of adapted size. Both
    ways are exact. The points are written once.
    """
    return knn_points(a, b, k, a_idx, b_idx, pairs).drop("bx", "by", "bz")


def knn_points(a: DataFrame, b: DataFrame, k: int, a_idx: str = "point_idx", b_idx: str = "point_idx", pairs: int = MOST_PAIRS) -> DataFrame:
    """``knn`` with the found points' coordinates bx, by, bz before the rank, so that no join has to fetch them."""
    rows = two_sides(_indexed(a, a_idx), _indexed(b, b_idx))
    large, cols = large_clouds(rows, pairs), ["cloud_id", "a_idx", "b_idx", "d2", "bx", "by", "bz", "rank"]
    if large is None:
        return _in_tasks(rows, k).select(*cols)
    few = _in_tasks(rows.join(large, "cloud_id", "left_anti"), k).select(*cols)
    return few.unionByName(knn_tiles(_side_of(rows, 0, large), _side_of(rows, 1, large), k).select(*cols))


def hybrid(a: DataFrame, b: DataFrame, radius: float, max_nn: int, crowd: int = 32, pairs: int = MOST_PAIRS) -> DataFrame:
    """(cloud_id, a_idx, b_idx, d2, bx, by, bz, rank): at most ``max_nn`` nearest of ``b`` within ``radius`` for each of ``a``.

    Clouds of at most ``pairs`` pairs are searched within a task. Larger ones go by cells of the radius as long as a point's own cell holds
    ``crowd`` times ``max_nn`` points or fewer, on average over the points; the pairs of crowded ones would grow with the square of a
    cell, so these are searched in tiles. All ways are exact.
    """
    rows, cols = two_sides(_indexed(a, "point_idx"), _indexed(b, "point_idx")), ["cloud_id", "a_idx", "b_idx", "d2", "bx", "by", "bz", "rank"]
    large = large_clouds(rows, pairs)
    if large is None:
        return _in_tasks(rows, max_nn, radius).select(*cols)
    few = _in_tasks(rows.join(large, "cloud_id", "left_anti"), max_nn, radius).select(*cols)
    return few.unionByName(_by_cells_or_tiles(_side_of(rows, 0, large), _side_of(rows, 1, large), radius, max_nn, crowd).select(*cols))


def _by_cells_or_tiles(a: DataFrame, b: DataFrame, radius: float, max_nn: int, crowd: int) -> DataFrame:
    cell = [F.floor(F.col(c) / radius).alias(f"c{c}") for c in XYZ]
    sizes = [df.groupBy("cloud_id", *cell).agg(F.count("*").cast("double").alias(n)) for df, n in ((a, "na"), (b, "nb"))]
    met = sizes[0].join(sizes[1], ["cloud_id", "cx", "cy", "cz"], "left").groupBy("cloud_id").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"), F.sum("na").alias("n"))
    crowded = written(met.filter(F.col("pairs") > crowd * max_nn * F.col("n")).select("cloud_id"), "hybrid-large")
    cut = (lambda df, how: df.join(crowded, "cloud_id", how)) if (more := not crowded.isEmpty()) else (lambda df, how: df)
    rank = F.row_number().over(Window.partitionBy("cloud_id", "a_idx").orderBy("d2", "b_idx"))
    near = cell_join(cut(a, "left_anti"), cut(b, "left_anti"), radius).select("cloud_id", "a_idx", "b_idx", "d2", "bx", "by", "bz").withColumn("rank", rank).filter(F.col("rank") <= max_nn)
    return near.unionByName(knn_tiles(cut(a, "left_semi"), cut(b, "left_semi"), max_nn, radius=radius)) if more else near


def interpolate_3nn(fine: DataFrame, coarse: DataFrame, cols: Sequence[str], radius: float | None = None) -> DataFrame:
    """(cloud_id, point_idx, cols): means of the three nearest coarse points, weighted by 1 / (d2 + 1e-8); fewer if there are fewer.

    Neighbours are exact whatever ``radius``; it is a starting radius that callers may state, and the search needs none.
    """
    held, none = [f"__v{k}" for k in range(len(cols))], [f"__none{k}" for k in range(len(cols))]
    values = [F.col(c).cast("double").alias(v) for c, v in zip(cols, held)] + [F.col(c).isNull().cast("double").alias(v) for c, v in zip(cols, none)]
    rows = two_sides(_indexed(fine, "point_idx"), coarse.select("cloud_id", "point_idx", *[F.col(c).cast("double").alias(c) for c in XYZ], *values), [*held, *none])

    def mean(c, at, d2, first):
        w = 1 / (d2 + 1e-8)
        total = np.add.reduceat(w, first)
        for name, v, n in zip(cols, held, none):
            known = c[n][at] == 0
            sums = np.add.reduceat(np.where(known, w * c[v][at], 0.0), first)
            yield name, pa.array(sums / total, pa.float64(), mask=~np.logical_or.reduceat(known, first))

    schema = [(c, "double") for c in cols]
    if (large := large_clouds(rows)) is None:
        return _folded(rows, 3, schema, mean)
    near = knn_tiles(_side_of(rows, 0, large), _side_of(rows, 1, large), 3).withColumn("w", 1 / (F.col("d2") + 1e-8))
    near = near.join(_side_of(rows, 1, large).select("cloud_id", F.col("point_idx").alias("b_idx"), *[F.when(F.col(n) == 0, F.col(v)).alias(v) for v, n in zip(held, none)]), ["cloud_id", "b_idx"])
    far = near.groupBy("cloud_id", F.col("a_idx").alias("point_idx")).agg(*[(F.sum(F.col("w") * F.col(v)) / F.sum("w")).alias(c) for c, v in zip(cols, held)])
    return _folded(rows.join(large, "cloud_id", "left_anti"), 3, schema, mean).unionByName(far)


def nn_distance(a: DataFrame, b: DataFrame, radius: float | None = None) -> DataFrame:
    """(cloud_id, side, point_idx, d2, nn_idx): the nearest point of the other cloud for all of ``a`` (side a) and ``b`` (side b).

    Neighbours are exact whatever ``radius``; it is a starting radius that callers may state, and the search needs none.
    """
    rows, cols = two_sides(_indexed(a, "point_idx"), _indexed(b, "point_idx")), ["cloud_id", "side", F.col("a_idx").alias("point_idx"), "d2", F.col("b_idx").alias("nn_idx")]
    side = F.when(F.col("way") == 0, "a").otherwise("b")
    if (large := large_clouds(rows)) is None:
        return _in_tasks(rows, 1, both=True).withColumn("side", side).select(*cols)
    found = _in_tasks(rows.join(large, "cloud_id", "left_anti"), 1, both=True).withColumn("side", side).select(*cols)
    p, q = (_side_of(rows, s, large) for s in (0, 1))
    for name, near in (("a", knn_tiles(p, q, 1)), ("b", knn_tiles(q, p, 1))):
        found = found.unionByName(near.withColumn("side", F.lit(name)).select(*cols))
    return found


def simplification_loss(ref: DataFrame, samp: DataFrame, size: int, gamma: float = 1.0, delta: float = 0.0) -> DataFrame:
    """(forward, farthest, backward, loss): mean and mean largest squared distance of samples to the reference, mean of the way back."""
    near = nn_distance(samp, ref)
    per = near.groupBy("cloud_id").agg(
        F.avg(F.when(F.col("side") == "a", F.col("d2"))).alias("f"), F.max(F.when(F.col("side") == "a", F.col("d2"))).alias("m"), F.avg(F.when(F.col("side") == "b", F.col("d2"))).alias("b"),
        F.count(F.when(F.col("side") == "a", 1)).alias("nf"), F.count(F.when(F.col("side") == "b", 1)).alias("nb"),
    )
    total = per.agg((F.sum(F.col("f") * F.col("nf")) / F.sum("nf")).alias("forward"), F.avg("m").alias("farthest"), (F.sum(F.col("b") * F.col("nb")) / F.sum("nb")).alias("backward"))
    return total.withColumn("loss", F.col("forward") + F.col("farthest") + (gamma + delta * size) * F.col("backward"))


def nn_match(full: DataFrame, idx: DataFrame, k: int, complete: bool = True) -> DataFrame:
    """Matched points (cloud_id, slot, point_idx) of ``full``: distinct in first-seen order and completed to ``k`` by farthest points, or as they are."""
    if not complete:
        return index_points(full.select("cloud_id", "point_idx", *XYZ), idx.select("cloud_id", F.col("slot").cast("int").alias("place"), "point_idx")).filter(F.col("place") < k)
    first = idx.groupBy("cloud_id", "point_idx").agg(F.min("slot").alias("slot"))
    seeds = first.withColumn("seed_no", F.row_number().over(Window.partitionBy("cloud_id").orderBy("slot")) - 1)
    seeds = index_points(full.select("cloud_id", "point_idx", *XYZ), seeds.select("cloud_id", "point_idx", "seed_no"))
    return farthest.fps_complete(full, seeds.filter(F.col("seed_no") < k), k)


def soft_project(samp: DataFrame, full: DataFrame, k: int = 7, sigma: float = 1.0, hard: bool = False) -> DataFrame:
    """(cloud_id, point_idx, x, y, z): samples as means of their ``k`` nearest points weighted by softmax(-d2 / sigma), or the nearest alone."""
    rows, k = two_sides(_indexed(samp, "point_idx"), _indexed(full, "point_idx")), 1 if hard else k

    def mean(c, at, d2, first):
        n = np.diff(first, append=len(d2))
        w = np.exp((np.repeat(np.minimum.reduceat(d2, first), n) - d2) / sigma)
        total = np.add.reduceat(w, first)
        for name in XYZ:
            yield name, np.add.reduceat(w * c[name][at], first) / total

    schema = [(c, "double") for c in XYZ]
    if (large := large_clouds(rows)) is None:
        return _folded(rows, k, schema, mean)
    near = knn_tiles(_side_of(rows, 0, large), _side_of(rows, 1, large), k)
    near = near.withColumn("w", F.exp((F.min("d2").over(Window.partitionBy("cloud_id", "a_idx")) - F.col("d2")) / sigma))
    far = near.groupBy("cloud_id", F.col("a_idx").alias("point_idx")).agg(*[(F.sum(F.col("w") * F.col(f"b{c}")) / F.sum("w")).alias(c) for c in XYZ])
    return _folded(rows.join(large, "cloud_id", "left_anti"), k, schema, mean).unionByName(far)


def compare_clouds(a: DataFrame, b: DataFrame) -> DataFrame:
    """(point_idx, ax..az, bx..bz, distance): two clouds side by side by place, as far as the shorter goes."""
    left, right = (df.select("point_idx", *[F.col(c).alias(f"{n}{c}") for c in XYZ]) for n, df in (("a", a), ("b", b)))
    return left.join(right, "point_idx").withColumn("distance", F.sqrt(_between()))


def cloud_pairs(clouds: DataFrame, key: str = "cloud_id", each: int = 10_000_000) -> DataFrame:
    """(a, b): all pairs of clouds with a < b, the work list of a registration of every pair.

    Blocks of clouds meet each other and are dealt out evenly to a task for about ``each`` pairs. Only blocks are shuffled, each as one row:
    pairs come into being where they are given out, so nothing but the result grows with the square of the clouds.
    """
    places = ranked(clouds.select(key).distinct(), key, name="__k")
    n, size = places.count(), 1 << (math.isqrt(each).bit_length() - 1)
    blocks = places.groupBy(F.floor(F.col("__k") / size).alias("block")).agg(F.collect_list(key).alias("ids"))
    upper = blocks.select(F.col("block").alias("of"), F.col("ids").alias("upper"), F.explode(F.sequence(F.lit(0).cast("bigint"), "block")).alias("block"))
    met = upper.join(blocks, "block").repartition(max(1, -(-n * n // (2 * each))))

    def run(it):
        for rows in it:
            for ids, upper, own in zip(rows.column("ids"), rows.column("upper"), pc.equal(rows.column("block"), rows.column("of")).to_pylist()):
                ids, upper = ids.values, upper.values
                step = max(1, 65_536 // max(1, len(ids)))
                for k in range(0, len(upper), step):
                    some = upper.slice(k, step)
                    out = pa.record_batch([ids.take(pa.array(np.tile(np.arange(len(ids)), len(some)))), some.take(pa.array(np.repeat(np.arange(len(some)), len(ids))))], names=["a", "b"])
                    yield out.filter(pc.less(out.column("a"), out.column("b"))) if own else out

    kind = clouds.schema[key].dataType.simpleString()
    return met.mapInArrow(run, f"a {kind}, b {kind}")


def feature_matches(a: DataFrame, b: DataFrame, r: float, edge: float = 0.9, block: int = 4_096) -> DataFrame:
    """(a_id, b_id, distance, kept): the nearest feature vector of ``b`` for each of ``a`` (vec_id, embedding), within ``r``.

    ``b`` meets ``a`` in blocks of ``block`` vectors, each one product of matrices in a helper; the best over blocks is an aggregate.
    ``kept``: the vectors' lengths agree by the ratio ``edge``.
    """
    left = a.select(F.col("vec_id").alias("a_id"), F.col("embedding").cast("array<double>").alias("av"))
    right = b.select(F.col("vec_id").alias("b_id"), F.col("embedding").cast("array<double>").alias("bv"))
    blocks = max(1, -(-b.count() // block))
    # keys of one type: cogroups of other types don't meet
    own = lambda *cols: F.pmod(F.xxhash64(*cols), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = left.withColumn("block", every).withColumn("part", own("a_id", F.lit(1)))
    right = right.withColumn("block", own("b_id")).withColumn("part", every)

    def total(v):
        """Row sums, one column after the other: equal rows have equal sums, and SQL adds in this order."""
        out = np.zeros(len(v))
        for k in range(v.shape[1]):
            out += v[:, k]
        return out

    def nearest(key, p, q):
        import pandas as pd

        none = pd.DataFrame(columns=["a_id", "b_id", "d", "la", "lb"])
        if p.empty or q.empty:
            return none
        q = q.sort_values("b_id", ignore_index=True)
        x, y = np.stack(p.av.to_numpy()), np.stack(q.bv.to_numpy())
        (p, x), (q, y) = ((df[ok], v[ok]) for df, v, ok in ((p, x, np.isfinite(x).all(axis=1)), (q, y, np.isfinite(y).all(axis=1))))
        if p.empty or q.empty:
            return none
        first = np.sort(np.unique(y, axis=0, return_index=True)[1])  # of equal vectors the lowest id alone can win
        ids, y = q.b_id.to_numpy()[first], y[first]
        x2, y2 = total(x * x), total(y * y)
        out = []
        for at in range(0, len(x), 1_024):  # the product of matrices only proposes: what is as near but for its rounding is measured
            part, part2 = x[at : at + 1_024], x2[at : at + 1_024]
            about = part2[:, None] + y2[None] - 2 * part @ y.T
            slack = 8 * (x.shape[1] + 2) * np.finfo(float).eps * (part2 + y2.max())
            row, col = np.nonzero(about <= (about.min(axis=1) + slack)[:, None])
            d = np.sqrt(total((part[row] - y[col]) ** 2))
            by = np.lexsort((ids[col], d, row))
            by = by[np.diff(row[by], prepend=-1) != 0]
            row, col = row[by], col[by]
            out.append(pd.DataFrame({"a_id": p.a_id.to_numpy()[at + row], "b_id": ids[col], "d": d[by], "la": np.sqrt(part2[row]), "lb": np.sqrt(y2[col])}))
        return pd.concat(out)

    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(nearest, "a_id long, b_id long, d double, la double, lb double")
    best = found.groupBy("a_id").agg(F.min(F.struct("d", "b_id", "la", "lb")).alias("m")).select("a_id", "m.b_id", F.col("m.d").alias("distance"), "m.la", "m.lb")
    ratio = F.least("la", "lb") >= edge * F.greatest("la", "lb")
    return best.filter(F.col("distance") <= r).select("a_id", "b_id", "distance", ratio.alias("kept"))
