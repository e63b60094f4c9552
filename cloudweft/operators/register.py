"""Registration and earth mover's distances: feature histograms, ICP, information matrices, transport between signatures."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import written
from .farthest import fps_complete
from .geometry import XYZ, estimate_normals, normals_of, transform_points
from .in_task import MOST_PAIRS, each_cloud, each_dealt_cloud, large_clouds, nearest, two_sides
from .neighbors import cell_join, hybrid, index_points

IDENTITY = [1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]


def transport(cost: np.ndarray, supply: np.ndarray, demand: np.ndarray) -> float | None:
    """Least cost of moving exactly ``demand`` out of ``supply`` (whole numbers); None if there is less. Successive cheapest paths."""
    n, m = cost.shape
    if supply.sum() < demand.sum():
        return None
    flow, left, need, total = np.zeros((n, m), np.int64), supply.astype(np.int64).copy(), demand.astype(np.int64).copy(), 0.0
    while need.any():
        # distances over rows, then columns, by Bellman-Ford on the residual graph; a column may send flow back to a row
        row, col = np.where(left > 0, 0.0, np.inf), np.full(m, np.inf)
        back, via = np.full(n, -1), np.full(m, -1)
        for _ in range(n + m):
            reach = row[:, None] + cost
            best = reach.argmin(axis=0)
            better = reach[best, np.arange(m)] < col - 1e-12
            col[better], via[better] = reach[best, np.arange(m)][better], best[better]
            ret = np.where(flow > 0, col[None, :] - cost, np.inf)
            from_col = ret.argmin(axis=1)
            gain = ret[np.arange(n), from_col] < row - 1e-12
            row[gain], back[gain] = ret[np.arange(n), from_col][gain], from_col[gain]
            if not better.any() and not gain.any():
                break
        j = int(np.where(need > 0, col, np.inf).argmin())
        path, c = [], j
        while True:
            r = int(via[c])
            path.append((r, c, 1))
            if back[r] < 0:
                break
            path.append((r, int(back[r]), -1))
            c = int(back[r])
        amount = min(int(need[j]), int(left[r]), *[int(flow[a, b]) for a, b, s in path if s < 0])
        for a, b, s in path:
            flow[a, b] += s * amount
            total += s * amount * float(cost[a, b])
        left[r] -= amount
        need[j] -= amount
    return total


def emd_pairs(signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, work, flow, emd) of signature pairs (a, b): least work of moving b's whole mass out of a's, over that mass.

    ``signatures`` has (sig_id, item_no, feature, weight), weights whole numbers. Null where a has less mass, or b none. Distances are
    Euclidean. Each pair is one small problem of its own group.
    """
    side = lambda k: pairs.select("a", "b", F.col(k).alias("sig_id")).join(signatures, "sig_id").select("a", "b", F.lit(k).alias("side"), "item_no", F.col("feature").cast("array<double>").alias("feature"), F.col("weight").cast("long").alias("weight"))

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "item_no"])
        p, q = pdf[pdf.side == "a"], pdf[pdf.side == "b"]
        work, flow = None, int(q.weight.sum())
        if len(p) and len(q):
            x, y = np.stack(p.feature.to_numpy()), np.stack(q.feature.to_numpy())
            work = transport(np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1)), p.weight.to_numpy(), q.weight.to_numpy())
        return pd.DataFrame({"a": [key[0]], "b": [key[1]], "work": [work], "flow": [flow], "emd": [None if work is None or not flow else work / flow]})

    return side("a").unionByName(side("b")).groupBy("a", "b").applyInPandas(solve, "a long, b long, work double, flow long, emd double")


def emd_1d(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """(key, emd) of histograms (key, bin, weight) on whole-number bins: the sum over bins of the difference of running totals."""
    both = a.select(key, "bin", F.col("weight").alias("d")).unionByName(b.select(key, "bin", (-F.col("weight")).alias("d"))).groupBy(key, "bin").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(key).orderBy("bin")
    run = both.withColumn("run", F.sum("d").over(w)).withColumn("wide", F.lead("bin").over(w) - F.col("bin"))
    return run.groupBy(key).agg(F.coalesce(F.sum(F.abs("run") * F.col("wide")), F.lit(0)).cast("double").alias("emd"))


def emd_match(full: DataFrame, gen: DataFrame, k: int) -> DataFrame:
    """Points of ``full`` matched to ``gen`` so that all generated points share the full cloud evenly, distinct, completed to ``k`` by farthest points.

    An auction per cloud: every point of ``full`` bids for the generated points, each of which takes its even share; a generated point's
    match is its nearest winner.
    """

    def auction(pdf: pd.DataFrame, qdf: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or qdf.empty:
            return pd.DataFrame({"cloud_id": [], "slot": [], "point_idx": []}).astype({"cloud_id": int, "slot": int, "point_idx": int})
        pdf, qdf = pdf.sort_values("point_idx", ignore_index=True), qdf.sort_values("point_idx", ignore_index=True)
        x, y = pdf[list(XYZ)].to_numpy(float), qdf[list(XYZ)].to_numpy(float)
        share = -(-len(x) // len(y))
        left, own, out = np.full(len(y), share), np.full(len(x), -1), np.full(len(y), -1)
        d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None] - 2 * x @ y.T, 0))
        while (own < 0).any():  # each round fills a generated point or places all
            free = np.flatnonzero(own < 0)
            want = np.where(left[None] > 0, d[free], np.inf).argmin(axis=1)
            for j in np.unique(want):
                bids = free[want == j]
                taken = bids[np.argsort(d[bids, j], kind="stable")[: left[j]]]
                own[taken] = j
                left[j] -= len(taken)
        for j in range(len(y)):
            mine = np.flatnonzero(own == j)
            out[j] = mine[d[mine, j].argmin()] if len(mine) else d[:, j].argmin()
        return pd.DataFrame({"cloud_id": pdf.cloud_id.iloc[0], "slot": np.arange(len(y)), "point_idx": pdf.point_idx.to_numpy()[out]})

    cols = ("cloud_id", "point_idx", *XYZ)
    matched = full.select(*cols).groupBy("cloud_id").cogroup(gen.select(*[F.col(c).alias(c) for c in cols]).groupBy("cloud_id")).applyInPandas(auction, "cloud_id long, slot long, point_idx long")
    first = matched.groupBy("cloud_id", "point_idx").agg(F.min("slot").alias("slot"))
    seeds = first.withColumn("seed_no", F.row_number().over(Window.partitionBy("cloud_id").orderBy("slot")) - 1).drop("slot")
    return fps_complete(full, index_points(full.select(*cols), seeds), k)


def _angles(p: list[Column], n: list[Column], q: list[Column], m: list[Column]) -> tuple[Column, Column, Column]:
    """(cos alpha, cos phi, theta) of a point with normal n and a neighbour q with normal m, in the frame of n."""
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    d = [b - a for a, b in zip(p, q)]
    length = F.sqrt(dot(d, d))
    d = [F.try_divide(c, length) for c in d]
    v = [d[1] * n[2] - d[2] * n[1], d[2] * n[0] - d[0] * n[2], d[0] * n[1] - d[1] * n[0]]
    size = F.sqrt(dot(v, v))
    v = [F.try_divide(c, size) for c in v]
    w = [n[1] * v[2] - n[2] * v[1], n[2] * v[0] - n[0] * v[2], n[0] * v[1] - n[1] * v[0]]
    return F.coalesce(dot(v, m), F.lit(0.0)), F.coalesce(dot(n, d), F.lit(0.0)), F.atan2(F.coalesce(dot(w, m), F.lit(0.0)), dot(n, m))


def _angles_of(p: np.ndarray, n: np.ndarray, q: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_angles`` of rows of points and normals, in the same order of sums."""
    dot = lambda a, b: a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]
    cross = lambda a, b: np.stack([a[:, 1] * b[:, 2] - a[:, 2] * b[:, 1], a[:, 2] * b[:, 0] - a[:, 0] * b[:, 2], a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]], axis=1)
    unit = lambda v: np.divide(v, (size := np.sqrt(dot(v, v)))[:, None], out=np.full_like(v, np.nan), where=size[:, None] > 0)
    d = unit(q - p)
    v = unit(cross(d, n))
    w = cross(n, v)
    return np.nan_to_num(dot(v, m)), np.nan_to_num(dot(n, d)), np.arctan2(np.nan_to_num(dot(w, m)), dot(n, m))


def _histograms(xyz: np.ndarray, idx: np.ndarray, n: np.ndarray, has: np.ndarray, radius: float, max_nn: int) -> Iterator[dict[str, np.ndarray]]:
    """(point_idx, bin, value) of the points ``idx`` of one cloud, with the normals ``n`` of those that have one."""
    found = []
    for row, col, d2, _ in nearest(xyz, xyz, max_nn + 1, radius):  # a point is its own nearest, or one of its place is
        row, col, d2 = (v[row != col] for v in (row, col, d2))
        kept = np.arange(len(row)) - np.searchsorted(row, row) < max_nn
        found.append((row[kept], col[kept], d2[kept]))
    row, col, d2 = (np.concatenate(v) for v in zip(*found)) if found else (np.zeros(0, int),) * 3
    if not len(row):
        return
    count = np.bincount(row, minlength=len(xyz))[:, None]
    both = has[row] & has[col]
    i, j = row[both], col[both]
    own = np.zeros(len(xyz) * 33)
    for k, (v, lo, hi) in enumerate(zip(_angles_of(xyz[i], n[i], xyz[j], n[j]), (-1.0, -1.0, -math.pi), (1.0, 1.0, math.pi))):
        bins = np.clip(np.floor((v - lo) / (hi - lo) * 11), 0, 10).astype(np.int64)
        own += np.bincount(i * 33 + 11 * k + bins, minlength=len(own))
    own = 100 * own.reshape(-1, 33) / np.maximum(count, 1)
    apart = d2 > 0
    row, col, w = row[apart], col[apart], 1 / np.sqrt(d2[apart])
    lent = np.zeros_like(own)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        lent[row[first]] = np.add.reduceat(w[:, None] * own[col], first)
    value = own + lent / np.maximum(count, 1)
    value[own.sum(axis=1) == 0] = 0  # without an angle of its own a point has no histogram
    at, bins = np.nonzero(value > 0)
    yield {"point_idx": idx[at], "bin": bins.astype(np.int32), "value": value[at, bins]}


def fpfh(pts: DataFrame, normals: DataFrame, radius: float, max_nn: int = 100, pairs: int = MOST_PAIRS) -> DataFrame:
    """(cloud_id, point_idx, bin, value): feature histograms of 33 bins (three angles, eleven each, in percent) of each point.

    A point's own histogram plus the mean of its neighbours', each weighted by the inverse of its distance. Bins of value 0 have no row.
    Clouds of at most ``pairs`` pairs are worked on within a task, so that neither neighbours nor histograms are shuffled.
    """
    nrm = ["nx", "ny", "nz"]
    blank = normals.select("cloud_id", "point_idx", *[F.lit(None).cast("double").alias(c) for c in XYZ], *[F.col(c).cast("double").alias(c) for c in nrm])
    rows = two_sides(pts.select("cloud_id", "point_idx", *[F.col(c).cast("double").alias(c) for c in XYZ]), blank, nrm, "fpfh-sides")
    large = large_clouds(rows.filter("side = 0").drop("side"), pairs)
    schema = StructType([*[rows.schema[c] for c in ("cloud_id", "point_idx")], *StructType.fromDDL("bin int, value double").fields])

    def work(c):
        p, q = (np.flatnonzero(c["side"] == s) for s in (0, 1))
        xyz, idx = np.stack([c[k][p] for k in XYZ], axis=1), c["point_idx"][p]
        n, has = np.zeros((len(p), 3)), np.zeros(len(p), bool)
        at = np.searchsorted(idx, c["point_idx"][q])
        met = at < len(p)
        met[met] = idx[at[met]] == c["point_idx"][q[met]]
        n[at[met]], has[at[met]] = np.stack([c[k][q[met]] for k in nrm], axis=1), True
        yield from _histograms(xyz, idx, n, has, radius, max_nn)

    if large is None:
        return each_cloud(rows, work, schema, "side", "point_idx")
    few = each_cloud(rows.join(large, "cloud_id", "left_anti"), work, schema, "side", "point_idx")
    sides = [rows.filter(F.col("side") == k).join(large, "cloud_id", "left_semi") for k in (0, 1)]
    return few.unionByName(_fpfh_of_large(sides[0].drop("side", *nrm), sides[1].drop("side", *XYZ), radius, max_nn))


def fpfh_of_points(pts: DataFrame, radius: float, max_nn: int, normal_radius: float, normal_nn: int, pairs: int = MOST_PAIRS) -> DataFrame:
    """``fpfh`` of ``pts`` with their own normals, ``estimate_normals(pts, normal_radius, normal_nn)``.

    Clouds of at most ``pairs`` pairs get normals and histograms in one task, straight from ``pts``: nothing is written on the way, and points
    that are dealt out by cloud are not shuffled again. ``point_idx`` is unique within a cloud.
    """
    pts = pts.select("cloud_id", "point_idx", *[F.col(c).cast("double").alias(c) for c in XYZ])
    large = large_clouds(pts, pairs)
    schema = StructType([*[pts.schema[c] for c in ("cloud_id", "point_idx")], *StructType.fromDDL("bin int, value double").fields])

    def work(c):
        xyz = np.stack([c[k] for k in XYZ], axis=1)
        n, has = np.zeros_like(xyz), np.zeros(len(xyz), bool)
        for at, v, _ in normals_of(xyz, normal_radius, normal_nn):
            n[at], has[at] = v, True
        yield from _histograms(xyz, c["point_idx"], n, has, radius, max_nn)

    if large is None:
        return each_dealt_cloud(pts, work, schema)
    # written, as a broadcast of the ids would do away with how the points are dealt out, and their numbers be made twice
    pts = written(pts, "fpfh-points")
    of = pts.join(large, "cloud_id", "left_semi")
    return each_dealt_cloud(pts.join(large, "cloud_id", "left_anti"), work, schema).unionByName(fpfh(of, estimate_normals(of, normal_radius, normal_nn, pairs), radius, max_nn, pairs))


def _fpfh_of_large(pts: DataFrame, nrm: DataFrame, radius: float, max_nn: int) -> DataFrame:
    side = lambda s: nrm.select("cloud_id", F.col("point_idx").alias(f"{s}_idx"), *[F.col(f"n{c}").alias(f"{s}n{c}") for c in XYZ])
    # a point is its own nearest, or one of its place is: one neighbour more, and then without itself
    near = hybrid(pts, pts, radius, max_nn + 1).filter("a_idx <> b_idx").drop("rank")
    rank = F.row_number().over(Window.partitionBy("cloud_id", "a_idx").orderBy("d2", "b_idx"))
    near = near.withColumn("k", rank).filter(F.col("k") <= max_nn).drop("k")
    near = near.join(pts.select("cloud_id", F.col("point_idx").alias("a_idx"), *[F.col(c).alias(f"a{c}") for c in XYZ]), ["cloud_id", "a_idx"])
    both = near.join(side("a"), ["cloud_id", "a_idx"]).join(side("b"), ["cloud_id", "b_idx"])
    alpha, phi, theta = _angles(*[[F.col(f"{s}{c}") for c in XYZ] for s in ("a", "an", "b", "bn")])
    cut = lambda v, lo, hi: F.greatest(F.least(F.floor((v - lo) / (hi - lo) * 11), F.lit(10)), F.lit(0))
    found = both.select("cloud_id", "a_idx", cut(alpha, -1.0, 1.0).alias("b0"), cut(phi, -1.0, 1.0).alias("b1"), cut(theta, -math.pi, math.pi).alias("b2"))
    bins, key = range(33), ["cloud_id", "a_idx"]
    own = found.groupBy(*key).agg(*[F.sum((F.col(f"b{k // 11}") == k % 11).cast("double")).alias(f"h{k}") for k in bins])
    own = own.join(near.groupBy(*key).agg(F.count("*").alias("n")), key).select(*key, "n", *[(100 * F.col(f"h{k}") / F.col("n")).alias(f"h{k}") for k in bins])
    # a column a bin: neighbours' histograms are added up row by row, none is taken apart
    theirs = own.drop("n").withColumnRenamed("a_idx", "b_idx")
    lent = near.filter("d2 > 0").select(*key, "b_idx", (1 / F.sqrt("d2")).alias("w")).join(theirs, ["cloud_id", "b_idx"])
    lent = lent.groupBy(*key).agg(*[F.sum(F.col("w") * F.col(f"h{k}")).alias(f"l{k}") for k in bins])
    every = own.join(lent, key, "left").select("cloud_id", F.col("a_idx").alias("point_idx"), F.posexplode(F.array(*[F.col(f"h{k}") + F.coalesce(F.col(f"l{k}") / F.col("n"), F.lit(0.0)) for k in bins])).alias("bin", "value"))
    return every.filter("value > 0")


def _correspondences(source: DataFrame, target: DataFrame, size: float) -> DataFrame:
    """Each source point with its nearest target point within ``size``, if any."""
    near = cell_join(source, target, size)
    return near.groupBy("cloud_id", "a_idx").agg(F.min(F.struct("d2", "b_idx", "ax", "ay", "az", "bx", "by", "bz")).alias("m")).select("cloud_id", "a_idx", "m.*")


def _solved(h: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """The 4 x 4 motion of one round, from its normal equations."""
    x = np.linalg.lstsq(h, -rhs, rcond=1e-9)[0]
    (cx, cy, cz), (sx, sy, sz) = np.cos(x[:3]), np.sin(x[:3])
    t = np.eye(4)
    t[:3, :3] = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]]) @ np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]]) @ np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    t[:3, 3] = x[3:]
    return t


def icp(source: DataFrame, target: DataFrame, size: float, init: DataFrame | None = None, iters: int = 10, pairs: int = MOST_PAIRS) -> DataFrame:
    """(cloud_id, m, fitness, rmse): point-to-plane registration of every source cloud to its target (with normals nx, ny, nz).

    Both sides are written once. Clouds of at most ``pairs`` pairs run all rounds within a task, so that no correspondence is shuffled; larger
    ones join in each round (``_icp_of_large``). ``fitness`` is the share of source points with a correspondence.
    """
    nrm = ["nx", "ny", "nz"]
    cols = lambda df, *more: df.select("cloud_id", "point_idx", *[F.col(c).cast("double").alias(c) for c in (*XYZ, *more)])
    rows = two_sides(cols(source), cols(target, *nrm), nrm, "icp-sides")
    clouds = source.select("cloud_id").distinct() if init is None else source.select("cloud_id").distinct().join(init.select("cloud_id", F.col("m").alias("given")), "cloud_id", "left")
    start = F.array(*[F.lit(v) for v in IDENTITY])
    poses = written(clouds.select("cloud_id", (start if init is None else F.coalesce("given", start)).alias("m")), "icp")
    large = large_clouds(rows, pairs)
    few = rows if large is None else rows.join(large, "cloud_id", "left_anti")
    if init is not None:
        moved = transform_points(few.filter("side = 0").select("cloud_id", "point_idx", *XYZ), poses)
        few = two_sides(moved, few.filter("side = 1").drop("side"), nrm, "icp-moved")
    schema = StructType([rows.schema["cloud_id"], *StructType.fromDDL("t array<double>, fitness double, rmse double").fields])

    def work(c):
        a, b = (np.flatnonzero(c["side"] == s) for s in (0, 1))
        if not len(a):
            return
        xyz, n = np.stack([c[k] for k in XYZ], axis=1), np.stack([c[k] for k in nrm], axis=1)[b]
        p, q, t = xyz[a], xyz[b], np.eye(4)
        for k in range(iters + 1):
            now = p @ t[:3, :3].T + t[:3, 3]
            found = list(nearest(now, q, 1, size))
            row, col, d2 = (np.concatenate([f[i] for f in found]) for i in range(3)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            if k == iters or not len(row):
                break
            jac = np.hstack([np.cross(now[row], n[col]), n[col]])
            res = ((now[row] - q[col]) * n[col]).sum(axis=1)
            t = _solved(jac.T @ jac, jac.T @ res) @ t
        yield {"t": [t.ravel().tolist()], "fitness": np.array([len(row) / len(a)]), "rmse": np.array([np.sqrt(d2.mean()) if len(row) else 0.0])}

    @F.pandas_udf("array<double>")
    def after(t: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([(np.array(x).reshape(4, 4) @ np.array(y).reshape(4, 4)).ravel().tolist() for x, y in zip(t, m)])

    out = each_cloud(few, work, schema, "side", "point_idx")
    out = out.withColumnRenamed("t", "m") if init is None else out.join(poses, "cloud_id").select("cloud_id", after("t", "m").alias("m"), "fitness", "rmse")
    if large is None:
        return out
    sides = [rows.filter(F.col("side") == s).drop("side").join(large, "cloud_id", "left_semi") for s in (0, 1)]
    return out.unionByName(_icp_of_large(*sides, size, poses.join(large, "cloud_id", "left_semi"), iters))


def _icp_of_large(source: DataFrame, target: DataFrame, size: float, poses: DataFrame, iters: int) -> DataFrame:
    """Each round joins nearest points within ``size`` by cells, adds up the 6 x 6 normal equations by aggregates, and solves them for
    all clouds in a helper; the matrices are a written table, so the lineage stays short.
    """
    eq = [(i, j) for i in range(6) for j in range(i, 6)]

    @F.pandas_udf("array<double>")
    def solve(m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for old, up, rhs in zip(m, a, b):
            h = np.zeros((6, 6))
            for (i, j), v in zip(eq, up):
                h[i, j] = h[j, i] = v
            out.append((_solved(h, np.array(rhs)) @ np.array(old).reshape(4, 4)).ravel().tolist())
        return pd.Series(out)

    normals = target.select("cloud_id", F.col("point_idx").alias("b_idx"), "nx", "ny", "nz")
    for _ in range(iters):
        pairs = _correspondences(transform_points(source.select("cloud_id", "point_idx", *XYZ), poses), target, size).join(normals, ["cloud_id", "b_idx"])
        p, n = [F.col(f"a{c}") for c in XYZ], [F.col(f"n{c}") for c in XYZ]
        jac = [p[1] * n[2] - p[2] * n[1], p[2] * n[0] - p[0] * n[2], p[0] * n[1] - p[1] * n[0], *n]
        res = sum((F.col(f"a{c}") - F.col(f"b{c}")) * F.col(f"n{c}") for c in XYZ)
        sums = pairs.groupBy("cloud_id").agg(F.array(*[F.sum(jac[i] * jac[j]) for i, j in eq]).alias("a"), F.array(*[F.sum(j * res) for j in jac]).alias("b"))
        moved = poses.join(sums, "cloud_id").select("cloud_id", solve("m", "a", "b").alias("m"))
        poses = written(moved.unionByName(poses.join(sums.select("cloud_id"), "cloud_id", "left_anti")), "icp")
    last = _correspondences(transform_points(source.select("cloud_id", "point_idx", *XYZ), poses), target, size)
    found = last.groupBy("cloud_id").agg(F.count("*").alias("c"), F.sqrt(F.avg("d2")).alias("rmse"))
    sizes = source.groupBy("cloud_id").agg(F.count("*").alias("n"))
    return poses.join(sizes, "cloud_id").join(found, "cloud_id", "left").select("cloud_id", "m", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("fitness"), F.coalesce("rmse", F.lit(0.0)).alias("rmse"))


def information_matrix(pairs: DataFrame) -> DataFrame:
    """(cloud_id, row, col, value): the sum of G'G over correspondences with target points (cloud_id, x, y, z), G = [-[p]x | I].

    Ten sums of products make all 36 entries.
    """
    s = pairs.groupBy("cloud_id").agg(F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"s{c}") for c in XYZ], *[F.sum(F.col(a) * F.col(b)).alias(f"s{a}{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]])
    c, zero = F.col, F.lit(0.0)
    top = [
        [c("syy") + c("szz"), -c("sxy"), -c("sxz"), zero, -c("sz"), c("sy")],
        [-c("sxy"), c("sxx") + c("szz"), -c("syz"), c("sz"), zero, -c("sx")],
        [-c("sxz"), -c("syz"), c("sxx") + c("syy"), -c("sy"), c("sx"), zero],
    ]
    n = [[c("n") if i == j else zero for j in range(3)] for i in range(3)]
    full = top + [[top[j][i + 3] for j in range(3)] + n[i] for i in range(3)]
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("row"), F.lit(j).alias("col"), full[i][j].alias("value")) for i in range(6) for j in range(6)])).alias("e")
    return s.select("cloud_id", cells).select("cloud_id", "e.*")
