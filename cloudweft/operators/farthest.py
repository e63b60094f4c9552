"""Farthest point sampling and its relatives, and grouping points by seeds.

A cloud of up to ``max_points`` is walked pick by pick in one group of a vectorised helper. A larger one is cut into tiles along a
space-filling curve, and the walk goes on in rounds that give exactly the same picks. A tile keeps its points' distances to what is
chosen; new picks change only tiles whose bounding box they come near enough to. It offers its farthest points and a bound for the
others. Distances never grow, so among the offers of all tiles picks go on, in one small task a cloud, as long as the farthest
offer stands above every bound; a pick also lowers the bound of a tile to the distance of the box's far corner.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, written
from .in_task import large_clouds, two_sides
from .nearest import knn_tiles
from .order import ranked
from .sampling import head_points
from .tiles import tiled
from .voxel import voxel_average_trunc

#: How many seeds may seem equally near after a large number was added to their distances.
_TIED = 8
_PICKS = "cloud_id long, place int, point_idx long, x double, y double, z double"


def _d2(xyz: np.ndarray, p: np.ndarray) -> np.ndarray:
    return ((xyz - p) ** 2).sum(axis=1)


def _walk(xyz: np.ndarray, n: int, start: int, known: np.ndarray | None = None) -> np.ndarray:
    """Rows picked: each the first one farthest from all picked before. ``known`` are distances to what is chosen already."""
    best = np.full(len(xyz), 1e10) if known is None else known.copy()
    at, out = start if known is None else int(best.argmax()), np.zeros(n, np.int64)
    for k in range(n):
        out[k] = at
        best = np.minimum(best, _d2(xyz, xyz[at]))
        at = int(best.argmax())
    return out


def _sorted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    pdf = pdf.sort_values("point_idx", ignore_index=True)
    return pdf, pdf[["x", "y", "z"]].to_numpy(np.float64)


def _frame(pdf: pd.DataFrame, rows: np.ndarray, first: int = 0) -> pd.DataFrame:
    out = pdf.loc[rows, ["cloud_id", "point_idx", "x", "y", "z"]].reset_index(drop=True)
    out.insert(1, "place", np.arange(first, first + len(rows), dtype=np.int32))
    return out


def _large(pts: DataFrame, max_points: int) -> DataFrame | None:
    """(cloud_id) of the clouds of more than ``max_points`` points, if there are any."""
    found = written(pts.groupBy("cloud_id").count().filter(F.col("count") > max_points).select("cloud_id"), "fps-large")
    return None if found.isEmpty() else found


def _start(big: DataFrame, start: int) -> DataFrame:
    """(cloud_id, place 0, point_idx, x, y, z): row ``start`` of each cloud, or its last row."""
    if start:
        places = ranked(big, "cloud_id", "point_idx", name="at")
        wanted = places.groupBy("cloud_id").agg(F.least(F.min("at") + start, F.max("at")).alias("at"))
        first = places.join(wanted, ["cloud_id", "at"])
    else:
        first = big.groupBy("cloud_id").agg(F.min(F.struct("point_idx", "x", "y", "z")).alias("p")).select("cloud_id", "p.*")
    return written(first.select("cloud_id", F.lit(0).alias("place"), "point_idx", "x", "y", "z"), "fps-first")


def farthest_point_sample(pts: DataFrame, n: int, start: int = 0, max_points: int = 200_000) -> DataFrame:
    """(cloud_id, place, point_idx, x, y, z): ``n`` picks of each cloud from its row ``start`` on, exactly, whatever its size.

    Ties go to the first index; a cloud of fewer points repeats index 0 once all are picked. ``max_points`` says which clouds are
    walked in tiles, and changes no result.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, xyz = _sorted(pdf)
        return _frame(pdf, _walk(xyz, n, min(start, len(xyz) - 1)))

    rows, large = pts.select("cloud_id", "point_idx", "x", "y", "z"), _large(pts, max_points)
    if large is None:
        return rows.groupBy("cloud_id").applyInPandas(pick, _PICKS)
    big = rows.join(large, "cloud_id", "left_semi")
    first = _start(big, start)
    small = rows.join(large, "cloud_id", "left_anti").groupBy("cloud_id").applyInPandas(pick, _PICKS)
    return small.unionByName(_tile_walk(big, first, n, 1e10))


#: A tile: its points and their distances as packed numbers, its offers (index, x, y, z, distance), and of the other points the first
#: one in the order of picks (distance, index) and the lowest index.
_TILE = "cloud_id long, tile int, tiles int, done int, idx binary, xyz binary, d binary, box array<double>, offers binary, rest double, rest_idx long, low_idx long"


def _tile_walk(pts: DataFrame, first: DataFrame, n: int, unknown: float, size: int = 1024, offers: int = 131_072) -> DataFrame:
    """Picks of every cloud of ``first`` (cloud_id, place, point_idx, x, y, z: what is chosen already) up to ``n`` rows a cloud.

    ``unknown`` is the distance before anything is chosen. A round maps over the tiles, and walks over their offers, about
    ``offers`` a cloud. Tiles are rows of written tables, so a lost executor costs its tiles of one round.
    """
    names = [c.split()[0] for c in _TILE.split(", ")]

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        tiles = int(pdf.tiles.iloc[0])
        pdf, xyz = _sorted(pdf)
        box = [*xyz.min(axis=0), *xyz.max(axis=0)]
        row = [pdf.cloud_id[0], pdf.tile[0], tiles, 0, pdf.point_idx.to_numpy(np.int64).tobytes(), xyz.tobytes(), np.full(len(xyz), unknown).tobytes(), box, b"", 0.0, 0, 0]
        return pd.DataFrame([row], columns=names)

    def near(it):
        """Tiles after the new picks; one that they don't come near to stays as it is."""
        for pdf in it:
            out = []
            for r in pdf.to_dict("records"):
                new = np.asarray(r.pop("new"), np.float64).reshape(-1, 3)
                d, box = np.frombuffer(r["d"]), np.asarray(r["box"], np.float64)
                gap = np.maximum(np.maximum(box[:3] - new, new - box[3:]), 0)
                hits = new[(gap**2).sum(axis=1) * (1 - 1e-12) < d.max()]
                r["done"] += len(new)
                if len(hits) or not r["offers"]:
                    xyz, idx = np.frombuffer(r["xyz"]).reshape(-1, 3), np.frombuffer(r["idx"], np.int64)
                    for p in hits:
                        d = np.minimum(d, _d2(xyz, p))
                    m = max(8, offers // r["tiles"])
                    order = np.lexsort((idx, -d))
                    top, rest = order[:m], order[m:]
                    r |= {"d": d.tobytes(), "offers": np.column_stack([idx[top].view(np.float64), xyz[top], d[top]]).tobytes()}
                    r |= {"rest": d[rest[0]], "rest_idx": idx[rest[0]], "low_idx": idx[rest].min()} if len(rest) else {"rest": -1.0}
                out.append(r)
            if out:
                yield pd.DataFrame(out, columns=names)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        """Picks among the offers of one cloud's tiles, as long as none of the other points can come first."""
        rows = np.concatenate([np.frombuffer(x).reshape(-1, 5) for x in pdf.offers])
        idx = rows[:, 0].copy().view(np.int64)
        by = np.argsort(idx, kind="stable")
        idx, xyz, d = idx[by], np.ascontiguousarray(rows[by, 1:4]), rows[by, 4].copy()
        rest, ahead = pdf.rest.to_numpy(np.float64).copy(), pdf.rest_idx.to_numpy(np.int64).copy()
        low, box, out = pdf.low_idx.to_numpy(np.int64), np.stack(pdf.box.to_numpy()), []
        for place in range(int(pdf.done.iloc[0]), n):
            at = int(d.argmax())
            if ((rest > d[at]) | ((rest == d[at]) & (ahead < idx[at]))).any():
                break
            out.append((pdf.cloud_id.iloc[0], place, idx[at], *xyz[at]))
            d = np.minimum(d, _d2(xyz, xyz[at]))
            far = (np.maximum(np.abs(box[:, :3] - xyz[at]), np.abs(box[:, 3:] - xyz[at])) ** 2).sum(axis=1) * (1 + 1e-12)
            less = far < rest
            rest[less], ahead[less] = far[less], low[less]
        return pd.DataFrame(out, columns=["cloud_id", "place", "point_idx", "x", "y", "z"])

    rows = written(tiled(pts, size).groupBy("cloud_id", "tile").applyInPandas(packed, _TILE), "fps-tiles")
    new, out = first, first
    while True:
        at = F.transform(F.sort_array(F.collect_list(F.struct("place", "x", "y", "z"))), lambda p: F.array(p["x"], p["y"], p["z"]))
        step = rows.join(new.groupBy("cloud_id").agg(F.flatten(at).alias("new")), "cloud_id").select(*names, "new").mapInPandas(near, _TILE)
        before, rows = rows, written(step.filter(F.col("done") < n), "fps-tiles")
        discard(before)
        if rows.isEmpty():
            return out.filter(F.col("place") < n)
        new = written(rows.select("cloud_id", "done", "offers", "rest", "rest_idx", "low_idx", "box").groupBy("cloud_id").applyInPandas(walk, _PICKS), "fps-picks")
        out = out.unionByName(new)


def _last_point(xyz: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each farthest from the pick before it (first ``at``); picked rows go."""
    left, out = np.arange(len(xyz)), []
    for _ in range(min(n, len(xyz))):
        k = int(_d2(xyz[left], at).argmax())
        out.append(left[k])
        at, left = xyz[left[k]], np.delete(left, k)
    return np.array(out, np.int64)


def _tile_last_point(pts: DataFrame, first: DataFrame, n: int, after: int, size: int = 1024) -> DataFrame:
    """Up to ``n`` picks a cloud, each farthest from the one before, the first from the place (cloud_id, x, y, z) of ``first``; places count from ``after``.

    Tiles are opened on demand: a walk sees the points of open tiles and the boxes of the others. A pick stands if no closed box
    reaches as far; if one does, the boxes that may hold the farthest point are opened and the walk is made again. Points only go
    from open tiles, so the sides of closed boxes have points, which bounds from below how far one reaches.
    """

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, xyz = _sorted(pdf)
        row = [pdf.cloud_id[0], pdf.tile[0], pdf.point_idx.to_numpy(np.int64).tobytes(), xyz.tobytes(), [*xyz.min(axis=0), *xyz.max(axis=0)]]
        return pd.DataFrame([row], columns=["cloud_id", "tile", "idx", "xyz", "box"])

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        names = ["cloud_id", "place", "point_idx", "x", "y", "z", "wanted"]
        cloud, at, seen = pdf.cloud_id.iloc[0], pdf[["x", "y", "z"]].to_numpy(np.float64)[0], pdf.idx.notna().to_numpy()
        idx = np.frombuffer(b"".join(pdf.idx[seen]), np.int64)
        by = np.argsort(idx, kind="stable")
        idx, xyz = idx[by], np.frombuffer(b"".join(pdf.xyz[seen])).reshape(-1, 3)[by]
        closed, box = pdf.tile.to_numpy()[~seen], np.array(pdf.box[~seen].tolist()).reshape(-1, 6)
        gone, out = np.zeros(len(idx), bool), []
        for place in range(after, after + n):
            d = np.where(gone, -1.0, _d2(xyz, at))
            k = int(d.argmax()) if len(d) else 0
            best = d[k] if len(d) else -1.0
            far = (np.maximum(np.abs(box[:, :3] - at), np.abs(box[:, 3:] - at)) ** 2).sum(axis=1) * (1 + 1e-12)
            if (far >= best).any():
                gap = np.maximum(np.maximum(box[:, :3] - at, at - box[:, 3:]), 0) ** 2
                sides = np.maximum(np.abs(box[:, :3] - at), np.abs(box[:, 3:] - at)) ** 2
                reach = (sides + gap.sum(axis=1, keepdims=True) - gap).max(axis=1) * (1 - 1e-12)
                wanted = closed[far >= max(best, reach.max())]
                return pd.DataFrame([(cloud, 0, 0, 0.0, 0.0, 0.0, int(t)) for t in wanted], columns=names)
            if best < 0:
                break
            gone[k], at = True, xyz[k]
            out.append((cloud, place, idx[k], *at, -1))
        return pd.DataFrame(out, columns=names)

    tiles = written(tiled(pts, size).groupBy("cloud_id", "tile").applyInPandas(packed, "cloud_id long, tile int, idx binary, xyz binary, box array<double>"), "last-tiles")
    left = tiles.join(first.select("cloud_id", "x", "y", "z"), "cloud_id")
    opened, out = None, None
    while True:
        shown = left.withColumns({"idx": F.lit(None).cast("binary"), "xyz": F.lit(None).cast("binary")})
        if opened is not None:
            at = left.join(opened.withColumn("open", F.lit(True)), ["cloud_id", "tile"], "left").join(opened.select("cloud_id").distinct(), "cloud_id", "left_semi")
            shown = at.withColumns({c: F.when(F.col("open"), F.col(c)) for c in ("idx", "xyz")}).drop("open")
        step = written(shown.groupBy("cloud_id").applyInPandas(walk, f"{_PICKS}, wanted int"), "last-picks")
        asked = step.filter("wanted >= 0").select("cloud_id", F.col("wanted").alias("tile"))
        picks = step.filter("wanted < 0").drop("wanted")
        out = picks if out is None else out.unionByName(picks)
        if asked.isEmpty():
            return out
        # clouds that ask for nothing are done
        still = asked.select("cloud_id").distinct()
        opened = written(asked if opened is None else asked.unionByName(opened.join(still, "cloud_id", "left_semi")), "last-open")


def last_point_sample(pts: DataFrame, n: int, start: int = 0, max_points: int = 200_000) -> DataFrame:
    """Picks farthest from the pick before alone. The start row is not removed and may be picked once more.

    A cloud of over ``max_points`` points is searched in tiles, with the same picks.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, xyz = _sorted(pdf)
        first = min(start, len(xyz) - 1)
        return _frame(pdf, np.concatenate([[first], _last_point(xyz, xyz[first], n - 1)]))

    rows, large = pts.select("cloud_id", "point_idx", "x", "y", "z"), _large(pts, max_points)
    if large is None:
        return rows.groupBy("cloud_id").applyInPandas(pick, _PICKS)
    big = rows.join(large, "cloud_id", "left_semi")
    first = _start(big, start)
    small = rows.join(large, "cloud_id", "left_anti").groupBy("cloud_id").applyInPandas(pick, _PICKS)
    return small.unionByName(first).unionByName(_tile_last_point(big, first, n - 1, 1))


def fps_complete(pts: DataFrame, seeds: DataFrame, k: int, max_points: int = 200_000) -> DataFrame:
    """The seeds (cloud_id, seed_no, x, y, z) of each cloud in order, then farthest points up to ``k`` rows; seeds have no point_idx.

    A cloud of over ``max_points`` points is walked in tiles, with the same picks.
    """

    def pick(pdf: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("seed_no", ignore_index=True)
        head = own[["cloud_id", "x", "y", "z"]].head(k)
        head.insert(1, "place", np.arange(len(head), dtype=np.int32))
        head.insert(2, "point_idx", pd.array([None] * len(head), dtype="Int64"))
        if pdf.empty or len(own) >= k:
            return head
        pdf, xyz = _sorted(pdf)
        known = None
        for p in own[["x", "y", "z"]].to_numpy(np.float64):
            known = _d2(xyz, p) if known is None else np.minimum(known, _d2(xyz, p))
        return pd.concat([head, _frame(pdf, _walk(xyz, k - len(own), 0, known), len(own))], ignore_index=True)

    rows, large = pts.select("cloud_id", "point_idx", "x", "y", "z"), _large(pts, max_points)
    own = seeds.select(*[F.col(c).alias(c) for c in ("cloud_id", "seed_no", "x", "y", "z")])
    cut = (lambda df, how: df.join(large, "cloud_id", how)) if large is not None else (lambda df, how: df)
    small = cut(rows, "left_anti").groupBy("cloud_id").cogroup(cut(own, "left_anti").groupBy("cloud_id")).applyInPandas(pick, _PICKS)
    if large is None:
        return small
    place = (F.row_number().over(Window.partitionBy("cloud_id").orderBy("seed_no")) - 1).cast("int")
    first = written(cut(own, "left_semi").select("cloud_id", place.alias("place"), F.lit(None).cast("long").alias("point_idx"), "x", "y", "z"), "fps-first")
    seeded = first.select("cloud_id").distinct()
    out = small.unionByName(_tile_walk(rows.join(seeded, "cloud_id", "left_semi"), first, k, float("inf")))
    bare = large.join(seeded, "cloud_id", "left_anti")
    return out if bare.isEmpty() else out.unionByName(farthest_point_sample(rows.join(bare, "cloud_id", "left_semi"), k, max_points=max_points))


def voxel_fps_sample(pts: DataFrame, n: int = 1024, size: float = 1e-5, m: int = 700, start: int = 0) -> DataFrame:
    """The first ``m`` voxel means, then farthest points of the whole cloud (not seeded by the means) up to ``n`` rows."""
    means = voxel_average_trunc(pts, size, min(m, n)).select("cloud_id", "place", F.lit(None).cast("long").alias("point_idx"), "x", "y", "z")
    held = means.groupBy("cloud_id").agg(F.count("*").alias("held"))
    picks = farthest_point_sample(pts, n, start).join(held, "cloud_id").filter(F.col("place") < n - F.col("held"))
    return means.unionByName(picks.withColumn("place", (F.col("place") + F.col("held")).cast("int")).drop("held"))


def head_last_point_sample(pts: DataFrame, n: int = 1024, m: int = 700, max_points: int = 200_000) -> DataFrame:
    """The first ``m`` rows, then last-point picks of the rest, from row m - 1 on. A cloud of ``m`` rows or fewer stays as it is.

    A cloud of over ``max_points`` points is searched in tiles, with the same picks.
    """

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, xyz = _sorted(pdf)
        return _frame(pdf, _last_point(xyz[m:], xyz[m - 1], n - m) + m, m) if len(xyz) > m else _frame(pdf, np.zeros(0, np.int64))

    rows, large = pts.select("cloud_id", "point_idx", "x", "y", "z"), _large(pts, max(max_points, m))
    rest = (rows if large is None else rows.join(large, "cloud_id", "left_anti")).groupBy("cloud_id").applyInPandas(pick, _PICKS)
    if large is not None:
        big = rows.join(large, "cloud_id", "left_semi")
        first = _start(big, m - 1)
        beyond = big.join(first.select("cloud_id", F.col("point_idx").alias("last")), "cloud_id").filter("point_idx > last").drop("last")
        rest = rest.unionByName(_tile_last_point(beyond, first, n - m, m))
    head = head_points(pts, min(m, n)).select("cloud_id", F.col("point_idx").cast("int").alias("place"), "point_idx", "x", "y", "z")
    return head.unionByName(rest)


def group_last_seed(pts: DataFrame, seeds: DataFrame, r: float) -> DataFrame:
    """(cloud_id, point_idx, label): the last seed nearer than ``r``, else 0."""
    from .neighbors import cell_join

    near = cell_join(seeds, pts, r, a_idx="seed_no").filter(F.sqrt("d2") < r).groupBy("cloud_id", F.col("b_idx").alias("point_idx")).agg(F.max("a_idx").cast("long").alias("label"))
    return pts.select("cloud_id", "point_idx").join(near, ["cloud_id", "point_idx"], "left").select("cloud_id", "point_idx", F.coalesce("label", F.lit(0)).alias("label"))


def group_nearest_seed(pts: DataFrame, seeds: DataFrame, r: float, include_last: bool = True) -> DataFrame:
    """(cloud_id, point_idx, label): the nearest seed, the first on ties; distances above ``r`` count 1e6 r more.

    Without ``include_last`` the last seed owns nothing, as where distances are those of the last step. The addition can make equal what
    differed by less than its rounding, so the ``_TIED`` nearest seeds of a point are compared with it.
    """
    from .neighbors import _folded, _indexed, _side_of

    if not include_last:
        last = Window.partitionBy("cloud_id")
        seeds = seeds.withColumn("__last", F.max("seed_no").over(last)).filter("seed_no < __last").drop("__last")
    rows = two_sides(_indexed(pts, "point_idx"), _indexed(seeds, "seed_no"))

    def least(c, at, d2, first):
        d, seed = np.sqrt(d2), c["point_idx"][at]
        row = np.repeat(np.arange(len(first)), np.diff(first, append=len(d2)))
        yield "label", seed[np.lexsort((seed, np.where(d > r, d + 1e6 * r, d), row))[first]]

    if (large := large_clouds(rows)) is None:
        return _folded(rows, _TIED, [("label", "long")], least)
    d = F.sqrt("d2")
    far = F.when(d > r, d + 1e6 * r).otherwise(d)
    near = knn_tiles(_side_of(rows, 0, large), _side_of(rows, 1, large), _TIED)
    few = _folded(rows.join(large, "cloud_id", "left_anti"), _TIED, [("label", "long")], least)
    return few.unionByName(near.groupBy("cloud_id", F.col("a_idx").alias("point_idx")).agg(F.min_by(F.col("b_idx").cast("long"), F.struct(far, "b_idx")).alias("label")))


def sampling_report(pts: DataFrame, samples: dict[str, DataFrame]) -> DataFrame:
    """(sampler, clouds, kept, share): what each sampler keeps of all points."""
    total = pts.agg(F.count("*").alias("total"))
    out = None
    for name, df in samples.items():
        one = df.agg(F.lit(name).alias("sampler"), F.countDistinct("cloud_id").alias("clouds"), F.count("*").alias("kept"))
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(total)).select("sampler", "clouds", "kept", (F.col("kept") / F.col("total")).alias("share"))
