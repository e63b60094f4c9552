"""The k nearest points of another set, exactly, without a radius and whatever the density.

Both sets are cut into the same tiles of a bounded number of points along a space-filling curve. Every tile first searches itself,
which bounds how far its points have to look. Boxes of tiles then tell which other tiles may hold something nearer: those whose
least distance is not above that bound. Only these meet, in lots of bounded size, and in them only points whose own bound reaches
the box. No key is a whole cloud: the one task a cloud sees the boxes of its tiles alone, at most ``MOST`` of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .tiles import XYZ, tiled

MOST = 8_192
_TILE = "cloud_id long, tile int, na int, nb int, a_box array<double>, b_box array<double>, reach double, a_idx binary, a_xyz binary, held_d2 binary, held_at binary, b_idx binary, b_xyz binary"


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, added up as x, y, z."""
    x, y, z = (a[:, None, k] - b[None, :, k] for k in range(3))
    return x * x + y * y + z * z


def _gap2(low: np.ndarray, high: np.ndarray, box: np.ndarray) -> np.ndarray:
    """Squared distance between boxes (low..high) and the boxes (rows of six numbers), a little less for safety."""
    gap = np.maximum(np.maximum(box[..., :3] - high, low - box[..., 3:]), 0)
    return (gap * gap).sum(axis=-1) * (1 - 1e-12)


def _box(xyz: np.ndarray) -> list[float]:
    return [*xyz.min(axis=0), *xyz.max(axis=0)] if len(xyz) else []


def knn_tiles(a: DataFrame, b: DataFrame, k: int, a_idx: str = "point_idx", b_idx: str = "point_idx", radius: float | None = None, size: int = 512, lot: int = 64) -> DataFrame:
    """(cloud_id, a_idx, b_idx, d2, bx, by, bz, rank): the ``k`` nearest of ``b`` for each of ``a``, the lower index first on ties; with
    ``radius`` only those within it.

    Indices are whole numbers, unique within a cloud. A cloud without points of ``b`` gives no rows, one with fewer than ``k`` all. Of
    points of ``b`` in one place only the first ``k`` can be among the nearest, so only these are searched.
    """
    far2 = np.inf if radius is None else radius * radius

    def home(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf.side == s] for s in (0, 1)]
        (ai, ax), (bi, bx) = ((p.point_idx.to_numpy(np.int64), np.ascontiguousarray(p[list(XYZ)].to_numpy(np.float64))) for p in sides)
        by = np.argsort(bi)
        bi, bx = bi[by], bx[by]
        all_d2, d2, at = _d2(ax, bx), np.full((len(ax), k), np.inf), np.full((len(ax), k), -1, np.int64)
        if len(bi):
            first = np.argsort(all_d2, axis=1, kind="stable")[:, :k]  # in the order of indices before, so ties stay in it
            d2[:, : first.shape[1]], at[:, : first.shape[1]] = np.take_along_axis(all_d2, first, axis=1), first
        d2[d2 > far2], at[d2 > far2] = np.inf, -1
        reach = min(d2[:, -1].max(), far2) if len(ax) else 0.0
        row = [pdf.cloud_id.iloc[0], pdf.tile.iloc[0], len(ax), len(bx), _box(ax), _box(bx), reach, ai.tobytes(), ax.tobytes(), d2.tobytes(), at.tobytes(), bi.tobytes(), bx.tobytes()]
        return pd.DataFrame([row], columns=[c.split()[0] for c in _TILE.split(", ")])

    def partners(pdf: pd.DataFrame) -> pd.DataFrame:
        """(cloud_id, tile, other, lot): the other tiles that a tile's points may have to look into, nearest first."""
        own, other = pdf[pdf.na > 0], pdf[pdf.nb > 0]
        cols = ["cloud_id", "tile", "other", "lot"]
        if own.empty or other.empty:
            return pd.DataFrame(columns=cols)
        boxes, held, names = np.stack(other.b_box.to_numpy()), other.nb.to_numpy(), other.tile.to_numpy()
        out = []
        for t, box, reach in zip(own.tile, own.a_box, own.reach):
            gap = _gap2(box[:3], box[3:], boxes)
            if np.isinf(reach):  # enough points are as near as the far corners of the nearest boxes
                far = (np.maximum(np.abs(boxes[:, 3:] - box[:3]), np.abs(box[3:] - boxes[:, :3])) ** 2).sum(axis=1) * (1 + 1e-12)
                by = np.argsort(far, kind="stable")
                enough = np.searchsorted(np.cumsum(held[by]), k)
                reach = far[by[enough]] if enough < len(by) else np.inf
            at = np.flatnonzero((gap <= reach) & (names != t))
            at = at[np.argsort(gap[at], kind="stable")]
            out.append(pd.DataFrame({"tile": t, "other": names[at], "lot": np.arange(len(at)) // lot}))
        out = pd.concat(out, ignore_index=True)
        out.insert(0, "cloud_id", pdf.cloud_id.iloc[0])
        return out[cols]

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        """A tile's points among one lot of other tiles; what they found at home goes with the first lot."""
        own = pdf[pdf.other < 0].iloc[0]
        ai, ax = np.frombuffer(own.idx, np.int64), np.frombuffer(own.xyz).reshape(-1, 3)
        d2, at = np.frombuffer(own.held_d2).reshape(-1, k), np.frombuffer(own.held_at, np.int64).reshape(-1, k)
        bi, bx = np.frombuffer(own.b_idx, np.int64), np.frombuffer(own.b_xyz).reshape(-1, 3)
        reach, held = np.minimum(d2[:, -1], far2), (at >= 0) & (own.lot == 0)
        found = [(np.nonzero(held)[0], d2[held], bi[at[held]], bx[at[held]])]
        for p in pdf[pdf.other >= 0].itertuples(index=False):
            near = np.flatnonzero(_gap2(ax, ax, np.asarray(p.box)) <= reach)
            if len(near):
                idx, xyz = np.frombuffer(p.b_idx, np.int64), np.frombuffer(p.b_xyz).reshape(-1, 3)
                d = _d2(ax[near], xyz)
                row, col = np.nonzero(d <= reach[near, None])
                found.append((near[row], d[row, col], idx[col], xyz[col]))
        row, d, idx, xyz = (np.concatenate(c) for c in zip(*found))
        by = np.lexsort((idx, d, row))
        by = by[np.arange(len(by)) - np.searchsorted(row[by], row[by]) < k]
        return pd.DataFrame({"cloud_id": own.cloud_id, "a_idx": ai[row[by]], "b_idx": idx[by], "d2": d[by], "bx": xyz[by, 0], "by": xyz[by, 1], "bz": xyz[by, 2]})

    here = Window.partitionBy("cloud_id", *XYZ).orderBy("point_idx")
    b = b.select("cloud_id", F.col(b_idx).cast("long").alias("point_idx"), *XYZ).withColumn("__place", F.row_number().over(here)).filter(F.col("__place") <= k)
    both = a.select("cloud_id", F.col(a_idx).cast("long").alias("point_idx"), *XYZ, F.lit(0).alias("side")).unionByName(b.select("cloud_id", "point_idx", *XYZ, F.lit(1).alias("side")))
    tiles = written(tiled(both, size, MOST, ["side"]).groupBy("cloud_id", "tile").applyInPandas(home, _TILE), "knn-tiles")
    pairs = tiles.select("cloud_id", "tile", "na", "nb", "a_box", "b_box", "reach").groupBy("cloud_id").applyInPandas(partners, "cloud_id long, tile int, other int, lot int")
    pairs = written(pairs, "knn-pairs")
    blank = lambda *cols: [F.lit(None).cast("binary").alias(c) for c in cols]
    others = pairs.join(tiles.select("cloud_id", F.col("tile").alias("other"), "b_idx", "b_xyz", F.col("b_box").alias("box")), ["cloud_id", "other"])
    lots = pairs.groupBy("cloud_id", "tile").agg((F.max("lot") + 1).alias("lots"))
    each = F.explode(F.sequence(F.lit(0), F.coalesce("lots", F.lit(1)) - 1)).alias("lot")
    own = tiles.filter("na > 0").join(lots, ["cloud_id", "tile"], "left")
    own = own.select("cloud_id", "tile", each, F.lit(-1).alias("other"), "b_idx", "b_xyz", F.col("a_box").alias("box"), F.col("a_idx").alias("idx"), F.col("a_xyz").alias("xyz"), "held_d2", "held_at")
    rows = own.unionByName(others.select("cloud_id", "tile", "lot", "other", "b_idx", "b_xyz", "box", *blank("idx", "xyz", "held_d2", "held_at")))
    near = rows.groupBy("cloud_id", "tile", "lot").applyInPandas(met, "cloud_id long, a_idx long, b_idx long, d2 double, bx double, by double, bz double")
    rank = F.row_number().over(Window.partitionBy("cloud_id", "a_idx").orderBy("d2", "b_idx"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)
