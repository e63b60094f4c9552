"""Work on whole clouds of a bounded size inside tasks: Spark deals the clouds out and sorts them, numpy walks one after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..session import tasks, written

XYZ = ("x", "y", "z")
#: A cloud of more points, or of more pairs than stated, is no work for one task.
MOST_POINTS, MOST_PAIRS = 500_000, 20_000_000
#: Distances held at a time (so few that they stay in the cache), and rows sent on at a time.
_HELD, _SENT = 50_000, 50_000


def _runs(it: Iterator[pa.RecordBatch], key: str = "cloud_id") -> Iterator[pa.Table]:
    """One table for each run of equal cloud ids, or of another ``key``."""
    open_: list[pa.RecordBatch] = []
    for batch in it:
        if not batch.num_rows:
            continue
        ids = batch.column(key)
        edges = (np.flatnonzero(pc.not_equal(ids[1:], ids[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist() if batch.num_rows > 1 else []
        for a, b in zip([0, *edges], [*edges, batch.num_rows]):
            if open_ and (a > 0 or open_[-1].column(key)[-1] != ids[a]):
                yield pa.Table.from_batches(open_)
                open_ = []
            open_.append(batch.slice(a, b - a))
    if open_:
        yield pa.Table.from_batches(open_)


def _made(work: Callable[[dict[str, np.ndarray]], Iterator[dict[str, np.ndarray]]], schema: StructType) -> Callable[[pa.Table], Iterator[pa.Table]]:
    """What ``work`` makes of one cloud, as tables of ``schema``."""
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in schema.fields]

    def made(cloud):
        cols = {c: cloud.column(c).to_numpy() for c in cloud.column_names if c != "cloud_id"}
        for out in work(cols):
            size = len(next(iter(out.values())))
            if size:
                yield pa.table({name: pa.repeat(cloud.column("cloud_id")[0], size) if name == "cloud_id" else out[name] if isinstance(out[name], pa.Array) else pa.array(out[name], kind) for name, kind in kinds})

    return made


def each_dealt_cloud(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], Iterator[dict[str, np.ndarray]]], schema: StructType) -> DataFrame:
    """``each_cloud`` of rows that may be dealt out by cloud already, as ``views.points`` are: these are not shuffled again. Points come in the order of ``point_idx``."""
    made, empty = _made(work, schema), pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields]).empty_table()

    def run(cloud):
        if not pc.all(pc.less_equal(cloud.column("point_idx")[:-1], cloud.column("point_idx")[1:])).as_py():
            cloud = cloud.sort_by("point_idx")
        return pa.concat_tables([empty, *made(cloud)])

    return rows.filter(F.col("cloud_id").isNotNull()).groupBy("cloud_id").applyInArrow(run, schema)


def each_cloud(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], Iterator[dict[str, np.ndarray]]], schema: StructType, *order: str) -> DataFrame:
    """What ``work`` makes of each cloud: it gets the columns but ``cloud_id`` as arrays, in the order of ``order``, and gives out the columns of ``schema`` but ``cloud_id``."""
    made = _made(work, schema)

    def run(it):
        held, n = [], 0
        for cloud in _runs(it):
            for out in made(cloud):
                held.append(out)
                n += out.num_rows
                if n >= _SENT:
                    yield from pa.concat_tables(held).combine_chunks().to_batches()
                    held, n = [], 0
        if held:
            yield from pa.concat_tables(held).combine_chunks().to_batches()

    return rows.filter(F.col("cloud_id").isNotNull()).repartition(tasks(rows.sparkSession), "cloud_id").sortWithinPartitions("cloud_id", *order).mapInArrow(run, schema)


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All squared distances, added up as x, y, z."""
    out = np.subtract.outer(a[:, 0], b[:, 0])
    out *= out
    for k in (1, 2):
        d = np.subtract.outer(a[:, k], b[:, k])
        d *= d
        out += d
    return out


def nearest(a: np.ndarray, b: np.ndarray, k: int, radius: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row of a, row of b, squared distance, rank) of the ``k`` nearest of each point, the first row of ``b`` on ties, some points at a time."""
    far2 = np.inf if radius is None else radius * radius
    if not len(b):
        return
    step = max(1, _HELD // max(len(b), k))
    for at in range(0, len(a), step):
        d = _d2(a[at : at + step], b)
        if k == 1:
            d[np.isnan(d)] = np.inf
            col = d.argmin(axis=1)
            low = d[np.arange(len(d)), col]
            row = np.flatnonzero((low <= far2) & np.isfinite(low))
            yield at + row, col[row], low[row], np.ones(len(row), np.int32)
            continue
        reach = np.full(len(d), far2)
        if k < len(b) and (radius is None or np.count_nonzero(d <= far2) > 8 * k * len(d)):
            reach = np.minimum(np.nan_to_num(np.partition(d, k - 1, axis=1)[:, k - 1], nan=np.inf), far2)
        flat = np.flatnonzero((d <= reach[:, None]) & (d < np.inf))
        (row, col), found = np.divmod(flat, len(b)), d.ravel()[flat]
        by = np.lexsort((found, row))  # stable: lower columns first on ties
        row, col, found = row[by], col[by], found[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        yield at + row[kept], col[kept], found[kept], (rank[kept] + 1).astype(np.int32)


def two_sides(a: DataFrame, b: DataFrame, more: Sequence[str] = (), name: str = "sides") -> DataFrame:
    """(cloud_id, side, point_idx, x, y, z, ``more``) of both sets as one written table, so that each is made once. Side 1 is ``b``, and the one that has ``more``."""
    rows = a.select("cloud_id", F.lit(0).alias("side"), "point_idx", *XYZ, *[F.lit(None).cast("double").alias(c) for c in more])
    return written(rows.unionByName(b.select("cloud_id", F.lit(1).alias("side"), "point_idx", *XYZ, *more)), name)


def large_clouds(rows: DataFrame, pairs: int = MOST_PAIRS, points: int = MOST_POINTS) -> DataFrame | None:
    """Ids of the clouds that are too large for one task, or None where there are none; ``rows`` from ``two_sides``, or one set that meets itself."""
    n = F.count(F.lit(1)).cast("double")
    if "side" in rows.columns:
        n0, n1 = (F.sum((F.col("side") == s).cast("double")) for s in (0, 1))
    else:
        n0 = n1 = n
    found = written(rows.groupBy("cloud_id").agg((n0 * n1).alias("pairs"), n.alias("n")).filter((F.col("pairs") > pairs) | (F.col("n") > points)).select("cloud_id"), "large-clouds")
    return None if found.isEmpty() else found
