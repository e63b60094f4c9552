"""Hand cases, properties and plans."""

from __future__ import annotations

import math
import re
import struct

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cloudweft import plans, session
from cloudweft.functions import keyed
from cloudweft.operators import augment as A
from cloudweft.operators import blocks as B
from cloudweft.operators import catalog as C
from cloudweft.operators import farthest as P
from cloudweft.operators import geometry as G
from cloudweft.operators import metrics as M
from cloudweft.operators import neighbors as N
from cloudweft.operators import nearest as NE
from cloudweft.operators import order as O
from cloudweft.operators import register as R
from cloudweft.operators import sampling as S
from cloudweft.operators import text as T
from cloudweft.operators import tiles as TL
from cloudweft.operators import voxel as X
from cloudweft.sources import points as SP
from cloudweft.sources import texts as ST

PTS = "cloud_id long, point_idx long, x double, y double, z double"


def cloud(spark, xyz, cloud_id=0):
    return spark.createDataFrame([(cloud_id, k, *map(float, p)) for k, p in enumerate(xyz)], PTS)


def picks(df):
    return [r.point_idx for r in sorted(df.collect(), key=lambda r: r.place)]


def test_farthest_points_of_a_circle_are_two_diameters(spark):
    got = picks(P.farthest_point_sample(SP.circle_cloud(spark, 1.0, 8), 4))
    assert got[:2] == [0, 4] and sorted(got[2:]) == [2, 6]  # their distances tie but for the last bit


def test_farthest_points_of_a_diagonal(spark):
    pts = cloud(spark, [(v, v, v) for v in (0.1, 1, 2.1, 3, 4, 5)])
    assert picks(P.farthest_point_sample(pts, 3, 1)) == [1, 5, 3]


def test_farthest_point_sampling_of_small_clouds_repeats_the_first(spark):
    pts = cloud(spark, [(0, 0, 0), (1, 0, 0)]).unionByName(cloud(spark, [(5, 5, 5)], 1))
    got = P.farthest_point_sample(pts, 4).collect()
    assert [r.point_idx for r in sorted(got, key=lambda r: r.place) if r.cloud_id == 0] == [0, 1, 0, 0]
    assert [r.point_idx for r in got if r.cloud_id == 1] == [0, 0, 0, 0]


def test_farthest_points_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    pts = cloud(spark, rng.integers(0, 9, (60, 3)))
    assert picks(P.farthest_point_sample(pts.repartition(7), 9)) == picks(P.farthest_point_sample(pts.orderBy(F.desc("x")), 9))


def _greedy(xyz, n, at, best=None):
    best, out = np.full(len(xyz), 1e10) if best is None else best, []
    for k in range(n):
        at = at if k == 0 and at is not None else int(best.argmax())
        out.append(at)
        best = np.minimum(best, ((xyz - xyz[at]) ** 2).sum(axis=1))
    return out


def _of(rows, cloud_id=0):
    return [r.point_idx for r in sorted((r for r in rows if r.cloud_id == cloud_id), key=lambda r: r.place)]


@pytest.mark.parametrize("start", [0, 7, 10**6])
def test_large_clouds_are_walked_in_tiles_exactly(spark, start):
    rng = np.random.default_rng(2)
    clouds = {0: rng.random((5000, 3)), 1: rng.integers(0, 12, (3000, 3)).astype(float), 2: np.ones((1500, 3)), 3: rng.random((50, 3)), 4: np.concatenate([rng.random((2000, 3)), 5 + rng.random((900, 3)) * 1e-3, np.full((600, 3), 9.0)])}
    rows = [(c, k, *map(float, p)) for c, xyz in clouds.items() for k, p in enumerate(xyz)]
    pts = spark.createDataFrame(rows, "cloud_id long, point_idx long, x double, y double, z double")
    got = P.farthest_point_sample(pts, 120, start, max_points=1200).collect()
    assert set(got[0].asDict()) == {"cloud_id", "place", "point_idx", "x", "y", "z"}
    for c, xyz in clouds.items():
        assert _of(got, c) == _greedy(xyz, 120, min(start, len(xyz) - 1)), c


def test_a_cloud_of_300_000_points(spark):
    xyz = np.random.default_rng(4).normal(size=(300_000, 3))
    pdf = pd.DataFrame(xyz, columns=["x", "y", "z"])
    pdf["cloud_id"], pdf["point_idx"] = 0, np.arange(len(xyz))
    got = P.farthest_point_sample(spark.createDataFrame(pdf), 256).collect()
    assert _of(got) == _greedy(xyz, 256, 0)


def test_large_clouds_are_completed_in_tiles_exactly(spark):
    rng = np.random.default_rng(3)
    clouds = {0: rng.random((3000, 3)), 1: rng.integers(0, 9, (2500, 3)).astype(float), 2: rng.random((40, 3)), 3: rng.random((2000, 3))}
    pts = spark.createDataFrame([(c, k, *map(float, p)) for c, xyz in clouds.items() for k, p in enumerate(xyz)], "cloud_id long, point_idx long, x double, y double, z double")
    held = {c: rng.random((m, 3)) * 3 for c, m in ((0, 5), (1, 70), (2, 3))}
    seeds = spark.createDataFrame([(c, k, *map(float, p)) for c, xyz in held.items() for k, p in enumerate(xyz)], "cloud_id long, seed_no long, x double, y double, z double")
    got = P.fps_complete(pts, seeds, 60, max_points=1000).collect()
    for c, xyz in clouds.items():
        own = held.get(c)
        best = None if own is None else np.min([((xyz - p) ** 2).sum(axis=1) for p in own], axis=0)
        rest = _greedy(xyz, 60, 0) if own is None else [None] * min(60, len(own)) + _greedy(xyz, max(0, 60 - len(own)), None, best)
        assert _of(got, c) == rest, c


def test_tiles_are_bounded_whatever_the_density(spark):
    rng = np.random.default_rng(5)
    xyz = np.concatenate([rng.random((3000, 3)), np.full((4000, 3), 0.5), 0.5 + rng.random((3000, 3)) * 1e-9])
    tiles = TL.tiled(cloud(spark, xyz), size=100).groupBy("tile").agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).collect()
    assert len(tiles) == 100 and {r.n for r in tiles} == {100}
    assert np.median([max(r.x, r.y, r.z) for r in tiles]) < 0.3


def _nearest(a, b, k):
    d = ((a[:, None, 0] - b[None, :, 0]) ** 2 + (a[:, None, 1] - b[None, :, 1]) ** 2) + (a[:, None, 2] - b[None, :, 2]) ** 2
    return {(i, r + 1): (int(j), float(d[i, j])) for i in range(len(a)) for r, j in enumerate(np.lexsort((np.arange(len(b)), d[i]))[:k])}


@pytest.mark.parametrize("k", [1, 3, 7])
def test_nearest_in_tiles_is_exact_whatever_the_density(spark, k):
    rng = np.random.default_rng(k)
    dense = lambda n: np.concatenate([rng.random((n // 3, 3)), 0.5 + rng.random((n // 3, 3)) * 1e-6, np.full((n // 3, 3), 0.25)])
    sides = {0: (rng.random((500, 3)), rng.random((700, 3))), 1: (dense(600), dense(300)), 2: (rng.integers(0, 6, (400, 3)).astype(float), rng.integers(0, 6, (300, 3)).astype(float)), 3: (rng.random((300, 3)), 50 + rng.random((2, 3))), 4: (rng.random((3, 3)) - 9, rng.random((900, 3)))}
    a, b = (spark.createDataFrame([(c, i, *map(float, p)) for c, v in sides.items() for i, p in enumerate(v[s])], PTS) for s in (0, 1))
    want = {(c, i, r): v for c, (x, y) in sides.items() for (i, r), v in _nearest(x, y, k).items()}
    for found in (NE.knn_tiles(a, b, k, size=64, lot=4), N.knn(a, b, k, pairs=100_000)):
        assert {(r.cloud_id, r.a_idx, r["rank"]): (r.b_idx, r.d2) for r in found.collect()} == want
    within = NE.knn_tiles(a, b, k, radius=0.3, size=64, lot=4).collect()
    assert {(r.cloud_id, r.a_idx, r["rank"]): (r.b_idx, r.d2) for r in within} == {at: v for at, v in want.items() if v[1] <= 0.3 * 0.3}
    assert all((r.bx, r.by, r.bz) == tuple(map(float, sides[r.cloud_id][1][r.b_idx])) for r in within)


def test_nearest_of_large_clouds_joins_no_whole_cloud(spark):
    pts = cloud(spark, np.random.default_rng(0).random((300, 3)))
    plan = N.nn_distance(pts, pts.filter("point_idx % 3 = 0")).select("d2")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(cloud_id#" in plan  # few pairs: ranked as they are
    plan = NE.knn_tiles(pts, pts, 2, size=50)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line or "BroadcastHashJoin" in line]
    assert joins and not any(re.search(r"Join \[cloud_id#\d+L?\]", line) for line in joins)


def test_a_place_that_holds_a_third_of_a_cloud_meets_few_tiles(spark):
    xyz = np.concatenate([np.random.default_rng(8).random((4000, 3)), np.full((2000, 3), 0.5)])
    got = NE.knn_tiles(cloud(spark, xyz), cloud(spark, xyz), 3, size=100).filter("a_idx >= 4000").groupBy("rank").agg(F.min("b_idx").alias("low"), F.max("b_idx").alias("high"), F.max("d2").alias("d2")).collect()
    assert {(r["rank"], r.low, r.high, r.d2) for r in got} == {(k + 1, 4000 + k, 4000 + k, 0.0) for k in range(3)}


def test_a_crowded_cell_gives_the_same_neighbours(spark):
    rng = np.random.default_rng(9)
    xyz = np.concatenate([rng.random((300, 3)) * 10, 5 + rng.random((300, 3)) * 1e-3, np.full((100, 3), 2.0)])
    pts = cloud(spark, xyz).unionByName(cloud(spark, rng.random((100, 3)) * 10, 1))
    rows = lambda df: sorted((r.cloud_id, r.a_idx, r["rank"], r.b_idx, r.d2, r.bx) for r in df.collect())
    assert rows(N.hybrid(pts, pts, 1.0, 6, crowd=1)) == rows(N.hybrid(pts, pts, 1.0, 6, crowd=10**9))


def _windows(xy, size):
    return (np.abs(xy[:, None] - xy[None]) <= size / 2).all(axis=2).sum(axis=1)


def test_valid_centres_are_those_counted_one_by_one(spark):
    rng = np.random.default_rng(11)
    clouds = {0: rng.random((900, 3)) * 8, 1: rng.integers(0, 16, (900, 3)) / 4.0, 2: np.concatenate([rng.random((700, 3)), rng.random((200, 3)) * 9]), 3: -np.ones((60, 3))}
    pts = spark.createDataFrame([(c, k, *map(float, p)) for c, xyz in clouds.items() for k, p in enumerate(xyz)], PTS)
    for more_than in (10, 40, 59, 200):
        got = {(r.cloud_id, r.point_idx) for r in B.valid_centres(pts, 2.0, more_than).collect()}
        assert got == {(c, k) for c, xyz in clouds.items() for k, m in enumerate(_windows(xyz[:, :2], 2.0)) if m > more_than}


def test_a_block_is_lost_only_where_a_room_has_no_centre(spark):
    rng = np.random.default_rng(12)
    rare = np.concatenate([rng.random((40, 3)), 10 + rng.random((2000, 3)) * 400])  # one dense spot that draws hardly hit
    pts = cloud(spark, rare).unionByName(cloud(spark, 10 + rng.random((300, 3)) * 400, 1)).withColumns({"r": F.lit(1), "g": F.lit(2), "b": F.lit(3), "label": F.lit(0)})
    plan = spark.createDataFrame([(c, k) for c in (0, 1) for k in range(50)], "cloud_id long, rep int")
    got = B.centre_blocks(pts, plan, 8, 2.0, min_points=30, tries=2, seed=1).groupBy("cloud_id", "rep").agg(F.count("*").alias("n"), F.max("point_idx").alias("most")).collect()
    assert {(r.cloud_id, r.rep) for r in got} == {(0, k) for k in range(50)} and {r.n for r in got} == {8} and max(r.most for r in got) < 40


def test_global_ranks(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), float(v)) for k, v in enumerate(rng.integers(0, 50, 5000))] + [(5000, None)]
    got = O.ranked(spark.createDataFrame(rows, "k long, v double").repartition(13), "v", "k").collect()
    assert [r.k for r in sorted(got, key=lambda r: r["rank"])] == [k for k, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))]
    assert sorted(r["rank"] for r in got) == list(range(len(rows)))
    assert O.ranked(spark.createDataFrame([], "k long"), "k").count() == 0
    sums = O.ranked(spark.createDataFrame([(k, k % 4) for k in range(1000)], "k long, n int"), "k", name="before", of="n").collect()
    assert {r.k: r.before for r in sums} == {k: sum(i % 4 for i in range(k)) for k in range(1000)}


def test_ranks_inside_groups(spark):
    rng = np.random.default_rng(8)
    rows = [(None if k % 50 == 0 else int(k % 3 and 7), int(rng.integers(40)), k) for k in range(900)]
    got = O.ranked_inside(spark.createDataFrame(rows, "g int, a int, k int"), "g", "a", "k", name="r", size="n").collect()
    for g in (None, 0, 7):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.r)
        assert [(r.a, r.k) for r in own] == sorted((a, k) for h, a, k in rows if h == g)
        assert [r.r for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}


@pytest.mark.parametrize("of", ["random", "exact", "unit", "dropout"])
def test_no_window_is_a_whole_cloud(spark, of):
    pts = cloud(spark, np.random.default_rng(1).random((50, 3)))
    make = {"random": lambda: S.random_down_sample(pts, 0.5), "exact": lambda: S.uniform_to_n(pts, 7), "unit": lambda: G.normalize_unit(pts), "dropout": lambda: A.point_dropout(pts)}
    df = make[of]()
    assert df.count() == {"random": 25, "exact": 7}.get(of, 50) and df.columns == pts.columns
    assert "windowspecdefinition(cloud_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_keyed_numbers(spark):
    n = 1_000_003
    far = spark.range(5, 8).crossJoin(spark.createDataFrame([(0,), (1,), (n,), (2 * n,), (n * n,)], "p long")).select(keyed.uniform(F.col("id"), F.col("p")).alias("u"))
    assert far.distinct().count() == 15  # points beyond any factor share no number with other clouds
    many = spark.range(2_000_000).select((F.col("id") % 1000 - 500).alias("c"), F.floor(F.col("id") / 1000).alias("p"))
    many = many.select(keyed.uniform(F.col("c"), F.col("p"), 3).alias("u"), keyed.uniform(F.col("c"), F.col("p") + 1, 3).alias("v"), keyed.uniform(F.col("c"), F.col("p"), 3, 1).alias("w"), keyed.gaussian(F.col("c"), F.col("p"), 3).alias("g"))
    r = many.agg(F.count_distinct("u").alias("n"), F.min("u").alias("lo"), F.max("u").alias("hi"), F.avg("u").alias("mean"), F.var_pop("u").alias("var"), F.corr("u", "v").alias("uv"), F.corr("u", "w").alias("uw"), F.avg("g").alias("gm"), F.var_pop("g").alias("gv")).first()
    assert r.n == 2_000_000 and 0 < r.lo < 1e-5 and 1 - 1e-5 < r.hi < 1
    assert abs(r["mean"] - 0.5) < 1e-3 and abs(r["var"] - 1 / 12) < 1e-3 and max(abs(r.uv), abs(r.uw)) < 4e-3 and abs(r.gm) < 4e-3 and abs(r.gv - 1) < 1e-2
    counts = [x["count"] for x in many.groupBy(F.floor(F.col("u") * 200)).count().collect()]
    assert len(counts) == 200 and sum((c - 10_000) ** 2 / 10_000 for c in counts) < 290  # chi-square, 199 degrees


def test_keyed_numbers_equal_their_sql(spark):
    keys = [(c, p) for c in (-(2**62), -7, 0, 1, 10**12) for p in (-1, 0, 5, 2147483647, 2**60)]
    got = [tuple(r) for r in spark.createDataFrame(keys, "c long, p long").select(keyed.uniform(F.col("c"), F.col("p"), 11, 4), keyed.gaussian(F.col("c"), F.col("p"), 11)).collect()]
    want = [duckdb.sql(f"select {keyed.uniform_sql(str(c), str(p), 11, 4)}, {keyed.gaussian_sql(str(c), str(p), 11)}").fetchall()[0] for c, p in keys]
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose(got, want, rtol=1e-12) and all(0 < g[0] < 1 for g in got)


def test_no_window_sees_all_rows(spark):
    pts = cloud(spark, np.random.default_rng(0).random((60, 3))).withColumns({"label": F.lit(1), "pred": F.lit(1)})
    found = [S.shuffle_points(pts), S.assign_batches(pts, 7, ["point_idx"]), M.batch_accuracy(pts, 7, ["point_idx"]), A.noise_points(pts, 0.3), G.merge_clouds([pts, pts], 5), N.cloud_pairs(pts)]
    for df in found:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # only the sums over ranges, one row each, have no key
        assert all("__rank_part" in line or "[cloud_id" in line for line in plan.splitlines() if "Window [" in line), plan


@pytest.mark.parametrize("start", [0, 7])
def test_last_points_in_tiles_are_those_of_the_plain_walk(spark, start):
    rng = np.random.default_rng(start)
    clouds = {1: rng.normal(size=(6000, 3)), 2: rng.integers(0, 6, (5000, 3)).astype(float), 3: np.zeros((4000, 3)), 4: rng.random((500, 3))}
    pts = spark.createDataFrame(pd.concat([pd.DataFrame({"cloud_id": c, "point_idx": np.arange(len(x)) * 2, "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}) for c, x in clouds.items()]))
    rows = lambda df: sorted((r.cloud_id, r.place, r.point_idx, r.x, r.y, r.z) for r in df.collect())
    plain = rows(P.last_point_sample(pts, 90, start))
    assert len(plain) == 360 and rows(P.last_point_sample(pts, 90, start, max_points=1000)) == plain
    m = 20 + start
    plain = rows(P.head_last_point_sample(pts, 70, m))
    assert rows(P.head_last_point_sample(pts, 70, m, max_points=1000)) == plain


def test_last_point_sampling_may_pick_the_start_again(spark):
    assert picks(P.last_point_sample(cloud(spark, [(0, 0, 0), (10, 0, 0), (1, 0, 0)]), 4, 0)) == [0, 1, 0, 2]


def test_voxels_truncate_or_floor(spark):
    pts = cloud(spark, [(-0.5, 0, 0), (0.5, 0, 0), (1.5, 0, 0)])
    assert [r.x for r in sorted(X.voxel_average_trunc(pts, 1.0).collect(), key=lambda r: r.place)] == [0.0, 1.5]
    assert X.voxel_down_sample(pts, 1.0).count() == 3


def test_voxel_count_falls_with_size(spark):
    pts = cloud(spark, np.random.default_rng(3).random((300, 3)))
    n = [X.voxel_down_sample(pts, s).count() for s in (0.05, 0.2, 0.6)]
    assert n[0] > n[1] > n[2] > 0


@pytest.mark.parametrize("size", [3, 5, 8])
def test_fit_to_n(spark, size):
    got = S.fit_to_n(cloud(spark, [(k, 0, 0) for k in range(size)]), 5).collect()
    assert sorted(r.slot for r in got) == list(range(5))
    if size <= 5:
        assert {r.point_idx for r in got} == set(range(size))


def test_exact_samples(spark):
    pts = cloud(spark, [(k, 0, 0) for k in range(103)])
    assert S.random_down_sample(pts, 0.1, 1).count() == 10
    assert S.uniform_to_n(pts, 20).count() == 20 and S.uniform_to_n(pts, 104).count() == 0
    assert S.random_down_sample(pts.repartition(5), 0.1, 1).select("point_idx").subtract(S.random_down_sample(pts, 0.1, 1).select("point_idx")).count() == 0
    split = S.split_head_tail(pts, "cloud_id", ["point_idx"])
    assert {r.part: r["count"] for r in split.groupBy("part").count().collect()} == {"head": 82, "tail": 21}


def test_global_shuffle_is_a_permutation(spark):
    got = S.shuffle_clouds(spark.range(500).withColumnRenamed("id", "cloud_id"), 3).collect()
    assert sorted(r.place for r in got) == list(range(500)) and [r.place for r in sorted(got, key=lambda r: r.cloud_id)] != list(range(500))


def test_normalised_clouds(spark):
    pts = cloud(spark, np.random.default_rng(4).random((50, 3)) * 9).unionByName(cloud(spark, [(1, 2, 3)], 1))
    got = G.normalize_unit(pts).collect()
    assert max(math.hypot(r.x, r.y, r.z) for r in got if r.cloud_id == 0) == pytest.approx(1)
    assert [r.x for r in got if r.cloud_id == 1] == [None]


def test_rotations_keep_norms_and_repeat(spark):
    pts = cloud(spark, np.random.default_rng(5).random((20, 3)))
    for f in (lambda p: A.rotate_y(p, 1), lambda p: A.rotate_z(p, 1), lambda p: A.perturb_rotation(p, seed=1)):
        a, b = f(pts).collect(), f(pts.repartition(3)).orderBy("point_idx").collect()
        assert sorted(a) == sorted(b)
        for p, q in zip(sorted(pts.collect()), sorted(a)):
            assert math.hypot(p.x, p.y, p.z) == pytest.approx(math.hypot(q.x, q.y, q.z))
    with pytest.raises(ValueError):
        A.jitter(pts, clip=0)
    with pytest.raises(ValueError):
        A.noise_points(pts, 1.0)


def test_euler_angles_at_the_pole_and_back(spark):
    one = spark.range(1)
    z, y, x = F.lit(0.3), F.lit(-0.4), F.lit(1.1)
    e = one.select(G.matrix_to_euler(G.euler_to_matrix(z, y, x)).alias("e")).first().e
    assert (e.z, e.y, e.x) == pytest.approx((0.3, -0.4, 1.1))
    m = [[F.lit(v) for v in r] for r in ((0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (-1.0, 0.0, 0.0))]
    p = one.select(G.matrix_to_euler(m).alias("e")).first().e
    assert (p.z, p.y, p.x) == pytest.approx((0.0, math.pi / 2, 0.0))
    q = one.select(G.euler_to_quat(F.lit(1.0), F.lit(0.0), F.lit(0.0)).alias("q")).first().q
    assert (q.w, q.x, q.y, q.z) == pytest.approx((math.cos(0.5), 0, 0, math.sin(0.5)))
    a = one.select(G.quat_to_axis_angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("a")).first().a
    assert (a.angle, a.x, a.y, a.z) == (0.0, 1.0, 0.0, 0.0)


def test_normals_of_a_plane_point_up(spark):
    pts = cloud(spark, [(i, j, 0.5) for i in range(5) for j in range(5)])
    got = G.estimate_normals(pts, 1.5).collect()
    assert len(got) == 25 and all((r.nx, r.ny, r.nz) == pytest.approx((0, 0, 1), abs=1e-9) for r in got)


def test_blocks_include_both_edges(spark):
    pts = cloud(spark, [(x, y, 0) for x in (0, 1, 2) for y in (0, 1)])
    got = B.room_blocks(pts, 4, 1.0, 1.0, min_points=1).groupBy("bi", "bj").agg(F.countDistinct("point_idx").alias("n")).collect()
    assert {(r.bi, r.bj): r.n for r in got} == {(0, 0): 4, (1, 0): 4}


def test_sliding_scene_covers_every_point(spark):
    rng = np.random.default_rng(6)
    pts = cloud(spark, rng.random((200, 3)) * 5).withColumns({"r": F.lit(1), "g": F.lit(2), "b": F.lit(3), "label": (F.col("point_idx") % 4)})
    got = B.sliding_scene(pts, 1.0, 0.5, 0.001, 16)
    assert got.select("point_idx").distinct().count() == 200
    assert {r["count"] for r in got.groupBy("ix", "iy", "batch").count().collect()} == {16}


def test_ball_query_takes_the_first_by_index_and_pads(spark):
    pts = cloud(spark, [(3, 0, 0), (0.5, 0, 0), (0.1, 0, 0), (-0.9, 0, 0)])
    centres = spark.createDataFrame([(0, 0, 0.0, 0.0, 0.0), (0, 1, 50.0, 0.0, 0.0)], "cloud_id long, centre long, x double, y double, z double")
    rows = lambda n: [(r.centre, r.slot, r.point_idx) for r in N.ball_query(pts, centres, 1.0, n).orderBy("centre", "slot").collect()]
    assert rows(2) == [(0, 0, 1), (0, 1, 2)]
    assert rows(5) == [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 4, 1)]


def test_ball_query_has_no_cartesian_product(spark):
    pts = cloud(spark, [(0, 0, 0)])
    plan = N.ball_query(pts, pts.withColumnRenamed("point_idx", "centre"), 1.0, 2)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_interpolation_with_few_neighbours(spark):
    fine, coarse = cloud(spark, [(0, 0, 0), (2, 0, 0)]), cloud(spark, [(1, 0, 0)]).withColumn("v", F.lit(7.0))
    assert [r.v for r in N.interpolate_3nn(fine, coarse, ["v"]).collect()] == pytest.approx([7.0, 7.0])


def test_vectors_of_other_lengths(spark):
    assert spark.range(1).select(N.vector_distance(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d")).first().d == -1


def test_votes(spark):
    rows = [(0, 0, 2, 1.0), (0, 0, 1, 1.0), (0, 1, 3, 0.0), (0, 2, 4, float("inf")), (0, 3, 5, 1.0), (0, 3, 5, 1.0), (0, 3, 6, 1.0)]
    preds = spark.createDataFrame(rows, "scene_id long, point_idx long, pred long, weight double")
    assert {r.point_idx: r.pred for r in M.vote_labels(preds, preds).collect()} == {0: 1, 1: 0, 2: 0, 3: 5}


def test_scene_without_a_class_and_part_in_neither(spark):
    seg = spark.createDataFrame([(0, 1, 1), (0, 1, 2), (1, 2, 2)], "scene_id long, label long, pred long")
    assert {r.scene_id: (r.classes, round(r.miou, 3)) for r in M.scene_miou(seg).collect()} == {0: (1, 0.5), 1: (1, 1.0)}
    part = spark.createDataFrame([(0, 0, 0, 0, 0)], "cloud_id long, point_idx long, category long, part long, pred long")
    parts = spark.createDataFrame([(0, 0), (0, 1)], "category long, part long")
    assert {r.part: r.iou for r in M.part_iou(part, parts).collect()} == {0: 1.0, 1: 1.0}


def test_transport_matches_all_assignments():
    from itertools import permutations

    rng = np.random.default_rng(7)
    for _ in range(20):
        supply, demand = rng.integers(1, 3, 3), rng.integers(1, 2, 3)
        cost = rng.random((3, 3)).round(3)
        rows, cols = np.repeat(np.arange(3), supply), np.repeat(np.arange(3), demand)
        best = min(sum(cost[r, c] for r, c in zip(p, cols)) for p in permutations(rows, len(cols)))
        assert R.transport(cost, supply, demand) == pytest.approx(best)
    assert R.transport(np.ones((1, 1)), np.array([1]), np.array([2])) is None


def test_emd_of_two_colour_signatures(spark):
    # fixed values: the features and weights of the two signatures
    f1, w1 = [(100.0, 40.0, 22.0), (211.0, 20.0, 2.0), (32.0, 190.0, 150.0), (2.0, 100.0, 100.0)], [4, 3, 2, 1]
    f2, w2 = [(0.0, 0.0, 0.0), (50.0, 100.0, 80.0), (255.0, 255.0, 255.0)], [5, 3, 2]
    rows = [(0, k, list(f), w) for k, (f, w) in enumerate(zip(f1, w1))] + [(1, k, list(f), w) for k, (f, w) in enumerate(zip(f2, w2))]
    sig = spark.createDataFrame(rows, "sig_id long, item_no long, feature array<double>, weight long")
    got = R.emd_pairs(sig, spark.createDataFrame([(0, 1)], "a long, b long")).first()
    assert got.flow == 10 and got.emd == pytest.approx(160.542770, abs=1e-5)


def test_icp_brings_a_moved_cloud_back(spark):
    rng = np.random.default_rng(8)
    side = rng.random((300, 2)) * 4
    target = np.concatenate([np.c_[side[:100], np.zeros(100)], np.c_[side[100:200, 0], np.zeros(100), side[100:200, 1]], np.c_[np.zeros(100), side[200:]]])
    normals = np.repeat([[0, 0, 1.0], [0, 1.0, 0], [1.0, 0, 0]], 100, axis=0)
    rows = [(0, k, *map(float, p), *map(float, n)) for k, (p, n) in enumerate(zip(target, normals))]
    t = spark.createDataFrame(rows, PTS + ", nx double, ny double, nz double")
    s = cloud(spark, target + [0.1, -0.05, 0.08])
    got = R.icp(s, t, 0.5, iters=6).first()
    assert got.fitness == 1.0 and np.allclose(np.array(got.m).reshape(4, 4)[:3, 3], [-0.1, 0.05, -0.08], atol=0.02)


def test_names_and_classes(spark):
    df = spark.createDataFrame([("a/night_stand_0012.txt",), ("x_12345.txt",)], "file_name string")
    got = [tuple(r.n) for r in df.select(C.parse_shape_name(F.col("file_name")).alias("n")).collect()]
    assert got == [("night_stand", 12), ("x", 12345)]
    assert [r.shape_id for r in C.shape_ids(df).collect()] == ["night_stand_0012", "x_12345"]
    cls = spark.createDataFrame([("wall",), ("stairs",), (None,)], "class_name string")
    assert [r.class_id for r in C.encode_class(cls).collect()] == [2, 12, 12]


def test_empty_clouds_count_as_small(spark):
    shapes = spark.createDataFrame([(0,), (9,)], "cloud_id long")
    assert {r.cloud_id: r.n_points for r in C.below_size(cloud(spark, [(0, 0, 0)]), 5, shapes).collect()} == {0: 1, 9: 0}


def test_read_points_reports_bad_lines(spark, tmp_path):
    (tmp_path / "c1.txt").write_text("1 2 3\n\n4,5,6\r\n7, 8, nine\n1.5 2\n")
    got = sorted(SP.read_points(spark, str(tmp_path)).collect(), key=lambda r: r.point_idx)
    assert [(r.point_idx, r.x, r.z, r.error) for r in got] == [(0, 1.0, 3.0, None), (2, 4.0, 6.0, None), (3, 7.0, None, "7, 8, nine"), (4, 1.5, None, "1.5 2")]
    assert [r.name for r in SP.numbered(SP.read_points(spark, str(tmp_path))).select("name").distinct().collect()] == ["c1"]


def test_large_text_files_are_read_in_splits(spark, tmp_path):
    rng = np.random.default_rng(4)
    want = []
    for name, end in (("a", "\n"), ("b", "\r\n"), ("empty", "")):
        lines = [] if name == "empty" else ["" if k % 97 == 5 else f"{k} {'1' * int(rng.integers(1, 30))} 0.5" for k in range(4_000)]
        (tmp_path / f"{name}.txt").write_bytes("".join(x + end for x in lines).encode())
        want += [(name, k, float(k)) for k, x in enumerate(lines) if x]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        pts = SP.read_points(spark, str(tmp_path))
        assert SP.numbered_lines(spark, str(tmp_path)).select(F.col("line_no")).agg(F.max("line_no")).first()[0] == 3_999
        assert sorted((r.cloud_id, r.point_idx, r.x) for r in pts.collect()) == want and pts.filter("error is not null").count() == 0
        one = pts.filter("cloud_id = 'b' and point_idx between 3000 and 3002").collect()  # filters must not change the numbers
        assert sorted((r.point_idx, r.x) for r in one) == [(k, float(k)) for k in (3000, 3001, 3002) if k % 97 != 5]
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_ply_of_all_kinds(spark, tmp_path):
    head = "ply\nformat {}\nelement vertex {}\nproperty float x\nproperty uchar q\nproperty double y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n"
    rows = [(1.0, 7, 2.5, 3.0), (-1.0, 8, 0.5, 4.0)]
    (tmp_path / "a.ply").write_bytes((head.format("ascii 1.0", 2) + "1 7 2.5 3\n-1 8 .5 4\n3 0 1 0\n").encode())
    for name, order in (("binary_little_endian", "<"), ("binary_big_endian", ">")):
        (tmp_path / f"{name[7]}.ply").write_bytes(head.format(f"{name} 1.0", 2).encode() + b"".join(struct.pack(order + "fBdf", *r) for r in rows) + b"\x03")
    (tmp_path / "short.ply").write_bytes(head.format("binary_little_endian 1.0", 5).encode() + struct.pack("<fBdf", *rows[0]) + b"xx")
    (tmp_path / "bad.ply").write_text(head.format("ascii 1.0", 2) + "1 7 2.5 3\noops\n")
    (tmp_path / "none.ply").write_text("hello")
    got: dict = {}
    for r in SP.read_ply(spark, str(tmp_path)).collect():
        got.setdefault(r.cloud_id, []).append((r.point_idx, r.x, r.y, r.z, r.error))
    want = [(0, 1.0, 2.5, 3.0, None), (1, -1.0, 0.5, 4.0, None)]
    assert sorted(got["a"]) == sorted(got["l"]) == sorted(got["b"]) == want
    assert (None, None, None, None, "1 of 5 vertices") in got["short"] and len(got["short"]) == 2
    assert any(e and "oops" in e for *_, e in got["bad"]) and got["none"] == [(None, None, None, None, "no header")]


def test_files_round_trip(spark, tmp_path):
    pts = cloud(spark, [(1.25, -2, 3), (4, 5, 6)], 3).unionByName(cloud(spark, [(7, 8, 9)], 4))
    for kind in ("comma", "spaced"):
        SP.write_points_text(pts, str(tmp_path / kind), kind)
        back = SP.read_points(spark, str(tmp_path / kind)).select(F.col("cloud_id").cast("long"), "point_idx", "x", "y", "z")
        assert sorted(back.collect()) == sorted(pts.collect())
    SP.write_cloud_files(pts, str(tmp_path / "ply"), "ply")
    assert sorted(tuple(r)[1:5] for r in SP.read_ply(spark, str(tmp_path / "ply")).collect()) == sorted(tuple(r)[1:] for r in pts.collect())
    with pytest.raises(ValueError):
        SP.write_cloud_files(pts, str(tmp_path / "x"), "stl")
    assert sorted(SP.unpack_clouds(SP.pack_clouds(pts)).collect()) == sorted(pts.collect())


@pytest.mark.parametrize("name, key", [("sliding_scene", "ix"), ("room_blocks", "bi"), ("block_features", "bi")])
def test_blocks_are_filled_where_their_clouds_are(spark, tiny, name, key):
    plan = plans.QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(rf"hashpartitioning\([^)]*\b{key}#", plan)  # rows of blocks, several for each point, are not shuffled


def test_clouds_are_dealt_out_to_more_tasks_as_rows_grow(spark, tiny, monkeypatch):
    monkeypatch.setattr(session, "TASK_ROWS", 500)
    pts = plans.views.points(spark, tiny)
    assert pts.rdd.getNumPartitions() == -(-pts.count() // 500) > 4


def test_files_of_many_clouds(spark, tmp_path):
    names = ["a b/ä", "# cloud_id=x", "7", "8", *[f"n{k}" for k in range(8)]]
    rows = [(c, k, float(k), -1.5, float(i)) for i, c in enumerate(names) for k in range(3 + i * 20)]
    pts = spark.createDataFrame(rows, "cloud_id string, point_idx long, x double, y double, z double")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for fmt in ("comma", "spaced"):
            SP.write_points_text(pts, str(tmp_path / fmt), fmt, together=True)
            assert len(list((tmp_path / fmt).rglob("part-*"))) <= 4  # not one a cloud
            back = SP.read_points(spark, str(tmp_path / fmt))
            assert sorted(back.select(pts.columns).collect()) == sorted(rows) and back.filter("error is not null").count() == 0
            assert back.filter("cloud_id = '7' and point_idx = 30").count() == 1
        for kind in ("ply", "obj", "pcd"):
            SP.write_cloud_files(pts, str(tmp_path / kind), kind, together=True)
            assert len(list((tmp_path / kind).rglob("part-*"))) <= 4
            lines = SP.cloud_lines(spark, str(tmp_path / kind)).groupBy("cloud_id").agg(F.count("*").alias("n"), F.min("line_no").alias("a"), F.max("line_no").alias("b"))
            head = {"ply": 7, "obj": 0, "pcd": 11}[kind]
            assert sorted(map(tuple, lines.collect())) == sorted((c, 3 + i * 20 + head, 0, 2 + i * 20 + head) for i, c in enumerate(names))
        back = SP.read_ply(spark, str(tmp_path / "ply"))
        assert sorted(back.select(pts.columns).collect()) == sorted(rows) and back.filter("error is not null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tasks_grow_with_the_rows(spark):
    assert session.tasks(spark) == session.tasks(spark, 10) == 4 and session.tasks(spark, 9 * session.TASK_ROWS + 1) == 10


def test_corpus_of_many_documents_a_file(spark, tmp_path):
    bodies = ["", "h1\nh2\nh3\none\ntwo\n", "a\x1eb\n\n\nx\x1by\x1ee\x1br\x1bz", "1\n2\n3\n\x1b\x1e\x1er", "\n\n\n\r\nend\r", *[f"a\nb\nc\ndocument {k}" for k in range(100)]]
    df = spark.createDataFrame([(c, b) for c in ("sport", "news") for b in bodies], "class string, body string")
    ST.write_class_corpus(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").rglob("part-*"))) <= 2 * df.rdd.getNumPartitions()
    got = ST.read_class_corpus(spark, f"{tmp_path}/c/*", together=True).collect()
    assert sorted((r["class"], r.body) for r in got) == sorted((f"class={c}", "".join(b.split("\n")[3:])) for c in ("sport", "news") for b in bodies)


def test_corpus_and_csv(spark, tmp_path):
    (tmp_path / "sport").mkdir()
    (tmp_path / "sport" / "a.txt").write_text("h1\nh2\nh3\none　\ntwo\n", encoding="utf-8")
    (tmp_path / "sport" / "b.txt").write_text("short", encoding="utf-8")
    got = ST.read_class_corpus(spark, str(tmp_path / "*")).collect()
    assert sorted((r["class"], r.body) for r in got) == [("sport", ""), ("sport", "onetwo")]
    df = spark.createDataFrame([("1", 'a "b", c\nd', ""), ("0", "x", None)], "label string, Description1 string, Description2 string")
    ST.write_labelled_csv(df, str(tmp_path / "csv"))
    back = ST.read_labelled_csv(spark, str(tmp_path / "csv")).collect()
    assert sorted(r.Description1 for r in back) == ['a "b", c\nd', "x"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("é a  the b",), (None,)], "t string")
    assert [r.tokens for r in T.tokenize(df, "t", ["the"]).collect()] == [["é", "a", "", "b"], [""]]
    assert df.select(T.nfc("t").alias("n")).first().n == "é a  the b"
    vecs = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.similarity) for r in T.most_similar(vecs, vecs.filter("vec_id = 0"), 2).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]
    rows = [(k, [float(k % 7 + 1), float(k % 5), float(k % 3)]) for k in range(60)] + [(60, None), (61, [None, 1.0, 1.0])]
    many = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cos = lambda a, b: round(sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 12)
    want = sorted((q, i, k + 1) for q in range(0, 60, 20) for k, (_, i) in enumerate(sorted((-cos(rows[q][1], rows[i][1]), i) for i in range(60) if i != q)[:4]))
    assert sorted((r["query"], r.vec_id, r["rank"]) for r in T.most_similar(many, many.filter("vec_id % 20 = 0"), 4, part_rows=10).collect()) == want
    assert T.most_similar(many.limit(0), many, 4).collect() == []
    pairs = spark.createDataFrame([(0, 2), (1, 3), (0, 9)], "i long, j long")
    assert sorted((r.i, r.j, r.similarity) for r in T.similarity(vecs, pairs).collect()) == [(0, 2, 0.0), (1, 3, None)]
    pca = T.pca_vectors(spark.createDataFrame([(k, [10.0 + k, 5.0 - 2 * k, 1.0]) for k in range(6)], "vec_id long, v array<double>"), 1, "v").collect()
    got = [r.components[0] for r in sorted(pca, key=lambda r: r.vec_id)]
    assert sum(got) == pytest.approx(0, abs=1e-9) and abs(got[-1] - got[0]) == pytest.approx(5 * math.sqrt(5))


def test_new_clouds_are_sampled_as_they_arrive(spark, tmp_path):
    from cloudweft.streaming.incremental import sample_new

    src, out, chk = (str(tmp_path / n) for n in ("in", "out", "chk"))
    run = lambda: sample_new(spark, src, out, chk, PTS, lambda p: S.head_points(p, 2)).awaitTermination()
    cloud(spark, [(k, 0, 0) for k in range(5)], 1).write.parquet(src)
    run()
    cloud(spark, [(k, 0, 0) for k in range(5)], 2).unionByName(cloud(spark, [(9, 9, 9)], 1)).write.mode("append").parquet(src)
    run()
    run()
    assert sorted((r.cloud_id, r.point_idx) for r in spark.read.parquet(out).collect()) == [(1, 0), (1, 1), (2, 0), (2, 1)]


def test_entry_points(spark):
    import __spark_entry__ as E

    assert set(E.oracle_sql()) <= set(E.queries())
    assert E.entry(spark).count() > 0


def test_cloud_pairs_are_dealt_out_by_their_number(spark):
    clouds = spark.createDataFrame([(k * 3,) for k in range(60)], "cloud_id long")
    got = N.cloud_pairs(clouds, each=200)
    assert sorted(map(tuple, got.collect())) == [(a * 3, b * 3) for a in range(60) for b in range(a + 1, 60)]
    sizes = [r.n for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 5 and max(sizes) < 900


@pytest.mark.parametrize("block", [4_096, 25])
def test_feature_matches_of_copies_and_ties(spark, block):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 16)).astype("float32").astype(float)
    near = [base[rng.integers(40)] + rng.choice([0.0, 0.25], 16) for _ in range(60)]
    a, b = ([(int(k), v.tolist()) for k, v in enumerate(s)] for s in ([*base, *near], [*near, *base[::2], *near[::-1], *(v[::-1] for v in near)]))
    sides = [spark.createDataFrame(s, "vec_id long, embedding array<double>") for s in (a, b)]

    def d(x, y):
        s = 0.0
        for p, q in zip(x, y):
            s += (p - q) * (p - q)
        return math.sqrt(s)

    want = {i: min((d(x, y), j) for j, y in b) for i, x in a}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small shuffles would become one partition, where all keys meet
    try:
        got = {r.a_id: (r.distance, r.b_id) for r in N.feature_matches(*sides, 100.0, block=block).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want


def test_icp_in_tasks_equals_icp_by_joins(spark):
    rng = np.random.default_rng(8)
    t, src = [], []
    for c in range(4):
        xyz, n = rng.uniform(0, 3, (60, 3)), rng.normal(size=(60, 3))
        n /= np.linalg.norm(n, axis=1, keepdims=True)
        t += [(c, k, *map(float, p), *map(float, v)) for k, (p, v) in enumerate(zip(xyz, n))]
        src += [(c, k, *map(float, p)) for k, p in enumerate(xyz[: 50 + c] + [0.06, -0.04, 0.05] + rng.normal(0, 0.01, (50 + c, 3)))]
    src.append((9, 0, 1.0, 1.0, 1.0))  # no target
    target, source = spark.createDataFrame(t, "cloud_id long, point_idx long, x double, y double, z double, nx double, ny double, nz double"), spark.createDataFrame(src, "cloud_id long, point_idx long, x double, y double, z double")
    init = spark.createDataFrame([(1, [1.0, 0.0, 0.0, -0.05, 0.0, 1.0, 0.0, 0.03, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "cloud_id long, m array<double>")
    for given in (None, init):
        ways = [sorted(R.icp(source, target, 0.6, given, 3, pairs=p).select("cloud_id", "m", "fitness", "rmse").collect()) for p in (10_000, 3_100, 0)]
        assert [r.cloud_id for r in ways[0]] == [0, 1, 2, 3, 9]
        for way in ways[1:]:
            assert all(a.fitness == b.fitness and np.allclose(a.m, b.m, atol=1e-9) and abs(a.rmse - b.rmse) < 1e-9 for a, b in zip(ways[0], way, strict=True))


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.mark.parametrize("name", ["interpolate_3nn", "interpolate_3nn_by_radius", "soft_project", "soft_project_hard", "group_nearest_seed"])
def test_neighbours_of_small_clouds_are_not_shuffled(spark, tiny, name):
    assert _exchanges(plans.QUERIES[name](spark, tiny)) == 1  # the clouds themselves


def test_folded_neighbours_equal_those_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(c, i, *map(float, p)) for c in (1, 2) for i, p in enumerate(rng.integers(0, 6, (40, 3)))]
    fine = spark.createDataFrame(rows, "cloud_id long, point_idx long, x double, y double, z double")
    coarse = fine.filter("point_idx % 4 = 0").withColumn("v", F.when(F.col("point_idx") % 8 == 0, F.col("x")))
    coarse = coarse.withColumn("nothing", F.lit(None).cast("double"))
    seeds = fine.filter("point_idx % 7 = 0").withColumnRenamed("point_idx", "seed_no")
    own, whole = N.large_clouds, {}
    for large in (False, True):
        if large:
            for module in (N, P):
                monkeypatch.setattr(module, "large_clouds", lambda df: own(df, 300))
        whole[large] = [
            sorted(tuple(None if v is None else round(v, 9) for v in r) for r in df.collect())
            for df in (N.interpolate_3nn(fine, coarse, ["v"]), N.soft_project(coarse, fine, 5, 2.0), N.soft_project(coarse, fine, hard=True), P.group_nearest_seed(fine, seeds, 2.5))
        ]
        assert [r.nothing for r in N.interpolate_3nn(fine, coarse, ["nothing"]).collect()] == [None] * 80
    assert whole[False] == whole[True] and [len(w) for w in whole[True]] == [80, 20, 20, 80]


def test_fpfh_in_tasks_equals_joins_without_their_shuffles(spark, tiny):
    pts = plans.views.points(spark, tiny).filter("cloud_id < 4")
    pts = pts.unionByName(pts.filter("point_idx < 3").withColumn("point_idx", F.col("point_idx") + 100_000))  # places held twice
    normals = G.estimate_normals(pts, 8.0, 20).filter("point_idx % 9 <> 4")
    few, large = (R.fpfh(pts, normals, 8.0, 30, pairs=p) for p in (R.MOST_PAIRS, 0))
    assert _exchanges(few) == 1
    a, b = ({(r.cloud_id, r.point_idx, r.bin): r.value for r in df.collect()} for df in (few, large))
    assert a.keys() == b.keys() and len(a) > 1000 and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)


def test_word_vectors_of_many_parts(spark, monkeypatch):
    """Words of one topic end up near each other, whatever the parts; no vocabulary goes to the driver."""
    from cloudweft.operators import word_vectors as W

    monkeypatch.setattr(W, "FIRST_WORDS", 4_000)
    monkeypatch.setattr(W, "PART_FLOATS", 0)
    monkeypatch.setattr(W, "ROUNDS", 3)
    rng = np.random.default_rng(3)
    topics = [[f"{t}{k}" for k in range(12)] for t in "ab"]
    texts = [(k, " ".join(rng.choice(topics[k % 2], 30).tolist() + ["both"])) for k in range(400)] + [(400, "rare a1"), (401, ""), (402, None)]
    df = T.tokenize(spark.createDataFrame(texts, "row_id long, text string").repartition(2), "text")
    model = T.fit_doc_vectors(df, 12, min_count=2, iterations=20)
    v = {r.word: np.array(r.vector) for r in model.getVectors().collect()}
    assert sorted(v) == sorted(["", "both", *topics[0], *topics[1]])
    mean = np.mean([v[w] for t in topics for w in t], axis=0)
    unit = {w: (x - mean) / np.linalg.norm(x - mean) for w, x in v.items()}
    cos = lambda p, q: np.mean([unit[a] @ unit[b] for a in p for b in q if a != b])
    assert cos(topics[0], topics[0]) > cos(topics[0], topics[1]) + 0.3 and cos(topics[1], topics[1]) > cos(topics[0], topics[1]) + 0.3
    got = {r.row_id: r.vector.toArray() for r in model.transform(df.select("row_id", "tokens")).collect()}
    assert sorted(got) == list(range(403))
    for k, text in texts:
        assert got[k] == pytest.approx(sum((v.get(w, np.zeros(12)) for w in (text or "").split(" ")), np.zeros(12)) / len((text or "").split(" ")), abs=1e-5)


def test_fpfh_of_points_needs_no_shuffle_but_that_of_its_clouds(spark, tiny):
    assert _exchanges(plans.QUERIES["fpfh"](spark, tiny)) == 1
    pts = plans.views.points(spark, tiny).filter("cloud_id < 4")
    want = R.fpfh(pts, G.estimate_normals(pts, 8.0, 20), 8.0, 30)
    one = pts.unionByName(pts.limit(0)).repartition(5)  # dealt out by nothing, in no order
    found = [R.fpfh_of_points(pts, 8.0, 30, 8.0, 20), R.fpfh_of_points(one, 8.0, 30, 8.0, 20), R.fpfh_of_points(pts, 8.0, 30, 8.0, 20, pairs=1_000_000)]
    want, *found = ({(r.cloud_id, r.point_idx, r.bin): r.value for r in df.collect()} for df in (want, *found))
    assert len(want) > 1000
    for got in found:
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_cloud_pairs_shuffles_blocks_not_pairs(spark):
    """Pairs are made after the last shuffle, not before; clouds without an id have none, as in SQL."""
    import re

    clouds = spark.createDataFrame([(k,) for k in [None, *range(2_500)]], "cloud_id long")
    got = N.cloud_pairs(clouds, each=1_000_000)
    rows = got.groupBy().agg(F.count("*"), F.countDistinct("a", "b"), F.min(F.col("b") - F.col("a"))).first()
    assert tuple(rows) == (2_500 * 2_499 // 2, 2_500 * 2_499 // 2, 1)
    plan = got._jdf.queryExecution().optimizedPlan().toString()  # the topmost operator first
    assert "MapInArrow" in plan[: re.search("Join|Repartition", plan).start()] and plan.count("explode") == 1


def test_text_queries_learn_with_whole_parameters(spark, tiny, monkeypatch):
    """300 numbers a word, every word, 150 passes, as the operator states."""
    import inspect

    seen = []

    def fit(df, *args, **kwargs):
        bound = inspect.signature(own).bind(df, *args, **kwargs)
        bound.apply_defaults()
        seen.append({k: v for k, v in bound.arguments.items() if k not in ("df", "seed")})
        return own(df, 4, iterations=1)

    own = T.fit_doc_vectors
    monkeypatch.setattr(T, "fit_doc_vectors", fit)
    words = {r.word for r in plans.QUERIES["fit_doc_vectors"](spark, tiny).collect()}
    assert seen == [{"size": 300, "window": 5, "min_count": 1, "iterations": 150}]
    texts = spark.read.parquet(f"{tiny}/documents.parquet").select("text").collect()
    assert words == {w for r in texts for w in (r.text or "").split(" ")}


def test_forest_in_groups_of_trees(spark, monkeypatch):
    """As many trees as asked for, never more than ``together`` at once; a forest of one group is Spark's."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4))
    rows = [(k % 150, int(v[0] * v[1] > 0), v.tolist()) for k, v in enumerate(x)]  # row ids occur twice
    train, valid = (spark.createDataFrame(r, "row_id long, label int, features array<double>") for r in (rows[:200], rows[200:]))
    grown, own = [], T.RandomForestClassifier
    monkeypatch.setattr(T, "RandomForestClassifier", lambda **k: grown.append((k["numTrees"], k["maxDepth"])) or own(**k))
    got = T.train_text_classifier(train, valid, trees=25, depth=6, together=10).collect()
    assert grown == [(10, 6), (10, 6), (5, 6)] and len(got) == 100
    assert np.mean([r.label == r.pred for r in got]) > 0.85
    vec = lambda df: df.withColumn("v", T.array_to_vector("features"))
    model = own(numTrees=10, maxDepth=6, seed=1, featuresCol="v", labelCol="label").fit(vec(train))
    want = sorted((r.row_id, r.label, int(r.prediction)) for r in model.transform(vec(valid)).collect())
    assert sorted((r.item, r.label, r.pred) for r in T.train_text_classifier(train, valid, trees=10, depth=6, together=10).collect()) == want
    assert inspect_defaults(T.train_text_classifier) == (1500, 11)


def inspect_defaults(f):
    import inspect

    p = inspect.signature(f).parameters
    return p["trees"].default, p["depth"].default


def test_forest_query_grows_the_whole_forest(spark, tiny, monkeypatch):
    fits, forests, own, grow = [], [], T.fit_doc_vectors, T.train_text_classifier
    monkeypatch.setattr(T, "fit_doc_vectors", lambda df, **k: fits.append(k) or own(df, 4, iterations=1))
    monkeypatch.setattr(T, "train_text_classifier", lambda a, b, **k: forests.append(k) or grow(a, b, trees=2, depth=2))
    assert plans.QUERIES["train_text_classifier"](spark, tiny).count() > 0
    assert fits == [{}] and forests == [{}]  # the operators' own sizes: 300 numbers, 150 passes, 1500 trees of depth 11
