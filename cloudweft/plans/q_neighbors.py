"""Queries of the neighbour, matching and block operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import rounded, uniform_sql
from ..operators import blocks as B
from ..operators import neighbors as N
from ..operators import sampling as S
from . import views as V
from .q_geometry import _fps
from .views import sql

XYZ = ("x", "y", "z")
_R, _K = 10.0, 8


def _r(df, *cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


def _coarse(s, d):
    return S.uniform_down_sample(V.points(s, d), 100)


def _sample(s, d):
    """Every 40th point, moved a little: a sampler's output near the cloud."""
    p = S.uniform_down_sample(V.points(s, d), 40)
    return p.withColumns({"x": F.col("x") + F.lit(0.25), "y": F.col("y") + F.col("point_idx") % 3})


def _centres(s, d):
    return _coarse(s, d).withColumnRenamed("point_idx", "centre")


def _groups(s, d):
    p = V.points_full(s, d)
    return N.index_points(p.select("cloud_id", "point_idx", *XYZ, "r"), N.ball_query(p, _centres(s, d), _R, _K))


def _vectors(s, d, odd):
    return V.table(s, d, "embeddings").filter(F.col("label") % 2 == odd).select("vec_id", "embedding")


def _matches(s, d):
    near = N.knn(_sample(s, d), V.points(s, d), 1)
    return near.select("cloud_id", (F.col("a_idx") / 40).cast("int").alias("slot"), F.col("b_idx").alias("point_idx"))


def _rooms(s, d):
    return V.points_full(s, d).select("cloud_id", "point_idx", *XYZ, "r", "g", "b", "label")


_F = [f"f{k}" for k in range(9)]

QUERIES = {
    "square_distance": lambda s, d: N.square_distance(V.points(s, d), _coarse(s, d)),
    "vector_distance": lambda s, d: _r(V.table(s, d, "embeddings").select("vec_id", N.vector_distance(F.col("embedding").cast("array<double>"), F.when(F.col("vec_id") % 50 == 0, F.slice("embedding", 1, 8)).otherwise(F.reverse("embedding")).cast("array<double>")).alias("d")), "d"),
    "index_points": lambda s, d: N.index_points(V.points(s, d), _coarse(s, d).select("cloud_id", F.col("point_idx").alias("slot"), (F.col("point_idx") * 7 % 500).alias("point_idx"))),
    "ball_query": lambda s, d: N.ball_query(V.points(s, d), _centres(s, d), _R, _K),
    "sample_and_group": lambda s, d: N.sample_and_group(V.points(s, d), 4, _R, _K),
    "multi_scale_group": lambda s, d: N.multi_scale_group(V.points(s, d), _centres(s, d), [(4.0, 4), (8.0, 8), (12.0, 16)]),
    "group_max": lambda s, d: N.group_max(_groups(s, d), ["x", "y", "z", "r"]),
    "interpolate_3nn": lambda s, d: _r(N.interpolate_3nn(V.points(s, d), _coarse(s, d).withColumn("v", F.col("x") * 3 + F.col("z")), ["v", "y"]), "v", "y"),
    "nn_distance": lambda s, d: N.nn_distance(_sample(s, d), V.points(s, d)),
    "nn_distance_by_radius": lambda s, d: N.nn_distance(_sample(s, d), V.points(s, d), radius=6.0),
    "interpolate_3nn_by_radius": lambda s, d: _r(N.interpolate_3nn(V.points(s, d), _coarse(s, d).withColumn("v", F.col("x") * 3 + F.col("z")), ["v", "y"], radius=12.0), "v", "y"),
    "simplification_loss": lambda s, d: _r(N.simplification_loss(V.points(s, d), _sample(s, d), 15, 1.0, 0.1), "forward", "farthest", "backward", "loss"),
    "nn_match": lambda s, d: N.nn_match(V.points(s, d), _matches(s, d), 20),
    "nn_match_plain": lambda s, d: N.nn_match(V.points(s, d), _matches(s, d), 20, complete=False),
    "soft_project": lambda s, d: _r(N.soft_project(_sample(s, d), V.points(s, d), 7, 4.0), *XYZ),
    "soft_project_hard": lambda s, d: _r(N.soft_project(_sample(s, d), V.points(s, d), hard=True), *XYZ),
    "compare_clouds": lambda s, d: _r(N.compare_clouds(V.points(s, d).withColumn("point_idx", F.col("cloud_id") * 1000 + F.col("point_idx")), _sample(s, d).withColumn("point_idx", F.col("cloud_id") * 1000 + F.col("point_idx"))), "distance"),
    "cloud_pairs": lambda s, d: N.cloud_pairs(V.shapes(s, d)),
    "feature_matches": lambda s, d: _r(N.feature_matches(_vectors(s, d, 0), _vectors(s, d, 1), 1.6), "distance"),
    "room_blocks": lambda s, d: B.room_blocks(V.points(s, d), 128, 20.0, 10.0, seed=3),
    "random_blocks": lambda s, d: _r(B.random_blocks(V.points(s, d), 64, 16.0, min_points=60, seed=3), *XYZ),
    "block_features": lambda s, d: _r(B.block_features(B.room_blocks(_rooms(s, d), 64, 20.0, 10.0, seed=3), _rooms(s, d), 20.0), *_F).select("cloud_id", "bi", "bj", "slot", "point_idx", *_F),
    "room_samples": lambda s, d: _r(B.room_samples(_rooms(s, d), 128, seed=4), *_F).select("cloud_id", "chunk", "slot", "point_idx", *_F),
    "centre_blocks": lambda s, d: _r(B.centre_blocks(_rooms(s, d), S.sampling_plan(_rooms(s, d).groupBy("cloud_id").agg(F.count("*").alias("n_points")), 256), 96, 24.0, min_points=110, tries=12, seed=5), *_F).select("cloud_id", "rep", "slot", "point_idx", *_F),
    "sliding_scene": lambda s, d: _r(B.sliding_scene(_rooms(s, d), 20.0, 10.0, 0.001, 64, seed=6), *_F, "weight").select("cloud_id", "ix", "iy", "batch", "slot", "point_idx", "weight", *_F),
}

_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_C = ", c as (select cloud_id, point_idx, x, y, z from points where point_idx % 100 = 0)"
_SAMP = ", sm as (select cloud_id, point_idx, x + 0.25 as x, y + point_idx % 3 as y, z from points where point_idx % 40 = 0)"


def _balls(scales, centres="c", key="point_idx") -> str:
    """near: candidates by scale; ball: slots, free ones filled with the first point."""
    rows = ", ".join(f"({k}, {r * r}::double, {n})" for k, (r, n) in enumerate(scales))
    return f""", sc(scale, r2, lim) as (values {rows}), near as (
        select a.cloud_id, a.{key} as centre, b.point_idx, scale, lim, row_number() over w - 1 as k, count(*) over (partition by a.cloud_id, a.{key}, scale) as n
        from {centres} a join points b using (cloud_id), sc where {_D2} <= r2 window w as (partition by a.cloud_id, a.{key}, scale order by b.point_idx)),
        ball as (select cloud_id, centre, scale, k as slot, point_idx from near where k < lim
                 union all select cloud_id, centre, scale, s, point_idx from near, range(64) t(s) where k = 0 and s >= n and s < lim)"""


_NN = f""", p as (select a.cloud_id, a.point_idx as i, b.point_idx as j, {_D2} as d2 from sm a join points b using (cloud_id)),
        nn as (select cloud_id, 'a' as side, i as point_idx, min(d2) as d2, arg_min(j, (d2, j)) as nn_idx from p group by 1, 3
               union all select cloud_id, 'b', j, min(d2), arg_min(i, (d2, i)) from p group by 1, 3)"""
_KNN = f", kn as (select a.cloud_id, a.point_idx, b.x, b.y, b.z, {_D2} as d2, row_number() over (partition by a.cloud_id, a.point_idx order by {_D2}, b.point_idx) as k from sm a join points b using (cloud_id))"
_MATCH = ", mt as (select cloud_id, point_idx // 40 as slot, nn_idx as point_idx from nn where side = 'a')"
_RXYZ = "round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z"


def _fit(src: str, keys: str, n: int, salt: str, seed: int, above: bool = True) -> str:
    u = uniform_sql("cloud_id", "slot - base", seed, "salt")
    more = "" if above else f" union all select * exclude (u) from (select *, row_number() over (partition by {keys} order by u, k) - 1 as slot from (select *, {uniform_sql('cloud_id', 'k', seed, 'salt')} as u from rk where m > {n})) where slot < {n}"
    return f""", rk as (select *, row_number() over (partition by {keys} order by point_idx) - 1 as k, count(*) over (partition by {keys}) as m, {salt} as salt from {src}),
        sl as (select {keys}, m, salt, s as slot, case when m > {n} then 0 else m end as base from rk, range({n}) t(s) where k = 0 and m {'<>' if above else '<'} {n} and s >= case when m > {n} then 0 else m end),
        dr as (select {keys}, slot, floor({u} * m)::bigint as k from sl),
        fit as (select *, k as slot from rk where m <= {n}{more} union all select rk.*, slot from dr join rk using ({keys}, k))"""


_BLOCKS = """, lim as (select cloud_id, ceil((max(x) - 20) / 10)::bigint as nx, ceil((max(y) - 20) / 10)::bigint as ny from points group by 1),
        bl as (select p.*, i as bi, j as bj from points p join lim using (cloud_id), range(64) t(i), range(64) u(j) where i <= greatest(nx, 0) and j <= greatest(ny, 0) and x >= i * 10 and x <= i * 10 + 20 and y >= j * 10 and y <= j * 10 + 20),
        big as (select * from (select *, count(*) over (partition by cloud_id, bi, bj) as c from bl) where c >= 100)"""
_ROOM = ", room as (select cloud_id, max(x) as mx, max(y) as my, max(z) as mz from points group by 1)"


def _feat(dx: str, dy: str) -> str:
    return f"round(x - {dx}, 6) + 0.0 as f0, round(y - {dy}, 6) + 0.0 as f1, round(z, 6) + 0.0 as f2, round(r / 255, 6) + 0.0 as f3, round(g / 255, 6) + 0.0 as f4, round(b / 255, 6) + 0.0 as f5, round(x / nullif(mx, 0), 6) + 0.0 as f6, round(y / nullif(my, 0), 6) + 0.0 as f7, round(z / nullif(mz, 0), 6) + 0.0 as f8"


_PLAN = ", pn as (select cloud_id, count(*) as n from points group by 1), pl as (select cloud_id, rep from (select cloud_id, round_even(n / sum(n) over () * floor(sum(n) over () * 1.0::double / 256), 0)::int as times from pn), range(1000) t(rep) where rep < times)"

SQL = {
    "square_distance": sql("points", _C + f" select a.cloud_id, a.point_idx as a_idx, b.point_idx as b_idx, {_D2} as d2 from points a join c b using (cloud_id)"),
    "vector_distance": "select vec_id, case when vec_id % 50 = 0 then -1.0::double else round(sqrt(list_sum([(embedding[i]::double - embedding[len(embedding) + 1 - i]::double) * (embedding[i]::double - embedding[len(embedding) + 1 - i]::double) for i in range(1, len(embedding) + 1)])), 6) + 0.0 end as d from embeddings",
    "index_points": sql("points", _C + " select i.cloud_id, i.point_idx as slot, p.point_idx, p.x, p.y, p.z from c i join points p on p.cloud_id = i.cloud_id and p.point_idx = i.point_idx * 7 % 500"),
    "ball_query": sql("points", _C + _balls([(_R, _K)]) + " select cloud_id, centre, slot::int as slot, point_idx from ball"),
    "sample_and_group": sql("points", _fps(4) + ", c as (select cloud_id, place, x, y, z from w where point_idx = pick)" + _balls([(_R, _K)], "c", "place") + " select b.cloud_id, centre::int as centre, slot::int as slot, point_idx, p.x - c.x as x, p.y - c.y as y, p.z - c.z as z from ball b join points p using (cloud_id, point_idx) join c on c.cloud_id = b.cloud_id and c.place = b.centre", True),
    "multi_scale_group": sql("points", _C + _balls([(4.0, 4), (8.0, 8), (12.0, 16)]) + " select cloud_id, centre, scale::int as scale, slot::int as slot, point_idx from ball"),
    "group_max": sql("points", _C + _balls([(_R, _K)]) + " select cloud_id, centre, max(x) as x, max(y) as y, max(z) as z, max(r) as r from ball join points using (cloud_id, point_idx) group by 1, 2"),
    "interpolate_3nn": sql("points", _C + f", k as (select a.cloud_id, a.point_idx, b.x * 3 + b.z as v, b.y as y, 1 / ({_D2} + 1e-8::double) as w, row_number() over (partition by a.cloud_id, a.point_idx order by {_D2}, b.point_idx) as k from points a join c b using (cloud_id)) select cloud_id, point_idx, round(sum(w * v) / sum(w), 6) + 0.0 as v, round(sum(w * y) / sum(w), 6) + 0.0 as y from k where k <= 3 group by 1, 2"),
    "nn_distance": sql("points", _SAMP + _NN + " select cloud_id, side, point_idx, d2, nn_idx from nn"),
    "simplification_loss": sql("points", _SAMP + _NN + ", m as (select max(d2) as m from nn where side = 'a' group by cloud_id), t as (select avg(d2) filter (where side = 'a') as forward, (select avg(m) from m) as farthest, avg(d2) filter (where side = 'b') as backward from nn) select round(forward, 6) + 0.0 as forward, round(farthest, 6) + 0.0 as farthest, round(backward, 6) + 0.0 as backward, round(forward + farthest + (1 + 0.1::double * 15) * backward, 6) + 0.0 as loss from t"),
    "nn_match": sql("points", _SAMP + _NN + _MATCH + """, f as (select cloud_id, point_idx, row_number() over (partition by cloud_id order by min(slot)) - 1 as seed from mt group by 1, 2),
        s as (select cloud_id, seed, x, y, z from f join points using (cloud_id, point_idx) where seed < 20), h as (select cloud_id, count(*) as held from s group by 1),
        k as (select a.cloud_id, a.point_idx, a.x, a.y, a.z, min(""" + _D2 + """) as best from points a join s b using (cloud_id) group by all),
        w as (select k.*, held as place, arg_max(point_idx, best * 1e7 - point_idx) over (partition by cloud_id) as pick from k join h using (cloud_id) where held < 20
              union all select cloud_id, point_idx, x, y, z, best, place, arg_max(point_idx, best * 1e7 - point_idx) over (partition by cloud_id) from (
                select cloud_id, point_idx, x, y, z, least(best, (x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)) as best, place + 1 as place from (
                    select *, """ + ", ".join(f"max(case when point_idx = pick then {c} end) over (partition by cloud_id) as p{c}" for c in XYZ) + """ from w where place < 19)))
        select cloud_id, seed::int as place, null::bigint as point_idx, x, y, z from s union all select cloud_id, place::int, point_idx, x, y, z from w where point_idx = pick""", True),
    "nn_match_plain": sql("points", _SAMP + _NN + _MATCH + " select cloud_id, point_idx, slot::int as place, x, y, z from mt join points using (cloud_id, point_idx) where slot < 20"),
    "soft_project": sql("points", _SAMP + _KNN + ", w as (select *, exp((min(d2) over (partition by cloud_id, point_idx) - d2) / 4) as w from kn where k <= 7), o as (select cloud_id, point_idx, sum(w * x) / sum(w) as x, sum(w * y) / sum(w) as y, sum(w * z) / sum(w) as z from w group by 1, 2) select cloud_id, point_idx, " + _RXYZ + " from o"),
    "soft_project_hard": sql("points", _SAMP + _KNN + f" select cloud_id, point_idx, {_RXYZ} from kn where k = 1"),
    "compare_clouds": sql("points", _SAMP + " select a.cloud_id * 1000 + a.point_idx as point_idx, a.x as ax, a.y as ay, a.z as az, b.x as bx, b.y as by, b.z as bz, round(sqrt(" + _D2 + "), 6) + 0.0 as distance from points a join sm b using (cloud_id, point_idx)"),
    "cloud_pairs": sql("shapes", "select a.cloud_id as a, b.cloud_id as b from shapes a join shapes b on a.cloud_id < b.cloud_id"),
    "feature_matches": """with v as (select vec_id, label % 2 as odd, embedding::double[] as e, sqrt(list_sum([x::double * x for x in embedding])) as n from embeddings),
        p as (select a.vec_id as a_id, b.vec_id as b_id, a.n as la, b.n as lb, list_distance(a.e, b.e) as d from v a, v b where a.odd = 0 and b.odd = 1),
        m as (select a_id, arg_min(b_id, (d, b_id)) as b_id, min(d) as distance, min(la) as la, arg_min(lb, (d, b_id)) as lb from p group by 1)
        select a_id, b_id, round(distance, 6) + 0.0 as distance, least(la, lb) >= 0.9::double * greatest(la, lb) as kept from m where distance <= 1.6""",
    "room_blocks": sql("points", _BLOCKS + _fit("big", "cloud_id, bi, bj", 128, "bi * 65536 + bj", 3) + " select cloud_id, point_idx, x, y, z, bi, bj, slot from fit"),
    "random_blocks": sql("points", f""", room as (select cloud_id, max(x) as mx, max(y) as my from points group by 1),
        co as (select cloud_id, block, {uniform_sql('cloud_id', 'block', 3, 0)} * (mx + 16) - 16 as x0, {uniform_sql('cloud_id', 'block', 3, 1)} * (my + 16) - 16 as y0 from room, range(256) t(block) where block < ceil(mx / 16) * ceil(my / 16)),
        bl as (select p.cloud_id, point_idx, x, y, z, block from points p join co using (cloud_id) where x >= x0 and x <= x0 + 16 and y >= y0 and y <= y0 + 16),
        big as (select * exclude (c) from (select *, count(*) over (partition by cloud_id, block) as c from bl) where c >= 60)""" + _fit("big", "cloud_id, block", 64, "block + 2", 3) + f" select cloud_id, point_idx, {_RXYZ}, block, slot from fit"),
    "block_features": sql("points", _BLOCKS + _fit("big", "cloud_id, bi, bj", 64, "bi * 65536 + bj", 3) + _ROOM + f" select cloud_id, bi, bj, slot, point_idx, {_feat('(min(x) over w + 10)', '(min(y) over w + 10)')} from fit join room using (cloud_id) window w as (partition by cloud_id, bi, bj)"),
    "room_samples": sql("points", f""", u as (select *, row_number() over (partition by cloud_id order by {uniform_sql('cloud_id', 'point_idx', 4, 0)}, point_idx) - 1 as k, count(*) over (partition by cloud_id) as n from points),
        sl as (select cloud_id, n, n + e as p, floor({uniform_sql('cloud_id', 'e', 4, 1)} * n)::bigint as k from u, range(128) t(e) where k = 0 and n + e < ceil(n / 128) * 128),
        al as (select *, k as p from u union all select u.*, p from sl join u using (cloud_id, k))""" + _ROOM + f" select cloud_id, p // 128 as chunk, p % 128 as slot, point_idx, {_feat('0', '0')} from al join room using (cloud_id)"),
    "centre_blocks": sql("points", _PLAN + f""", cd as (select cloud_id, rep, t, floor({uniform_sql('cloud_id', 'rep', 5, 't')} * n)::bigint as point_idx from pl join pn using (cloud_id), range(12) r(t)),
        ce as (select cloud_id, rep, t, x as x0, y as y0 from cd join points using (cloud_id, point_idx)),
        cn as (select ce.cloud_id, rep, t, x0, y0, count(*) as c from ce join points p using (cloud_id) where abs(p.x - x0) <= 12 and abs(p.y - y0) <= 12 group by all having count(*) > 110),
        c1 as (select cloud_id, rep, arg_min(x0, t) as x0, arg_min(y0, t) as y0 from cn group by 1, 2),
        lf as (select cloud_id, rep from pl anti join c1 using (cloud_id, rep)),
        wv as (select p.cloud_id, p.point_idx, p.x, p.y from points p semi join lf using (cloud_id) join points q on q.cloud_id = p.cloud_id and abs(q.x - p.x) <= 12 and abs(q.y - p.y) <= 12 group by all having count(*) > 110),
        wk as (select *, row_number() over (partition by cloud_id order by point_idx) - 1 as k, count(*) over (partition by cloud_id) as v from wv),
        ch as (from c1 union all select cloud_id, rep, x, y from lf join wk using (cloud_id) where k = floor({uniform_sql('cloud_id', 'rep', 5, '12')} * v)),
        bl as (select p.*, rep, x0, y0 from ch join points p using (cloud_id) where abs(p.x - x0) <= 12 and abs(p.y - y0) <= 12)""" + _fit("bl", "cloud_id, rep", 96, "rep + 1000", 5, False) + _ROOM + f" select cloud_id, rep::int as rep, slot, point_idx, {_feat('x0', 'y0')} from fit join room using (cloud_id)"),
    "sliding_scene": sql("points", f""", lim as (select cloud_id, min(x) as lx, max(x) as hx, min(y) as ly, max(y) as hy from points group by 1),
        gr as (select *, least(lx + ix * 10 + 20, hx) as ex, least(ly + iy * 10 + 20, hy) as ey from lim, range(64) t(ix), range(64) v(iy) where ix <= greatest(ceil((hx - lx - 20) / 10), 0) and iy <= greatest(ceil((hy - ly - 20) / 10), 0)),
        bl as (select p.*, ix, iy, ex - 20 as sx, ey - 20 as sy from points p join gr using (cloud_id) where x >= ex - 20 - 0.001::double and x <= ex + 0.001::double and y >= ey - 20 - 0.001::double and y <= ey + 0.001::double),
        u as (select *, row_number() over (partition by cloud_id, ix, iy order by {uniform_sql('cloud_id', 'point_idx', 6, '(ix * 65536 + iy) * 4')}, point_idx) - 1 as k, count(*) over (partition by cloud_id, ix, iy) as m from bl),
        q as (select *, (ceil(m / 64) * 64 - m)::bigint as pad from u),
        sl as (select cloud_id, ix, iy, m + e as p, floor({uniform_sql('cloud_id', 'e', 6, '(ix * 65536 + iy) * 4 + 1')} * m)::bigint as k from q, range(64) t(e) where k = 0 and pad > m and e < pad),
        al as (select *, k as p from q union all select *, m + k as p from q where pad <= m and k < pad union all select q.*, p from sl join q using (cloud_id, ix, iy, k)),
        sh as (select *, row_number() over (partition by cloud_id, ix, iy order by {uniform_sql('cloud_id', 'p', 6, '(ix * 65536 + iy) * 4 + 2')}, p) - 1 as s from al),
        lw as (select label, pow(max(count(*)) over () / count(*), 1.0::double / 3) as weight from points group by 1)""" + _ROOM + f" select cloud_id, ix, iy, s // 64 as batch, s % 64 as slot, point_idx, round(weight, 6) + 0.0 as weight, {_feat('(sx + 10)', '(sy + 10)')} from sh join room using (cloud_id) join lw using (label)"),
}

SQL |= {f"{k}_by_radius": SQL[k] for k in ("nn_distance", "interpolate_3nn")}
