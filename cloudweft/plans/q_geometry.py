"""Queries of the voxel, farthest-point and geometry operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keyed import rounded
from ..operators import farthest as P
from ..operators import geometry as G
from ..operators import voxel as X
from . import views as V
from .views import sql

XYZ = ("x", "y", "z")
_N, _M = 8, 5


def _r(df, *cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


def _seeds(s, d):
    """Points 0, 50, 100, 150 of each cloud as seeds 0..3."""
    return V.points(s, d).filter("point_idx % 50 = 0 and point_idx < 200").select("cloud_id", (F.col("point_idx") / 50).cast("int").alias("seed_no"), *XYZ)


def _picks(df):
    return df.select("cloud_id", "place", "point_idx")


def _instances(s, d):
    return V.points_full(s, d).withColumnRenamed("label", "instance_id").withColumn("label", F.col("instance_id").cast("int"))


def _named(s, d):
    from ..operators.catalog import ROOM_CLASSES

    name = F.get(F.array(*[F.lit(c) for c in ("stairs", *ROOM_CLASSES[1:])]), F.col("label").cast("int"))
    return V.points_full(s, d).select("cloud_id", "point_idx", F.col("label").alias("instance_id"), name.alias("class_name"), *XYZ)


def _transforms(s, d):
    c = F.col("cloud_id").cast("double")
    row = lambda *v: [F.lit(float(x)) if isinstance(x, (int, float)) else x for x in v]
    m = F.array(*row(0, -1, 0, c, 1, 0, 0, 2, 0, 0, 1, -c, 0, 0, 0, 1))
    return V.shapes(s, d).filter("split = 'train'").select("cloud_id", m.alias("m"))


def _poses(s, d):
    c = F.col("cloud_id")
    return V.shapes(s, d).select("cloud_id", *[(c % k).cast("double").alias(f"t{a}") for a, k in zip(XYZ, (5, 7, 11))], *[F.lit(v).alias(f"q{a}") for a, v in (("x", 0.1), ("y", 0.2), ("z", 0.3))], (c % 3 + 1).cast("double").alias("qw"))


def _angles(s, d):
    a = lambda k, n: (F.col("vec_id") % k - n).cast("double") / 10
    return V.table(s, d, "embeddings").select("vec_id", a(59, 29).alias("az"), a(29, 14).alias("ay"), a(61, 30).alias("ax"))


def _matrix(s, d):
    m = G.euler_to_matrix(F.col("az"), F.col("ay"), F.col("ax"))
    return _angles(s, d).select("vec_id", *[rounded(m[i][k]).alias(f"m{i}{k}") for i in range(3) for k in range(3)])


def _euler(s, d):
    m = G.euler_to_matrix(F.col("az"), F.col("ay"), F.col("ax"))
    return _angles(s, d).select("vec_id", G.matrix_to_euler(m).alias("e")).select("vec_id", *[rounded(F.col(f"e.{c}")).alias(c) for c in "zyx"])


def _quat(s, d):
    q = _angles(s, d).select("vec_id", G.euler_to_quat(F.col("az"), F.col("ay"), F.col("ax")).alias("q"))
    back = G.quat_to_euler(*[F.col(f"q.{c}") for c in "wxyz"])
    turn = G.quat_to_axis_angle(*[F.col(f"q.{c}") for c in "wxyz"])
    q = q.withColumns({"e": back, "t": turn})
    return q.select("vec_id", *[rounded(F.col(f"q.{c}")).alias(f"q{c}") for c in "wxyz"], *[rounded(F.col(f"e.{c}")).alias(f"e{c}") for c in "zyx"], rounded(F.col("t.angle")).alias("angle"))


def _volume(s, d):
    return G.to_volume(V.points(s, d).withColumns({"x": F.col("x") / 25 - 1, "y": F.col("y") / 25 - 1, "z": F.col("z") / 5 - 1}), 12, 1.0)


def _report(s, d):
    from ..operators import sampling as S

    p = V.points(s, d)
    return _r(P.sampling_report(p, {"every_40": S.uniform_down_sample(p, 40), "random_10": S.random_down_sample(p, 0.1, 3), "voxel_10": X.voxel_down_sample(p, 10.0), "farthest_8": P.farthest_point_sample(p, _N)}), "share")


QUERIES = {
    "voxel_average_trunc": lambda s, d: _r(X.voxel_average_trunc(V.points(s, d).withColumn("x", F.col("x") - 25), 8.0, 40), *XYZ),
    "voxel_down_sample": lambda s, d: _r(X.voxel_down_sample(G.normalize_unit(V.points(s, d)), 0.19), *XYZ).groupBy("cloud_id").agg(F.count("*").alias("kept"), F.sum("n").alias("n_points"), F.max("n").alias("fullest")),
    "voxel_down_sample_cells": lambda s, d: _r(X.voxel_down_sample(V.points(s, d), 10.0), *XYZ),
    "sweep_down_sample": lambda s, d: X.sweep_down_sample(V.points(s, d), [4.0, 10.0, 25.0], [4, 40, 400]),
    "farthest_point_sample": lambda s, d: _picks(P.farthest_point_sample(V.points(s, d), _N)),
    "last_point_sample": lambda s, d: _picks(P.last_point_sample(V.points(s, d), _N, start=2)),
    "fps_complete": lambda s, d: P.fps_complete(V.points(s, d), _seeds(s, d).filter("seed_no < 3"), _N),
    "voxel_fps_sample": lambda s, d: _r(P.voxel_fps_sample(V.points(s, d), 12, 20.0, 7), *XYZ),
    "head_last_point_sample": lambda s, d: _picks(P.head_last_point_sample(V.points(s, d), 20, 14)),
    "group_last_seed": lambda s, d: P.group_last_seed(V.points(s, d), _seeds(s, d), 12.5),
    "group_nearest_seed": lambda s, d: P.group_nearest_seed(V.points(s, d), _seeds(s, d), 12.5),
    "sampling_report": _report,
    "normalize_unit": lambda s, d: _r(G.normalize_unit(V.points(s, d)), *XYZ),
    "cloud_bounds": lambda s, d: _r(G.cloud_bounds(V.points(s, d)), "voxel_size"),
    "shift_to_origin": lambda s, d: G.shift_to_origin(V.points(s, d)),
    "collect_rooms": lambda s, d: G.collect_rooms(_named(s, d)),
    "instance_boxes": lambda s, d: G.instance_boxes(_instances(s, d)),
    "points_with_boxes": lambda s, d: G.points_with_boxes(_instances(s, d).select("cloud_id", "point_idx", "instance_id", *XYZ)),
    "box_corners": lambda s, d: _r(G.box_corners(G.instance_boxes(_instances(s, d)), (0, 2, 1), True, (7,)), *XYZ),
    "to_volume": _volume,
    "from_volume": lambda s, d: G.from_volume(_volume(s, d)),
    "merge_clouds": lambda s, d: G.merge_clouds([V.points(s, d).filter("cloud_id % 2 = 1"), V.points(s, d).filter("cloud_id % 2 = 0")], 7),
    "transform_points": lambda s, d: G.transform_points(V.points(s, d), _transforms(s, d)),
    "apply_poses": lambda s, d: _r(G.apply_poses(V.points(s, d), _poses(s, d)), *XYZ),
    "euler_to_matrix": _matrix,
    "matrix_to_euler": _euler,
    "euler_to_quat": _quat,
    "estimate_normals": lambda s, d: _r(G.estimate_normals(V.points(s, d), 6.0, 20), "nx", "ny", "nz"),
}

_D2 = "(x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)"
_AT = ", ".join(f"max(case when point_idx = pick then {c} end) over (partition by cloud_id) as p{c}" for c in XYZ)


def _fps(n: int, start: str = "0") -> str:
    return f""", w as (
        select cloud_id, point_idx, x, y, z, 0 as place, 1e10 as best, {start}::bigint as pick from points
        union all
        select cloud_id, point_idx, x, y, z, place + 1, best, arg_max(point_idx, best * 1e7 - point_idx) over (partition by cloud_id)
        from (select *  replace (least(best, {_D2}) as best) from (select *, {_AT} from w where place < {n - 1})))"""


_LAST = f""", w as (
        select cloud_id, point_idx, x, y, z, 0 as place, false as gone, 2::bigint as pick from points
        union all
        select cloud_id, point_idx, x, y, z, place, gone or point_idx = pick, pick from (
            select *, arg_max(point_idx, case when gone then -1e300 else d * 1e7 - point_idx end) over (partition by cloud_id) as pick
            from (select cloud_id, point_idx, x, y, z, place + 1 as place, gone, {_D2} as d from (select *, {_AT} from w where place < {_N - 1})))) select distinct cloud_id, place::int as place, pick as point_idx from w"""
_HEADLAST = f""", w as (
        select cloud_id, point_idx, x, y, z, 13 as place, point_idx < 14 as gone, 13::bigint as pick from points
        union all
        select cloud_id, point_idx, x, y, z, place, gone or point_idx = pick, pick from (
            select *, arg_max(point_idx, case when gone then -1e300 else d * 1e7 - point_idx end) over (partition by cloud_id) as pick
            from (select cloud_id, point_idx, x, y, z, place + 1 as place, gone, {_D2} as d from (select *, {_AT} from w where place < 19))))
        select cloud_id, point_idx::int as place, point_idx from points where point_idx < 14
        union all select distinct cloud_id, place::int, pick from w where place > 13"""
_COMPLETE = f""", s as (select cloud_id, point_idx // 50 as seed_no, x, y, z from points where point_idx in (0, 50, 100)),
        k as (select p.cloud_id, point_idx, p.x, p.y, p.z, min((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z)) as best from points p join s using (cloud_id) group by all),
        w as (
        select *, 3 as place, arg_max(point_idx, best * 1e7 - point_idx) over (partition by cloud_id) as pick from k
        union all
        select cloud_id, point_idx, x, y, z, best, place, arg_max(point_idx, best * 1e7 - point_idx) over (partition by cloud_id)
        from (select cloud_id, point_idx, x, y, z, least(best, {_D2}) as best, place + 1 as place from (select *, {_AT} from w where place < {_N - 1})))
        select cloud_id, seed_no::int as place, null::bigint as point_idx, x, y, z from s
        union all select w.cloud_id, place::int, point_idx, x, y, z from w where point_idx = pick"""
_TRUNC = """, c as (select cloud_id, trunc((x {shift}) / {size})::bigint as i, trunc(y / {size})::bigint as k, trunc(z / {size})::bigint as m, avg(x {shift}) as x, avg(y) as y, avg(z) as z, min(point_idx) as f from points group by 1, 2, 3, 4),
        v as (select cloud_id, row_number() over (partition by cloud_id order by f) - 1 as place, x, y, z from c)"""
_CELLS = """, c as (select p.*, floor((p.x - (min(p.x) over w - {h})) / {s})::bigint as ix, floor((p.y - (min(p.y) over w - {h})) / {s})::bigint as iy, floor((p.z - (min(p.z) over w - {h})) / {s})::bigint as iz from {t} p window w as (partition by cloud_id))"""
_UNIT = """, c0 as (select cloud_id, point_idx, x - avg(x) over w as x, y - avg(y) over w as y, z - avg(z) over w as z from points window w as (partition by cloud_id)),
        unit as (select cloud_id, point_idx, x / m as x, y / m as y, z / m as z from (select *, max(sqrt(x * x + y * y + z * z)) over (partition by cloud_id) as m from c0))"""
_SEEDS = """, s as (select cloud_id, point_idx // 50 as seed_no, x, y, z from points where point_idx % 50 = 0 and point_idx < 200),
        n as (select p.cloud_id, point_idx, seed_no, sqrt((p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) + (p.z - s.z) * (p.z - s.z)) as d from points p join s using (cloud_id))"""
_RXYZ = "round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, round(z, 6) + 0.0 as z"
_BOXES = """, b0 as (select cloud_id, label as instance_id, label::int as label, min(x) as x1, max(x) as x2, min(y) as y1, max(y) as y2, min(z) as z1, max(z) as z2 from points group by 1, 2, 3),
        b as (select cloud_id, instance_id, label, """ + ", ".join(f"{c}{k} - min({c}1) over (partition by cloud_id) as {c}{k}" for c in XYZ for k in (1, 2)) + " from b0)"
_VOLUME = """, v as (select distinct cloud_id, trunc((x / 25 - 1 + 1) / (2.0::double / 12))::bigint as a, trunc((y / 25 - 1 + 1) / (2.0::double / 12))::bigint as b, trunc((z / 5 - 1 + 1) / (2.0::double / 12))::bigint as c from points),
        vol as (select * from v where a between 0 and 11 and b between 0 and 11 and c between 0 and 11)"""
_ANGLES = "with a as (select vec_id, (vec_id % 59 - 29)::double / 10 as az, (vec_id % 29 - 14)::double / 10 as ay, (vec_id % 61 - 30)::double / 10 as ax from embeddings)"
_MAT = {
    "m00": "cos(ay) * cos(az)", "m01": "-cos(ay) * sin(az)", "m02": "sin(ay)", "m10": "sin(ax) * sin(ay) * cos(az) + cos(ax) * sin(az)", "m11": "cos(ax) * cos(az) - sin(ax) * sin(ay) * sin(az)",
    "m12": "-sin(ax) * cos(ay)", "m20": "sin(ax) * sin(az) - cos(ax) * sin(ay) * cos(az)", "m21": "cos(ax) * sin(ay) * sin(az) + sin(ax) * cos(az)", "m22": "cos(ax) * cos(ay)",
}
_EULER = "atan2(-m01, m00) as z, atan2(m02, sqrt(m22 * m22 + m12 * m12)) as y, atan2(-m12, m22) as x"
_QUAT = {
    "w": "cos(ax / 2) * cos(ay / 2) * cos(az / 2) - sin(ax / 2) * sin(ay / 2) * sin(az / 2)", "x": "cos(ax / 2) * sin(ay / 2) * sin(az / 2) + cos(ay / 2) * cos(az / 2) * sin(ax / 2)",
    "y": "cos(ax / 2) * cos(az / 2) * sin(ay / 2) - sin(ax / 2) * cos(ay / 2) * sin(az / 2)", "z": "cos(ax / 2) * cos(ay / 2) * sin(az / 2) + sin(ax / 2) * cos(az / 2) * sin(ay / 2)",
}
_POSE = """, q as (select distinct cloud_id, (cloud_id % 5)::double tx, (cloud_id % 7)::double ty, (cloud_id % 11)::double tz, 0.1::double qx, 0.2::double qy, 0.3::double qz, (cloud_id % 3 + 1)::double qw from points),
        m as (select *, 2.0 / (qw * qw + qx * qx + qy * qy + qz * qz) as s from q)"""

SQL = {
    "voxel_average_trunc": sql("points", _TRUNC.format(shift="- 25", size="8.0::double") + f" select cloud_id, place::int as place, {_RXYZ} from v where place < 40"),
    "voxel_down_sample": sql("points", _UNIT + _CELLS.format(h="0.19::double / 2", s="0.19::double", t="unit") + ", g as (select cloud_id, count(*) as n from c group by cloud_id, ix, iy, iz) select cloud_id, count(*) as kept, sum(n)::bigint as n_points, max(n) as fullest from g group by 1"),
    "voxel_down_sample_cells": sql("points", _CELLS.format(h="5.0::double", s="10.0::double", t="points") + ", g as (select cloud_id, ix, iy, iz, count(*) as n, avg(x) as x, avg(y) as y, avg(z) as z from c group by 1, 2, 3, 4) select cloud_id, ix, iy, iz, n, " + _RXYZ + " from g"),
    "sweep_down_sample": sql("points", " ".join(_CELLS.format(h=f"{s}::double / 2", s=f"{s}::double", t="points").replace(", c as", f", c{k} as") for k, s in enumerate((4.0, 10.0, 25.0))) + "".join(f" {'union all' if k else ''} select 'voxel' as method, {s}::double as setting, cloud_id, count(distinct (ix, iy, iz)) as n_points from c{k} group by 3" for k, s in enumerate((4.0, 10.0, 25.0))) + "".join(f" union all select 'every', {k}.0::double, cloud_id, count(*) from points where point_idx % {k} = 0 group by 3" for k in (4, 40, 400))),
    "farthest_point_sample": sql("points", _fps(_N) + " select distinct cloud_id, place::int as place, pick as point_idx from w", True),
    "last_point_sample": sql("points", _LAST, True),
    "fps_complete": sql("points", _COMPLETE, True),
    "voxel_fps_sample": sql("points", _TRUNC.format(shift="", size="20.0::double") + _fps(12) + f""", h as (select cloud_id, least(count(*), 7) as held from v group by 1)
        select cloud_id, place::int as place, null::bigint as point_idx, {_RXYZ} from v where place < 7
        union all select cloud_id, (place + held)::int, point_idx, x, y, z from w join h using (cloud_id) where point_idx = pick and place < 12 - held""", True),
    "head_last_point_sample": sql("points", _HEADLAST, True),
    "group_last_seed": sql("points", _SEEDS + " select cloud_id, point_idx, coalesce(max(case when d < 12.5 then seed_no end), 0)::bigint as label from n group by 1, 2"),
    "group_nearest_seed": sql("points", _SEEDS + " select cloud_id, point_idx, arg_min(seed_no, (case when d > 12.5 then d + 12.5e6 else d end, seed_no))::bigint as label from n group by 1, 2"),
    "normalize_unit": sql("points", _UNIT + f" select cloud_id, point_idx, {_RXYZ} from unit"),
    "cloud_bounds": sql("points", ", b as (select cloud_id, min(x) as min_x, max(x) as max_x, min(y) as min_y, max(y) as max_y, min(z) as min_z, max(z) as max_z from points group by 1), e as (select *, greatest(max_x - min_x, max_y - min_y, max_z - min_z) as extent from b) select *, round(extent / 30, 6) + 0.0 as voxel_size from e"),
    "shift_to_origin": sql("points", "select cloud_id, point_idx, x - min(x) over w as x, y - min(y) over w as y, z - min(z) over w as z from points window w as (partition by cloud_id)"),
    "collect_rooms": sql("points", "select cloud_id, point_idx, label as instance_id, (case when label = 0 then 12 else label end)::int as label, x - min(x) over w as x, y - min(y) over w as y, z - min(z) over w as z from points window w as (partition by cloud_id)"),
    "instance_boxes": sql("points", _BOXES + " select * from b"),
    "points_with_boxes": sql("points", ", i as (select cloud_id, label as instance_id, point_idx, x, y, z, " + ", ".join(f"(min({c}) over i + max({c}) over i) / 2 - {c} as d{c}, (max({c}) over i - min({c}) over i) / 2 as h{c}" for c in XYZ) + " from points window i as (partition by cloud_id, label)) select * replace (" + ", ".join(f"{c} - min({c}) over (partition by cloud_id) as {c}" for c in XYZ) + ") from i"),
    "box_corners": sql("points", _BOXES + """, p as (select cloud_id, instance_id, label, x1, x2, z1 as y1, z2 as y2, y1 as z1, y2 as z2 from b),
        h as (select *, max(x2) over w / 2 as hx, max(y2) over w / 2 as hy, max(z2) over w / 2 as hz from p window w as (partition by cloud_id)),
        n as (select cloud_id, instance_id, label, (x1 - hx) / g as x1, (x2 - hx) / g as x2, (y1 - hy) / g as y1, (y2 - hy) / g as y2, (z1 - hz) / g as z1, (z2 - hz) / g as z2 from (select *, nullif(greatest(hx, hy, hz), 0) as g from h) where label <> 7)
        """ + " union all ".join(f"select cloud_id, instance_id, label, {k} as corner, round(x{i}, 6) + 0.0 as x, round(y{j}, 6) + 0.0 as y, round(z{m}, 6) + 0.0 as z from n" for k, (i, j, m) in enumerate((x, y, z) for z in (2, 1) for x, y in ((1, 1), (1, 2), (2, 2), (2, 1))))),
    "to_volume": sql("points", _VOLUME + " select * from vol"),
    "from_volume": sql("points", _VOLUME + " select cloud_id, row_number() over (partition by cloud_id order by a, b, c) - 1 as point_idx, a::double as x, b::double as y, c::double as z from vol"),
    "merge_clouds": sql("points", "select 7::bigint as cloud_id, row_number() over (order by 1 - cloud_id % 2, cloud_id, point_idx) - 1 as point_idx, x, y, z from points"),
    "transform_points": sql("points", "select cloud_id, point_idx, case when cloud_id % 5 > 0 then -y + cloud_id else x end as x, case when cloud_id % 5 > 0 then x + 2 else y end as y, case when cloud_id % 5 > 0 then z - cloud_id else z end as z from points"),
    "apply_poses": sql("points", _POSE + """ select cloud_id, point_idx,
        round((1 - s * (qy * qy + qz * qz)) * x + s * (qx * qy - qw * qz) * y + s * (qx * qz + qw * qy) * z + tx, 6) + 0.0 as x,
        round(s * (qx * qy + qw * qz) * x + (1 - s * (qx * qx + qz * qz)) * y + s * (qy * qz - qw * qx) * z + ty, 6) + 0.0 as y,
        round(s * (qx * qz - qw * qy) * x + s * (qy * qz + qw * qx) * y + (1 - s * (qx * qx + qy * qy)) * z + tz, 6) + 0.0 as z from points join m using (cloud_id)"""),
    "euler_to_matrix": _ANGLES + " select vec_id, " + ", ".join(f"round({v}, 6) + 0.0 as {k}" for k, v in _MAT.items()) + " from a",
    "matrix_to_euler": _ANGLES + ", m as (select vec_id, " + ", ".join(f"{v} as {k}" for k, v in _MAT.items()) + f" from a), e as (select vec_id, {_EULER} from m) select vec_id, {_RXYZ} from e",
    "euler_to_quat": _ANGLES + ", q as (select *, " + ", ".join(f"{v} as q{k}" for k, v in _QUAT.items()) + " from a), m as (select *, " + ", ".join(f"{v} as {k}" for k, v in _MAT.items()) + f" from q), e as (select vec_id, qw, qx, qy, qz, {_EULER} from m) select vec_id, " + ", ".join(f"round(q{c}, 6) + 0.0 as q{c}" for c in "wxyz") + ", " + ", ".join(f"round({c}, 6) + 0.0 as e{c}" for c in "zyx") + ", round(2 * acos(greatest(least(qw, 1.0::double), -1.0::double)), 6) + 0.0 as angle from e",
}
SQL["sampling_report"] = sql("points", _CELLS.format(h="5.0::double", s="10.0::double", t="points") + """, t as (select count(*) as total, count(distinct cloud_id) as clouds from points),
        k as (select 'every_40' as sampler, count(*) as kept from points where point_idx % 40 = 0
              union all select 'random_10', sum(floor(n * 0.1::double))::bigint from (select count(*) as n from points group by cloud_id)
              union all select 'voxel_10', count(distinct (cloud_id, ix, iy, iz)) from c union all select 'farthest_8', clouds * 8 from t)
        select sampler, clouds, kept, round(kept / total, 6) + 0.0 as share from k, t""")
