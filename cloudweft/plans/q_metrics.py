"""Queries of the metrics and augmentation operators."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.keyed import gaussian_sql, rounded, uniform_sql
from ..operators import augment as A
from ..operators import metrics as M
from . import views as V
from .views import sql

XYZ, NORMAL = ("x", "y", "z"), ("nx", "ny", "nz")


def _r(df, *cols):
    return df.withColumns({c: rounded(F.col(c)) for c in cols})


def _normals(s, d):
    return V.points_full(s, d).select("cloud_id", "point_idx", *XYZ, *[(F.col(c) / 100).cast("double").alias(f"n{a}") for c, a in zip("rgb", XYZ)])


def _part_scores(s, d):
    """Scores of all 12 parts for every point, so that the category's restriction matters."""
    p = V.part_preds(s, d)
    e = p.select("cloud_id", "point_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(11).cast("long"))).alias("class"))
    return e.withColumn("score", ((F.col("cloud_id") * 31 + F.col("point_idx") * 17 + F.col("class") * 29) % 23).cast("double"))


def _log(s, d):
    e = V.table(s, d, "events")
    return e.select((F.col("event_id") % 10).alias("run"), F.floor(F.col("event_id") / 10).alias("epoch"), F.col("value").alias("instance"), F.round(F.col("value") * (F.col("user_id") % 7), 4).alias("class"))


_P = ("cloud_id", "point_idx")
_first = lambda s, d: V.points(s, d)

QUERIES = {
    "vote_labels": lambda s, d: M.vote_labels(V.preds(s, d), V.preds(s, d)),
    "vote_scores": lambda s, d: _r(M.vote_scores(V.scores(s, d)), "score"),
    "argmax_in_category": lambda s, d: M.argmax_in_category(_part_scores(s, d), V.part_preds(s, d), V.parts(s)),
    "segmentation_metrics": lambda s, d: _r(M.segmentation_metrics(V.preds(s, d)), "iou", "accuracy", "point_accuracy"),
    "scene_miou": lambda s, d: _r(M.scene_miou(V.preds(s, d)), "miou"),
    "part_iou": lambda s, d: _r(M.part_iou(V.part_preds(s, d), V.parts(s)), "iou"),
    "part_metrics": lambda s, d: _r(M.part_metrics(V.part_preds(s, d), V.parts(s)), "miou", "class_miou", "accuracy", "class_accuracy"),
    "batch_accuracy": lambda s, d: _r(M.batch_accuracy(V.class_preds(s, d), 32, ["item"]), "instance_accuracy", "class_accuracy"),
    "pooled_accuracy": lambda s, d: _r(M.pooled_accuracy(V.class_preds(s, d)), "accuracy", "mean_loss"),
    "confusion_matrix": lambda s, d: _r(M.confusion_matrix(V.class_preds(s, d), range(5)), "accuracy"),
    "best_so_far": lambda s, d: M.best_so_far(_log(s, d), ["instance", "class"], run="run"),
    "prediction_report": lambda s, d: M.prediction_report(V.part_preds(s, d).select("cloud_id", "pred", F.col("part").alias("label")), V.shapes(s, d)),
    "label_weights": lambda s, d: _r(M.label_weights(V.points_full(s, d)), "weight"),
    "label_share": lambda s, d: _r(M.label_share(V.points_full(s, d)), "share"),
    "rotate_y": lambda s, d: _r(A.rotate_y(V.points(s, d), 3), *XYZ),
    "rotate_y_by": lambda s, d: _r(A.rotate_y_by(V.points(s, d), 0.7), *XYZ),
    "rotate_z": lambda s, d: _r(A.rotate_z(V.points(s, d), 3), *XYZ),
    "rotate_with_normals": lambda s, d: _r(A.rotate_with_normals(_normals(s, d), seed=4), *XYZ, *NORMAL),
    "rotate_with_normals_by": lambda s, d: _r(A.rotate_with_normals(_normals(s, d), 0.3), *XYZ, *NORMAL),
    "perturb_rotation": lambda s, d: _r(A.perturb_rotation(_normals(s, d), normals=True, seed=5), *XYZ, *NORMAL),
    "jitter": lambda s, d: _r(A.jitter(V.points(s, d), seed=6), *XYZ),
    "random_shift": lambda s, d: _r(A.random_shift(V.points(s, d), seed=7), *XYZ),
    "random_scale": lambda s, d: _r(A.random_scale(V.points(s, d), seed=8), *XYZ),
    "point_dropout": lambda s, d: A.point_dropout(V.points(s, d), seed=9),
    "noise_points": lambda s, d: _r(A.noise_points(V.points(s, d), 0.1, seed=10), *XYZ),
    "augment": lambda s, d: _r(A.augment(V.points(s, d), "classification", seed=11), *XYZ),
}

_CLASS = """, k as (select {by} label, pred, count(*) as n from preds group by all),
        c as (select {by} class, sum(seen)::bigint as seen, sum(correct)::bigint as correct, sum(u)::bigint as union_ from (
            select {by} label as class, n as seen, case when label = pred then n else 0 end as correct, n as u from k
            union all select {by} pred, 0, 0, case when label = pred then 0 else n end from k) group by all)"""
_PIOU = """, s as (select distinct cloud_id, category from part_preds), sp as (select cloud_id, category, part from s join parts using (category)),
        i as (select cloud_id, sp.category, sp.part, case when count(p.point_idx) = 0 then 1.0::double else count(*) filter (where p.part = sp.part and p.pred = sp.part) / count(p.point_idx) end as iou
              from sp left join part_preds p using (cloud_id) where p.part = sp.part or p.pred = sp.part group by 1, 2, 3),
        iou as (select cloud_id, category, part, coalesce(i.iou, 1.0::double) as iou from sp left join i using (cloud_id, category, part))"""
_RX = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in XYZ)
_RN = ", ".join(f"round({c}, 6) + 0.0 as {c}" for c in NORMAL)
_NV = ", nv as (select cloud_id, point_idx, x, y, z, r / 100 as nx, g / 100 as ny, b / 100 as nz from points)"
_TWO_PI = f"{2 * math.pi!r}::double"


def _turn(table: str, angle: str, seeds: str = "") -> str:
    n = ", nx * cos(a) - nz * sin(a) as nx, ny, nx * sin(a) + nz * cos(a) as nz" if table == "nv" else ""
    return f", t as (select *, {angle} as a from {table}), o as (select cloud_id, point_idx, x * cos(a) - z * sin(a) as x, y, x * sin(a) + z * cos(a) as z{n} from t) select cloud_id, point_idx, {_RX}{', ' + _RN if n else ''} from o"


def _uc(seed: int, salt: int) -> str:
    return uniform_sql("cloud_id", "0", seed, salt)


def _clip(v: str, c: float) -> str:
    return f"greatest(least({v}, {c}::double), -{c}::double)"


_ANG = ", ".join(f"{_clip(gaussian_sql('cloud_id', '0', 5, k) + ' * 0.06::double', 0.18)} as a{k}" for k in range(3))
_ROT = (
    ("cos(a1) * cos(a2)", "sin(a0) * sin(a1) * cos(a2) - cos(a0) * sin(a2)", "cos(a0) * sin(a1) * cos(a2) + sin(a0) * sin(a2)"),
    ("cos(a1) * sin(a2)", "sin(a0) * sin(a1) * sin(a2) + cos(a0) * cos(a2)", "cos(a0) * sin(a1) * sin(a2) - sin(a0) * cos(a2)"),
    ("-sin(a1)", "sin(a0) * cos(a1)", "cos(a0) * cos(a1)"),
)


def _apply(cols) -> str:
    return ", ".join(f"round({' + '.join(f'{cols[i]} * ({_ROT[i][k]})' for i in range(3))}, 6) + 0.0 as {c}" for k, c in enumerate(cols))


def _dropout(seed: int) -> str:
    return f""", w as (select *, {uniform_sql('cloud_id', 'point_idx', seed, 1)} <= {_uc(seed, 0)} * 0.875::double as gone from points),
        dr as (select w.cloud_id, w.point_idx, case when gone then f.x else w.x end as x, case when gone then f.y else w.y end as y, case when gone then f.z else w.z end as z
               from w join (select cloud_id, x, y, z from points where point_idx = 0) f using (cloud_id))"""


SQL = {
    "vote_labels": sql("preds", ", v as (select scene_id, point_idx, pred, count(*) as votes from preds where weight <> 0 group by all), b as (select scene_id, point_idx, arg_max(pred, (votes, -pred)) as pred, max(votes) as votes from v group by 1, 2) select scene_id, point_idx, coalesce(pred, 0) as pred, coalesce(votes, 0) as votes from (select distinct scene_id, point_idx from preds) left join b using (scene_id, point_idx)"),
    "vote_scores": sql("scores", ", m as (select item, class, round(avg(score), 9) as score from scores group by all) select item, arg_max(class, (score, -class)) as pred, round(max(score), 6) + 0.0 as score from m group by 1"),
    "argmax_in_category": sql("part_preds", ", s as (select cloud_id, point_idx, c as class, ((cloud_id * 31 + point_idx * 17 + c * 29) % 23)::double as score, category from part_preds, range(12) t(c)) select cloud_id, point_idx, arg_max(class, (score, -class)) as pred, max(score) as score from s where class // 4 = category group by 1, 2"),
    "segmentation_metrics": sql("preds", _CLASS.format(by="") + ' select class, seen, correct, union_ as "union", round(correct / (union_ + 1e-6), 6) + 0.0 as iou, round(correct / nullif(seen, 0), 6) + 0.0 as accuracy, round(sum(correct) over () / sum(seen) over (), 6) + 0.0 as point_accuracy from c'),
    "scene_miou": sql("preds", _CLASS.format(by="scene_id,") + " select scene_id, count(*) as classes, round(avg(correct / (union_ + 1e-6)), 6) + 0.0 as miou from c where seen > 0 group by 1"),
    "part_iou": sql("part_preds parts", _PIOU + " select cloud_id, category, part, round(iou, 6) + 0.0 as iou from iou"),
    "part_metrics": sql("part_preds parts", _PIOU + """, sh as (select cloud_id, category, avg(iou) as iou from iou group by 1, 2),
        per as (select category, count(*) as shapes, avg(iou) as miou from sh group by 1),
        pt as (select category, part, count(*) as n, count(*) filter (where part = pred) as hit from part_preds group by 1, 2),
        ac as (select category, sum(hit) / sum(n) as accuracy, avg(hit / n) as class_accuracy from pt group by 1),
        al as (select category, shapes, miou, miou as class_miou, accuracy, class_accuracy from per join ac using (category)
               union all select null, (select count(*) from sh), (select avg(iou) from sh), (select avg(miou) from per), (select sum(hit) / sum(n) from pt), (select avg(hit / n) from pt))
        select category, shapes, round(miou, 6) + 0.0 as miou, round(class_miou, 6) + 0.0 as class_miou, round(accuracy, 6) + 0.0 as accuracy, round(class_accuracy, 6) + 0.0 as class_accuracy from al"""),
    "batch_accuracy": sql("class_preds", ", b as (select label, (label = pred)::int as hit, (row_number() over (order by item) - 1) // 32 as batch from class_preds), i as (select avg(a) as a from (select avg(hit) as a from b group by batch)), c as (select avg(a) as a from (select label, avg(a) as a from (select label, batch, avg(hit) as a from b group by 1, 2) group by 1)) select round(i.a, 6) + 0.0 as instance_accuracy, round(c.a, 6) + 0.0 as class_accuracy from i, c"),
    "pooled_accuracy": sql("class_preds", "select label, count(*) as n, count(*) filter (where label = pred) as correct, round(count(*) filter (where label = pred) / count(*), 6) + 0.0 as accuracy, round(avg(loss), 6) + 0.0 as mean_loss from class_preds group by rollup (label)"),
    "confusion_matrix": sql("class_preds", "select label, " + ", ".join(f"count(*) filter (where pred = {k}) as pred_{k}" for k in range(5)) + ", round((select count(*) filter (where label = pred) / count(*) from class_preds), 6) + 0.0 as accuracy from class_preds group by 1"),
    "best_so_far": "with l as (select event_id % 10 as run, event_id // 10 as epoch, value as instance, round(value * (user_id % 7), 4) as class from events), b as (select *, max(instance) over w as best_instance, max(class) over w as best_class from l window w as (partition by run order by epoch rows unbounded preceding)) select *, instance >= best_instance as saved from b",
    "prediction_report": sql("part_preds shapes", "select pred, part as label, file_name as path from part_preds join shapes using (cloud_id)"),
    "label_weights": sql("points", ", c as (select range as label, (select count(*) from points p where p.label = range) as n from range(13)) select label, n, round(pow(max(n) over () / nullif(n, 0), 1.0::double / 3), 6) + 0.0 as weight from c"),
    "label_share": sql("points", "select range as label, round((select count(*) from points p where p.label = range) / (select count(*) from points), 6) + 0.0 as share from range(13)"),
    "rotate_y": sql("points", _turn("points", f"{_uc(3, 0)} * {_TWO_PI}")),
    "rotate_y_by": sql("points", _turn("points", "0.7::double")),
    "rotate_z": sql("points", f", t as (select *, {_uc(3, 0)} * {_TWO_PI} as a from points), o as (select cloud_id, point_idx, x * cos(a) - y * sin(a) as x, x * sin(a) + y * cos(a) as y, z from t) select cloud_id, point_idx, {_RX} from o"),
    "rotate_with_normals": sql("points", _NV + _turn("nv", f"{_uc(4, 0)} * {_TWO_PI}")),
    "rotate_with_normals_by": sql("points", _NV + _turn("nv", "0.3::double")),
    "perturb_rotation": sql("points", _NV + f", t as (select *, {_ANG} from nv) select cloud_id, point_idx, {_apply(XYZ)}, {_apply(NORMAL)} from t"),
    "jitter": sql("points", "select cloud_id, point_idx, " + ", ".join(f"round({c} + {_clip(gaussian_sql('cloud_id', 'point_idx', 6, k) + ' * 0.01::double', 0.05)}, 6) + 0.0 as {c}" for k, c in enumerate(XYZ)) + " from points"),
    "random_shift": sql("points", "select cloud_id, point_idx, " + ", ".join(f"round({c} + ({_uc(7, k)} * 0.2::double - 0.1::double), 6) + 0.0 as {c}" for k, c in enumerate(XYZ)) + " from points"),
    "random_scale": sql("points", "select cloud_id, point_idx, " + ", ".join(f"round({c} * ({_uc(8, 0)} * 0.45::double + 0.8::double), 6) + 0.0 as {c}" for c in XYZ) + " from points"),
    "point_dropout": sql("points", _dropout(9) + " select * from dr"),
    "noise_points": sql("points", f", i as (select distinct point_idx from points), k as (select point_idx, row_number() over (order by {uniform_sql('0', 'point_idx', 10)}, point_idx) as k, count(*) over () as n from i), m as (select point_idx from k where k <= floor(n * 0.1::double)) select cloud_id, p.point_idx, " + ", ".join(f"round(case when m.point_idx is null then {c} else {uniform_sql('cloud_id', 'p.point_idx', 10, k + 1)} * 2 - 1 end, 6) + 0.0 as {c}" for k, c in enumerate(XYZ)) + " from points p left join m using (point_idx)"),
    "augment": sql("points", _dropout(11) + " select cloud_id, point_idx, " + ", ".join(f"round({c} * ({_uc(12, 0)} * 0.45::double + 0.8::double) + ({_uc(13, k)} * 0.2::double - 0.1::double), 6) + 0.0 as {c}" for k, c in enumerate(XYZ)) + " from dr"),
}
