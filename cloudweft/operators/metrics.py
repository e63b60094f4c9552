"""Votes, segmentation and classification metrics, class weights: counts first, by one aggregate, then small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sampling import assign_batches


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def vote_labels(preds: DataFrame, points: DataFrame, keys: Sequence[str] = ("scene_id", "point_idx")) -> DataFrame:
    """(keys, pred, votes): the label with most votes of weight not 0 and finite, the lowest on ties; points without a vote get 0."""
    valid = preds.filter((F.col("weight") != 0) & _finite(F.col("weight")))
    counts = valid.groupBy(*keys, "pred").agg(F.count("*").alias("votes"))
    best = counts.groupBy(*keys).agg(F.max_by("pred", F.struct("votes", -F.col("pred"))).alias("pred"), F.max("votes").alias("votes"))
    voted = points.select(*keys).distinct().join(best, list(keys), "left")
    return voted.select(*keys, F.coalesce("pred", F.lit(0)).alias("pred"), F.coalesce("votes", F.lit(0)).alias("votes"))


def _argmax(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(F.max_by("class", F.struct("score", -F.col("class"))).alias("pred"), F.max("score").alias("score"))


def vote_scores(scores: DataFrame, key: str = "item") -> DataFrame:
    """(item, pred, score): the class with the largest mean score over the passes, the lowest on ties."""
    return _argmax(scores.groupBy(key, "class").agg(F.round(F.avg("score"), 9).alias("score")), [key])


def argmax_in_category(scores: DataFrame, truth: DataFrame, parts: DataFrame, keys: Sequence[str] = ("cloud_id", "point_idx")) -> DataFrame:
    """(keys, pred, score): the best part among those of the cloud's category, which the true part of its first point names.

    ``scores`` has (keys, class, score), ``truth`` (cloud_id, point_idx, part), ``parts`` (category, part).
    """
    first = truth.groupBy("cloud_id").agg(F.min_by("part", "point_idx").alias("part"))
    allowed = first.join(F.broadcast(parts), "part").select("cloud_id", "category").join(F.broadcast(parts), "category").select("cloud_id", F.col("part").alias("class"))
    return _argmax(scores.join(allowed, ["cloud_id", "class"], "left_semi"), keys)


def confusion(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, pred, n)."""
    return pred.groupBy(*by, "label", "pred").agg(F.count("*").alias("n"))


def _class_counts(pred: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, class, seen, correct, union) from one confusion table: each of its rows counts for its label and for its prediction."""
    c = confusion(pred, by)
    hit = F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)
    rows = c.select(*by, F.explode(F.array(
        F.struct(F.col("label").alias("class"), F.col("n").alias("seen"), hit.alias("correct"), F.col("n").alias("any")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("seen"), F.lit(0).cast("long").alias("correct"), (F.col("n") - hit).alias("any")),
    )).alias("s"))
    return rows.groupBy(*by, "s.class").agg(F.sum("s.seen").alias("seen"), F.sum("s.correct").alias("correct"), F.sum("s.any").alias("union"))


def segmentation_metrics(pred: DataFrame) -> DataFrame:
    """(class, seen, correct, union, iou, accuracy, point_accuracy); a class never seen has null accuracy."""
    c = _class_counts(pred)
    total = c.agg(F.sum("seen").alias("__s"), F.sum("correct").alias("__c"))
    both = c.join(F.broadcast(total))
    return both.select("class", "seen", "correct", "union", (F.col("correct") / (F.col("union") + 1e-6)).alias("iou"), F.try_divide("correct", "seen").alias("accuracy"), F.try_divide("__c", "__s").alias("point_accuracy"))


def scene_miou(pred: DataFrame, scene: str = "scene_id") -> DataFrame:
    """(scene, classes, miou): mean IoU over the classes present in the truth."""
    seen = _class_counts(pred, [scene]).filter("seen > 0")
    return seen.groupBy(scene).agg(F.count("*").alias("classes"), F.avg(F.col("correct") / (F.col("union") + 1e-6)).alias("miou"))


def part_iou(pred: DataFrame, parts: DataFrame) -> DataFrame:
    """(cloud_id, category, part, iou) for every part of each shape's category; a part in neither truth nor prediction counts 1."""
    shapes = pred.select("cloud_id", "category").distinct().join(F.broadcast(parts), "category")
    counts = _class_counts(pred.select("cloud_id", F.col("part").alias("label"), "pred"), ["cloud_id"]).withColumnRenamed("class", "part")
    both = shapes.join(counts, ["cloud_id", "part"], "left")
    return both.select("cloud_id", "category", "part", F.when(F.coalesce("union", F.lit(0)) == 0, 1.0).otherwise(F.col("correct") / F.col("union")).alias("iou"))


def part_metrics(pred: DataFrame, parts: DataFrame) -> DataFrame:
    """(category, shapes, miou, accuracy): a row per category and a row of null category with all.

    Its ``miou`` is the instance average (mean of shapes), ``class_miou`` the mean of categories, ``accuracy`` that of points,
    ``class_accuracy`` the mean of the parts' accuracies.
    """
    shapes = part_iou(pred, parts).groupBy("cloud_id", "category").agg(F.avg("iou").alias("iou"))
    hits = pred.groupBy("category", "part").agg(F.count("*").alias("n"), F.count(F.when(F.col("part") == F.col("pred"), 1)).alias("hit"))
    per = shapes.groupBy("category").agg(F.count("*").alias("shapes"), F.avg("iou").alias("miou"), F.sum("iou").alias("__sum"))
    acc = hits.groupBy("category").agg((F.sum("hit") / F.sum("n")).alias("accuracy"), F.sum("hit").alias("__hit"), F.sum("n").alias("__n"), F.avg(F.col("hit") / F.col("n")).alias("class_accuracy"), F.count("*").alias("__parts"))
    both = per.join(acc, "category").withColumn("class_miou", F.col("miou"))
    every = both.agg(
        F.lit(None).cast(both.schema["category"].dataType).alias("category"), F.sum("shapes").alias("shapes"), (F.sum("__sum") / F.sum("shapes")).alias("miou"), F.avg("miou").alias("class_miou"),
        (F.sum("__hit") / F.sum("__n")).alias("accuracy"), (F.sum(F.col("class_accuracy") * F.col("__parts")) / F.sum("__parts")).alias("class_accuracy"),
    )
    return both.select(*every.columns).unionByName(every)


def batch_accuracy(pred: DataFrame, size: int, order: Sequence[str], drop_last: bool = False) -> DataFrame:
    """(instance_accuracy, class_accuracy): the mean of batches' accuracies, and the mean over classes of the mean of their batches'."""
    b = assign_batches(pred, size, order, drop_last).withColumn("hit", (F.col("label") == F.col("pred")).cast("double"))
    per_class = b.groupBy("batch", "label").agg(F.avg("hit").alias("a"), F.sum("hit").alias("hits"), F.count("*").alias("n"))
    instance = per_class.groupBy("batch").agg((F.sum("hits") / F.sum("n")).alias("a")).agg(F.avg("a").alias("instance_accuracy"))
    classes = per_class.groupBy("label").agg(F.avg("a").alias("a")).agg(F.avg("a").alias("class_accuracy"))
    return instance.join(F.broadcast(classes))


def pooled_accuracy(pred: DataFrame) -> DataFrame:
    """(label, n, correct, accuracy, mean_loss) per class, and a row of null label with all."""
    hit = F.count(F.when(F.col("label") == F.col("pred"), 1))
    return pred.rollup("label").agg(F.count("*").alias("n"), hit.alias("correct"), (hit / F.count("*")).alias("accuracy"), F.avg("loss").alias("mean_loss"))


def confusion_matrix(pred: DataFrame, classes: Sequence[int]) -> DataFrame:
    """(label, pred_0, pred_1, ..., accuracy): a row per true class, and the overall accuracy in each."""
    wide = pred.groupBy("label").agg(*[F.count(F.when(F.col("pred") == c, 1)).alias(f"pred_{c}") for c in classes])
    total = pred.agg((F.count(F.when(F.col("label") == F.col("pred"), 1)) / F.count("*")).alias("accuracy"))
    return wide.join(F.broadcast(total))


def best_so_far(log: DataFrame, metrics: Sequence[str], order: str = "epoch", run: str | None = None) -> DataFrame:
    """The log with the running best of each metric and ``saved``, whether the first metric reaches its best here."""
    w = Window.partitionBy(*([run] if run else [])).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = log.withColumns({f"best_{m}": F.max(m).over(w) for m in metrics})
    return out.withColumn("saved", F.col(metrics[0]) >= F.col(f"best_{metrics[0]}"))


def prediction_report(pred: DataFrame, shapes: DataFrame, key: str = "cloud_id") -> DataFrame:
    """(pred, label, path): predictions with the file they are for."""
    return pred.join(shapes.select(key, F.col("file_name").alias("path")), key).select("pred", "label", "path")


def label_weights(pts: DataFrame, classes: int = 13) -> DataFrame:
    """(label, n, weight): the cube root of the largest share over each label's; null for a label without points."""
    counts = pts.groupBy("label").agg(F.count("*").alias("n"))
    every = pts.sparkSession.range(classes).withColumnRenamed("id", "label").join(counts, "label", "left")
    top = counts.agg(F.max("n").alias("__top"))
    return every.join(F.broadcast(top)).select("label", F.coalesce("n", F.lit(0)).alias("n"), F.pow(F.try_divide("__top", "n"), F.lit(1 / 3)).alias("weight"))


def label_share(pts: DataFrame, n: int = 13) -> DataFrame:
    """(label, share): the histogram of labels 0 .. n - 1."""
    counts = pts.groupBy("label").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("__total"))
    every = pts.sparkSession.range(n).withColumnRenamed("id", "label").join(counts, "label", "left")
    return every.join(F.broadcast(total)).select("label", (F.coalesce("n", F.lit(0)) / F.col("__total")).alias("share"))
