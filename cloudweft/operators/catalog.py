"""Catalogues of clouds: counts, quality checks, names, look-ups, reshaping. Points are (cloud_id, point_idx, x, y, z, ...)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The thirteen room classes in order, their colours, and the ids of the easy view.
ROOM_CLASSES = ("ceiling", "floor", "wall", "beam", "column", "window", "door", "table", "chair", "sofa", "bookcase", "board", "clutter")
ROOM_COLOURS = (
    (0, 255, 0), (0, 0, 255), (0, 255, 255), (255, 255, 0), (255, 0, 255), (100, 100, 255), (200, 200, 100), (170, 120, 200), (255, 0, 0), (200, 100, 100), (10, 200, 100), (200, 200, 200), (50, 50, 50),
)
EASY_VIEW = (7, 8, 9, 10, 11, 1)
WALLS = (0, 2)


def count_clouds(pts: DataFrame) -> DataFrame:
    """n_clouds: how many clouds there are."""
    return pts.agg(F.countDistinct("cloud_id").alias("n_clouds"))


def points_per_cloud(pts: DataFrame, error_col: str | None = None) -> DataFrame:
    """(cloud_id, n_points); null for a cloud with any row whose ``error_col`` is set."""
    n = F.count(F.lit(1))
    if error_col:
        n = F.when(F.count(error_col) == 0, n)
    return pts.groupBy("cloud_id").agg(n.alias("n_points"))


def wrong_size(pts: DataFrame, n: int) -> DataFrame:
    """Clouds that do not have exactly ``n`` points."""
    return points_per_cloud(pts).filter(F.col("n_points") != n)


def below_size(pts: DataFrame, t: int, shapes: DataFrame | None = None) -> DataFrame:
    """Clouds of ``t`` points or fewer; with a shape list, its clouds without points count 0."""
    sizes = points_per_cloud(pts)
    if shapes is not None:
        sizes = shapes.select("cloud_id").distinct().join(sizes, "cloud_id", "left").select("cloud_id", F.coalesce("n_points", F.lit(0)).alias("n_points"))
    return sizes.filter(F.col("n_points") <= t)


def bad_lines(lines: DataFrame, sep: str = ",") -> DataFrame:
    """(cloud_id, line_no): 1-based numbers of lines with a part that is no number. An empty line passes."""
    parts = F.split("value", sep)
    bad = F.exists(parts, lambda x: F.trim(x).try_cast("double").isNull())
    return lines.filter((F.trim("value") != "") & bad).select("cloud_id", "line_no")


def xyz_only(pts: DataFrame) -> DataFrame:
    return pts.select("cloud_id", "point_idx", "x", "y", "z")


def redelimit(lines: DataFrame, sep: str = ",") -> DataFrame:
    """Lines with every run of white space replaced by ``sep``, none at the ends."""
    return lines.withColumn("value", F.regexp_replace(F.regexp_replace("value", r"^\s+|\s+$", ""), r"\s+", sep))


def parse_shape_name(col: Column) -> Column:
    """struct(class_name, number) of ``some_class_0012.txt``: all but the last part is the class."""
    stem = F.regexp_replace(F.regexp_replace(col, "^.*/", ""), r"\.[^.]*$", "")
    return F.struct(F.regexp_extract(stem, "^(.*)_[^_]*$", 1).alias("class_name"), F.regexp_extract(stem, "([^_]*)$", 1).try_cast("int").alias("number"))


def zero_padded(number: Column, width: int = 4) -> Column:
    """At least ``width`` digits; longer numbers are not cut."""
    text = number.cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def shape_ids(files: DataFrame, col: str = "file_name") -> DataFrame:
    """Distinct ids ``class_0012`` in order."""
    name = parse_shape_name(F.col(col))
    return files.select(F.concat(name["class_name"], F.lit("_"), zero_padded(name["number"])).alias("shape_id")).distinct().orderBy("shape_id")


def relative_paths(files: DataFrame, root: str, col: str = "path") -> DataFrame:
    """Paths below ``root``, relative to it; others are left out."""
    root = root.rstrip("/") + "/"
    return files.filter(F.col(col).startswith(root)).select(F.expr(f"substring({col}, {len(root) + 1})").alias("path"))


def renumber_shapes(shapes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Shapes (class_name, number) with classes renamed by ``mapping`` (old, new; unknown ones keep theirs) and numbered 1..n in each."""
    names = mapping.select(F.col("old").alias("class_name"), "new")
    renamed = shapes.join(F.broadcast(names), "class_name", "left").withColumn("new_class", F.coalesce("new", "class_name"))
    order = Window.partitionBy("new_class").orderBy("number", "class_name")
    return renamed.select("class_name", "number", "new_class", F.row_number().over(order).alias("new_number"))


def replace_clouds(target: DataFrame, source: DataFrame, names: DataFrame) -> DataFrame:
    """``target`` with the files listed in ``names`` (path) taken from ``source`` where it has them: replaced, or inserted if absent."""
    fresh = source.join(names.select("path").distinct(), "path", "left_semi")
    return target.join(fresh.select("path").distinct(), "path", "left_anti").unionByName(fresh)


def encode_class(df: DataFrame, classes: Sequence[str] = ROOM_CLASSES, default: str = "clutter", col: str = "class_name") -> DataFrame:
    """Adds class_id, the place of the class in ``classes``; unknown and null ones count as ``default``."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.coalesce(F.col(col), F.lit(default)))
    return df.withColumn("class_id", F.when(at > 0, at - 1).otherwise(F.lit(list(classes).index(default))).cast("int"))


def colourise(pts: DataFrame, easy_view: bool = False, no_wall: bool = False, colours: Sequence[tuple[int, int, int]] = ROOM_COLOURS) -> DataFrame:
    """Points with r, g, b of their label; optionally the easy view's labels alone, or without walls and ceilings."""
    if easy_view:
        pts = pts.filter(F.col("label").isin(*EASY_VIEW))
    if no_wall:
        pts = pts.filter(~F.col("label").isin(*WALLS))
    rows = F.array(*[F.array(*[F.lit(v) for v in c]) for c in colours])
    return pts.withColumns({c: F.get(F.get(rows, F.col("label").cast("int")), F.lit(k)) for k, c in enumerate("rgb")})


def one_hot(col: Column, n: int) -> Column:
    """An array of ``n`` zeros and a one at ``col``; all zeros if it is out of range."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == col, 1).otherwise(0))


def pending(inputs: DataFrame, done: DataFrame, key: str = "cloud_id") -> DataFrame:
    """Inputs whose key has no output yet."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def rename_by(mapping: Mapping[str, str], spark) -> DataFrame:
    """A mapping as the (old, new) table of ``renumber_shapes``."""
    return spark.createDataFrame(list(mapping.items()) or [], "old string, new string")
