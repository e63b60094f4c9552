"""The driver's tables seen as clouds, shapes, predictions, scores, texts and pairs - for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import session
from ..operators import catalog

#: Rows of a cloud are ordered by every column: no subset is unique.
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points_full(spark: SparkSession, d: str) -> DataFrame:
    """Points with colour, label, area and instance columns.

    Clouds are dealt out to a stated number of tasks: by their compressed size many would share one, whose sort then spills.
    That number grows with the rows of the table (counted from the files' footers), so a task's memory doesn't.
    """
    w, lines = Window.partitionBy("l_suppkey").orderBy(*_ORDER), table(spark, d, "lineitem")
    return lines.select("l_suppkey", *_ORDER).repartition(session.tasks(spark, lines.count()), "l_suppkey").select(
        F.col("l_suppkey").alias("cloud_id"),
        (F.row_number().over(w) - 1).cast("long").alias("point_idx"),
        F.col("l_quantity").cast("double").alias("x"),
        F.floor(F.col("l_extendedprice") / 2000).cast("double").alias("y"),
        (F.round(F.col("l_discount") * 100) + F.lit(0.0)).alias("z"),
        (F.col("l_partkey") * 7 % 256).alias("r"), (F.col("l_partkey") * 13 % 256).alias("g"), (F.col("l_partkey") * 29 % 256).alias("b"),
        ((F.col("l_partkey") + F.col("l_linenumber")) % 13).alias("label"),
        (F.col("l_suppkey") % 6 + 1).alias("area"),
    )


def points(spark: SparkSession, d: str) -> DataFrame:
    return points_full(spark, d).select("cloud_id", "point_idx", "x", "y", "z")


def whole_shapes(spark: SparkSession, d: str) -> DataFrame:
    """``shapes`` with ``whole_name``, the file name with all digits of the number: ``file_name`` keeps four, as in the SQL."""
    ids = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cloud_id")).distinct()
    named = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    name = F.lower(F.replace("n_name", F.lit(" "), F.lit("_")))
    file = lambda number: F.concat(name, F.lit("_"), number, F.lit(".txt"))
    return ids.join(named, F.col("cloud_id") == F.col("s_suppkey")).select(
        "cloud_id", name.alias("class_name"), file(F.lpad(F.col("cloud_id").cast("string"), 4, "0")).alias("file_name"),
        F.when(F.col("cloud_id") % 5 == 0, "test").otherwise("train").alias("split"), file(catalog.zero_padded(F.col("cloud_id"))).alias("whole_name"),
    )


def shapes(spark: SparkSession, d: str) -> DataFrame:
    """One row per cloud: class from the supplier's nation, a number, a file name and a split."""
    return whole_shapes(spark, d).drop("whole_name")


def preds(spark: SparkSession, d: str) -> DataFrame:
    """Three passes of predictions over points of ten scenes; some have weight 0."""
    e = table(spark, d, "events").select("user_id", "event_id", F.explode(F.array(*[F.lit(k) for k in range(3)])).alias("pass"))
    return e.select(
        (F.col("user_id") % 10).alias("scene_id"), F.col("event_id").alias("point_idx"), "pass", (F.col("event_id") % 13).alias("label"),
        ((F.col("event_id") * (F.col("pass") + 1) + F.col("user_id")) % 13).alias("pred"), F.when(F.col("event_id") % 17 == 0, 0.0).otherwise(1.0).alias("weight"),
    )


def part_preds(spark: SparkSession, d: str) -> DataFrame:
    """Clouds of three categories with four parts each (ids 4c .. 4c+3), true and predicted."""
    p = points_full(spark, d)
    c = F.col("cloud_id") % 3
    return p.select("cloud_id", "point_idx", c.alias("category"), (c * 4 + F.col("label") % 3).alias("part"), (c * 4 + (F.col("label") + F.col("point_idx") % 2) % 3).alias("pred"))


def parts(spark: SparkSession) -> DataFrame:
    return spark.range(12).select(F.floor(F.col("id") / 4).alias("category"), F.col("id").alias("part"))


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of 13 classes in two passes, from the first entries of each embedding."""
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 26)).alias("k", "v"))
    return e.select(F.col("vec_id").alias("item"), (F.col("k") % 13).cast("long").alias("class"), F.floor(F.col("k") / 13).alias("pass"), F.round(F.col("v").cast("double"), 4).alias("score"))


def class_preds(spark: SparkSession, d: str) -> DataFrame:
    """One prediction per event: label, pred, loss."""
    return table(spark, d, "events").select(F.col("event_id").alias("item"), (F.col("event_id") % 5).alias("label"), ((F.col("event_id") + F.when(F.col("user_id") % 3 == 0, 1).otherwise(0)) % 5).alias("pred"), F.col("value").alias("loss"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.col("source").alias("class"), F.col("text").alias("body"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """A document and the next one, labelled by quality."""
    t = table(spark, d, "documents").select("doc_id", "text")
    other = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("d2"))
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    return t.join(other, "doc_id").join(labels, "doc_id").select(F.col("doc_id").alias("row_id"), "label", F.col("text").alias("d1"), "d2")


_VIEWS = {
    "points": f"""select l_suppkey as cloud_id, row_number() over (partition by l_suppkey order by {", ".join(_ORDER)}) - 1 as point_idx,
        l_quantity::double as x, floor(l_extendedprice / 2000)::double as y, round(l_discount * 100) + 0.0 as z,
        l_partkey * 7 % 256 as r, l_partkey * 13 % 256 as g, l_partkey * 29 % 256 as b, (l_partkey + l_linenumber) % 13 as label, l_suppkey % 6 + 1 as area
        from lineitem""",
    "shapes": """select cloud_id, lower(replace(n_name, ' ', '_')) as class_name,
        lower(replace(n_name, ' ', '_')) || '_' || lpad(cloud_id::varchar, 4, '0') || '.txt' as file_name, case when cloud_id % 5 = 0 then 'test' else 'train' end as split
        from (select distinct l_suppkey as cloud_id from lineitem) join supplier on cloud_id = s_suppkey join nation on s_nationkey = n_nationkey""",
    "preds": """select user_id % 10 as scene_id, event_id as point_idx, pass, event_id % 13 as label, (event_id * (pass + 1) + user_id) % 13 as pred,
        case when event_id % 17 = 0 then 0.0::double else 1.0::double end as weight from events, (values (0), (1), (2)) t(pass)""",
    "part_preds": "select cloud_id, point_idx, cloud_id % 3 as category, cloud_id % 3 * 4 + label % 3 as part, cloud_id % 3 * 4 + (label + point_idx % 2) % 3 as pred from points",
    "parts": "select range // 4 as category, range as part from range(12)",
    "scores": "select vec_id as item, k % 13 as class, k // 13 as pass, round(embedding[k + 1]::double, 4) as score from embeddings, (select range as k from range(26))",
    "class_preds": "select event_id as item, event_id % 5 as label, (event_id + case when user_id % 3 = 0 then 1 else 0 end) % 5 as pred, value as loss from events",
    "texts": "select doc_id, source as class, text as body from documents",
    "pairs": "select a.doc_id as row_id, quality as label, a.text as d1, b.text as d2 from documents a join documents b on b.doc_id = a.doc_id + 1 join labels l on l.doc_id = a.doc_id",
}
_NEEDS = {"part_preds": ["points"]}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``body`` after the named views as common table expressions. ``body`` may go on with ``, name as (...)``."""
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    head = ", ".join(f"{v} as ({_VIEWS[v]})" for v in names)
    return f"with {'recursive ' if recursive else ''}{head} {body}" if head else body
