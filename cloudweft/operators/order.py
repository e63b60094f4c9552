"""Global order without one task that sees every row: range partitions, and a prefix sum of their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranked(df: DataFrame, *keys: str | Column, name: str = "rank", of: str | None = None) -> DataFrame:
    """``df`` with each row's 0-based place in the order of ``keys`` (ascending, nulls first; ties in any order), or with the sum of the
    whole numbers ``of`` of the rows before it.

    Rows are dealt out by ranges of the keys, numbered inside each, and get the number of rows in the ranges before theirs: one
    row a range is all that is ever brought together. Keys that are equal for very many rows need a further key to be split.
    The numbered table is written, as the ranges are drawn from a sample and must be drawn once.
    """
    spark = df.sparkSession
    keys = [F.col(k) if isinstance(k, str) else k for k in keys]
    rows = df.withColumns({f"__rank_key{k}": key for k, key in enumerate(keys)})
    cols = [F.col(f"__rank_key{k}").asc_nulls_first() for k in range(len(keys))]
    rows = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *cols).withColumn("__rank_part", F.spark_partition_id())
    each = F.col(of).cast("bigint") if of else F.lit(1).cast("bigint")
    rows = rows.withColumn("__rank_own", each).withColumn("__rank_at", F.sum("__rank_own").over(Window.partitionBy("__rank_part").orderBy(*cols).rowsBetween(Window.unboundedPreceding, 0)))
    inside = written(rows, "ranked")
    upto = Window.orderBy("__rank_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = inside.groupBy("__rank_part").agg(F.sum("__rank_own").alias("__n")).select("__rank_part", F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__rank_before"))
    out = inside.join(F.broadcast(before), "__rank_part").withColumn(name, F.col("__rank_before") + F.col("__rank_at") - F.col("__rank_own"))
    return out.select(*df.columns, name)


def ranked_inside(df: DataFrame, by: str, *keys: str | Column, name: str = "rank", size: str = "n") -> DataFrame:
    """``df`` with each row's 0-based place among the rows of its group ``by``, in the order of ``keys``, and the group's ``size``.

    Places are global ranks minus the group's first, so a group that holds most rows is spread over many tasks. Nulls in ``by`` are a group.
    """
    rows = ranked(df, by, *keys, name=name)
    groups = rows.groupBy(F.col(by).alias("__by")).agg(F.min(name).alias("__first"), F.count("*").alias(size))
    return rows.join(groups, F.col(by).eqNullSafe(F.col("__by"))).withColumn(name, F.col(name) - F.col("__first")).select(*df.columns, name, size)
