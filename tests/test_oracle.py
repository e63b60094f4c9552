"""Every query of the library against its SQL in DuckDB, and those without SQL for rows and schema."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cloudweft import plans
from cloudweft.operators.in_task import each_cloud

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, tiny, con, name):
    df = plans.QUERIES[name](spark, tiny)
    cols = sorted(df.columns)
    res = con.execute(plans.SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*cols).collect())
    assert got == want


@pytest.mark.parametrize("name", ["parse_shape_name", "shape_ids"])
def test_shape_numbers_of_more_than_four_digits(spark, tiny, tmp_path, name):
    c = duckdb.connect()
    for t, key in (("lineitem", "l_suppkey"), ("supplier", "s_suppkey")):
        c.execute(f"copy (select * replace ({key} + k as {key}) from '{tiny}/{t}.parquet', (values (0), (12340), (123400)) v(k)) to '{tmp_path}/{t}.parquet' (format parquet)")
    c.execute(f"copy (from '{tiny}/nation.parquet') to '{tmp_path}/nation.parquet' (format parquet)")
    for t in ("lineitem", "supplier", "nation"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    test_sql(spark, str(tmp_path), c, name)


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_rows(spark, tiny, name):
    assert plans.QUERIES[name](spark, tiny).count() > 0


def test_clouds_are_dealt_out_to_all_tasks(spark, tiny):
    pts = plans.views.points(spark, tiny)
    clouds = each_cloud(pts, lambda c: iter([{"n": np.array([len(c["x"])])}]), StructType([pts.schema["cloud_id"], *StructType.fromDDL("n long").fields]))
    for df in (pts, clouds):  # small shuffles are not joined to one task
        assert df.select(F.spark_partition_id()).distinct().count() > 1


def test_every_sql_has_a_query():
    assert set(plans.SQL) <= set(plans.QUERIES)
