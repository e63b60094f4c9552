"""What the operators of this subpackage share: written tables, held-out rows, bounded label samples."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import lean, scratch, shared_root, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id as text leaves ``remainder``. A null id is held out: it never trains a model."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, modulus: int, remainder: int) -> DataFrame:
    """(id, text, label) of at most ``max_rows`` labelled rows that are not held out, chosen by the hash of the id.

    The ids are at most ``max_rows``, so their broadcast is bounded; the texts come from one scan of ``docs``.
    An id with several labels or texts takes the smallest, so that the sample stays as small however often a row is repeated.
    """
    ids = (
        labels.filter(~held_out(id_col, modulus, remainder) & F.col(label_col).isNotNull())
        .groupBy(id_col).agg(F.min(label_col).cast("int").alias("label"))
        .orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    )
    texts = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(ids), id_col).groupBy(id_col).agg(F.min("text").alias("text"), F.min("label").alias("label"))


def heavy_join(rows: DataFrame, facts: DataFrame, key: str, n_col: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``facts`` (one row a key; null where it has none), whatever a key's share of the rows.

    ``n_col`` of ``facts`` counts a key's rows of ``total``. Keys with over a thousandth of them, fewer than a thousand keys, are
    broadcast; the others, none of them hot, are joined by a shuffle, and rows with a null key go past both.
    """
    more = [c for c in facts.columns if c not in (key, n_col)]
    heavy = facts.filter(F.col(n_col) * 1000 > total).select(key, *more, F.lit(True).alias("__met"))
    light = facts.filter(F.col(n_col) * 1000 <= total).select(key, *more)
    at = rows.join(F.broadcast(heavy), key, "left")
    past = F.coalesce(F.col(key).isNull() | F.col("__met"), F.lit(False))
    return at.filter(past).drop("__met").unionByName(at.filter(~past).drop("__met", *more).join(light, key, "left"))


def small(table: DataFrame, rows: int = 500_000) -> DataFrame:
    """A written table of few short columns, to be broadcast if it has at most ``rows`` rows; a larger one is joined by a shuffle."""
    return F.broadcast(table) if table.count() <= rows else table


def pieces(texts: list, limit: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` with about ``limit`` characters each (one text at least), so that arrays stay bounded."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > limit:
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if start < len(texts):
        yield start, len(texts)


def batches(it: Iterable, *cols: str) -> Iterator[tuple[list, ...]]:
    """The named columns of each Arrow batch as lists."""
    for b in it:
        yield tuple(b.column(c).to_pylist() for c in cols)
