"""Keeping a sampled corpus up to date: new point files are sampled as they arrive, and clouds that are done are skipped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.catalog import pending


def sample_new(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str, sample: Callable[[DataFrame], DataFrame]):
    """A streaming query that reads Parquet points arriving in ``source`` and appends ``sample`` of clouds not yet in ``target``.

    A cloud arrives in one batch. A batch that is run again after a failure finds its clouds done or writes them, never both.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        try:
            done = spark.read.parquet(target).select("cloud_id")
        except Exception as e:  # nothing was written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            done = spark.createDataFrame([], batch.select("cloud_id").schema)
        sample(pending(batch, done)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
