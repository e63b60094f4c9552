"""Making the package importable in Python workers, whatever the working directory."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()
#: Paths of the tables made in each open ``scratch`` of this thread, the innermost last.
_open: ContextVar[tuple[list[str], ...]] = ContextVar("open", default=())


def on_path() -> None:
    """Workers inherit PYTHONPATH; set before the session starts, it is enough in local mode."""
    paths = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT.parent) not in paths:
        os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT.parent), *filter(None, paths)])


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source once per application, so that executors elsewhere can import it."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), f"{ROOT.name}.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent))
        sc.addPyFile(path)
        _sent.add(sc.applicationId)
    return spark


#: Rows that a task gets at most where their number is known, so that its memory doesn't grow with the input.
TASK_ROWS = 200_000


def tasks(spark: SparkSession, rows: int = 0) -> int:
    """The session's number of shuffle partitions, more if that leaves over ``TASK_ROWS`` of ``rows`` to each. Stated in ``repartition`` it
    holds: tasks aren't joined by their compressed size.
    """
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


#: Bytes of a batch that goes to a Python worker; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def lean(spark: SparkSession) -> None:
    """From now on batches of this session hold at most ``BATCH_BYTES``, less if the user said so: texts are on both sides of a batch, and
    workers and executors keep what they once needed.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where the session has none, a temporary one is set in local mode (tests);
    on a cluster that is an error, as executors and driver don't share their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: cuts the lineage, and a lost executor loses nothing.

    Tables stay until ``clear``, as results may read them. Within ``scratch`` they go with it, unless ``keep`` hands one to
    whatever is around that.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    around = _open.get()[:-1] if keep else _open.get()
    if around:
        around[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(table: DataFrame) -> None:
    """Removes one table that ``written`` has made, and that nothing reads any more."""
    found = table.inputFiles()
    if found and "/tables-" in found[0]:
        _remove(table.sparkSession, found[0].rpartition("/")[0])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end; what is read later has to be written with ``keep``."""
    made: list[str] = []
    token = _open.set((*_open.get(), made))
    try:
        yield
    finally:
        _open.reset(token)
        for path in made:
            _remove(spark, path)


def clear(spark: SparkSession) -> None:
    """Removes the tables that ``written`` has made in this application; results that read them must be saved before."""
    _remove(spark, f"{shared_root(spark)}/tables-{spark.sparkContext.applicationId}")
