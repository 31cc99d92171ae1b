"""Access to the corpus tables and to the cluster's shared folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Paths below the shared folder that this process has written.
_PATHS: list[str] = []
_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def let_workers_import(spark: SparkSession) -> None:
    """Puts this package's folder on the Python workers' path, for drivers that import it from a path of their own."""
    environment = spark.sparkContext.environment
    known = os.environ.get("PYTHONPATH", "").split(os.pathsep) + environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [_ROOT, environment.get("PYTHONPATH", "")]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. A session without one gets a temporary folder if it runs in this process alone (as
    tests do); on a cluster, whose executors could not see that folder, it raises."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = conf or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    _PATHS.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _PATHS[-1]


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded(df: DataFrame, rows: int) -> DataFrame | None:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else None: the caller then shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def discard_scratch(spark: SparkSession, since: int = 0, to: int | None = None) -> None:
    """Deletes what this process has written below the shared folder, from the ``since``-th path up to the ``to``-th. Call it when
    results that read from there have been written themselves; until then lost executors may need the tables again."""
    for name in _PATHS[since:to]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    del _PATHS[since:to]


def scratch_mark() -> int:
    """How many scratch paths there are, for ``discard_scratch``."""
    return len(_PATHS)


def with_text(docs: DataFrame, *columns: str) -> DataFrame:
    """The wanted columns of ``docs`` alone (extra columns never clash), with a text that is never null."""
    let_workers_import(docs.sparkSession)
    return docs.select(*[F.col(c) for c in columns], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


@contextmanager
def small_batches(spark: SparkSession, size: str) -> Iterator[None]:
    """What is executed inside sends Python batches of some ``size`` at most (one row more). By default a batch may be 64 MB, which an
    executor holds in its JVM, while it grows twice, and in Python as well, for every task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


LONG = T.LongType()


def drop_finished_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove shuffle files of finished queries now, not at some later collection of the driver's garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()
