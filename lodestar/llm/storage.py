"""Tables in the folder that the driver and all executors share.

Cutting lineage with a written table keeps a job alive when executors are lost: a lost task rereads the
table instead of whatever the dead executor held. The folder is the session's ``spark.checkpoint.dir``;
only where that is unset (tests, notebooks) a folder of our own is set.
"""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="lodestar-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base[len("file://") :], ignore_errors=True)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    app = spark.sparkContext.applicationId
    path = f"{shared_dir(spark)}/lodestar/{app}/{label}-{uuid.uuid4().hex[:12]}"
    _written.setdefault(app, []).append(path)
    return path


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 2000) -> Iterator[None]:
    """Arrow batches of whole texts in thousands of rows, so that both sides of the pipe hold megabytes of them only."""
    old = spark.conf.get(BATCH)
    if not 0 < int(old) <= rows:
        spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, old)


def bound_batches(spark: SparkSession, rows: int = 2000) -> None:
    """The same for results that are computed after an operator has returned: the session keeps the smaller size."""
    if not 0 < int(spark.conf.get(BATCH)) <= rows:
        spark.conf.set(BATCH, str(rows))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back; the lineage before it is gone."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete materialized tables that no later plan reads, and let Spark drop the shuffles behind them."""
    spark = None
    for t in tables:
        path = getattr(t, "_lodestar_path", None)
        if path is None:
            continue
        spark = t.sparkSession
        delete(spark, path)
    if spark is not None:
        drop_shuffles(spark)


def drop_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffles of plans that are done."""
    gc.collect()  # plans that only a cycle of Python objects holds
    spark.sparkContext._jvm.System.gc()


def cleanup(spark: SparkSession) -> None:
    """Delete every table that this application's operators have written, results that plans still read included."""
    for path in _written.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def columns(df: DataFrame) -> dict[str, np.ndarray]:
    """A table of bounded size as arrays, by way of Arrow."""
    table = df.toArrow()
    return {name: table.column(name).to_numpy() for name in table.column_names}


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0
