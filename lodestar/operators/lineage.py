"""Running long plans safely: lineage cut in the folder that all executors share, and limits on time."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: below ``spark.checkpoint.dir``, or below a folder of our own where that is unset."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="lodestar-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
        context.setCheckpointDir(base)
    return df.checkpoint()


def limited(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """Run an action; its Spark jobs are cancelled and ``TimeoutError`` is raised if it takes longer."""
    group, out, errors = f"limited-{uuid.uuid4().hex}", [], []
    context = spark.sparkContext

    def run() -> None:
        context.setJobGroup(group, "limited", interruptOnCancel=True)
        try:
            out.append(action())
        except Exception as e:  # noqa: BLE001 - handed to the caller
            errors.append(e)

    thread: threading.Thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if thread.is_alive():
        context.cancelJobGroup(group)
        thread.join(10)
        raise TimeoutError(f"took longer than {seconds} s")
    if errors:
        raise errors[0]
    return out[0]
