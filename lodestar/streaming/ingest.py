"""Streams that build keyed state: each micro-batch and the state before give the state after.

``keyed_ingest`` keeps state in versioned Parquet folders and moves a pointer last, so that a batch that is run again
after a failure starts from the same state. ``per_key_ingest`` keeps state for each key in Spark's state store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.operators.keyed import apply_changes, latest_per_key, upsert

Transform = Callable[[DataFrame, DataFrame], DataFrame | None]


def upsert_transform(keys: Sequence[str], order: Sequence[str]) -> Transform:
    """The latest message of each key replaces its row."""
    return lambda incoming, previous: upsert(previous, latest_per_key(incoming, keys, order).select(*previous.columns), keys)


def change_feed_transform(keys: Sequence[str], order: Sequence[str], deleted: Column) -> Transform:
    return lambda incoming, previous: apply_changes(previous, incoming, keys, order, deleted)


def counting_transform(keys: Sequence[str], count: str = "n") -> Transform:
    """A running count for each key."""

    def run(incoming: DataFrame, previous: DataFrame) -> DataFrame:
        both = previous.select(*keys, count).unionByName(incoming.groupBy(*keys).agg(F.count("*").alias(count)))
        return both.groupBy(*keys).agg(F.sum(count).cast("long").alias(count))

    return run


def topics_transform(transforms: Mapping[str, Transform], topic: str = "topic") -> Transform:
    """Several topics into one state, each in a part of its own, named by the column ``topic``.

    A topic's transform sees its messages and its part without that column. Messages of other topics are dropped; parts
    of topics without a transform, or whose transform gives None, stay as they are."""

    def run(incoming: DataFrame, previous: DataFrame) -> DataFrame | None:
        parts, changed = [], []
        for name, transform in transforms.items():
            new = transform(incoming.filter(F.col(topic) == name).drop(topic), previous.filter(F.col(topic) == name).drop(topic))
            if new is not None:
                parts.append(new.withColumn(topic, F.lit(name)).select(*previous.columns))
                changed.append(name)
        if not parts:
            return None
        kept = previous.filter(~F.coalesce(F.col(topic).isin(changed), F.lit(False)))
        return reduce(lambda a, b: a.unionByName(b), parts, kept)

    return run


class StateTable:
    """State by batch id below a shared path; ``current`` is the newest committed version."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), root

    def versions(self) -> list[int]:
        jvm, fs, root = self._fs()
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in names if p.getName().startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def current(self, before: int | None = None) -> DataFrame:
        found = [v for v in self.versions() if before is None or v < before]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={found[-1]}")

    def commit(self, df: DataFrame, version: int, keep: int = 2) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/v={version}")
        jvm, fs, root = self._fs()
        for old in self.versions()[:-keep]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"v={old}"), True)


def keyed_ingest(stream: DataFrame, state: StateTable, transform: Transform, checkpoint: str, trigger: dict | None = None, ready: Callable[[], bool] = lambda: True) -> StreamingQuery:
    """Start a query that folds micro-batches into the state. A transform that gives None leaves the state as it is;
    nothing starts before ``ready``."""
    if not ready():
        raise RuntimeError("the transform is not ready")

    def fold(batch: DataFrame, batch_id: int) -> None:
        new = transform(batch, state.current(before=batch_id))
        if new is not None:
            state.commit(new, batch_id)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def per_key_ingest(stream: DataFrame, key: str, fold: Callable[[pd.DataFrame, tuple | None], tuple], state_schema: str, output_schema: str) -> DataFrame:
    """``fold(rows of a key in this batch, state before)`` gives the state after, which is also the output row."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get if state.exists else None
        for pdf in frames:
            value = fold(pdf, value)
        state.update(value)
        yield pd.DataFrame([(*k, *value)], columns=[f.strip().split()[0] for f in output_schema.split(",")])

    return stream.groupBy(key).applyInPandasWithState(run, output_schema, state_schema, "update", GroupStateTimeout.NoTimeout)
