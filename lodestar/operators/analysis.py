"""Batch queries, comparison of two rule sets over the same inputs, and its report."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.values import Undefined, plain
from lodestar.plans.evaluate import ConflictError, Engine
from lodestar.plans.relational import Planner, Table
from lodestar.functions.documents import merge_right


def with_common(inputs: DataFrame, common: dict[str, Column]) -> DataFrame:
    """Inputs with the members of a common input where they have none of their own (the input wins)."""
    have = set(inputs.columns)
    return inputs.select("*", *[v.alias(k) for k, v in common.items() if k not in have]).withColumns({k: F.coalesce(F.col(k), v) for k, v in common.items() if k in have})


def batch_columns(inputs: DataFrame, result: Column, error: Column | None = None) -> DataFrame:
    """Set at a time: each input with ``result`` or, where ``error`` is not null, with the error instead."""
    error = F.lit(None).cast("string") if error is None else error
    out = inputs.withColumn("error", error)
    return out.withColumn("result", F.when(F.col("error").isNull(), result))


def batch_status(results: DataFrame) -> DataFrame:
    """One row: 200 if all inputs went well (or there are none), 500 if none did, 207 otherwise."""
    n = results.agg(F.count("*").alias("total"), F.count("error").alias("failed"))
    return n.select("total", "failed", F.when(F.col("failed") == 0, 200).when(F.col("failed") == F.col("total"), 500).otherwise(207).alias("status"))


def batch_query(engine: Engine, path: str, inputs: dict[str, Any], common: Any = None) -> dict:
    """Documents held by the driver: ``{id: input}`` to ``{id: {"result"} or {"error"}}`` and the status."""
    responses, failed = {}, 0
    for name, own in inputs.items():
        try:
            value = merge_right(common, own) if isinstance(common, dict) and isinstance(own, dict) else own
            responses[name] = {"result": plain(engine.query(path, value))}
        except Undefined:
            responses[name] = {}
        except (ConflictError, ValueError) as e:
            responses[name] = {"error": {"message": str(e)}}
            failed += 1
    status = 200 if not failed else 500 if failed == len(inputs) else 207
    return {"status": status, "responses": responses}


def batch_rules(modules: list[str], path: str, inputs: DataFrame, ids: list[str], tables: Mapping[str, Table | DataFrame] | None = None) -> DataFrame:
    """``inputs`` with result and error of a complete rule: one plan for all rows; a row's error is its own."""
    return Planner(modules, tables or {}).decide(path, inputs, ids, "result", errors="error")


def impact_rules(primary: list[str], secondary: list[str], path: str, inputs: DataFrame, ids: list[str], tables: Mapping[str, Table | DataFrame] | None = None, equals: bool = False) -> DataFrame:
    """Inputs with value_a and value_b of two rule sets where they differ (or all, with ``equals``)."""
    first = Planner(primary, tables or {}).decide(path, inputs, ids, "value_a")
    both = Planner(secondary, tables or {}).decide(path, first, ids, "value_b")
    return both if equals else both.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def sampled(df: DataFrame, rate: float, key: str) -> DataFrame:
    """The same rows on every run: those whose key hashes below the rate."""
    return df if rate >= 1 else df.filter(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(rate * 1_000_000))


def impact(inputs: DataFrame, primary: Callable[[DataFrame], Column], secondary: Callable[[DataFrame], Column], equals: bool = False, rate: float = 1.0, key: str | None = None) -> DataFrame:
    """Inputs with value_a and value_b of two rule sets where they differ (or all, with ``equals``)."""
    df = sampled(inputs, rate, key) if key else inputs
    both = df.select("*", primary(df).alias("value_a"), secondary(df).alias("value_b"))
    return both if equals else both.filter(~F.col("value_a").eqNullSafe(F.col("value_b")))


def impact_report(rows: DataFrame, group: Sequence[str] = ("path",), limit: int | None = None, a: str = "eval_ns_a", b: str = "eval_ns_b") -> DataFrame:
    """Counts and latency statistics (sample deviation and variance) for each group, most frequent first."""
    stats = [
        f(c).alias(f"{n}_{s}")
        for s, c in (("a", a), ("b", b))
        for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max), ("stddev", F.stddev_samp), ("var", F.var_samp))
    ]
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), *stats).orderBy(F.desc("n"), *group)
    return out.limit(limit) if limit is not None else out


def fail_if_any(rows: DataFrame) -> None:
    """Raise if two rule sets differ anywhere."""
    if rows.take(1):
        raise AssertionError(f"{rows.count()} decisions differ")
