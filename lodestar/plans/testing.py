"""Try a filter rule on rows: build tables, compile the rule, run a SELECT through it, apply the masks."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.plans.conditions import Always
from lodestar.plans.evaluate import Engine, compile_filter
from lodestar.plans.masks import apply_masks


def filter_rows(
    spark: SparkSession, engine: Engine, rule: str, select: str, tables: Mapping[str, DataFrame | Sequence[Mapping[str, Any]]], input: Any = None,
    mappings: Mapping | None = None, masking: Mapping[str, str] | None = None, unknowns: list[str] | None = None,
) -> DataFrame:
    """The rows of ``select`` that the rule lets through, masked by its mask rule.

    The condition goes into the SELECT itself (joined with AND to a WHERE that it has), so that Spark pushes it into
    the tables. An unconditional yes adds nothing."""
    for name, rows in tables.items():
        df = rows if isinstance(rows, DataFrame) else spark.createDataFrame([dict(r) for r in rows])
        df.createOrReplaceTempView(name)
    got = compile_filter(engine, rule, input, ("spark", "all"), unknowns, mappings)
    condition = got.get("query", Always(False))
    text = condition.sql("sqlite") if condition != Always(True) else ""
    if re.search(r"\blike\s+'", text, re.I):  # LIKE needs the dialect's escapes: filter by column instead
        text = ""
        out = _by_column(spark, select, condition)
    else:
        out = spark.sql(with_where(select, text))
    return apply_masks(out, got["masks"], masking) if got.get("masks") else out


def with_where(select: str, text: str) -> str:
    if not text:
        return select
    m = re.search(r"\bwhere\b", select, re.I)
    tail = re.search(r"\b(group\s+by|order\s+by|limit)\b", select, re.I)
    end = tail.start() if tail else len(select)
    head, rest = select[:end].rstrip(), select[end:]
    if m and m.start() < end:
        return f"{select[: m.end()]} ({head[m.end() :].strip()}) AND ({text}) {rest}".rstrip()
    return f"{head} WHERE {text} {rest}".rstrip()


def _by_column(spark: SparkSession, select: str, condition: Any) -> DataFrame:
    """Filter on columns that the SELECT does not show: they are added, used and dropped."""
    fields = sorted(condition.fields())
    names = {f: f"_f{i}" for i, f in enumerate(fields)}
    added = ", ".join(f"{f} AS {n}" for f, n in names.items())
    df = spark.sql(re.sub(r"\bfrom\b", f", {added} FROM", select, count=1, flags=re.I))
    return df.filter(condition.column(lambda f: F.col(names[f]))).drop(*names.values())
