"""Decision events: drop, mask, deliver.

A drop rule is a column. Masks name parts of an event by pointer, below ``input``, ``result`` or ``nd_builtin_cache``:
``remove`` deletes, ``upsert`` sets; the pointers that applied are listed in ``erased`` and ``masked``. A target that is
not there is left alone; an unknown operation is an error. Paths into typed structs become one projection; events kept
as JSON text go through Arrow.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf
from pyspark.sql.streaming import StreamingQuery

from lodestar.functions.documents import PointerError, extract, parse_pointer, patch
from lodestar.sources.sinks import Sink

ROOTS = ("input", "result", "nd_builtin_cache")


class MaskRuleError(ValueError):
    pass


def normalise(mask: str | dict) -> dict:
    """A text means removal."""
    mask = {"op": "remove", "path": mask} if isinstance(mask, str) else mask
    if mask.get("op") not in ("remove", "upsert"):
        raise MaskRuleError(f"unknown operation {mask.get('op')!r}")
    path = parse_pointer(mask["path"])
    if not path or path[0] not in ROOTS:
        raise MaskRuleError(f"masks apply below {', '.join(ROOTS)}")
    return mask


def mask_event(event: dict, masks: Sequence[str | dict]) -> dict:
    """One event as a document."""
    erased, masked = list(event.get("erased", [])), list(event.get("masked", []))
    for m in map(normalise, masks):
        path = parse_pointer(m["path"])
        try:
            if m["op"] == "remove":
                extract(event, path)
                event = {k: v for k, v in event.items() if k != path[0]} if len(path) == 1 else patch(event, [{"op": "remove", "path": m["path"]}])
                erased.append(m["path"])
            else:
                parent = extract(event, path[:-1])
                if len(path) == 1 and path[0] not in event:
                    continue
                if isinstance(parent, list):
                    extract(parent, path[-1:])
                event = patch(event, [{"op": "replace" if isinstance(parent, list) else "add", "path": m["path"], "value": m["value"]}])
                masked.append(m["path"])
        except PointerError:
            continue
    return event | ({"erased": erased} if erased else {}) | ({"masked": masked} if masked else {})


def mask_json(event: Column, masks: Sequence[str | dict]) -> Column:
    """Events as JSON text; bad texts become NULL."""
    checked = [normalise(m) for m in masks]

    @pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str) -> str | None:
            try:
                return json.dumps(mask_event(json.loads(t), checked), separators=(",", ":"), sort_keys=True)
            except ValueError:
                return None

        return texts.map(one, na_action="ignore")

    return run(event)


def _has(kind: T.DataType, path: list[str]) -> bool:
    for p in path:
        if not isinstance(kind, T.StructType) or p not in kind.names:
            return False
        kind = kind[p].dataType
    return True


def mask_structs(df: DataFrame, masks: Sequence[str | dict], when: Column | None = None) -> DataFrame:
    """Typed events: removal drops the field from the struct (or nulls it where ``when`` says which rows), upsert
    replaces it."""
    erased: list[Column] = []
    masked: list[Column] = []
    for m in map(normalise, masks):
        path = parse_pointer(m["path"])
        root, rest = path[0], path[1:]
        if not _has(df.schema, path[:-1]) or (m["op"] == "remove" and not _has(df.schema, path)) or (not rest and root not in df.columns):
            continue
        hit = F.lit(m["path"]) if when is None else F.when(when, F.lit(m["path"]))
        (erased if m["op"] == "remove" else masked).append(hit)
        if m["op"] == "remove" and when is None:
            df = df.withColumn(root, F.col(root).dropFields(".".join(f"`{p}`" for p in rest))) if rest else df.drop(root)
            continue
        value = F.lit(m.get("value"))
        if m["op"] == "remove" or (when is not None and _has(df.schema, path)):
            old = F.col(root)
            for p in rest:
                old = old[p]
            value = F.when(when, value).otherwise(old) if when is not None else value
        df = df.withColumn(root, F.col(root).withField(".".join(f"`{p}`" for p in rest), value) if rest else value)
    listed = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return df.withColumns({"erased": listed(erased), "masked": listed(masked)})


def process(df: DataFrame, drop: Column | None = None, masks: Sequence[str | dict] = ()) -> DataFrame:
    """Drop first, then mask."""
    kept = df if drop is None else df.filter(~F.coalesce(drop, F.lit(False)))
    return mask_structs(kept, masks) if masks else kept


def deliver(stream: DataFrame, sink: Sink, checkpoint: str, drop: Column | None = None, masks: Sequence[str | dict] = (), trigger: dict | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Run the pipeline over a stream. Batches are delivered at least once; the checkpoint is the buffer."""

    def run(batch: DataFrame, batch_id: int) -> None:
        out = process(batch, drop, masks)
        sink(prepare(out) if prepare else out, batch_id)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event(decision_id: Column, timestamp: Column, input: Column, result: Column, labels: dict[str, Any] | None = None) -> Column:
    """An event as a struct."""
    return F.struct(decision_id.alias("decision_id"), F.struct(*[F.lit(v).alias(k) for k, v in (labels or {"id": "lodestar"}).items()]).alias("labels"), timestamp.alias("timestamp"), input.alias("input"), result.alias("result"))
