"""Column masks: ``{table: {column: {"replace": {"value": v}}}}`` applied as one projection.

An empty mask shows the value. A column without a mask is shown unless ``default`` masks it.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class MaskError(ValueError):
    pass


def masked(column: Column, mask: Mapping | None) -> Column:
    if not mask:
        return column
    if set(mask) != {"replace"} or not isinstance(mask["replace"], Mapping) or "value" not in mask["replace"]:
        raise MaskError(f"unknown mask {dict(mask)!r}")
    value = mask["replace"]["value"]
    return value if isinstance(value, Column) else F.lit(value)


def _find(masks: Mapping, place: str) -> Mapping | None:
    table, _, column = place.rpartition(".")
    return masks.get(table, {}).get(column)


def apply_masks(df: DataFrame, masks: Mapping[str, Mapping[str, Any]], mapping: Mapping[str, str] | None = None, default: Mapping | None = None, when: Column | None = None) -> DataFrame:
    """Mask ``df``. ``mapping`` says which ``table.column`` a result column shows; without it the column's name decides,
    and a name that several tables mask is left alone with a warning. ``when`` masks only some rows."""
    out = []
    for name in df.columns:
        if mapping is not None:
            mask = _find(masks, mapping[name]) if name in mapping else None
        else:
            found = [m[name] for m in masks.values() if name in m]
            if len(found) > 1:
                warnings.warn(f'cannot guess mask mapping for result column "{name}"', stacklevel=2)
            mask = found[0] if len(found) == 1 else None
        if mask is None:
            mask = default
        own = df[f"`{name}`"]
        new = masked(own, mask)
        if mask and when is not None:
            new = F.when(when, new).otherwise(own)
        out.append(new.cast(df.schema[name].dataType).alias(name) if mask and not isinstance(mask["replace"]["value"], str) else new.alias(name))
    return df.select(*out)
