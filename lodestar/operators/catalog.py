"""A tree of named DataFrames: registration, reads by path, overlays, staged bulk changes, memoised results."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class CatalogError(ValueError):
    pass


def _path(path: str) -> tuple[str, ...]:
    parts = tuple(p for p in path.replace("/", ".").split(".") if p)
    return parts[1:] if parts[:1] == ("data",) else parts


class Catalog:
    """Documents at paths. A path owned by a connector refuses other writers; paths may not contain one another."""

    def __init__(self) -> None:
        self.frames: dict[tuple[str, ...], DataFrame] = {}
        self.owner: dict[tuple[str, ...], str] = {}
        self.listeners: list[Callable[[str, DataFrame | None], None]] = []
        self.version = 0

    def mount(self, path: str, frame: DataFrame, owner: str = "") -> None:
        p = _path(path)
        for other in self.frames:
            if other != p and (other[: len(p)] == p or p[: len(other)] == other):
                raise CatalogError(f"{path} overlaps {'.'.join(other)}")
        if self.owner.get(p, owner) != owner:
            raise CatalogError(f"{path} belongs to {self.owner[p]}")
        self.frames[p] = frame
        if owner:
            self.owner[p] = owner
        self._changed(path, frame)

    def remove(self, path: str, owner: str = "") -> None:
        p = _path(path)
        if p not in self.frames:
            raise CatalogError(f"nothing at {path}")
        if self.owner.get(p, owner) != owner:
            raise CatalogError(f"{path} belongs to {self.owner[p]}")
        del self.frames[p]
        self.owner.pop(p, None)
        self._changed(path, None)

    def read(self, path: str, keys: Sequence[Any] = (), key_columns: Sequence[str] = ()) -> DataFrame:
        """The table at a path; further path members select by key columns (a filter that reaches the source)."""
        p = _path(path)
        if p not in self.frames:
            raise CatalogError(f"nothing at {path}")
        df = self.frames[p]
        for c, k in zip(key_columns, keys, strict=False):
            df = df.filter(F.col(c) == F.lit(k))
        return df

    def paths(self) -> list[str]:
        return sorted(".".join(p) for p in self.frames)

    def on_change(self, listener: Callable[[str, DataFrame | None], None]) -> None:
        self.listeners.append(listener)

    def _changed(self, path: str, frame: DataFrame | None) -> None:
        self.version += 1
        for f in self.listeners:
            f(".".join(_path(path)), frame)

    def register_views(self) -> None:
        """A temporary view ``data_<path>`` for each table, for SQL."""
        for p, df in self.frames.items():
            df.createOrReplaceTempView("data_" + "_".join(p))

    def bulk(self, writes: Sequence[tuple], reads: Sequence[str] = (), parallel_errors: bool = True) -> dict:
        """Writes ("create"|"update"|"delete", path[, frame]) in order, all or none; then reads, each with its own
        result or error."""
        staged = Catalog()
        staged.frames, staged.owner = dict(self.frames), dict(self.owner)
        for kind, path, *rest in writes:
            exists = _path(path) in staged.frames
            if kind == "create" and exists:
                raise CatalogError(f"{path} exists")
            if kind in ("update", "delete") and not exists:
                raise CatalogError(f"nothing at {path}")
            if kind == "delete":
                staged.remove(path)
            elif kind in ("create", "update"):
                staged.mount(path, rest[0])
            else:
                raise CatalogError(f"unknown write {kind}")
        changed = {p for p in self.frames.keys() | staged.frames.keys() if self.frames.get(p) is not staged.frames.get(p)}
        self.frames, self.owner = staged.frames, staged.owner
        for p in changed:
            self._changed(".".join(p), self.frames.get(p))
        out: list[dict] = []
        for path in reads:
            try:
                out.append({"result": self.read(path)})
            except CatalogError as e:
                if not parallel_errors:
                    raise
                out.append({"error": str(e)})
        return {"reads": out}


def overlay_point(base: DataFrame, overlay: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Point reads: the overlay's value where it has the key and a value, else the base's."""
    rest = [c for c in base.columns if c not in keys]
    o = overlay.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in rest])
    joined = base.join(o, list(keys), "left")
    return joined.select(*keys, *[F.coalesce(F.col(f"_o_{c}"), F.col(c)).alias(c) for c in rest]).select(*base.columns)


def overlay_all(base: DataFrame, overlay: DataFrame, keys: Sequence[str], deduplicate: bool = True) -> DataFrame:
    """All rows seen through an overlay: its rows shadow base rows of the same key (or, without ``deduplicate``, both
    are listed)."""
    if not deduplicate:
        return overlay.unionByName(base)
    return overlay.unionByName(base.join(overlay.select(*keys).distinct(), list(keys), "left_anti"))


class Memo:
    """Results by request, for a time. Errors are kept as well if ``errors``."""

    def __init__(self, seconds: float = 60.0, errors: bool = False, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.errors, self.clock = seconds, errors, clock
        self.held: dict[str, tuple[float, Any, Exception | None]] = {}
        self.hits = 0

    def get(self, request: Any, compute: Callable[[], Any]) -> Any:
        key = json.dumps(request, sort_keys=True, default=str)
        if key in self.held and self.clock() - self.held[key][0] < self.seconds:
            self.hits += 1
            _, value, error = self.held[key]
            if error is not None:
                raise error
            return value
        try:
            value = compute()
        except Exception as e:
            if self.errors:
                self.held[key] = (self.clock(), None, e)
            raise
        self.held[key] = (self.clock(), value, None)
        return value
