"""Tables of a SQL store as documents: key columns are members of the path, other columns are the document below them.

A path is the mount's own path, then a value for each key column, then members inside the document. Keys become filters
that reach the source; a path that stops before the last key gives a row for each document below it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.operators.keyed import upsert
from lodestar.sources.external import bounded


class MountError(ValueError):
    pass


def members(path: str) -> tuple[str, ...]:
    return tuple(p for p in path.split("/") if p)


@dataclass(frozen=True)
class Mount:
    """``values``: path inside the document -> column; the path "" is the whole document. Without it, every column that
    is no key stands under its own name."""

    path: str
    frame: DataFrame
    keys: tuple[str, ...] = ()
    values: Mapping[str, str] | None = None

    def columns(self) -> dict[tuple[str, ...], str]:
        if self.values is None:
            return {(c,): c for c in self.frame.columns if c not in self.keys}
        return {members(p): c for p, c in self.values.items()}

    def document(self, below: tuple[str, ...] = ()) -> Column | None:
        """The part of the document at ``below``: a column, or a struct of the columns under it."""
        found = self.columns()
        for n in range(len(below) + 1):
            if (column := found.get(below[:n])) is not None:  # members beyond a column lie inside its value
                return _inside(F.col(f"`{column}`"), self.frame.schema[column].dataType, below[n:])
        names = list(dict.fromkeys(p[len(below)] for p in found if p[: len(below)] == below))
        return F.struct(*[self.document((*below, n)).alias(n) for n in names]) if names else None

    def where(self, given: Sequence[str]) -> DataFrame:
        df = self.frame
        for c, k in zip(self.keys, given, strict=False):
            df = df.filter(F.col(f"`{c}`") == F.lit(k).try_cast(df.schema[c].dataType))
        return df

    def read(self, rest: Sequence[str]) -> DataFrame:
        """Key columns that ``rest`` does not give, and ``value``; no rows where there is no such document."""
        n = len(self.keys)
        value = self.document(tuple(rest[n:]))
        if value is None:
            raise MountError(f"no column at {'/'.join(rest[n:])} of {self.path}")
        out = self.where(rest[:n]).select(*[F.col(f"`{c}`") for c in self.keys[len(rest) :]], value.alias("value"))
        return out.filter("value IS NOT NULL") if len(rest) > n else out

    def row(self, rest: Sequence[str], document: Any) -> tuple:
        """The row that holds a document; what the document lacks is NULL."""
        if len(rest) != len(self.keys):
            raise MountError(f"a document of {self.path} lies below {len(self.keys)} keys")
        found: dict[str, Any] = dict(zip(self.keys, rest, strict=True))
        for path, column in self.columns().items():
            at = document
            for m in path:
                at = at.get(m) if isinstance(at, Mapping) else None
            found[column] = at
        return tuple(found.get(c) for c in self.frame.columns)

    def written(self, rows: Iterable[tuple[Sequence[str], Any]]) -> Mount:
        """With documents inserted or replaced, each given as (keys, document); the last of one key counts."""
        last = {tuple(map(str, keys)): document for keys, document in rows}
        schema = self.frame.schema
        as_text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in self.keys else T.StructField(f.name, f.dataType) for f in schema])
        new = self.frame.sparkSession.createDataFrame([self.row(k, d) for k, d in last.items()], as_text)
        new = new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])
        return replace(self, frame=upsert(self.frame, new, self.keys))

    def deleted(self, rest: Sequence[str]) -> Mount:
        """Without the document at these keys; fewer keys remove all documents below."""
        if not rest or len(rest) > len(self.keys):
            raise MountError(f"a document of {self.path} lies below {len(self.keys)} keys")
        held = F.lit(True)
        for c, k in zip(self.keys, rest, strict=False):
            held = held & F.col(f"`{c}`").eqNullSafe(F.lit(k).try_cast(self.frame.schema[c].dataType))
        return replace(self, frame=self.frame.filter(~held))


def _inside(value: Column, kind: T.DataType, below: tuple[str, ...]) -> Column | None:
    for m in below:
        if isinstance(kind, T.StructType) and m in kind.names:
            value, kind = value.getField(m), kind[m].dataType
        elif isinstance(kind, T.MapType):
            value, kind = F.try_element_at(value, F.lit(m).try_cast(kind.keyType)), kind.valueType
        elif isinstance(kind, T.ArrayType) and m.isdigit():
            value, kind = F.get(value, F.lit(int(m))), kind.elementType
        else:
            return None
    return value


class Mounts:
    """Several mounts as one tree; none may lie inside another."""

    def __init__(self, mounts: Iterable[Mount] = ()):
        self.held: dict[tuple[str, ...], Mount] = {}
        for m in mounts:
            self.add(m)

    def add(self, mount: Mount) -> None:
        p = members(mount.path)
        for other in self.held:
            if other[: len(p)] == p or p[: len(other)] == other:
                raise MountError(f"{mount.path} overlaps {'/'.join(other)}")
        self.held[p] = mount

    def find(self, path: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(path of the mount, members below it)."""
        p = members(path)
        for n in range(len(p), 0, -1):
            if p[:n] in self.held:
                return p[:n], p[n:]
        raise MountError(f"nothing at {path}")

    def below(self, path: str) -> list[str]:
        """Mounts under a path."""
        p = members(path)
        return sorted("/".join(m) for m in self.held if m[: len(p)] == p)

    def read(self, path: str) -> DataFrame:
        at, rest = self.find(path)
        return self.held[at].read(rest)

    def write(self, path: str, document: Any) -> None:
        at, rest = self.find(path)
        self.held[at] = self.held[at].written([(rest, document)])

    def delete(self, path: str) -> None:
        at, rest = self.find(path)
        self.held[at] = self.held[at].deleted(rest)


def discover(columns: DataFrame, constraints: DataFrame, usage: DataFrame, load: Callable[[str], DataFrame], root: str = "", schema: str = "public") -> Mounts:
    """A mount for each table of a schema, its primary key as path members.

    The first three are a store's ``INFORMATION_SCHEMA`` views COLUMNS, TABLE_CONSTRAINTS and KEY_COLUMN_USAGE (through
    JDBC or as fixtures); ``load`` gives a table's rows by ``schema.table``. A table without a primary key has no key
    members. The catalog's rows come to the driver, up to the bound of ``external``."""
    here = F.col("table_schema") == schema
    lower = lambda df: df.toDF(*map(str.lower, df.columns)).filter(here)
    primary = lower(constraints).filter("constraint_type = 'PRIMARY KEY'").select("table_name", "constraint_name")
    keyed = lower(usage).join(primary, ["table_name", "constraint_name"]).select("table_name", "ordinal_position", "column_name")
    keys: dict[str, list[str]] = {r.table_name: [] for r in bounded(lower(columns).select("table_name").distinct())}
    for r in sorted(bounded(keyed), key=lambda r: (r.table_name, r.ordinal_position)):
        if r.table_name in keys:
            keys[r.table_name].append(r.column_name)
    return Mounts(Mount("/".join((*members(root), name)), load(f"{schema}.{name}"), tuple(k)) for name, k in sorted(keys.items()))
