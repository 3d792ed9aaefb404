"""Condition trees: the filter algebra between rules and data.

A tree arrives as nested dicts, expanded (``type``/``operator``/``field``/``value``) or concise
(``{"a": {"lt": 2}, "or": [...]}``), and leaves as a Spark ``Column`` or as a SQL ``WHERE`` text. Columns are built
from native expressions only, so filters reach the scan. SQL's three-valued logic holds in both forms.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARISONS: dict[str, tuple[str, Callable]] = {
    "eq": ("=", operator.eq),
    "ne": ("<>", operator.ne),
    "gt": (">", operator.gt),
    "lt": ("<", operator.lt),
    "gte": (">=", operator.ge),
    "lte": ("<=", operator.le),
}
SYNONYMS = {"ge": "gte", "le": "lte"}
MEMBERSHIP = ("in", "nin")
STRINGS = ("startswith", "endswith", "contains")
COMPOUND = ("and", "or", "not")
MIRRORED = {"lt": "gt", "gt": "lt", "lte": "gte", "gte": "lte", "eq": "eq", "ne": "ne"}
DIALECTS = ("mysql", "sqlite", "sqlite-internal", "postgres", "postgresql", "sqlserver")


class ConditionError(ValueError):
    """A tree that no backend can express."""


@dataclass(frozen=True)
class FieldRef:
    """The other column of a column-to-column comparison."""

    field: str


class Condition:
    """Base of all nodes; combine with ``&``, ``|`` and ``~``."""

    def __and__(self, other: Condition) -> Condition:
        return all_of([self, other])

    def __or__(self, other: Condition) -> Condition:
        return any_of([self, other])

    def __invert__(self) -> Condition:
        return negate(self)

    def where(self, df: DataFrame, resolve: Callable[[str], Column] | None = None) -> DataFrame:
        return df.filter(self.column(resolve))

    def column(self, resolve: Callable[[str], Column] | None = None) -> Column:
        raise NotImplementedError

    def sql(self, dialect: str = "sqlite") -> str:
        raise NotImplementedError

    def to_dict(self) -> dict:
        raise NotImplementedError

    def rename(self, name: Callable[[str], str]) -> Condition:
        raise NotImplementedError

    def fields(self) -> set[str]:
        raise NotImplementedError


@dataclass(frozen=True)
class Always(Condition):
    """A decision that needs no data: every row, or none."""

    value: bool

    def column(self, resolve=None) -> Column:
        return F.lit(self.value)

    def sql(self, dialect="sqlite") -> str:
        return "" if self.value else "1 = 0"

    def to_dict(self) -> dict:
        return {} if self.value else {"type": "compound", "operator": "or", "value": []}

    def rename(self, name):
        return self

    def fields(self):
        return set()


@dataclass(frozen=True)
class Field(Condition):
    op: str
    field: str
    value: Any

    def column(self, resolve=None) -> Column:
        get = resolve or F.col
        c, v = get(self.field), self.value
        if v is None:
            return c.isNull() if self.op == "eq" else c.isNotNull()
        if self.op in MEMBERSHIP:
            inside = c.isin(list(v)) if len(v) else (F.lit(False) & c.isNotNull())
            return inside if self.op == "in" else ~inside
        v = get(v.field) if isinstance(v, FieldRef) else v
        if self.op in STRINGS:
            return getattr(c, self.op)(v)
        return COMPARISONS[self.op][1](c, v if isinstance(v, Column) else F.lit(v))

    def sql(self, dialect="sqlite") -> str:
        f, v = self.field, self.value
        if v is None:
            return f"{f} IS NULL" if self.op == "eq" else f"{f} IS NOT NULL"
        if self.op in MEMBERSHIP:
            listed = ", ".join(quote(x, dialect) for x in v)
            if not v:
                return "1 = 0" if self.op == "in" else "1 = 1"
            return f"{f} {'IN' if self.op == 'in' else 'NOT IN'} ({listed})"
        if self.op in STRINGS:
            if dialect == "sqlite-internal":
                return f"internal_{self.op}({f}, {v.field if isinstance(v, FieldRef) else quote(v, dialect)})"
            if isinstance(v, FieldRef):
                raise ConditionError(f"'{self.op}' needs a constant string")
            before, after = {"startswith": ("", "%"), "endswith": ("%", ""), "contains": ("%", "%")}[self.op]
            return f"{f} LIKE {quote(before + escape_like(v) + after, dialect)}"
        return f"{f} {COMPARISONS[self.op][0]} {v.field if isinstance(v, FieldRef) else quote(v, dialect)}"

    def to_dict(self) -> dict:
        v = {"field": self.value.field} if isinstance(self.value, FieldRef) else list(self.value) if self.op in MEMBERSHIP else self.value
        return {"type": "field", "operator": self.op, "field": self.field, "value": v}

    def rename(self, name):
        v = FieldRef(name(self.value.field)) if isinstance(self.value, FieldRef) else self.value
        return replace(self, field=name(self.field), value=v)

    def fields(self):
        return {self.field} | ({self.value.field} if isinstance(self.value, FieldRef) else set())


@dataclass(frozen=True)
class Compound(Condition):
    op: str
    parts: tuple[Condition, ...]

    def column(self, resolve=None) -> Column:
        cols = [p.column(resolve) for p in self.parts]
        if self.op == "not":
            return ~cols[0]
        if not cols:
            return F.lit(self.op == "and")
        return reduce(operator.and_ if self.op == "and" else operator.or_, cols)

    def sql(self, dialect="sqlite") -> str:
        if self.op == "not":
            return f"NOT {self.parts[0].sql(dialect)}"
        if not self.parts:
            return "1 = 1" if self.op == "and" else "1 = 0"
        texts = [p.sql(dialect) for p in self.parts]
        return texts[0] if len(texts) == 1 else "(" + f" {self.op.upper()} ".join(texts) + ")"

    def to_dict(self) -> dict:
        return {"type": "compound", "operator": self.op, "value": [p.to_dict() for p in self.parts]}

    def rename(self, name):
        return replace(self, parts=tuple(p.rename(name) for p in self.parts))

    def fields(self):
        return set().union(*(p.fields() for p in self.parts))


def all_of(parts: Sequence[Condition]) -> Condition:
    parts = [p for p in parts if p != Always(True)]
    if Always(False) in parts:
        return Always(False)
    return Always(True) if not parts else parts[0] if len(parts) == 1 else Compound("and", tuple(parts))


def any_of(parts: Sequence[Condition]) -> Condition:
    parts = list(dict.fromkeys(p for p in parts if p != Always(False))) if all(_hashable(p) for p in parts) else [p for p in parts if p != Always(False)]
    if Always(True) in parts:
        return Always(True)
    return Always(False) if not parts else parts[0] if len(parts) == 1 else Compound("or", tuple(parts))


def negate(part: Condition) -> Condition:
    return Always(not part.value) if isinstance(part, Always) else Compound("not", (part,))


def _hashable(p: Condition) -> bool:
    try:
        hash(p)
    except TypeError:
        return False
    return True


def parse(tree: Mapping | Condition) -> Condition | None:
    """A condition from an expanded or concise tree. A field node without a value is no condition (None); null and
    unknown operators where they make no sense raise :class:`ConditionError`."""
    if isinstance(tree, Condition):
        return tree
    if not isinstance(tree, Mapping):
        raise ConditionError(f"a condition must be an object, not {type(tree).__name__}")
    return _expanded(tree) if "operator" in tree and "type" in tree else _concise(tree)


def _expanded(tree: Mapping) -> Condition | None:
    kind, op = tree["type"], SYNONYMS.get(tree["operator"], tree["operator"])
    if kind == "compound":
        if op not in COMPOUND:
            raise ConditionError(f"unexpected compound operator '{op}'")
        value = tree.get("value")
        if not isinstance(value, list | tuple):
            raise ConditionError(f"'{op}' needs an array of conditions")
        parts = [p for p in map(parse, value) if p is not None]
        if op == "not":
            if len(parts) != 1:
                raise ConditionError("'not' needs exactly one condition")
            return Compound("not", (parts[0],))
        return Compound(op, tuple(parts))
    if kind == "document" and op == "exists":
        return Field("ne", tree["field"], None)
    if kind != "field":
        raise ConditionError(f"unexpected node type '{kind}'")
    return _field(op, tree["field"], tree["value"]) if "value" in tree else None


def _field(op: str, field: str, value: Any) -> Condition:
    op = SYNONYMS.get(op, op)
    if op not in (*COMPARISONS, *MEMBERSHIP, *STRINGS):
        raise ConditionError(f"unexpected field operator '{op}'")
    if isinstance(value, Mapping):
        if set(value) != {"field"}:
            raise ConditionError(f"'{op}' can't compare with an object")
        value = FieldRef(value["field"])
    if value is None and op not in ("eq", "ne"):
        raise ConditionError("null value can only be used with 'eq' or 'ne'")
    if op in MEMBERSHIP:
        if not isinstance(value, list | tuple | set | frozenset):
            raise ConditionError(f"'{op}' needs an array")
        return Field(op, field, tuple(value))
    if isinstance(value, list | tuple):
        raise ConditionError(f"'{op}' can't compare with an array")
    if op in STRINGS and not isinstance(value, str | FieldRef):
        raise ConditionError(f"'{op}' needs a string")
    return Field(op, field, value)


def _concise(tree: Mapping) -> Condition:
    parts: list[Condition] = []
    for key, value in tree.items():
        if key in COMPOUND:
            items = value if isinstance(value, list | tuple) else [value]
            inner = [p for p in map(parse, items) if p is not None]
            if key == "not":
                if len(inner) != 1:
                    raise ConditionError("'not' needs exactly one condition")
                parts.append(Compound("not", tuple(inner)))
            else:
                parts.append(Compound(key, tuple(inner)))
        elif isinstance(value, Mapping) and set(value) != {"field"}:
            parts += [_field(op, key, v) for op, v in value.items()]
        elif isinstance(value, list | tuple):
            parts.append(_field("in", key, value))
        else:
            parts.append(_field("eq", key, value))
    return parts[0] if len(parts) == 1 else Compound("and", tuple(parts))


def where_clause(condition: Condition | None, dialect: str = "sqlite") -> str:
    """``WHERE ...``, or an empty text for no condition or an unconditional yes."""
    text = condition.sql(dialect) if condition is not None else ""
    return f"WHERE {text}" if text else ""


def escape_like(text: str) -> str:
    return text.replace("\\", "\\\\").replace("_", "\\_").replace("%", "\\%")


def quote(value: Any, dialect: str) -> str:
    """A literal of the dialect."""
    if isinstance(value, bool):
        return ("1" if value else "0") if dialect == "sqlserver" else ("TRUE" if value else "FALSE")
    if value is None:
        return "NULL"
    if isinstance(value, int | float):
        if isinstance(value, float) and not math.isfinite(value):
            raise ConditionError("numbers must be finite")
        return repr(value)
    if not isinstance(value, str):
        raise ConditionError(f"a {type(value).__name__} can't be a SQL literal")
    if dialect in ("postgres", "postgresql"):
        return "E'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if dialect == "mysql":
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return ("N'" if dialect == "sqlserver" else "'") + value.replace("'", "''") + "'"


def name_mapping(mapping: Mapping[str, Any], shorts: Mapping[str, str] | None = None) -> Callable[[str], str]:
    """Field renaming from ``{table: {"$self": new_table, column: new_column}}`` and short names of tables.

    ``{"$table": short}`` under a table says how the rule calls it."""
    calls = dict(shorts or {})
    calls |= {spec["$table"]: table for table, spec in mapping.items() if isinstance(spec, Mapping) and "$table" in spec}

    def rename(field: str) -> str:
        table, _, column = field.rpartition(".")
        table = calls.get(table, table)
        spec = mapping.get(table, {})
        if isinstance(spec, str):
            spec = {"$self": spec}
        new_table, new_column = spec.get("$self", table), spec.get(column, column)
        return f"{new_table}.{new_column}" if new_table else new_column

    return rename


def filter_in(df: DataFrame, column: str, values: Sequence, inline: int = 1000, broadcast: int = 1_000_000) -> DataFrame:
    """Rows whose column is in ``values``: an ``IN`` list while that is short, else a semi-join that is broadcast only
    up to a counted size."""
    if len(values) <= inline:
        return df.filter(F.col(column).isin(list(values)))
    kind = df.schema[column].dataType
    side = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(values)], f"{column} {kind.simpleString()}")
    return df.join(F.broadcast(side) if len(values) <= broadcast else side, column, "left_semi")
