"""Rules over tables as DataFrame plans: set at a time, for all inputs together.

A body is a chain of steps on one DataFrame. Iterating a table is a join, whose conditions are the comparisons that
follow (Catalyst turns them into hash or merge joins and pushes the rest into the scans); iterating an array or map
column is an explode; comparisons filter; ``not`` over a table or rule is an anti-join, ``in`` a semi-join; several
bodies are a union; sets are distinct rows. Two tables that only an inequality compares are made distinct before they are
paired, and totals of their pairs need no pairs. A body fails where a term is undefined, so that NULL conditions drop rows
and ``not`` holds for them. A comprehension over tables runs once for all rows, grouped by the outer values it uses.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, is_dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.scalar import COLUMNS, type_name
from lodestar.plans.rules import Call, Collection, Comprehension, Const, Literal, Module, Ref, Rule, Var, parse_module
from lodestar.plans.targets import FragmentError


@dataclass(frozen=True)
class Table:
    """A table at a data path. ``key``: the column that ``data.t[k]`` looks up."""

    frame: DataFrame
    key: str | None = None


@dataclass(frozen=True)
class Step:
    """``kinds``: types of variables that stand for array elements inside an expression. ``unit``: the one row without
    columns that a body begins with; the first table takes its place. ``order``: keys of the tables iterated so far."""

    df: DataFrame
    env: Mapping[str, Column] = field(default_factory=dict)
    kinds: Mapping[str, T.DataType] = field(default_factory=dict)
    unit: bool = False
    order: tuple[Column, ...] = ()

    def bind(self, name: str, value: Column, kind: T.DataType | None = None) -> Step:
        return replace(self, env={**self.env, name: value}, kinds={**self.kinds, name: kind} if kind else self.kinds)

    def kind_of(self, column: Column) -> T.DataType:
        return self.df.select(column).schema[0].dataType


@dataclass(frozen=True)
class Compared:
    """Two tables that one inequality compares: the rows of each, distinct in its own part of the head, with the value
    (column ``_v``) that compares best. ``op``: how the second table's value relates to the first's."""

    sides: tuple[DataFrame, DataFrame]
    names: tuple[list[str], list[str]]
    op: str


def _distinct(rows: DataFrame) -> DataFrame:
    """Distinct rows; maps can be grouped but not deduplicated."""
    if any(isinstance(f.dataType, T.MapType) for f in rows.schema):
        return rows.groupBy(*rows.columns).agg(F.lit(1).alias("_n")).drop("_n")
    return rows.distinct()


def _holds(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


#: Types of columns that each predicate holds for.
IS_KIND = {
    "is_string": (T.StringType,), "is_number": (T.NumericType,), "is_boolean": (T.BooleanType,), "is_null": (T.NullType,),
    "is_array": (T.ArrayType,), "is_set": (T.ArrayType,), "is_object": (T.StructType, T.MapType),
}

#: Inequalities, and the same with their sides exchanged.
EXCHANGED = {"lt": "gt", "lte": "gte", "gt": "lt", "gte": "lte"}

#: The pairs of two tables are made in at least so many tasks, whatever the size of the tables.
PAIR_TASKS = 64

#: Totals over an order run in ranges of about so many distinct values.
RANGE_VALUES = 50_000

#: Aggregates of a comprehension over tables, with their value over nothing.
TOTALS = {"count": (F.count, 0), "sum": (F.sum, 0), "product": (F.product, 1), "max": (F.max, None), "min": (F.min, None)}


class Planner:
    """``functions``: further functions over columns by name; a dotted path below ``data`` (``data.geo.near``) is called
    by that path or through an import of it."""

    def __init__(self, modules: list[str | Module], tables: Mapping[str, Table | DataFrame], functions: Mapping[str, Callable[..., Column]] | None = None):
        self.functions = dict(functions or {})
        self.rules: dict[str, list[Rule]] = {}
        self.home: dict[int, Module] = {}
        for m in (parse_module(x) if isinstance(x, str) else x for x in modules):
            for r in m.rules:
                self.rules.setdefault(".".join((*m.package, r.name)), []).append(r)
                at: Rule | None = r
                while at is not None:
                    self.home[id(at)] = m
                    at = at.otherwise
        self.tables = {k.removeprefix("data."): t if isinstance(t, Table) else Table(t) for k, t in tables.items()}
        self.serial = 0

    # -- public
    def relation(self, path: str, inputs: DataFrame | None = None) -> DataFrame:
        """The rows of a partial set or object rule: one column for each part of its head.

        A set of objects has their members as columns, a set of arrays ``_1, _2, ...``, any other set ``value``; an
        object rule has ``key`` (``key1, key2, ...``) and ``value``. Two values for one key raise an error."""
        path = path.removeprefix("data.")
        rules = [r for r in self.rules[path] if not r.default]
        spark = next(iter(self.tables.values())).frame.sparkSession if self.tables else inputs.sparkSession
        parts, distinct = [], False
        for r in rules:
            if inputs is None and (compared := self.compared(r)) is not None:
                parts.append(self.pairs(compared, [n for n, _ in self.named_terms(r)]))
                distinct = len(rules) == 1
                continue
            start = Step(inputs.select(F.struct("*").alias("input"))) if inputs is not None else Step(spark.range(1).select(), unit=True)
            columns, step = self.head(r, self.body(r.body, start, r))
            parts.append(step.df.select(*columns))
        rows = reduce(lambda a, b: a.unionByName(b), parts)
        if not distinct:
            rows = _distinct(rows)
        if rules[0].kind != "object":
            return rows
        keys = [c for c in rows.columns if c.startswith("key")]
        one = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first("value").alias("value"))
        clash = F.concat(F.lit(f"object key of {path} has several values: "), F.to_json(F.struct(*keys)))
        return one.select(*keys, F.when(F.col("n") > 1, F.raise_error(clash)).otherwise(F.col("value")).alias("value"))

    def totals(self, path: str, by: list[str], **of: tuple[str, str]) -> DataFrame:
        """The rows of a set rule grouped ``by`` columns; ``of``: ("count", "*"), ("min", column) or ("max", column) by name.

        Where the rule compares two tables by an inequality of numbers, ``by`` is what the head has of one and the totals
        are of the other, its pairs are never built: see ``running``."""
        path = path.removeprefix("data.")
        rules = [r for r in self.rules[path] if not r.default]
        compared = self.compared(rules[0]) if len(rules) == 1 else None
        if compared is not None and sorted(by) in (sorted(n) for n in compared.names):
            at = 0 if sorted(by) == sorted(compared.names[0]) else 1
            kinds = [side.schema["_v"].dataType for side in compared.sides]
            fits = all((f, c) == ("count", "*") or f in ("min", "max") and c in compared.names[1 - at] for f, c in of.values())
            if fits and kinds[0] == kinds[1] and isinstance(kinds[0], T.NumericType):
                own, other = compared.sides[at], compared.sides[1 - at]
                return self.running(own, other, by, EXCHANGED[compared.op] if at else compared.op, of)
        return self.relation(path).groupBy(*by).agg(*[getattr(F, f)(c).alias(n) for n, (f, c) in of.items()])

    def decide(self, path: str, inputs: DataFrame, ids: list[str], name: str = "decision", errors: str | None = None) -> DataFrame:
        """``inputs`` with the value of a complete rule for each row (``ids`` identify rows); NULL where undefined.

        Several bodies may hold at once: different values for one row raise an error, or, where ``errors`` names a
        column, become a message there for that row alone."""
        path = path.removeprefix("data.")
        rules = self.rules[path]
        start = Step(inputs.select(F.struct("*").alias("input")))
        key = lambda s: [F.col("input")[i].alias(i) for i in ids]
        parts, default = [], F.lit(None)
        for r in rules:
            if r.default:
                default = self.term(r.value, start, r)[0]
                continue
            at, rank = r, 0
            while at is not None:
                step = self.body(at.body, start, at)
                value, step = self.term(at.value, step, at)
                parts.append(step.df.select(*key(step), F.lit(rank).alias("_rank"), value.alias("_value")))
                at, rank = at.otherwise, rank + 1
        if not parts:
            out = inputs.withColumn(name, default)
            return out.withColumn(errors, F.lit(None).cast("string")) if errors else out
        found = reduce(lambda a, b: a.unionByName(b), parts).distinct()
        best = found.groupBy(*ids).agg(F.min("_rank").alias("_best"), F.collect_set(F.struct("_rank", "_value")).alias("_all"))
        values = F.array_distinct(F.transform(F.filter("_all", lambda x: x["_rank"] == F.col("_best")), lambda x: x["_value"]))
        several = F.lit(f"complete rule {path} has several values")
        value = F.get(values, F.lit(0))
        if errors is None:
            decided = best.select(*ids, F.when(F.size(values) > 1, F.raise_error(several)).otherwise(value).alias("_decision"))
        else:
            decided = best.select(*ids, F.when(F.size(values) == 1, value).alias("_decision"), F.when(F.size(values) > 1, several).alias("_error"))
        out = inputs.join(decided, ids, "left")
        own = [inputs[c] for c in inputs.columns]
        if errors is None:
            return out.select(*own, F.coalesce("_decision", default).alias(name))
        return out.select(*own, F.when(F.col("_error").isNull(), F.coalesce("_decision", default)).alias(name), F.col("_error").alias(errors))

    # -- heads
    def named_terms(self, r: Rule) -> list[tuple[str, Any]]:
        """The head's terms by the names of their columns."""
        if r.kind == "set":
            term = r.keys[-1]
            if isinstance(term, Collection) and term.kind == "object":
                return [(k.value, v) for k, v in term.items]
            if isinstance(term, Collection) and term.kind == "array":
                return [(f"_{i}", v) for i, v in enumerate(term.items, 1)]
            return [("value", term)]
        keys = ["key"] if len(r.keys) == 1 else [f"key{i}" for i in range(1, len(r.keys) + 1)]
        return [*zip(keys, r.keys, strict=True), ("value", r.value)]

    def head(self, r: Rule, step: Step) -> tuple[list[Column], Step]:
        """The head's columns, and the step with the tables that they look up."""
        out = []
        for name, v in self.named_terms(r):
            column, step = self.term(v, step, r)
            out.append(column.alias(name))
        return out, step

    # -- two tables and an inequality
    def is_table(self, term: Any, r: Rule) -> bool:
        found = self.full(term, r) if isinstance(term, Var | Ref) else None
        return bool(found) and not found[1] and (found[0] in self.tables or found[0] in self.rules and self.rules[found[0]][0].kind in ("set", "object"))

    def compared(self, r: Rule) -> Compared | None:
        """A set rule whose body iterates two tables and compares them by one inequality; every other line and every part
        of the head is about one of them. Of equal rows of a side only the best value counts: it has all their pairs."""
        tables = [lit.terms for lit in r.body if lit.kind == "somein"]
        lines = [lit for lit in r.body if lit.kind not in ("some", "somein")]
        if r.kind != "set" or len(tables) != 2 or any(lit.withs for lit in r.body) or any(lit.kind not in ("expr", "assign") for lit in lines):
            return None
        if any(key is not None or not isinstance(value, Var) or not self.is_table(coll, r) for key, value, coll in tables) or tables[0][1].name == tables[1][1].name:
            return None
        own = ({tables[0][1].name}, {tables[1][1].name})

        def side(node: Any) -> int | None:
            """The table that a term is about; None: both."""
            used: dict[str, set[str] | None] = {}
            self.outer(node, own[0] | own[1], r, used)
            return None if used.keys() & own[0] and used.keys() & own[1] else 1 if used.keys() & own[1] else 0

        bodies: tuple[list[Literal], list[Literal]] = ([], [])
        for i, (_, value, _) in enumerate(tables):
            bodies[i].extend(lit for lit in r.body if lit.kind == "somein" and lit.terms[1] is value)
        inequality = None
        for lit in lines:
            if lit.kind == "assign" and (not isinstance(lit.terms[0], Var) or lit.terms[0].name in own[0] | own[1]):
                return None
            term = lit.terms[-1]
            at = side(term)
            if at is not None:
                bodies[at].append(lit)
                if lit.kind == "assign":
                    own[at].add(lit.terms[0].name)
            elif inequality is None and lit.kind == "expr" and isinstance(term, Call) and term.name in EXCHANGED and None not in map(side, term.args):
                inequality = term
            else:
                return None
        named = [(n, v, side(v)) for n, v in self.named_terms(r)]
        if inequality is None or any(at is None for _, _, at in named):
            return None
        first = side(inequality.args[0])
        values = inequality.args if first == 0 else inequality.args[::-1]
        op = inequality.name if first == 1 else EXCHANGED[inequality.name]
        greater = op in ("gt", "gte")
        sides, names = [], []
        for i in (0, 1):
            step = self.body(tuple(bodies[i]), Step(next(iter(self.tables.values())).frame.sparkSession.range(1).select(), unit=True), r)
            columns = []
            for n, v, at in named:
                if at == i:
                    column, step = self.term(v, step, r)
                    columns.append(column.alias(n))
            value, step = self.term(values[i], step, r)
            names.append([n for n, _, at in named if at == i])
            best = F.max if greater == (i == 1) else F.min
            rows = step.df.select(*columns, value.alias("_v")).filter(F.col("_v").isNotNull())
            sides.append(rows.groupBy(*names[i]).agg(best("_v").alias("_v")).filter(F.col("_v").isNotNull()))
        kinds = [s.schema["_v"].dataType for s in sides]
        if kinds[0] != kinds[1] and not all(isinstance(k, T.NumericType) for k in kinds):
            return None  # what compares best depends on the type in which it is compared
        return Compared(tuple(sides), tuple(names), op)

    def pairs(self, compared: Compared, names: list[str]) -> DataFrame:
        """The pairs themselves, without equal ones: a nested loop that keeps nothing, in many tasks though both sides
        may be small files (numbers of partitions that are given are not coalesced)."""
        spark = compared.sides[0].sparkSession
        tasks = max(PAIR_TASKS, 4 * spark.sparkContext.defaultParallelism)
        a, b = (side.withColumnRenamed("_v", f"_v{i}").repartition(tasks) for i, side in enumerate(compared.sides))
        return a.join(b, COLUMNS[compared.op](F.col("_v1"), F.col("_v0"))).select(*names)

    def running(self, own: DataFrame, other: DataFrame, by: list[str], op: str, of: Mapping[str, tuple[str, str]]) -> DataFrame:
        """Totals of the rows of ``other`` that compare (``other op own``) with each row of ``own``, in sorts instead of
        pairs: the distinct values of both sides are cut into ranges, running totals inside a range follow the order, the
        whole ranges before it are added. The bounds of the ranges are found when the plan is made."""
        inner = [F.count("*").alias(n) if f == "count" else getattr(F, f)(c).alias(n) for n, (f, c) in of.items()]
        inner.append(F.count("*").alias("_n"))
        again = lambda n, over: (F.sum(n) if n == "_n" or of[n][0] == "count" else getattr(F, of[n][0])(n)).over(over)
        made = [*of, "_n"]
        mine = own.select("_v").distinct().select("_v", F.lit(0).alias("_side"))
        points = mine.unionByName(other.groupBy("_v").agg(*inner).withColumn("_side", F.lit(1)), allowMissingColumns=True)
        cuts = 1000
        n, found = points.agg(F.count("*"), F.percentile_approx("_v", [i / cuts for i in range(1, cuts)], 10 * cuts)).first()
        ranges = min(cuts, n // RANGE_VALUES + 1)
        bounds = sorted(set(found[cuts // ranges - 1 :: cuts // ranges])) if ranges > 1 else []
        kind = own.schema["_v"].dataType
        value = F.col("_v")
        place = F.size(F.filter(F.array(*[F.lit(x).cast(kind) for x in bounds]), lambda x: x <= value)) if bounds else F.lit(0)
        points = points.withColumn("_range", place)
        down = op in ("gt", "gte")
        first = F.col("_side").asc() if op in ("gt", "lt") else F.col("_side").desc()  # equal values count after the row, or before
        inside = Window.partitionBy("_range").orderBy(value.desc() if down else value.asc(), first).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = Window.orderBy(F.col("_range").desc() if down else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
        whole = points.groupBy("_range").agg(*[(F.sum(n) if n == "_n" or of[n][0] == "count" else getattr(F, of[n][0])(n)).alias(n) for n in made])
        whole = whole.select("_range", *[again(n, before).alias(f"_before_{n}") for n in made])
        run = points.select("_v", "_side", "_range", *[again(n, inside).alias(f"_in_{n}") for n in made]).filter(F.col("_side") == 0)

        def both(n: str) -> Column:
            a, b = F.col(f"_in_{n}"), F.col(f"_before_{n}")
            if n == "_n" or of[n][0] == "count":
                return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
            return F.least(a, b) if of[n][0] == "min" else F.greatest(a, b)

        found = run.join(F.broadcast(whole), "_range").select(value.alias("_at"), *[both(n).alias(f"_of_{n}") for n in made]).filter(F.col("_of__n") > 0)
        return own.join(found, value == F.col("_at")).select(*by, *[F.col(f"_of_{n}").alias(n) for n in of])

    # -- bodies
    def body(self, body: tuple, step: Step, r: Rule) -> Step:
        for lit in body:
            step = self.literal(lit, step, r)
        return step

    def literal(self, lit: Literal, step: Step, r: Rule) -> Step:
        if lit.withs:
            return self.substituted(lit, step, r)
        if lit.kind == "some":
            return step
        if lit.kind == "somein":
            return self.iterate(*lit.terms, step, r)
        if lit.kind in ("assign", "unify"):
            value, step = self.term(lit.terms[1], step, r)
            target = lit.terms[0]
            if isinstance(target, Var) and target.name not in step.env:
                return replace(step.bind(target.name, value), df=step.df.filter(value.isNotNull()))
            left, step = self.term(target, step, r)
            return replace(step, df=step.df.filter(left == value))
        if lit.kind == "not":
            return self.negated(lit.body, step, r)
        if lit.kind == "every":
            key, value, coll = lit.terms
            if (frame := self.frame(coll, r)) is not None:  # no row of the table breaks the body
                alias = self.fresh()
                row = F.col(alias)
                inner = step.bind(value.name, row)
                bad = ~_holds(self.condition(lit.body, inner, r))
                return replace(step, df=step.df.join(frame.frame.select(F.struct("*").alias(alias)), bad, "left_anti"))
            xs, step = self.term(coll, step, r)
            element = step.kind_of(xs).elementType
            holds = F.forall(xs, lambda x: _holds(self.condition(lit.body, step.bind(value.name, x, element), r)))
            return replace(step, df=step.df.filter(holds))
        term = lit.terms[0]
        if isinstance(term, Call) and term.name == "internal.member_2" and (frame := self.frame(term.args[1], r)) is not None:
            return self.semi(term.args[0], frame, step, r, "left_semi")
        if isinstance(term, Ref | Var) and (lookup := self.lookup(term, r)) is not None and len(lookup[2]) == 0:
            return self.semi(lookup[1], lookup[0], step, r, "left_semi")
        cond, step = self.term(term, step, r)
        return replace(step, df=step.df.filter(self.truthy(cond, step)))

    def truthy(self, cond: Column, step: Step) -> Column:
        return cond if isinstance(step.kind_of(cond), T.BooleanType) else cond.isNotNull()

    def condition(self, body: tuple, step: Step, r: Rule) -> Column:
        """A body without iteration as one boolean column."""
        out = F.lit(True)
        for lit in body:
            if lit.kind == "not":
                out = out & ~_holds(self.condition(lit.body, step, r))
            elif lit.kind == "assign" and isinstance(lit.terms[0], Var):
                value, step = self.term(lit.terms[1], step, r)
                step = step.bind(lit.terms[0].name, value)
                out = out & value.isNotNull()
            elif lit.kind == "unify":
                a, b = (self.term(t, step, r)[0] for t in lit.terms)
                out = out & (a == b)
            elif lit.kind == "expr":
                before = step.df
                cond, step = self.term(lit.terms[0], step, r)
                if step.df is not before:
                    raise FragmentError("a table lookup can't be part of this condition")
                out = out & cond
            else:
                raise FragmentError(f"'{lit.kind}' can't be part of this condition")
        return out

    def negated(self, body: tuple, step: Step, r: Rule) -> Step:
        term = body[0].terms[0] if body[0].kind == "expr" else None
        if isinstance(term, Call) and term.name == "internal.member_2" and (frame := self.frame(term.args[1], r)) is not None:
            return self.semi(term.args[0], frame, step, r, "left_anti")
        if isinstance(term, Ref | Var) and (lookup := self.lookup(term, r)) is not None and len(lookup[2]) == 0:
            return self.semi(lookup[1], lookup[0], step, r, "left_anti")
        return replace(step, df=step.df.filter(~_holds(self.condition(body, step, r))))

    def semi(self, term: Any, table: Table, step: Step, r: Rule, how: str) -> Step:
        value, step = self.term(term, step, r)
        column = table.key or table.frame.columns[0]
        alias = self.fresh()
        keys = table.frame.select(F.col(column).alias(alias)).distinct() if how == "left_semi" else table.frame.select(F.col(column).alias(alias))
        return replace(step, df=step.df.join(keys, value == F.col(alias), how))

    def iterate(self, key: Any, value: Any, coll: Any, step: Step, r: Rule) -> Step:
        if (frame := self.frame(coll, r)) is not None:
            alias = self.fresh()
            rows = frame.frame.select(F.struct("*").alias(alias))
            row = F.col(alias)
            step = replace(step, df=rows if step.unit else step.df.crossJoin(rows), unit=False)
            single = len(frame.frame.columns) == 1 and frame.frame.columns[0] == "value"
            if frame.key:
                step = replace(step, order=(*step.order, row[frame.key]))
            step = self.match(value, row["value"] if single else row, step, r)
            return self.match(key, row[frame.key], step, r) if key is not None and frame.key else step
        if isinstance(coll, Ref | Var) and (lookup := self.lookup(coll, r)) is not None:
            step, xs = self.joined(lookup, step, r)
        else:
            xs, step = self.term(coll, step, r)
        a, b = self.fresh(), self.fresh()
        kind = step.kind_of(xs)
        if isinstance(kind, T.MapType):
            df = step.df.select("*", F.explode(xs).alias(a, b))
        elif isinstance(kind, T.ArrayType):
            df = step.df.select("*", F.posexplode(xs).alias(a, b))
        else:
            raise FragmentError("only tables, arrays and maps can be iterated")
        step = self.match(value, F.col(b), replace(step, df=df), r)
        return self.match(key, F.col(a), step, r) if key is not None else step

    def match(self, pattern: Any, value: Column, step: Step, r: Rule) -> Step:
        if isinstance(pattern, Var) and pattern.name not in step.env:
            return step.bind(pattern.name, value)
        known, step = self.term(pattern, step, r)
        return replace(step, df=step.df.filter(known == value))

    # -- tables and rules as tables
    def fresh(self) -> str:
        self.serial += 1
        return f"_s{self.serial}"

    def full(self, term: Any, r: Rule) -> tuple[str, tuple] | None:
        """(dotted path of constants below data, remaining terms)."""
        base, path = (term.base, term.path) if isinstance(term, Ref) else (term, ())
        if not isinstance(base, Var):
            return None
        module = self.home[id(r)]
        if base.name == "data":
            head: tuple = ()
        elif base.name in module.imports and module.imports[base.name][0] == "data":
            head = module.imports[base.name][1:]
        elif ".".join((*module.package, base.name)) in self.rules:
            head = (*module.package, base.name)
        else:
            return None
        names = list(head)
        while path and isinstance(path[0], Const) and ".".join(names) not in self.tables and ".".join(names) not in self.rules:
            names.append(path[0].value)
            path = path[1:]
        return ".".join(names), path

    def frame(self, term: Any, r: Rule) -> Table | None:
        found = self.full(term, r) if isinstance(term, Var | Ref) else None
        return self.named(found[0]) if found and not found[1] else None

    def named(self, path: str) -> Table | None:
        if path in self.tables:
            return self.tables[path]
        if path in self.rules and self.rules[path][0].kind in ("set", "object"):
            rows = self.relation(path)
            return Table(rows, "key" if "key" in rows.columns else rows.columns[0])
        return None

    def lookup(self, term: Any, r: Rule) -> tuple[Table, Any, tuple] | None:
        """``data.t[k].rest`` as (table, k, rest)."""
        found = self.full(term, r)
        if found is None or not found[1]:
            return None
        table = self.named(found[0])
        return (table, found[1][0], found[1][1:]) if table is not None and table.key else None

    def joined(self, lookup: tuple, step: Step, r: Rule) -> tuple[Step, Column]:
        table, key, rest = lookup
        value, step = self.term(key, step, r)
        alias = self.fresh()
        rows = table.frame.select(F.struct("*").alias(alias))
        step = replace(step, df=step.df.join(rows, F.col(alias)[table.key] == value))
        others = [c for c in table.frame.columns if c != table.key]
        out = F.col(alias)[others[0]] if len(others) == 1 else F.col(alias)
        for p in rest:
            k, step = self.term(p, step, r)
            out = out[p.value] if isinstance(p, Const) and isinstance(p.value, str) else F.try_element_at(out, k)
        return step, out

    def candidates(self, head: str, path: tuple) -> dict[str, list[Rule]]:
        """Rules that ``data.<head>[k].<tail>`` may mean, by k: what is known when the plan is made."""
        if not path or not all(isinstance(p, Const) for p in path[1:]):
            return {}
        before, after = (head + "." if head else ""), "".join(f".{p.value}" for p in path[1:])
        found = {n[len(before) : len(n) - len(after)]: rules for n, rules in self.rules.items() if n.startswith(before) and n.endswith(after) and len(n) > len(before) + len(after)}
        return {k: rules for k, rules in found.items() if "." not in k and rules[0].args is None}

    def dispatched(self, candidates: dict[str, list[Rule]], key: Any, step: Step, r: Rule) -> tuple[Column, Step]:
        """The rule that the key names for each row; undefined where it names none."""
        name, step = self.term(key, step, r)
        out = None
        for k, rules in sorted(candidates.items()):
            if any(x.kind != "complete" for x in rules):
                raise FragmentError(f"{k}: only complete rules can be chosen by a key in a plan")
            value = self.complete(rules, [], step)[0]
            out = F.when(name == k, value) if out is None else out.when(name == k, value)
        return out, step

    # -- terms
    def term(self, term: Any, step: Step, r: Rule) -> tuple[Column, Step]:
        if isinstance(term, Const):
            return F.lit(term.value), step
        if isinstance(term, Var | Ref):
            base, path = (term.base, term.path) if isinstance(term, Ref) else (term, ())
            if isinstance(base, Var) and base.name in step.env:
                out = step.env[base.name]
            elif not isinstance(base, Var):
                out, step = self.term(base, step, r)
            elif base.name == "input":
                out = F.col("input")
            elif (lookup := self.lookup(term, r)) is not None:
                step, out = self.joined(lookup, step, r)
                return out, step
            elif isinstance(base, Var) and (found := self.full(term, r)) and found[0] in self.rules and not found[1]:
                return self.complete(self.rules[found[0]], [], step)
            elif found and (candidates := self.candidates(*found)):
                return self.dispatched(candidates, found[1][0], step, r)
            else:
                raise FragmentError(f"{base} has no value here")
            for p in path:
                if isinstance(p, Const):
                    out = out[p.value] if isinstance(p.value, str) else F.get(out, F.lit(p.value))
                else:
                    k, step = self.term(p, step, r)
                    out = F.try_element_at(out, k)
            return out, step
        if isinstance(term, Collection):
            if term.kind == "object":
                parts = []
                for k, v in term.items:
                    c, step = self.term(v, step, r)
                    parts.append(c.alias(k.value))
                return F.struct(*parts), step
            parts = []
            for v in term.items:
                c, step = self.term(v, step, r)
                parts.append(c)
            return (F.array_sort(F.array_distinct(F.array(*parts))) if term.kind == "set" else F.array(*parts)), step
        if isinstance(term, Comprehension):
            return self.gathered(term, step, r) if self.over_rows(term, r) else (self.comprehension(term, step, r), step)
        if isinstance(term, Call):
            of = term.args[0] if len(term.args) == 1 else None
            if term.name in TOTALS and isinstance(of, Comprehension) and of.kind != "object" and self.over_rows(of, r):
                return self.gathered(of, step, r, term.name)
            args = []
            for a in term.args:
                c, step = self.term(a, step, r)
                args.append(c)
            return self.apply(term, args, step, r), step
        raise FragmentError(f"can't plan {term}")

    def apply(self, term: Call, args: list[Column], step: Step, r: Rule) -> Column:
        module = self.home[id(r)]
        head, *rest = term.name.split(".")
        path = ".".join((*module.imports.get(head, (head,)), *rest))
        for name in (".".join((*module.package, term.name)), path.removeprefix("data.")):
            if name in self.rules and self.rules[name][0].args is not None:
                return self.complete(self.rules[name], args, step)[0]
        if path in self.functions:
            return self.functions[path](*args)
        if term.name == "internal.member_2":
            if isinstance(term.args[1], Collection) and all(isinstance(x, Const) for x in term.args[1].items):
                return args[0].isin([x.value for x in term.args[1].items])
            return F.array_contains(args[1], args[0])
        if term.name == "count":
            of = term.args[0]
            kind = step.kinds[of.name] if isinstance(of, Var) and of.name in step.kinds else step.kind_of(args[0])
            return F.length(args[0]) if isinstance(kind, T.StringType) else F.size(args[0])
        if term.name == "sprintf":
            from lodestar.functions.scalar import sprintf

            return sprintf(term.args[0].value, *(args[1 + i] for i in range(len(args) - 1))) if not isinstance(term.args[1], Collection) else sprintf(term.args[0].value, *[self.term(x, step, r)[0] for x in term.args[1].items])
        if term.name in IS_KIND:
            return self.is_kind(term, args[0], step)
        if term.name in COLUMNS:
            return COLUMNS[term.name](*args)
        raise FragmentError(f"function {term.name} can't be planned")

    def is_kind(self, term: Call, value: Column, step: Step) -> Column:
        """``is_string`` and the like: known from a column's type, looked up in VARIANT values. Sets are arrays here."""
        of = term.args[0]
        kind = step.kinds[of.name] if isinstance(of, Var) and of.name in step.kinds else step.kind_of(value)
        if isinstance(kind, T.VariantType):
            return type_name(value) == term.name.removeprefix("is_")
        return F.when(value.isNotNull(), F.lit(isinstance(kind, IS_KIND[term.name])))

    def complete(self, rules: list[Rule], args: list[Column], step: Step) -> tuple[Column, Step]:
        """A function or a complete rule without iteration as a CASE."""
        out, default = None, F.lit(None)
        for r in rules:
            if r.default:
                default = self.term(r.value, step, r)[0]
                continue
            at = r
            while at is not None:
                inner, cond = replace(step, env={}), F.lit(True)
                for p, a in zip(at.args or (), args, strict=True):
                    if isinstance(p, Var):
                        inner = inner.bind(p.name, a)
                    else:
                        cond = cond & (a == self.term(p, inner, at)[0])
                for lit in at.body:
                    if lit.kind == "assign" and isinstance(lit.terms[0], Var):
                        inner = inner.bind(lit.terms[0].name, self.term(lit.terms[1], inner, at)[0])
                cond = cond & self.condition(at.body, inner, at)
                value = self.term(at.value, inner, at)[0]
                out = F.when(cond, value) if out is None else out.when(cond, value)
                at = at.otherwise
        return (default if out is None else out.otherwise(default)), step

    def substituted(self, lit: Literal, step: Step, r: Rule) -> Step:
        """A line under ``with``: parts of the input become other values, data paths other tables or rules. What is bound
        before or by the line keeps its value afterwards."""
        values, tables = [], dict(self.tables)
        for (root, *path), term in lit.withs:
            if root == "data":
                if (table := self.frame(term, r)) is None:
                    raise FragmentError("a table can only be replaced by a table or a rule")
                tables[".".join(path)] = table
            elif root == "input":
                value, step = self.term(term, step, r)
                values.append((path, value))
            else:
                raise FragmentError(f"{root} can't be replaced in a plan")
        held = {n: self.fresh() for n in step.env}
        known, saved, doc = "input" in step.df.columns, self.fresh(), None
        df = step.df.select("*", *[step.env[n].alias(c) for n, c in held.items()], *([F.col("input").alias(saved)] if known else []))
        if values:
            doc = F.col("input") if known else None
            for path, value in values:
                if path and doc is not None:
                    value = doc.withField(".".join(f"`{p}`" for p in path), value)
                else:
                    for p in reversed(path):
                        value = F.struct(value.alias(p))
                doc = value
            df = df.withColumn("input", doc)
        inner = replace(step, df=df, env={n: F.col(c) for n, c in held.items()}, unit=step.unit and not values)
        before, self.tables = self.tables, tables
        try:
            out = self.literal(replace(lit, withs=()), inner, r)
        finally:
            self.tables = before
        new = {n: self.fresh() for n in out.env if n not in held}
        df = out.df.select("*", *[out.env[n].alias(c) for n, c in new.items()])
        if known:
            df = df.withColumn("input", F.col(saved)).drop(saved)
        elif values:
            df = df.drop("input")
        return replace(out, df=df, env={n: F.col(c) for n, c in {**held, **new}.items()})

    def over_rows(self, term: Comprehension, r: Rule) -> bool:
        """Whether the body iterates a table, or a rule that is one."""
        return any(lit.kind == "somein" and self.is_table(lit.terms[2], r) for lit in term.body)

    def outer(self, node: Any, names: set[str], r: Rule, used: dict[str, set[str] | None]) -> None:
        """For each of ``names`` that is used below ``node``: its fields in use, or None for the whole value."""
        base, path = (node.base, node.path) if isinstance(node, Ref) else (node, ())
        if isinstance(base, Var) and base.name in names:
            if path and isinstance(path[0], Const) and isinstance(path[0].value, str) and used.get(base.name, set()) is not None:
                used.setdefault(base.name, set()).add(path[0].value)
            else:
                used[base.name] = None
            node = path
        elif "input" in names and (isinstance(node, Var | Ref) and (found := self.full(node, r)) and found[0] in self.rules or isinstance(node, Call) and ".".join((*self.home[id(r)].package, node.name)) in self.rules):
            used["input"] = None  # the rule may use any part of it
        if isinstance(node, tuple):
            for x in node:
                self.outer(x, names, r, used)
        elif is_dataclass(node):
            for f in fields(node):
                self.outer(getattr(node, f.name), names, r, used)

    def gathered(self, term: Comprehension, step: Step, r: Rule, total: str | None = None) -> tuple[Column, Step]:
        """A comprehension over tables for all rows of the step: its body runs once for each combination of the outer
        values that it uses, is grouped by them, and joined back. ``total`` aggregates without building the collection.

        Sets come sorted, arrays in the order of the tables' keys (then by value)."""
        known = "input" in step.df.columns and "input" not in step.env
        used: dict[str, set[str] | None] = {}
        self.outer((term.head, term.body), {*step.env, *(["input"] if known else [])}, r, used)
        keys = {}
        for n, parts in sorted(used.items()):
            value = step.env[n] if n in step.env else F.col("input")
            keys[n] = ("input" if n not in step.env else self.fresh(), value if parts is None else F.struct(*[value[p].alias(p) for p in sorted(parts)]))
        if keys:
            start = Step(step.df.select(*[v.alias(c) for c, v in keys.values()]).distinct(), {n: F.col(c) for n, (c, _) in keys.items() if n in step.env})
        else:
            start = Step(step.df.sparkSession.range(1).select(), unit=True)
        inner = self.body(term.body, start, r)
        head = []
        for x in term.head:
            column, inner = self.term(x, inner, r)
            head.append(column)
        back = {n: self.fresh() for n in keys}
        rows = inner.df.select(*[F.col(keys[n][0]).alias(c) for n, c in back.items()], *[c.alias(f"_h{i}") for i, c in enumerate(head)], F.struct(*inner.order, F.lit(0)).alias("_order"))
        rows = rows.filter(reduce(lambda a, b: a & b, [F.col(f"_h{i}").isNotNull() for i in range(len(head))]))
        if total is not None:
            if term.kind == "set":
                rows = rows.drop("_order").distinct()
            made, empty = TOTALS[total][0]("_h0"), TOTALS[total][1]
            made = made if empty is None else F.coalesce(made, F.lit(empty))
        elif term.kind == "object":
            made, empty = F.map_from_entries(F.collect_set(F.struct("_h0", "_h1"))), None
        elif term.kind == "set":
            made, empty = F.array_sort(F.collect_set("_h0")), None
        else:
            made, empty = F.transform(F.array_sort(F.collect_list(F.struct("_order", "_h0"))), lambda x: x["_h0"]), None
        out = self.fresh()
        grouped = rows.groupBy(*back.values()).agg(made.alias(out))
        if not keys:  # one row
            return F.col(out), replace(step, df=step.df.crossJoin(grouped), unit=False)
        same = reduce(lambda a, b: a & b, [keys[n][1].eqNullSafe(F.col(c)) for n, c in back.items()])
        df = step.df.join(grouped, same, "left").drop(*back.values())
        if total is None:
            kind = grouped.schema[out].dataType
            nothing = F.create_map() if term.kind == "object" else F.array()
            return F.coalesce(F.col(out), nothing.cast(kind)), replace(step, df=df, unit=False)
        return (F.col(out) if empty is None else F.coalesce(F.col(out), F.lit(empty))), replace(step, df=df, unit=False)

    def comprehension(self, term: Comprehension, step: Step, r: Rule) -> Column:
        """Over one array column: filter and transform."""
        first, *rest = term.body
        if first.kind != "somein" or not isinstance(first.terms[1], Var):
            raise FragmentError("a planned comprehension iterates one array first")
        key, value, coll = first.terms
        xs = self.term(coll, step, r)[0]
        element = None if isinstance(coll, Var) and coll.name in step.kinds else step.kind_of(xs).elementType

        def inner(x: Column, i: Column) -> Step:
            s = step.bind(value.name, x, element)
            s = s.bind(key.name, i) if isinstance(key, Var) else s
            for lit in rest:
                if lit.kind == "assign" and isinstance(lit.terms[0], Var):
                    s = s.bind(lit.terms[0].name, self.term(lit.terms[1], s, r)[0])
            return s

        kept = F.filter(xs, lambda x, i: _holds(self.condition(tuple(rest), inner(x, i), r)))
        out = F.transform(kept, lambda x, i: self.term(term.head[-1], inner(x, i), r)[0])
        if term.kind == "object":
            keys = F.transform(kept, lambda x, i: self.term(term.head[0], inner(x, i), r)[0])
            return F.map_from_arrays(keys, out)
        return F.array_sort(F.array_distinct(out)) if term.kind == "set" else out
