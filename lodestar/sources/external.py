"""Queries to other stores: one request object in, one result object out.

Every function checks the keys of its request, raises on errors or returns ``{"error": {...}}`` where the request says
``raise_error: false``, and keeps results per request (``cache: true``, ``cache_duration`` in seconds). The stores
themselves are DataFrames or a reader that the caller provides, so that filters, projections and limits become plans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators.catalog import Memo
from lodestar.plans.conditions import quote

_memos: dict[float, Memo] = {}


class RequestError(ValueError):
    pass


def _checked(request: Mapping, required: set[str], allowed: set[str]) -> None:
    if missing := required - set(request):
        raise RequestError(f"missing request parameters: {sorted(missing)}")
    if extra := set(request) - required - allowed - {"raise_error", "cache", "cache_duration"}:
        raise RequestError(f"unexpected request parameters: {sorted(extra)}")


def _run(name: str, request: Mapping, compute: Callable[[], dict]) -> dict:
    try:
        if not request.get("cache"):
            return compute()
        seconds = float(request.get("cache_duration", 60))
        return _memos.setdefault(seconds, Memo(seconds)).get([name, request], compute)
    except Exception as e:
        if request.get("raise_error", True) or isinstance(e, RequestError):
            raise
        return {"error": {"message": str(e), "type": type(e).__name__}}


#: Rows that a request may bring to the driver; more raise an error (the ``*_frame`` forms stay distributed).
MAX_ROWS = 100_000


def bounded(df: DataFrame) -> list:
    rows = df.take(MAX_ROWS + 1)
    if len(rows) > MAX_ROWS:
        raise RequestError(f"the result has more than {MAX_ROWS} rows; use the DataFrame form")
    return rows


def _rows(df: DataFrame, objects: bool) -> list:
    return [r.asDict(recursive=True) if objects else list(r) for r in bounded(df)]


DRIVERS = {"postgres": "org.postgresql.Driver", "mysql": "com.mysql.cj.jdbc.Driver", "sqlite": "org.sqlite.JDBC", "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "oracle": "oracle.jdbc.OracleDriver"}


def sql_frame(spark: SparkSession, request: Mapping) -> DataFrame:
    """The DataFrame of a SQL request. ``driver: spark`` queries views of the session; others go through JDBC."""
    args = list(request.get("args", []))
    if request["driver"] == "spark":
        return spark.sql(request["query"], args=args or None)
    if request["driver"] not in DRIVERS:
        raise RequestError(f"unknown driver {request['driver']}")
    query = with_args(request["query"], args, request["driver"])
    return spark.read.format("jdbc").options(url=request["data_source_name"], driver=DRIVERS[request["driver"]], query=query).load()


_SQL_TOKEN = re.compile(r"""'(?:[^'\\]|''|\\.)*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\?|\$\d+|.""", re.S)


def with_args(query: str, args: list, driver: str) -> str:
    """The query with arguments as literals of the driver's dialect: ``?`` in their order, ``$n`` by number.

    Strings, quoted names and comments stay as they are. Arguments too few or too many are an error."""
    used: set[int] = set()

    def put(m: re.Match) -> str:
        token = m[0]
        if token == "?":
            at = len(used)
        elif token[0] == "$" and len(token) > 1:
            at = int(token[1:]) - 1
        else:
            return token
        if not 0 <= at < len(args):
            raise RequestError(f"no argument for {token}")
        used.add(at)
        return quote(args[at], driver)

    out = _SQL_TOKEN.sub(put, query) if args else query
    if len(used) != len(args):
        raise RequestError(f"{len(args)} arguments, {len(used)} of them used")
    return out


def sql_send(spark: SparkSession, request: Mapping) -> dict:
    """``{"rows": [...]}``: arrays, or objects with ``row_object: true``."""
    _checked(request, {"driver", "query"}, {"data_source_name", "args", "row_object", "max_open_connections", "max_idle_connections", "connection_max_idle_time", "connection_max_life_time", "max_prepared_statements"})
    return _run("sql.send", request, lambda: {"rows": _rows(sql_frame(spark, request), bool(request.get("row_object")))})


# -- documents by key, as in DynamoDB
def dynamodb_get(table: DataFrame, request: Mapping) -> dict:
    """``{"row": {...}}`` of a full key, or ``{}``. A consistent read is never taken from the cache."""
    _checked(request, {"key"}, {"table", "region", "endpoint", "credentials", "consistent_read"})
    if request.get("consistent_read"):
        request = {**request, "cache": False}

    def compute() -> dict:
        cond = reduce(lambda a, b: a & b, [F.col(k) == F.lit(_attribute(v)) for k, v in request["key"].items()])
        found = _rows(table.filter(cond).limit(1), True)
        return {"row": found[0]} if found else {}

    return _run("dynamodb.get", request, compute)


def _attribute(v: Any) -> Any:
    if isinstance(v, Mapping) and len(v) == 1:
        kind, value = next(iter(v.items()))
        return (float(value) if "." in str(value) else int(value)) if kind == "N" else value
    return v


_KEY_PART = re.compile(r"\s*(begins_with)\s*\(\s*(#?\w+)\s*,\s*(:\w+)\s*\)|\s*(#?\w+)\s*(BETWEEN|<=|>=|=|<|>)\s*(:\w+)(?:\s+AND\s+(:\w+))?", re.I)


def key_condition(expression: str, names: Mapping[str, str], values: Mapping[str, Any]) -> Column:
    """A key condition such as ``p = :p AND s BETWEEN :a AND :b`` as a Column."""
    out, at = None, 0
    while at < len(expression):
        m = _KEY_PART.match(expression, at)
        if not m:
            raise RequestError(f"bad key condition near {expression[at:]!r}")
        col = lambda n: F.col(names.get(n, n))
        val = lambda n: F.lit(_attribute(values[n]))
        if m[1]:
            part = col(m[2]).startswith(val(m[3]))
        elif m[5].upper() == "BETWEEN":
            part = col(m[4]).between(val(m[6]), val(m[7]))
        else:
            part = {"=": col(m[4]) == val(m[6]), "<": col(m[4]) < val(m[6]), "<=": col(m[4]) <= val(m[6]), ">": col(m[4]) > val(m[6]), ">=": col(m[4]) >= val(m[6])}[m[5]]
        out = part if out is None else out & part
        at = m.end()
        if (a := re.compile(r"\s+AND\s+|\s*$", re.I).match(expression, at)) is None:
            raise RequestError(f"bad key condition near {expression[at:]!r}")
        at = a.end()
    return out


def dynamodb_query_frame(table: DataFrame, request: Mapping, sort_key: str | None = None) -> DataFrame:
    names = request.get("expression_attribute_names", {})
    values = request.get("expression_attribute_values", {})
    df = table.filter(key_condition(request["key_condition_expression"], names, values))
    if (start := request.get("exclusive_start_key")) and sort_key:
        after = F.col(sort_key) > F.lit(_attribute(start[sort_key])) if request.get("scan_index_forward", True) else F.col(sort_key) < F.lit(_attribute(start[sort_key]))
        df = df.filter(after)
    if sort_key:
        df = df.orderBy(F.col(sort_key).asc() if request.get("scan_index_forward", True) else F.col(sort_key).desc())
    if limit := request.get("limit"):
        df = df.limit(limit)
    if projection := request.get("projection_expression"):
        df = df.select(*[names.get(p.strip(), p.strip()) for p in projection.split(",")])
    return df


def dynamodb_query(table: DataFrame, request: Mapping, sort_key: str | None = None) -> dict:
    """``{"rows": [...]}``, or ``{"count": n}`` with ``select: COUNT``."""
    _checked(request, {"key_condition_expression"}, {"table", "region", "endpoint", "credentials", "expression_attribute_names", "expression_attribute_values", "index_name", "projection_expression", "limit", "select", "scan_index_forward", "exclusive_start_key", "consistent_read"})

    def compute() -> dict:
        df = dynamodb_query_frame(table, request, sort_key)
        return {"count": df.count()} if request.get("select") == "COUNT" else {"rows": _rows(df, True)}

    return _run("dynamodb.query", request, compute)


# -- document filters, as in MongoDB
def document_filter(spec: Mapping) -> Column:
    """``{"bar": {"$gt": 1}, "$or": [...]}`` as a Column."""
    parts = []
    for k, v in spec.items():
        if k in ("$and", "$or", "$nor"):
            inner = reduce((lambda a, b: a & b) if k == "$and" else (lambda a, b: a | b), map(document_filter, v))
            parts.append(~F.coalesce(inner, F.lit(False)) if k == "$nor" else inner)
        elif isinstance(v, Mapping) and any(x.startswith("$") for x in v):
            parts += [_operator(F.col(k), op, x) for op, x in v.items()]
        else:
            parts.append(F.col(k).eqNullSafe(F.lit(v)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _operator(c: Column, op: str, v: Any) -> Column:
    simple = {"$eq": lambda: c.eqNullSafe(F.lit(v)), "$ne": lambda: ~c.eqNullSafe(F.lit(v)), "$gt": lambda: c > v, "$gte": lambda: c >= v, "$lt": lambda: c < v, "$lte": lambda: c <= v, "$in": lambda: c.isin(list(v)), "$nin": lambda: ~F.coalesce(c.isin(list(v)), F.lit(False)), "$exists": lambda: c.isNotNull() if v else c.isNull(), "$regex": lambda: c.rlike(v)}
    if op == "$not":
        return ~F.coalesce(reduce(lambda a, b: a & b, [_operator(c, o, x) for o, x in v.items()]), F.lit(False))
    if op not in simple:
        raise RequestError(f"unknown operator {op}")
    return simple[op]()


def mongodb_find_frame(collection: DataFrame, request: Mapping) -> DataFrame:
    options = request.get("options", {})
    df = collection.filter(document_filter(request.get("filter", {})))
    if sort := options.get("sort"):
        df = df.orderBy(*[F.col(k).asc() if d >= 0 else F.col(k).desc() for k, d in sort.items()])
    if skip := options.get("skip"):
        df = df.offset(skip)
    if limit := options.get("limit"):
        df = df.limit(limit)
    if projection := options.get("projection"):
        shown = [k for k, x in projection.items() if x]
        df = df.select(*shown) if shown else df.drop(*projection)
    return df


_FIND = {"uri", "auth", "database", "collection", "options", "canonical"}


def mongodb_find(collection: DataFrame, request: Mapping) -> dict:
    _checked(request, {"filter"}, _FIND)
    return _run("mongodb.find", request, lambda: {"results": _rows(mongodb_find_frame(collection, request), True)})


def mongodb_find_one(collection: DataFrame, request: Mapping) -> dict:
    _checked(request, {"filter"}, _FIND)

    def compute() -> dict:
        found = _rows(mongodb_find_frame(collection, request).limit(1), True)
        return {"results": found[0]} if found else {}

    return _run("mongodb.find_one", request, compute)


def neo4j_query(run: Callable[[str, Mapping], DataFrame], request: Mapping) -> dict:
    """``run(query, parameters)`` reads rows, e.g. through a connector; ``{"results": [row maps]}``."""
    _checked(request, {"query"}, {"uri", "auth", "parameters", "database"})
    return _run("neo4j.query", request, lambda: {"results": _rows(run(request["query"], request.get("parameters", {})), True)})


def vault_send(read: Callable[[str, str], Mapping], request: Mapping) -> dict:
    """``{"data": {...}}`` of a key-value secret; the whole request is the cache key."""
    _checked(request, {"kv2_get"}, {"address", "token", "app_role"})
    get = request["kv2_get"]
    return _run("vault.send", request, lambda: {"data": dict(read(get["mount_path"], get["path"]))})


# -- values by key, as in Redis: Columns over stored strings, lists, hashes (maps) and sets (arrays)
def _sorted(c: Column) -> Column:
    return F.array_sort(c)


REDIS: dict[str, Callable[..., Column]] = {
    "get": lambda v: v,
    "getrange": lambda v, a, b: _bytes_between(v, a, b),
    "strlen": lambda v: F.octet_length(v),
    "mget": lambda *vs: F.array(*vs),
    "lindex": lambda v, i: F.get(v, F.lit(i) if i >= 0 else F.size(v) + i),
    "llen": lambda v: F.size(v),
    "lrange": lambda v, a, b: F.slice(v, _from(v, a) + 1, F.greatest(F.least(_from(v, b), F.size(v) - 1) - _from(v, a) + 1, F.lit(0))),
    "lpos": lambda v, x: F.nullif(F.array_position(v, F.lit(x)), F.lit(0)) - 1,
    "hget": lambda v, k: F.try_element_at(v, F.lit(k)),
    "hgetall": lambda v: v,
    "hexists": lambda v, k: F.map_contains_key(v, F.lit(k)),
    "hkeys": lambda v: _sorted(F.map_keys(v)),
    "hlen": lambda v: F.size(v),
    "hmget": lambda v, *ks: F.array(*[F.try_element_at(v, F.lit(k)) for k in ks]),
    "hrandfield": lambda v: F.get(F.shuffle(F.map_keys(v)), F.lit(0)),
    "scard": lambda v: F.size(v),
    "sdiff": lambda v, *o: _sorted(reduce(F.array_except, o, v)),
    "sinter": lambda v, *o: _sorted(reduce(F.array_intersect, o, v)),
    "sintercard": lambda v, *o: F.size(reduce(F.array_intersect, o, v)),
    "sismember": lambda v, x: F.array_contains(v, F.lit(x)),
    "smembers": lambda v: _sorted(v),
    "smismember": lambda v, *xs: F.array(*[F.array_contains(v, F.lit(x)) for x in xs]),
    "srandmember": lambda v: F.get(F.shuffle(v), F.lit(0)),
    "sunion": lambda v, *o: _sorted(reduce(F.array_union, o, v)),
}


def _bytes_between(v: Column, a: int, b: int) -> Column:
    """Bytes a to b, both included; negative places count from the end."""
    n = F.octet_length(v)
    place = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    data = F.substring(v.cast("binary"), place(a) + 1, F.greatest(F.least(place(b), n - 1) - place(a) + 1, F.lit(0)))
    return F.decode(data, "UTF-8")


def _from(v: Column, i: int) -> Column:
    return F.lit(i) if i >= 0 else F.greatest(F.size(v) + i, F.lit(0))


def redis_query(store: Mapping[str, Column], one_row: DataFrame, request: Mapping) -> dict:
    """``{"results": value}``. ``store`` names a Column of ``one_row`` for each key; commands of several keys take them all."""
    _checked(request, {"command", "args"}, {"addr", "auth", "db"})
    command, args = request["command"].lower(), list(request["args"])
    if command not in REDIS:
        raise RequestError(f"command {command} is not allowed")

    def compute() -> dict:
        n = len(args) if command in ("mget", "sdiff", "sinter", "sunion", "sintercard") else 1
        keys = [store.get(k, F.lit(None)) for k in args[:n]]
        value = one_row.select(REDIS[command](*keys, *args[n:]).alias("v")).first()[0]
        return {"results": value}

    return _run("redis.query", request, compute)
