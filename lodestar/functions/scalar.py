"""The rule language's functions as Spark columns: all built-in expressions, none in Python.

Undefined is NULL. Sets are arrays kept sorted and distinct; objects are maps (or structs, by field name).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions.patterns import glob_to_regex

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _const(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def as_set(xs: ColumnLike) -> Column:
    return F.array_sort(F.array_distinct(_c(xs)))


def member(x: ColumnLike, xs: ColumnLike) -> Column:
    """x in array or set."""
    return F.array_contains(_c(xs), _const(x) if not isinstance(x, str) else F.col(x))


def member_of_map(x: Column, m: ColumnLike) -> Column:
    return F.array_contains(F.map_values(_c(m)), x)


def member_pair(k: Column, v: Column, m: ColumnLike) -> Column:
    """``k, v in m``: the entry at k is there and equals v."""
    return F.map_contains_key(_c(m), k) & F.try_element_at(_c(m), k).eqNullSafe(v)


def object_get(m: ColumnLike, path: Sequence, default: Column) -> Column:
    out = _c(m)
    for k in path:
        out = F.try_element_at(out, _const(k))
    return F.coalesce(out, default)


def object_keys(m: ColumnLike) -> Column:
    return F.array_sort(F.map_keys(_c(m)))


def object_remove(m: ColumnLike, keys: Column) -> Column:
    return F.map_filter(_c(m), lambda k, _: ~F.array_contains(keys, k))


def object_filter(m: ColumnLike, keys: Column) -> Column:
    return F.map_filter(_c(m), lambda k, _: F.array_contains(keys, k))


def object_union(a: ColumnLike, b: ColumnLike) -> Column:
    """One level of maps; the right side wins, also with a null value."""
    left, right = _c(a), _c(b)
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def struct_union(a: Column, a_fields: Sequence[str], b: Column, b_fields: Sequence[str]) -> Column:
    """Structs: all fields of b, then those of a alone."""
    return F.struct(*[a[f].alias(f) for f in a_fields if f not in b_fields], *[b[f].alias(f) for f in b_fields])


def concat(sep: str, xs: ColumnLike, is_set: bool = False) -> Column:
    return F.array_join(as_set(xs) if is_set else _c(xs), sep)


def sprintf(fmt: str, *args: ColumnLike) -> Column:
    """%v becomes %s; the other verbs mean the same in both worlds."""
    return F.format_string(re.sub(r"%([-+ 0#]*\d*(?:\.\d+)?)v", r"%\1s", fmt), *map(_c, args))


def array_concat(a: ColumnLike, b: ColumnLike) -> Column:
    return F.concat(_c(a), _c(b))


def array_slice(a: ColumnLike, start: Column | int, stop: Column | int) -> Column:
    a, start, stop = _c(a), _const(start), _const(stop)
    low = F.greatest(start, F.lit(0))
    return F.slice(a, low + 1, F.greatest(F.least(stop, F.size(a)) - low, F.lit(0)))


def numbers_range(a: ColumnLike, b: ColumnLike) -> Column:
    return F.sequence(_c(a), _c(b))


def numbers_range_step(a: ColumnLike, b: ColumnLike, step: int) -> Column:
    if step <= 0:
        raise ValueError("step must be positive")
    a, b = _c(a), _c(b)
    return F.sequence(a, b, F.when(a <= b, F.lit(step)).otherwise(F.lit(-step)))


def glob_match(pattern: str, delimiters: Sequence[str] | None, s: ColumnLike) -> Column:
    return _c(s).rlike(f"^(?:{glob_to_regex(pattern, delimiters)})$")


def substring(s: ColumnLike, start: int, length: int = -1) -> Column:
    if start < 0:
        raise ValueError("negative offset")
    return F.substring(_c(s), start + 1, length if length >= 0 else 2**31 - 1)


def split(s: ColumnLike, sep: str) -> Column:
    return F.split(_c(s), re.escape(sep) if sep else "")


def indexof(s: ColumnLike, x: str) -> Column:
    return F.instr(_c(s), F.lit(x)) - 1


def format_int(n: ColumnLike, base: int) -> Column:
    return F.lower(F.conv(_c(n).cast("long").cast("string"), 10, base))


def type_name(v: ColumnLike) -> Column:
    """The type of a VARIANT."""
    kind = F.schema_of_variant(_c(v))
    return (
        F.when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number")
    )


def parse_json(s: ColumnLike) -> Column:
    return F.try_parse_json(_c(s))


def set_union(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_sort(F.array_union(_c(a), _c(b)))


def set_intersection(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_sort(F.array_intersect(_c(a), _c(b)))


def set_difference(a: ColumnLike, b: ColumnLike) -> Column:
    return F.array_sort(F.array_except(_c(a), _c(b)))


def array_sum(xs: ColumnLike) -> Column:
    return F.aggregate(_c(xs), F.lit(0.0), lambda a, x: a + x)


def array_product(xs: ColumnLike) -> Column:
    return F.aggregate(_c(xs), F.lit(1.0), lambda a, x: a * x)


def cidr_contains(cidr: str, ip: ColumnLike) -> Column:
    """IPv4: whether an address lies in a network given at plan time."""
    network, _, bits = cidr.partition("/")
    number = 0
    for part in network.split("."):
        number = number << 8 | int(part)
    shift = 32 - int(bits or 32)
    parts = F.split(_c(ip), r"\.")
    value = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("long") * (1 << 8 * (3 - i)) for i in range(4)), F.lit(0).cast("long"))
    return F.shiftright(value, shift) == (number >> shift)


def semver_compare(a: ColumnLike, b: ColumnLike) -> Column:
    """-1, 0 or 1 of major.minor.patch; a pre-release comes before its release."""

    def key(x: Column) -> Column:
        core = F.split(F.regexp_replace(x, r"[-+].*$", ""), r"\.")
        pre = F.regexp_extract(x, r"^[^-+]*-([^+]*)", 1)
        return F.struct(*[F.try_element_at(core, F.lit(i)).try_cast("int").alias(f"n{i}") for i in (1, 2, 3)], (pre == "").alias("release"), pre.alias("pre"))

    x, y = key(_c(a)), key(_c(b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


#: Unit prefixes.
_UNITS = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40}


def units_parse_bytes(s: ColumnLike) -> Column:
    low = F.lower(F.trim(_c(s)))
    unit = F.regexp_extract(low, r"^[0-9.]+\s*([a-z]*?)b?$", 1)
    factor = F.coalesce(*[F.when(unit == k, F.lit(v)) for k, v in _UNITS.items()])
    return (F.regexp_extract(low, r"^([0-9.]+)", 1).try_cast("double") * factor).cast("long")


def split_at(s: Column, sep: Column) -> Column:
    """Parts of a text; single characters for an empty separator."""
    return F.when(sep == "", F.split(s, F.lit(""))).otherwise(F.split(s, F.concat(F.lit("\\Q"), sep, F.lit("\\E"))))


def count_of(s: Column, x: Column) -> Column:
    """Occurrences that don't overlap; an empty text lies between all characters."""
    n = F.call_function("div", F.length(s) - F.length(F.replace(s, x, F.lit(""))), F.nullif(F.length(x), F.lit(0)))
    return F.coalesce(n, F.length(s) + 1)


def positions(s: Column, x: Column) -> Column:
    """Every place where x begins."""
    last = F.length(s) - F.length(x)
    return F.when(last < 0, F.array().cast("array<int>")).otherwise(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.substring(s, i + 1, F.length(x)) == x))


def found(p: Column, s: Column, n: Column) -> Column:
    """The first n matches of a pattern, or all where n is negative."""
    every = F.regexp_extract_all(s, p, F.lit(0))
    return F.when(n < 0, every).otherwise(F.slice(every, F.lit(1), F.greatest(n, F.lit(0))))


def some_pair(test: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
    return lambda xs, ys: F.exists(xs, lambda x: F.exists(ys, lambda y: test(x, y)))


_DAY = 86400 * 10**9


def _whole(ns: Column, unit: int) -> Column:
    """Units since the epoch, rounded down, in whole numbers."""
    return F.call_function("div", ns - F.pmod(ns, F.lit(unit)), F.lit(unit))


def day_of(ns: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), _whole(ns, _DAY).cast("int"))


def date_parts(ns: Column) -> Column:
    """[year, month, day] in UTC."""
    return F.array(F.year(day_of(ns)), F.month(day_of(ns)), F.day(day_of(ns)))


def clock_parts(ns: Column) -> Column:
    """[hour, minute, second] in UTC."""
    second = _whole(F.pmod(ns, F.lit(_DAY)), 10**9)
    return F.array(F.call_function("div", second, F.lit(3600)), F.call_function("div", second % 3600, F.lit(60)), second % 60)


def rfc3339_ns(s: Column) -> Column:
    """Nanoseconds since the epoch; NULL for other texts."""
    shape = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.(\d{1,9}))?(?:Z|[+-]\d\d:\d\d)$"
    seconds = F.unix_seconds(F.regexp_replace(s, r"\.\d+", "").try_cast("timestamp"))
    fraction = F.rpad(F.regexp_extract(s, shape, 1), 9, "0").cast("long")
    return F.when(F.rlike(s, F.lit(shape)), seconds * F.lit(10**9) + fraction)


#: Units of durations, in nanoseconds.
_DURATIONS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}


def duration_ns(s: Column) -> Column:
    """Nanoseconds of ``1h30m``; NULL for other texts."""
    number = r"(\d+(?:\.\d+)?)"
    total = F.lit(0.0)
    for unit, n in _DURATIONS.items():
        total = total + n * F.aggregate(F.regexp_extract_all(s, F.lit(rf"{number}{unit}(?![a-z])"), F.lit(1)), F.lit(0.0), lambda a, x: a + x.cast("double"))
    sign = F.when(s.startswith("-"), -1).otherwise(1)
    return F.when(F.rlike(s, F.lit(rf"^-?(?:{number}(?:ns|us|ms|s|m|h))+$")), (sign * total).cast("long"))


def _url64(s: Column) -> Column:
    return F.translate(F.base64(F.encode(s, "UTF-8")), "+/", "-_")


def _text(b: Column) -> Column:
    return F.decode(b, "UTF-8")


#: Functions of the rule planner: name -> builder over Columns.
COLUMNS: dict[str, Callable[..., Column]] = {
    "equal": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "plus": lambda a, b: a + b,
    "minus": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: F.try_divide(a, b),
    "rem": lambda a, b: a % b,
    "or": set_union,
    "and": set_intersection,
    "abs": F.abs,
    "ceil": F.ceil,
    "floor": F.floor,
    "round": F.round,
    "lower": F.lower,
    "upper": F.upper,
    "trim_space": F.trim,
    "contains": lambda s, x: s.contains(x),
    "startswith": lambda s, x: s.startswith(x),
    "endswith": lambda s, x: s.endswith(x),
    "concat": lambda sep, xs: F.call_function("array_join", xs, sep),
    "replace": lambda s, a, b: F.replace(s, a, b),
    "array.concat": F.concat,
    "array.slice": array_slice,
    "array.reverse": F.reverse,
    "numbers.range": F.sequence,
    "object.keys": object_keys,
    "object.remove": object_remove,
    "object.filter": object_filter,
    "object.union": object_union,
    "union": lambda xs: as_set(F.flatten(xs)),
    "sum": array_sum,
    "product": array_product,
    "max": F.array_max,
    "min": F.array_min,
    "sort": F.array_sort,
    "base64.encode": lambda s: F.base64(s),
    "base64.decode": lambda s: F.try_to_binary(s, F.lit("base64")).cast("string"),
    "json.marshal": F.to_json,
    "json.unmarshal": F.try_parse_json,
    "regex.match": lambda p, s: F.rlike(s, p),
    "to_number": lambda x: x.try_cast("double"),
    "strings.reverse": F.reverse,
    "all": lambda xs: F.forall(xs, lambda x: F.coalesce(x, F.lit(False))),
    "any": lambda xs: F.exists(xs, lambda x: F.coalesce(x, F.lit(False))),
    "intersection": lambda xs: as_set(F.aggregate(xs, F.get(xs, F.lit(0)), F.array_intersect)),
    "split": split_at,
    "indexof": lambda s, x: F.instr(s, x) - 1,
    "indexof_n": positions,
    "substring": lambda s, a, n: F.substring(s, a + 1, F.when(n < 0, F.length(s)).otherwise(n)),
    "trim": lambda s, c: F.trim(s, c),
    "trim_left": lambda s, c: F.ltrim(s, c),
    "trim_right": lambda s, c: F.rtrim(s, c),
    "trim_prefix": lambda s, x: F.when(s.startswith(x), F.substring(s, F.length(x) + 1, F.length(s))).otherwise(s),
    "trim_suffix": lambda s, x: F.when(s.endswith(x), F.substring(s, F.lit(1), F.length(s) - F.length(x))).otherwise(s),
    "format_int": lambda n, base: F.lower(F.call_function("conv", n.cast("long").cast("string"), F.lit(10), base)),
    "strings.count": count_of,
    "strings.any_prefix_match": some_pair(lambda x, y: x.startswith(y)),
    "strings.any_suffix_match": some_pair(lambda x, y: x.endswith(y)),
    "regex.split": lambda p, s: F.split(s, p),
    "regex.replace": lambda s, p, r: F.regexp_replace(s, p, r),
    "regex.find_n": found,
    "bits.and": lambda a, b: a.bitwiseAND(b),
    "bits.or": lambda a, b: a.bitwiseOR(b),
    "bits.xor": lambda a, b: a.bitwiseXOR(b),
    "bits.negate": F.bitwise_not,
    "bits.lsh": lambda a, n: F.call_function("shiftleft", a.cast("long"), n.cast("int")),
    "bits.rsh": lambda a, n: F.call_function("shiftright", a.cast("long"), n.cast("int")),
    "crypto.md5": F.md5,
    "crypto.sha1": F.sha1,
    "crypto.sha256": lambda s: F.sha2(s, 256),
    "hex.encode": lambda s: F.lower(F.hex(F.encode(s, "UTF-8"))),
    "hex.decode": lambda s: _text(F.unhex(s)),
    "base64url.encode": _url64,
    "base64url.encode_no_pad": lambda s: F.rtrim(_url64(s), F.lit("=")),
    "base64url.decode": lambda s: _text(F.try_to_binary(F.concat(F.translate(s, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(s), F.lit(4)))), F.lit("base64"))),
    "urlquery.encode": lambda s: F.replace(F.replace(F.url_encode(s), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")),
    "urlquery.decode": F.try_url_decode,
    "semver.compare": semver_compare,
    "units.parse_bytes": units_parse_bytes,
    "time.date": date_parts,
    "time.clock": clock_parts,
    "time.weekday": lambda ns: F.date_format(day_of(ns), "EEEE"),
    "time.parse_rfc3339_ns": rfc3339_ns,
    "time.parse_duration_ns": duration_ns,
}
