"""Functions as columns give what the same functions give on values."""

import pytest
from pyspark.sql import functions as F

from lodestar.functions.scalar import COLUMNS
from lodestar.functions.values import BUILTINS
from lodestar.plans.relational import Planner, Table

TEXTS = ["", "a", "abcabc", "  padded ", "a/b//c", "x*y~z w+é", "**star**", "aaaa", "-1.5h", "Zürich 12, 7", "preabcpost"]
NUMBERS = [0, 1, 7, 255, -3, 1 << 40]
STAMPS = [0, 1, -1, 1_700_000_000_123_456_789, 86_399_999_999_999, -86_400_000_000_001, 951_782_400 * 10**9]
CASES = [
    *[(n, (t,)) for n in ("crypto.md5", "crypto.sha1", "crypto.sha256", "hex.encode", "base64url.encode", "base64url.encode_no_pad", "urlquery.encode", "strings.reverse") for t in TEXTS],
    *[(n, (t, x)) for n in ("split", "indexof", "indexof_n", "strings.count", "trim_prefix", "trim_suffix") for t in TEXTS for x in ("a", "abc", "/", "*", "aa")],
    *[(n, (t, x)) for n in ("trim", "trim_left", "trim_right") for t in TEXTS for x in ("a", " *", "ca")],
    *[("substring", (t, a, n)) for t in TEXTS for a, n in ((0, 2), (1, -1), (3, 100))],
    *[("regex.replace", (t, "(a)(b)", "$2-$1")) for t in TEXTS],
    *[("regex.split", ("[/,]", t)) for t in TEXTS],
    *[("regex.find_n", ("[a-c]+", t, n)) for t in TEXTS for n in (-1, 0, 1)],
    *[(n, (a, b)) for n in ("bits.and", "bits.or", "bits.xor") for a in NUMBERS for b in (3, 255)],
    *[(n, (a, 3)) for n in ("bits.lsh", "bits.rsh") for a in NUMBERS],
    *[("bits.negate", (a,)) for a in NUMBERS],
    *[("format_int", (abs(a), b)) for a in NUMBERS for b in (2, 8, 10, 16)],
    *[(n, (x,)) for n in ("time.date", "time.clock", "time.weekday") for x in STAMPS],
    *[("time.parse_rfc3339_ns", (t,)) for t in ("1970-01-01T00:00:00Z", "2024-02-29T23:59:59.5Z", "2024-02-29T23:59:59.123456789+02:30", "1969-12-31T23:59:59Z")],
    *[("time.parse_duration_ns", (t,)) for t in ("1h30m", "-2s", "1.5ms", "3us4ns", "2m")],
    *[("strings.any_prefix_match", (["abc", "xyz"], [p, "q"])) for p in ("ab", "yz", "")],
    *[("strings.any_suffix_match", (["abc", "xyz"], [p, "q"])) for p in ("ab", "yz", "")],
    *[("all", (xs,)) for xs in ([True, True], [True, False])],
    *[("any", (xs,)) for xs in ([True, False], [False, False])],
]


def _lit(v):
    return F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)


def test_columns_equal_values(spark):
    for at in range(0, len(CASES), 80):  # one wide row at a time
        part = CASES[at : at + 80]
        row = spark.range(1).select(*[COLUMNS[n](*map(_lit, args)).alias(f"c{i}") for i, (n, args) in enumerate(part)]).first()
        for i, (n, args) in enumerate(part):
            assert row[i] == BUILTINS[n](*args), (n, args)


@pytest.mark.parametrize("name", ["hex", "base64url", "urlquery"])
def test_round_trips(spark, name):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", COLUMNS[f"{name}.decode"](COLUMNS[f"{name}.encode"](F.col("t"))).alias("back"))
    assert all(r.t == r.back for r in df.collect())


def test_bad_texts_are_undefined(spark):
    row = spark.range(1).select(COLUMNS["time.parse_rfc3339_ns"](F.lit("yesterday")), COLUMNS["time.parse_duration_ns"](F.lit("1 day")), COLUMNS["base64url.decode"](F.lit("%%%%"))).first()
    assert list(row) == [None, None, None]


def test_kinds_in_plans(spark):
    rule = """
package kinds

seen contains {"id": r.id, "text": is_string(r.name), "list": is_array(r.tags), "dyn": is_number(r.doc), "obj": is_object(r.part)} if some r in data.rows
"""
    rows = spark.sql("SELECT 1 AS id, 'a' AS name, array(1) AS tags, parse_json('3') AS doc, named_struct('x', 1) AS part UNION ALL SELECT 2, NULL, array(2), parse_json('[3]'), named_struct('x', 2)")
    got = {r.id: (r.text, r.list, r.dyn, r.obj) for r in Planner([rule], {"rows": Table(rows, "id")}).relation("kinds.seen").collect()}
    assert got == {1: (True, True, True, True), 2: (None, True, False, True)}
