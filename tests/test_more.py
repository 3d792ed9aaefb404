import pytest

from lodestar.functions.values import Set, call
from lodestar.plans.evaluate import Engine, evaluate_modules
from lodestar.plans.testing import filter_rows, with_where


@pytest.mark.parametrize(
    "name, args, want",
    [
        ("bits.xor", [5, 3], 6), ("crypto.sha256", ["a"], "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"), ("hex.decode", ["6869"], "hi"),
        ("base64url.decode", ["aGk_"], "hi?"), ("json.filter", [{"a": {"b": 1, "c": 2}}, ["a/b"]], {"a": {"b": 1}}), ("json.remove", [{"a": {"b": 1, "c": 2}}, ["a/b"]], {"a": {"c": 2}}),
        ("object.subset", [{"a": [1, 2, 3]}, {"a": [2, 3]}], True), ("object.subset", [Set([1]), Set([2])], False), ("regex.replace", ["ab12", r"(\d)(\d)", "$2$1"], "ab21"),
        ("regex.find_n", ["a.", "abac", -1], ["ab", "ac"]), ("graph.reachable", [{"a": ["b"], "b": ["a"], "c": []}, ["a"]], ["a", "b"]), ("net.cidr_contains", ["10.0.0.0/8", "10.1.2.3"], True),
        ("semver.compare", ["1.10.0", "1.9.3"], 1), ("semver.compare", ["1.0.0-a.2", "1.0.0-a.10"], -1), ("semver.is_valid", ["1.0"], False), ("units.parse", ["10m"], 0.01), ("units.parse_bytes", ["1.5KiB"], 1536),
        ("time.parse_rfc3339_ns", ["1970-01-01T00:00:01.5Z"], 1_500_000_000), ("time.parse_duration_ns", ["1m30s"], 90_000_000_000), ("time.weekday", [0], "Thursday"), ("indexof_n", ["abab", "b"], [1, 3]),
        ("strings.replace_n", [{"a": "1", "b": "2"}, "abc"], "12c"), ("union", [[Set([1]), Set([2])]], [1, 2]), ("rem", [7, 4], 3), ("format_int", [255, 16], "ff"), ("substring", ["hello", 1, -1], "ello"),
    ],
)
def test_builtins(name, args, want):
    assert call(name, args) == want


def test_modules_as_data():
    assert evaluate_modules({"module": "package a\nb := input.x + 1", "path": "a/b", "input": {"x": 1}}) == {"result": 2}
    assert evaluate_modules({"module": "package a\nb := input.x + 1", "path": "a/b"}) == {}
    assert "error" in evaluate_modules({"module": "nope", "path": "a", "raise_error": False})


RULES = """
package desk

# METADATA
# compile:
#   unknowns: [input.orders, input.customer]
#   mask_rule: hidden
open if {
    input.orders.state == "O"
    input.customer.segment in input.segments
}

worth if input.orders.total >= input.least

everything := true

hidden.customer.balance.replace.value := 0

hidden.orders.clerk.replace.value := "n/a"
"""


def test_filter_rows(spark):
    engine = Engine([RULES])
    customer = spark.createDataFrame([(7, "BUILDING", 120.5), (8, "MACHINERY", -3.0), (9, "BUILDING", 0.5)], "ckey int, segment string, balance double")
    orders = [{"okey": 100 + i, "ckey": 7 + i % 3, "state": "OF"[i % 2], "total": 50 * i, "clerk": f"c{i}"} for i in range(6)]
    select = "SELECT orders.okey, customer.balance, orders.clerk FROM customer JOIN orders ON orders.ckey = customer.ckey"
    unknowns = ["input.orders", "input.customer"]
    run = lambda rule, given: sorted(map(tuple, filter_rows(spark, engine, f"data.desk.{rule}", select, {"orders": orders, "customer": customer}, given, unknowns=unknowns).collect()))
    assert run("open", {"segments": ["BUILDING"]}) == [(100, 0.0, "n/a"), (102, 0.0, "n/a")]
    assert run("open", {"segments": []}) == []
    assert [r[0] for r in run("worth", {"least": 200})] == [104, 105]
    assert len(run("everything", {})) == 6


def test_where_is_added_to_what_is_there():
    assert with_where("SELECT 1 FROM t WHERE a OR b ORDER BY x", "c = 1") == "SELECT 1 FROM t WHERE (a OR b) AND (c = 1) ORDER BY x"
    assert with_where("SELECT 1 FROM t LIMIT 3", "c = 1") == "SELECT 1 FROM t WHERE c = 1 LIMIT 3"
    assert with_where("SELECT 1", "") == "SELECT 1"
