import pytest
from pyspark.sql import functions as F

from lodestar.functions.values import Set, Undefined
from lodestar.plans.conditions import Always
from lodestar.plans.evaluate import ConflictError, Engine, compile_filter
from lodestar.plans.relational import Planner, Table
from lodestar.plans.rules import RuleSyntaxError, parse_module
from lodestar.plans.targets import FragmentError

POLICY = """
# a policy
package shop

import data.limits as lim

default allow := false

allow if {
    zone := data.staff[input.who]   # lookup
    input.door in data.doors[zone]
}

allow if input.who == "porter"

kinds contains x if some x in ["b", "a", "b"]

sizes[k] := count(v) if some k, v in {"x": [1, 2], "y": []}

nested[a][b] := a + b if { some a in [1, 2]; some b in [10] }

grade(x) := "high" if x > lim.top

else := "mid" if {
    x > 5
} else := "low"

level := grade(input.n)

evens := [x | some x in numbers.range(1, 6); x % 2 == 0]

index := {k: v | some v, k in ["p", "q"]}

pairs contains [i, x] if some i, x in ["u", "w"]

all_small if every x in input.xs { x < 10 }

none_big if not any_big

any_big if some x in input.xs with input.xs as [1, 2]

text := sprintf("%s-%d %v", ["a", 7, [1, "b"]])

clash := 1 if input.a

clash := 2 if input.b

dup[k] := v if { some v in [1, 2]; k := "same" }

up := upper(concat("/", {"b", "a"}))

tagged if "x" in input.tags

has_entry if "k", 3 in {"k": 3}

ranges := array.slice(numbers.range(5, 1), 1, 3)
"""
DATA = {"staff": {"ann": "lab"}, "doors": {"lab": ["north", "east"]}, "limits": {"top": 10}}


@pytest.fixture(scope="module")
def engine():
    return Engine([POLICY], DATA)


@pytest.mark.parametrize(
    "path, given, want",
    [
        ("allow", {"who": "ann", "door": "east"}, True),
        ("allow", {"who": "ann", "door": "west"}, False),
        ("allow", {"who": "porter"}, True),
        ("kinds", None, ["a", "b"]),
        ("sizes", None, {"x": 2, "y": 0}),
        ("nested", None, {1: {10: 11}, 2: {10: 12}}),
        ("level", {"n": 11}, "high"),
        ("level", {"n": 6}, "mid"),
        ("level", {"n": 1}, "low"),
        ("evens", None, [2, 4, 6]),
        ("index", None, {"p": 0, "q": 1}),
        ("pairs", None, [[0, "u"], [1, "w"]]),
        ("all_small", {"xs": [1, 2]}, True),
        ("text", None, 'a-7 [1, "b"]'),
        ("up", None, "A/B"),
        ("tagged", {"tags": Set(["x"])}, True),
        ("has_entry", None, True),
        ("ranges", None, [4, 3]),
        ("clash", {"a": True}, 1),
    ],
)
def test_values(engine, path, given, want):
    assert engine.query(f"data.shop.{path}", given) == want


@pytest.mark.parametrize("path, given", [("all_small", {"xs": [1, 20]}), ("level", {}), ("tagged", {}), ("nothing", {}), ("none_big", {"xs": []})])
def test_undefined(engine, path, given):
    with pytest.raises(Undefined):
        engine.query(f"data.shop.{path}", given)


def test_conflicts(engine):
    with pytest.raises(ConflictError):
        engine.query("data.shop.clash", {"a": True, "b": True})
    with pytest.raises(ConflictError):
        engine.query("data.shop.dup")


def test_syntax_errors_name_the_line():
    with pytest.raises(RuleSyntaxError, match="line 4"):
        parse_module("package a\n\nallow if {{\n")
    with pytest.raises(RuleSyntaxError):
        parse_module("allow := true")


FILTERS = """
package filters

# METADATA
# scope: document
# compile:
#   unknowns: ["input.fruits", "input.users"]
#   mask_rule: mask
include if input.users.name == input.username

include if {
    input.fruits.colour in data.liked[input.username]
    not input.fruits.price > 10
    startswith(input.fruits.name, "a_")
}

include if 3 <= input.fruits.price
mask.users.phone.replace.value := "<phone>"
yes if input.username == "jane"
bare if input.fruits.ripe
call if lower(input.fruits.name) == "x"
member if "x" in input.fruits.tags
two if input.fruits.a == input.fruits.b
"""


@pytest.fixture(scope="module")
def filters():
    return Engine([FILTERS], {"liked": {"jane": ["red", "green"]}})


def test_partial_evaluation(filters):
    got = compile_filter(filters, "data.filters.include", {"username": "jane"}, [("sql", "postgresql"), ("ucast", "all")])
    assert got["postgresql"]["query"] == (
        "WHERE (users.name = E'jane' OR (fruits.colour IN (E'red', E'green') AND NOT fruits.price > 10 AND fruits.name LIKE E'a\\\\_%') OR fruits.price >= 3)"
    )
    assert got["ucast"]["masks"] == {"users": {"phone": {"replace": {"value": "<phone>"}}}}
    bob = filters.condition("data.filters.include", {"username": "bob"})
    assert bob.sql() == "(users.name = 'bob' OR fruits.price >= 3)"


def test_unconditional_answers(filters):
    assert compile_filter(filters, "data.filters.yes", {"username": "jane"}, ("sql", "mysql"), ["input.fruits"])["query"] == ""
    assert compile_filter(filters, "data.filters.yes", {"username": "jane"}, ("ucast", "all"), ["input.fruits"])["query"] == {}
    assert compile_filter(filters, "data.filters.yes", {"username": "x"}, unknowns=["input.fruits"]) == {}
    assert filters.condition("data.filters.two", {}) != Always(True)


@pytest.mark.parametrize("rule", ["bare", "call", "member"])
def test_outside_the_fragment(filters, rule):
    unknowns = ["input.fruits"]
    with pytest.raises(FragmentError):
        compile_filter(filters, f"data.filters.{rule}", {}, unknowns=unknowns)
    got = compile_filter(filters, f"data.filters.{rule}", {}, unknowns=unknowns, raise_error=False)
    assert got["error"]["code"] == "pe_fragment_error"


def test_filtering_equals_direct_evaluation(spark, filters):
    fruits = [("a_1", "red", 5), ("a_2", "blue", 1), ("b", "green", 2), ("a_3", "green", 2), ("c", "red", 20)]
    users = ["jane", "john"]
    df = spark.createDataFrame([(*f, u) for f in fruits for u in users], "name string, colour string, price int, owner string")
    names = {"fruits.name": "name", "fruits.colour": "colour", "fruits.price": "price", "users.name": "owner"}
    for who in ("jane", "john", "zed"):
        cond = filters.condition("data.filters.include", {"username": who})
        got = {tuple(r) for r in df.filter(cond.column(lambda f: F.col(names[f]))).collect()}
        want = {(*f, u) for f in fruits for u in users if filters.query("data.filters.include", {"username": who, "fruits": dict(zip(("name", "colour", "price"), f, strict=True)), "users": {"name": u}}, None)}
        assert got == want


def test_rule_as_column(spark, engine):
    df = spark.createDataFrame([(1,), (6,), (11,), (None,)], "n int")
    assert [r.v for r in df.select(engine.column("data.shop.level", {}, ["input"]).alias("v")).collect()] == ["low", "mid", "high", "low"]


ROWS = """
package rows

default ok := "no"

ok := "yes" if {
    some r in data.grants[input.user]
    r == input.role
}

banned contains u.name if { some u in data.people; u.bad }

fine contains u.name if { some u in data.people; not u.name in banned }

tags contains {"n": u.name, "t": x} if { some u in data.people; some x in u.tags; x != "skip" }

lengths[u.name] := n if { some u in data.people; n := count(u.tags) }

long contains u.name if { some u in data.people; every x in u.tags { count(x) > 1 } }

picked contains {"n": u.name, "t": ys} if { some u in data.people; ys := [upper(x) | some x in u.tags; x != "skip"] }
"""


def test_planned_rules(spark):
    people = spark.createDataFrame([("ann", False, ["ab", "skip"]), ("bob", True, ["x"]), ("cy", None, [])], "name string, bad boolean, tags array<string>")
    grants = spark.createDataFrame([("ann", ["r1", "r2"]), ("bob", [])], "user string, roles array<string>")
    p = Planner([ROWS], {"people": Table(people, "name"), "grants": Table(grants, "user")})
    rows = lambda name: sorted(tuple(r) for r in p.relation(f"rows.{name}").collect())
    assert rows("banned") == [("bob",)] and rows("fine") == [("ann",), ("cy",)]
    assert rows("tags") == [("ann", "ab"), ("bob", "x")]
    assert rows("lengths") == [("ann", 2), ("bob", 1), ("cy", 0)]
    assert rows("long") == [("ann",), ("cy",)]
    assert rows("picked") == [("ann", ["AB"]), ("bob", ["X"]), ("cy", [])]
    asked = spark.createDataFrame([(1, "ann", "r2"), (2, "ann", "r9"), (3, "zed", "r1")], "id int, user string, role string")
    got = p.decide("rows.ok", asked, ["id"])
    assert {r.id: r.decision for r in got.collect()} == {1: "yes", 2: "no", 3: "no"}
    assert "Join" in got._jdf.queryExecution().toString()


GATHERED = """
package stock

names[r.r_name] := [n.n_name | some n in data.nation; n.n_regionkey == r.r_regionkey] if some r in data.region

codes contains {"region": r.r_name, "codes": {n.n_nationkey % 3 | some n in data.nation; n.n_regionkey == r.r_regionkey}} if some r in data.region

totals contains {"region": r.r_name, "n": count([1 | some n in data.nation; n.n_regionkey == r.r_regionkey]), "top": t} if {
    some r in data.region
    t := max({n.n_nationkey | some n in data.nation; n.n_regionkey == r.r_regionkey})
}

whole contains {"region": r.r_name, "all": sum([n.n_nationkey | some n in data.nation])} if some r in data.region

by_name contains {"region": r.r_name, "keys": {n.n_name: n.n_nationkey | some n in data.nation; n.n_regionkey == r.r_regionkey}} if some r in data.region

wide if count({n.n_name | some n in data.nation; n.n_regionkey == input.region}) > input.least

wide_with if {
    first := input.least
    count({n.n_name | some n in data.nation; n.n_regionkey == input.region}) > input.least with input.least as 2
    first == input.least
}

other contains n.n_name if {
    some r in data.region
    some n in data.nation with data.nation as data.small
    n.n_regionkey == r.r_regionkey
}
"""


def _gathered(spark):
    region = spark.createDataFrame([(0, "north"), (1, "south"), (2, "empty"), (None, "nowhere")], "r_regionkey long, r_name string")
    nation = spark.createDataFrame([(4, "d", 0), (1, "a", 0), (2, "z", 1), (3, "c", 0), (9, None, 1)], "n_nationkey long, n_name string, n_regionkey long")
    tables = {"region": Table(region, "r_name"), "nation": Table(nation, "n_nationkey"), "small": Table(nation.filter("n_nationkey < 3"), "n_nationkey")}
    return Planner([GATHERED], tables)


def test_comprehensions_over_tables_are_grouped_by_the_outer_values(spark):
    p = _gathered(spark)
    got = {r.key: r.value for r in p.relation("stock.names").collect()}
    assert got == {"north": ["a", "c", "d"], "south": ["z"], "empty": [], "nowhere": []}
    assert {r.region: r.codes for r in p.relation("stock.codes").collect()} == {"north": [0, 1], "south": [0, 2], "empty": [], "nowhere": []}
    assert {r.region: (r.n, r.top) for r in p.relation("stock.totals").collect()} == {"north": (3, 4), "south": (2, 9)}
    assert {r.region: r.all for r in p.relation("stock.whole").collect()} == dict.fromkeys(["north", "south", "empty", "nowhere"], 19)
    assert {r.region: r["keys"] for r in p.relation("stock.by_name").collect()}["north"] == {"a": 1, "c": 3, "d": 4}


def test_comprehensions_over_tables_and_with_in_decisions(spark):
    p = _gathered(spark)
    inputs = spark.createDataFrame([(1, 0, 1), (2, 0, 5), (3, 1, 0), (4, None, 0), (5, 2, 0)], "id long, region long, least long")
    assert {r.id: r.decision for r in p.decide("stock.wide", inputs, ["id"]).collect()} == {1: True, 2: None, 3: True, 4: None, 5: None}
    assert {r.id: r.decision for r in p.decide("stock.wide_with", inputs, ["id"]).collect()} == {1: True, 2: True, 3: None, 4: None, 5: None}
    assert sorted(r.value for r in p.relation("stock.other").collect()) == ["a", "z"]
