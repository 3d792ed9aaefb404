"""Queries of the engine over the standard tables, each with an independent SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import documents, scalar
from lodestar.operators import analysis, catalog, keyed, relations
from lodestar.plans import conditions, masks
from lodestar.plans.evaluate import Engine, compile_filter
from lodestar.plans.relational import Planner, Table
from lodestar.sources import external
from lodestar.sources.mounts import Mount, Mounts
from lodestar.streaming import events as decision_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filtered(name: str, table: str, tree: dict, columns: list[str], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return conditions.parse(tree).where(t(spark, sf_dir, table)).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {where}")(run)


# -- conditions
_LINE = ["l_orderkey", "l_linenumber", "l_quantity"]
_filtered("filter_eq", "customer", {"type": "field", "operator": "eq", "field": "c_mktsegment", "value": "BUILDING"}, ["c_custkey", "c_mktsegment"], "c_mktsegment = 'BUILDING'")
_filtered("filter_ne", "customer", {"type": "field", "operator": "ne", "field": "c_mktsegment", "value": "BUILDING"}, ["c_custkey", "c_mktsegment"], "c_mktsegment <> 'BUILDING'")
_filtered("filter_lt", "lineitem", {"l_quantity": {"lt": 5}}, _LINE, "l_quantity < 5")
_filtered("filter_lte", "lineitem", {"l_quantity": {"lte": 5}}, _LINE, "l_quantity <= 5")
_filtered("filter_le_synonym", "lineitem", {"l_quantity": {"le": 3}}, _LINE, "l_quantity <= 3")
_filtered("filter_gt", "lineitem", {"l_quantity": {"gt": 45}}, _LINE, "l_quantity > 45")
_filtered("filter_gte", "lineitem", {"l_quantity": {"gte": 45}}, _LINE, "l_quantity >= 45")
_filtered("filter_ge_synonym", "lineitem", {"l_quantity": {"ge": 48}}, _LINE, "l_quantity >= 48")
_filtered("filter_in", "orders", {"o_orderpriority": {"in": ["1-URGENT", "2-HIGH"]}}, ["o_orderkey", "o_orderpriority"], "o_orderpriority IN ('1-URGENT', '2-HIGH')")
_filtered("filter_nin", "orders", {"o_orderpriority": {"nin": ["1-URGENT", "2-HIGH"]}}, ["o_orderkey", "o_orderpriority"], "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
_filtered("filter_startswith", "part", {"p_name": {"startswith": "red b"}}, ["p_partkey", "p_name"], "starts_with(p_name, 'red b')")
_filtered("filter_endswith", "part", {"p_name": {"endswith": "e"}}, ["p_partkey", "p_name"], "ends_with(p_name, 'e')")
_filtered("filter_contains", "part", {"p_type": {"contains": "R"}}, ["p_partkey", "p_type"], "contains(p_type, 'R')")
_filtered("filter_contains_literal_wildcards", "pages", {"or": [{"html": {"contains": "%"}}, {"html": {"contains": "_"}}]}, ["page_id", "url"], "contains(html, '%') OR contains(html, '_')")
_filtered(
    "filter_compound",
    "orders",
    {"type": "compound", "operator": "or", "value": [
        {"type": "compound", "operator": "and", "value": [{"type": "field", "operator": "eq", "field": "o_orderstatus", "value": "O"}, {"type": "field", "operator": "gt", "field": "o_totalprice", "value": 200000}]},
        {"type": "compound", "operator": "not", "value": [{"type": "field", "operator": "in", "field": "o_orderpriority", "value": ["1-URGENT", "5-LOW"]}]},
    ]},
    ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"],
    "(o_orderstatus = 'O' AND o_totalprice > 200000) OR NOT o_orderpriority IN ('1-URGENT', '5-LOW')",
)
_filtered("filter_yes", "region", {"type": "compound", "operator": "and", "value": []}, ["r_regionkey", "r_name"], "TRUE")
_filtered("filter_no", "region", {"type": "compound", "operator": "or", "value": []}, ["r_regionkey", "r_name"], "FALSE")
_filtered("filter_concise", "customer", {"c_nationkey": [1, 2, 3], "c_acctbal": {"gt": 0, "lt": 5000}}, ["c_custkey", "c_nationkey"], "c_nationkey IN (1, 2, 3) AND c_acctbal > 0 AND c_acctbal < 5000")

_CUSTOMER_ORDERS = "customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) o ON o_custkey = c_custkey"


def _customer_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders").filter("o_totalprice > 300000"), F.col("o_custkey") == F.col("c_custkey"), "left")


@query(f"SELECT c_custkey FROM {_CUSTOMER_ORDERS} WHERE o_orderkey IS NULL")
def filter_null(spark, sf_dir):
    return conditions.parse({"o_orderkey": None}).where(_customer_orders(spark, sf_dir)).select("c_custkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_CUSTOMER_ORDERS} WHERE o_orderkey IS NOT NULL")
def filter_not_null(spark, sf_dir):
    return conditions.parse({"o_orderkey": {"ne": None}}).where(_customer_orders(spark, sf_dir)).select("c_custkey", "o_orderkey")


@query(f"SELECT c_custkey, o_orderkey FROM {_CUSTOMER_ORDERS} WHERE NOT (o_orderstatus = 'O')")
def filter_not(spark, sf_dir):
    return conditions.parse({"not": [{"o_orderstatus": "O"}]}).where(_customer_orders(spark, sf_dir)).select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate > o_orderdate")
def filter_field_ref(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return conditions.parse({"l_shipdate": {"gt": {"field": "o_orderdate"}}}).where(df).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000")
def filter_mapping(spark, sf_dir):
    rename = conditions.name_mapping({"users": {"$self": "customer", "balance": "c_acctbal", "$table": "u"}})
    cond = conditions.parse({"u.balance": {"gt": 9000}}).rename(rename)
    return cond.where(t(spark, sf_dir, "customer").alias("customer")).select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def filter_in_large(spark, sf_dir):
    n = t(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    return conditions.filter_in(t(spark, sf_dir, "orders"), "o_custkey", [k for k in range(0, n + 1, 3)], inline=10).select("o_orderkey")


# -- rules to conditions
_POLICY = """
package tickets

# METADATA
# scope: document
# compile:
#   unknowns: ["input.orders", "input.customer"]
#   mask_rule: mask
include if {
    input.customer.c_mktsegment in data.segments[input.role]
    input.orders.o_totalprice >= 1000
}

include if input.role == "admin"

include if {
    input.role == "auditor"
    not input.orders.o_orderstatus == "O"
}

flipped if 25 < input.part.p_size

mask.customer.c_name.replace.value := "***" if not input.role == "admin"
mask.customer.c_acctbal := {}
"""


def _policy() -> Engine:
    return Engine([_POLICY], {"segments": {"sales": ["BUILDING", "MACHINERY"]}})


def _joined(spark, sf_dir):
    return t(spark, sf_dir, "customer").join(t(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))


def _bare(field: str) -> Column:
    return F.col(field.rpartition(".")[2])


@query("SELECT p_partkey, p_size FROM part WHERE p_size > 25")
def filter_flipped(spark, sf_dir):
    cond = _policy().condition("data.tickets.flipped", {}, ["input.part"])
    return t(spark, sf_dir, "part").filter(cond.column(_bare)).select("p_partkey", "p_size")


@query("SELECT o_orderkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND o_totalprice >= 1000")
def compile_filter_sales(spark, sf_dir):
    got = compile_filter(_policy(), "data.tickets.include", {"role": "sales"})
    return _joined(spark, sf_dir).filter(got["query"].column(_bare)).select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey")
def compile_filter_admin(spark, sf_dir):
    got = compile_filter(_policy(), "data.tickets.include", {"role": "admin"})
    return _joined(spark, sf_dir).filter(got["query"].column(_bare)).select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE NOT (o_orderstatus = 'O')")
def compile_filter_auditor(spark, sf_dir):
    got = compile_filter(_policy(), "data.tickets.include", {"role": "auditor"})
    return _joined(spark, sf_dir).filter(got["query"].column(_bare)).select("o_orderkey", "c_custkey")


@query("SELECT o_orderkey, c_custkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE FALSE")
def compile_filter_stranger(spark, sf_dir):
    got = compile_filter(_policy(), "data.tickets.include", {"role": "nobody"})
    cond = got.get("query", conditions.Always(False))
    return _joined(spark, sf_dir).filter(cond.column(_bare)).select("o_orderkey", "c_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE (p_size > 25)")
def compile_to_sql_text(spark, sf_dir):
    text = compile_filter(_policy(), "data.tickets.flipped", {}, ("sql", "sqlite"), ["input.part"])["query"]
    t(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql(f"SELECT p_partkey, p_size FROM part {text}")


# -- masks
@query("SELECT c_custkey, '***' AS c_name, c_acctbal FROM customer")
def mask_replace(spark, sf_dir):
    mask = _policy().query("data.tickets.mask", {"role": "sales"})
    return masks.apply_masks(t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), mask)


@query("SELECT o_orderkey, '***' AS owner FROM customer JOIN orders ON o_custkey = c_custkey")
def mask_explicit_map(spark, sf_dir):
    df = _joined(spark, sf_dir).select("o_orderkey", F.col("c_name").alias("owner"))
    return masks.apply_masks(df, {"customer": {"c_name": {"replace": {"value": "***"}}}}, {"o_orderkey": "orders.o_orderkey", "owner": "customer.c_name"})


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '***' ELSE c_name END AS c_name FROM customer")
def mask_conditional(spark, sf_dir):
    df = t(spark, sf_dir, "customer")
    return masks.apply_masks(df, {"customer": {"c_name": {"replace": {"value": "***"}}}}, when=F.col("c_acctbal") < 0).select("c_custkey", "c_name")


@query("SELECT c_custkey, '-' AS c_name, '-' AS c_mktsegment FROM customer")
def mask_default_deny(spark, sf_dir):
    df = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    shown = {"customer": {"c_custkey": {}}}
    return masks.apply_masks(df, shown, default={"replace": {"value": "-"}})


# -- rules over tables
_RULES = """
package rules

either contains c.c_custkey if {
    some c in data.customer
    c.c_mktsegment == "BUILDING"
}

either contains c.c_custkey if {
    some c in data.customer
    c.c_acctbal > 9000
}

nations contains {"nation": n.n_name, "region": r.r_name} if {
    some n in data.nation
    some r in data.region
    n.n_regionkey == r.r_regionkey
}

busy contains o.o_custkey if {
    some o in data.orders
    o.o_totalprice > 300000
}

quiet contains c.c_custkey if {
    some c in data.customer
    not c.c_custkey in busy
}

active contains c.c_custkey if {
    some c in data.customer
    c.c_custkey in busy
}

cheap contains {"p": p.p_partkey, "s": s.s_suppkey} if {
    some p in data.part
    p.p_size < 3
    some s in data.supplier
    s.s_acctbal > p.p_retailprice
}

cheaper contains {"p": p.p_partkey, "s": s.s_suppkey} if {
    some p in data.part
    some s in data.supplier
    s.s_acctbal > p.p_retailprice
}

by_region[r.r_name] := r.r_regionkey if some r in data.region

looked contains {"c": c.c_custkey, "n": data.nation[c.c_nationkey].n_name} if some c in data.customer

biggest if every p in data.part { p.p_size <= 50 }

default tier := "basic"

tier := "gold" if {
    input.o_totalprice > 300000
} else := "silver" if {
    input.o_totalprice > 150000
}

label(x) := "small" if x < 10

else := "large"

sizes contains {"p": p.p_partkey, "size": label(p.p_size)} if some p in data.part

squares contains {"e": e.event_id, "v": y} if {
    some e in data.small_events
    some x in numbers.range(1, 3)
    y := e.event_id * x
}
"""


def _planner(spark, sf_dir) -> Planner:
    names = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "orders": "o_orderkey", "part": "p_partkey", "supplier": "s_suppkey"}
    tables = {n: Table(t(spark, sf_dir, n), k) for n, k in names.items()}
    return Planner([_RULES], {**tables, "small_events": Table(t(spark, sf_dir, "events").select("event_id"), "event_id")})


@query("SELECT c_custkey AS value FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000")
def rule_or(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.either")


@query("SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def rule_and_join(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.nations")


@query("SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rule_not_anti(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.quiet")


@query("SELECT c_custkey AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def rule_exists_semi(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.active")


@query("SELECT p_partkey AS p, s_suppkey AS s FROM part JOIN supplier ON s_acctbal > p_retailprice WHERE p_size < 3")
def rule_theta_join(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.cheap")


@query("SELECT p_partkey AS p, count(*) AS n, min(s_suppkey) AS first, max(s_suppkey) AS last FROM part JOIN supplier ON s_acctbal > p_retailprice GROUP BY 1")
def rule_theta_join_all(spark, sf_dir):
    """All parts against all suppliers; the pairs are counted."""
    return _planner(spark, sf_dir).totals("rules.cheaper", ["p"], n=("count", "*"), first=("min", "s"), last=("max", "s"))


@query("SELECT r_name AS key, r_regionkey AS value FROM region")
def rule_partial_object(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.by_region")


@query("SELECT c_custkey AS c, n_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey")
def rule_lookup(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.looked")


@query("SELECT r_regionkey, (SELECT bool_and(p_size <= 50) FROM part) AS fits FROM region")
def rule_every(spark, sf_dir):
    out = _planner(spark, sf_dir).decide("rules.biggest", t(spark, sf_dir, "region"), ["r_regionkey"], "fits")
    return out.select("r_regionkey", F.coalesce("fits", F.lit(False)).alias("fits"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'gold' WHEN o_totalprice > 150000 THEN 'silver' ELSE 'basic' END AS tier FROM orders")
def rule_else_default(spark, sf_dir):
    return _planner(spark, sf_dir).decide("rules.tier", t(spark, sf_dir, "orders"), ["o_orderkey"], "tier").select("o_orderkey", "tier")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'gold' WHEN o_totalprice > 150000 THEN 'silver' ELSE 'basic' END AS tier FROM orders")
def rule_as_column(spark, sf_dir):
    """The same rule as one CASE expression: no join, no shuffle."""
    tier = Engine([_RULES]).column("data.rules.tier", {}, ["input"])
    return t(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"))


@query("SELECT p_partkey AS p, CASE WHEN p_size < 10 THEN 'small' ELSE 'large' END AS size FROM part")
def rule_function(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.sizes")


@query("SELECT DISTINCT event_id AS e, event_id * x AS v FROM events, (SELECT unnest([1, 2, 3]) AS x)")
def rule_range_iteration(spark, sf_dir):
    return _planner(spark, sf_dir).relation("rules.squares")


# -- comprehensions and aggregates
@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM (SELECT DISTINCT n_regionkey, n_name FROM nation) GROUP BY 1")
def set_comp(spark, sf_dir):
    return t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("names"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_nationkey DESC) AS names FROM nation GROUP BY 1")
def array_comp_sorted(spark, sf_dir):
    pairs = F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")), asc=False)
    return t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(pairs, lambda p: p["n_name"]), ",").alias("names"))


@query("SELECT n_regionkey, string_agg(n_name || '=' || n_nationkey, ';' ORDER BY n_name) AS pairs FROM nation GROUP BY 1")
def object_comp(spark, sf_dir):
    df = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_set(F.struct("n_name", "n_nationkey"))).alias("m"))
    shown = F.transform(F.array_sort(F.map_keys("m")), lambda k: F.concat_ws("=", k, F.try_element_at("m", k)))
    return df.select("n_regionkey", F.array_join(shown, ";").alias("pairs"))


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS total, min(l_quantity) AS least, max(l_quantity) AS most, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def agg_count_sum_min_max(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT r_regionkey, product(n_nationkey + 1)::DOUBLE AS p FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def agg_product(spark, sf_dir):
    df = t(spark, sf_dir, "region").join(t(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    return df.groupBy("r_regionkey").agg(F.product((F.col("n_nationkey") + 1).cast("double")).alias("p"))


@query("SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_order, bool_or(o_totalprice > 300000) AS some_order FROM orders GROUP BY 1")
def agg_all_any(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_totalprice") > 1000).alias("every_order"), F.bool_or(F.col("o_totalprice") > 300000).alias("some_order"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).union(t(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(t(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_except(spark, sf_dir):
    return t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).subtract(t(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


_GATHERED = """
package gathered

names[r.r_name] := [n.n_name | some n in data.nation; n.n_regionkey == r.r_regionkey] if some r in data.region

segments contains {"nation": n.n_name, "segments": {c.c_mktsegment | some c in data.customer; c.c_nationkey == n.n_nationkey}} if some n in data.nation

keys contains {"region": r.r_name, "keys": {n.n_name: n.n_nationkey | some n in data.nation; n.n_regionkey == r.r_regionkey}} if some r in data.region

spent contains {"c": c.c_custkey, "n": n, "most": most} if {
    some c in data.customer
    n := count([o.o_orderkey | some o in data.orders; o.o_custkey == c.c_custkey])
    most := max({o.o_totalprice | some o in data.orders; o.o_custkey == c.c_custkey})
}

default loyal := false

loyal if count([1 | some o in data.orders; o.o_custkey == input.c_custkey; o.o_totalprice > input.least]) >= 3

default eager := false

eager if count([1 | some o in data.orders; o.o_custkey == input.c_custkey; o.o_totalprice > input.least]) >= 3 with input.least as 200000

shown contains n.n_name if some n in data.nation with data.nation as data.some_nations

both contains k if {
    some c in data.customer
    k := c.c_nationkey
    k in home
}

home contains s.s_nationkey if some s in data.supplier

bare contains n.n_nationkey if {
    some n in data.nation
    not n.n_nationkey in home_rich
}

home_rich contains s.s_nationkey if {
    some s in data.supplier
    s.s_acctbal > 5000
}
"""


def _gathering(spark, sf_dir) -> Planner:
    names = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey", "orders": "o_orderkey", "supplier": "s_suppkey"}
    tables = {n: Table(t(spark, sf_dir, n), k) for n, k in names.items()}
    return Planner([_GATHERED], {**tables, "some_nations": Table(t(spark, sf_dir, "nation").filter("n_nationkey % 4 = 1"), "n_nationkey")})


@query("SELECT r_name AS region, coalesce(string_agg(n_name, ',' ORDER BY n_nationkey), '') AS names FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")
def rule_array_comp(spark, sf_dir):
    """Arrays come in the order of the table's key."""
    rows = _gathering(spark, sf_dir).relation("gathered.names")
    return rows.select(F.col("key").alias("region"), F.array_join("value", ",").alias("names"))


@query("SELECT n_name AS nation, coalesce(string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment), '') AS segments FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def rule_set_comp(spark, sf_dir):
    rows = _gathering(spark, sf_dir).relation("gathered.segments")
    return rows.select("nation", F.array_join("segments", ",").alias("segments"))


@query("SELECT r_name AS region, n_name AS name, n_nationkey AS k FROM nation JOIN region ON n_regionkey = r_regionkey")
def rule_object_comp(spark, sf_dir):
    return _gathering(spark, sf_dir).relation("gathered.keys").select("region", F.explode("keys").alias("name", "k"))


@query("SELECT c_custkey AS c, count(*) AS n, max(o_totalprice) AS most FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def rule_comp_totals(spark, sf_dir):
    """Counts and maxima of comprehensions are aggregates; customers without orders have no maximum and fall out."""
    return _gathering(spark, sf_dir).relation("gathered.spent").filter("most IS NOT NULL")


@query("""SELECT c_custkey, least, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > least) >= 3 AS loyal
  FROM (SELECT c_custkey, (c_custkey % 5) * 50000 AS least FROM customer)""")
def rule_comp_decide(spark, sf_dir):
    inputs = t(spark, sf_dir, "customer").select("c_custkey", ((F.col("c_custkey") % 5) * 50000).alias("least"))
    return _gathering(spark, sf_dir).decide("gathered.loyal", inputs, ["c_custkey"], "loyal")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) >= 3 AS eager FROM customer")
def rule_with_input(spark, sf_dir):
    """A rule under a replaced part of the input."""
    inputs = t(spark, sf_dir, "customer").select("c_custkey", F.lit(0).alias("least"))
    return _gathering(spark, sf_dir).decide("gathered.eager", inputs, ["c_custkey"], "eager").select("c_custkey", "eager")


@query("SELECT n_name AS value FROM nation WHERE n_nationkey % 4 = 1")
def rule_with_data(spark, sf_dir):
    return _gathering(spark, sf_dir).relation("gathered.shown")


@query("SELECT DISTINCT c_nationkey AS value FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)")
def rule_set_intersect(spark, sf_dir):
    return _gathering(spark, sf_dir).relation("gathered.both")


@query("SELECT n_nationkey AS value FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def rule_set_except(spark, sf_dir):
    return _gathering(spark, sf_dir).relation("gathered.bare")


# -- functions
def _props(spark, sf_dir) -> DataFrame:
    e = t(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "map<string,bigint>").alias("m"), F.create_map(F.lit("event"), "event_id", F.lit("user"), "user_id").alias("o"))


@query("SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, -1) AS k, -1::BIGINT AS missing FROM events")
def fn_object_get(spark, sf_dir):
    return _props(spark, sf_dir).select("event_id", scalar.object_get("m", ["k"], F.lit(-1).cast("long")).alias("k"), scalar.object_get("m", ["nope"], F.lit(-1).cast("long")).alias("missing"))


@query("SELECT event_id, 'event,user' AS names, event_id AS kept, user_id AS rest FROM events")
def fn_object_filter_remove_keys(spark, sf_dir):
    keys = F.array(F.lit("event"))
    return _props(spark, sf_dir).select(
        "event_id", F.array_join(scalar.object_keys("o"), ",").alias("names"), F.try_element_at(scalar.object_filter("o", keys), F.lit("event")).alias("kept"), F.try_element_at(scalar.object_remove("o", keys), F.lit("user")).alias("rest")
    )


@query("SELECT event_id, -event_id AS event, user_id AS user, 7::BIGINT AS extra FROM events")
def fn_object_union(spark, sf_dir):
    right = F.create_map(F.lit("event"), -F.col("event_id"), F.lit("extra"), F.lit(7).cast("long"))
    u = scalar.object_union("o", right)
    return _props(spark, sf_dir).select("event_id", *[F.try_element_at(u, F.lit(k)).alias(k) for k in ("event", "user", "extra")])


@query("SELECT n_nationkey, n_regionkey IN (1, 3) AS inside, n_nationkey = 7 AS pair FROM nation")
def fn_member(spark, sf_dir):
    n = t(spark, sf_dir, "nation")
    m = F.create_map(F.lit("a"), "n_nationkey")
    return n.select("n_nationkey", F.array_contains(F.array(F.lit(1), F.lit(3)), F.col("n_regionkey")).alias("inside"), scalar.member_pair(F.lit("a"), F.lit(7), m).alias("pair"))


@query("SELECT p_partkey, p_brand || '/' || p_type AS list, CASE WHEN p_brand = p_type THEN p_brand WHEN p_brand < p_type THEN p_brand || '/' || p_type ELSE p_type || '/' || p_brand END AS as_set FROM part")
def fn_concat(spark, sf_dir):
    a = F.array("p_brand", "p_type")
    return t(spark, sf_dir, "part").select("p_partkey", scalar.concat("/", a).alias("list"), scalar.concat("/", a, is_set=True).alias("as_set"))


@query("SELECT p_partkey, p_brand || ' #' || p_partkey || ' ' || printf('%.2f', p_retailprice) AS s FROM part")
def fn_sprintf(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", scalar.sprintf("%v #%d %.2f", "p_brand", "p_partkey", "p_retailprice").alias("s"))


@query("SELECT n_nationkey, array_to_string(CASE WHEN n_nationkey >= 10 THEN range(10, n_nationkey + 1) ELSE range(10, n_nationkey - 1, -1) END, ',') AS xs FROM nation")
def fn_range(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(scalar.numbers_range(F.lit(10), F.col("n_nationkey")).cast("array<string>"), ",").alias("xs"))


@query("SELECT n_nationkey, array_to_string(CASE WHEN n_nationkey >= 10 THEN range(10, n_nationkey + 1, 4) ELSE range(10, n_nationkey - 1, -4) END, ',') AS xs FROM nation")
def fn_range_step(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(scalar.numbers_range_step(F.lit(10), F.col("n_nationkey"), 4).cast("array<string>"), ",").alias("xs"))


@query("SELECT n_nationkey, array_to_string(([0, 1, 2, 3, 4, 5])[greatest(n_nationkey - 3, 0) + 1 : least(n_nationkey, 6)], ',') AS xs FROM nation")
def fn_slice(spark, sf_dir):
    xs = F.array(*[F.lit(i) for i in range(6)])
    return t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(scalar.array_slice(xs, F.col("n_nationkey") - 3, F.col("n_nationkey")).cast("array<string>"), ",").alias("xs"))


@query("SELECT n_nationkey, n_name || ',x,' || n_name AS xs FROM nation")
def fn_array_concat(spark, sf_dir):
    return t(spark, sf_dir, "nation").select("n_nationkey", F.array_join(scalar.array_concat(F.array("n_name"), F.array(F.lit("x"), F.col("n_name"))), ",").alias("xs"))


@query(r"SELECT page_id, regexp_full_match(url, 'https?://[^./]*\.[^./]*\.[^./]*/.*') AS plain, regexp_full_match(url, '(?s:.*)example(?s:.*)') AS anywhere FROM pages")
def fn_glob(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", scalar.glob_match("{http,https}://*.*.*/**", [".", "/"], "url").alias("plain"), scalar.glob_match("*example*", None, "url").alias("anywhere"))


@query("SELECT event_id, 'object' AS whole, 'number' AS part FROM events")
def fn_type_name(spark, sf_dir):
    v = scalar.parse_json("props")
    return t(spark, sf_dir, "events").select("event_id", scalar.type_name(v).alias("whole"), scalar.type_name(F.try_variant_get(v, "$.k", "variant")).alias("part"))


@query("SELECT p_partkey, lower(p_name) AS low, upper(p_name) AS up, substr(p_name, 3) AS tail, strpos(p_name, 'a') - 1 AS at, split_part(p_name, ' ', 1) AS head, replace(p_name, 'a', 'A') AS swapped, reverse(p_name) AS back FROM part")
def fn_strings(spark, sf_dir):
    p = F.col("p_name")
    return t(spark, sf_dir, "part").select("p_partkey", F.lower(p).alias("low"), F.upper(p).alias("up"), scalar.substring("p_name", 2).alias("tail"), scalar.indexof("p_name", "a").cast("long").alias("at"), F.get(scalar.split("p_name", " "), F.lit(0)).alias("head"), F.replace(p, F.lit("a"), F.lit("A")).alias("swapped"), F.reverse(p).alias("back"))


@query("SELECT p_partkey, lower(printf('%x', p_partkey)) AS hex, base64(p_name::BLOB) AS b64 FROM part")
def fn_encodings(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", scalar.format_int("p_partkey", 16).alias("hex"), F.base64("p_name").alias("b64"))


@query("SELECT s_suppkey, 'a,b,c' AS u, 'b' AS i, 'a' AS d, 6.0::DOUBLE AS total, 6.0::DOUBLE AS product FROM supplier")
def fn_set_algebra(spark, sf_dir):
    a, b = F.array(F.lit("b"), F.lit("a")), F.array(F.lit("c"), F.lit("b"))
    xs = F.array(*[F.lit(float(i)) for i in (1, 2, 3)])
    return t(spark, sf_dir, "supplier").select("s_suppkey", *[F.array_join(f(a, b), ",").alias(n) for n, f in (("u", scalar.set_union), ("i", scalar.set_intersection), ("d", scalar.set_difference))], scalar.array_sum(xs).alias("total"), scalar.array_product(xs).alias("product"))


@query("SELECT user_id % 256 AS u, bool_or(TRUE) AS seen, max(CASE WHEN user_id % 256 BETWEEN 64 AND 127 THEN 1 ELSE 0 END) = 1 AS inside FROM events GROUP BY 1")
def fn_cidr(spark, sf_dir):
    e = t(spark, sf_dir, "events").select((F.col("user_id") % 256).alias("u")).distinct()
    return e.select("u", F.lit(True).alias("seen"), scalar.cidr_contains("10.1.2.64/26", F.concat(F.lit("10.1.2."), F.col("u").cast("string"))).alias("inside"))


_CALLS = """
package calls

digests contains {
    "p": p.p_partkey, "md5": crypto.md5(p.p_name), "sha1": crypto.sha1(p.p_name), "sha256": crypto.sha256(p.p_name), "hex": hex.encode(p.p_name),
    "back": hex.decode(hex.encode(p.p_name)), "url64": base64url.decode(base64url.encode_no_pad(p.p_type)), "query": urlquery.encode(p.p_brand)
} if some p in data.part

bits contains {"p": p.p_partkey, "a": bits.and(p.p_partkey, 12), "o": bits.or(p.p_partkey, 3), "x": bits.xor(p.p_partkey, 5), "l": bits.lsh(p.p_partkey, 4), "r": bits.rsh(p.p_partkey, 2), "n": bits.negate(p.p_partkey)} if some p in data.part

texts contains {
    "p": p.p_partkey, "n": strings.count(p.p_name, "e"), "cut": trim_prefix(p.p_name, "small "), "end": trim_suffix(p.p_type, "BRASS"), "part": split(p.p_name, " ")[1],
    "first": substring(p.p_name, 1, 4), "swapped": regex.replace(p.p_brand, "#([0-9])([0-9])", "-$2$1"), "two": concat("|", regex.find_n("[a-z]+", p.p_name, 2)), "at": indexof(p.p_type, "A"), "trimmed": trim(p.p_name, "aeb")
} if some p in data.part

times contains {"e": e.event_id, "day": time.date(e.ns), "clock": time.clock(e.ns), "weekday": time.weekday(e.ns)} if some e in data.stamps

any_prefix contains p.p_partkey if {
    some p in data.part
    strings.any_prefix_match([p.p_name, p.p_type], ["blue", "ECO", "red"])
}

kinds contains {"p": d.p_partkey, "text": is_string(d.v), "number": is_number(d.v), "list": is_array(d.v), "object": is_object(d.v), "nothing": is_null(d.v), "truth": is_boolean(d.v)} if some d in data.docs

sets contains {"c": c.c_custkey, "either": xs | ys, "both": xs & ys} if {
    some c in data.customer
    xs := {c.c_nationkey, c.c_custkey % 7}
    ys := {c.c_custkey % 5, c.c_custkey % 7}
}
"""


def _calls(spark, sf_dir, path: str) -> DataFrame:
    ns = F.lit(1_600_000_000_000_000_000).cast("decimal(19,0)") + F.col("event_id").cast("decimal(19,0)") * F.lit(86_399_123_456_789).cast("decimal(14,0)")
    stamps = t(spark, sf_dir, "events").select("event_id", ns.alias("ns"))  # from event 88,235 on beyond 64 bits
    docs = t(spark, sf_dir, "part").select("p_partkey", F.try_parse_json(F.get(F.array(*map(F.lit, ['"x"', "1.5", "[1]", '{"a": 1}', "null", "true"])), (F.col("p_partkey") % 6).cast("int"))).alias("v"))
    tables = {"part": Table(t(spark, sf_dir, "part"), "p_partkey"), "customer": Table(t(spark, sf_dir, "customer"), "c_custkey"), "stamps": Table(stamps, "event_id"), "docs": Table(docs, "p_partkey")}
    return Planner([_CALLS], tables).relation(f"calls.{path}")


@query("SELECT p_partkey AS p, md5(p_name) AS md5, sha1(p_name) AS sha1, sha256(p_name) AS sha256, lower(hex(p_name)) AS hex, p_name AS back, p_type AS url64, replace(p_brand, '#', '%23') AS query FROM part")
def fn_digests(spark, sf_dir):
    return _calls(spark, sf_dir, "digests")


@query("SELECT p_partkey AS p, p_partkey & 12 AS a, p_partkey | 3 AS o, xor(p_partkey, 5) AS x, p_partkey * 16 AS l, p_partkey >> 2 AS r, -p_partkey - 1 AS n FROM part")
def fn_bits(spark, sf_dir):
    return _calls(spark, sf_dir, "bits")


@query("""SELECT p_partkey AS p, length(p_name) - length(replace(p_name, 'e', '')) AS n, regexp_replace(p_name, '^small ', '') AS cut, regexp_replace(p_type, 'BRASS$', '') AS "end", split_part(p_name, ' ', 2) AS part,
  substr(p_name, 2, 4) AS first, regexp_replace(p_brand, '#([0-9])([0-9])', '-\\2\\1') AS swapped, array_to_string(regexp_extract_all(p_name, '[a-z]+')[1:2], '|') AS two, strpos(p_type, 'A') - 1 AS "at", trim(p_name, 'aeb') AS trimmed FROM part""")
def fn_texts(spark, sf_dir):
    out = _calls(spark, sf_dir, "texts")
    return out.withColumns({c: F.col(c).cast("long") for c in ("n", "at")})


@query("""SELECT event_id AS e, strftime(ts, '%Y-%-m-%-d') AS day, strftime(ts, '%-H:%-M:%-S') AS clock, dayname(ts) AS weekday
  FROM (SELECT event_id, make_timestamp(((1600000000000000000 + event_id::HUGEINT * 86399123456789) // 1000)::BIGINT) AS ts FROM events)""")
def fn_times(spark, sf_dir):
    """Days and times of nanoseconds, over dates of centuries."""
    joined = lambda c, sep: F.array_join(F.col(c).cast("array<string>"), sep).alias(c)
    return _calls(spark, sf_dir, "times").select("e", joined("day", "-"), joined("clock", ":"), "weekday")


@query("SELECT p_partkey AS value FROM part WHERE regexp_matches(p_name, '^(blue|ECO|red)') OR regexp_matches(p_type, '^(blue|ECO|red)')")
def fn_any_prefix_match(spark, sf_dir):
    return _calls(spark, sf_dir, "any_prefix")


@query("""SELECT p_partkey AS p, k = 'VARCHAR' AS text, k = 'DOUBLE' AS number, k = 'ARRAY' AS list, k = 'OBJECT' AS object, k = 'NULL' AS nothing, k = 'BOOLEAN' AS truth
  FROM (SELECT p_partkey, json_type((['"x"', '1.5', '[1]', '{"a": 1}', 'null', 'true'])[p_partkey % 6 + 1]::JSON) AS k FROM part)""")
def fn_kinds(spark, sf_dir):
    return _calls(spark, sf_dir, "kinds")


@query("""SELECT c_custkey AS c, array_to_string(list_sort(list_distinct([c_nationkey, c_custkey % 7, c_custkey % 5])), ',') AS either,
  array_to_string(list_sort(list_filter(list_distinct([c_nationkey, c_custkey % 7]), lambda x: x = c_custkey % 5 OR x = c_custkey % 7)), ',') AS both FROM customer""")
def fn_set_operators(spark, sf_dir):
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return _calls(spark, sf_dir, "sets").select("c", joined("either"), joined("both"))


# -- documents
@query("SELECT event_id, '/k' AS path, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def fn_walk_leaves(spark, sf_dir):
    nodes = t(spark, sf_dir, "events").select("event_id", F.inline(documents.walked(F.col("props"), leaves=True)))
    return nodes.filter("kind = 'number'").select("event_id", "path", "value")


@query("""WITH l AS (SELECT l_orderkey, list({'n': l_linenumber, 'flag': l_returnflag, 'returned': l_returnflag = 'R', 'note': NULL::VARCHAR} ORDER BY l_linenumber, l_returnflag) AS lines FROM lineitem GROUP BY 1),
d AS (SELECT o_orderkey, to_json({'status': o_orderstatus, 'customer': {'key': o_custkey}, 'lines': coalesce(lines, [])}) AS doc FROM orders LEFT JOIN l ON l_orderkey = o_orderkey)
SELECT o_orderkey, replace(replace(replace(substr(j.fullkey, 2), '[', '/'), ']', ''), '.', '/') AS path, j.value::VARCHAR AS value,
  CASE j.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END AS kind
FROM d, json_tree(d.doc) j WHERE j.type NOT IN ('OBJECT', 'ARRAY')""")
def fn_walk_nested_leaves(spark, sf_dir):
    """Every leaf of each order's document with its lineitems."""
    flag = F.col("l_returnflag")
    line = F.struct(F.col("l_linenumber").alias("n"), flag.alias("flag"), (flag == "R").alias("returned"), F.lit(None).cast("string").alias("note"))
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines")).hint("merge")
    orders = t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    none = F.array().cast(lines.schema["lines"].dataType)
    doc = F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").alias("key")).alias("customer"), F.coalesce("lines", none).alias("lines"))
    docs = orders.select("o_orderkey", F.to_json(doc, {"ignoreNullFields": "false"}).alias("doc"))
    return docs.select("o_orderkey", F.inline(documents.walked(F.col("doc"), leaves=True)))


@query("""SELECT count(*) AS n, min(o_orderkey) AS first, o_orderstatus AS status, o_custkey AS customer FROM orders GROUP BY o_orderstatus, o_custkey""")
def json_value_hash(spark, sf_dir):
    """Equal documents written in two ways have one hash: orders of a customer by status."""
    o = t(spark, sf_dir, "orders")
    one = F.format_string('{"status": "%s", "customer": {"key": %d, "w": 1.0}}', "o_orderstatus", "o_custkey")
    two = F.format_string('{"customer":{"w":1,"key":%d.0},"status":"%s"}', "o_custkey", "o_orderstatus")
    doc = F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(two)
    rows = o.select("o_orderkey", "o_orderstatus", "o_custkey", documents.value_hash(doc).alias("h")).groupBy("h").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first"), F.min("o_orderstatus").alias("status"), F.min("o_custkey").alias("customer"))
    return rows.drop("h")


@query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"u\":'  || user_id || '}' AS doc FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_merge(spark, sf_dir):
    e = t(spark, sf_dir, "events").filter(documents.pointer_get(F.col("props"), "/k").isNotNull())
    return e.select("event_id", documents.json_merge(F.col("props"), F.to_json(F.struct(F.col("user_id").alias("u")))).alias("doc"))


@query("SELECT event_id, '{\"j\":' || json_extract_string(props, '$.k') || ',\"z\":{\"a\":1}}' AS doc FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_patch(spark, sf_dir):
    e = t(spark, sf_dir, "events").filter(documents.pointer_get(F.col("props"), "/k").isNotNull())
    ops = [{"op": "move", "from": "/k", "path": "/j"}, {"op": "create", "path": "/z/a", "value": 1}]
    return e.select("event_id", documents.json_patch(F.col("props"), ops).alias("doc"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'removed' ELSE 'changed' END AS change FROM orders WHERE o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 UNION ALL SELECT -o_orderkey, 'added' FROM orders WHERE o_orderkey % 11 = 0 AND o_orderkey <> 0")
def json_diff(spark, sf_dir):
    before = t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    after = before.filter("o_orderkey % 7 <> 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    after = after.unionByName(before.filter("o_orderkey % 11 = 0 AND o_orderkey <> 0").withColumn("o_orderkey", -F.col("o_orderkey")))
    return keyed.diff_tables(before, after, ["o_orderkey"]).select("o_orderkey", "change")


@query("""SELECT n_nationkey, '{"added":' || n_nationkey || ',"copy":' || n_regionkey || ',"deep":{"list":[1,' || n_nationkey || ',3]},"moved":"' || n_name || '"}' AS doc FROM nation WHERE n_nationkey <> 7""")
def json_patch_operations(spark, sf_dir):
    """Every operation in one patch; where a test fails there is no document."""
    n = t(spark, sf_dir, "nation")
    inner = F.struct(F.array(F.lit(1), F.lit(2), F.lit(3), F.lit(4)).alias("list"))
    doc = F.to_json(F.struct(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("key"), inner.alias("deep"), F.lit("old").alias("gone"), (F.col("n_nationkey") == 7).alias("odd")))
    operations = [
        {"op": "test", "path": "/odd", "value": False}, {"op": "remove", "path": "/odd"}, {"op": "move", "from": "/name", "path": "/moved"}, {"op": "copy", "from": "/region", "path": "/copy"},
        {"op": "remove", "path": "/region"}, {"op": "replace", "path": "/gone", "value": "new"}, {"op": "remove", "path": "/gone"}, {"op": "remove", "path": "/deep/list/3"},
        {"op": "copy", "from": "/key", "path": "/deep/list/1"}, {"op": "remove", "path": "/deep/list/2"}, {"op": "move", "from": "/key", "path": "/added"},
    ]
    return n.select("n_nationkey", documents.json_patch(doc, operations).alias("doc")).filter("doc IS NOT NULL")


# -- streams as tables
_LATEST = "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"


@query(_LATEST)
def ingest_latest_per_key(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return keyed.latest_per_key(e, ["user_id"], ["event_id"])


@query(f"WITH l AS ({_LATEST}) SELECT * FROM (SELECT user_id, event_id, event_type, value FROM l WHERE event_id % 2 = 0 UNION ALL SELECT c_custkey, 0::BIGINT, 'seed', c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l WHERE event_id % 2 = 0))")
def ingest_upsert(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    seed = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.lit(0).cast("long").alias("event_id"), F.lit("seed").alias("event_type"), F.col("c_acctbal").alias("value"))
    return keyed.upsert(seed, keyed.latest_per_key(e, ["user_id"], ["event_id"]).filter("event_id % 2 = 0"), ["user_id"])


@query(f"WITH l AS ({_LATEST}) SELECT user_id, value FROM l WHERE event_type <> 'error' UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM l)")
def ingest_change_feed(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    seed = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("value"))
    return keyed.apply_changes(seed, e, ["user_id"], ["event_id"], F.col("event_type") == "error")


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click'")
def events_drop(spark, sf_dir):
    return decision_events.process(t(spark, sf_dir, "events"), drop=F.col("event_type") == "click").select("event_id", "event_type")


@query("SELECT event_id, event_type, '<user>' AS user_id, '/input/value' AS erased, '/input/user_id' AS masked FROM events")
def events_mask(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", F.struct("user_id", "event_type", "value").alias("input"))
    out = decision_events.process(e, masks=["/input/value", {"op": "upsert", "path": "/input/user_id", "value": "<user>"}, "/input/nothing"])
    return out.select("event_id", "input.event_type", "input.user_id", F.array_join("erased", ",").alias("erased"), F.array_join("masked", ",").alias("masked"))


# -- batches, comparison, overlay, relations
@query("SELECT event_id, CASE WHEN value < 0 THEN NULL ELSE round(value * 2, 6) END AS result, CASE WHEN value < 0 THEN 'negative' END AS error, coalesce(event_type, 'none') AS event_type, 'EUR' AS currency FROM events")
def batch_query(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", "event_type", "value")
    common = analysis.with_common(e, {"event_type": F.lit("none"), "currency": F.lit("EUR")})
    out = analysis.batch_columns(common, F.round(F.col("value") * 2, 6), F.when(F.col("value") < 0, "negative"))
    return out.select("event_id", "result", "error", "event_type", "currency")


BANDS_RULE = """
package bands

size := "small" if input.value < 60

size := "large" if input.value > 40

size := "none" if input.event_type == "view"
"""


@query("""SELECT event_id, CASE WHEN len(s) = 1 THEN s[1] END AS result, CASE WHEN len(s) > 1 THEN 'several values' END AS error FROM (
  SELECT event_id, list_filter([CASE WHEN value < 60 THEN 'small' END, CASE WHEN value > 40 THEN 'large' END, CASE WHEN event_type = 'view' THEN 'none' END], lambda x: x IS NOT NULL) AS s FROM events)""")
def batch_rules(spark, sf_dir):
    """A rule's text over all events at once; an input that gives two values has an error of its own."""
    out = analysis.batch_rules([BANDS_RULE], "bands.size", t(spark, sf_dir, "events").select("event_id", "event_type", "value"), ["event_id"])
    return out.select("event_id", "result", F.when(F.col("error").isNotNull(), "several values").alias("error"))


@query("""SELECT o_orderkey, value_a, value_b FROM (
  SELECT o_orderkey, o_totalprice > 100000 AND o_orderstatus <> 'P' AS value_a, o_totalprice > 150000 OR c_mktsegment = 'MACHINERY' AS value_b
  FROM orders JOIN customer ON c_custkey = o_custkey) WHERE value_a <> value_b""")
def impact_rules(spark, sf_dir):
    """Where two rule sets, given as text, decide differently."""
    first = "package check\n\ndefault held := false\n\nheld if { input.o_totalprice > 100000; input.o_orderstatus != \"P\" }"
    second = "package check\n\ndefault held := false\n\nheld if input.o_totalprice > 150000\n\nheld if data.buyers[input.o_custkey] == \"MACHINERY\""
    o, c = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"), t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    rows = analysis.impact_rules([first], [second], "check.held", o, ["o_orderkey"], {"buyers": Table(c, "c_custkey")})
    return rows.select("o_orderkey", "value_a", "value_b")


@query("SELECT count(*) AS total, sum((value < 50)::INT)::BIGINT AS failed, CASE WHEN sum((value < 50)::INT) = 0 THEN 200 WHEN sum((value < 50)::INT) = count(*) THEN 500 ELSE 207 END AS status FROM events")
def batch_status(spark, sf_dir):
    e = t(spark, sf_dir, "events")
    return analysis.batch_status(analysis.batch_columns(e, F.lit(1), F.when(F.col("value") < 50, "small")))


@query("SELECT o_orderkey, o_totalprice > 100000 AS value_a, o_totalprice > 150000 AS value_b FROM orders WHERE (o_totalprice > 100000) IS DISTINCT FROM (o_totalprice > 150000)")
def impact_diff(spark, sf_dir):
    rows = analysis.impact(t(spark, sf_dir, "orders"), lambda d: F.col("o_totalprice") > 100000, lambda d: F.col("o_totalprice") > 150000)
    return rows.select("o_orderkey", "value_a", "value_b")


@query("""SELECT path, count(*) AS n, round(avg(a), 4) AS mean_a, round(median(a), 4) AS median_a, round(min(a), 4) AS min_a, round(max(a), 4) AS max_a, round(stddev_samp(a), 4) AS stddev_a, round(var_samp(a), 2) AS var_a,
  round(avg(b), 4) AS mean_b, round(median(b), 4) AS median_b, round(min(b), 4) AS min_b, round(max(b), 4) AS max_b, round(stddev_samp(b), 4) AS stddev_b, round(var_samp(b), 2) AS var_b
  FROM (SELECT event_type AS path, value AS a, value * 2 AS b FROM events) GROUP BY 1""")
def impact_report(spark, sf_dir):
    e = t(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("value").alias("eval_ns_a"), (F.col("value") * 2).alias("eval_ns_b"))
    out = analysis.impact_report(e)
    return out.select("path", "n", *[F.round(c, 2 if c.startswith("var") else 4).alias(c) for c in out.columns[2:]])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'preview' ELSE c_name END AS c_name FROM customer UNION ALL SELECT -1, 'new'")
def overlay_read(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    overlay = base.filter("c_custkey % 10 = 0").withColumn("c_name", F.lit("preview"))
    overlay = overlay.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("c_custkey"), F.lit("new").alias("c_name")))
    return catalog.overlay_all(base, overlay, ["c_custkey"])


@query("SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'preview' ELSE c_name END AS c_name, c_mktsegment FROM customer")
def overlay_point_read(spark, sf_dir):
    base = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    overlay = base.filter("c_custkey % 10 = 0").select("c_custkey", F.lit("preview").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"))
    return catalog.overlay_point(base, overlay, ["c_custkey"])


@query("SELECT c_custkey AS id FROM customer WHERE c_nationkey = 3 UNION ALL SELECT s_suppkey FROM supplier")
def bulk_read_write(spark, sf_dir):
    c = catalog.Catalog()
    c.mount("people.customers", t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")))
    out = c.bulk([("create", "people.suppliers", t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))], ["people.suppliers", "people.nobody"])
    assert "error" in out["reads"][1]
    return c.read("people.customers", [3], ["nation"]).select("id").unionByName(out["reads"][0]["result"])


def _tuples(spark, sf_dir) -> DataFrame:
    """Customers are members of nations, nations of regions."""
    blank = F.lit(None).cast("string")
    region = lambda c: F.concat(F.lit("region:"), c)
    nation = lambda c: F.concat(F.lit("nation:"), c)
    a = t(spark, sf_dir, "customer").select(nation(F.col("c_nationkey")).alias("object"), F.lit("member").alias("relation"), F.col("c_custkey").cast("string").alias("user"), blank.alias("userset_object"), blank.alias("userset_relation"))
    b = t(spark, sf_dir, "nation").select(region(F.col("n_regionkey")).alias("object"), F.lit("member").alias("relation"), blank.alias("user"), nation(F.col("n_nationkey")).alias("userset_object"), F.lit("member").alias("userset_relation"))
    c = t(spark, sf_dir, "region").select(F.lit("world").alias("object"), F.lit("viewer").alias("relation"), blank.alias("user"), region(F.col("r_regionkey")).alias("userset_object"), F.lit("member").alias("userset_relation"))
    return a.unionByName(b).unionByName(c)


_MEMBERS = """SELECT 'nation:' || c_nationkey AS object, 'member' AS relation, c_custkey::VARCHAR AS "user" FROM customer
UNION SELECT 'region:' || n_regionkey, 'member', c_custkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION SELECT 'world', 'viewer', c_custkey::VARCHAR FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


@query(_MEMBERS)
def rebac_depth2(spark, sf_dir):
    return relations.expand(_tuples(spark, sf_dir), depth=2)


@query(_MEMBERS)
def rebac_closure(spark, sf_dir):
    return relations.expand(_tuples(spark, sf_dir))


@query("""WITH RECURSIVE m AS (SELECT s_suppkey AS g, s_suppkey AS u FROM supplier
UNION SELECT s.s_suppkey, m.u FROM m JOIN supplier s ON s.s_suppkey = m.g - 1 WHERE m.g % 8 <> 0)
SELECT 'group:' || g AS object, 'member' AS relation, u::VARCHAR AS "user" FROM m""")
def rebac_closure_chains(spark, sf_dir):
    """Chains of eight groups, each a member of the one before: seven levels of usersets."""
    blank = F.lit(None).cast("string")
    group = lambda c: F.concat(F.lit("group:"), c)
    s = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))
    head = [F.lit("member").alias("relation")]
    users = s.select(group(F.col("k")).alias("object"), *head, F.col("k").cast("string").alias("user"), blank.alias("userset_object"), blank.alias("userset_relation"))
    inner = s.filter("k % 8 <> 0").select((F.col("k") - 1).alias("at"), "k").join(s.select(F.col("k").alias("at")), "at", "left_semi")
    links = inner.select(group(F.col("at")).alias("object"), *head, blank.alias("user"), group(F.col("k")).alias("userset_object"), F.lit("member").alias("userset_relation"))
    return relations.expand(users.unionByName(links))


@query("""SELECT o_orderkey, EXISTS (
  SELECT 1 FROM customer c JOIN (SELECT DISTINCT c_mktsegment AS role, o_orderpriority AS action, o_orderstatus AS resource FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 250000) p ON p.role = c.c_mktsegment
  WHERE c.c_custkey = o.o_custkey AND p.action = o.o_orderpriority AND p.resource = o.o_orderstatus) AS allow FROM orders o""")
def rbac_allow(spark, sf_dir):
    """The flagship: bulk decisions by role, over all requests at once."""
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    user_roles = c.select(F.col("c_custkey").alias("user"), F.col("c_mktsegment").alias("role"))
    grants = o.filter("o_totalprice > 250000").join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("role"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("resource")).distinct()
    requests = o.select("o_orderkey", F.col("o_custkey").alias("user"), F.col("o_orderpriority").alias("action"), F.col("o_orderstatus").alias("resource"))
    return relations.rbac_decisions(requests, user_roles, grants).select("o_orderkey", "allow")


DUTY_RULE = """
package duty

default covered := false

covered if {
    segment := data.buyers[input.o_custkey]
    some duty in data.duties
    duty.c_mktsegment == segment
    duty.o_orderpriority == input.o_orderpriority
    duty.o_orderstatus == input.o_orderstatus
}
"""


@query(ORACLES["rbac_allow"])
def rbac_rule_text(spark, sf_dir):
    """The same decisions from a rule's text over flat grants: the plan joins requests, buyers and grants on their keys."""
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    duties = o.filter("o_totalprice > 250000").join(c, F.col("o_custkey") == F.col("c_custkey")).select("c_mktsegment", "o_orderpriority", "o_orderstatus").distinct()
    requests = o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    planner = Planner([DUTY_RULE], {"buyers": Table(c.select("c_custkey", "c_mktsegment"), "c_custkey"), "duties": Table(duties)})
    return planner.decide("duty.covered", requests, ["o_orderkey"], "allow").select("o_orderkey", "allow")


# -- rules chosen by a key known only when a row is read, functions of another namespace
_BY_SEGMENT = [
    "package offers.building\n\nallow if input.c_acctbal > 1000\n\nrate := 3",
    "package offers.machinery\n\ndefault allow := false\n\nallow if { input.c_acctbal < 0; input.c_nationkey % 2 == 1 }\n\nrate := 5 if input.c_nationkey > 10\n\nelse := 4",
    "package offers.household\n\nallow if not input.c_nationkey == 7",
    """package main

import data.text

open contains input.c_custkey if data.offers[text.low(input.c_mktsegment)].allow

rates contains {"c_custkey": input.c_custkey, "rate": data.offers[s].rate} if s := text.low(input.c_mktsegment)
""",
]


def _by_segment(spark, sf_dir, path: str) -> DataFrame:
    return Planner(_BY_SEGMENT, {}, {"data.text.low": F.lower}).relation(f"main.{path}", t(spark, sf_dir, "customer"))


@query(
    "SELECT c_custkey AS value FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_acctbal > 1000) OR (c_mktsegment = 'HOUSEHOLD' AND c_nationkey <> 7)"
    " OR (c_mktsegment = 'MACHINERY' AND c_acctbal < 0 AND c_nationkey % 2 = 1)"
)
def rule_chosen_by_key(spark, sf_dir):
    return _by_segment(spark, sf_dir, "open")


@query("SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 3 WHEN c_nationkey > 10 THEN 5 ELSE 4 END AS rate FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def rule_value_chosen_by_key(spark, sf_dir):
    return _by_segment(spark, sf_dir, "rates").filter("rate IS NOT NULL")


# -- tables as documents below their keys
def _store(spark, sf_dir) -> Mounts:
    lines = Mount("market/lines", t(spark, sf_dir, "lineitem"), ("l_orderkey", "l_linenumber"), {"item/part": "l_partkey", "item/supplier": "l_suppkey", "price": "l_extendedprice", "flag": "l_returnflag"})
    return Mounts([lines, Mount("market/nations", t(spark, sf_dir, "nation"), ("n_nationkey",))])


@query("SELECT l_linenumber, l_partkey AS part, l_suppkey AS supplier, l_returnflag AS flag FROM lineitem WHERE l_orderkey = 7")
def source_mount_below_key(spark, sf_dir):
    """``market/lines/7``: every document below one order; the key is a filter of the scan."""
    return _store(spark, sf_dir).read("market/lines/7").select("l_linenumber", "value.item.part", "value.item.supplier", "value.flag")


@query("SELECT l_suppkey AS value FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 2")
def source_mount_member(spark, sf_dir):
    return _store(spark, sf_dir).read("market/lines/7/2/item/supplier")


@query("SELECT l_orderkey, l_linenumber, l_suppkey AS supplier, l_returnflag AS flag FROM lineitem")
def source_mount_all(spark, sf_dir):
    return _store(spark, sf_dir).read("market/lines").select("l_orderkey", "l_linenumber", "value.item.supplier", "value.flag")


@query("SELECT n_nationkey, CASE n_nationkey WHEN 3 THEN 'ELSEWHERE' ELSE n_name END AS n_name, CASE n_nationkey WHEN 3 THEN -1 ELSE n_regionkey END AS n_regionkey FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 77, 'NOWHERE', 2")
def source_mount_written(spark, sf_dir):
    store = _store(spark, sf_dir)
    store.write("market/nations/3", {"n_name": "ELSEWHERE"})
    store.write("market/nations/77", {"n_name": "NOWHERE", "n_regionkey": 2})
    store.delete("market/nations/5")
    return store.read("market/nations").select("n_nationkey", "value.n_name", F.coalesce("value.n_regionkey", F.lit(-1)).alias("n_regionkey"))


# -- external stores over tables
@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 10")
def source_sql_send(spark, sf_dir):
    t(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return external.sql_frame(spark, {"driver": "spark", "query": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = ? AND c_custkey > ?", "args": ["BUILDING", 10]})


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey = 7 AND l_linenumber BETWEEN 1 AND 3")
def source_dynamodb_query(spark, sf_dir):
    request = {"key_condition_expression": "#o = :o AND l_linenumber BETWEEN :a AND :b", "expression_attribute_names": {"#o": "l_orderkey"}, "expression_attribute_values": {":o": {"N": "7"}, ":a": {"N": "1"}, ":b": {"N": "3"}}, "projection_expression": "#o, l_linenumber"}
    return external.dynamodb_query_frame(t(spark, sf_dir, "lineitem"), request, "l_linenumber")


@query("SELECT p_partkey, p_brand FROM part WHERE (p_size > 40 OR p_size <= 2) AND p_brand <> 'Brand#11'")
def source_mongodb_find(spark, sf_dir):
    request = {"filter": {"$or": [{"p_size": {"$gt": 40}}, {"p_size": {"$lte": 2}}], "p_brand": {"$ne": "Brand#11"}}, "options": {"projection": {"p_partkey": 1, "p_brand": 1}}}
    return external.mongodb_find_frame(t(spark, sf_dir, "part"), request)


@query("SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_type LIKE '%O%' ORDER BY p_size DESC, p_partkey LIMIT 25 OFFSET 5")
def source_mongodb_sorted(spark, sf_dir):
    """A request's own order, skip and limit."""
    request = {
        "filter": {"$and": [{"p_size": {"$gte": 10, "$lte": 20}}, {"p_type": {"$regex": "O"}}]},
        "options": {"projection": {"p_partkey": 1, "p_size": 1}, "sort": {"p_size": -1, "p_partkey": 1}, "skip": 5, "limit": 25},
    }
    return external.mongodb_find_frame(t(spark, sf_dir, "part"), request)


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders) AND o_orderkey < 1000000000 ORDER BY o_orderkey DESC LIMIT 3")
def source_dynamodb_page(spark, sf_dir):
    """A page of a key's rows, from the end, after a start key."""
    orders = t(spark, sf_dir, "orders")
    first = orders.agg(F.min("o_custkey")).first()[0]
    request = {
        "key_condition_expression": "o_custkey = :c", "expression_attribute_values": {":c": {"N": str(first)}}, "projection_expression": "o_custkey, o_orderkey, o_orderpriority",
        "scan_index_forward": False, "exclusive_start_key": {"o_orderkey": {"N": "1000000000"}}, "limit": 3,
    }
    return external.dynamodb_query_frame(orders, request, "o_orderkey")


@query("SELECT n_regionkey, count(*) AS scard, string_agg(n_name, ',' ORDER BY n_name) AS smembers, bool_or(n_name = 'FRANCE') AS sismember FROM nation GROUP BY 1")
def source_redis_sets(spark, sf_dir):
    s = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_set("n_name").alias("v"))
    r, v = external.REDIS, F.col("v")
    return s.select("n_regionkey", r["scard"](v).cast("long").alias("scard"), F.array_join(r["smembers"](v), ",").alias("smembers"), r["sismember"](v, "FRANCE").alias("sismember"))


def _stored(spark, sf_dir) -> DataFrame:
    """For each region a text, a list, a hash and a set, as a store of keys would hold them."""
    n = F.struct("n_nationkey", "n_name")
    g = t(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(n)).alias("rows"))
    names = F.transform("rows", lambda x: x["n_name"])
    return g.select(
        "n_regionkey", F.array_join(names, " ").alias("text"), names.alias("list"), names.alias("members"), F.map_from_arrays(names, F.transform("rows", lambda x: x["n_nationkey"])).alias("hash"),
        F.array(F.lit("FRANCE"), F.lit("KENYA"), F.get(names, F.lit(0))).alias("other"),
    )


_STORED = """WITH s AS (SELECT n_regionkey, string_agg(n_name, ' ' ORDER BY n_nationkey) AS text, list(n_name ORDER BY n_nationkey) AS l, list(n_nationkey ORDER BY n_nationkey) AS k FROM nation GROUP BY 1)
"""


@query(_STORED + """SELECT n_regionkey, text AS get, substr(text, 3, 4) AS middle, substr(text, length(text) - 3, 4) AS tail, strlen(text)::BIGINT AS strlen, text || '|' || l[1] AS mget FROM s""")
def source_redis_strings(spark, sf_dir):
    r, v = external.REDIS, F.col("text")
    return _stored(spark, sf_dir).select(
        "n_regionkey", r["get"](v).alias("get"), r["getrange"](v, 2, 5).alias("middle"), r["getrange"](v, -4, -1).alias("tail"), r["strlen"](v).cast("long").alias("strlen"),
        F.array_join(r["mget"](v, F.get("list", F.lit(0))), "|").alias("mget"),
    )


@query(_STORED + """SELECT n_regionkey, l[2] AS second, l[-1] AS last, len(l)::BIGINT AS llen, array_to_string(l[2:3], ',') AS middle, array_to_string(l[-2:], ',') AS tail, (CASE WHEN list_contains(l, 'KENYA') THEN list_position(l, 'KENYA') - 1 END)::BIGINT AS lpos FROM s""")
def source_redis_lists(spark, sf_dir):
    r, v = external.REDIS, F.col("list")
    return _stored(spark, sf_dir).select(
        "n_regionkey", r["lindex"](v, 1).alias("second"), r["lindex"](v, -1).alias("last"), r["llen"](v).cast("long").alias("llen"), F.array_join(r["lrange"](v, 1, 2), ",").alias("middle"),
        F.array_join(r["lrange"](v, -2, -1), ",").alias("tail"), r["lpos"](v, "KENYA").cast("long").alias("lpos"),
    )


@query(_STORED + """SELECT n_regionkey, (CASE WHEN list_contains(l, 'FRANCE') THEN k[list_position(l, 'FRANCE')] END)::BIGINT AS hget, list_contains(l, 'KENYA') AS hexists, array_to_string(list_sort(l), ',') AS hkeys,
  len(l)::BIGINT AS hlen, list_sum(k)::BIGINT AS hgetall, coalesce((CASE WHEN list_contains(l, 'KENYA') THEN k[list_position(l, 'KENYA')] END)::VARCHAR, '-') || ',' || coalesce((CASE WHEN list_contains(l, 'PERU') THEN k[list_position(l, 'PERU')] END)::VARCHAR, '-') AS hmget, TRUE AS hrandfield FROM s""")
def source_redis_hashes(spark, sf_dir):
    r, v = external.REDIS, F.col("hash")
    return _stored(spark, sf_dir).select(
        "n_regionkey", r["hget"](v, "FRANCE").cast("long").alias("hget"), r["hexists"](v, "KENYA").alias("hexists"), F.array_join(r["hkeys"](v), ",").alias("hkeys"), r["hlen"](v).cast("long").alias("hlen"),
        F.aggregate(F.map_values(r["hgetall"](v)), F.lit(0).cast("long"), lambda a, x: a + x).alias("hgetall"), F.array_join(r["hmget"](v, "KENYA", "PERU").cast("array<string>"), ",", "-").alias("hmget"),
        F.map_contains_key(v, r["hrandfield"](v)).alias("hrandfield"),
    )


@query(_STORED + """, o AS (SELECT n_regionkey, l, ['FRANCE', 'KENYA', l[1]] AS x FROM s)
SELECT n_regionkey, array_to_string(list_sort(list_filter(l, lambda e: NOT list_contains(x, e))), ',') AS sdiff, array_to_string(list_sort(list_filter(l, lambda e: list_contains(x, e))), ',') AS sinter,
  len(list_filter(l, lambda e: list_contains(x, e)))::BIGINT AS sintercard, array_to_string(list_sort(list_distinct(l || x)), ',') AS sunion, list_contains(l, 'FRANCE')::VARCHAR || ',' || list_contains(l, 'CHINA')::VARCHAR AS smismember, TRUE AS srandmember FROM o""")
def source_redis_set_algebra(spark, sf_dir):
    r, v, o = external.REDIS, F.col("members"), F.col("other")
    return _stored(spark, sf_dir).select(
        "n_regionkey", F.array_join(r["sdiff"](v, o), ",").alias("sdiff"), F.array_join(r["sinter"](v, o), ",").alias("sinter"), r["sintercard"](v, o).cast("long").alias("sintercard"),
        F.array_join(r["sunion"](v, o), ",").alias("sunion"), F.array_join(r["smismember"](v, "FRANCE", "CHINA").cast("array<string>"), ",").alias("smismember"), F.array_contains(v, r["srandmember"](v)).alias("srandmember"),
    )
