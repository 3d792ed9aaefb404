import pytest
from pyspark.sql import functions as F

from lodestar.plans.evaluate import Engine
from lodestar.plans.relational import Planner
from lodestar.plans.targets import FragmentError
from lodestar.sources.mounts import Mount, MountError, Mounts, discover


@pytest.fixture
def stock(spark):
    rows = [("eu", 1, "bolt", {"w": 2}, 5), ("eu", 2, "nut", {}, None), ("us", 1, "gear", {"w": 9}, 7)]
    return spark.createDataFrame(rows, "zone string, id long, title string, size map<string,int>, held int")


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_paths_are_keys_then_members(stock):
    m = Mounts([Mount("shop/stock", stock, ("zone", "id"), {"name": "title", "store/size": "size", "store/held": "held"})])
    assert m.read("shop/stock").columns == ["zone", "id", "value"]
    assert _rows(m.read("/shop/stock/eu").select("id", "value.name", "value.store.held")) == [(1, "bolt", 5), (2, "nut", None)]
    assert _rows(m.read("shop/stock/us/1/name")) == [("gear",)]
    assert _rows(m.read("shop/stock/us/1/store/size/w")) == [(9,)]
    assert _rows(m.read("shop/stock/eu/2/store/size/w")) == [] and _rows(m.read("shop/stock/eu/2/store/held")) == []
    assert _rows(m.read("shop/stock/eu/x")) == []  # no number
    with pytest.raises(MountError):
        m.read("shop/stock/eu/1/price")
    with pytest.raises(MountError):
        m.read("shop/other")
    with pytest.raises(MountError):
        m.add(Mount("shop", stock))


def test_keys_reach_the_scan(spark, stock, tmp_path, capsys):
    stock.write.parquet(str(tmp_path / "s"))
    Mount("s", spark.read.parquet(str(tmp_path / "s")), ("zone", "id")).read(("eu", "2", "title")).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(id,2)" in plan and "EqualTo(zone,eu)" in plan and "held" not in plan


def test_writes_and_whole_documents(stock):
    m = Mounts([Mount("s", stock, ("zone", "id")), Mount("t", stock.select("zone", "title"), ("zone",), {"": "title"})])
    m.write("s/eu/2", {"title": "nail", "size": {"w": 1}})
    m.write("s/ap/3", {"held": 1})
    m.delete("s/us")
    assert _rows(m.read("s").select("zone", "id", "value.title", "value.held")) == [("ap", 3, None, 1), ("eu", 1, "bolt", 5), ("eu", 2, "nail", None)]
    assert _rows(m.read("t/us")) == [("gear",)]
    with pytest.raises(MountError):
        m.write("s/eu", {})
    assert m.below("") == ["s", "t"]


def test_discovery(spark, stock):
    columns = spark.createDataFrame([("public", "stock", c) for c in stock.columns] + [("public", "log", "x"), ("other", "hidden", "x")], "TABLE_SCHEMA string, TABLE_NAME string, COLUMN_NAME string")
    constraints = spark.createDataFrame([("public", "stock", "pk", "PRIMARY KEY"), ("public", "stock", "fk", "FOREIGN KEY")], "TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_NAME string, CONSTRAINT_TYPE string")
    usage = spark.createDataFrame([("public", "stock", "pk", "id", 2), ("public", "stock", "pk", "zone", 1), ("public", "stock", "fk", "held", 1)], "TABLE_SCHEMA string, TABLE_NAME string, CONSTRAINT_NAME string, COLUMN_NAME string, ORDINAL_POSITION int")
    m = discover(columns, constraints, usage, lambda name: {"public.stock": stock, "public.log": spark.range(2).toDF("x")}[name], root="db/main")
    assert m.below("db") == ["db/main/log", "db/main/stock"]
    assert _rows(m.read("db/main/stock/eu/1/title")) == [("bolt",)]
    assert m.read("db/main/log").count() == 2


CHOSEN = [
    "package desk.orders\n\nallow if input.total < 100\n\ncost := input.total * 2",
    "package desk.parts\n\ndefault allow := false\n\nallow if input.size < 10\n\nhalf(x) := x / 2",
    """package main

import data.desk.parts as p
import data.geo

open contains input.id if data.desk[input.kind].allow

cost contains {"id": input.id, "cost": c} if { k := input.kind; c := data.desk[k].cost }

near contains input.id if geo.far(input.size) > p.half(input.total)
""",
]


def test_rules_chosen_by_a_key_and_functions_of_other_namespaces(spark):
    rows = [(1, "orders", 5, 50), (2, "orders", 500, 50), (3, "parts", 900, 3), (4, "parts", 5, 70), (5, "none", 1, 1), (6, None, 1, 1)]
    inputs = spark.createDataFrame(rows, "id int, kind string, total int, size int")
    far = lambda x: x * 10
    planner = Planner(CHOSEN, {}, {"data.geo.far": far})
    assert _rows(planner.relation("main.open", inputs)) == [(1,), (3,)]
    assert sorted((r.id, r.cost) for r in planner.relation("main.cost", inputs).collect()) == [(1, 10), (2, 1000)]
    engine = Engine(CHOSEN, functions={"data.geo.far": far})
    for path, given in (("open", "id"), ("near", "id")):
        want = [v for i, k, t, s in rows for v in engine.query(f"data.main.{path}", {"id": i, "total": t, "size": s} | ({"kind": k} if k else {}))]
        assert sorted(r[0] for r in planner.relation(f"main.{path}", inputs).collect()) == sorted(want)
    with pytest.raises(FragmentError):
        Planner(CHOSEN, {}).relation("main.near", inputs)


def test_trace():
    for kind, want in (("names", None), ("values", [10]), ("hashes", ["4a44dc15364204a80fe80e9039455cc1608281820fe2b24f1e5233ade6af1dd5"])):
        engine = Engine(CHOSEN, functions={"data.geo.far": len}, trace=kind)
        engine.query("data.main.cost", {"id": 1, "kind": "orders", "total": 5})
        assert engine.traced["data.desk.orders.cost"] == want and "data.main.cost" in engine.traced
    engine = Engine(CHOSEN, trace="hashes")
    engine.query("data.desk.orders.allow", {"total": 500}, default=None)
    assert engine.traced == {"data.desk.orders.allow": ["0" * 64]}
    with pytest.raises(ValueError):
        Engine([], trace="all")
