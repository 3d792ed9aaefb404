"""Queries over keys, values and sizes that the small tables don't have equal their SQL."""

import json
import math
import operator
import random
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestar.functions import documents
from lodestar.functions.values import type_name, walk
from lodestar.plans import relational
from lodestar.plans.relational import Planner, Table
from lodestar.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def tables(folder: Path, **changed: str) -> str:
    """A folder of the small tables; ``changed``: SQL of those that differ."""
    with duckdb.connect() as db:
        for p in Path(DATA).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        for p in Path(DATA).glob("*.parquet"):
            db.execute(f"COPY ({changed.get(p.stem, f'SELECT * FROM {p.stem}')}) TO '{folder / p.name}' (FORMAT parquet)")
    return str(folder)


def agrees(spark, name: str, folder: str) -> Counter:
    with duckdb.connect() as db:
        for p in Path(folder).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rows = db.execute(ORACLES[name])
        names = [d[0] for d in rows.description]
        want = Counter(tuple(v for _, v in sorted(zip(names, row, strict=True), key=lambda x: x[0])) for row in rows.fetchall())
    df = QUERIES[name](spark, folder)
    got = Counter(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert got == want and want
    return got


def test_times_beyond_64_bits(spark, tmp_path):
    """Nanoseconds of the event ids of larger tables: beyond the year 2262 (id 88,234) and beyond 9999."""
    folder = tables(tmp_path, events="SELECT * REPLACE ([0, 88234, 88235, 99999, 6000000, 36000000][event_id + 1] AS event_id) FROM events WHERE event_id < 6")
    assert len(agrees(spark, "fn_times", folder)) == 6


PAIRS = """
package pairs

found contains {"a": x.k, "b": y.k} if {
    some x in data.left
    x.use
    some y in data.right
    z := y.v
    z OP x.v
}
"""


@pytest.mark.parametrize("op", ["<", "<=", ">", ">="])
def test_compared_tables_and_their_totals(spark, op, monkeypatch):
    """Ties, NULL, NaN, equal keys with several values, keys that are NULL, in one range and in many."""
    compare = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}[op]
    rng = random.Random(7)
    rows = lambda n: [(rng.choice([None, *range(12)]), rng.choice([None, math.nan, math.inf, -0.0, 0.0, *[i / 2 for i in range(-9, 9)]]), rng.random() < 0.8) for _ in range(n)]
    left, right = rows(40), rows(30)
    as_key = lambda v: (math.isnan(v), 0.0 if math.isnan(v) else v)
    want = {(a, b) for a, x, use in left for b, y, _ in right if use and None not in (x, y) and compare(as_key(y), as_key(x))}
    frame = lambda rows: Table(spark.createDataFrame(rows, "k int, v double, use boolean"))
    planner = Planner([PAIRS.replace("OP", op)], {"left": frame(left), "right": frame(right)})
    found = planner.relation("pairs.found")
    assert Counter(map(tuple, found.collect())) == Counter(want)
    for by, other in (("a", "b"), ("b", "a")):
        groups: dict = {}
        for a, b in want:
            groups.setdefault(a if by == "a" else b, []).append(b if by == "a" else a)
        totals = {k: (len(v), min((x for x in v if x is not None), default=None), max((x for x in v if x is not None), default=None)) for k, v in groups.items()}
        for values in (2, 50_000):
            monkeypatch.setattr(relational, "RANGE_VALUES", values)
            df = planner.totals("pairs.found", [by], n=("count", "*"), first=("min", other), last=("max", other))
            assert sorted(((r[0], tuple(r)[1:]) for r in df.collect()), key=str) == sorted(totals.items(), key=str)
            assert "NestedLoop" not in plan(df) and "Cartesian" not in plan(df)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_of_an_inequality_build_no_pairs(spark):
    assert "NestedLoop" not in (text := plan(QUERIES["rule_theta_join_all"](spark, DATA))) and "Cartesian" not in text


def test_pairs_are_not_shuffled_and_made_in_many_tasks(spark):
    """Nothing is above the nested loop, which runs in many tasks though its tables are small files."""
    df = QUERIES["rule_theta_join"](spark, DATA)
    text = plan(df)
    above = text.split("NestedLoop")[0]
    assert "Aggregate" not in above and "Exchange" not in above and df.rdd.getNumPartitions() >= relational.PAIR_TASKS
    agrees(spark, "rule_theta_join", DATA)


def test_empty_tables_compare_with_nothing(spark, tmp_path):
    folder = tables(tmp_path, supplier="SELECT * FROM supplier WHERE FALSE")
    for name in ("rule_theta_join", "rule_theta_join_all"):
        assert QUERIES[name](spark, folder).count() == 0


def test_walk_of_odd_documents(spark):
    """Nodes in pre-order as a plain walk gives them; nothing for null and bad documents, whose rows stay."""
    texts = [
        None, "", "{", "nothing", "3", "null", '"x"', "{}", "[]", "[[], {}]", '{"a": 1, "a": [true, false, null]}', '{"a~b/c": {"": {"é": "ü\\n\\"q\\""}}}', "[1.0, -0.0, 1e400, NaN, 12345678901234567890]",
        '{"b": {"z": 1, "a": [1, {"x": "y"}]}, "a": 0}', "[" * 300 + "7" + "]" * 300,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r.id: r for r in df.select("id", documents.walked(F.col("text")).alias("all"), documents.walked(F.col("text"), leaves=True).alias("leaves")).collect()}
    for i, text in enumerate(texts):
        try:
            doc = json.loads(text or "")
        except ValueError:
            assert got[i]["all"] is None and got[i]["leaves"] is None
            continue
        want = [(documents.format_pointer(p), json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False), type_name(v)) for p, v in walk(doc)]
        assert list(map(tuple, got[i]["all"])) == want
        assert list(map(tuple, got[i]["leaves"])) == [x for x in want if x[2] not in ("object", "array")]
    half = spark.range(1).select(F.inline(documents.walked(F.lit('["\\ud800", "b"]'), leaves=True))).collect()
    assert [r.value for r in half] == ['"?"', '"b"']


@pytest.mark.parametrize("name", ["fn_walk_leaves", "fn_walk_nested_leaves"])
def test_walks_go_by_batches(spark, name):
    """Documents travel in Arrow batches, and no table that grows is broadcast."""
    text = plan(QUERIES[name](spark, DATA))
    assert "ArrowEvalPython" in text and "Broadcast" not in text and "UDTF" not in text
    agrees(spark, name, DATA)
