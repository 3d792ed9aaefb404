"""Random condition trees: the Column, the SQL text and a plain evaluation must select the same rows."""

import duckdb
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lodestar.plans import conditions as c

ROWS = [(i, n, s) for i, (n, s) in enumerate([(None, None), (0, "a"), (1, "ab"), (2, None), (None, "b'c"), (5, "xyz"), (5, ""), (-3, "abc")])]

numbers = st.one_of(
    st.builds(lambda op, v: {"type": "field", "operator": op, "field": "n", "value": v}, st.sampled_from(["eq", "ne", "lt", "lte", "gt", "gte", "ge", "le"]), st.integers(-3, 6)),
    st.builds(lambda op, v: {"type": "field", "operator": op, "field": "n", "value": v}, st.sampled_from(["in", "nin"]), st.lists(st.integers(-3, 6), min_size=1, max_size=3)),
    st.builds(lambda op: {"type": "field", "operator": op, "field": "n", "value": {"field": "id"}}, st.sampled_from(["eq", "lt", "gte"])),
)
texts = st.one_of(
    st.builds(lambda op, v: {"type": "field", "operator": op, "field": "s", "value": v}, st.sampled_from(["eq", "ne", "startswith", "endswith", "contains", "lt"]), st.sampled_from(["a", "b", "b'", "", "abc"])),
    st.builds(lambda op: {"type": "field", "operator": op, "field": "s", "value": None}, st.sampled_from(["eq", "ne"])),
)
trees = st.recursive(
    numbers | texts,
    lambda t: st.one_of(
        st.builds(lambda op, v: {"type": "compound", "operator": op, "value": v}, st.sampled_from(["and", "or"]), st.lists(t, min_size=1, max_size=3)),
        st.builds(lambda v: {"type": "compound", "operator": "not", "value": [v]}, t),
    ),
    max_leaves=6,
)


def _plain(tree, row):
    """Three-valued: True, False or None."""
    op, value = tree["operator"], tree.get("value")
    if tree["type"] == "compound":
        parts = [_plain(t, row) for t in value]
        if op == "not":
            return None if parts[0] is None else not parts[0]
        sure = op == "or"
        return sure if sure in parts else None if None in parts else not sure
    own = row[tree["field"]]
    if value is None:
        return (own is None) == (op == "eq")
    if isinstance(value, dict):
        value = row[value["field"]]
    if own is None or value is None:
        return None
    return {
        "eq": lambda: own == value, "ne": lambda: own != value, "lt": lambda: own < value, "gt": lambda: own > value, "lte": lambda: own <= value, "le": lambda: own <= value,
        "gte": lambda: own >= value, "ge": lambda: own >= value, "in": lambda: own in value, "nin": lambda: own not in value,
        "startswith": lambda: own.startswith(value), "endswith": lambda: own.endswith(value), "contains": lambda: value in own,
    }[op]()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=trees)
def test_three_ways_agree(spark, tree):
    cond = c.parse(tree)
    want = [r[0] for r in ROWS if _plain(tree, dict(zip(("id", "n", "s"), r, strict=True))) is True]
    df = spark.createDataFrame(ROWS, "id int, n int, s string")
    assert sorted(r.id for r in cond.where(df).collect()) == want
    db = duckdb.connect()
    db.execute("CREATE TABLE t (id INT, n INT, s VARCHAR)")
    db.executemany("INSERT INTO t VALUES (?, ?, ?)", ROWS)
    assert [r[0] for r in db.execute(f"SELECT id FROM t {c.where_clause(cond, 'sqlite')} ORDER BY id").fetchall()] == want
    assert c.parse(cond.to_dict()) == cond
