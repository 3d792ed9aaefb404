"""Queries over whole tables and nested documents equal their SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lodestar.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


WHOLE = [
    "fn_walk_nested_leaves", "rule_theta_join_all", "rebac_closure_chains", "rule_array_comp", "rule_set_comp", "rule_object_comp", "rule_comp_totals", "rule_comp_decide", "rule_with_input",
    "rule_with_data", "rule_set_intersect", "rule_set_except", "fn_digests", "fn_bits", "fn_texts", "fn_times", "fn_any_prefix_match", "fn_kinds", "fn_set_operators", "json_patch_operations",
    "source_redis_strings", "source_redis_lists", "source_redis_hashes", "source_redis_set_algebra", "source_mongodb_sorted", "source_dynamodb_page", "filter_startswith",
]


@pytest.mark.parametrize("name", WHOLE)
def test_equals_its_sql(spark, name):
    with duckdb.connect() as db:
        for p in Path(DATA).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        rows = db.execute(ORACLES[name])
        names = [d[0] for d in rows.description]
        want = Counter(tuple(v for _, v in sorted(zip(names, row, strict=True), key=lambda x: x[0])) for row in rows.fetchall())
    df = QUERIES[name](spark, DATA)
    got = Counter(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert got == want and want
