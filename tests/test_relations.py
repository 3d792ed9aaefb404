from lodestar.operators import relations


def test_chains_longer_than_fifty_levels_are_followed_and_cycles_end(spark):
    n = 53
    rows = [("g0", "m", "u", None, None)] + [(f"g{i}", "m", None, f"g{i - 1}", "m") for i in range(1, n)] + [("g0", "m", None, "g1", "m")]
    tuples = spark.createDataFrame(rows, "object string, relation string, user string, userset_object string, userset_relation string").coalesce(1)
    assert {r.object for r in relations.expand(tuples).collect()} == {f"g{i}" for i in range(n)}


def test_paths_longer_than_fifty_steps_are_followed(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(53)] + [(1, 0)], "parent long, child long").coalesce(1)
    assert {r.node for r in relations.reachable(edges, spark.createDataFrame([(0,)], "root long")).collect()} == set(range(54))
