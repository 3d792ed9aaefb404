"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins. The aggregates are written before they are joined: a join that reuses
an aggregate's partitioning would bring all edges of a hot vertex to one task, while both sides of these joins are
exchanged by the join itself, so that AQE can split a hot vertex. The edges of a round are a written table, so a lost executor costs one
round at most. Edges never reach the driver: it sees a count and a checksum for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import discard, materialize


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Null ends and self-loops are dropped, repeated edges count once, and an empty table gives an empty table.
    """
    pairs = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v"))
    pairs = pairs.filter("u IS NOT NULL AND v IS NOT NULL AND u <> v").distinct()
    now = materialize(pairs, "cc")
    state = _checksum(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        stars, least = _large_star(now)
        large = materialize(stars, "cc-large")
        discard(now, least)
        stars, least = _small_star(large)
        nxt = materialize(stars, "cc")
        discard(large, least)
        after = _checksum(nxt)
        now, done, state = nxt, after == state, after
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every edge is (node, smallest node of its component)
    members = now.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("component"))
    roots = now.select(F.least("u", "v").alias("node")).distinct().withColumn("component", F.col("node"))
    return members.unionByName(roots)


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each vertex's larger neighbours point to its smallest; and the written table of smallest ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("m", "u").alias("m"))
    least = materialize(least, "cc-least")
    larger = both.filter("v > u")
    return larger.join(least, larger.u == least.c).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each vertex and its smaller neighbours point to the smallest of these; and the written table of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v")
    least = materialize(down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "c"), "cc-least")
    joined = down.join(least, down.u == least.c)
    out = joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
    return out.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u <> v").distinct(), least
