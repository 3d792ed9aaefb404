"""Access by roles and by relationships."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.lineage import cut

def rbac_decisions(requests: DataFrame, user_roles: DataFrame, role_permissions: DataFrame, name: str = "allow") -> DataFrame:
    """requests (user, action, resource, ...) with a boolean: some role of the user has the permission.

    ``user_roles``: (user, role) rows; ``role_permissions``: (role, action, resource) rows. The distinct questions meet
    the roles of their users and then, in a semi-join, the permissions: rows stay within questions times roles a
    user, however many permissions the roles have."""
    asked = requests.select("user", "action", "resource").distinct()
    held = asked.join(user_roles, "user").join(role_permissions, ["role", "action", "resource"], "left_semi")
    granted = held.select("user", "action", "resource").distinct().withColumn(name, F.lit(True))
    out = requests.join(granted, ["user", "action", "resource"], "left")
    return out.select(*[requests[c] for c in requests.columns], F.coalesce(name, F.lit(False)).alias(name))


FOLD = 16  # rounds after which the pairs found so far become one checkpoint


def rounds(limit: int | None) -> Iterable[int]:
    return count() if limit is None else range(limit)


def expand(tuples: DataFrame, depth: int | None = None, max_depth: int | None = None) -> DataFrame:
    """Members of (object, relation) through usersets: (object, relation, user).

    ``tuples``: (object, relation, user, userset_object, userset_relation); a row names a user or a userset. ``depth``
    limits the indirections; None follows all of them until no new pair appears (a semi-naive iteration: each round joins
    only new pairs, so cycles end). More than ``max_depth`` rounds, if it is given, raise ``RuntimeError``."""
    direct = tuples.filter("user IS NOT NULL").select("object", "relation", "user").distinct()
    links = tuples.filter("userset_object IS NOT NULL").select("object", "relation", "userset_object", "userset_relation").distinct()
    found, new = direct, direct
    for i in rounds(max_depth if depth is None else depth):
        member = new.select(F.col("object").alias("userset_object"), F.col("relation").alias("userset_relation"), "user")
        step = links.join(member, ["userset_object", "userset_relation"]).select("object", "relation", "user").distinct()
        new = step.join(found, ["object", "relation", "user"], "left_anti")
        if depth is None:
            new = cut(new)
            if not new.take(1):
                return found
        found = found.unionByName(new)
        if depth is None and i % FOLD == FOLD - 1:
            found = cut(found)
    if depth is None:
        raise RuntimeError(f"usersets are nested deeper than {max_depth}")
    return found


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(root, node) for each node that edges (parent, child) reach from a root, itself included; of any length unless ``max_depth`` is given."""
    found = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node")).distinct()
    new = found
    for i in rounds(max_depth):
        step = new.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        new = step.join(found, ["root", "node"], "left_anti")
        new = cut(new)
        if not new.take(1):
            return found
        found = found.unionByName(new)
        if i % FOLD == FOLD - 1:
            found = cut(found)
    raise RuntimeError(f"paths are longer than {max_depth}")


def inherit(owners: DataFrame, parents: DataFrame, depth: int) -> DataFrame:
    """(object, user): owners of an object or of one of its ancestors up to ``depth`` levels above."""
    levels, at = [owners.select("object", "user")], owners.select("object", "user")
    for _ in range(depth):
        at = parents.join(at.withColumnRenamed("object", "parent"), "parent").select("object", "user")
        levels.append(at)
    return reduce(lambda a, b: a.unionByName(b), levels).distinct()
