"""Embedding near-duplicates by p-stable hashing.

Unit vectors are projected on Gaussian directions, shifted and quantised to steps of ``width``; ``functions`` codes
together name a bucket, in ``tables`` tables. A cosine of 0.93 is a distance of 0.374: at width 1.5 one code then
agrees with probability 0.80, so all tables miss such a pair with probability below 1e-4, while unrelated vectors
(distance 1.41) share a bucket of one table with probability 0.0034.

Equal vectors of a label are one class with a count. Large buckets are cut into blocks of about ``block`` vectors,
compared block by block; a task holds two blocks at most. Every table's task checks exact cosines in double
precision, counts a pair only in the first table that has it, and emits sums and spanning edges, never pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import connected_components
from lodestar.llm.storage import discard, materialize
from lodestar.llm.text import STEP, column, mix64


def projections(dim: int, tables: int, functions: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * functions)), rng.uniform(0, width, tables * functions)


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one dimension as rows of doubles."""
    flat = np.asarray(lists.flatten()).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / np.where(big > 0, big, 1)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def bucket_keys(x: np.ndarray, tables: int, functions: int, width: float, seed: int) -> np.ndarray:
    """(vectors x tables) keys; the table is part of the key."""
    a, b = projections(x.shape[1], tables, functions, width, seed)
    codes = np.floor((x @ a + b) / width).astype(np.int64).view(np.uint64).reshape(len(x), tables, functions)
    acc = np.broadcast_to(mix64(np.arange(1, tables + 1, dtype=np.uint64) + np.uint64(x.shape[1] << 20)), (len(x), tables)).copy()
    for i in range(functions):
        acc = mix64((acc * STEP + codes[:, :, i]).ravel()).reshape(acc.shape)
    return acc.view(np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], least: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a stream that is sorted by ``keys``, of ``least`` rows or more, with each group's begin."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < least:
            continue
        table = pa.concat_tables(held)
        begins = group_begins(table, keys)
        if len(begins) > 1:
            yield table.slice(0, int(begins[-1])), begins[:-1]
            table = table.slice(int(begins[-1]))
        held, rows = [table], table.num_rows
    if held:
        table = pa.concat_tables(held)
        yield table, group_begins(table, keys)


def group_begins(table: pa.Table, keys: list[str]) -> np.ndarray:
    k = np.stack([np.asarray(column(table, name)) for name in keys])
    return np.append(0, np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1)


def local_roots(n: int, a: np.ndarray, b: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """For each of n rows the row of the smallest rank that the links (a, b) reach from it."""
    order = np.argsort(rank, kind="stable")
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    u, v = back[a], back[b]
    label = np.arange(n)
    while True:
        nxt = label.copy()
        np.minimum.at(nxt, u, label[v])
        np.minimum.at(nxt, v, label[u])
        nxt = np.minimum(nxt, nxt[nxt])
        if (nxt == label).all():
            return order[label[back]]
        label = nxt


class Rows:
    """The vectors of some block pairs as arrays. ``table`` is the table of keys that each row's bucket belongs to."""

    def __init__(self, group: pa.Table, keys_of):
        self.rep, self.own, self.label, self.m, self.table, self.i, self.j = (np.asarray(column(group, c)) for c in ("rep", "own", "lab", "m", "table", "i", "j"))
        self.x = unit(matrix(column(group, "embedding")))
        self.keys_of = keys_of

    def settle(self, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(vector, links counted here, root here) from the linked pairs of rows p and q."""
        if not len(p):
            return None
        some, place = np.unique(np.concatenate((p, q)), return_inverse=True)
        a, b = place[: len(p)], place[len(p) :]
        counts = np.zeros(len(some), np.int64)
        keys = self.keys_of(self.x[some], self.label[some])
        for lo in range(0, len(a), 1 << 18):  # a pair counts in the first table that has it
            u, v = a[lo : lo + (1 << 18)], b[lo : lo + (1 << 18)]
            first = (keys[u] == keys[v]).argmax(axis=1) == self.table[some[u]]
            np.add.at(counts, u[first], self.m[some[v[first]]])
            np.add.at(counts, v[first], self.m[some[u[first]]])
        return self.rep[some], counts, self.rep[some[local_roots(len(some), a, b, self.rep[some])]]

    def may_link(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Labels agree, and two blocks are compared across only."""
        return (self.label[p] == self.label[q]) & ((self.i[p] == self.j[p]) | (self.own[p] != self.own[q])) & (self.rep[p] != self.rep[q])


def compare_large(rows: Rows, a: int, b: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of one group of rows [a, b), by a product of matrices."""
    x = rows.x[a:b]
    p, q = np.nonzero(np.triu(x @ x.T >= cosine, 1))
    p, q = p + a, q + a
    keep = rows.may_link(p, q)
    return p[keep], q[keep]


def compare_small(rows: Rows, begins: np.ndarray, ends: np.ndarray, cosine: float, step: int = 1 << 15) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of many small groups, all pairs of each one, ``step`` pairs at a time."""
    sizes = ends - begins
    at = np.repeat(begins - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    later = np.repeat(ends, sizes) - at - 1
    bound = np.cumsum(later)
    out = []
    for lo in range(0, int(bound[-1]) if len(bound) else 0, step):
        n = np.arange(lo, min(lo + step, int(bound[-1])))
        row = np.searchsorted(bound, n, side="right")
        p = at[row]
        q = p + 1 + n - (bound[row] - later[row])
        keep = rows.may_link(p, q)
        p, q = p[keep], q[keep]
        near = np.einsum("ij,ij->i", rows.x[p], rows.x[q]) >= cosine
        out.append((p[near], q[near]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x[0] for x in out)]), np.concatenate([none, *(x[1] for x in out)])


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.93, tables: int = 32, functions: int = 6, width: float = 1.5, block: int = 1024, seed: int = 23
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors are compared only under equal labels that are not null; null, empty and zero vectors and those with null
    or non-finite components link with nothing. n_links counts the other vectors of a link found (copies too).
    A row with a null vec_id links with nothing: component_id null, kept true. Repeated ids are one vector. An empty
    table gives an empty table; other columns are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.xxhash64(F.col("label").cast("string")).alias("lab"), F.col("label").isNotNull().alias("labelled"), "embedding")
    sound = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("embedding", lambda c: c != 0)
    v = v.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & F.col("labelled") & sound, F.lit(False)))
    name = [F.xxhash64("embedding").alias("h1"), F.xxhash64(F.lit(seed), F.size("embedding"), "embedding").alias("h2")]
    named = materialize(v.filter("ok").select("vec_id", "lab", *name, "embedding").dropDuplicates(["vec_id", "lab", "h1", "h2"]), "pstable-vectors")
    classes = materialize(named.groupBy("lab", "h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m")), "pstable-classes")
    reps = named.withColumnRenamed("vec_id", "rep").join(classes, ["lab", "h1", "h2", "rep"])

    def keys_of(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        keys = bucket_keys(x, tables, functions, width, seed)
        return mix64((keys.view(np.uint64) ^ label.view(np.uint64)[:, None]).ravel()).reshape(keys.shape).view(np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e = batch.column("embedding")
            dims = np.diff(np.asarray(e.offsets))
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                keys = keys_of(unit(matrix(part.column("embedding"))), np.asarray(part.column("lab")))
                yield part.append_column("keys", pa.array(list(keys), pa.list_(pa.int64())))

    cols = reps.select("rep", "lab", "h1", "m", "embedding")
    kind = dict(cols.dtypes)["embedding"]
    keyed = materialize(cols.mapInArrow(hashed, f"rep long, lab long, h1 long, m long, embedding {kind}, keys array<long>"), "pstable-keys")
    # several vectors of one id stay apart by class; buckets are cut by the id's hash
    # buckets of one vector send nothing; the others are cut into blocks before any vector is sent
    shared = keyed.select(F.explode("keys").alias("key")).groupBy("key").count().filter("count > 1")
    shared = materialize(shared.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "pstable-shared")
    names = keyed.select("rep", "lab", "h1", F.posexplode("keys").alias("table", "key")).join(shared, "key")
    names = names.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), "blocks").cast("int"))
    names = names.select("rep", "lab", "h1", F.struct("key", "table", "blocks", "own").alias("b")).groupBy("rep", "lab", "h1").agg(F.collect_list("b").alias("buckets"))  # one of each table at most
    rows = keyed.select("rep", "lab", "h1", "m", "embedding").join(names, ["rep", "lab", "h1"]).select("rep", "lab", "m", "embedding", F.explode("buckets").alias("b")).select("rep", "lab", "m", "embedding", "b.*")
    dealt = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "table", "rep", "lab", "m", "embedding")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for group, begins in whole_groups(batches, ["key", "i", "j"]):
            ends = np.append(begins[1:], group.num_rows)
            dims = np.diff(np.asarray(column(group, "embedding").offsets))[begins]  # a key tells the dimension
            for d in np.unique(dims):
                sizes = ends - begins
                take = np.repeat(dims == d, sizes)
                rows = Rows(group.filter(pa.array(take)), keys_of)
                own = sizes[dims == d]
                end = np.cumsum(own)
                begin = end - own
                small = own <= 64
                found = [compare_small(rows, begin[small], end[small], cosine), *(compare_large(rows, a, b, cosine) for a, b in zip(begin[~small].tolist(), end[~small].tolist(), strict=True))]
                if (links := rows.settle(np.concatenate([p for p, _ in found]), np.concatenate([q for _, q in found]))) is not None:
                    held.append(links)
            if sum(len(x[0]) for x in held) > 50_000:
                yield _batch(held)
                held = []
        yield _batch(held)

    placed = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links = materialize(placed.mapInArrow(check, "vec long, links long, root long").groupBy("vec", "root").agg(F.sum("links").alias("links")), "pstable-links")
    comp = materialize(connected_components(links.filter("vec <> root").select(F.col("vec").alias("src"), F.col("root").alias("dst"))), "pstable-comp")
    counted = links.groupBy("vec").agg(F.sum("links").alias("links"))
    per_class = classes.join(counted, classes.rep == counted.vec, "left").join(comp, classes.rep == comp.node, "left")
    per_class = per_class.select("lab", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    per_vector = named.select("vec_id", "lab", "h1", "h2").join(per_class, ["lab", "h1", "h2"])
    final = materialize(per_vector.groupBy("vec_id").agg(F.sum("n").cast("long").alias("n_links"), F.min("component").alias("component_id")), "pstable-final")
    discard(named, classes, keyed, shared, links, comp)
    out = v.select("vec_id").join(final, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _batch(found: list[tuple]) -> pa.RecordBatch:
    cat = lambda i: np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)])
    return pa.record_batch([pa.array(cat(0)), pa.array(cat(1)), pa.array(cat(2))], names=["vec", "links", "root"])
