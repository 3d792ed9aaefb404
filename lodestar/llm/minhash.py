"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star edges.

1. Each text becomes its set of word shingles. Texts with the same set (a 128-bit sum over the set) form a
   class; only the smallest id of a class goes on, so any number of exact copies costs one row.
2. One hash pass fills ``BINS`` bins with the smallest shingle hash of each; an empty bin copies the first
   non-empty bin of its own fixed random sequence. ``bands`` keys of ``rows`` bins each follow.
3. A bucket (documents sharing a band key) gives star edges from one centre to the others: linear in its size.
   The same centre order holds in all bands, so that the stars of similar buckets coincide.
4. Each star edge is confirmed on the full shingle sets; hot centres are salted into bounded groups.
5. Buckets whose other members still lie in several components hold pairs that no star has compared. They are
   compared exactly, in blocks of bounded size (matrix products of incidence rows), emitting spanning edges.

At similarity 0.8 a pair shares no band with probability below 1e-5 (42 bands of 6 rows).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.components import connected_components
from lodestar.llm.storage import discard, is_empty, materialize
from lodestar.llm.text import STEP, column, mix64, releasing, shingles_of, slices, texts_of, words_of

BINS = 256
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def one_permutation(sets: list[np.ndarray]) -> np.ndarray:
    """A (documents x BINS) signature; rows of empty sets stay empty."""
    edges = (np.arange(BINS, dtype=np.uint64)) << np.uint64(56)
    sig = np.full((len(sets), BINS), _EMPTY)
    for i, s in enumerate(sets):
        if len(s):
            at = np.searchsorted(s, edges)
            top = np.minimum(at, len(s) - 1)
            held = (s[top] >> np.uint64(56)) == np.arange(BINS, dtype=np.uint64)
            held &= at < len(s)
            sig[i, held] = s[top[held]]
    return densify(sig)


def densify(sig: np.ndarray) -> np.ndarray:
    """Optimal densification: each empty bin draws bins of its own random sequence until one is filled."""
    filled = sig != _EMPTY
    rows, bins = np.nonzero(~filled & filled.any(axis=1)[:, None])
    out, attempt = sig.copy(), 0
    while len(rows):
        attempt += 1
        if attempt <= 16 * BINS:
            draw = mix64(bins.astype(np.uint64) * STEP + np.uint64(attempt))
            target = (draw >> np.uint64(40)).astype(np.int64) % BINS
        else:  # a sequence that has missed this often ends with the next bins in order
            target = (bins + attempt) % BINS
        ok = filled[rows, target]
        out[rows[ok], bins[ok]] = sig[rows[ok], target[ok]]
        rows, bins = rows[~ok], bins[~ok]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    acc = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(sig), bands)).copy()
    for r in range(rows):
        acc *= STEP
        acc += sig[:, r : bands * rows : rows]
    return mix64(acc.ravel()).reshape(acc.shape).view(np.int64)


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, keys): set_* name the shingle set, keys are empty for empty sets."""
    if bands * rows > BINS:
        raise ValueError(f"bands * rows must be at most {BINS}")
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets = shingles_of(words_of(texts_of(part)), shingle)
                n = np.array([len(s) for s in sets], np.int64)
                a = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                b = np.array([mix64(s ^ STEP).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                keys = band_keys(one_permutation(sets), bands, rows)
                lists = [k if m else k[:0] for k, m in zip(keys, n, strict=True)]
                yield pa.record_batch([column(part, "doc_id"), pa.array(n), pa.array(a), pa.array(b), pa.array(lists, pa.list_(pa.int64()))], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(releasing(run), "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>")


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 42, rows: int = 6, star_group: int = 256, block: int = 1024) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Two documents are linked when ``100 * |intersection| >= percent * |union|`` of their shingle sets.
    component_id is the smallest doc_id reachable; kept says that it is the row's own. Null or empty texts have
    no shingles and stand alone. A row with a null doc_id links with nothing: component_id null, kept true.
    Repeated ids are one document and give equal rows. An empty table gives an empty table; other columns of
    ``docs`` are not read, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sig = materialize(signatures(docs, shingle, bands, rows), "minhash-sig")
    known = sig.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    # aggregates are written before they are joined, so that AQE can split a hot set, bucket or centre
    reps = materialize(known.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rep")), "minhash-reps")
    member = materialize(
        known.select("doc_id", "set_a", "set_b", "n_shingles").join(reps, ["set_a", "set_b", "n_shingles"]).select("doc_id", "rep").distinct(), "minhash-member"
    )
    lone = member.filter("doc_id = rep").select("doc_id")
    buckets = known.join(lone, "doc_id", "left_semi").select("doc_id", F.explode("keys").alias("key")).distinct()
    order = F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").alias("c"))
    centres = buckets.groupBy("key").agg(F.min(order).alias("m"), F.count("*").alias("n")).filter("n > 1")
    centres = materialize(centres.select("key", F.col("m.c").alias("centre")), "minhash-centres")
    cand = materialize(buckets.join(centres, "key").select("key", "doc_id", "centre"), "minhash-cand")
    pairs = cand.filter("doc_id <> centre").select("centre", "doc_id").distinct()
    # texts of candidates only are read again; one plan at every size, as a broadcast of ids would not scale
    wanted = cand.select("doc_id").distinct()
    texts = materialize(docs.join(wanted.hint("merge"), "doc_id"), "minhash-texts")
    edges = materialize(_confirm_stars(texts, pairs, shingle, percent, star_group), "minhash-edges")
    comp = materialize(connected_components(edges), "minhash-comp")
    rest = _unresolved(cand, comp)
    rest = materialize(rest, "minhash-rest")
    if not is_empty(rest):
        more = materialize(_confirm_blocks(texts, rest, shingle, percent, block), "minhash-more")
        both = edges.unionByName(more)
        again = materialize(connected_components(both), "minhash-comp")
        discard(comp, more)
        comp = again
    discard(reps, centres, cand, edges, rest, texts)
    joined = member.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    final = materialize(joined.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component_id")), "minhash-final")
    discard(comp)
    out = sig.select("doc_id", "n_shingles").join(final, "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _confirm_stars(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int, group: int) -> DataFrame:
    """Confirmed (src, dst) of the pairs (centre, doc_id). A centre's members are dealt to salted groups of
    about ``group``; the centre's text goes to each of them."""
    pairs = materialize(pairs, "minhash-pairs")
    salts = materialize(pairs.groupBy("centre").agg(F.ceil(F.count("*") / group).cast("int").alias("salts")), "minhash-salts")
    salted = pairs.join(salts, "centre").select("doc_id", "centre", F.pmod(F.xxhash64("doc_id", F.lit(7)), "salts").cast("int").alias("salt"), F.lit(False).alias("hub"))
    hubs = salted.select(F.col("centre").alias("doc_id"), "centre", "salt", F.lit(True).alias("hub")).distinct()
    held = docs.join(salted.unionByName(hubs), "doc_id")

    def check(table: pa.Table) -> pa.Table:
        sets = shingles_of(words_of(texts_of(table)), shingle)
        hub = np.asarray(column(table, "hub"))
        ids = np.asarray(column(table, "doc_id"))
        if not hub.any():
            return pa.table({"src": pa.array([], pa.int64()), "dst": pa.array([], pa.int64())})
        base = sets[int(np.flatnonzero(hub)[0])]
        src, dst = [], []
        for i in np.flatnonzero(~hub):
            shared = int(np.isin(sets[i], base, assume_unique=True).sum())
            if 100 * shared >= percent * (len(sets[i]) + len(base) - shared):
                src.append(int(ids[hub][0]))
                dst.append(int(ids[i]))
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return held.select("doc_id", "text", "centre", "salt", "hub").groupBy("centre", "salt").applyInArrow(check, "src long, dst long")


def _unresolved(cand: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, doc_id, component, n) of buckets whose members besides the centre lie in several components, one
    bucket of each set of members."""
    at = cand.filter("doc_id <> centre").join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    mixed = at.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("s")
    ).filter("a < b")
    one = mixed.groupBy("n", "s").agg(F.min("key").alias("key")).select("key", "n")
    return at.join(one, "key")


def _confirm_blocks(docs: DataFrame, rest: DataFrame, shingle: int, percent: int, block: int) -> DataFrame:
    """Edges for all links between different components inside each bucket: blocks of about ``block`` members are
    compared pairwise, and each finds a spanning set of its links."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / block)).cast("int")
    mine = rest.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(11)), "blocks").cast("int"))
    dealt = mine.select("key", "doc_id", "component", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("key", "doc_id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    held = docs.join(dealt, "doc_id")

    def check(table: pa.Table) -> pa.Table:
        ids, first = np.unique(np.asarray(column(table, "doc_id")), return_index=True)
        comp, group, size = np.unique(np.asarray(column(table, "component"))[first], return_inverse=True, return_counts=True)
        sets = shingles_of(words_of(texts_of(table.take(pa.array(first)))), shingle)
        n = np.array([len(s) for s in sets], np.int64)
        # pairs inside a component are joined already: members of the largest need no comparison of their own
        few = np.flatnonzero(group != size.argmax())
        shared = intersections(sets, few)
        linked = (100 * shared >= percent * (n[few, None] + n[None, :] - shared)) & (group[few, None] != group[None, :])
        src, dst = spanning_edges(few, *np.nonzero(linked), group)
        return pa.table({"src": pa.array(ids[src], pa.int64()), "dst": pa.array(ids[dst], pa.int64())})

    return held.select("doc_id", "text", "component", "key", "i", "j").groupBy("key", "i", "j").applyInArrow(check, "src long, dst long")


def intersections(sets: list[np.ndarray], rows: np.ndarray, width: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the sets at ``rows`` with all sets, by products of incidence columns
    ``width`` at a time."""
    out = np.zeros((len(rows), len(sets)), np.float64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    wanted = np.zeros(int(code.max()) + 1 if len(code) else 1, bool)
    wanted[code[np.isin(owner, rows)]] = True
    wide = wanted[code]
    owner, code = owner[wide], (np.cumsum(wanted) - 1)[code[wide]]
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    for a in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        lo, hi = np.searchsorted(code, (a, a + width))
        x = np.zeros((len(sets), width), np.float32)
        x[owner[lo:hi], code[lo:hi] - a] = 1
        out += x[rows] @ x.T
    return np.rint(out).astype(np.int64)


def spanning_edges(rows: np.ndarray, at: np.ndarray, other: np.ndarray, group: np.ndarray) -> tuple[list[int], list[int]]:
    """Of the links (rows[at], other), as many as join groups that are not joined yet."""
    root = list(range(int(group.max()) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    src, dst = [], []
    for a, b in zip(rows[at].tolist(), other.tolist(), strict=True):
        x, y = find(int(group[a])), find(int(group[b]))
        if x != y:
            root[x] = y
            src.append(a)
            dst.append(b)
    return src, dst


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose document is not the smallest id of its component; all columns stay.

    Only the ids that go are joined, so that rows with a null doc_id stay. Of rows that repeat one doc_id, one row
    of each text stays.
    """
    found = near_duplicates(docs, **options)
    counts = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.col("kept")).alias("kept"))
    gone = materialize(counts.filter("NOT kept").select(F.col("doc_id").alias("gone_id")), "minhash-gone")
    out = docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
    if is_empty(counts.filter("rows > 1")):
        return out
    once = out.filter("doc_id IS NOT NULL").withColumn("_text_hash", F.xxhash64(F.col("text").cast("string"))).dropDuplicates(["doc_id", "_text_hash"]).drop("_text_hash")
    return once.unionByName(out.filter("doc_id IS NULL"))
