"""Removal of long repeated byte strings by distributed prefix doubling: Spark sorts of rank pairs at growing offsets.

A position's rank names the ``size`` bytes that start there; equal strings have equal ranks, and ranks are in the order
of the strings. A round pairs the rank of a position with the rank ``offset`` further on in the same document, sorts the
distinct pairs of ranks, and numbers those that occur more than once; positions whose pair is unique drop out for good,
and so do positions whose partner has dropped out, since a longer string is unique if any part of it is. The offset
doubles each round; the last one is cut so that the strings are exactly ``length`` bytes long. Ranks are exact: no
fingerprints, so that no two strings are taken for one another.

The first round has a row for each byte of the corpus, some tens of bytes wide. ``suffix`` gives the same results from
sampled fingerprints for a fraction of that; this module is the plain form, for corpora where disk is no matter and as
an independent check.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import discard, materialize
from lodestar.llm.text import releasing, slices

UNIT = 8  # bytes that one long holds; the first pairs are of two longs
_STEP = 1 << 18  # positions in a batch


def _packed(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a big-endian number; signed, in the order of the bytes."""
    out = np.zeros(max(0, len(data) - UNIT + 1), np.uint64)
    for i in range(UNIT):
        out |= data[i : i + len(out)].astype(np.uint64) << np.uint64(8 * (UNIT - 1 - i))
    return (out ^ np.uint64(1 << 63)).view(np.int64)


def first_pairs(numbered: DataFrame, length: int) -> DataFrame:
    """(row, pos, r1, r2): the first and second 8 bytes from each position where ``length`` bytes may start a chain."""
    schema = pa.schema([("row", pa.int64()), ("pos", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64())])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist(), strict=True):
                    data = np.frombuffer((text or "").encode(), np.uint8)
                    if len(data) < length:
                        continue
                    for a in range(0, len(data) - 2 * UNIT + 1, _STEP):  # neighbours share the bytes at the cut
                        h = _packed(data[a : a + _STEP + 2 * UNIT - 1])
                        n = len(h) - UNIT
                        yield pa.record_batch([np.full(n, row, np.int64), np.arange(a, a + n), h[:n], h[UNIT:]], schema=schema)

    return numbered.mapInArrow(releasing(pairs), "row long, pos long, r1 long, r2 long")


def rerank(pairs: DataFrame) -> DataFrame:
    """(row, pos, rank) of positions whose pair occurs more than once; ranks follow the sorted pairs.

    Pairs are counted map-side first, so that a pair that a third of all positions have is one row a task; the join back
    is left to AQE, which splits such a pair. No row of ``pairs`` passes through a window or one task."""
    repeated = pairs.groupBy("r1", "r2").agg(F.count("*").alias("n")).filter("n > 1").select("r1", "r2")
    ranks = materialize(repeated.orderBy("r1", "r2").withColumn("rank", F.monotonically_increasing_id()), "doubling-ranks")
    state = materialize(pairs.join(ranks.hint("merge"), ["r1", "r2"]).select("row", "pos", "rank"), "doubling-state")
    discard(pairs, ranks)
    return state


def repeated_starts(numbered: DataFrame, length: int) -> DataFrame:
    """(row, pos): where a string of ``length`` bytes starts that also starts anywhere else; ``numbered``: (row, text)."""
    state = rerank(materialize(first_pairs(numbered, length), "doubling-pairs"))
    size = 2 * UNIT
    while size < length:
        offset = min(size, length - size)
        further = state.select("row", (F.col("pos") - offset).alias("pos"), F.col("rank").alias("r2"))
        pairs = state.withColumnRenamed("rank", "r1").join(further.hint("merge"), ["row", "pos"])
        pairs = materialize(pairs.select("row", "pos", "r1", "r2"), "doubling-pairs")
        discard(state)
        state = rerank(pairs)
        size += offset
    return state.select("row", "pos")


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; see ``suffix.remove_repeats``.

    Null and empty texts, and texts shorter than ``length`` bytes, have nothing to remove. Null ids and repeated rows are
    documents of their own. An empty table gives an empty table; other columns are not read."""
    if length < 2 * UNIT:
        raise ValueError(f"length must be at least {2 * UNIT}")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # written, as row numbers would change where a task is run again over other partitions
    numbered = materialize(given.withColumn("row", F.monotonically_increasing_id()), "doubling-texts")
    starts = repeated_starts(numbered.select("row", "text"), length).groupBy("row").agg(F.sort_array(F.collect_list("pos")).alias("starts"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "starts")), strict=True):
                data = np.frombuffer((text or "").encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int64)
                at = np.array(found or [], np.int64)
                edge[at] += 1
                edge[at + length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": int(gone.sum()), "n_spans": spans, "kept_sha256": hashlib.sha256(data[~gone].tobytes()).hexdigest()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    joined = numbered.join(starts.hint("merge"), "row", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(releasing(cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
