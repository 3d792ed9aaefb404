"""Sequence packing: first-fit decreasing over a tournament tree, in randomised groups of documents.

Documents are dealt to groups by a hash of their place in the input (not of their content or id, so that
copies spread evenly; the same place on every retry). A group holds about ``group_docs`` documents whatever
the table's size. Inside a group each document becomes full pieces of ``seq_len`` ids and one remainder; the
remainders go, longest first, to the first sequence with room, which the tree of largest free capacities finds
in logarithmic time. Sequences that stay loose give their pieces, cut where needed, to the gaps of fuller ones.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bpe
from lodestar.llm.storage import bound_batches
from lodestar.llm.text import column, release, texts_of

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


class Tournament:
    """Free capacities of bins; every inner node holds the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room and return the bin."""
        best, i = self.best, 1
        if best[1] < size:
            raise ValueError("no bin has room")
        while i < self.leaves:
            i *= 2
            if best[i] < size:
                i += 1
        best[i] -= size
        at = i
        while i > 1:
            i //= 2
            best[i] = max(best[2 * i], best[2 * i + 1])
        return at - self.leaves


def pack_lengths(lengths: list[int], seq_len: int, min_cut: int = 32) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length). Every id of every item is in exactly one piece."""
    sequences = [[(i, a, seq_len)] for i, n in enumerate(lengths) for a in range(0, n - n % seq_len, seq_len)]
    rest = sorted(((n % seq_len, i) for i, n in enumerate(lengths) if n % seq_len), key=lambda x: (-x[0], x[1]))
    tree, bins = Tournament(len(rest), seq_len), {}
    for size, i in rest:
        bins.setdefault(tree.place(size), []).append((i, lengths[i] - size, size))
    loose = [bins[b] for b in sorted(bins)]
    return sequences + _fill_gaps(loose, seq_len, min_cut)


def _fill_gaps(bins: list[list[tuple[int, int, int]]], seq_len: int, min_cut: int) -> list[list[tuple[int, int, int]]]:
    fill = lambda b: sum(p[2] for p in b)
    order = sorted(bins, key=lambda b: -fill(b))
    sizes = [fill(b) for b in order]
    i, j = 0, len(order) - 1
    while i < j:
        gap = seq_len - sizes[i]
        if gap < min_cut:
            i += 1
            continue
        item, start, n = order[j].pop()
        take = min(gap, n)
        if take < n:  # the head fills the gap, the tail stays
            order[j].append((item, start + take, n - take))
        order[i].append((item, start, take))
        sizes[i] += take
        sizes[j] -= take
        if not sizes[j]:
            j -= 1
    return [b for b in order if b]


def pack_documents(docs: DataFrame, tokenizer: str, seq_len: int = 1024, end_id: int = 0, group_docs: int = 2048, seed: int = 17, group_bytes: int = 32 << 20) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document is its byte-BPE ids and then ``end_id``; a null or empty text is ``end_id`` alone. Rows with a null
    doc_id and repeated rows are packed like any other row, each on its own. An empty table gives an empty
    table. Other columns of ``docs`` are not read. A random group has about ``group_docs`` documents, fewer where texts
    are long: about ``group_bytes`` of text at most, so that a task's memory follows neither.
    """
    bound_batches(docs.sparkSession)
    rows, size = docs.agg(F.count("*"), F.sum(F.octet_length(F.col("text").cast("string")))).first()
    groups = max(1, math.ceil(rows / group_docs), math.ceil((size or 0) / group_bytes))
    place = F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.pmod(place, F.lit(groups)).alias("grp"))

    def pack(table: pa.Table) -> pa.Table:
        tok = bpe.load(tokenizer)
        end = np.array([end_id], "<u4")
        held = [np.concatenate((tok.ids(t), end)) for t in texts_of(table).to_pylist()]
        ids = column(table, "doc_id").to_pylist()
        group = int(column(table, "grp")[0].as_py())
        out: list[list] = [[] for _ in SCHEMA]
        for s, pieces in enumerate(pack_lengths([len(h) for h in held], seq_len)):
            offset = 0
            for i, start, n in pieces:
                row = (ids[i], start, n, held[i][start : start + n].tobytes(), len(held[i]), group << 32 | s, offset)
                for target, value in zip(out, row, strict=True):
                    target.append(value)
                offset += n
        packed = pa.table([pa.array(x, f.type) for x, f in zip(out, SCHEMA, strict=True)], schema=SCHEMA)
        del out, held
        release()
        return packed

    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return source.groupBy("grp").applyInArrow(pack, schema)
