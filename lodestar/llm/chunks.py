"""Documents in chunks, and values of a corpus-wide table joined to the chunks that need them.

A chunk holds whole documents of about ``limit`` bytes. It keeps its words as codes into its own list of
distinct keys (64-bit hashes), so that a join over the corpus moves a key once for each chunk, not once for each
word: frequent words make no hot key. Keys travel in blobs, one for each chunk and key range ("shard"); a shard
answers with a blob of values, and the chunk meets its answers in a cogroup. Sizes: a shard holds about
``SHARD_KEYS`` keys, a chunk its own documents; both stay as they are when the corpus grows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import materialize
from lodestar.llm.text import releasing, slices, texts_of, words_of

SHARD_KEYS = 2_000_000


def pack(a: np.ndarray) -> bytes:
    """An integer array, compressed by byte planes (small numbers leave the high planes empty)."""
    a = np.ascontiguousarray(a)
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b""
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def unpack(data: bytes, dtype, n: int) -> np.ndarray:
    dtype = np.dtype(dtype)
    if not n:
        return np.zeros(0, dtype)
    planes = pa.decompress(data, decompressed_size=n * dtype.itemsize, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).ravel()


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key, by its value: sorted keys have sorted shards."""
    return ((keys >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def runs(ordered: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, begin, end) of each run of equal values."""
    begin = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    return list(zip(ordered[begin].tolist(), begin.tolist(), np.append(begin[1:], len(ordered)).tolist() if len(begin) else [], strict=True))


COLUMNS = [("chunk", pa.int64()), ("n_docs", pa.int64()), ("n_words", pa.int64()), ("n_keys", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("flags", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary()), ("keys", pa.binary())]
_DDL = "chunk long, n_docs long, n_words long, n_keys long, doc_ids array<long>, lang array<string>, flags binary, sizes binary, codes binary, keys binary"


def encode(docs: DataFrame, flag, limit: int = 16 << 20, extra: Callable | None = None, extra_fields: list | None = None, label: str = "chunks") -> DataFrame:
    """A written table with a row for each chunk. ``flag``: a boolean Column kept for each document.

    Keys are the sorted distinct word hashes; codes are places in them. ``extra(words, hashes, flags)`` may add
    values for ``extra_fields``.
    """
    fields = [*COLUMNS, *(extra_fields or [])]
    arrow = pa.schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, limit=limit):
                w = words_of(texts_of(part))
                hashed = w.hashes()
                keys, place = np.unique(hashed, return_inverse=True)
                codes = place[w.codes].astype(np.uint32)
                flags = np.asarray(part.column("flag").to_numpy(zero_copy_only=False)).astype(bool)
                row = {
                    "chunk": partition << 32 | n, "n_docs": len(part), "n_words": len(codes), "n_keys": len(keys), "doc_ids": part.column("doc_id").to_pylist(), "lang": part.column("lang").to_pylist(),
                    "flags": flags.tobytes(), "sizes": pack(np.diff(w.offsets)), "codes": pack(codes), "keys": keys.tobytes(),
                }
                if extra is not None:
                    row |= extra(codes, np.diff(w.offsets), keys, flags)
                n += 1
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"), flag.alias("flag"))
    ddl = _DDL + "".join(f", {name} binary" for name, _ in (extra_fields or []))
    return materialize(source.mapInArrow(releasing(run), ddl), label)


class Chunk:
    """One row of ``encode`` as arrays."""

    def __init__(self, row: dict):
        self.doc_ids, self.lang, self.n_words = row["doc_ids"], row["lang"], row["n_words"]
        self.flags = np.frombuffer(row["flags"], bool)
        self.sizes = unpack(row["sizes"], np.int64, row["n_docs"])
        self.codes = unpack(row["codes"], np.uint32, row["n_words"])
        self.keys = np.frombuffer(row["keys"], np.uint64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def shards_for(chunks: DataFrame, column: str = "n_keys") -> int:
    total = chunks.agg(F.sum(column)).first()[0] or 0
    return max(1, math.ceil(total / SHARD_KEYS))


REQUEST = "chunk long, shard long, n long, keys binary, counts binary"
ANSWER = "chunk long, shard long, n long, answer binary"


def requests(chunks: DataFrame, shards: int, columns: list[str], make: Callable[[dict], tuple[np.ndarray, np.ndarray | None]]) -> DataFrame:
    """For each chunk and shard the chunk's sorted keys there (and a count for each): ``make(row)`` gives both.

    A shard where a chunk has no key gets no row: there are at most as many rows as keys, however many shards."""
    arrow = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = make(row)
                out = [
                    {"chunk": row["chunk"], "shard": s, "n": b - a, "keys": keys[a:b].tobytes(), "counts": pack(counts[a:b]) if counts is not None else b""}
                    for s, a, b in runs(shard_of(keys, shards).astype(np.int64))
                ]
                yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return chunks.select("chunk", *columns).mapInArrow(releasing(run), REQUEST)


def merge_counts(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(distinct keys, summed counts, each request's places) of one shard's requests."""
    keys = [np.frombuffer(k, np.uint64) for k in table.column("keys").to_pylist()]
    counts = [unpack(c, np.uint32, n) if c else np.zeros(n, np.uint32) for c, n in zip(table.column("counts").to_pylist(), table.column("n").to_pylist(), strict=True)]
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    all_keys = np.concatenate(keys)
    distinct = pd.unique(all_keys)
    distinct.sort()
    places = [np.searchsorted(distinct, k) for k in keys]
    total = np.zeros(len(distinct), np.int64)
    for p, c in zip(places, counts, strict=True):
        total[p] += c  # keys of one request are distinct
    return distinct, total, places
