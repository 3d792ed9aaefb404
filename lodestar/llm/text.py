"""Vectorised text helpers used inside Arrow-batched functions.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; only A-Z is lower-cased. A null text is the
empty text. Everything works on whole texts; batches are cut between documents, never inside one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

MIX1, MIX2, STEP = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


Batches = Iterator[pa.RecordBatch]


def releasing(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """Give a task's memory back when it ends: Python workers are reused, and idle ones would keep it."""

    @wraps(run)
    def wrapped(batches: Batches) -> Batches:
        yield from run(batches)
        release()

    return wrapped


def release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (multiply and shift)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX1
    x ^= x >> np.uint64(27)
    x *= MIX2
    x ^= x >> np.uint64(31)
    return x


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    col = batch.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> pa.Array:
    col = column(batch, name)
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    if col.offset:  # string kernels misread sliced arrays: copy what the slice shows
        col = col.take(pa.array(np.arange(len(col))))
    return col.cast(pa.large_string()).fill_null("")


def slices(batch: pa.RecordBatch, name: str = "text", limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch between rows so that each piece has about ``limit`` bytes of text (one row at least)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0)).astype(np.int64)
    if len(sizes) == 0:
        return
    part = (np.cumsum(sizes) - sizes) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(a, b - a)


@dataclass
class Words:
    """codes: index into ``dictionary`` for each word; the words of document i are offsets[i]:offsets[i+1]."""

    codes: np.ndarray
    offsets: np.ndarray
    dictionary: pa.Array

    def hashes(self) -> np.ndarray:
        """A 64-bit hash for each dictionary entry."""
        values = np.array(self.dictionary.to_pylist(), dtype=object)
        return pd.util.hash_array(values, categorize=False) if len(values) else np.zeros(0, np.uint64)


def words_of(text: pa.Array, lower: bool = True) -> Words:
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text)
    offsets = np.asarray(lists.offsets).astype(np.int64)
    encoded = lists.flatten().dictionary_encode()
    codes, offsets = np.asarray(encoded.indices), offsets - offsets[0]
    empty = pc.index(encoded.dictionary, pa.scalar("", encoded.dictionary.type)).as_py()
    if empty >= 0:
        keep = codes != empty
        offsets = np.concatenate(([0], np.cumsum(keep)))[offsets]
        codes = codes[keep]
    return Words(codes, offsets, encoded.dictionary)


def shingles_of(words: Words, size: int) -> list[np.ndarray]:
    """For each document the sorted distinct 64-bit hashes of its word shingles.

    A document with fewer words than ``size`` has its whole sequence as its one shingle; without words, none.
    """
    h, off = words.hashes()[words.codes], words.offsets
    n = len(h)
    rolled = np.zeros(n, np.uint64)
    if n >= size:
        m = n - size + 1
        acc = np.full(m, np.uint64(size), np.uint64)
        for j in range(size):
            acc *= STEP
            acc += h[j : j + m]
        rolled[:m] = mix64(acc)
    out = []
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            acc = np.full(1, np.uint64(b - a), np.uint64)
            for x in h[a:b]:
                acc *= STEP
                acc += x
            out.append(mix64(acc))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
