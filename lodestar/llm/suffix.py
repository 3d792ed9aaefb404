"""Removal of long repeated byte strings, by prefix doubling on sampled positions.

A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else. Ranking every suffix
would move tens of bytes for each byte of text, so ranks are names (64-bit fingerprints): the name of 2m bytes is
made from the pair of names of m bytes at a position and m further on, which needs no sort inside a chunk, and
names at growing lengths go out to be counted over the corpus only until they are unique or reach ``length``:

1. Sampling. ``p(s)`` is the place of the smallest 32-byte name in the window that begins at start s. It depends
   on the text after s alone, so equal strings have it in the same place. Starts with the same p(s) are a
   segment of at most ``window`` starts.
2. Names of half the length at each p(s), and of the full length at the last start of each segment, are sorted and
   ranked by range of names ("shards" of bounded size); a unique name has rank 0. A segment whose half name is
   unique holds no repeated start: it drops out. A segment between two repeated full names is covered by them.
3. For segments that remain, and all segments whose half name has the same rank, every start's full name is ranked.

The strings so found are exactly the repeated ones, up to collisions of 64-bit names (about n*n / 2**65).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import chunks as ck
from lodestar.llm.storage import discard, materialize
from lodestar.llm.text import MIX1, STEP, column, mix64, releasing, slices, texts_of

GRAM, WORD_GRAM = 32, 8
_BLOCK = 1 << 14  # values that stay in a core's cache while they are named
_DENSE = 16  # from one place in so many on, names are made for all places
_LONG_WORD = 64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8) + 32 * ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Names of pairs of names."""
    out = left * STEP
    out ^= out >> np.uint64(29)
    out += right
    out *= MIX1
    out ^= out >> np.uint64(32)
    return out


def doubled(h: np.ndarray, m: int) -> np.ndarray:
    """Names of 2m bytes from names of m bytes; the last m positions have none."""
    out = np.empty(len(h) - m, np.uint64)
    for a in range(0, len(out), _BLOCK):
        b = min(a + _BLOCK, len(out))
        out[a:b] = joined(h[a:b], h[a + m : b + m])
    return out


def eights(data: np.ndarray) -> np.ndarray:
    """A name for the 8 bytes at each position: different bytes, different names; the last 7 positions have none."""
    raw = np.ndarray(max(0, len(data) - 7), "<u8", np.ascontiguousarray(data), 0, (1,))
    out = np.empty(len(raw), np.uint64)
    for a in range(0, len(out), _BLOCK):
        out[a : a + _BLOCK] = mix64(raw[a : a + _BLOCK])
    return out


class Names:
    """Names of every position of an array of bytes or word hashes at ``gram`` (a power of 2, 8 bytes at least), and of
    chosen positions at any longer length: made for these positions only, or for all where they are many."""

    def __init__(self, data: np.ndarray, gram: int):
        h, m = (eights(data), 8) if data.dtype == np.uint8 else (mix64(data), 1)
        while m < gram and len(h) > m:
            h, m = doubled(h, m), 2 * m
        self.level = {m: h}

    def _named(self, positions: np.ndarray, m: int) -> np.ndarray:
        if m in self.level:
            return self.level[m][positions]
        return joined(self._named(positions, m // 2), self._named(positions + m // 2, m // 2))

    def at(self, positions: np.ndarray, length: int) -> np.ndarray:
        """The pair of names that overlap in the middle covers any length between two powers of 2."""
        m = 1 << (length.bit_length() - 1)
        if not len(positions):
            return np.zeros(0, np.uint64)
        top = max(self.level)
        while top < m and len(positions) * _DENSE > len(self.level[top]):
            self.level[2 * top] = doubled(self.level[top], top)
            top *= 2
        return mix64(self._named(positions, m) * STEP + self._named(positions + (length - m), m) + np.uint64(length))


def window_minima(h: np.ndarray, window: int) -> np.ndarray:
    """For each start the place of the smallest name in [start, start + window); the first place in a tie."""
    n = len(h)
    out = np.empty(n, np.uint32)
    for a in range(0, n, _BLOCK):
        b = min(a + _BLOCK, n)
        last = min(b + window - 1, n)
        low = np.full(b - a + window - 1, np.uint64(0xFFFFFFFFFFFFFFFF))
        low[: last - a] = (h[a:last] & np.uint64(0xFFFFFFFF00000000)) | np.arange(a, last, dtype=np.uint64)
        m = 1
        while 2 * m <= window:
            low = np.minimum(low[:-m], low[m:])
            m *= 2
        out[a:b] = np.minimum(low[: b - a], low[window - m :][: b - a]).astype(np.uint32)
    return out


def segments(data: np.ndarray, sizes: np.ndarray, length: int, window: int, gram: int) -> tuple[Names, np.ndarray, np.ndarray, np.ndarray]:
    """(names, tests, places, first): the last start of each segment (and each document's first start), with its
    p(start); ``first`` marks a document's first start. Starts are those with ``length`` units of their document left."""
    names = Names(data, gram)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    if not (sizes >= length).any():
        none = np.zeros(0, np.int64)
        return names, none, none, np.zeros(0, bool)
    p = window_minima(names.level[gram], window)
    edge = np.zeros(len(data) + 1, np.int8)
    long = sizes >= length
    edge[starts[long]] += 1
    edge[ends[long] - length + 1] -= 1
    valid = np.cumsum(edge[:-1]).astype(bool)[: len(p)]
    after = np.append(valid[1:], False)
    changes = np.append(p[1:] != p[:-1], True)
    first = np.zeros(len(p), bool)
    first[starts[long]] = True
    tests = np.flatnonzero(valid & (changes | ~after | first))
    return names, tests, p[tests].astype(np.int64), first[tests]


def regions(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(units, shift): what strings of ``length`` that start in the ranges [lo, hi] cover, put end to end, and for each
    range how far its starts move. The ranges are in order and disjoint."""
    end = hi + length
    fresh = np.append(True, lo[1:] > end[:-1])
    a, b = lo[fresh], end[np.append(fresh[1:], True)]
    shift = a - (np.cumsum(b - a) - (b - a))
    return np.concatenate([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]), shift[np.cumsum(fresh) - 1]


def by_shard(shard: np.ndarray, shards: int) -> tuple[np.ndarray, list[int]]:
    """(order, cuts): items of shard i are order[cuts[i]:cuts[i + 1]], in their own order."""
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(shards + 1)).tolist()


def once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, again, twice): which keys are the first of their kind, for the others the place of the first one, and
    for the first ones whether others follow. A chunk sends a name once, however often it holds it."""
    _, index, inverse, count = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    first = np.zeros(len(keys), bool)
    first[index] = True
    return first, index[inverse[~first]].astype(np.uint32), count[inverse[first]] > 1


def _send(table: DataFrame, column: str, shards: int) -> DataFrame:
    """Rows (chunk, shard, n, keys, twice) of each chunk's distinct keys, in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys = _u64(row[column])
                first, _, twice = once(keys)
                keys = keys[first]
                order, cuts = by_shard(shard_numbers(keys, shards), shards)
                keys, twice = keys[order], twice[order]
                out = [
                    {"chunk": row["chunk"], "shard": s, "n": b - a, "keys": keys[a:b].tobytes(), "twice": np.packbits(twice[a:b]).tobytes()}
                    for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))
                    if b > a
                ]
                yield pa.RecordBatch.from_pylist(out, schema=_REQUEST)

    return table.select("chunk", column).mapInArrow(releasing(run), _REQUEST_DDL)


def places(keys: np.ndarray, shards: int) -> dict:
    """What a chunk keeps to read its answers: each distinct key's shard, and where the others' first ones are."""
    first, again, _ = once(keys)
    return {"shard": ck.pack(shard_numbers(keys[first], shards)), "first_of": np.packbits(first).tobytes(), "again": ck.pack(again), "n_again": len(again)}


def _all_ranks(right: pa.Table, row: dict, n: int, width) -> np.ndarray:
    """The rank of each of a chunk's n keys, from ``places`` and the answers."""
    first = np.unpackbits(np.frombuffer(row["first_of"], np.uint8), count=n).astype(bool)
    out = np.zeros(n, np.uint32)
    out[first] = _answers(right, ck.unpack(row["shard"], width, n - row["n_again"]))
    out[~first] = out[ck.unpack(row["again"], np.uint32, row["n_again"])]
    return out


_REQUEST = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("twice", pa.binary())])
_REQUEST_DDL = "chunk long, shard long, n long, keys binary, twice binary"
_PLACES = [("shard", pa.binary()), ("first_of", pa.binary()), ("again", pa.binary()), ("n_again", pa.int64())]
_PLACES_DDL = "shard binary, first_of binary, again binary, n_again long"
_ANSWER = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("answer", pa.binary())])


def shard_numbers(keys: np.ndarray, shards: int) -> np.ndarray:
    return ck.shard_of(keys, shards).astype(np.uint16 if shards < 1 << 16 else np.uint32)


def _rank(asked: DataFrame, label: str) -> DataFrame:
    """For each request the rank of each key among the shard's repeated names, from 1; 0 for unique ones."""

    def rank(t: pa.Table) -> pa.Table:
        keys = np.concatenate([np.frombuffer(k, np.uint64) for k in t.column("keys").to_pylist()])
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.append(True, ordered[1:] != ordered[:-1])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(keys)))
        twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(t.column("twice").to_pylist(), t.column("n").to_pylist(), strict=True)])
        often = (size > 1) | (np.maximum.reduceat(twice[order], begin) > 0)
        repeated = np.cumsum(often) * often
        ranks = np.empty(len(keys), np.uint32)
        ranks[order] = np.repeat(repeated, size)
        ends = np.cumsum(t.column("n").to_pylist()).tolist()
        packed = [ck.pack(ranks[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return pa.table([t.column("chunk"), t.column("shard"), t.column("n"), pa.array(packed, pa.binary())], schema=_ANSWER)

    return materialize(asked.groupBy("shard").applyInArrow(rank, ck.ANSWER), label)


def _answers(right: pa.Table, shard: np.ndarray) -> np.ndarray:
    """One chunk's ranks in the order of its keys, whose shards are given."""
    out = np.zeros(len(shard), np.uint32)
    rows = sorted(zip(right.column("shard").to_pylist(), right.column("n").to_pylist(), right.column("answer").to_pylist(), strict=True))
    if rows:
        out[np.argsort(shard, kind="stable")] = np.concatenate([ck.unpack(a, np.uint32, n) for _, n, a in rows])
    return out


def _u64(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint64)


def _flags(data: bytes) -> np.ndarray:
    return np.frombuffer(data, bool)


def chunk_texts(docs: DataFrame, limit: int) -> DataFrame:
    """(chunk, n_docs, doc_ids, sizes, size, blob): whole documents as compressed UTF-8, about ``limit`` bytes."""
    fields = pa.schema([("chunk", pa.int64()), ("n_docs", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.binary()), ("size", pa.int64()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch, limit=limit):
                texts = texts_of(part)
                sizes = np.asarray(pc.binary_length(texts)).astype(np.int64)
                data = pc.binary_join(pa.array([texts.to_pylist()], pa.list_(pa.large_string())), pa.scalar("", pa.large_string()))[0].as_py().encode()
                row = {"chunk": partition << 32 | n, "n_docs": len(part), "doc_ids": column(part, "doc_id").to_pylist(), "sizes": ck.pack(sizes), "size": len(data), "blob": pa.compress(data, codec="zstd", asbytes=True)}
                n += 1
                yield pa.RecordBatch.from_pylist([row], schema=fields)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(source.mapInArrow(releasing(run), "chunk long, n_docs long, doc_ids array<long>, sizes binary, size long, blob binary"), "suffix-text")


Read = Callable[[dict], tuple[np.ndarray, np.ndarray]]


def _text(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's bytes, and how many each document has."""
    data = pa.decompress(row["blob"], decompressed_size=row["size"], codec="zstd", asbytes=True) if row["size"] else b""
    return np.frombuffer(data, np.uint8), ck.unpack(row["sizes"], np.int64, row["n_docs"])


def word_bounds(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, end) of each word in texts that begin at ``starts``; a word is a run of bytes outside ``\\x20\\x09-\\x0D``."""
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[starts] = True
    cut[-1] = True
    begin, end = cut[:-1].copy(), cut[1:].copy()
    begin[1:] |= ~inside[:-1]
    end[:-1] |= ~inside[1:]
    return np.flatnonzero(inside & begin), np.flatnonzero(inside & end) + 1


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[begin:end], by its bytes, eight at a time."""
    eight = np.ndarray(len(data) + 1, "<u8", np.append(data, np.zeros(8, np.uint8)), 0, (1,))
    size = end - begin
    out = size.astype(np.uint64)
    todo = np.flatnonzero(size <= _LONG_WORD)
    for k in range(0, _LONG_WORD, 8):
        left = size[todo] - k
        beyond = 8 * (8 - np.minimum(left, 8)).astype(np.uint64)
        out[todo] = mix64(out[todo] * STEP + (eight[begin[todo] + k] << beyond))
        todo = todo[left > 8]
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def _words(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's words (A-Z lower-cased) as hashes, and how many each document has."""
    data, sizes = _text(row)
    ends = np.cumsum(sizes)
    begin, end = word_bounds(data, ends - sizes)
    return word_hashes(_LOWER[data], begin, end), np.diff(np.searchsorted(begin, ends), prepend=0)


def _word_counts(data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    ends = np.cumsum(sizes)
    return np.diff(np.searchsorted(word_bounds(data, ends - sizes)[0], ends), prepend=0)


def covered(hits: list[dict], size: int, length: int) -> np.ndarray:
    """Which of ``size`` units some string of ``length`` units covers that starts at a place found."""
    out = np.zeros(size, bool)
    for r in hits:
        at = np.cumsum(ck.unpack(r["found"], np.int64, r["m"]))
        breaks = np.flatnonzero(at[1:] > at[:-1] + length)
        for a, b in zip(at[np.append(0, breaks + 1)].tolist(), at[np.append(breaks, len(at) - 1)].tolist(), strict=True):
            out[a : b + length] = True
    return out


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=schema)


def repeated_starts(texts: DataFrame, read: Read, length: int, half: int, gram: int) -> DataFrame:
    """(chunk, m, found): where strings of ``length`` units start, whole in one document, that start elsewhere as well.

    ``read`` gives a chunk's units (bytes or words). Names of ``half`` units are counted at the smallest name of ``gram``
    units of a window, as described above."""
    window = half - gram + 1 if half > gram else length - gram + 1  # p(s) and its half name end inside the string that begins at s
    tested = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("tests", pa.binary()), ("first", pa.binary()), ("names", pa.binary())])

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data, sizes = read(row)
                names, tests, places, first = segments(data, sizes, length, window, gram)
                both = np.concatenate((names.at(places, half), names.at(tests, length)))
                out = {"chunk": row["chunk"], "n": len(tests), "tests": ck.pack(np.diff(tests, prepend=0)), "first": np.packbits(first).tobytes(), "names": both.tobytes()}
                yield pa.RecordBatch.from_pylist([out], schema=tested)

    sampled = materialize(texts.mapInArrow(releasing(sample), "chunk long, n long, tests binary, first binary, names binary"), "suffix-tests")
    total = sampled.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-2 * total // ck.SHARD_KEYS))
    width = np.uint16 if shards < 1 << 16 else np.uint32
    ranks = _rank(_send(sampled, "names", shards), "suffix-a")
    # what meets the answers is each name's shard, not the name
    shown = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("tests", pa.binary()), ("first", pa.binary()), *_PLACES])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("chunk", "n", "tests", "first")} | places(_u64(row["names"]), shards)], schema=shown)

    judged = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("tests", pa.binary()), ("first", pa.binary()), ("m", pa.int64()), ("at", pa.binary()), ("shard", pa.binary()), ("rank", pa.binary()), ("need", pa.binary()), ("repeated", pa.binary())])

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        """Tests whose half name is repeated (``at``), its shard and rank, and which of them need their starts counted."""
        out = []
        for row in left.to_pylist():
            n = row["n"]
            rank = _all_ranks(right, row, 2 * n, width)
            own = np.unpackbits(np.frombuffer(row["first_of"], np.uint8), count=2 * n).astype(bool)
            shard = np.zeros(2 * n, width)
            shard[own] = ck.unpack(row["shard"], width, 2 * n - row["n_again"])
            shard[~own] = shard[ck.unpack(row["again"], np.uint32, row["n_again"])]
            first = np.unpackbits(np.frombuffer(row["first"], np.uint8), count=n).astype(bool)
            repeated = rank[n:] > 0
            before = np.append(False, repeated[:-1])[:n] & ~first  # a document's first start has nothing before it
            at = np.flatnonzero(rank[:n])
            out.append(
                {k: row[k] for k in ("chunk", "n", "tests", "first")}
                | {"m": len(at), "at": ck.pack(np.diff(at, prepend=0)), "shard": ck.pack(shard[at]), "rank": ck.pack(rank[at]), "need": (~(before & repeated))[at].tobytes(), "repeated": np.packbits(repeated).tobytes()}
            )
        return _rows(judged, out)

    ddl = "chunk long, n long, tests binary, first binary"
    left = sampled.mapInArrow(releasing(show), f"{ddl}, {_PLACES_DDL}")
    state = materialize(left.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(judge, f"{ddl}, m long, at binary, shard binary, rank binary, need binary, repeated binary"), "suffix-state")
    discard(sampled, ranks)

    def want(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each shard's ranks of a chunk, twice the rank plus whether a start must be counted."""
        for batch in batches:
            for row in batch.to_pylist():
                shard, rank = ck.unpack(row["shard"], width, row["m"]), ck.unpack(row["rank"], np.uint32, row["m"])
                need = _flags(row["need"])
                # a rank goes out once: with a need if any of its tests has one
                kind = shard.astype(np.uint64) << np.uint64(32) | rank
                _, place = np.unique(kind, return_inverse=True)
                any_need = np.zeros(int(place.max()) + 1 if len(place) else 0, bool)
                any_need[place[need]] = True
                first, _, _ = once(kind)
                order, cuts = by_shard(shard[first], shards)
                value = (rank.astype(np.uint64) << np.uint64(1) | any_need[place])[first][order]
                out = [{"chunk": row["chunk"], "shard": s, "n": b - a, "keys": ck.pack(value[a:b]), "twice": b""} for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]
                yield pa.RecordBatch.from_pylist(out, schema=_REQUEST)

    def mark(t: pa.Table) -> pa.Table:
        values = [ck.unpack(k, np.uint64, n) for k, n in zip(t.column("keys").to_pylist(), t.column("n").to_pylist(), strict=True)]
        needed = np.zeros(max(int(v.max() >> np.uint64(1)) for v in values) + 1, np.uint32)
        for v in values:
            needed[(v[(v & np.uint64(1)) == 1] >> np.uint64(1)).astype(np.int64)] = 1
        return pa.table([t.column("chunk"), t.column("shard"), t.column("n"), pa.array([ck.pack(needed[(v >> np.uint64(1)).astype(np.int64)]) for v in values], pa.binary())], schema=_ANSWER)

    asked = state.select("chunk", "m", "shard", "rank", "need").mapInArrow(releasing(want), _REQUEST_DDL)
    marks = materialize(asked.groupBy("shard").applyInArrow(mark, ck.ANSWER), "suffix-b")
    planned = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("lo", pa.binary()), ("hi", pa.binary()), ("m", pa.int64()), ("found", pa.binary())])

    def plan(left: pa.Table, right: pa.Table) -> pa.Table:
        """Start ranges [lo, hi] to count, and tests already known to repeat."""
        out = []
        for row in left.to_pylist():
            n = row["n"]
            tests = np.cumsum(ck.unpack(row["tests"], np.int64, n))
            first, repeated = (np.unpackbits(np.frombuffer(row[k], np.uint8), count=n).astype(bool) for k in ("first", "repeated"))
            at = np.cumsum(ck.unpack(row["at"], np.int64, row["m"]))
            shard, rank = ck.unpack(row["shard"], width, row["m"]), ck.unpack(row["rank"], np.uint32, row["m"])
            first_of, again, _ = once(shard.astype(np.uint64) << np.uint64(32) | rank)
            needed = np.zeros(row["m"], np.uint32)
            needed[first_of] = _answers(right, shard[first_of])
            needed[~first_of] = needed[again]
            marked = at[needed > 0]
            lo = np.where(first, tests, np.append(0, tests[:-1])[:n] + 1)[marked]
            hi, found = tests[marked], tests[repeated]
            out.append({"chunk": row["chunk"], "n": len(lo), "lo": ck.pack(np.diff(lo, prepend=0)), "hi": ck.pack(hi - lo), "m": len(found), "found": ck.pack(np.diff(found, prepend=0))})
        return _rows(planned, out)

    plans = materialize(state.groupBy("chunk").cogroup(marks.groupBy("chunk")).applyInArrow(plan, "chunk long, n long, lo binary, hi binary, m long, found binary"), "suffix-plan")
    discard(state, marks)
    counted = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("starts", pa.binary()), ("keys", pa.binary())])

    def expand(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        todo = {r["chunk"]: r for r in right.to_pylist()}
        for row in left.to_pylist():
            r = todo.get(row["chunk"])
            if r is None:
                continue
            lo = np.cumsum(ck.unpack(r["lo"], np.int64, r["n"]))
            size = ck.unpack(r["hi"], np.int64, r["n"]) + 1
            starts = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            units, shift = regions(read(row)[0], lo, lo + size - 1, length)
            keys = Names(units, gram).at(starts - np.repeat(shift, size), length)
            out.append({"chunk": row["chunk"], "n": len(starts), "starts": ck.pack(np.diff(starts, prepend=0)), "keys": keys.tobytes()})
        return _rows(counted, out)

    expanded = materialize(texts.groupBy("chunk").cogroup(plans.filter("n > 0").groupBy("chunk")).applyInArrow(expand, "chunk long, n long, starts binary, keys binary"), "suffix-starts")
    total = expanded.agg(F.sum("n")).first()[0] or 0
    last = max(1, -(-total // ck.SHARD_KEYS))
    last_width = np.uint16 if last < 1 << 16 else np.uint32
    ranks = _rank(_send(expanded, "keys", last), "suffix-c")
    placed = pa.schema([("chunk", pa.int64()), ("n", pa.int64()), ("starts", pa.binary()), *_PLACES])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{k: row[k] for k in ("chunk", "n", "starts")} | places(_u64(row["keys"]), last)], schema=placed)

    hits = pa.schema([("chunk", pa.int64()), ("m", pa.int64()), ("found", pa.binary())])

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            starts = np.cumsum(ck.unpack(row["starts"], np.int64, row["n"]))
            found = starts[_all_ranks(right, row, row["n"], last_width) > 0]
            out.append({"chunk": row["chunk"], "m": len(found), "found": ck.pack(np.diff(found, prepend=0))})
        return _rows(hits, out)

    left = expanded.mapInArrow(releasing(place), f"chunk long, n long, starts binary, {_PLACES_DDL}")
    settled = left.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(settle, "chunk long, m long, found binary")
    found = materialize(settled.unionByName(plans.select("chunk", "m", "found")).filter("m > 0"), "suffix-found")
    discard(expanded, ranks, plans)
    return found


def remove_repeats(docs: DataFrame, length: int = 400, passage: int = 0, chunk_bytes: int = 2 << 20, with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (and kept, the remaining bytes).

    Every whole text counts as UTF-8 bytes; strings never cross documents and overlapping occurrences count. Null
    and empty texts have nothing to remove. Null ids and repeated rows are documents of their own (so repeated rows
    of ``length`` bytes remove each other whole). An empty table gives an empty table; other columns are not read.
    With ``passage``, the column n_passage_words tells how many words lie in runs of that many words that also start
    elsewhere, however few bytes they have; nothing is removed for it.
    """
    if length < 4 * GRAM:
        raise ValueError(f"length must be at least {4 * GRAM}")
    if passage and passage < 2 * WORD_GRAM:
        raise ValueError(f"passage must be at least {2 * WORD_GRAM}")
    texts = chunk_texts(docs, chunk_bytes)
    found = repeated_starts(texts, _text, length, length // 2, GRAM).withColumn("unit", F.lit("byte"))
    if passage:
        found = found.unionByName(repeated_starts(texts, _words, passage, WORD_GRAM, WORD_GRAM).withColumn("unit", F.lit("word")))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    final = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", span)]
    final += [("n_passage_words", pa.int64())] * (passage > 0) + [("kept", pa.binary())] * with_text

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[dict] = []
        for row in left.to_pylist():
            data, sizes = _text(row)
            hits = right.to_pylist()
            gone = covered([r for r in hits if r["unit"] == "byte"], len(data), length)
            ends = np.cumsum(sizes)
            extra: list[dict] = [{}] * len(sizes)
            if passage:
                words = _word_counts(data, sizes) if any(r["unit"] == "word" for r in hits) else np.zeros(len(sizes), np.int64)
                inside = np.append(0, np.cumsum(covered([r for r in hits if r["unit"] == "word"], int(words.sum()), passage)))
                last = np.cumsum(words)
                extra = [{"n_passage_words": n} for n in (inside[last] - inside[last - words]).tolist()]
            for doc_id, a, b, more in zip(row["doc_ids"], (ends - sizes).tolist(), ends.tolist(), extra, strict=True):
                g = gone[a:b]
                turns = np.flatnonzero(np.diff(np.concatenate(([False], g, [False])).astype(np.int8))).tolist()
                kept = data[a:b][~g].tobytes()
                record = {"doc_id": doc_id, "n_bytes": b - a, "n_removed": int(g.sum()), "n_spans": len(turns) // 2, "kept_sha256": hashlib.sha256(kept).hexdigest(), "spans": [{"start": x, "end": y} for x, y in zip(turns[::2], turns[1::2], strict=True)]}
                out.append(record | more | ({"kept": kept} if with_text else {}))
        return _rows(pa.schema(final), out)

    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>" + ", n_passage_words long" * (passage > 0) + ", kept binary" * with_text
    return texts.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, ddl)
