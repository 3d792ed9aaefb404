"""Hidden Markov language model, trained by Baum-Welch over all training documents.

Hidden states emit word classes (a fixed hash of the word; the end of a text is a class of its own), and a word
follows from its class by its corpus count: P(word) = P(class | state) * (c + 1) / (N_class + V_class + 1), where
one share of each class stands for its unseen words. So the states' tables have a fixed size, while counts of
words stay in the corpus-wide table that chunks query shard by shard (see ``chunks``). Every round of Baum-Welch
sums expected counts inside each partition and then over partitions; the driver gets ``states * classes`` sums
only. Training cuts texts into segments of ``segment`` words; scoring runs the scaled forward recursion over
whole texts, so that the likelihood is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm import chunks as ck
from lodestar.llm.storage import columns, materialize
from lodestar.llm.text import releasing


@dataclass
class Hmm:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # states x classes

    @property
    def classes(self) -> int:
        return self.emit.shape[1]

    @staticmethod
    def initial(states: int, classes: int, seed: int = 5) -> Hmm:
        rng = np.random.default_rng(seed)
        emit = np.exp(rng.normal(0, 1, (states, classes)))
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=1, keepdims=True))


def blocks(lengths: np.ndarray, budget: int) -> Iterator[np.ndarray]:
    """Indexes of sequences, longest first, in blocks of about ``budget`` cells (one sequence at least)."""
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = max(1, budget // int(lengths[order[at]]))
        yield order[at : at + n]
        at += n


def _columns(seqs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-major classes (longest sequences first) and the number of sequences alive at each time."""
    longest = int(lengths[0])
    grid = starts[None, :] + np.arange(longest)[:, None]
    alive = np.searchsorted(-lengths, -np.arange(1, longest + 1), side="right")
    return seqs[np.minimum(grid, len(seqs) - 1)], alive


def forward(model: Hmm, seqs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, budget: int = 1 << 19) -> np.ndarray:
    """log10 likelihood of each class sequence by the scaled forward recursion."""
    out = np.zeros(len(lengths))
    by_class = np.ascontiguousarray(model.emit.T)
    for at in blocks(lengths, budget):
        cls, alive = _columns(seqs, starts[at], lengths[at])
        total = np.zeros(len(at))
        a = model.start[None, :] * by_class[cls[0]]
        for t, n in enumerate(alive.tolist()):
            if t:
                a = (a[:n] @ model.move) * by_class[cls[t, :n]]
            c = a.sum(axis=1)
            total[:n] += np.log10(c)
            a = a / c[:, None]
        out[at] = total
    return out


def expected_counts(model: Hmm, seqs: np.ndarray, starts: np.ndarray, lengths: np.ndarray, budget: int = 1 << 17) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch sums (start, move, emit) over the sequences, and their log10 likelihood."""
    s = len(model.start)
    start, move, emit, loglik = np.zeros(s), np.zeros((s, s)), np.zeros_like(model.emit), 0.0
    by_class, a32 = np.ascontiguousarray(model.emit.T.astype(np.float32)), model.move.astype(np.float32)
    for at in blocks(lengths, budget):
        cls, alive = _columns(seqs, starts[at], lengths[at])
        t_max, d = cls.shape
        alpha, scale = np.zeros((t_max, d, s), np.float32), np.ones((t_max, d), np.float32)
        likely = by_class[cls]
        for t, n in enumerate(alive.tolist()):
            a = (alpha[t - 1, :n] @ a32 if t else model.start.astype(np.float32)[None, :]) * likely[t, :n]
            c = a.sum(axis=1)
            scale[t, :n] = c
            alpha[t, :n] = a / c[:, None]
        beta, valid = np.ones((d, s), np.float32), np.zeros((t_max, d), bool)
        for t in range(t_max - 1, -1, -1):
            n = int(alive[t])
            valid[t, :n] = True
            if t + 1 < t_max and (m := int(alive[t + 1])):
                w = likely[t + 1, :m] * beta[:m] / scale[t + 1, :m, None]
                move += alpha[t, :m].T @ w
                beta[:m] = w @ a32.T
            likely_t = alpha[t, :n] * beta[:n]  # now the posterior of each state
            alpha[t, :n] = likely_t / likely_t.sum(axis=1, keepdims=True)
        start += alpha[0].sum(axis=0)
        flat, posterior = cls[valid], alpha[valid]
        for k in range(s):
            emit[k] += np.bincount(flat, weights=posterior[:, k], minlength=emit.shape[1])
        loglik += float(np.log10(scale[valid].astype(np.float64)).sum())
    return start, move * model.move, emit, loglik


def updated(start: np.ndarray, move: np.ndarray, emit: np.ndarray, smooth: float = 1.0) -> Hmm:
    """The next model. Classes are smoothed towards their share in all states, so that none is impossible."""
    states, classes = emit.shape
    share = (emit.sum(axis=0) + 1) / (emit.sum() + classes)
    emit = emit + smooth * states * share[None, :]
    move = move + 0.1
    start = start + 0.1
    return Hmm(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))


def _sequences(chunk: ck.Chunk, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class sequences of the chunk's documents with the end class after each: (classes, starts, lengths)."""
    cls = (chunk.keys % np.uint64(classes - 1)).astype(np.int32)[chunk.codes]
    lengths = chunk.sizes + 1
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    out = np.full(int(lengths.sum()), classes - 1, np.int32)
    out[np.arange(len(cls)) + chunk.doc_of_word()] = cls
    return out, starts, lengths


def _segments(starts: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    parts = -(-lengths // size)
    nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    first = np.repeat(starts, parts) + nth * size
    return first, np.minimum(size, np.repeat(starts + lengths, parts) - first)


def baum_welch(chunked: DataFrame, states: int, classes: int, rounds: int, segment: int, seed: int = 5) -> Hmm:
    """Train on the flagged documents of a chunk table."""
    model = Hmm.initial(states, classes, seed)
    size = states + states * states + states * classes
    fan = max(1, math.isqrt(chunked.count()))
    for _ in range(rounds):
        current = model

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                for row in batch.to_pylist():
                    chunk = ck.Chunk(row)
                    seqs, starts, lengths = _sequences(chunk, classes)
                    a, b = _segments(starts[chunk.flags], lengths[chunk.flags], segment)
                    start, move, emit, _ = expected_counts(current, seqs, a, b)
                    total += np.concatenate((start, move.ravel(), emit.ravel()))
            if total.any():
                yield pa.record_batch([pa.array([TaskContext.get().partitionId() % fan]), pa.array([total.tobytes()])], names=["branch", "sums"])

        def together(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x) for x in table.column("sums").to_pylist())
            return pa.table({"at": pa.array(np.arange(size, dtype=np.int32)), "value": pa.array(total)})

        # a tree: one vector for each task, one for each of ``fan`` branches (the root of the chunks' number), then sums
        parts = chunked.mapInArrow(releasing(run), "branch long, sums binary").groupBy("branch").applyInArrow(together, "at int, value double")
        got = columns(parts.groupBy("at").agg(F.sum("value").alias("value")))  # ``size`` sums at most
        if not len(got["at"]):
            return model
        total = np.zeros(size)
        total[got["at"]] = got["value"]
        start, move, emit = np.split(total, [states, states + states * states])
        model = updated(start, move.reshape(states, states), emit.reshape(states, classes))
    return model


def score_documents(docs: DataFrame, held_out: Column, states: int = 8, classes: int = 4097, rounds: int = 5, segment: int = 512, chunk_bytes: int = 16 << 20) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents that are not held out train the model. Tokens are the words (A-Z lower-cased) and one end. A null or
    empty text is the end alone. base_score is the add-one unigram log10 probability, score the model's. Null ids
    and repeated rows are scored row by row (and counted as often as they occur). Without training documents all
    counts are 0 and the model stays as it began. An empty table gives an empty table; other columns are not read.
    """
    own = docs.select("doc_id", "text", (~F.coalesce(held_out, F.lit(False))).alias("train_row"))

    def extra(codes: np.ndarray, sizes: np.ndarray, keys: np.ndarray, flags: np.ndarray) -> dict:
        return {"counts": ck.pack(np.bincount(codes[np.repeat(flags, sizes)], minlength=len(keys)).astype(np.uint32))}

    chunked = ck.encode(own, F.col("train_row"), chunk_bytes, extra, [("counts", pa.binary())], label="hmm-chunks")
    shards = ck.shards_for(chunked)
    asked = ck.requests(chunked, shards, ["n_keys", "keys", "counts"], lambda r: (np.frombuffer(r["keys"], np.uint64), ck.unpack(r["counts"], np.uint32, r["n_keys"])))
    arrow = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("answer", pa.binary())])

    def count(table: pa.Table) -> pa.Table:
        """Answers for the chunks; under chunk -1, tokens and distinct tokens of each class."""
        distinct, total, places = ck.merge_counts(table)
        shard = table.column("shard")[0].as_py()
        rows = [{"chunk": c, "shard": shard, "n": len(p), "m": 0, "answer": ck.pack(total[p])} for c, p in zip(table.column("chunk").to_pylist(), places, strict=True)]
        known = total > 0
        cls = (distinct[known] % np.uint64(classes - 1)).astype(np.int64)
        n, v = np.bincount(cls, weights=total[known], minlength=classes - 1), np.bincount(cls, minlength=classes - 1)
        rows += [{"chunk": -1, "shard": int(k), "n": int(n[k]), "m": int(v[k]), "answer": b""} for k in np.flatnonzero(v)]
        return pa.Table.from_pylist(rows, schema=arrow)

    answers = materialize(asked.groupBy("shard").applyInArrow(count, "chunk long, shard long, n long, m long, answer binary"), "hmm-answers")
    per_class = columns(answers.filter("chunk = -1").groupBy("shard").agg(F.sum("n").alias("n"), F.sum("m").alias("v")))  # one row a class
    n_class, v_class = np.zeros(classes - 1), np.zeros(classes - 1)
    n_class[per_class["shard"]] = per_class["n"]
    v_class[per_class["shard"]] = per_class["v"]
    trained = _training_documents(chunked)
    n_all, v_all = int(n_class.sum()) + trained, int(v_class.sum()) + (trained > 0)
    model = baum_welch(chunked, states, classes, rounds, segment)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = {(r["chunk"], r["shard"]): ck.unpack(r["answer"], np.int64, r["n"]) for r in right.to_pylist()}
        for row in left.to_pylist():
            chunk = ck.Chunk(row)
            c = np.concatenate([parts[k] for k in sorted(k for k in parts if k[0] == row["chunk"])] or [np.zeros(0, np.int64)])
            cls = (chunk.keys % np.uint64(classes - 1)).astype(np.int64)
            base = np.log10((c + 1) / (n_all + v_all + 1))
            in_class = np.log10((c + 1) / (n_class[cls] + v_class[cls] + 1))
            summed = lambda per_key: _by_document(per_key[chunk.codes], chunk.offsets)  # noqa: E731, B023
            seqs, starts, lengths = _sequences(chunk, classes)
            end = np.log10((trained + 1) / (n_all + v_all + 1))
            out.append(
                pa.table(
                    [
                        pa.array(chunk.doc_ids, pa.int64()), pa.array(~chunk.flags), pa.array(lengths), pa.array(summed((c > 0).astype(np.int64)) + (trained > 0)),
                        pa.array(np.full(len(lengths), n_all)), pa.array(summed(base) + end), pa.array(forward(model, seqs, starts, lengths) + summed(in_class)),
                    ],
                    schema=schema,
                )
            )
        return pa.concat_tables(out) if out else schema.empty_table()

    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    asked_for = answers.filter("chunk >= 0").select("chunk", "shard", "n", "answer")
    return chunked.groupBy("chunk").cogroup(asked_for.groupBy("chunk")).applyInArrow(score, ddl)


def _training_documents(chunked: DataFrame) -> int:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array([int(np.frombuffer(x, bool).sum()) for x in batch.column("flags").to_pylist()], pa.int64())], names=["n"])

    return chunked.select("flags").mapInArrow(releasing(run), "n long").agg(F.sum("n")).first()[0] or 0


def _by_document(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums inside each document, each added up on its own (a difference of running totals would lose digits)."""
    out = np.zeros(len(offsets) - 1, values.dtype)
    held = np.flatnonzero(np.diff(offsets))
    if len(held):
        out[held] = np.add.reduceat(values, offsets[held])
    return out
