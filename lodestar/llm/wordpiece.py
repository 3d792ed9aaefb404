"""Greedy longest-match piece counts in linear time, without building pieces.

The vocabulary is a trie over bytes. Each node has a failure link and the number of pieces popped on taking it:
reading a byte that no child matches pops the longest pieces of what has been read and goes on from the rest,
so that no byte is read twice. Each word is counted once for each block of text and then summed by document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm import bpe
from lodestar.llm.storage import bound_batches
from lodestar.llm.text import column, releasing, slices, texts_of, words_of


class Automaton:
    """``lead`` is put before each word. Every single byte must be a piece, so that matching never gets stuck."""

    def __init__(self, pieces: Iterable[bytes], lead: bytes = b" "):
        child: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in pieces:
            at = 0
            for byte in piece:
                nxt = child[at].get(byte)
                if nxt is None:
                    nxt = child[at][byte] = len(child)
                    child.append({})
                    whole.append(False)
                at = nxt
            whole[at] = at != 0
        if len(child[0]) < 256 or not all(whole[n] for n in child[0].values()):
            raise ValueError("every single byte must be in the vocabulary")
        fail, pops = [0] * len(child), [0] * len(child)
        level = [0]
        while level:  # by depth: links of shorter strings come first
            nxt_level = []
            for u in level:
                for byte, v in child[u].items():
                    nxt_level.append(v)
                    if whole[v]:
                        fail[v], pops[v] = 0, 1
                        continue
                    z, n = fail[u], pops[u]
                    while byte not in child[z]:
                        n += pops[z]
                        z = fail[z]
                    fail[v], pops[v] = child[z][byte], n
            level = nxt_level
        closing = [0] * len(child)  # pieces popped when the word ends here
        for u in range(len(child)):
            z, n = u, 0
            while z:
                n += pops[z]
                z = fail[z]
            closing[u] = n
        keys = np.array([(u << 8) | b for u, c in enumerate(child) for b in c], np.int64)
        to = np.array([v for c in child for v in c.values()], np.int64)
        order = np.argsort(keys)
        self.keys, self.to, self.lead = keys[order], to[order], lead
        self.fail, self.pops, self.closing = (np.array(x, np.int64) for x in (fail, pops, closing))

    def _step(self, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
        at, out = np.arange(len(state)), np.empty_like(state)
        while len(at):
            key = (state << 8) | byte
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[i] == key
            out[at[hit]] = self.to[i[hit]]
            at, state, byte = at[~hit], state[~hit], byte[~hit]
            np.add.at(count, at, self.pops[state])
            state = self.fail[state]
        return out

    def counts(self, words: pa.Array) -> np.ndarray:
        """The number of greedy pieces of each word."""
        words = words.cast(pa.large_binary())
        buffers = words.buffers()
        offsets = np.frombuffer(buffers[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if len(words) and buffers[2] is not None else np.zeros(0, np.uint8)
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        start, size = offsets[:-1][order], size[order]
        state, count = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        for byte in self.lead:
            state = self._step(state, np.full(len(state), byte, np.int64), count)
        longest = int(size[0]) if len(size) else 0
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")
        for t, n in enumerate(active.tolist()):
            state[:n] = self._step(state[:n], data[start[:n] + t].astype(np.int64), count[:n])
        out = np.empty(len(order), np.int64)
        out[order] = count + self.closing[state]
        return out


@lru_cache(maxsize=4)
def load(path: str) -> Automaton:
    """One automaton for each worker process and vocabulary file."""
    return Automaton(bpe.vocabulary(path)[0])


def token_counts(docs: DataFrame, vocabulary: str, lower: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_tokens (greedy pieces of all words, each with a leading space).

    Words are split at ASCII white space. Null and empty texts have 0 of both; null ids and repeated rows are
    counted like any other row; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(vocabulary)
        for batch in batches:
            for part in slices(batch, limit=16 << 20):
                words = words_of(texts_of(part), lower)
                per_word = automaton.counts(words.dictionary)[words.codes]
                total = np.concatenate(([0], np.cumsum(per_word)))
                yield pa.record_batch([column(part, "doc_id"), pa.array(np.diff(words.offsets)), pa.array(np.diff(total[words.offsets]))], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(releasing(run), "doc_id long, n_words long, n_tokens long")
