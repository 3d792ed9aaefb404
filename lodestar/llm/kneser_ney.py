"""Quality classification by the perplexity of an interpolated modified Kneser-Ney bigram model.

Training: one half of the trusted documents (labelled good and not toxic; by a hash of the id), all of them; the other
half sets the threshold, on texts that the model has not seen. Words that occur twice or more get numbers; other words
are one unknown word, whose probability is shared by as many types as training saw. The tables of the ``vocabulary`` most
frequent words are held in memory; those of the rest are a written table, joined to the bigrams that may hold such a
word ("open" ones; a bit array of fixed size tells), so that results do not depend on ``vocabulary``.
Counts of counts give the discounts D1, D2 and D3+; lower orders use continuation counts. ``min_count`` 1 keeps every
bigram of training; with 2, the default of the functions here, bigrams that occur once only feed the discounts and their
mass stays with the lower order (a pruned model). All probabilities sum to one either way. The registered query and the
pipeline keep every bigram.

Scoring, over all documents and whole texts: with q = (c - D) / c(h), a word costs
log(gamma(h) P(w)) + log(1 + q / (gamma(h) P(w))). The first part needs the tables of words only. The second is zero unless the bigram is in the model: those are joined to the sharded bigram table, once for each chunk
and bigram (see ``chunks``); a bit array of fixed size keeps most other bigrams out of the join (it lets some through,
never holds one back). Chunks are written once and meet the bigram table in ``ROUNDS`` rounds, each with its share of
them: of what is shuffled, only one round's share is on disk at a time.

Threshold: the exact ``quantile`` (the value of rank ceil(quantile * n)) of the cost per word of the other half of the trusted documents, for each language and
length band (documents of 1-7, 8-15, 16-31 ... words), raised by ``margin``. Bands and languages with fewer than
``least`` trusted documents fall back to the language, then to all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm import chunks as ck
from lodestar.llm.storage import columns, discard, drop_shuffles, materialize
from lodestar.llm.text import STEP, column, mix64, releasing, slices, texts_of, words_of

UNKNOWN, EDGE = 0, 1  # numbers of the unknown word and of both ends of a text
BLOOM_LOG = 26
BLOOM_BITS = 1 << BLOOM_LOG  # sized for bigrams that occur once as well; results do not depend on it
ROUNDS = 4  # of scoring; results do not depend on it


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many items occur 1, 2, 3 and 4 times (modified Kneser-Ney)."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    clip = lambda d, top: float(min(max(d, 0.1), top))
    return clip(1 - 2 * y * n2 / n1, 0.95), clip(2 - 3 * y * n3 / n2, 1.95), clip(3 - 4 * y * n4 / n3, 2.95)


def discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], d[0])) * (c > 0)


class Bits:
    """A bit array of fixed size over 64-bit keys; compressed on its way to tasks."""

    def __init__(self, words: np.ndarray):
        self.bytes = words.view(np.uint8)

    def __getstate__(self) -> bytes:
        return ck.pack(self.bytes)

    def __setstate__(self, state: bytes) -> None:
        self.bytes = ck.unpack(state, np.uint8, BLOOM_BITS // 8)

    def candidates(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that may be among its own; none that is among them is left out."""
        at = np.arange(len(keys))
        for shift in BLOOM_SHIFTS:
            p = bloom_places(keys[at], shift)
            at = at[((self.bytes[p >> 3] >> (p & 7).astype(np.uint8)) & 1).astype(bool)]
        return at


class Lexicon:
    """Places of words by their hash: the n-th of ``hashes`` has place n + 2 (frequent words first: that leaves small steps
    between bigrams). ``bits`` hold the other known words."""

    def __init__(self, hashes: np.ndarray, bits: Bits | None = None):
        self.order = np.argsort(hashes.astype(np.uint64)).astype(np.int32)
        self.hashes, self.bits = hashes.astype(np.uint64)[self.order], bits

    def __len__(self) -> int:
        return len(self.hashes) + 2

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of each word, and the sorted open words: their places follow those of the lexicon."""
        out = np.full(len(hashes), UNKNOWN, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            out = np.where(self.hashes[at] == hashes, self.order[at].astype(np.int64) + 2, UNKNOWN)
        if self.bits is None:
            return out, np.zeros(0, np.uint64)
        lacking = np.flatnonzero(out == UNKNOWN)
        lacking = lacking[self.bits.candidates(hashes[lacking])]
        words, place = np.unique(hashes[lacking], return_inverse=True)
        out[lacking] = place + len(self)
        return out, words


def bigrams(lexicon: Lexicon, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first words, second words, sizes, open words): the bigrams of each document, both edges included."""
    w = words_of(texts)
    places, words = lexicon.places(w.hashes())
    numbers = places[w.codes]
    sizes = np.diff(w.offsets)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    second = np.full(int(starts[-1]), EDGE, np.int64)
    second[np.arange(len(numbers)) + doc] = numbers
    first = np.append(EDGE, second[:-1])[: len(second)]
    first[starts[:-1]] = EDGE
    return first, second, sizes + 1, words


BLOOM_SHIFTS = np.arange(1, 4, dtype=np.uint64) * STEP


def bloom_places(pairs: np.ndarray, shift: np.uint64) -> np.ndarray:
    """One of the three bits of each pair."""
    return (mix64(pairs.astype(np.uint64) + shift) >> np.uint64(64 - BLOOM_LOG)).astype(np.int64)


KEPT = ("number", "by_first", "by_second")
REST = [("word", np.uint64), ("number", np.int64), ("log_lower", np.float64), ("log_gamma", np.float64), ("by_first", np.float64), ("by_second", np.float64)]


class Model:
    """Tables of the lexicon's words: P(w) of the lower order and gamma of each history. ``rest`` is the written table
    (REST) of the other known words, or None without any; ``size`` counts the numbers of all."""

    def __init__(self, lexicon: Lexicon, size: int, rest: DataFrame | None, lower: np.ndarray, gamma: np.ndarray, bits: Bits, history: np.ndarray, share: np.ndarray, d: tuple[float, float, float]):
        self.lexicon, self.size, self.rest, self.bits, self.d = lexicon, size, rest, bits, d
        self.log_lower, self.log_gamma = np.log10(lower), np.log10(gamma)
        self.by_first, self.by_second = 1 / (np.maximum(history, 1) * gamma), 1 / (share * lower)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"rest": None}  # tasks get the rows that they need

    def corrections(self, pairs: np.ndarray, n: np.ndarray, rest: dict[str, np.ndarray]) -> np.ndarray:
        """log10(1 + q / (gamma(h) P(w))) of bigrams that training saw n times; 0 where n is 0."""
        first, second = np.divmod(pairs, self.size)
        return np.log10(1 + (n - discount(n, self.d)) * self._by(first, rest, "by_first") * self._by(second, rest, "by_second"))

    def _by(self, numbers: np.ndarray, rest: dict[str, np.ndarray], name: str) -> np.ndarray:
        table = getattr(self, name)
        if not len(rest["number"]):
            return table[numbers]
        order = np.argsort(rest["number"])
        further = np.searchsorted(rest["number"][order], numbers)  # 0 for the lexicon's numbers
        return np.where(numbers < len(table), table[np.minimum(numbers, len(table) - 1)], rest[name][order][np.minimum(further, len(order) - 1)])



def _trusted(labels: DataFrame) -> DataFrame:
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return good.filter("doc_id IS NOT NULL AND q = 1 AND coalesce(t, 0) = 0").select("doc_id")


def _train_half(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(41)), F.lit(2)) == 0


def _training_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The written texts (text) of the training half. A bit array of fixed size keeps most other texts out of the join."""
    ids = materialize(_trusted(labels).filter(_train_half()), "kn-training-ids")
    bits = _bloom(ids.select(F.col("doc_id").alias("pair")))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(bits.candidates(np.asarray(batch.column("doc_id")))))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL")
    near_texts = texts.mapInArrow(releasing(near), "doc_id long, text string")
    chosen = materialize(near_texts.join(ids.hint("merge"), "doc_id", "left_semi").select("text"), "kn-training")
    discard(ids)
    return chosen


def _numbered(words: DataFrame, n: int, first: int, bucket: int = 1 << 20) -> DataFrame:
    """The written table (word, number) of ``n`` words (h): numbers from ``first`` on without gaps, by buckets of words."""
    buckets = max(1, math.ceil(n / bucket))
    words = words.select(F.col("h").alias("word"), F.pmod("h", F.lit(buckets)).alias("bucket"))
    begin, at = {}, first
    for b, size in sorted((r[0], r[1]) for r in words.groupBy("bucket").count().collect()):
        begin[b], at = at, at + size

    def run(table: pa.Table) -> pa.Table:
        word = np.sort(table.column("word").to_numpy())
        return pa.table({"word": word, "number": begin[table.column("bucket")[0].as_py()] + np.arange(len(word))})

    return materialize(words.groupBy("bucket").applyInArrow(run, "word long, number long"), "kn-rest")


def _open_bigrams(chosen: DataFrame, lexicon: Lexicon, rest: DataFrame) -> DataFrame:
    """(pair, n) of the bigrams with a word that may be in ``rest``; what is not there is the unknown word."""
    held = len(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                first, second, _, words = bigrams(lexicon, texts_of(part))
                pair, n = np.unique((first << 32 | second)[(first >= held) | (second >= held)], return_counts=True)
                first, second = pair >> 32, pair & ((1 << 32) - 1)
                value = np.concatenate((np.arange(held), words.view(np.int64)))
                yield pa.record_batch([pa.array(x) for x in (value[first], first >= held, value[second], second >= held, n.astype(np.int64))], names=["h", "h_open", "w", "w_open", "n"])

    rows = chosen.mapInArrow(releasing(run), "h long, h_open boolean, w long, w_open boolean, n long")
    # the key of a side that is not open is the other side, which is rare: frequent words make no hot key
    rows = rows.withColumn("h_key", F.when(F.col("h_open"), F.col("h")).otherwise(F.col("w"))).withColumn("w_key", F.when(F.col("w_open"), F.col("w")).otherwise(F.col("h")))
    for side in ("h", "w"):
        names = rest.select(F.col("word").alias(f"{side}_key"), F.col("number").alias(f"{side}_number"))
        rows = rows.join(names.hint("merge"), f"{side}_key", "left")
    number = lambda side: F.when(F.col(f"{side}_open"), F.coalesce(f"{side}_number", F.lit(UNKNOWN))).otherwise(F.col(side)).cast("long")
    return rows.select(F.shiftleft(number("h"), 32).bitwiseOR(number("w")).alias("pair"), "n")


def train(docs: DataFrame, labels: DataFrame, vocabulary: int = 1 << 18, min_count: int = 2) -> tuple[Model, DataFrame]:
    """The model, and the written bigram table (pair, n). ``vocabulary``: how many words have their tables in memory."""
    chosen = _training_texts(docs, labels)

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                w = words_of(texts_of(part))
                yield pa.record_batch([pa.array(w.hashes().view(np.int64)), pa.array(np.bincount(w.codes, minlength=len(w.dictionary)).astype(np.int64))], names=["h", "n"])

    words = chosen.mapInArrow(releasing(count_words), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    words = materialize(words, "kn-words")  # counted once for its top and its size
    known = words.filter("n >= 2")
    top = columns(known.orderBy(F.desc("n"), "h").limit(vocabulary).select("h", "n"))  # ``vocabulary`` words at most
    lexicon = Lexicon(top["h"].view(np.uint64))
    held, n_known = len(lexicon), known.count()
    unseen, size = max(1, words.count() - n_known), n_known + 2
    rest = None
    if size > held:  # the words after the last of ``top``
        n, h = (int(top[c][-1]) for c in ("n", "h")) if len(top["h"]) else (np.iinfo(np.int64).max, 0)
        rest = _numbered(known.filter((F.col("n") < n) | ((F.col("n") == n) & (F.col("h") > h))), size - held, held)
        lexicon.bits = _bloom(rest.select(F.col("word").alias("pair")))
    discard(words)

    def count_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                first, second, *_ = bigrams(lexicon, texts_of(part))
                pair, n = np.unique((first << 32 | second)[(first < held) & (second < held)], return_counts=True)
                yield pa.record_batch([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    counts = chosen.mapInArrow(releasing(count_bigrams), "pair long, n long")
    if rest is not None:
        counts = counts.unionAll(_open_bigrams(chosen, lexicon, rest))
    counts = counts.groupBy("pair").agg(F.sum("n").alias("n"))
    counts = counts.select(F.shiftright("pair", 32).alias("h"), F.col("pair").bitwiseAND((1 << 32) - 1).alias("w"), "n")
    counts = materialize(counts, "kn-bigrams")
    discard(chosen)
    by = lambda df, key, *aggs: columns(df.filter(F.col(key) < held).groupBy(key).agg(*aggs))  # noqa: E731  # ``vocabulary`` rows at most
    d2 = discounts(_counts_of_counts(counts, "n"))
    left = by(counts, "w", F.count("*").alias("types"))
    types = np.zeros(held)
    types[left["w"]] = left["types"]
    ones, total_types, after = [int((types == i).sum()) for i in (1, 2, 3, 4)], types.sum(), None
    if rest is not None:
        after = counts.filter(F.col("w") >= held).groupBy(F.col("w").alias("number")).agg(F.count("*").alias("types"))
        after = materialize(after, "kn-rest-types")
        ones = [a + b for a, b in zip(ones, _counts_of_counts(after, "types"), strict=True)]
        total_types += after.agg(F.sum("types")).first()[0]
    d1, total_types = discounts(ones), max(1.0, total_types)
    cut = lambda n, d: F.when(F.col(n) >= 3, F.lit(d[2])).when(F.col(n) == 2, F.lit(d[1])).otherwise(F.lit(d[0]))
    kept1 = np.maximum(types - discount(types, d1), 0)
    kept_types = kept1.sum()
    if after is not None:
        kept_types += after.agg(F.sum(F.greatest(F.col("types") - cut("types", d1), F.lit(0.0)))).first()[0]
    spread = (1 - kept_types / total_types) / size
    lower = kept1 / total_types + spread
    modelled = F.col("n") >= min_count
    sums = [F.sum("n").alias("c"), F.sum(F.when(modelled, F.col("n") - cut("n", d2)).otherwise(F.lit(0.0))).alias("kept")]
    right = by(counts, "h", *sums)
    c, kept = np.zeros(held), np.zeros(held)
    c[right["h"]] = right["c"]
    kept[right["h"]] = right["kept"]
    gamma = np.where(c > 0, 1 - kept / np.maximum(c, 1), 1.0)
    lower[UNKNOWN] /= unseen
    share = np.ones(held)
    share[UNKNOWN] = unseen
    further = None
    if after is not None:  # the same tables; each of these words has bigrams on both sides
        before = counts.filter(F.col("h") >= held).groupBy(F.col("h").alias("number")).agg(*sums)
        rows = rest.join(after.hint("merge"), "number").join(before.hint("merge"), "number")
        rows = rows.select("word", "number", "c", (F.greatest(F.col("types") - cut("types", d1), F.lit(0.0)) / total_types + F.lit(float(spread))).alias("lower"), (1 - F.col("kept") / F.col("c")).alias("gamma"))
        rows = rows.select("word", "number", F.log10("lower").alias("log_lower"), F.log10("gamma").alias("log_gamma"), (1 / (F.col("c") * F.col("gamma"))).alias("by_first"), (1 / F.col("lower")).alias("by_second"))
        further = materialize(rows, "kn-rest-tables")
        discard(rest, after)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.asarray(batch.column("h")) * size + np.asarray(batch.column("w"))
            yield pa.record_batch([pa.array(pair), batch.column("n")], names=["pair", "n"])

    table = materialize(counts.filter(modelled).mapInArrow(releasing(named), "pair long, n long"), "kn-table")
    model = Model(lexicon, size, further, lower, gamma, _bloom(table), c, share, d2)
    discard(counts)
    return model, table


def _counts_of_counts(counts: DataFrame, n: str) -> list[int]:
    found = {r[0]: r[1] for r in counts.filter(F.col(n) <= 4).groupBy(n).count().collect()}
    return [found.get(i, 0) for i in (1, 2, 3, 4)]


def _bloom(table: DataFrame) -> Bits:
    """Bits of all keys, or-ed by 64-bit words on the executors: BLOOM_BITS / 64 rows at most come back."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.asarray(batch.column("pair"))
            p = np.concatenate([bloom_places(pairs, shift) for shift in BLOOM_SHIFTS])
            yield pa.record_batch([pa.array(p >> 6), pa.array(np.left_shift(np.uint64(1), (p & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    rows = columns(table.select("pair").mapInArrow(releasing(places), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")))
    out = np.zeros(BLOOM_BITS // 64, np.uint64)
    out[rows["word"]] = rows["bits"].view(np.uint64)
    return Bits(out)


def _joined(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches together, up to about ``limit`` bytes of text: larger chunks ask for fewer keys."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if waiting and sum(b.column("text").nbytes for b in (*waiting, batch)) > limit:
            yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
            waiting = []
        if batch.num_rows:
            waiting.append(batch)
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def score(docs: DataFrame, model: Model, table: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """One row per input row: doc_id, text_hash, lang, n_tokens (words and the end), log10_prob."""
    fields = [("chunk", pa.int64()), ("n_docs", pa.int64()), ("n_hits", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64())), ("lang", pa.list_(pa.string())), ("tokens", pa.binary()), ("base", pa.binary()), ("hits", pa.binary()), ("codes", pa.binary()), ("n_keys", pa.int64()), ("keys", pa.binary()), ("words", pa.list_(pa.int64())), ("n_open", pa.int64()), ("open", pa.binary()), ("n_rest", pa.int64()), ("rest", pa.binary())]
    arrow = pa.schema(fields)

    def hits_of(doc: np.ndarray, pairs: np.ndarray, n_docs: int) -> dict:
        """The bigrams that may be in the model, document by document (``doc`` is sorted)."""
        at = shared.value.bits.candidates(pairs)
        doc = doc[at]
        distinct, codes = np.unique(pairs[at], return_inverse=True)
        # a document's sum does not depend on the order of its bigrams: sorted codes leave small steps
        codes = np.sort(doc << 32 | codes) & ((1 << 32) - 1)
        steps = np.diff(codes, prepend=0)
        hits = np.bincount(doc, minlength=n_docs)
        begin = (np.cumsum(hits) - hits)[hits > 0]
        steps[begin] = codes[begin]
        return {"n_hits": len(at), "hits": ck.pack(hits), "codes": ck.pack(steps.astype(np.uint32)), "n_keys": len(distinct), "keys": ck.pack(np.diff(distinct, prepend=0))}

    shared, held = docs.sparkSession.sparkContext.broadcast(model), len(model.lexicon)  # once for all three functions

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, partition, k = shared.value, TaskContext.get().partitionId(), 0
        for batch in _joined(batches, chunk_bytes):
            for part in slices(batch, limit=chunk_bytes):
                first, second, sizes, words = bigrams(model.lexicon, texts_of(part))
                starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
                doc = np.repeat(np.arange(len(sizes)), sizes)
                is_open = (first >= held) | (second >= held)
                open_bigrams = [a[is_open].astype(np.uint32) for a in (doc, first, second)]
                first[is_open] = second[is_open] = UNKNOWN  # their costs come with the answers
                cost = model.log_gamma[first] + model.log_lower[second]
                cost[is_open] = 0
                base = np.add.reduceat(cost, starts)
                closed = np.flatnonzero(~is_open)
                row = {
                    "chunk": (partition << 32 | k) << 1, "n_docs": len(part), "doc_ids": column(part, "doc_id").to_pylist(), "hashes": column(part, "text_hash").to_pylist(), "lang": column(part, "lang").to_pylist(),
                    "tokens": ck.pack(sizes), "base": base.tobytes(), **hits_of(doc[closed], first[closed] * model.size + second[closed], len(part)),
                    "words": words.view(np.int64).tolist(), "n_open": len(open_bigrams[0]), "open": ck.pack(np.concatenate(open_bigrams)),
                }
                k += 1
                yield pa.RecordBatch.from_pylist([row], schema=arrow)

    def resolve(left: pa.Table, right: pa.Table) -> pa.Table:
        """A second row for a chunk: its open bigrams, with the tables of their words."""
        model, rows = shared.value, np.zeros(right.num_rows, REST)
        for name, _ in REST:
            value = right.column(name).to_numpy()
            rows[name] = value.view(np.uint64) if name == "word" else value
        out = []
        for row in left.to_pylist():
            doc, first, second = ck.unpack(row["open"], np.uint32, 3 * row["n_open"]).astype(np.int64).reshape(3, -1)
            words = np.array(row["words"], np.int64).view(np.uint64)
            at = np.searchsorted(words, rows["word"]) + held
            number = np.concatenate((np.arange(held), np.full(len(words), UNKNOWN)))
            number[at] = rows["number"]
            gamma, lower = (np.concatenate((known, np.full(len(words), known[UNKNOWN]))) for known in (model.log_gamma, model.log_lower))
            gamma[at], lower[at] = rows["log_gamma"], rows["log_lower"]
            base = np.bincount(doc, weights=gamma[first] + lower[second], minlength=row["n_docs"])
            out.append({
                "chunk": row["chunk"] | 1, "n_docs": row["n_docs"], "doc_ids": [], "hashes": [], "lang": [], "tokens": b"", "base": base.tobytes(),
                **hits_of(doc, number[first] * model.size + number[second], row["n_docs"]), "n_rest": len(rows), "rest": ck.pack(np.concatenate([rows[name].view(np.int64) for name in KEPT])),
            })
        return pa.Table.from_pylist(out, schema=arrow)

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.col("text").cast("string")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("text_hash"))
    ddl = "chunk long, n_docs long, n_hits long, doc_ids array<long>, hashes array<long>, lang array<string>, tokens binary, base binary, hits binary, codes binary, n_keys long, keys binary, words array<long>, n_open long, open binary, n_rest long, rest binary"
    chunks = materialize(source.mapInArrow(releasing(encode), ddl), "kn-chunks")
    # open bigrams become keys of a round: no more of them than there are now
    shards = ck.shards_for(chunks.select((F.col("n_keys") + F.col("n_open")).alias("n_keys")))
    rounds = min(ROUNDS, shards)  # one where a shard holds all
    request = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("keys", pa.binary())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                pairs = np.cumsum(ck.unpack(row["keys"], np.int64, row["n_keys"]))
                shard = ck.shard_of(mix64(pairs), shards).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                out = [{"chunk": row["chunk"], "shard": s, "n": b - a, "keys": ck.pack(np.diff(pairs[order[a:b]], prepend=0))} for s, a, b in ck.runs(shard[order])]
                yield pa.RecordBatch.from_pylist(out, schema=request)

    shown = pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary())])

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The model's bigrams by shard, a million at a time, as steps between sorted ones."""
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= 1 << 20:
                yield packed(waiting)
                waiting = []
        if waiting:
            yield packed(waiting)

    def packed(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        pairs, n = (np.concatenate([np.asarray(b.column(c)) for b in batches]) for c in ("pair", "n"))
        shard = ck.shard_of(mix64(pairs), shards).astype(np.int64)
        order = np.lexsort((pairs, shard))
        pairs, n = pairs[order], n[order].astype(np.uint32)
        return pa.RecordBatch.from_pylist([{"shard": s, "n": b - a, "pairs": ck.pack(np.diff(pairs[a:b], prepend=0)), "counts": ck.pack(n[a:b])} for s, a, b in ck.runs(shard[order])], schema=shown)

    model_rows = materialize(table.mapInArrow(releasing(show), "shard long, n long, pairs binary, counts binary"), "kn-shards")
    discard(table)
    answer = pa.schema([("chunk", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("answer", pa.binary())])

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.to_pylist()
        keys = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(ck.unpack(r["pairs"], np.int64, r["n"])) for r in rows)])
        n = np.concatenate([np.zeros(0, np.uint32), *(ck.unpack(r["counts"], np.uint32, r["n"]) for r in rows)])
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        out = []
        for row in left.to_pylist():
            k = np.cumsum(ck.unpack(row["keys"], np.int64, row["n"]))
            value = np.zeros(len(k), np.uint32)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                value = np.where(keys[at] == k, n[at], 0).astype(np.uint32)
            out.append({"chunk": row["chunk"], "shard": row["shard"], "n": row["n"], "answer": ck.pack(value)})
        return pa.Table.from_pylist(out, schema=answer)

    result = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("lang", pa.string()), ("n_tokens", pa.int64()), ("log10_prob", pa.float64())])

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        total, answered = 0, right.to_pylist()
        for row in left.to_pylist():
            parts = sorted((r["shard"], r["n"], r["answer"]) for r in answered if r["chunk"] == row["chunk"])
            pairs = np.cumsum(ck.unpack(row["keys"], np.int64, row["n_keys"]))
            count = np.zeros(len(pairs), np.int64)
            if parts:  # a shard's answers are in the order of its keys
                count[np.argsort(ck.shard_of(mix64(pairs), shards), kind="stable")] = np.concatenate([ck.unpack(a, np.uint32, n) for _, n, a in parts])
            rest = ck.unpack(row["rest"], np.int64, len(KEPT) * (row["n_rest"] or 0)).reshape(len(KEPT), -1)
            rest = {name: rest[i].view(dict(REST)[name]) for i, name in enumerate(KEPT)}
            corr = shared.value.corrections(pairs, count, rest)
            steps, hits = ck.unpack(row["codes"], np.uint32, row["n_hits"]).astype(np.int64), ck.unpack(row["hits"], np.int64, row["n_docs"])
            doc = np.repeat(np.arange(row["n_docs"]), hits)
            codes = np.cumsum(steps)
            begin = (np.cumsum(hits) - hits)[hits > 0]
            codes -= np.repeat((codes - steps)[begin], hits[hits > 0])  # steps begin anew in each document
            extra = np.bincount(doc, weights=corr[codes], minlength=row["n_docs"]) if len(codes) else np.zeros(row["n_docs"])
            total = total + np.frombuffer(row["base"]) + extra
            if row["doc_ids"]:
                own = row
        columns = [pa.array(own["doc_ids"], pa.int64()), pa.array(own["hashes"], pa.int64()), pa.array(own["lang"], pa.string()), pa.array(ck.unpack(own["tokens"], np.int64, own["n_docs"])), pa.array(total)]
        return pa.table(columns, schema=result)

    number = F.shiftright("chunk", 1)  # the same for both rows of a chunk
    home = lambda df: df.withColumn("home", number).groupBy("home")
    turn = F.pmod(F.shiftright(number, 32) + number.bitwiseAND((1 << 32) - 1), F.lit(rounds))  # each task's chunks in turn

    def scored(mine: DataFrame) -> DataFrame:
        """The written scores of these chunks."""
        chunked, opened = mine.drop("words", "n_open", "open"), None
        if model.rest is not None:  # a chunk asks once for each of its open words
            asking = mine.filter("n_open > 0")
            words = asking.select(F.col("chunk").alias("of"), F.explode("words").alias("word")).join(model.rest.hint("merge"), "word")
            left = asking.select("chunk", "n_docs", "words", "n_open", "open").groupBy("chunk")
            opened = materialize(left.cogroup(words.groupBy("of")).applyInArrow(resolve, ddl), "kn-open")
            drop_shuffles(mine.sparkSession)
            chunked = chunked.unionAll(opened.drop("words", "n_open", "open"))
        asked = chunked.select("chunk", "n_keys", "keys").mapInArrow(releasing(ask), "chunk long, shard long, n long, keys binary")
        answers = asked.groupBy("shard").cogroup(model_rows.groupBy("shard")).applyInArrow(join, ck.ANSWER)
        answers = materialize(answers, "kn-answers")
        drop_shuffles(mine.sparkSession)  # the keys' shuffle goes before the chunks' begins
        scores = home(chunked).cogroup(home(answers)).applyInArrow(add, "doc_id long, text_hash long, lang string, n_tokens long, log10_prob double")
        scores = materialize(scores, "kn-scores")
        discard(opened, answers)
        return scores

    parts = [scored(chunks.filter(turn == r)) for r in range(rounds)]
    discard(chunks, model_rows, model.rest)
    return reduce(DataFrame.unionAll, parts)


def _quantiles(rows: DataFrame, keys: list[str], quantile: float) -> DataFrame:
    """For each group (``keys``): n, and t, its cost of rank ceil(quantile * n), exactly.

    Counts by steps of the cost find the step that holds it; only that step's costs are put in order."""
    step = F.floor(F.col("cost") * 256)
    group, rank = Window.partitionBy(*keys), F.greatest(F.ceil(F.lit(float(quantile)) * F.col("total")), F.lit(1))
    counted = rows.groupBy(*keys, step.alias("step")).agg(F.count("*").alias("n"))
    counted = counted.withColumn("total", F.sum("n").over(group)).withColumn("upto", F.sum("n").over(group.orderBy("step")))
    found = counted.filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    found = found.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("step").alias("_step"), "total", rank.alias("rank"), (F.col("upto") - F.col("n")).alias("below"))
    same = step == F.col("_step")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = rows.join(found.hint("merge"), same).groupBy(*keys, "total", "rank", "below", "cost").agg(F.count("*").alias("n"))
    inside = inside.withColumn("upto", F.col("below") + F.sum("n").over(group.orderBy("cost")))
    return inside.filter(F.col("upto") >= F.col("rank")).groupBy(*keys, F.col("total").alias("n")).agg(F.min("cost").alias("t"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = 0.99, margin: float = 0.05, least: int = 100, vocabulary: int = 1 << 18, min_count: int = 2) -> DataFrame:
    """One row per input row: doc_id, text_hash, lang, n_tokens, log10_prob, perplexity, threshold, keep.

    keep is false where the perplexity exceeds the threshold. Null and empty texts are the end alone. Without trusted
    documents nothing is rejected (threshold null). A null lang is a language of its own. Rows with null ids and
    repeated rows are judged row by row. Empty tables give an empty table; other columns are not read.
    """
    model, table = train(docs, labels, vocabulary, min_count)
    scored = score(docs, model, table)
    cost = scored.withColumn("cost", -F.col("log10_prob") / F.col("n_tokens")).withColumn("band", F.floor(F.log2(F.greatest(F.col("n_tokens"), F.lit(4)))).cast("int"))
    trusted = cost.join(_trusted(labels).filter(~_train_half()), "doc_id", "left_semi")
    trusted = materialize(trusted.select(F.col("lang").alias("l"), F.col("band").alias("b"), F.col("lang").alias("g"), F.lit(0).alias("a"), "cost"), "kn-trusted")
    raised = F.col("t") * (1 + margin)
    bands = _quantiles(trusted, ["l", "b"], quantile).filter(F.col("n") >= least).select("l", "b", raised.alias("t_band"))
    langs = _quantiles(trusted, ["g"], quantile).filter(F.col("n") >= least).select("g", raised.alias("t_lang"))
    everything = _quantiles(trusted, ["a"], quantile).select(raised).first()
    everything = everything[0] if everything else None
    bands, langs = materialize(bands, "kn-bands"), materialize(langs, "kn-langs")
    discard(trusted)
    out = cost.join(bands, cost["lang"].eqNullSafe(bands["l"]) & (cost["band"] == bands["b"]), "left")
    out = out.join(langs, out["lang"].eqNullSafe(langs["g"]), "left")
    limit = F.coalesce("t_band", "t_lang", F.lit(everything).cast("double"))
    return out.select(
        "doc_id", "text_hash", "lang", "n_tokens", "log10_prob", F.pow(F.lit(10.0), "cost").alias("perplexity"), F.pow(F.lit(10.0), limit).alias("threshold"),
        F.coalesce(F.col("cost") <= limit, F.lit(True)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected rows; all columns stay."""
    bad = classify(docs, labels, **options).filter(~F.col("keep")).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    # rejected ids grow with the table: the same plan at every size, as a broadcast of them would not scale
    bad = materialize(bad, "kn-rejected").hint("merge")
    same = docs["doc_id"].cast("long").eqNullSafe(bad["bad_id"]) & (F.xxhash64(docs["text"].cast("string")) == bad["bad_hash"])
    return docs.join(bad, same, "left_anti")
