import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.llm import hmm
from lodestar.llm.text import words_of

TEXTS = ["the cat sat", "", None, "The dog\tsat\x0bthere", "le chat dort", "the the the", "un chien dort la", "cat", "Zebra únique", "the cat sat"] * 3


def _docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, score double")


def _held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2


def test_forward_equals_the_sum_over_all_paths():
    m = hmm.Hmm.initial(3, 5)
    seqs = np.array([0, 3, 4, 1, 2, 4], np.int32)
    starts, lengths = np.array([0, 3, 5]), np.array([3, 2, 1])
    got = hmm.forward(m, seqs, starts, lengths)
    for i in range(3):
        x = seqs[starts[i] : starts[i] + lengths[i]]
        p = 0.0
        for path in itertools.product(range(3), repeat=len(x)):
            q = m.start[path[0]] * m.emit[path[0], x[0]]
            for t in range(1, len(x)):
                q *= m.move[path[t - 1], path[t]] * m.emit[path[t], x[t]]
            p += q
        assert got[i] == pytest.approx(math.log10(p), rel=1e-9)


def test_each_round_raises_the_likelihood():
    rng = np.random.default_rng(1)
    seqs = np.concatenate([rng.choice([0, 1, 2] if i % 2 else [3, 4, 5], 30) for i in range(60)]).astype(np.int32)
    starts, lengths = np.arange(60) * 30, np.full(60, 30)
    m, last = hmm.Hmm.initial(2, 6), -np.inf
    for _ in range(8):
        start, move, emit, ll = hmm.expected_counts(m, seqs, starts, lengths)
        assert ll >= last - 1e-3
        assert emit.sum() == pytest.approx(1800, rel=1e-4) and start.sum() == pytest.approx(60, rel=1e-4) and move.sum() == pytest.approx(60 * 29, rel=1e-3)
        m, last = hmm.updated(start, move, emit, smooth=1e-3), ll
    assert hmm.forward(m, seqs, starts, lengths).sum() > 60 * 30 * math.log10(1 / 4)


def test_base_score_and_counts(spark):
    got = {r.doc_id: r for r in hmm.score_documents(_docs(spark), _held_out(), states=2, classes=17, rounds=2, chunk_bytes=40).collect()}
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [0] for t in TEXTS]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(TEXTS))]
    c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in enumerate(words):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel=1e-9)
        assert r.score < 0
    assert len(got) == len(TEXTS)


def test_words_and_their_unseen_share_sum_to_one(spark):
    """One-word texts: the probabilities of all known words and of each class's unseen share sum to 1 at most."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(0, " ".join(words))] + [(i + 1, w) for i, w in enumerate(words)] + [(99, None)], "doc_id long, text string")
    rows = hmm.score_documents(docs, F.col("doc_id") > 0, states=2, classes=9, rounds=2).collect()
    total = sum(10**r.score for r in rows if 0 < r.doc_id < 99)
    assert 0 < total < 1


def test_empty_table_and_no_training(spark):
    assert hmm.score_documents(_docs(spark).limit(0), _held_out()).count() == 0
    rows = hmm.score_documents(_docs(spark, ["a b", None]), F.lit(True), states=2, classes=5, rounds=1).collect()
    assert [r.n_known for r in rows] == [0, 0] and all(r.base_score == 0 for r in rows)


def _paths(model, xs):
    """(path, probability) over every sequence of states."""
    start, move, emit = model
    for path in itertools.product(range(len(start)), repeat=len(xs)):
        p = start[path[0]] * emit[path[0]][xs[0]]
        for t in range(1, len(xs)):
            p *= move[path[t - 1]][path[t]] * emit[path[t]][xs[t]]
        yield path, p


def _trained(seqs, states, classes, rounds):
    """Baum-Welch by counting over every path, smoothed as ``updated`` says."""
    first = hmm.Hmm.initial(states, classes, 5)
    model = (first.start.tolist(), first.move.tolist(), first.emit.tolist())
    for _ in range(rounds):
        start, move, emit = [0.0] * states, [[0.0] * states for _ in range(states)], [[0.0] * classes for _ in range(states)]
        for xs in seqs:
            found = list(_paths(model, xs))
            whole = sum(p for _, p in found)
            for path, p in found:
                start[path[0]] += p / whole
                for t, k in enumerate(path):
                    emit[k][xs[t]] += p / whole
                    if t:
                        move[path[t - 1]][k] += p / whole
        every = sum(map(sum, emit))
        share = [(sum(e[c] for e in emit) + 1) / (every + classes) for c in range(classes)]
        scaled = lambda row: [x / sum(row) for x in row]
        model = (scaled([x + 0.1 for x in start]), [scaled([x + 0.1 for x in r]) for r in move], [scaled([x + states * share[c] for c, x in enumerate(e)]) for e in emit])
    return model


@pytest.mark.parametrize("chunk_bytes", [40, 1 << 20])
def test_score_equals_a_model_trained_over_all_paths(spark, chunk_bytes):
    """From texts to log10 probabilities: nulls, null ids and repeated rows included."""
    states, classes, rounds = 2, 7, 3
    texts = [*TEXTS, "the dog the dog", "une zebra", "THE  CAT"]
    rows = [(None if i % 9 == 8 else i, t, i % 4 == 1) for i, t in enumerate(texts)]
    rows += rows[:3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, apart boolean")
    words = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t, _ in rows]
    key = {w: int(words_of(pa.array([w])).hashes()[0]) % (classes - 1) for ws in words for w in ws}
    counts = Counter(w for ws, (_, _, apart) in zip(words, rows, strict=True) if not apart for w in ws)
    n, v = Counter(), Counter()
    for w, c in counts.items():
        n[key[w]] += c
        v[key[w]] += 1
    seqs = [[key[w] for w in ws] + [classes - 1] for ws in words]
    model = _trained([xs for xs, (_, _, apart) in zip(seqs, rows, strict=True) if not apart], states, classes, rounds)
    want = []
    for (i, _, apart), ws, xs in zip(rows, words, seqs, strict=True):
        p = math.log10(sum(p for _, p in _paths(model, xs)))
        want.append((i is None, i or 0, apart, len(xs), p + sum(math.log10((counts[w] + 1) / (n[key[w]] + v[key[w]] + 1)) for w in ws)))
    got = hmm.score_documents(docs, F.col("apart"), states, classes, rounds, chunk_bytes=chunk_bytes).collect()
    found = sorted((r.doc_id is None, r.doc_id or 0, r.held_out, r.n_tokens, r.score) for r in got)
    assert len(found) == len(want)
    for a, b in zip(found, sorted(want), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-4)


def test_words_of_a_class_sum_to_one_less_its_unseen_share(spark):
    """With one state, one-word texts have P(class) * P(word | class) * P(end): over known words and each class's one
    unseen share, the words' part is the classes' own probability."""
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(0, " ".join(words))] + [(i + 1, w) for i, w in enumerate(words)], "doc_id long, text string")
    classes = 9
    rows = {r.doc_id: r.score for r in hmm.score_documents(docs, F.col("doc_id") > 0, states=1, classes=classes, rounds=2).collect()}
    key = {w: int(words_of(pa.array([w])).hashes()[0]) % (classes - 1) for w in words}
    sizes = Counter(key.values())
    emit = _trained([[key[w] for w in words] + [classes - 1]], 1, classes, 2)[2][0]
    total = sum(10 ** rows[i + 1] / emit[-1] for i in range(40)) + sum(emit[k] / (2 * c + 1) for k, c in sizes.items())
    assert total == pytest.approx(sum(emit[k] for k in sizes), rel=1e-4)
