import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import chunks as ck
from lodestar.llm import doubling, suffix


def _brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(d), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return out


def _texts(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "of", "and", "über", "x"]) + str(rng.randint(0, 400))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randint(length // 8, length // 2)) for _ in range(6)]
    out = []
    for _ in range(40):
        parts = [rng.choice([text(rng.randint(0, 40)), rng.choice(passages)]) for _ in range(rng.randint(1, 6))]
        whole = " ".join(parts)
        if rng.random() < 0.5 and len(whole) > 10:  # cut passages short at both ends
            whole = whole[rng.randrange(len(whole) // 2) : -rng.randrange(1, len(whole) // 2)]
        out.append(whole)
    for t in rng.sample(out, 10):  # near copies
        k = rng.randrange(len(t) + 1)
        out.append(t[:k] + "Z" + t[k + 1 :])
    return out + [out[0], out[0], None, "", "a" * 3 * length, "ab" * length, "short", passages[0][: length - 1], "y" + text(30) + "y" * length]


@pytest.mark.parametrize("seed, length, chunk", [(1, 128, 1 << 20), (2, 128, 900), (3, 200, 3000), (4, 151, 2000)])
def test_equals_brute_force(spark, seed, length, chunk):
    texts = _texts(seed, length)
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_spans long")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs, length=length, chunk_bytes=chunk).collect()}
    assert [rows[i] for i in range(len(texts))] == _brute(texts, length)


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(str(i) for i in range(200))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (5, "x")], "doc_id long, text string")
    rows = suffix.remove_repeats(docs, length=128, with_text=True).collect()
    assert sorted((r.doc_id or 0, r.n_removed, bytes(r.kept)) for r in rows) == [(0, len(text), b""), (4, len(text), b""), (4, len(text), b""), (5, 0, b"x")]
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed, chunk", [(5, 1 << 20), (6, 2000)])
def test_passages_of_words(spark, seed, chunk):
    """Words in runs of 20 that also start elsewhere, whatever their bytes."""
    texts = _texts(seed, 128) + ["A b\tC " * 15, None, "", " ".join(f"w{i}" for i in range(20)), "x " + " ".join(f"W{i}" for i in range(20)) + " y"]
    words = [(t or "").lower().split() for t in texts]
    seen = Counter(tuple(w[i : i + 20]) for w in words for i in range(len(w) - 19))
    want = []
    for w in words:
        inside = {j for i in range(len(w) - 19) if seen[tuple(w[i : i + 20])] > 1 for j in range(i, i + 20)}
        want.append(len(inside))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: (r.n_passage_words, r.n_removed) for r in suffix.remove_repeats(docs, length=128, passage=20, chunk_bytes=chunk).collect()}
    assert [rows[i][0] for i in range(len(texts))] == want and want[-1] == 20
    assert [rows[i][1] for i in range(len(texts))] == [r[1] for r in _brute(texts, 128)]


@pytest.mark.parametrize("seed, length", [(7, 128), (8, 16), (9, 151)])
def test_prefix_doubling_equals_brute_force(spark, seed, length):
    texts = _texts(seed, max(length, 64)) + [None, "a" * (length - 1), "b" * length, "c" * (length + 1)]
    docs = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, rank long")
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in doubling.remove_repeats(docs, length=length).collect()}
    assert [rows[i] for i in range(len(texts))] == _brute(texts, length)


def test_prefix_doubling_at_batch_cuts_null_ids_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(doubling, "_STEP", 50)
    text = " ".join(str(i) for i in range(200))
    docs = spark.createDataFrame([(None, text), (4, text), (4, text), (5, "x"), (6, text[3:] + "!")], "doc_id long, text string")
    rows = doubling.remove_repeats(docs, length=100).collect()
    n = len(text)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in rows) == [(0, n, n), (4, n, n), (4, n, n), (5, 1, 0), (6, n - 2, n - 3)]
    assert doubling.remove_repeats(docs.limit(0), length=100).count() == 0


def test_long_names_are_made_at_chosen_places_only(monkeypatch):
    """Sampling a chunk doubles names up to GRAM for all positions; longer ones are made where a test needs them."""
    made, doubled = [], suffix.doubled
    monkeypatch.setattr(suffix, "doubled", lambda h, m: made.append(len(h)) or doubled(h, m))
    data = np.random.default_rng(1).integers(97, 123, 50_000).astype(np.uint8)
    names, tests, places, _ = suffix.segments(data, np.array([30_000, 20_000]), 400, 169, suffix.GRAM)
    half, full = names.at(places, 200), names.at(tests, 400)
    assert sum(made) <= 2 * len(data)
    everywhere = np.arange(len(data) - 399)
    assert (names.at(everywhere, 400)[tests] == full).all()
    assert (names.at(np.arange(len(data) - 199), 200)[places] == half).all()


@pytest.mark.parametrize("window", [2, 7, 64, 169])
def test_window_minima_across_blocks(monkeypatch, window):
    monkeypatch.setattr(suffix, "_BLOCK", 50)
    h = np.random.default_rng(2).integers(0, 5, 333).astype(np.uint64) << np.uint64(40)
    assert suffix.window_minima(h, window).tolist() == [i + int(np.argmin(h[i : i + window])) for i in range(len(h))]


def test_names_of_regions_equal_names_in_place():
    data = np.random.default_rng(3).integers(0, 256, 3000).astype(np.uint8)
    lo, hi = np.array([0, 40, 500, 900, 2500]), np.array([10, 60, 500, 1000, 2600])
    units, shift = suffix.regions(data, lo, hi, 400)
    assert len(units) == 460 + 900 + 500
    for a, b, s in zip(lo.tolist(), hi.tolist(), shift.tolist(), strict=True):
        starts = np.arange(a, b + 1)
        assert (suffix.Names(units, suffix.GRAM).at(starts - s, 400) == suffix.Names(data, suffix.GRAM).at(starts, 400)).all()


def test_words_of_odd_texts():
    texts = ["", "A b\tB", "a", "a", " \x0b\x0c\r\n", "\x00 \x1f\u00a0 \x85", "Über über ÜBER", "x" * 8 + " " + "x" * 9, "q" * 64 + " " + "Q" * 65 + " " + "q" * 200, "ab\x00 ab", "end ", ""]
    data = "".join(texts).encode()
    row = {"n_docs": len(texts), "sizes": ck.pack(np.array([len(t.encode()) for t in texts])), "size": len(data), "blob": pa.compress(data, codec="zstd", asbytes=True)}
    want = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in texts]
    hashes, counts = suffix._words(row)
    assert counts.tolist() == [len(w) for w in want]
    assert suffix._word_counts(*suffix._text(row)).tolist() == counts.tolist()
    words = [x for w in want for x in w]
    assert len(set(zip(words, hashes.tolist(), strict=True))) == len(set(words)) == len(set(hashes.tolist()))
