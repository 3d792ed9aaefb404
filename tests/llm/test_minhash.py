import random
import re

import numpy as np
import pytest

from lodestar.llm import minhash
from lodestar.llm.components import connected_components


def _sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def _brute(texts, k):
    sets = {i: _sets(t, k) for i, t in texts.items()}
    comp = {i: i for i in texts}
    for _ in texts:
        for a in texts:
            for b in texts:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in texts}


def _texts(seed, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out, bases = {}, [[rng.choice(vocab) for _ in range(rng.randint(10, 60))] for _ in range(6)]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out[3 * i] = " ".join(w)
    out |= {1: "", 4: None, 7: "one", 10: "ONE", 13: "one two", 16: "One\tTwo", 19: "a b a b a b", 22: "x " * 30_000}
    return out


@pytest.mark.parametrize("k, star, block", [(2, 256, 1024), (5, 3, 4)])
def test_components_equal_brute_force(spark, k, star, block):
    texts = _texts(k)
    docs = spark.createDataFrame([(i, t, i, True) for i, t in texts.items()], "doc_id long, text string, component_id long, kept boolean")
    rows = minhash.near_duplicates(docs, shingle=k, star_group=star, block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == _brute(texts, k)


def test_null_ids_repeats_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (9, "a b c"), (None, None)], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle=2).collect())
    assert rows == sorted([(-1, None, True), (-1, None, True), (5, 5, True), (5, 5, True), (9, 5, False)], key=str) or set(rows) == {(-1, None, True), (5, 5, True), (9, 5, False)} and len(rows) == 5
    assert minhash.near_duplicates(docs.limit(0)).count() == 0


def test_densify_fills_from_filled_bins():
    sig = minhash.one_permutation([np.array([5, 1 << 60], np.uint64), np.zeros(0, np.uint64)])
    assert set(sig[0].tolist()) == {5, 1 << 60}
    assert (sig[1] == minhash._EMPTY).all()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, x) for x in range(2, 40)] + [(7, 7), (None, 3), (1, 2)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: 100 for x in range(100, 161)} | {x: 1 for x in range(1, 40)}
