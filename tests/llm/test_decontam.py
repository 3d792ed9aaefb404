import random
import re
from collections import Counter

import pytest

from lodestar.llm import decontam


def _words(text):
    return [w for w in re.split(r"[^\w]+|_", (text or "").lower()) if w]


def _shingles(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def brute(docs, items, shingle=5, percent=80):
    """Every window: what lies in the document of any span of the item's length, compared as multisets."""
    out = {}
    for d, text in docs:
        w = _words(text)
        for i, item in items:
            iw = _words(item)
            if not iw or not w:
                continue
            k = min(len(iw), shingle)
            want, own = Counter(_shingles(iw, k)), _shingles(w, k)
            if not want.keys() & set(own):
                continue
            m = sum(want.values())
            best = None
            for start in range(1 - m, len(own)):
                got = own[max(start, 0) : start + m]
                shared = sum((Counter(got) & want).values())
                if 200 * shared >= percent * (len(got) + m):
                    found = (2 * shared / (len(got) + m), -max(start, 0))
                    best = found if best is None else max(best, found)
            if best is not None:
                out[d, i] = best
    return out


def _case():
    rng = random.Random(8)
    vocab = [f"tok{i}" for i in range(60)] + ["the", "of"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(8, 40))) for i in range(12)] + [(50, "tiny item"), (51, ""), (52, None), (53, "a b a b a b a b a b")]
    docs = []
    for d in range(60):
        w = text(rng.randint(0, 80)).split()
        if d % 3 == 0:  # an item, perhaps with a word changed, dropped or added
            passage = items[rng.randrange(12)][1].upper().split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], ["zz"], [passage[at], "zz"]])
            w[len(w) // 2 : len(w) // 2] = passage
        docs.append((d, ", ".join(w)))
    docs += [(100, None), (101, ""), (102, "x tiny, ITEM y"), (103, "word " * 20_000 + items[3][1]), (104, "a b " * 30), (105, items[0][1]), (106, items[0][1])]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = _case()
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, "x") for r in [*items, items[2]]], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (pytest.approx(r.similarity), -r.start_word) for r in decontam.matches(d, b).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 10


def test_filter_null_ids_and_empty_tables(spark):
    docs, items = _case()
    rows = [(None, items[0][1]), (None, "clean text"), (7, items[1][1]), (7, items[1][1]), (8, None), (9, "clean")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, decontam.decontaminate(d, b).collect()), key=str) == sorted([(None, "clean text"), (8, None), (9, "clean")], key=str)
    assert decontam.decontaminate(d, b.limit(0)).count() == 6
    assert decontam.matches(d.limit(0), b).count() == 0


def test_blocks_find_all_within_the_radius(spark):
    """Flip exactly ``radius`` random bits: some block always stays equal."""
    rng = random.Random(1)
    bounds = decontam.block_bounds(46)
    assert sum(w for _, _, w in bounds) == 128 and len(bounds) == 47
    for _ in range(2000):
        x = [0, 0]
        for b in rng.sample(range(128), 46):
            x[b // 64] |= 1 << b % 64
        assert any((x[i] >> a) & ((1 << w) - 1) == 0 for i, a, w in bounds)


def test_main_path_has_no_python(spark):
    docs, items = _case()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    plan = decontam.decontaminate(d, b)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_repeated_shingles_do_not_hide_a_window(spark):
    """A quoted item followed by a run of one word: similar as multisets, far apart if a shingle votes with its count."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(404))) for i in range(12)]
    docs = [(i, " ".join(item.split()[:324] + ["go"] * 80)) for i, item in items]
    want = brute(docs, items)
    assert len(want) == 12
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (pytest.approx(r.similarity), -r.start_word) for r in decontam.matches(d, b).collect()} == want


def test_windows_that_no_shared_shingle_aligns(spark):
    """Halves in the other order, items cut at either end of a text, an item spread by added words: brute force over all windows."""
    rng = random.Random(4)
    name = lambda i, n: [f"q{i}x{j}" for j in range(n)]
    filler = [f"f{i}" for i in range(100)]
    items, docs = [], []
    for i in range(8):
        n = 40 + 9 * i
        a, b = name(i, n), name(i + 100, n)
        items.append((i, " ".join(a + b)))
        docs.append((10 * i, " ".join(filler + b + a + filler)))
        docs.append((10 * i + 1, " ".join((a + b)[: int(1.5 * n)])))
        docs.append((10 * i + 2, " ".join(filler + (a + b)[: int(1.4 * n)])))
        docs.append((10 * i + 3, " ".join((a + b)[int(0.55 * n) :] + filler)))
        spread = a + b
        for _ in range(3):
            spread.insert(rng.randrange(len(spread)), "zz")
        docs.append((10 * i + 4, " ".join(filler + spread + filler)))
    want = brute(docs, items)
    assert len(want) > 20 and all((10 * i, i) in want for i in range(8))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id): (pytest.approx(r.similarity), -r.start_word) for r in decontam.matches(d, b).collect()} == want
