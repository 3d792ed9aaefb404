import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from lodestar.llm import bpe, kneser_ney, pii, text
from lodestar.llm.queries import QUERIES, tokenizer_path
from tests.llm import test_decontam, test_kneser_ney, test_minhash, test_pii


def _tables(spark, folder):
    rng = random.Random(5)
    words = ["the", "of", "and", "to", "in"] + [f"w{i}" for i in range(60)]
    weights = [20, 15, 10, 8, 6] + [1] * 60
    body = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [[i, body(rng.randint(30, 90)), "en", "s", 0] for i in range(90)]
    items = [(i, body(20)) for i in range(4)]
    for i in range(5):
        docs[10 + i][1] = docs[i][1] + " the"  # near copies
        docs[20 + i][1] = docs[i][1]
    docs[40][1] += " " + items[1][1]
    docs[41][1] = "mail a.b@c.de " + docs[41][1] + " 10.0.0.1"
    docs[42][1] = "QQ!! ZZ## " * 30
    docs += [[200, None, None, None, None], [201, "", "de", "s", 0], [None, body(40), "en", "s", 1]]
    labels = [(i, int(i != 42), 0) for i in range(0, 90)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items, labels


def test_run_equals_brute_force(spark, tmp_path):
    docs, items, labels = _tables(spark, str(tmp_path))
    frame = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    trusted = {r.doc_id for r in kneser_ney._trusted(frame).collect()}
    half = {r.doc_id for r in kneser_ney._trusted(frame).filter(kneser_ney._train_half()).collect()}
    train = [t for i, t, *_ in docs if i in half]
    cost = {}
    for i, t, *_ in docs:
        total, n = test_kneser_ney._brute(train, t)
        cost[i] = -total / n
    held = sorted(cost[i] for i in trusted - half)
    limit = held[int(np.ceil(0.99 * len(held))) - 1] * 1.05
    left = {i: t for i, t, *_ in docs if cost[i] <= limit}
    assert 42 not in left
    kept = {i for i, (_, _, keep) in test_minhash._brute({i: t for i, t in left.items() if i is not None}, 5).items() if keep}
    left = {i: t for i, t in left.items() if i is None or i in kept}
    assert not {20, 21} & set(left)
    hit = {i for i, _ in test_decontam.brute(list(left.items()), items)}
    left = {i: t for i, t in left.items() if i not in hit}
    assert 40 not in left
    for i, t in left.items():
        for a, k, b in reversed(test_pii._plain(t or "")):
            t = t[:a] + f"[{pii.KINDS[k].upper()}]" + t[b:]
        left[i] = t
    pieces: dict = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == set(left)
    tok = bpe.load(tokenizer_path("byte_bpe_50k.json"))
    for i, rows in pieces.items():
        n = len(tok.ids(left[i] or "")) + 1
        assert sum(r.length for r in rows) == n == rows[0].doc_tokens and sorted(r.start for r in rows)[0] == 0


def test_stages_keep_the_columns(spark, tmp_path):
    _tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).columns == docs.columns
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
    assert len([n for n in QUERIES if re.match(r"op\d+_", n)]) == 10


def test_sliced_arrays_give_the_same_words():
    texts = [f"Word{i} über x{i % 7}" if i % 5 else None for i in range(5000)]
    batch = pa.record_batch([pa.array(texts)], names=["text"])
    got = []
    for part in text.slices(batch, limit=2000):
        w = text.words_of(text.texts_of(part))
        values = w.dictionary.to_pylist()
        got += [[values[c] for c in w.codes[a:b]] for a, b in zip(w.offsets[:-1], w.offsets[1:], strict=True)]
    assert got == [(t or "").lower().split() for t in texts]
