import math
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from lodestar.llm import kneser_ney as kn


def _corpus(n=120):
    rng = random.Random(2)
    words = ["the", "of", "and", "to", "in"] + [f"w{i}" for i in range(40)]
    weights = [20, 15, 10, 8, 6] + [1] * 40
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(8, 60))), "en" if i % 3 else "de", 7.0) for i in range(n)]
    rows += [(1000 + i, "ZZ!! QQ## " * 20 + f"junk{i}%%", "en", 0.0) for i in range(6)]
    rows += [(2000, None, "en", 0.0), (2001, "", None, 0.0), (2002, "the of " * 20_000, "fr", 0.0), (None, "the of and", "en", 0.0)]
    return rows


def _frames(spark):
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, lang string, threshold double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(120)] + [(1000, 0, 0), (None, 1, 0), (3, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


def _brute(train, text):
    """Interpolated modified Kneser-Ney, plainly: bigrams that occur once give their mass to the lower order."""
    count = Counter(w for t in train for w in t.split())
    vocab = {w for w, c in count.items() if c >= 2}
    unseen = max(1, len(count) - len(vocab))
    seq = lambda t: ["<e>", *(w if w in vocab else "<u>" for w in (t or "").lower().split()), "<e>"]
    pairs = Counter((a, b) for t in train for a, b in zip(seq(t)[:-1], seq(t)[1:], strict=True))
    types, hist = Counter(b for _, b in pairs), Counter()
    for (a, _), c in pairs.items():
        hist[a] += c
    d2 = kn.discounts([sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)])
    d1 = kn.discounts([sum(c == i for c in types.values()) for i in (1, 2, 3, 4)])
    cut = lambda c, d: d[min(c, 3) - 1]
    size, total = len(vocab) + 2, sum(types.values())
    mass = sum(c - cut(c, d1) for c in types.values())
    lower = lambda w: (max(types[w] - cut(types[w], d1), 0) if types[w] else 0) / total + (1 - mass / total) / size
    kept = Counter()
    for (a, _), c in pairs.items():
        if c >= 2:
            kept[a] += c - cut(c, d2)

    def prob(a, b):
        q = (pairs[a, b] - cut(pairs[a, b], d2)) / hist[a] if pairs[a, b] >= 2 else 0
        gamma = 1 - kept[a] / hist[a] if hist[a] else 1
        return (q + gamma * lower(b)) / (unseen if b == "<u>" else 1)

    known = [*vocab, "<e>", "<u>"]
    for a in list(known)[:5]:
        assert sum(prob(a, b) * (unseen if b == "<u>" else 1) for b in known) == pytest.approx(1)
    s = seq(text)
    return sum(math.log10(prob(a, b)) for a, b in zip(s[:-1], s[1:], strict=True)), len(s) - 1


def test_scores_equal_brute_force_and_junk_goes(spark):
    docs, labels = _frames(spark)
    half = {r.doc_id for r in kn._trusted(labels).filter(kn._train_half()).collect()}
    assert 5 not in half and None not in half
    train = [t for i, t, *_ in _corpus() if i in half]
    rows = kn.classify(docs, labels, least=5, quantile=1.0).collect()
    assert len(rows) == len(_corpus())
    got = {r.doc_id: r for r in rows}
    for i, t, *_ in _corpus():
        want, n = _brute(train, t)
        assert (got[i].n_tokens, got[i].log10_prob) == (n, pytest.approx(want, rel=1e-5)), t
    assert not any(got[1000 + i].keep for i in range(6))
    assert all(got[i].keep for i in range(120))


def test_filter_keeps_columns_and_rows_with_null_ids(spark):
    docs, labels = _frames(spark)
    kept = kn.keep_good(docs, labels, least=5, quantile=1.0)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and None in ids and 2002 in ids and not ids & {1000 + i for i in range(6)}


def test_without_labels_nothing_is_rejected(spark):
    docs, labels = _frames(spark)
    assert kn.classify(docs, labels.limit(0)).filter("NOT keep OR threshold IS NOT NULL").count() == 0
    assert kn.classify(docs.limit(0), labels).count() == 0


def _whole(train, text):
    """The same model with every bigram: those that occur once are discounted by D1."""
    count = Counter(w for t in train for w in t.split())
    vocab = {w for w, c in count.items() if c >= 2}
    unseen = max(1, len(count) - len(vocab))
    seq = lambda t: ["<e>", *(w if w in vocab else "<u>" for w in (t or "").lower().split()), "<e>"]
    pairs = Counter(p for t in train for p in zip(seq(t)[:-1], seq(t)[1:], strict=True))
    types, hist, kept = Counter(b for _, b in pairs), Counter(), Counter()
    d2 = kn.discounts([sum(c == i for c in pairs.values()) for i in (1, 2, 3, 4)])
    d1 = kn.discounts([sum(c == i for c in types.values()) for i in (1, 2, 3, 4)])
    for (a, _), c in pairs.items():
        hist[a] += c
        kept[a] += c - d2[min(c, 3) - 1]
    known, total = [*vocab, "<e>", "<u>"], sum(types.values())
    own = {w: max(types[w] - d1[min(types[w], 3) - 1], 0) if types[w] else 0 for w in known}
    lower = {w: own[w] / total + (1 - sum(own.values()) / total) / len(known) for w in known}

    def prob(a, b):
        q = (pairs[a, b] - d2[min(pairs[a, b], 3) - 1]) / hist[a] if pairs[a, b] else 0
        return q + (1 - kept[a] / hist[a] if hist[a] else 1) * lower[b]

    assert all(sum(prob(a, b) for b in known) == pytest.approx(1) for a in known)
    s = seq(text)
    return sum(math.log10(prob(a, b) / (unseen if b == "<u>" else 1)) for a, b in zip(s[:-1], s[1:], strict=True))


def test_bigrams_that_occur_once_are_in_the_registered_model(spark, tmp_path):
    """The query and the pipeline's stage: all bigrams of training, as an unpruned brute force has them."""
    import corpus_pipeline
    from lodestar.llm.queries import op10_kneser_ney_quality

    docs, labels = _frames(spark)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    half = {r.doc_id for r in kn._trusted(labels).filter(kn._train_half()).collect()}
    train = [t for i, t, *_ in _corpus() if i in half]
    got = {r.doc_id: r for r in op10_kneser_ney_quality(spark, str(tmp_path)).collect()}
    for i, t, *_ in _corpus():
        assert got[i].log10_prob == pytest.approx(_whole(train, t), rel=1e-5), t
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i, r in got.items() if r.keep}


@pytest.mark.parametrize("vocabulary, full", [(0, False), (7, True)])
def test_words_beyond_those_in_memory_are_in_the_model(spark, vocabulary, full, monkeypatch):
    if full:  # bit arrays that let everything through: results do not depend on them
        monkeypatch.setattr(kn, "_bloom", lambda table: kn.Bits(np.full(kn.BLOOM_BITS // 8, 255, np.uint8)))
    docs, labels = _frames(spark)
    half = {r.doc_id for r in kn._trusted(labels).filter(kn._train_half()).collect()}
    train = [t for i, t, *_ in _corpus() if i in half]
    got = {r.doc_id: r for r in kn.classify(docs, labels, vocabulary=vocabulary, min_count=1).collect()}
    assert len(got) == len(_corpus())
    for i, t, *_ in _corpus():
        assert got[i].log10_prob == pytest.approx(_whole(train, t), rel=1e-9), t


def test_numbers_of_words_have_no_gap(spark):
    words = spark.range(-500, 500).selectExpr("id * 7919 AS h")
    got = kn._numbered(words, 1000, 12, bucket=64).collect()
    assert {r.word for r in got} == {i * 7919 for i in range(-500, 500)}
    assert sorted(r.number for r in got) == list(range(12, 1012))


def test_all_trusted_documents_train_or_set_the_threshold(spark):
    """More than 20,000 documents train, and more set the threshold: none is left out, and its rank is exact."""
    rng = random.Random(3)
    words, weights = [f"w{i}" for i in range(60)], [1 / (1 + i) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(2, 12))), "en" if i % 5 else None) for i in range(46_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(46_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    half = {r.doc_id for r in kn._trusted(labels).filter(kn._train_half()).collect()}
    assert 20_000 < len(half) < 26_000
    train = [t for i, t, _ in rows if i in half]
    got = {r.doc_id: r for r in kn.classify(docs, labels, min_count=1).collect()}
    for i, t, _ in rows[:4]:
        assert got[i].log10_prob == pytest.approx(_whole(train, t), rel=1e-9)
    costs: dict = {}
    for i, _, lang in rows:
        if i not in half:
            costs.setdefault((lang, max(got[i].n_tokens, 4).bit_length()), []).append(-got[i].log10_prob / got[i].n_tokens)
    for i, _, lang in rows:
        held = sorted(costs[lang, max(got[i].n_tokens, 4).bit_length()])
        assert math.log10(got[i].threshold) == pytest.approx(held[math.ceil(0.99 * len(held)) - 1] * 1.05, rel=1e-12)


def _shuffled(spark) -> dict[int, int]:
    """The bytes that each stage so far has put into a shuffle."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty()
    quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
    stages = context.statusStore().stageList(None, False, False, quantiles, spark._jvm.java.util.ArrayList())
    return {s.stageId(): s.shuffleWriteBytes() for s in map(stages.apply, range(stages.size()))}


def test_chunks_are_not_shuffled_all_at_once(spark, monkeypatch):
    """Scoring goes in rounds: no shuffle is near the size of the chunks; each row has its score once, as in one round."""
    rng = random.Random(4)
    words, weights = [f"w{i}" for i in range(800)], [1 / (1 + i) for i in range(800)]
    rows = [(i if i % 50 else None, " ".join(rng.choices(words, weights, k=rng.randint(1, 160)) + [f"u{i}"] * (i % 40 == 1)), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.range(3000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    whole = {(r.doc_id, r.text_hash): r.log10_prob for r in kn.classify(docs, labels, vocabulary=50, min_count=1).collect()}
    written, write = {}, kn.materialize

    def recorded(df, label):
        out = write(df, label)
        written[label] = sum(f.stat().st_size for f in Path(out._lodestar_path.removeprefix("file:")).glob("*.parquet"))
        return out

    monkeypatch.setattr(kn, "materialize", recorded)
    monkeypatch.setattr(kn.ck, "SHARD_KEYS", 10_000)
    model, table = kn.train(docs, labels, vocabulary=50, min_count=1)
    before = _shuffled(spark)
    got = kn.score(docs, model, table, chunk_bytes=1 << 15).collect()
    assert max(n for stage, n in _shuffled(spark).items() if stage not in before) < 0.5 * written["kn-chunks"]
    assert len(got) == len(rows) and {(r.doc_id, r.text_hash): pytest.approx(r.log10_prob, rel=1e-12) for r in got} == whole
    half = {r.doc_id for r in kn._trusted(labels).filter(kn._train_half()).collect()}
    train, by_id = [t for i, t, _ in rows if i in half], {r.doc_id: r.log10_prob for r in got}
    for i, t, _ in rows[1:4]:
        assert by_id[i] == pytest.approx(_whole(train, t), rel=1e-9)
