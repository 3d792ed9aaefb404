import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from lodestar.llm import bpe, packing, wordpiece
from lodestar.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
TEXTS = ["", None, "Hello  world", "naïve café ß\n\ttabs 12345 <|endoftext|> it's", "x" * 3000, " a b " * 2000, "日本語 テスト 🙂"]


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, length string, sequence_id long")


def test_fast_ids_equal_the_tokenizer_files():
    full = Tokenizer.from_file(PATH)
    full.encode_special_tokens = True
    for t in TEXTS:
        assert bpe.load(PATH).ids(t or "").tolist() == full.encode(t or "", add_special_tokens=False).ids


def test_every_id_is_in_one_piece_and_offsets_are_gapless(spark):
    texts = TEXTS * 3 + ["word " * n for n in range(0, 900, 37)]
    docs = _docs(spark, texts)
    rows = packing.pack_documents(docs.unionByName(docs.limit(3)), PATH, seq_len=256, group_docs=16).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        want = np.concatenate((bpe.load(PATH).ids(t or ""), [0])).astype("<u4")
        got = sorted(by_doc[i], key=lambda r: r.start)
        if i >= 3:  # not repeated
            assert b"".join(r.ids for r in got) == want.tobytes()
        assert all(zlib.crc32(r.ids) == zlib.crc32(want[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(want) for r in got)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256


@pytest.mark.parametrize("sizes", [[600] * 500, [random.Random(1).randint(1, 5000) for _ in range(700)], [1], []])
def test_padding_is_small(sizes):
    packed = packing.pack_lengths(sizes, 1024)
    used = [sum(p[2] for p in s) for s in packed]
    assert sum(used) == sum(sizes)
    assert max(used, default=0) <= 1024
    assert sum(u < 1024 - 32 for u in used) <= 1


def test_empty_tables(spark):
    docs = _docs(spark, ["x"]).limit(0)
    assert packing.pack_documents(docs, PATH).count() == 0
    assert wordpiece.token_counts(docs, PATH).count() == 0


def _greedy(word: bytes, pieces: set[bytes]) -> int:
    n, a = 0, 0
    while a < len(word):
        b = len(word)
        while word[a:b] not in pieces:
            b -= 1
        a, n = b, n + 1
    return n


def test_counts_equal_naive_longest_match(spark):
    pieces = set(bpe.vocabulary(PATH)[0])
    texts = [*TEXTS, "thhaen nding\x0bononen\x1cx  antidisestablishmentarianism"]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in wordpiece.token_counts(_docs(spark, texts), PATH).collect()}
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        assert got[i] == (len(words), sum(_greedy(b" " + w, pieces) for w in words))


def test_failure_links_on_a_small_vocabulary():
    singles = {bytes([b]) for b in range(256)}
    pieces = singles | {b"abcd", b"bcx", b"ab", b"cde", b"bcdef"}
    automaton = wordpiece.Automaton(pieces, lead=b"")
    rng = random.Random(3)
    words = [bytes(rng.choice(b"abcdefx") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    import pyarrow as pa

    assert automaton.counts(pa.array(words, pa.large_binary())).tolist() == [_greedy(w, pieces) for w in words]


def test_groups_are_bounded_by_bytes_and_rows_with_null_ids_stay(spark):
    texts = ["abc " * 400] * 12 + [None, "", "abc " * 400]
    docs = spark.createDataFrame([(None if i > 12 else i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    rows = packing.pack_documents(docs, PATH, seq_len=256, group_bytes=4000).collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 2
    assert len({r.sequence_id >> 32 for r in packing.pack_documents(docs, PATH, seq_len=256).collect()}) == 1
    total = sum(len(bpe.load(PATH).ids(t or "")) + 1 for t in [*texts, texts[0]])
    assert sum(r.length for r in rows) == total
    assert sum(r.length for r in rows if r.doc_id is None) == len(bpe.load(PATH).ids(texts[0])) + 2
    assert sum(r.length for r in rows if r.doc_id == 0) == 2 * len(bpe.load(PATH).ids(texts[0])) + 2
