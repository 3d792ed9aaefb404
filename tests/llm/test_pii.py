import random
import re

import pytest

from lodestar.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_equal_the_plain_patterns(seed):
    rng = random.Random(seed)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "Z", "0", "25", "4111111111111111", ".", "@", "-", "%", "+1 (", ")", " ", "é", "256", "+"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == _plain(text), text


def test_long_runs_stay_linear():
    for unit in ("1", "a", "@", "1.", "+1", "1 ", "a@", "("):
        pii.candidates_of(unit * 200_000)
    many = "a@b.co (375) 555-4393; " * 20_000
    found = pii.candidates_of(many)
    assert len(found) == 40_000
    every = pii.SpanModel(frozenset((s["kind"], s["votes"]) for s in found), {}, ())
    assert len(pii.accepted(found, every)[1]) == 40_000


def test_added_spans_overlap_nothing():
    rng = random.Random(9)
    for _ in range(2000):
        text = "".join(rng.choice(["(375) 555-4393", "+1 ", "375-555-4393", " at ", "x", "dot com", "(at)", "10.0.0.1", " ", "4111111111111112"]) for _ in range(8))
        found = pii.candidates_of(text)
        base, spans = pii.accepted(found, pii.SpanModel(frozenset((s["kind"], s["votes"]) for s in found), {}, ()))
        added = sorted((a, b) for a, k, b in spans if (a, k, b) not in base)
        assert all(b <= c for (_, b), (c, _) in zip(added[:-1], added[1:], strict=True))
        assert all(b <= x or a >= y for a, b in added for x, _, y in base)


def test_reliabilities_and_decisions():
    good = pii.encode_votes((-1, 1, 1, 1, 1, 0))
    bad = pii.encode_votes((-1, -1, 0, 0, 1, -1))
    strict = pii.encode_votes((1, 1, 1, 0, 1, 0))
    model = pii.fit([(3, good, 200), (2, bad, 300), (3, strict, 5000), (2, strict, 5000)])
    assert (3, good) in model.accept
    assert (2, bad) not in model.accept
    assert model.reliability["check"] > 0.9


def test_detect_and_redact(spark):
    rows = [(1, "call (375) 555-4393 now or +1 (375) 555-4393", "x"), (2, None, None), (3, "", "y"), (4, "ü a.b@c.de 10.0.0.1, 4111 1111 1111 1111.", "z"), (None, "a@b.co", "n"), (4, "ü a.b@c.de 10.0.0.1, 4111 1111 1111 1111.", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = [(r.doc_id, [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.base]) for r in pii.detect(docs).collect()]
    assert sorted(got, key=str) == sorted([(i, _plain(t or "")) for i, t, _ in rows], key=str)
    clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert clean[4] == "ü [EMAIL] [IP], [CARD]." and clean[2] is None and clean[3] == ""
    assert "4393" not in clean[1].split("or")[1]
    assert pii.detect(docs.limit(0)).count() == 0
    assert pii.redact(docs).columns == docs.columns


def _planted(n=1500, seed=3):
    """Texts with one candidate each, its kind and whether it is personal data; decoys look alike."""
    rng = random.Random(seed)
    digits = lambda k, first="0123456789": rng.choice(first) + "".join(rng.choice("0123456789") for _ in range(k - 1))

    def card(valid):
        while pii.luhn(x := digits(16, "45")) != valid:
            pass
        return x

    cue = lambda kind: rng.choice([f"{rng.choice(pii.CUES[kind])} ", "", ""])
    out = []
    for _ in range(n):
        kind = rng.randrange(4)
        true = rng.random() < 0.7
        name = f"{rng.choice(['ana', 'jo.li', 'kim'])}{rng.randrange(99)}"
        if kind == 0:
            real = [f"{name}@host{rng.randrange(9)}.com", f"{name} (at) host{rng.randrange(9)} dot org"][rng.random() < 0.4]
            span = cue("email") + real if true else f"key {name} (at) host dot zzqx"
        elif kind == 1:
            span = cue("ip") + f"{rng.randint(1, 126)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" if true else f"page {digits(1)}.{digits(1)}.{digits(1)}"
        elif kind == 2:
            span = cue("card") + card(True) if true else f"order {card(False)}"
        else:
            national = f"({digits(3, '23456789')}) {digits(3)}-{digits(4)}"
            span = cue("phone") + rng.choice([f"+1 {national}", national]) if true else f"serial 1{digits(2)} {digits(3)} {digits(3)}"
        out.append((f"lorem ipsum {span} dolor", kind, true))
    return out


def test_labelers_against_planted_labels():
    planted = _planted()
    found = [(s, true) for text, kind, true in planted for s in pii.candidates_of(text) if s["kind"] == kind]
    counts = {}
    for s, _ in found:
        counts[s["kind"], s["votes"]] = counts.get((s["kind"], s["votes"]), 0) + 1
    model = pii.fit([(k, v, n) for (k, v), n in counts.items()])
    for i, name in enumerate(pii.LABELERS):
        said = [(int(pii.decode_votes(s["votes"])[i]), true) for s, true in found]
        said = [((v > 0) == true) for v, true in said if v]
        assert len(said) > 50, name
        assert abs(sum(said) / len(said) - model.reliability[name]) < 0.15, (name, sum(said) / len(said), model.reliability[name])
    loose = [(true, (s["kind"], s["votes"]) in model.accept) for s, true in found if not s["strict"]]
    caught = [ok for true, ok in loose if true]
    wrong = [ok for true, ok in loose if not true]
    assert len(caught) > 100 and sum(caught) / len(caught) > 0.9
    assert len(wrong) > 100 and sum(wrong) / len(wrong) < 0.05
