"""Personal data by weak supervision.

Candidates are spans of four kinds (email, ip, card, phone): the strict patterns, and looser forms such as
``name (at) host dot com`` or a national telephone number. Six labelers vote on each candidate (for, against or
not at all): the strict pattern, the check of its digits, a gazetteer, the words before it, its
borders, and signs of something else (versions, sums, keys). Only how often each combination of kind, form and
votes occurs leaves the executors: at most ``4 * 2 * 3**6`` sums, whatever the corpus. From these, expectation-
maximisation estimates each labeler's reliability and the posterior of each combination; a logistic classifier
trained on the posteriors decides. Spans of the strict patterns stay in any case; the classifier adds others.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.storage import bound_batches, materialize
from lodestar.llm.text import column, releasing, texts_of

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "check", "gazetteer", "context", "border", "other")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot begin inside a run of digits that has failed as a whole, hence the look-behind.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")

_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\s{0,2}(?:\(at\)|\[at\]|\{at\}|\x20at\x20)\s{0,2}([A-Za-z0-9-]{1,63}(?:\s{0,2}(?:\(dot\)|\[dot\]|\{dot\}|\x20dot\x20|\.)\s{0,2}[A-Za-z0-9-]{1,63}){1,4})", re.I)
_NATIONAL = re.compile(r"(?<![0-9A-Za-z+.(-])(?:\([0-9]{2,4}\)[\x20-]?|0[0-9]{1,4}[\x20./-]|[0-9]{3}[\x20.-])[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9A-Za-z-])")

#: Words and phrases that speak for a kind when they stand close before a span or right after it.
CUES = {
    "email": ("email", "e-mail", "mail", "contact", "write to", "reach", "correo", "courriel", "schreiben an"),
    "ip": ("ip", "ip address", "host", "server", "client", "gateway", "login from", "adresse ip"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "payment", "tarjeta", "carte", "kreditkarte"),
    "phone": ("phone", "tel", "call", "mobile", "cell", "fax", "reach", "telefon", "telefono", "appeler"),
}
#: Words that speak for something else.
OTHER = ("version", "ver", "release", "isbn", "issn", "doi", "rfc", "section", "chapter", "page", "token", "key", "password", "passwd", "secret", "hash", "v", "order", "invoice", "serial", "ref", "id", "build", "ticket", "tracking")
#: Top-level domains of the gazetteer.
DOMAINS = frozenset("com org net edu gov mil int info biz io dev app eu de fr es it uk us ca au nl ch at be pl se no dk fi pt jp cn in br ru mx".split())
#: First digits of calling codes and of card issuers.
CALLING = tuple("1 7 20 27 3 4 5 6 8 9".split())
ISSUERS = tuple("34 37 4 51 52 53 54 55 6011 65 35 2".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the strict pattern, from each @ outwards: linear also where nothing matches."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the strict patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    low = text.lower()
    if "dot" in low or "(at)" in low or "[at]" in low or "{at}" in low:
        out += [(m.start(), 0, m.end()) for m in _SPELLED.finditer(text) if "dot" in m[2].lower() or m[0].lower().find("at)") > 0 or m[0].lower().find("at]") > 0]
    if _DIGIT.search(text):
        for m in _CARD.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and not luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _NATIONAL.finditer(text)]
    return out


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """One vote of each labeler: 1 for, -1 against, 0 no opinion."""
    span, name = text[start:end], KINDS[kind]
    digits = _NOT_DIGIT.sub("", span)
    before, low = text[max(0, start - 30) : start].lower(), span.lower()
    pattern = 1 if strict else -1
    if kind == 0:
        check = 1 if re.search(r"(?:\.|dot)\s*[a-z]{2,}$", low) else -1
        gazetteer = 1 if re.split(r"[^a-z0-9-]+", low)[-1] in DOMAINS else -1
    elif kind == 1:
        parts = [int(x[-4:]) for x in span.split(".")]
        check = -1 if any(len(x) > 1 and x[0] == "0" for x in span.split(".")) else 1
        gazetteer = 1 if 0 < parts[0] < 224 and parts[0] != 127 else -1
    elif kind == 2:
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(ISSUERS) else -1
    else:
        check = 1 if 10 <= len(digits) <= 15 else -1
        if span[0] == "+":
            gazetteer = 1 if digits.startswith(CALLING) else -1
        else:  # a national number: trunk zero, or an area code from 2 on
            gazetteer = 1 if digits[0] == "0" or len(digits) == 10 and digits[0] in "23456789" else -1
    near = f" {' '.join(_WORD.findall(before))} "
    after = f" {' '.join(_WORD.findall(text[end : end + 16].lower())[:1])} "
    context = 1 if any(f" {c} " in near or f" {c} " in after for c in CUES[name]) else 0
    left, right = text[start - 1 : start], text[end : end + 1]
    border = 1 if (not left or not left.isalnum()) and (not right or not right.isalnum()) else -1
    last = near.split()[-2:]
    other = -1 if any(w in OTHER for w in last) else 0
    return (pattern, check, gazetteer, context, border, other)


def encode_votes(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = 3 * code + x + 1
    return code


def decode_votes(code: int) -> np.ndarray:
    out = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        out.append(x - 1)
    return np.array(out[::-1])


@dataclass(frozen=True)
class SpanModel:
    """Decisions for each combination (kind, votes); ``reliability`` is P(right | votes) of each labeler."""

    accept: frozenset[tuple[int, int]]
    reliability: dict[str, float]
    weights: tuple[float, ...]


def fit(combinations: list[tuple[int, int, int]], rounds: int = 50, threshold: float = 0.5) -> SpanModel:
    """combinations: (kind, vote code, count). Dawid-Skene with one prior a kind, then a logistic classifier."""
    if not combinations:
        return SpanModel(frozenset(), {}, ())
    combinations = sorted(combinations)
    kind = np.array([c[0] for c in combinations])
    v = np.array([decode_votes(c[1]) for c in combinations])
    n = np.array([c[2] for c in combinations], float)
    q = 1 / (1 + np.exp(-v.sum(axis=1)))  # start: the majority
    said = np.stack([v == x for x in (-1, 0, 1)], axis=2)  # combination, labeler, vote
    smooth = np.full((len(LABELERS), 3), 1.0)
    for _ in range(rounds):
        yes = np.einsum("c,cld->ld", n * q, said) + smooth
        no = np.einsum("c,cld->ld", n * (1 - q), said) + smooth
        yes, no = yes / yes.sum(axis=1, keepdims=True), no / no.sum(axis=1, keepdims=True)
        prior = np.array([((n * q)[kind == k].sum() + 1) / (n[kind == k].sum() + 2) for k in range(len(KINDS))])
        logit = np.log(prior / (1 - prior))[kind] + np.einsum("cld,ld->c", said, np.log(yes / no))
        nxt = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if np.abs(nxt - q).max() < 1e-9:
            break
        q = nxt
    voted = (v != 0).astype(float)
    right = np.where(v > 0, q[:, None], 1 - q[:, None]) * voted
    reliability = {name: float((n @ right)[i] / max((n @ voted)[i], 1e-9)) for i, name in enumerate(LABELERS)}
    x = np.column_stack([np.ones(len(kind)), v, np.eye(len(KINDS))[kind]])
    w = _logistic(x, q, n)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
    accept = frozenset((int(k), int(c[1])) for k, c, ok in zip(kind, combinations, p >= threshold, strict=True) if ok)
    return SpanModel(accept, reliability, tuple(w))


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, rounds: int = 30, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = x.T @ (x * (n * p * (1 - p))[:, None]) + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (n * (y - p)) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8 or not math.isfinite(step.sum()):
            break
    return w


SPAN = "struct<kind:int,start:int,end:int,strict:boolean,votes:int>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("strict", pa.bool_()), ("votes", pa.int32())]))


def candidates_of(text: str) -> list[dict]:
    """Strict spans, and loose ones that overlap none of them, with their votes."""
    out = []
    strict_spans = base_spans(text)
    starts = [a for a, _, _ in strict_spans]
    ends = list(accumulate((b for _, _, b in strict_spans), max, initial=0))  # the furthest end of the first i spans
    free = [(a, k, b) for a, k, b in loose_spans(text) if ends[bisect_left(starts, b)] <= a]
    for spans, strict in ((strict_spans, True), (free, False)):
        out += [{"kind": k, "start": a, "end": b, "strict": strict, "votes": encode_votes(votes(text, k, a, b, strict))} for a, k, b in spans]
    return out


def accepted(found: list[dict], model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(strict spans, all spans) as sorted (start, kind, end); an added span never overlaps another span."""
    base = sorted((s["start"], s["kind"], s["end"]) for s in found if s["strict"])
    added, end = [], 0
    for s in sorted((s for s in found if not s["strict"]), key=lambda s: (s["start"], s["kind"])):
        if (s["kind"], s["votes"]) in model.accept and s["start"] >= end:
            added.append((s["start"], s["kind"], s["end"]))
            end = s["end"]
    return base, sorted(base + added)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) for each row; null texts have none."""
    schema = pa.schema([("doc_id", pa.int64()), ("spans", _SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [candidates_of(t) for t in texts_of(batch).to_pylist()]
            yield pa.record_batch([column(batch, "doc_id"), pa.array(spans, _SPAN)], schema=schema)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(releasing(run), f"doc_id long, spans array<{SPAN}>")


def train(found: DataFrame) -> SpanModel:
    """Fit on the counts of all candidates; at most ``4 * 3**6`` sums come to the driver."""
    s = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.votes").count()
    return fit([(r[0], r[1], r[2]) for r in s.collect()])


def detect(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, base and spans (arrays of kind, start, end in code points, by start).

    Null or empty texts have empty arrays. Null ids and repeated rows are handled row by row. An empty table
    gives an empty table. Other columns of ``docs`` are not read.
    """
    found = materialize(candidates(docs), "pii-candidates")
    model = train(found)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc_id", pa.int64()), ("base", kind), ("spans", kind)])
    named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [accepted(f or [], model) for f in column(batch, "spans").to_pylist()]
            yield pa.record_batch([column(batch, "doc_id"), pa.array([named(b) for b, _ in both], kind), pa.array([named(a) for _, a in both], kind)], schema=schema)

    span = "array<struct<kind:string,start:long,end:long>>"
    return found.mapInArrow(releasing(run), f"doc_id long, base {span}, spans {span}")


def redact(docs: DataFrame, placeholder: str = "[{kind}]") -> DataFrame:
    """``docs`` with each detected span of ``text`` replaced; all columns and rows stay, null texts stay null."""
    bound_batches(docs.sparkSession)
    model = train(candidates(docs))
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for a, k, b in accepted(candidates_of(text), model)[1]:
            if a >= end:
                out += [text[end:a], placeholder.format(kind=KINDS[k].upper())]
            end = max(end, b)
        return "".join([*out, text[end:]]) if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            field = batch.schema.field(at)
            texts = pa.array([clean(t) for t in batch.column(at).to_pylist()], field.type)
            yield batch.set_column(at, field, texts)

    return docs.mapInArrow(releasing(run), docs.schema)
