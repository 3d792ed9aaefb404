"""Further builtins over plain values: bits, hashes, encodings, times, networks, versions, units, graphs."""

from __future__ import annotations

import base64
import hashlib
import hmac
import ipaddress
import json
import re
import time
import urllib.parse
import uuid
from datetime import UTC, datetime
from typing import Any

from lodestar.functions.values import Set, lookup, object_union, plain, same

#: Unit prefixes (decimal and binary).
PREFIXES = {"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12, "p": 10**15, "e": 10**18, "ki": 2**10, "mi": 2**20, "gi": 2**30, "ti": 2**40, "pi": 2**50, "ei": 2**60}


def subset(big: Any, small: Any) -> bool:
    """Whether ``small`` is part of ``big``: members of objects, elements of sets, runs of arrays."""
    if isinstance(big, dict) and isinstance(small, dict):
        return all(k in big and (subset(big[k], v) if isinstance(v, dict | list) else same(big[k], v)) for k, v in small.items())
    if isinstance(big, Set) and isinstance(small, Set):
        return all(x in big for x in small)
    if isinstance(big, list) and isinstance(small, Set):
        return all(any(same(x, y) for y in big) for x in small)
    if isinstance(big, list) and isinstance(small, list):
        return any(all(same(x, y) for x, y in zip(big[i:], small, strict=False)) for i in range(len(big) - len(small) + 1))
    return same(big, small)


def _paths(paths: list) -> list[list]:
    return [p if isinstance(p, list) and not isinstance(p, Set) else [x.replace("~1", "/").replace("~0", "~") for x in p.strip("/").split("/")] for p in paths]


def json_filter(doc: dict, paths: list) -> dict:
    out: dict = {}
    for path in _paths(paths):
        try:
            value = doc
            for k in path:
                value = lookup(value, int(k) if isinstance(value, list) else k)
        except Exception:  # noqa: BLE001, S112 - a path that is not there adds nothing
            continue
        for k in reversed(path):
            value = {k: value}
        out = object_union(out, value)
    return out


def json_remove(doc: Any, paths: list) -> Any:
    def without(d: Any, path: list) -> Any:
        if isinstance(d, dict):
            return {k: without(v, path[1:]) if k == path[0] else v for k, v in d.items() if k != path[0] or len(path) > 1}
        if isinstance(d, list) and str(path[0]).isdigit():
            return [without(v, path[1:]) if i == int(path[0]) else v for i, v in enumerate(d) if i != int(path[0]) or len(path) > 1]
        return d

    for p in _paths(paths):
        doc = without(doc, p)
    return doc


def reachable(graph: dict, start: list) -> Set:
    seen, todo = [], [s for s in start if s in graph]
    while todo:
        n = todo.pop()
        if n not in seen:
            seen.append(n)
            todo += [m for m in (graph[n] or []) if m in graph]
    return Set(seen)


def semver_key(v: str) -> tuple:
    m = re.fullmatch(r"(\d+)\.(\d+)\.(\d+)(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]+)?", v)
    if not m:
        raise ValueError(v)
    pre = tuple((0, int(x), "") if x.isdigit() else (1, 0, x) for x in m[4].split(".")) if m[4] else ()
    return (int(m[1]), int(m[2]), int(m[3]), not m[4], pre)


def semver_compare(a: str, b: str) -> int:
    x, y = semver_key(a), semver_key(b)
    return (x > y) - (x < y)


def _valid(f, *args) -> bool:
    try:
        f(*args)
    except ValueError:
        return False
    return True


def units_parse(text: str, size: bool = False) -> float:
    m = re.fullmatch(r"([0-9.]+)\s*([A-Za-z]*?)([bB]?)", text.strip().strip('"'))
    if not m or (m[3] and not size):
        raise ValueError(text)
    if not size and m[2] == "m":  # milli, where sizes have mega
        return float(m[1]) / 1000
    n = float(m[1]) * PREFIXES[m[2].lower()]
    return int(n) if n == int(n) else n


def rfc3339_ns(text: str) -> int:
    m = re.fullmatch(r"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?(Z|[+-]\d\d:\d\d)", text)
    if not m:
        raise ValueError(text)
    seconds = int(datetime.fromisoformat(m[1] + m[3].replace("Z", "+00:00")).timestamp())
    return seconds * 10**9 + int((m[2] or "0").ljust(9, "0"))


def _utc(ns: int) -> datetime:
    return datetime.fromtimestamp(ns // 10**9, UTC)


def duration_ns(text: str) -> int:
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h)", text)
    if "".join(a + b for a, b in parts) != text.lstrip("-"):
        raise ValueError(text)
    n = sum(float(a) * {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9}[b] for a, b in parts)
    return int(-n if text[0] == "-" else n)


def seeded(seed: Any, n: int) -> int:
    """The same number below n for the same seed."""
    return int.from_bytes(hashlib.sha256(json.dumps(plain(seed)).encode()).digest()[:8], "big") % abs(n) if n else 0


def _decode64url(s: str) -> str:
    return base64.urlsafe_b64decode(s + "=" * (-len(s) % 4)).decode()


MORE = {
    "bits.and": lambda a, b: a & b,
    "bits.or": lambda a, b: a | b,
    "bits.xor": lambda a, b: a ^ b,
    "bits.negate": lambda a: ~a,
    "bits.lsh": lambda a, n: a << n,
    "bits.rsh": lambda a, n: a >> n,
    "crypto.md5": lambda s: hashlib.md5(s.encode()).hexdigest(),
    "crypto.sha1": lambda s: hashlib.sha1(s.encode()).hexdigest(),
    "crypto.sha256": lambda s: hashlib.sha256(s.encode()).hexdigest(),
    "crypto.hmac.sha256": lambda s, k: hmac.new(k.encode(), s.encode(), "sha256").hexdigest(),
    "crypto.hmac.equal": lambda a, b: hmac.compare_digest(a, b),
    "hex.encode": lambda s: s.encode().hex(),
    "hex.decode": lambda s: bytes.fromhex(s).decode(),
    "base64.is_valid": lambda s: _valid(lambda: base64.b64decode(s, validate=True)),
    "base64url.encode": lambda s: base64.urlsafe_b64encode(s.encode()).decode(),
    "base64url.encode_no_pad": lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("="),
    "base64url.decode": _decode64url,
    "urlquery.encode": urllib.parse.quote_plus,
    "urlquery.decode": urllib.parse.unquote_plus,
    "urlquery.encode_object": lambda o: urllib.parse.urlencode(sorted((k, v) for k, vs in o.items() for v in ([vs] if isinstance(vs, str) else vs))),
    "json.is_valid": lambda s: _valid(json.loads, s),
    "json.filter": json_filter,
    "json.remove": json_remove,
    "object.subset": subset,
    "object.union_n": lambda xs: _fold(object_union, xs, {}),
    "regex.is_valid": lambda p: _compiles(p),
    "regex.split": lambda p, s: re.split(p, s),
    "regex.replace": lambda s, p, r: re.sub(p, re.sub(r"\$(\d+)", r"\\\1", r), s),
    "regex.find_n": lambda p, s, n: [m[0] for m in re.finditer(p, s)][: n if n >= 0 else None],
    "strings.count": lambda s, x: s.count(x),
    "strings.replace_n": lambda pairs, s: _fold(lambda t, kv: t.replace(*kv), sorted(pairs.items()), s),
    "strings.any_prefix_match": lambda a, b: any(x.startswith(y) for x in ([a] if isinstance(a, str) else a) for y in ([b] if isinstance(b, str) else b)),
    "strings.any_suffix_match": lambda a, b: any(x.endswith(y) for x in ([a] if isinstance(a, str) else a) for y in ([b] if isinstance(b, str) else b)),
    "indexof_n": lambda s, x: [i for i in range(len(s)) if s.startswith(x, i)],
    "graph.reachable": reachable,
    "net.cidr_contains": lambda net, x: ipaddress.ip_network(x, strict=False).subnet_of(ipaddress.ip_network(net, strict=False)),
    "net.cidr_intersects": lambda a, b: ipaddress.ip_network(a, strict=False).overlaps(ipaddress.ip_network(b, strict=False)),
    "net.cidr_is_valid": lambda x: _valid(lambda: ipaddress.ip_network(x, strict=False)),
    "net.cidr_expand": lambda x: Set(map(str, ipaddress.ip_network(x, strict=False))),
    "semver.compare": semver_compare,
    "semver.is_valid": lambda v: isinstance(v, str) and _valid(semver_key, v),
    "units.parse": units_parse,
    "units.parse_bytes": lambda s: int(units_parse(s, True)),
    "time.now_ns": time.time_ns,
    "time.parse_rfc3339_ns": rfc3339_ns,
    "time.parse_duration_ns": duration_ns,
    "time.date": lambda ns: [_utc(ns).year, _utc(ns).month, _utc(ns).day],
    "time.clock": lambda ns: [_utc(ns).hour, _utc(ns).minute, _utc(ns).second],
    "time.weekday": lambda ns: _utc(ns).strftime("%A"),
    "rand.intn": seeded,
    "uuid.rfc4122": lambda key: str(uuid.uuid5(uuid.UUID(int=0), key)),
    "print": lambda *a: True,
}


def _fold(f, xs, start):
    for x in xs:
        start = f(start, x)
    return start


def _compiles(p: str) -> bool:
    try:
        re.compile(p)
    except re.error:
        return False
    return True
