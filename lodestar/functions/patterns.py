"""Glob patterns as regular expressions that both Java and Python read alike."""

from __future__ import annotations

import re
from collections.abc import Sequence

_SPECIAL = set(".^$*+?()[]{}|\\-&~#")


def _literal(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def glob_to_regex(pattern: str, delimiters: Sequence[str] | None = ()) -> str:
    """``*`` stays between delimiters, ``**`` does not, ``?`` is one character, ``[a-z]``/``[!a]`` and ``{a,b}`` choose.

    ``delimiters``: None for none at all, an empty list for the dot.
    """
    marks = [] if delimiters is None else list(delimiters) or ["."]
    one = f"[^{''.join(map(_literal, marks))}]" if marks else "(?s:.)"
    out, i, depth = [], 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            out.append(_literal(pattern[i + 1]))
            i += 2
            continue
        if c == "*":
            double = pattern[i : i + 2] == "**"
            out.append("(?s:.*)" if double else one + "*")
            i += 2 if double else 1
            continue
        if c == "?":
            out.append(one)
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            negated = inside[0] in "!^"
            body = re.sub(r"[\\\[\]^&~|]", lambda m: "\\" + m[0], inside[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
            i = end
        elif c == "{":
            out.append("(?:")
            depth += 1
        elif c == "}" and depth:
            out.append(")")
            depth -= 1
        elif c == "," and depth:
            out.append("|")
        else:
            out.append(_literal(c))
        i += 1
    return "".join(out)
