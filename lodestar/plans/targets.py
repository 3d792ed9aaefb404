"""What each filter target can express, and the checks a condition must pass to go there."""

from __future__ import annotations

from collections.abc import Iterable

from lodestar.plans.conditions import COMPARISONS, MEMBERSHIP, STRINGS, Always, Compound, Condition, Field, FieldRef

_COMPARE = frozenset(COMPARISONS)
_ALL = _COMPARE | {"in"} | frozenset(STRINGS)

#: Operators and features of each (target, dialect).
TARGETS: dict[tuple[str, str], tuple[frozenset[str], frozenset[str]]] = {
    ("sql", "sqlite"): (_COMPARE | {"in"}, frozenset({"not", "field-ref"})),
    ("sql", "sqlite-internal"): (_ALL, frozenset({"not", "field-ref"})),
    ("sql", "mysql"): (_ALL, frozenset({"not", "field-ref"})),
    ("sql", "postgresql"): (_ALL, frozenset({"not", "field-ref"})),
    ("sql", "sqlserver"): (_ALL, frozenset({"not", "field-ref"})),
    ("ucast", "all"): (_ALL, frozenset({"not", "field-ref"})),
    ("ucast", "prisma"): (_ALL, frozenset({"not"})),
    ("ucast", "linq"): (_COMPARE | {"in"}, frozenset()),
    ("ucast", "minimal"): (_COMPARE, frozenset()),
    ("spark", "all"): (_ALL | frozenset(MEMBERSHIP), frozenset({"not", "field-ref"})),
}


class FragmentError(ValueError):
    """A rule or condition outside the fragment that can become a filter."""

    code = "pe_fragment_error"

    def __init__(self, problems: str | list[str]):
        self.problems = [problems] if isinstance(problems, str) else problems
        super().__init__("; ".join(self.problems))


def problems(condition: Condition, target: tuple[str, str]) -> list[str]:
    if target not in TARGETS:
        raise FragmentError(f"unknown target {target[0]}/{target[1]}")
    ops, features = TARGETS[target]
    name = "/".join(target)
    out: list[str] = []

    def walk(c: Condition) -> None:
        if isinstance(c, Compound):
            if c.op == "not" and "not" not in features:
                out.append(f"'not' is not supported by {name}")
            for p in c.parts:
                walk(p)
        elif isinstance(c, Field):
            if c.op not in ops:
                out.append(f"'{c.op}' is not supported by {name}")
            if isinstance(c.value, FieldRef) and "field-ref" not in features:
                out.append(f"comparing two fields is not supported by {name}")
            if isinstance(c.value, FieldRef) and c.op in (*STRINGS, *MEMBERSHIP):
                out.append(f"'{c.op}' needs a known operand")
        elif not isinstance(c, Always):
            out.append(f"unexpected node {type(c).__name__}")

    walk(condition)
    return list(dict.fromkeys(out))


def check(condition: Condition, targets: Iterable[tuple[str, str]]) -> Condition:
    """The condition itself if every target can express it; else one error with all problems."""
    found = [p for t in targets for p in problems(condition, t)]
    if found:
        raise FragmentError(found)
    return condition
