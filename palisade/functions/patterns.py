"""The literals that a pattern can't match without, from its syntax tree.

Almost no text holds what a policy looks for, so each alternative of a pattern is searched only where one of its
literals is there (see scan).
"""

from __future__ import annotations

from functools import lru_cache
from re import _constants as op
from re import _parser as parser

#: Stands for "some decimal digit" among the literals.
DIGIT = "\\d"
_DIGITS = set(range(48, 58))


def alternatives(pattern: str) -> list[str]:
    """The pattern cut at its top-level bars."""
    out, depth, in_class, start, i = [], 0, False, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]"
        elif c == "[":
            in_class = True
            i += pattern[i + 1 : i + 2] in ("]", "^")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and not depth:
            out.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*out, pattern[start:]]


def _worth(found: frozenset[str]) -> tuple[float, int]:
    """How rare a set is, about: long literals are, and so are signs."""
    return (min(0 if a == DIGIT else len(a) + (not a.isalpha()) / 2 for a in found), -len(found))


def _needed(tree) -> list[frozenset[str]]:
    """Sets of literals; every match has at least one of each set."""
    sets: list[frozenset[str]] = []
    run = ""

    def close() -> None:
        nonlocal run
        if run:
            sets.append(frozenset([run]))
        run = ""

    for kind, value in tree:
        if kind is op.LITERAL:
            run += chr(value).lower()
            continue
        close()
        if kind is op.SUBPATTERN:
            sets += _needed(value[3])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            sets += _needed(value[2]) if value[0] >= 1 else []
        elif kind is op.BRANCH:
            each = [max(_needed(branch), key=_worth, default=None) for branch in value[1]]
            sets += [frozenset().union(*each)] if all(each) else []
        elif kind is op.IN:
            digits = all(k is op.RANGE and set(range(v[0], v[1] + 1)) <= _DIGITS or k is op.CATEGORY and v is op.CATEGORY_DIGIT for k, v in value)
            few = len(value) <= 4 and all(k is op.LITERAL for k, _ in value)
            sets += [frozenset([DIGIT])] if digits else [frozenset(chr(v).lower() for _, v in value)] if few else []
    close()
    return sets


@lru_cache(maxsize=None)
def needed_sets(pattern: str) -> tuple[frozenset[str], ...]:
    """Sets of at most 40 literals, of each of which every match has at least one."""
    return tuple(dict.fromkeys(s for s in _needed(parser.parse(pattern)) if len(s) <= 40))


def needed_literals(pattern: str) -> tuple[str, ...] | None:
    """The rarest of the sets, or None if there is none."""
    best = max(needed_sets(pattern), key=_worth, default=None)
    return tuple(sorted(best)) if best else None
