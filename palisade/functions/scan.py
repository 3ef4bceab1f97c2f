"""One pass over a text for many patterns, under a budget.

An Aho-Corasick automaton over the literals that the patterns can't match without goes once over the text and says which
patterns are worth trying; few are. Those are searched one by one with a limit of time, so a text that makes
a pattern backtrack costs a bounded time and is reported as undecided. A pattern that matters only together with others is
tried only where one of these was found. The function is an Arrow function from a
column of texts to the numbers of the patterns that match; what follows from them is up to column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .patterns import DIGIT, alternatives, needed_sets

#: The limit is for so many characters; a longer text has as many limits.
SPAN = 16_000
#: Digits that read as letters where only letters and digits count.
_LOOKS = str.maketrans("013457", "oieast")
_KEPT = bytes(range(48, 58)) + bytes(range(97, 123))
_COMPACT = bytes(ord(chr(b).translate(_LOOKS)) for b in range(256))
_DROPPED = bytes(b for b in range(256) if b not in _KEPT)


def compact_form(text: str) -> bytes:
    """Letters and digits only, with the usual digits read as letters."""
    return text.encode("utf-8", "replace").translate(_COMPACT, _DROPPED)


class Patterns:
    """Numbers for what is looked for: patterns, an administrator's own ones, and phrases in the compact form of a text."""

    def __init__(self):
        self.numbers: dict[tuple[str, str], int] = {}
        self.relies: dict[int, set[int]] = {}
        self.alone: set[int] = set()

    def _number(self, kind: str, what: str) -> int:
        return self.numbers.setdefault((kind, what), len(self.numbers))

    def pattern(self, pattern: str, on: str | None = None) -> int:
        """on: the pattern without which this one doesn't matter here."""
        number = self._number("built in", pattern)
        if on is None:
            self.alone.add(number)
        else:
            self.relies.setdefault(number, set()).add(self._number("built in", on))
        return number

    def own(self, pattern: str) -> int:
        """A pattern of which nothing is known, so that it is always tried."""
        return self._number("own", pattern)

    def phrase(self, phrase: str) -> int:
        return self._number("phrase", phrase)

    def reliant(self) -> dict[int, set[int]]:
        return {n: on for n, on in self.relies.items() if n not in self.alone}


class Scanner:
    def __init__(self, sought: Patterns, seconds: float):
        import ahocorasick
        import regex

        self.seconds, self.phrases, literals = seconds, [], {DIGIT: 1}
        reliant = sought.reliant()
        #: (number, masks of literals of which each has to be there, compiled), for numbers of their own and for reliant ones
        self.first, self.second = [], []
        for (kind, what), number in sought.numbers.items():
            if kind == "phrase":
                self.phrases.append((what.encode(), number))
                continue
            for part in alternatives(what) if kind == "built in" else [what]:
                sets = needed_sets(part) if kind == "built in" else ()
                masks = [sum(literals.setdefault(x, 1 << len(literals)) for x in sorted(s)) for s in sets]
                entry = (number, masks, regex.compile(part, regex.I))
                if number in reliant:
                    self.second.append((*entry, reliant[number]))
                else:
                    self.first.append(entry)
        self.digit, self.digits = regex.compile(r"\d"), literals.pop(DIGIT)
        # one character is everywhere: a plain test is cheaper than its matches
        self.single = [(x, literals.pop(x)) for x in list(literals) if len(x) == 1]
        self.automaton = ahocorasick.Automaton() if literals else None
        for literal, bit in literals.items():
            self.automaton.add_word(literal, bit)
        if literals:
            self.automaton.make_automaton()

    def literals(self, text: str) -> int:
        """The bits of the literals that a text has."""
        # the pattern language takes a dotless i for an i where case is ignored
        plain = text if text.isascii() else text.replace("ı", "i")
        bits = self.digits if self.digit.search(text) else 0
        for literal, bit in self.single:
            if literal in plain:
                bits |= bit
        if self.automaton:
            for _, bit in self.automaton.iter(plain):
                bits |= bit
        return bits

    def _search(self, compiled, text: str) -> bool:
        limit = self.seconds * (1 + len(text) // SPAN)
        try:
            return compiled.search(text, timeout=limit) is not None
        except TimeoutError:
            # once more, for a machine that was busy with other work
            return compiled.search(text, timeout=4 * limit) is not None

    def find(self, text: str) -> list[int] | None:
        """The numbers of what is in a text, or None if a search ran out of time."""
        found, there = set(), self.literals(text)
        try:
            for number, masks, compiled in self.first:
                if number not in found and all(m & there for m in masks) and self._search(compiled, text):
                    found.add(number)
            for number, masks, compiled, on in self.second:
                if number not in found and not found.isdisjoint(on) and all(m & there for m in masks) and self._search(compiled, text):
                    found.add(number)
        except TimeoutError:
            return None
        if self.phrases:
            compacted = compact_form(text)
            found.update(number for phrase, number in self.phrases if phrase in compacted)
        return sorted(found)


def scan(texts: Column, sought: Patterns, seconds: float) -> Column:
    """For an array of texts, an array with the numbers of what is in each; null for a text that took too long."""
    made: list[Scanner] = []

    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def found(columns: pd.Series) -> pd.Series:
        if not made:  # once in a worker's task
            made.append(Scanner(sought, seconds))
        find = made[0].find

        def each(values: Iterable[str] | None):
            return None if values is None else [find(v) for v in values]

        return columns.map(each)

    return found(texts)
