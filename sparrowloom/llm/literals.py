"""Which of several expressions can match a text at all, told by literals that are
derived from the expressions themselves.

Every match of an expression holds at least one of its required literals, so a
text without any of them need not be tried: nothing is ever lost by screening.
All literals are looked for in one pass over the text.
"""

from __future__ import annotations

import re
from re import _constants as ops
from re import _parser as parser

try:
    import ahocorasick
except ImportError:  # one search per literal does the same more slowly
    ahocorasick = None

#: Signs that re.IGNORECASE takes for these letters, besides those that lower() maps to them.
_ALIKE = (("İ", "i"), ("ı", "i"), ("ſ", "s"))


def folded(text: str) -> str:
    """Lower case as re.IGNORECASE sees it; every sign keeps its place."""
    if not text.isascii():
        for sign, plain in _ALIKE:
            text = text.replace(sign, plain)
    return text.lower()


def _weight(s: frozenset[str]) -> tuple[int, int]:
    return min(map(len, s)), -len(s)


def _needed(items) -> list[frozenset[str]]:
    """Sets of literals, the most telling first; a match holds one of each set."""
    found, run = [], ""
    for op, arg in [*items, (None, None)]:
        if op is ops.LITERAL:
            run += folded(chr(arg))
            continue
        if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
            continue  # no width
        if run:
            found.append(frozenset([run]))
            run = ""
        if op is ops.BRANCH:
            parts = [_needed(b) for b in arg[1]]
            if all(parts):
                found.append(frozenset().union(*(x[0] for x in parts)))
        elif op is ops.SUBPATTERN:
            found += _needed(arg[3])
        elif op is ops.ATOMIC_GROUP:
            found += _needed(arg)
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT) and arg[0] >= 1:
            found += _needed(arg[2])
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg) and len(arg) <= 8:
            found.append(frozenset(folded(chr(a)) for _, a in arg))
    return sorted((x for x in set(found) if x), key=_weight, reverse=True)


def required(expression: re.Pattern, most: int = 2) -> list[frozenset[str]]:
    """Up to ``most`` sets of folded literals; every match holds at least one of each set."""
    return _needed(parser.parse(expression.pattern, expression.flags))[:most]


def _first(items) -> frozenset[str] | None:
    run = ""
    for op, arg in items:
        if op is ops.LITERAL:
            run += folded(chr(arg))
        elif op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
            continue
        elif run:
            break
        elif op is ops.BRANCH:
            parts = [_first(b) for b in arg[1]]
            return frozenset().union(*parts) if all(parts) else None
        elif op is ops.SUBPATTERN:
            return _first(arg[3])
        elif op is ops.IN and all(o is ops.LITERAL for o, _ in arg):
            return frozenset(folded(chr(a)) for _, a in arg)
        else:
            return None
    return frozenset([run]) if run else None


def beginnings(expression: re.Pattern) -> tuple[str, ...]:
    """Folded literals with one of which every match begins; the empty one if there are none such."""
    return tuple(sorted(_first(parser.parse(expression.pattern, expression.flags)) or {""}))


class Screen:
    """The names of the expressions that may match a text."""

    def __init__(self, expressions: dict[str, re.Pattern]):
        self.need, self.by = {}, {}
        for name, expression in expressions.items():
            sets = required(expression)
            self.need[name] = len(sets)
            for i, literals in enumerate(sets):
                for x in literals:
                    self.by.setdefault(x, []).append((name, i))
        self.always = frozenset(name for name, n in self.need.items() if not n)
        self.automaton = None
        if ahocorasick is not None and self.by:
            self.automaton = ahocorasick.Automaton()
            for x, marks in self.by.items():
                self.automaton.add_word(x, marks)
            self.automaton.make_automaton()

    def _hits(self, low: str):
        if self.automaton is not None:
            return self.automaton.iter(low)
        return sorted((m.start() + len(x) - 1, marks) for x, marks in self.by.items() for m in re.finditer(f"(?={re.escape(x)})", low))

    def _met(self, seen: set[tuple[str, int]]) -> set[str]:
        met: dict[str, int] = {}
        for name, _ in seen:
            met[name] = met.get(name, 0) + 1
        return {name for name, n in met.items() if n == self.need[name]}

    def names(self, text: str) -> set[str]:
        """Expressions that may match somewhere in the text."""
        seen = set()
        for _, marks in self._hits(folded(text)):
            seen.update(marks)
        return self._met(seen) | self.always

    def by_unit(self, text: str, starts: list[int]) -> dict[int, set[str]]:
        """Expressions, other than those to be tried always, that may match within each of the units that begin at ``starts``."""
        seen: dict[int, set] = {}
        unit, last, end = -1, len(starts) - 1, -1
        for place, marks in self._hits(folded(text)):
            while place >= end:
                unit += 1
                end = starts[unit + 1] if unit < last else len(text) + 1
            if unit in seen:
                seen[unit].update(marks)
            else:
                seen[unit] = set(marks)
        return {u: met for u, marks in seen.items() if (met := self._met(marks))}
