"""Boolean trigram queries of regular expressions.

A query is an OR of ANDs of lower-case trigrams that every match holds, in any case. It is
derived from the parsed expression bottom-up: each part is described by the strings it can
match, as long as they are few, by the strings it can begin and end with, and by the query of
what it holds inside. Where two parts meet, the ends of the one and the beginnings of the
other make the trigrams that span both.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from itertools import product

#: Strings that describe a part at most, characters of a class that count as single ones, and branches of a query.
STRINGS, CHARACTERS, BRANCHES = 40, 12, 100
#: Copies of a repeated part that are looked at one by one.
REPEATS = 4

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])


def _or(a: Query, b: Query) -> Query:
    """Either; a branch that asks for more than another is left out."""
    both = a | b
    least = frozenset(x for x in both if not any(y < x for y in both))
    return least if len(least) <= BRANCHES else ANY


def _and(a: Query, b: Query) -> Query:
    """Both; if that takes too many branches, the one with fewer."""
    if len(a) * len(b) > BRANCHES:
        return min(a, b, key=lambda q: (q == ANY, len(q)))
    return _or(frozenset(x | y for x in a for y in b), frozenset())


def _grams(strings: frozenset[str]) -> Query:
    """One of the strings: ANY if one of them is too short to hold a trigram."""
    found: Query = frozenset()
    for s in strings:
        found = _or(found, frozenset([frozenset(s[i : i + 3] for i in range(len(s) - 2))]))
    return found or ANY


@dataclass(frozen=True)
class _Part:
    """exact: all strings it matches, or None; starts and ends: what its matches begin and end with; query: what they hold."""

    exact: frozenset[str] | None
    starts: frozenset[str]
    ends: frozenset[str]
    query: Query = ANY


_EMPTY = frozenset([""])
_NOTHING = _Part(_EMPTY, _EMPTY, _EMPTY)
_UNKNOWN = _Part(None, _EMPTY, _EMPTY)


def _strings(values: frozenset[str]) -> _Part:
    return _Part(values, values, values) if len(values) <= STRINGS else _UNKNOWN


def _open(p: _Part) -> _Part:
    """The part without its exact strings: their trigrams go into the query, only their ends stay."""
    query = p.query if p.exact is None else _and(p.query, _grams(p.exact))
    starts, ends = frozenset(s[:2] for s in p.starts), frozenset(s[-2:] for s in p.ends)
    return _Part(None, starts if len(starts) <= STRINGS else _EMPTY, ends if len(ends) <= STRINGS else _EMPTY, query)


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str]:
    return frozenset(x + y for x, y in product(a, b))


def _then(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= STRINGS:
        return _strings(_cross(a.exact, b.exact))
    starts = _cross(a.exact, b.starts) if a.exact is not None and len(a.exact) * len(b.starts) <= STRINGS else a.starts
    ends = _cross(a.ends, b.exact) if b.exact is not None and len(a.ends) * len(b.exact) <= STRINGS else b.ends
    between = _grams(_cross(a.ends, b.starts)) if len(a.ends) * len(b.starts) <= STRINGS**2 else ANY
    return _open(_Part(None, starts, ends, _and(_and(_open(a).query, _open(b).query), between)))


def _either(a: _Part, b: _Part) -> _Part:
    if a.exact is not None and b.exact is not None and len(a.exact | b.exact) <= STRINGS:
        return _strings(a.exact | b.exact)
    a, b = _open(a), _open(b)
    return _Part(None, a.starts | b.starts, a.ends | b.ends, _or(a.query, b.query))


def _character(code: int) -> _Part:
    # Other letters may have several lower-case forms; what they hold is not asked for.
    return _strings(frozenset([chr(code).lower()])) if code < 128 else _UNKNOWN


def _class(items: list) -> _Part:
    codes: set[int] = set()
    for kind, value in items:
        if kind is _LITERAL:
            codes.add(value)
        elif kind is _RANGE and value[1] - value[0] <= 128:
            codes.update(range(value[0], value[1] + 1))
        else:
            return _UNKNOWN  # a negated class, a category or a long range
    lower = frozenset(chr(c).lower() for c in codes)
    return _strings(lower) if max(codes) < 128 and len(lower) <= CHARACTERS else _UNKNOWN


_parser = re._parser  # the standard library's own parse tree
_LITERAL, _RANGE = re._constants.LITERAL, re._constants.RANGE


def _part(kind, value) -> _Part:
    name = str(kind)
    if name == "LITERAL":
        return _character(value)
    if name == "IN":
        return _class(value)
    if name == "SUBPATTERN":
        return _sequence(value[-1])
    if name == "ATOMIC_GROUP":
        return _sequence(value)
    if name == "BRANCH":
        found = [_sequence(x) for x in value[1]]
        part = found[0]
        for other in found[1:]:
            part = _either(part, other)
        return part
    if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, inner = value
        one = _sequence(inner)
        part = _NOTHING
        for _ in range(min(int(least), REPEATS)):
            part = _then(part, one)
        if least == 0 and most == 1:
            return _either(one, _NOTHING)
        return part if most == least <= REPEATS else _then(part, _UNKNOWN)
    if name in ("AT", "ASSERT", "ASSERT_NOT"):
        return _NOTHING  # takes no characters
    return _UNKNOWN


def _sequence(items) -> _Part:
    part = _NOTHING
    for kind, value in items:
        part = _then(part, _part(kind, value))
    return part


def trigram_query(pattern: str) -> list[list[str]]:
    """OR of ANDs of lower-case trigrams that every match of a Java regular expression holds; empty if none is mandatory.

    What the two dialects read differently, or what doesn't parse, has no query.
    """
    if "&&" in pattern or "\\Q" in pattern:
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            tree = _parser.parse(pattern)
    except (re.error, Warning, OverflowError):
        return []
    query = _open(_sequence(tree)).query
    return [] if any(not branch for branch in query) else sorted(sorted(branch) for branch in query)
