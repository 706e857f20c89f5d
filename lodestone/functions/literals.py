"""Words that any match of a pattern must contain.

A substring test is far cheaper than a regular expression, so a pattern runs only where one of its
words occurs.
"""

from __future__ import annotations

from re import _constants as op
from re import _parser as parser

MOST = 24


def required(regex: str) -> frozenset[str] | None:
    """A set of strings of which every match contains at least one; None if there is none."""
    return _of_sequence(parser.parse(regex))


def _worth(words: frozenset[str]) -> tuple[int, int]:
    return min(map(len, words)), -len(words)


def _of_sequence(items) -> frozenset[str] | None:
    """The best set that any mandatory part of the sequence gives: a run of letters, or a part with a set of its own."""
    found, run = [], ""
    for kind, arg in [*items, (None, None)]:
        if kind is op.LITERAL:
            run += chr(arg)
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        part = _of_item(kind, arg)
        if part and len(part) <= MOST:
            found.append(part)
    return max(found, key=_worth, default=None)


def _of_item(kind, arg) -> frozenset[str] | None:
    if kind is op.SUBPATTERN:
        return _of_sequence(arg[3])
    if kind is op.BRANCH:
        parts = [_of_sequence(x) for x in arg[1]]
        return frozenset().union(*parts) if all(parts) else None
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and arg[0] > 0:
        return _of_sequence(arg[2])
    return None
