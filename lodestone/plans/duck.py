"""Small generators for the SQL twins: the same lexicons as DuckDB expressions."""

from __future__ import annotations

import re

from lodestone.functions.text import TERM_LETTERS, normal_text


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def normal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9æøå+/# .&-]', ' ', 'g'), ' +', ' ', 'g'))"


def collapsed(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[\\s ]+', ' ', 'g'))"


def identity(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', '', 'g')"


def matches(x: str, *regexes: str) -> str:
    joined = "|".join(f"(?:{r})" for r in regexes)
    return f"regexp_matches({x}, {text('(?s)' + joined)})"


def contains_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def count_contained(x: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({x}, {text(w)}) AS INT)" for w in words) + ")"


def term_count(x: str, terms) -> str:
    rx = lambda t: f"(^|[^{TERM_LETTERS}]){re.escape(normal_text(t))}([^{TERM_LETTERS}]|$)"
    return "(" + " + ".join(f"CAST(regexp_matches({x}, {text(rx(t))}) AS INT)" for t in terms) + ")"


def categories(x: str, lexicon: dict[str, list[str]]) -> str:
    cases = ", ".join(f"CASE WHEN {matches(x, *regexes)} THEN {text(name)} END" for name, regexes in lexicon.items())
    return f"list_filter([{cases}], lambda c: c IS NOT NULL)"


def cases(pairs, otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {otherwise} END"
