"""Text normalisation and matching as Column expressions.

``\\b`` in patterns is compiled to its ASCII meaning, so that every engine agrees on it next to
letters outside ASCII. Patterns stay literals: they are compiled once per task.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.literals import required

_BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
SENTENCE_BREAK = r"(?<=[.!?;])\s+|\n+"
TERM_LETTERS = "a-z0-9æøå"


def pattern(regex: str) -> str:
    """A pattern whose ``\\b`` have their ASCII meaning. Before a letter or digit that is one look back instead of four."""
    before_letter = re.sub(r"\\b(?=[A-Za-z0-9])", r"(?<![A-Za-z0-9_])", regex)
    return "(?s)" + re.sub(r"\\b(?=\((?:\?:)?[A-Za-z0-9 &+/|-]+\))", _before_group, before_letter).replace(r"\b", _BOUNDARY)


def _before_group(found: re.Match) -> str:
    """The boundary before a plain group: a look back where each of its alternatives begins with a letter or digit."""
    group = re.match(r"\((?:\?:)?([^)]*)\)", found.string[found.end() :])[1]
    return r"(?<![A-Za-z0-9_])" if all(re.match("[A-Za-z0-9]", x) for x in group.split("|")) else r"\b"


def matches(text: Column, *regexes: str) -> Column:
    """Whether any of the patterns occurs in a lower-case text.

    Each pattern runs only where one of the words occurs that it cannot do without.
    """
    out = F.lit(False)
    for regex in regexes:
        test, words = text.rlike(pattern(regex)), required(regex)
        out = out | (contains_any(text, sorted(words)) & test if words else test)
    return out


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def count_contained(text: Column, words) -> Column:
    out = F.lit(0)
    for word in words:
        out = out + F.when(text.contains(word), 1).otherwise(0)
    return out


def normal(text: Column) -> Column:
    """Lower case; letters, digits and a few marks; single spaces."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9æøå+/# .&-]", " "), " +", " "))


def collapsed(text: Column) -> Column:
    """Lower case, white space collapsed, punctuation kept."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\s ]+", " "))


def identity(text: Column) -> Column:
    """Lower case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def normal_text(value: str) -> str:
    """normal() of a constant."""
    return re.sub(" +", " ", re.sub("[^a-z0-9æøå+/# .&-]", " ", value.lower())).strip()


def term_pattern(term: str) -> str:
    return f"(?<![{TERM_LETTERS}]){re.escape(normal_text(term))}(?![{TERM_LETTERS}])"


def term_count(text: Column, terms) -> Column:
    """How many of the terms occur as whole words of a normalised text."""
    out = F.lit(0)
    for term in terms:
        out = out + F.when(text.contains(normal_text(term)) & text.rlike(term_pattern(term)), 1).otherwise(0)
    return out


def term_occurrences(text: Column, terms) -> Column:
    """How often any of the terms occurs."""
    return F.regexp_count(text, F.lit("|".join(term_pattern(t) for t in terms)))


def categories(text: Column, lexicon: dict[str, list[str]]) -> Column:
    """The names of the categories of which any pattern occurs, in lexicon order."""
    return F.array_compact(F.array(*(F.when(matches(text, *regexes), name) for name, regexes in lexicon.items())))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE_BREAK), lambda s: F.trim(s)), lambda s: s != "")


def lines(text: Column) -> Column:
    """Trimmed lines that are not empty."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\u0000", ""), "\r\n?", "\n")
    return F.filter(F.transform(F.split(clean, "\n"), lambda s: F.trim(s)), lambda s: s != "")


#: The entities that occur in practice; the rest stay as they are.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&apos;": "'", "&amp;": "&"}


def unescaped(text: Column) -> Column:
    for entity, char in ENTITIES.items():
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def clean_html(html: Column) -> Column:
    """Scripts, styles and tags go, then entities are decoded, then white space collapses (line ends too)."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = unescaped(F.regexp_replace(text, "(?s)<[^>]+>", " "))
    return F.trim(F.regexp_replace(text, r"[\s ]+", " "))


def clean_html_lines(html: Column) -> Column:
    """Entities are decoded first; breaks and closing blocks become line ends, of which at most two stand together."""
    text = unescaped(F.coalesce(html, F.lit("")))
    text = F.regexp_replace(text, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|li|h[1-6]|section|article|ul|ol)>", "\n")
    text = F.regexp_replace(F.regexp_replace(text, "(?s)<[^>]+>", " "), r"[ \t ]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), "\n{3,}", "\n\n"))


def clean_basic(text: Column) -> Column:
    """Tags and the four commonest entities go, white space collapses."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]*>", " ")
    for entity, char in {"&nbsp;": " ", "&amp;": "&", "&quot;": '"', "&#39;": "'"}.items():
        text = F.regexp_replace(text, f"(?i){entity}", char)
    return F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))


def folded_dashes(text: Column) -> Column:
    """Lower case, long dashes as hyphens."""
    return F.regexp_replace(F.lower(text), "[–—]", "-")
