"""Many patterns over a text in one pass.

An Aho-Corasick automaton holds, for all patterns of some lexicons, the literals that a match cannot do without. One pass
over a text finds where they stand; a pattern is tried only there, within its greatest width of a literal. A pattern without
a literal or a bound on its width is tried on the whole text, once.

The automaton is built from the lexicons in each Python worker, and kept; ``MOST_LITERALS`` bounds its size.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.literals import required

MOST_LITERALS, MOST_WIDTH = 20_000, 1_000

#: Lexicons by name, each a tuple of (category, patterns): hashable, so that a worker can keep what it has built.
Lexicons = tuple[tuple[str, tuple[tuple[str, tuple[str, ...]], ...]], ...]


def frozen(**lexicons: dict[str, list[str]]) -> Lexicons:
    return tuple((name, tuple((c, tuple(p)) for c, p in lexicon.items())) for name, lexicon in lexicons.items())


class Matcher:
    def __init__(self, lexicons: Lexicons) -> None:
        self.names = [(lexicon, category) for lexicon, held in lexicons for category, _ in held]
        self.unbound: list[tuple[int, re.Pattern]] = []
        near: dict[str, list[tuple[int, re.Pattern, int]]] = {}
        for number, regexes in enumerate(patterns for _, held in lexicons for _, patterns in held):
            for regex in regexes:
                # the ASCII meaning of \b, as in the expressions of functions/text.py
                compiled, words, width = re.compile(regex, re.ASCII | re.DOTALL), required(regex), parser.parse(regex).getwidth()[1]
                if not words or width > MOST_WIDTH:
                    self.unbound.append((number, compiled))
                    continue
                for word in words:
                    near.setdefault(word, []).append((number, compiled, int(width)))
        if len(near) > MOST_LITERALS:
            raise ValueError(f"{len(near)} literals, {MOST_LITERALS} at most")
        self.automaton = ahocorasick.Automaton() if near else None
        for word, tests in near.items():
            self.automaton.add_word(word, (len(word), tests))
        if near:
            self.automaton.make_automaton()

    def found(self, text: str) -> list[bool]:
        """Which categories occur in a lower-case text, in the order of ``names``."""
        out = [False] * len(self.names)
        if self.automaton is not None:
            for end, (length, tests) in self.automaton.iter(text):
                for number, compiled, width in tests:
                    if not out[number]:
                        out[number] = occurs(compiled, text, max(0, end + 1 - width), end + 1 - length + width)
        for number, compiled in self.unbound:
            out[number] = out[number] or compiled.search(text) is not None
        return out


def occurs(compiled: re.Pattern, text: str, low: int, high: int) -> bool:
    """Whether the pattern matches from low on and not beyond high. What is seen with the text cut off there is tried again on the whole text."""
    while m := compiled.search(text, low, high + 1):
        if compiled.match(text, m.start()):
            return True
        low = m.start() + 1
    return False


@lru_cache(maxsize=16)
def matcher(lexicons: Lexicons) -> Matcher:
    return Matcher(lexicons)


def finder(lexicons: Lexicons) -> Callable[[pa.Array], pa.Array]:
    """From a batch of lower-case texts to structs of arrays of categories."""
    fields = [lexicon for lexicon, _ in lexicons]
    own = [(fields.index(lexicon), category) for lexicon, held in lexicons for category, _ in held]

    def find(texts: pa.Array) -> pa.Array:
        # a text is decoded when its turn comes, so that a batch is held once and never as strings too
        held, names = matcher(lexicons), pa.array([category for _, category in own], pa.string())
        ends, at = [[0] for _ in fields], [[] for _ in fields]
        for text in texts:
            for number, there in enumerate(held.found(text.as_py() or "")):
                if there:
                    at[own[number][0]].append(number)
            for end, found in zip(ends, at, strict=True):
                end.append(len(found))
        lists = [pa.ListArray.from_arrays(pa.array(end, pa.int32()), names.take(pa.array(found, pa.int32()))) for end, found in zip(ends, at, strict=True)]
        return pa.StructArray.from_arrays(lists, fields)

    return find


def categories_of(text: Column, lexicons: Lexicons) -> Column:
    """struct of arrays: for each lexicon the categories that occur in a lower-case text, in its order; null texts have none."""
    kinds = ", ".join(f"{lexicon}: array<string>" for lexicon, _ in lexicons)
    return F.arrow_udf(finder(lexicons), f"struct<{kinds}>")(text)
