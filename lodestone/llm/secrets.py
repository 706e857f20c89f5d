"""Secret scans with a trigram inverted index.

Each rule's regular expression gives a Boolean query of trigrams that any match must contain.
Rows are indexed in slices: postings (which rows contain a trigram) are built for the trigrams
that the queries ask for, the queries are evaluated by intersecting and uniting postings, and
only candidate rows are verified with the expression itself. A rule without mandatory trigrams
scans every row. The index is partitioned by document, so nothing is shuffled and no posting
list is longer than a slice; the scan is one narrow stage over whole texts.

Defined results: a null or empty text has no spans and the SHA-256 of the empty string; spans
are in code points, ends exclusive; repeated rows give repeated results; an empty table gives
no rows; columns besides doc_id and text are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.llm.words import byte_slices

MOST_STRINGS = 64
MOST_CLASS = 6


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, re.ASCII).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.least]


#: The base rules. A run of 16 or more hex digits is the same as a longest run that has them.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: What the method adds: public formats of credentials.
MORE = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----"),
    Rule("gkey", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("url", r"[a-z][a-z0-9+.-]{1,16}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@"),
)

# A query is None (any row), a trigram (bytes), or ("and" | "or", [queries]).


def both(*queries):
    parts = [q for q in dict.fromkeys(queries) if q is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def either(*queries):
    parts = list(dict.fromkeys(queries))
    return None if None in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def of_strings(strings: set[bytes]):
    """The query that a match contains one of these strings."""
    return either(*(both(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def fold(char: int) -> bytes:
    return chr(char).encode("utf-8", "surrogatepass").lower()


def of_items(items) -> tuple[set[bytes] | None, object]:
    """The strings that a sequence matches if they are few, else None; and its query. Letters are folded to lower case."""
    held: set[bytes] = {b""}
    exact, queries = True, []
    for kind, arg in items:
        strings, query = of_item(kind, arg)
        if strings is not None and len(held) * len(strings) <= MOST_STRINGS:
            held = {a + b for a in held for b in strings}
            continue
        if strings is not None:
            query = both(query, of_strings(strings))
        queries += [of_strings(held), query]
        exact = False
        # what a long run of strings ends in still forms trigrams with what follows
        held = {b[-2:] for b in strings} if strings is not None and len(strings) <= MOST_STRINGS else {b""}
    if exact:
        return held, of_strings(held)
    return None, both(*queries, of_strings(held))


def of_item(kind, arg) -> tuple[set[bytes] | None, object]:
    if kind is op.LITERAL:
        return {fold(arg)}, None
    if kind is op.IN:
        chars: set[bytes] = set()
        for k, a in arg:
            if k is op.LITERAL:
                chars.add(fold(a))
            elif k is op.RANGE and a[1] - a[0] < 2 * MOST_CLASS:
                chars |= {fold(c) for c in range(a[0], a[1] + 1)}
            else:
                return None, None
        return (chars, None) if len(chars) <= MOST_CLASS else (None, None)
    if kind is op.SUBPATTERN:
        return of_items(arg[3])
    if kind is op.BRANCH:
        parts = [of_items(x) for x in arg[1]]
        if all(s is not None for s, _ in parts) and sum(len(s) for s, _ in parts) <= MOST_STRINGS:
            return set().union(*(s for s, _ in parts)), None
        return None, either(*(q for _, q in parts))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        low, high, body = arg
        strings, query = of_items(body)
        if strings is not None and high in (0, 1):
            return strings | {b""} if low == 0 else strings, None
        if strings is not None and low == high and len(strings) ** int(low) <= MOST_STRINGS:
            out = {b""}
            for _ in range(int(low)):
                out = {a + b for a in out for b in strings}
            return out, None
        return None, None if low == 0 else query
    if kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
        return {b""}, None
    return None, None


def trigram_query(pattern: str):
    """A Boolean query of folded trigrams that every match of ``pattern`` satisfies; None if there is none."""
    return of_items(parser.parse(pattern))[1]


def trigrams(query) -> set[bytes]:
    return set() if query is None else {query} if isinstance(query, bytes) else set().union(*map(trigrams, query[1]))


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def postings(data: np.ndarray, at: np.ndarray, wanted: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A Boolean row for each wanted trigram: which texts contain it. number: 24-bit code to 1 + its place, 0: not wanted."""
    out = np.zeros((len(wanted), len(at) - 1), bool)
    if len(data) < 3:
        return out
    folded = _FOLD[data].astype(np.uint32)
    which = number[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
    place = np.flatnonzero(which)
    row = np.searchsorted(at, place, "right") - 1
    inside = place + 3 <= at[row + 1]
    out[which[place[inside]] - 1, row[inside]] = True
    return out


def matching(query, rows: int, found: dict[bytes, np.ndarray]) -> np.ndarray:
    if query is None:
        return np.ones(rows, bool)
    if isinstance(query, bytes):
        return found[query]
    parts = [matching(q, rows, found) for q in query[1]]
    return (np.logical_and if query[0] == "and" else np.logical_or).reduce(parts)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans: an array of (kind, start, end) by start, then by the order of the rules."""
    asked = [(rule, trigram_query(rule.pattern)) for rule in rules]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = sorted(set().union(*(trigrams(q) for _, q in asked)))
        wanted = np.array([int.from_bytes(t, "big") for t in names], np.int64)
        number = np.zeros(1 << 24, np.uint16)
        number[wanted] = np.arange(1, len(wanted) + 1)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            text = batch.column("text")
            for rows, data, at in byte_slices(text):
                n = rows.stop - rows.start
                found = dict(zip(names, postings(data, at, wanted, number), strict=True))
                spans: list[list] = [[] for _ in range(n)]
                texts: dict[int, str] = {}
                for order, (rule, query) in enumerate(asked):
                    for i in np.flatnonzero(matching(query, n, found)).tolist():
                        if i not in texts:
                            texts[i] = text[rows.start + i].as_py() or ""
                        spans[i] += [(a, order, rule.kind, b) for a, b in rule.spans(texts[i])]
                out = [[{"kind": k, "start": a, "end": b} for a, _, k, b in sorted(x)] for x in spans]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, n), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE]
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, base),
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
