"""Review of a CV against a job: summary choice, rewrites, and the changes that are proposed.

All of it is array expressions over one row per CV and job, so a summary's sentences are compared inside
their own row and no join pairs them. The choice among combinations of sentences is a branch and bound, or for few
sentences a look at all of them in arrays over many rows.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import lines, matches, pattern
from lodestone.operators import evidence, requirements
from lodestone.operators.cv import SUMMARY_HEADING
from lodestone.operators.evidence import clean_source
from lodestone.operators.observed import fenced

# Where a summary ends, what opens a sentence, what counts as proof, and the rewrites.
SUMMARY_STOP = r"^(professional\s+experience|work\s+experience|experience|employment|career\s+history|skills|core\s+competenc(?:e|es|ies)|key\s+skills|technical\s+skills|education|certifications?|courses?)$"
CONTACT = r"@|https?://|linkedin|\+?\d[\d ()-]{6,}"
IDENTITY_ROLE = r"\b(senior|lead|manager|consultant|director|head)\b"
IDENTITY_FIELD = r"\b(project|delivery|program|programme|technology|technical|it)\b"
YEARS = r"\b\d+\+?\s*years?\b"
PROOF = (r"^\s*(most recently|previously)\b", r"\bngsp\b", r"\b\d+\+?\s*(?:specialists?|people|countries)\b")
CAPABILITY, RESPONSIBLE, SOFT = r"^\s*(skilled|strong|experienced)\b", r"^\s*responsible for\b", r"^\s*(known for|comfortable)\b"
REWRITES = (
    (r"\bLed the delivery of\b", "Led delivery of", True), (r"\bworked closely with\b", "collaborated with", False), (r"\bhelping to maintain\b", "supporting", False),
    (r"\bhelping maintain\b", "supporting", False), (r"\bin order to\b", "to", False), (r"\s+,", ",", False),
)
LABELS = {
    "end_to_end": "End-to-end delivery", "distributed": "Distributed / international teams", "release": "Release readiness / go-live", "risk_dependency": "Risk & dependency management",
    "integration": "Integration dependencies", "governance": "Programme / delivery governance", "regulatory": "Regulatory / compliance delivery", "agile": "Agile / hybrid delivery",
}
MOST_WORDS, MOST_SENTENCES = 120, 4
#: Candidates of a row up to which all their combinations are looked at, together with those of other rows.
MOST_AT_ONCE = 8


def finds(text: Column, regex: str) -> Column:
    return text.rlike("(?i)" + pattern(regex))


def replaced(text: Column, regex: str, by: str, once: bool = True) -> Column:
    """Case-blind replacement; once: of the first match only."""
    if not once:
        return F.regexp_replace(text, "(?i)" + pattern(regex), by)
    return F.regexp_replace(text, f"(?is)^(.*?){pattern(regex).removeprefix('(?s)')}", "$1" + by)


def ended(text: Column) -> Column:
    # in an array of one, so that what makes the text stands in the expression once
    return F.transform(F.array(text), lambda t: F.when((t == "") | t.rlike("[.!?]$"), t).otherwise(F.concat(t, F.lit("."))))[0]


def conservative(text: Column) -> Column:
    """The few wordings that are always tightened, and a final period."""
    out = clean_source(text)
    for regex, by, once in REWRITES:
        out = replaced(out, regex, by, once)
    return ended(out)


def distributed(text: Column) -> Column:
    across = text.rlike("(?is)" + pattern(r"\bDenmark\b.*\bIndia\b|\bIndia\b.*\bPoland\b|\bDK\b.*\bIN\b"))
    return finds(text, r"\bdistributed\b") | (finds(text, r"\binternational (?:project |engineering )?teams?\b") & across)


def for_requirement(text: Column, name: str) -> Column:
    """The guarded rewrite of one requirement; a text that does not ask for it stays as it is."""
    has = lambda rx: finds(text, rx)
    once = lambda rx, by: replaced(text, rx, by)
    rules = {
        "end_to_end": [(has("delivery lifecycle") & ~has("end[- ]to[- ]end"), once("delivery lifecycle", "end-to-end delivery lifecycle")), (has("full lifecycle") & ~has("end[- ]to[- ]end"), once("full lifecycle", "end-to-end lifecycle"))],
        "distributed": [(distributed(text) & has("international (project |engineering )?teams") & ~has("distributed"), F.regexp_replace(text, "(?is)^(.*?)(international (?:project |engineering )?teams)", "$1distributed $2"))],
        "release": [(has("release readiness for go-live"), once("release readiness for go-live", "release and go-live readiness")),
                    (has("release readiness") & has("go-live|RFS|production") & ~has("release and go-live readiness"), once("release readiness", "release and go-live readiness"))],
        "risk_dependency": [(has("risk,? dependenc(?:y|ies)"), once("risk,? dependenc(?:y|ies)", "risk and dependency management")), (has("delivery risks? and dependenc(?:y|ies)"), once("delivery risks? and dependenc(?:y|ies)", "delivery risk and dependency management"))],
        "integration": [(has(r"\b(managed|owned|resolved|handled|coordinated)\b") & has("integration") & has("dependenc") & ~has("integration dependency management"), once("integration[^,.;]*dependenc(?:y|ies)", "integration dependency management"))],
        "governance": [(has(r"\b(programme|program)\b") & has("delivery governance") & ~has("programme delivery governance"), once("delivery governance", "programme delivery governance")),
                       (has(r"\b(programme|program)\b") & has("backlog governance") & ~has("programme-level backlog governance"), once("backlog governance", "programme-level backlog governance"))],
        "regulatory": [(has("regulatory") & has("delivery|reporting|compliance") & ~has(r"regulated\s*/\s*regulatory"), once("regulatory", "regulated / regulatory"))],
        "agile": [(has("Agile/Hybrid execution"), once("Agile/Hybrid execution", "Agile/Hybrid delivery execution"))],
    }
    out = text
    for test, value in reversed(rules[name]):
        out = F.when(test, value).otherwise(out)
    return out


def bullet_changes(facts: DataFrame, keys: list[str], wanted: str = "wanted") -> DataFrame:
    """facts: keys, fact and wanted (requirements of the job that the CV supports). The facts whose wording changes: original, updated, requirements (labels applied).

    The rewrites follow one another in the order of the catalogue, each on what the last has left.
    """
    rows = fenced(facts.withColumns({"original": clean_source(F.col("fact")), "shown": requirements.shown_by(F.col("fact")), "tight": conservative(F.col("fact"))}))
    names = F.filter(F.array(*map(F.lit, LABELS)), lambda n: F.array_contains(wanted, n) & F.array_contains("shown", n))

    def step(done: Column, name: Column) -> Column:
        text = done["text"]
        chain = text
        for known in LABELS:
            chain = F.when(name == known, for_requirement(text, known)).otherwise(chain)
        # an array of one, so that the rewrite stands in the expression once
        return F.transform(F.array(chain), lambda after: F.struct(after.alias("text"), F.when(after != text, F.concat(done["applied"], F.array(name))).otherwise(done["applied"]).alias("applied")))[0]

    start = F.struct(F.col("tight").alias("text"), F.array().cast("array<string>").alias("applied"))
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))

    def finish(done: Column) -> Column:
        tidy = ended(F.trim(F.regexp_replace(F.regexp_replace(done["text"], r"\s+,", ","), r"\s+", " ")))
        return F.struct(tidy.alias("updated"), F.transform(done["applied"], lambda n: F.element_at(labels, n)).alias("requirements"))

    # fenced, or the filter below would make the change again
    out = fenced(rows.withColumn("change", F.aggregate(names, start, step, finish))).select(*keys, "original", "change.*")
    return out.where(F.col("updated") != ended(F.col("original")))


def first_where(array: Column, test) -> Column:
    """The index of the first element that passes, from 0; null if none does."""
    return F.nullif(F.array_position(F.transform(array, test), True), F.lit(0).cast("long")) - 1


def summary_of(text: Column) -> Column:
    """The summary of a CV text: the lines between its heading and the next stop heading (none without one), or the long lines of the header without contact details."""
    all_lines = lines(text)
    heading, stop = lambda x: F.lower(x).rlike(SUMMARY_HEADING), lambda x: F.lower(x).rlike(SUMMARY_STOP)
    at, first_stop = first_where(all_lines, heading), first_where(all_lines, stop)
    after = first_where(all_lines, lambda x, i: (i > at) & stop(x))
    joined = lambda part: clean_source(F.array_join(part, " "))
    inside = joined(F.slice(all_lines, (at + 2).cast("int"), (after - at - 1).cast("int")))
    header = F.slice(all_lines, F.lit(1), F.coalesce(first_stop, F.least(F.size(all_lines), F.lit(10)).cast("long")).cast("int"))
    loose = joined(F.filter(header, lambda x, i: (i >= 1) & (F.length(x) >= 55) & ~x.rlike("(?i)" + CONTACT)))
    return F.when(at.isNull(), loose).when(after.isNull() | (F.length(inside) < 40), "").otherwise(inside)


def sentences_of(summary: Column) -> Column:
    found = F.regexp_extract_all(clean_source(summary), F.lit("[^.!?]+[.!?]+|[^.!?]+$"), 0)
    return F.filter(F.transform(found, lambda s: F.trim(s)), lambda s: s != "")


def words_in(text: Column) -> Column:
    text = clean_source(text)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, r"\s+")))


def is_identity(sentence: Column) -> Column:
    return finds(sentence, IDENTITY_ROLE) & finds(sentence, IDENTITY_FIELD)


def identity_index(sentences: Column) -> Column:
    """The first sentence that names a role and years, else the first that names a role, else the first."""
    return F.coalesce(first_where(sentences, lambda s: is_identity(s) & finds(s, YEARS)), first_where(sentences, is_identity), F.lit(0).cast("long"))


def is_proof(sentence: Column) -> Column:
    out = F.lit(False)
    for regex in PROOF:
        out = out | finds(sentence, regex)
    return out


def candidate(sentence: Column, index: Column, required: Column, terms: Column) -> Column:
    """struct(i, score, words, proof, capable, reqs, terms, sentence) of a sentence against what a job requires and its terms."""
    reqs = F.array_intersect(requirements.shown_by(sentence), required)
    low = F.lower(sentence)
    own = F.filter(terms, lambda t: low.contains(t))
    base = F.size(reqs) * 5 + F.size(own) * 2 + F.when(is_proof(sentence), 4).otherwise(0)
    capable = finds(sentence, CAPABILITY)
    score = base + F.when(capable & (base > 0), 2).otherwise(0) - F.when(finds(sentence, RESPONSIBLE), 1).otherwise(0) - F.when(finds(sentence, SOFT) & (F.size(reqs) == 0), 2).otherwise(0)
    return F.struct(index.cast("int").alias("i"), score.alias("score"), words_in(sentence).alias("words"), is_proof(sentence).alias("proof"), capable.alias("capable"), reqs.alias("reqs"), own.alias("terms"), sentence.alias("sentence"))


class Pick:
    """A partial combination of candidates, with what its score is made of."""

    def __init__(self, own_words: int, picked: tuple = ()) -> None:
        self.picked, self.words = picked, own_words + sum(c["words"] for c in picked)
        self.reqs, self.terms = [r for c in picked for r in c["reqs"]], [t for c in picked for t in c["terms"]]
        self.proof = any(c["proof"] for c in picked)

    def score(self) -> float:
        kinds, words = len(set(self.reqs)), self.words
        bonus = 24 - abs(105 - words) * 0.35 if words >= 90 else -((90 - words) * 0.45)
        base = sum(c["score"] for c in self.picked) + kinds * 8 + len(set(self.terms)) * 2 + (4 if self.proof else 0) - (len(self.reqs) - kinds) * 2
        return base + bonus - max(0, len(self.picked) - 3) * 8

    def order(self) -> list[int]:
        return [c["i"] for c in self.picked]


def worth(c: dict) -> int:
    """The most that a candidate can add to a combination, but for its words and proof."""
    return c["score"] + 8 * len(set(c["reqs"])) + 2 * len(set(c["terms"]))


def best_combination(candidates: list[dict], own_words: int, least: int, proven: bool) -> list[dict] | None:
    """Of all combinations of ``least`` to four candidates within MOST_WORDS words (with proof, if ``proven``) the one with the greatest score, the first of equals in order of its sentences; None if there is none.

    Branch and bound: a branch is left when what its candidates could add at most does not reach the best score. Of candidates
    that count for the same only the first four are looked at, since the others could take part in no earlier combination.
    """
    alike: dict[tuple, int] = {}
    held = []
    for c in sorted(candidates, key=lambda c: c["i"]):
        kind = (c["score"], c["words"], c["proof"], tuple(sorted(c["reqs"])), tuple(sorted(c["terms"])))
        alike[kind] = alike.get(kind, 0) + 1
        if alike[kind] <= MOST_SENTENCES:
            held.append(c)
    # the most that n further candidates, from the k-th on, can add
    adds = [[0] * (MOST_SENTENCES + 1) for _ in range(len(held) + 1)]
    for k in range(len(held) - 1, -1, -1):
        for n in range(1, MOST_SENTENCES + 1):
            adds[k][n] = max(adds[k + 1][n], worth(held[k]) + adds[k + 1][n - 1])
    best: tuple | None = None

    def walk(k: int, now: Pick) -> None:
        nonlocal best
        n = len(now.picked)
        if n >= least and now.words <= MOST_WORDS and (now.proof or not proven):
            found = (-now.score(), now.order(), now.picked)
            best = min(best, found, key=lambda x: x[:2]) if best else found
        if n == MOST_SENTENCES or k == len(held):
            return
        so_far = sum(c["score"] for c in now.picked) + 8 * len(set(now.reqs)) + 2 * len(set(now.terms)) - 2 * (len(now.reqs) - len(set(now.reqs)))
        for j in range(k, len(held)):
            if best and so_far + adds[j][MOST_SENTENCES - n] + 4 + 24 < -best[0] - 1e-6:
                return  # and so for all candidates after it
            if now.words + held[j]["words"] <= MOST_WORDS:
                walk(j + 1, Pick(own_words, (*now.picked, held[j])))

    greatest = sorted(held, key=lambda c: (-worth(c), c["i"]))
    for n in range(1, MOST_SENTENCES + 1):  # a bound to begin with
        walk(len(held), Pick(own_words, tuple(sorted(greatest[:n], key=lambda c: c["i"]))))
    walk(0, Pick(own_words))
    return None if best is None else list(best[2])


def chosen_sentences(candidates: list[dict], own_words: int) -> list[int]:
    """The indices of the best combination: of two to four with proof, else of any with proof, else of any; proof is asked for where any candidate has it."""
    candidates = [{"i": c["i"], "score": c["score"], "words": c["words"], "proof": c["proof"], "reqs": list(c["reqs"]), "terms": list(c["terms"])} for c in candidates]
    proof = any(c["proof"] for c in candidates)
    for least, proven in ((min(2, len(candidates)), proof), (1, proof), (1, False)):
        if picked := best_combination(candidates, own_words, max(1, least), proven):
            return [c["i"] for c in picked]
    return []


@lru_cache(maxsize=MOST_AT_ONCE)
def all_combinations(n: int) -> np.ndarray:
    """The combinations of one to four of n places, in order; n stands for no further place."""
    found = sorted(c for k in range(1, MOST_SENTENCES + 1) for c in combinations(range(n), k))
    return np.array([(*c, *[n] * (MOST_SENTENCES - len(c))) for c in found])


def kinds_as_bits(lists: pa.Array, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The strings of each list as bits, which count within its row, and how many different strings each row has."""
    items, owner = pc.dictionary_encode(lists.flatten(), null_encoding="encode"), np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    size = max(1, len(items.dictionary))
    kinds, place = np.unique(row[owner] * size + items.indices.to_numpy(zero_copy_only=False), return_inverse=True)
    bit = np.arange(len(kinds)) - np.searchsorted(kinds // size, kinds // size)
    out = np.zeros(len(lists), np.uint64)
    np.bitwise_or.at(out, owner, np.uint64(1) << np.minimum(bit, 63)[place].astype(np.uint64))
    return out, np.bincount(kinds // size, minlength=rows)


def best_of_all(n: int, own_words: np.ndarray, c: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """chosen_sentences() of rows of n candidates, in order of their sentences: places (n for none), and whether there is any combination."""
    table = all_combinations(n)
    c = {k: np.concatenate([v, np.zeros((len(v), 1), v.dtype)], axis=1)[:, table] for k, v in c.items()}
    words, size = own_words[:, None] + c["words"].sum(axis=2), (table < n).sum(axis=1)
    kinds, terms = (np.bitwise_count(np.bitwise_or.reduce(c[k], axis=2)).astype(np.int64) for k in ("reqs", "terms"))
    proof = c["proof"].any(axis=2)
    bonus = np.where(words >= 90, 24 - np.abs(105 - words) * 0.35, -((90 - words) * 0.45))
    base = c["score"].sum(axis=2) + kinds * 8 + terms * 2 + np.where(proof, 4, 0) - (c["n_reqs"].sum(axis=2) - kinds) * 2
    score = base + bonus - np.maximum(0, size - 3) * 8
    fit = proof | ~proof.any(axis=1)[:, None]
    pool = np.where(words > MOST_WORDS, 3, np.where(fit, np.where(size >= min(2, n), 0, 1), 2))
    first = pool.min(axis=1)
    return table[np.where(pool == first[:, None], score, -np.inf).argmax(axis=1)], first < 3


def chosen_in_batch(candidates: pa.Array, own_words: pa.Array) -> pa.Array:
    """chosen_sentences() of each row. Rows of few candidates are looked at together, all combinations of each; the others, and rows with nulls, one by one."""
    rows = len(candidates)
    n = pc.fill_null(pc.list_value_length(candidates), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    structs, row = candidates.flatten(), np.repeat(np.arange(rows), n)
    held = {f.name: col for f, col in zip(structs.type, structs.flatten(), strict=True)}
    odd = np.isin(np.arange(rows), row[pc.is_null(structs).to_numpy(zero_copy_only=False)]) | pc.is_null(own_words).to_numpy(zero_copy_only=False) | pc.is_null(candidates).to_numpy(zero_copy_only=False)
    for name in ("i", "score", "words", "proof", "reqs", "terms"):
        odd[row[pc.is_null(held[name]).to_numpy(zero_copy_only=False)]] = True
    flat = {k: pc.fill_null(held[k], 0).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("i", "score", "words")} | {"proof": pc.fill_null(held["proof"], False).to_numpy(zero_copy_only=False)}
    flat["n_reqs"] = pc.fill_null(pc.list_value_length(held["reqs"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for name in ("reqs", "terms"):
        flat[name], kinds = kinds_as_bits(held[name], row, rows)
        odd |= kinds > 64
    order = np.lexsort((flat["i"], row))
    flat = {k: v[order] for k, v in flat.items()}
    odd[row[1:][(row[1:] == row[:-1]) & (flat["i"][1:] == flat["i"][:-1])]] = True
    out: list[list[int]] = [[] for _ in range(rows)]
    start, words = np.cumsum(n) - n, pc.fill_null(own_words, 0).to_numpy(zero_copy_only=False).astype(np.int64)
    for size in range(1, MOST_AT_ONCE + 1):
        alike = np.flatnonzero((n == size) & ~odd)
        for some in np.array_split(alike, -(-len(alike) // 1_000)) if len(alike) else []:
            c = {k: v[start[some][:, None] + np.arange(size)] for k, v in flat.items()}
            places, there = best_of_all(size, words[some], c)
            named = np.take_along_axis(np.concatenate([c["i"], np.full((len(some), 1), -1)], axis=1), places, axis=1)
            for at, picked, many, any_ in zip(some.tolist(), named.tolist(), (places < size).sum(axis=1).tolist(), there.tolist(), strict=True):
                out[at] = picked[:many] if any_ else []
    for at in np.flatnonzero(odd | (n > MOST_AT_ONCE)).tolist():
        out[at] = chosen_sentences(list(candidates[at].as_py()), int(own_words[at].as_py()))
    return pa.array(out, pa.list_(pa.int32()))


def picked_sentences(candidates: Column, own_words: Column) -> Column:
    return F.arrow_udf(chosen_in_batch, "array<int>")(candidates, own_words)


def tailored_summaries(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows: keys, summary, jd. keys, original, updated, requirements (labels): the summary shortened to its identity sentence and the best combination of others.

    Combinations of two to four sentences within 120 words come first, with proof where there is any; then
    those of one to four; the first of equals in order of their sentences. No sentence is rewritten.
    """
    out = rows.withColumns({"sentences": sentences_of(F.col("summary")), "required": requirements.required_of(F.col("jd")), "job_terms": evidence.review_terms(F.coalesce("jd", F.lit("")))})
    out = out.where(F.size("sentences") > 0).withColumn("at", identity_index(F.col("sentences")))
    out = out.withColumn("identity", F.get("sentences", F.col("at").cast("int")))
    out = out.withColumn("cands", F.transform("sentences", lambda s, i: candidate(s, i, F.col("required"), F.col("job_terms"))))
    out = out.withColumn("cands", F.filter("cands", lambda c: (c["i"] != F.col("at")) & (c["score"] > 0)))
    out = out.withColumn("own_words", words_in(F.col("identity")))
    out = fenced(out.withColumn("_at", picked_sentences(F.transform("cands", lambda c: c.dropFields("sentence", "capable")), F.col("own_words"))))
    out = out.withColumn("picked", F.filter("cands", lambda c: F.array_contains("_at", c["i"])))
    ranked = F.transform(F.coalesce("picked", F.array().cast(out.schema["cands"].dataType)), lambda x: F.struct((~x["capable"]).alias("a"), (~x["proof"]).alias("b"), (-x["score"]).alias("c"), x["i"].alias("d"), x["sentence"].alias("s")))
    chosen = F.concat(F.array("identity"), F.transform(F.array_sort(ranked), lambda x: x["s"]))
    out = out.withColumns({"updated": clean_source(F.array_join(chosen, " ")), "original": clean_source(F.col("summary"))})
    named = F.filter("required", lambda r: F.array_contains(requirements.shown_by(F.col("updated")), r))
    labels = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    out = out.withColumn("requirements", F.slice(F.transform(named, lambda r: F.element_at(labels, r)), 1, 4))
    return out.where((F.col("updated") != "") & (F.col("updated") != F.col("original"))).select(*keys, "original", "updated", "requirements")
