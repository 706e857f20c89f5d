"""CV lines, evidence, grounding and change checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import lines, matches

# Words that mark a line as evidence, and the vocabulary of a review.
ACTIONS = r"\b(managed|led|delivered|owned|drove|implemented)\b"
FACT_ACTIONS = r"\b(led|managed|delivered|owned|drove|coordinated|implemented|built|launched|improved|reduced|created|supported|developed|oversaw|directed|governed|planned|executed|established|introduced|worked|responsible|lead|manage|deliver|drive|coordinate|implement|build|launch|improve|reduce|create|support|develop|oversee|direct|govern|plan|execute|establish|introduce)\b"
FACT_SIGNALS = r"\b(project|program|programme|delivery|software|platform|digital|fintech|bank|banking|trading|post-trade|regulatory|compliance|risk|data|analytics|bi|stakeholder|budget|roadmap|release|cutover|hypercare|uat|sit|agile|scrum|safe|azure|jira|confluence|sql|power bi|team|engineering)\b"
COMPLETE_ACTIONS = r"\b(led|managed|delivered|owned|drove|implemented|built|launched|improved|reduced|created|supported|developed|oversaw|planned|executed|established|introduced|collaborated|experience|experienced|worked|responsible)\b"
DANGLING = r"\b(and|with|a|an|the|to|for|of|in|across|through|including)\s*[,;:]?$"
YEAR = r"\b(19|20)\d{2}\b"
VOCABULARY = (
    "delivery", "software", "platform", "project", "program", "programme", "implementation", "integration", "transformation",
    "fintech", "banking", "regulatory", "compliance", "risk", "governance", "stakeholder", "release", "cutover", "uat", "agile",
    "azure", "data", "engineering", "migration", "cloud",
)
INSTRUCTION_LIKE = (
    r"\b(ignore|disregard|forget)\b.{0,50}\b(previous|prior|above|system|developer|instructions?|rules?)\b",
    r"\b(system|developer)\s+(message|prompt)\b",
    r"\bdo\s+not\s+follow\b.{0,40}\binstructions?\b",
    r"\bclaim\b.{0,30}\bexpertise\b",
)
BULLETS = r"^[•\-–—▪◦*]+\s*"


def clean_source(text: Column) -> Column:
    """A line without its bullet, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), BULLETS, ""), r"\s+", " "))


def fact_lines(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, line, useful, number: the lines of 24 to 420 characters that name an action, a signal or a year, once each, numbered from 1.

    Where a text has fewer than eight of those, its other lines of 30 to 350 characters follow, up to thirty in all.
    """
    line = F.trim(F.regexp_replace("line", BULLETS, ""))
    out = rows.select(key, F.posexplode(lines(F.col(text))).alias("at", "line")).withColumn("line", line)
    useful = matches(F.lower("line"), FACT_ACTIONS, FACT_SIGNALS, YEAR)
    out = out.where(F.length("line").between(24, 420)).withColumn("useful", useful).where(F.col("useful") | F.length("line").between(30, 350))
    first = out.groupBy(key, F.lower("line").alias("_lower")).agg(F.min(F.struct("at", "line", "useful")).alias("_first")).select(key, "_first.*")
    by_use = Window.partitionBy(key).orderBy(F.desc("useful"), "at")
    first = first.withColumns({"number": F.row_number().over(by_use), "_n": F.count_if("useful").over(Window.partitionBy(key))})
    return first.where(F.col("useful") | ((F.col("_n") < 8) & (F.col("number") <= 30))).drop("_n")


def numbered(facts: DataFrame, key: str, most: int = 80) -> DataFrame:
    return facts.where(F.col("number") <= most).withColumn("fact_id", F.concat(F.lit("FACT-"), F.lpad(F.col("number").cast("string"), 3, "0")))


def review_terms(text: Column) -> Column:
    lowered = F.lower(text)
    return F.array_compact(F.array(*(F.when(matches(lowered, rf"\b{w}\b"), w) for w in VOCABULARY)))


def relevance(fact: Column, terms: Column) -> Column:
    """Two for each term in the fact, one for an action."""
    text = F.lower(clean_source(fact))
    return F.size(F.filter(terms, lambda t: text.contains(t))) * 2 + F.when(matches(text, ACTIONS), 1).otherwise(0)


def complete(fact: Column) -> Column:
    """Whether a fact stands alone: 42 to 360 characters, an action, and no dangling word at its end."""
    text = clean_source(fact)
    low = F.lower(text)
    return F.length(text).between(42, 360) & ~matches(low, DANGLING) & matches(low, COMPLETE_ACTIONS)


def top_evidence(facts: DataFrame, key: str, most: int = 6) -> DataFrame:
    """facts: key, at, fact, relevance. The most relevant facts of a key; equals stay in order.

    They come from the complete facts where a key has three of them, else from those of more than 35 characters.
    """
    rows = facts.withColumns({"_complete": complete(F.col("fact")), "_long": F.length(clean_source(F.col("fact"))) > 35})
    rows = rows.withColumn("_n", F.count_if("_complete").over(Window.partitionBy(key)))
    rows = rows.where(F.when(F.col("_n") >= 3, F.col("_complete")).otherwise(F.col("_long")))
    best = Window.partitionBy(key).orderBy(F.desc("relevance"), "at")
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most).drop("_complete", "_long", "_n")


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9][a-z0-9+.#/-]{2,}"), 0))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def meaningful_change(original: Column, updated: Column, jd: Column) -> Column:
    """Not too short or long, and either different enough or with two new words of the job description."""
    n, m = F.length(original), F.length(updated)
    sized = (n > 0) & (m > 0) & (original != updated) & (m >= F.greatest(F.lit(35.0), n * 0.55)) & (m <= n * 1.8)
    a, b = word_set(original), word_set(updated)
    wanted = F.filter(word_set(jd), lambda w: F.length(w) > 4)
    return sized & ((jaccard(a, b) < 0.88) | (F.size(F.array_intersect(F.array_except(b, a), wanted)) >= 2))


def claims(text: Column) -> Column:
    """Numbers and acronyms, which a rewrite may not add."""
    numbers = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[0-9]+(?:[.,][0-9]+)?(?![A-Za-z0-9_])"), 0)
    acronyms = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][A-Z0-9+&/-]{2,}(?![A-Za-z0-9_])"), 0)
    return F.array_distinct(F.concat(numbers, acronyms))


def claims_supported(updated: Column, source: Column) -> Column:
    lowered = F.lower(source)
    return F.forall(claims(updated), lambda t: lowered.contains(F.lower(t)))


def evidence_normal(text: Column) -> Column:
    """Quotes and dashes folded, invisible characters dropped, white space collapsed, lower case. NFKC is left to the landing step."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), "[­​-‍﻿]", "")
    out = F.regexp_replace(F.regexp_replace(out, "[“”]", '"'), "[‘’]", "'")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(out, "[–—]", "-"), r"\s+", " ")))


def grounded(excerpt: Column, source: Column) -> Column:
    """ok, unsafe (reads like an instruction), or missing from the source."""
    found = (evidence_normal(excerpt) != "") & evidence_normal(source).contains(evidence_normal(excerpt))
    return F.when(matches(F.lower(excerpt), *INSTRUCTION_LIKE), "unsafe").when(found, "ok").otherwise("missing")
