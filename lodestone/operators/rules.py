"""Discovery gates and the chain of hard exclusions, over a relation of features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions.automaton import categories_of, frozen
from lodestone.functions.text import collapsed, contains_any, count_contained, matches, normal, sentences, term_count
from lodestone.operators.observed import fenced


def with_features(jobs: DataFrame) -> DataFrame:
    """Normalised texts and category names, each computed once for everything downstream."""
    jobs = jobs.withColumns({
        "title_n": normal(F.col("title")), "body_n": normal(F.col("description")),
        "text_n": normal(F.concat_ws(" ", "title", "description")),
    })
    whole = categories_of(F.col("text_n"), frozen(responsibilities=L.RESPONSIBILITY, technologies=L.TECHNOLOGY, evidence=L.EVIDENCE))
    body = categories_of(F.col("body_n"), frozen(technologies=L.TECHNOLOGY))
    jobs = fenced(jobs.withColumns({"_whole": whole, "_body": body}))
    return jobs.select("*", "_whole.*", F.col("_body.technologies").alias("body_technologies")).drop("_whole", "_body")


def discovered(title: Column, description: Column, ready: bool = False) -> Column:
    """A title signal, or at least two technology words and two ownership words in the description; ``ready`` texts are collapsed."""
    title, body = (title, description) if ready else (collapsed(title), collapsed(description))
    lower = lambda words: [w.lower() for w in words]
    by_title = contains_any(title, dict.fromkeys(lower(L.DISCOVERY_TITLES)))
    by_body = (count_contained(body, lower(L.TECHNOLOGY_SIGNALS)) >= 2) & (count_contained(body, lower(L.OWNERSHIP_SIGNALS)) >= 2)
    return by_title | by_body


def with_gate(jobs: DataFrame) -> DataFrame:
    """Rows with discovered(). The collapsed texts are made once a row below a fence: drawn into the gate, they would be made again for each word."""
    jobs = fenced(jobs.withColumns({"_title": collapsed(F.col("title")), "_body": collapsed(F.col("description"))}))
    return jobs.withColumn("discovered", discovered(F.col("_title"), F.col("_body"), ready=True)).drop("_title", "_body")


def discovered_by_categories(title: Column, technologies: Column, responsibilities: Column) -> Column:
    """The gate of the web policy: categories are counted instead of words."""
    by_title = contains_any(collapsed(title), dict.fromkeys(w.lower() for w in L.DISCOVERY_TITLES))
    return by_title | ((F.size(technologies) >= 2) & (F.size(responsibilities) >= 2))


def mandatory_language(text: Column) -> Column:
    """Some sentence requires the language and does not say that it is optional."""

    def demands(sentence: Column) -> Column:
        s = normal(sentence)
        return matches(s, L.LANGUAGE) & ~matches(s, L.LANGUAGE_OPTIONAL) & matches(s, *L.LANGUAGE_REQUIRED)

    # most texts never name the language: the sentences are split only where they do
    return F.when(matches(F.lower(text), "danish|dansk"), F.exists(sentences(text), demands)).otherwise(F.lit(False))


def construction_primary() -> Column:
    return matches(F.col("text_n"), *L.CONSTRUCTION) & (~matches(F.col("text_n"), L.CONSTRUCTION_CORPORATE_IT) | (F.size("technologies") <= 1))


def research_primary() -> Column:
    terms = (term_count(F.col("body_n"), L.RESEARCH_TERMS) >= 2) & (F.size("body_technologies") <= 1)
    by_text = matches(F.col("title_n"), L.RESEARCH_TITLE) | matches(F.col("body_n"), *L.RESEARCH_BODY)
    return (by_text | terms) & ~matches(F.col("body_n"), L.RESEARCH_CORPORATE_IT)


def exclusion_rule() -> Column:
    """The name of the first rule that excludes a row of with_features(), or null. The order is part of the meaning."""
    few_tech, few_duties = F.size("technologies") <= 1, F.size("responsibilities") <= 2
    rules = {
        "unverified": ~F.col("full_jd_verified"),
        "closed": F.col("vacancy_status") == "CLOSED",
        "language": mandatory_language(F.concat_ws("\n", "title", "description")),
        "remote": (F.col("remote_type") == "remote") & (F.col("remote_eligibility") == "DENMARK EXCLUDED"),
        "junior": matches(F.col("title_n"), L.JUNIOR_TITLE) & ~matches(F.col("title_n"), L.LEADING_TITLE),
        "construction": construction_primary(),
        "research": research_primary(),
        "marketing": matches(F.col("text_n"), L.MARKETING) & few_tech,
        "retail": matches(F.col("text_n"), L.RETAIL) & few_tech,
        "no_ownership": matches(F.col("text_n"), *L.NO_OWNERSHIP),
        "support": (term_count(F.col("text_n"), L.SUPPORT_TERMS) >= 2) & few_duties,
        "coordination": (term_count(F.col("text_n"), L.COORDINATION_TERMS) >= 2) & few_duties,
        "no_evidence": F.size("responsibilities") == 0,
    }
    chain = None
    for name, rule in rules.items():
        chain = F.when(rule, name) if chain is None else chain.when(rule, name)
    return chain


def reason(rule: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in L.REASONS.items() for x in pair)), rule)


def fresh(published: Column, now: Column, days: int, grace_hours: float, null_passes: bool = True) -> Column:
    """Published within ``days`` and the policy's grace; a missing date passes or not, by policy."""
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(published.cast("timestamp"))) / 3600.0
    return F.coalesce(age <= days * 24 + grace_hours, F.lit(null_passes))
