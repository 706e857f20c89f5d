"""The web policy of the search: its own texts, categories, exclusion chain, caps and order; no history.

Punctuation stays in the text that patterns see (dashes folded, case and white space too), support and
coordination words are counted as often as they occur, and a posting whose title and body pass the
category gate is scored by the web's wording: finance terms anywhere in the text, whole words of seniority in the title,
and a country that contains the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions.automaton import categories_of, frozen
from lodestone.functions.text import clean_html_lines, contains_any, folded_dashes, matches, pattern
from lodestone.operators import rules, score
from lodestone.operators.observed import fenced

RESPONSIBILITY = L.RESPONSIBILITY | {"end_to_end": [L.WEB_END_TO_END, *L.RESPONSIBILITY["end_to_end"][1:]]}
MOST_DETAILS, MOST_RESULTS, LEAST_CV = 24, 10, 100


def web_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(folded_dashes(clean_html_lines(text)), r"\s+", " "))


WORDING = score.Wording(
    text=web_text,
    finance=lambda: contains_any(F.col("text_n"), L.WEB_FINANCE_TERMS) | matches(F.lower(F.concat_ws(" ", "title", "description")), L.REGULATED),
    senior=lambda title: matches(title, L.WEB_SENIOR), manager=lambda title: matches(title, L.WEB_MANAGER),
    at_home=lambda country: contains_any(web_text(country), L.COUNTRY), cv_name="Source CV")


def with_features(jobs: DataFrame) -> DataFrame:
    jobs = jobs.withColumns({"title_n": web_text(F.col("title")), "body_n": web_text(F.col("description")), "text_n": web_text(F.concat_ws(" ", "title", "description"))})
    whole = categories_of(F.col("text_n"), frozen(responsibilities=RESPONSIBILITY, technologies=L.TECHNOLOGY, evidence=L.EVIDENCE))
    body = categories_of(F.col("body_n"), frozen(technologies=L.TECHNOLOGY, responsibilities=RESPONSIBILITY))
    jobs = fenced(jobs.withColumns({"_whole": whole, "_body": body}))
    return jobs.select("*", "_whole.*", *(F.col(f"_body.{c}").alias(f"body_{c}") for c in ("technologies", "responsibilities"))).drop("_whole", "_body")


def exclusion_rule() -> Column:
    """The name of the first rule that excludes a row of with_features(), or null."""
    few_tech, few_duties = F.size("technologies") <= 1, F.size("responsibilities") <= 2
    research = (matches(F.col("title_n"), L.RESEARCH_TITLE) | (matches(F.col("body_n"), *L.RESEARCH_BODY) & (F.size("body_technologies") <= 1))) & ~matches(F.col("body_n"), L.RESEARCH_CORPORATE_IT)
    often = lambda regex: F.regexp_count(F.col("text_n"), F.lit(pattern(regex)))
    chain = [
        ("unverified", ~F.col("full_jd_verified")), ("closed", F.col("vacancy_status") == "CLOSED"), ("language", rules.mandatory_language(F.concat_ws("\n", "title", "description"))),
        ("remote", (F.col("remote_type") == "remote") & (F.col("remote_eligibility") == "DENMARK EXCLUDED")), ("junior", matches(F.col("title_n"), L.JUNIOR_TITLE) & ~matches(F.col("title_n"), L.LEADING_TITLE)),
        ("construction", rules.construction_primary()), ("research", research), ("marketing", matches(F.col("text_n"), L.MARKETING) & few_tech), ("retail", matches(F.col("text_n"), L.RETAIL) & few_tech),
        ("no_ownership", matches(F.col("text_n"), *L.NO_OWNERSHIP)), ("support", few_duties & (often(L.WEB_SUPPORT) >= 2)), ("coordination", few_duties & (often(L.WEB_COORDINATION) >= 2)), ("no_evidence", F.size("responsibilities") == 0)]
    out = F.lit(None).cast("string")
    for name, test in reversed(chain):
        out = F.when(test, name).otherwise(out)
    return out


def capped(rows: DataFrame, most: int = MOST_DETAILS) -> DataFrame:
    """Search rows (job_id, published, pos): the first of each id, then the newest ``most``."""
    first = rows.groupBy("job_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c != "job_id")), "pos").alias("_r")).select("job_id", "_r.*")
    return first.orderBy(F.col("published").desc_nulls_last(), "pos").limit(most)


def evaluated(jobs: DataFrame, cv: str, days: int, now: int) -> DataFrame:
    """Postings past the gate with rule, scores, match and gaps; an excluded one scores zero. Fresh within six hours' grace; a missing date passes."""
    if len(cv.strip()) < LEAST_CV:
        raise ValueError("Source CV text is required for evaluation.")
    kept = with_features(jobs.where(F.coalesce(F.col("published_at") >= now - days * 86400 - 21600, F.lit(True))))
    found = contains_any(F.col("title_n"), dict.fromkeys(w.lower() for w in L.DISCOVERY_TITLES)) | ((F.size("body_technologies") >= 2) & (F.size("body_responsibilities") >= 2))
    kept = fenced(kept.withColumns({"found": found, "rule": exclusion_rule()})).where("found").withColumn("reason", rules.reason(F.col("rule")))
    out = fenced(score.match_and_gaps(score.with_scores(kept, cv, WORDING), WORDING))
    gone = F.col("rule").isNotNull()
    out = out.withColumns({c: F.when(gone, 0).otherwise(F.col(c)) for c in ("responsibility", "experience", "geography", "career", "total")})
    return out.withColumns({"verdict": score.verdict(F.col("total"), 1), "action": score.verdict(F.col("total"), 2)})


def best(judged: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """The best ``most`` of evaluated(): score, then newest, then first to arrive."""
    return judged.where("rule IS NULL AND verdict <> 'Poor fit'").orderBy(F.desc("total"), F.col("published_at").desc_nulls_last(), "pos").limit(most)


def ranked(jobs: DataFrame, cv: str, days: int, now: int, most: int = MOST_RESULTS) -> DataFrame:
    return best(evaluated(jobs, cv, days, now), most)


def first_capped(rows: DataFrame, most: int = 80) -> DataFrame:
    """The service's cap: the last row of each id counts, in the order in which ids first came."""
    value = F.struct(*(c for c in rows.columns if c not in ("job_id", "pos")))
    last = rows.groupBy("job_id").agg(F.max_by(value, "pos").alias("_r"), F.min("pos").alias("pos"))
    return last.orderBy("pos").limit(most).select("job_id", "_r.*", "pos")
