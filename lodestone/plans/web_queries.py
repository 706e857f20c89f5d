"""Queries of the web policy and of match notes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.operators import rules, score
from lodestone.plans import duck, search, web
from lodestone.plans.queries import (_CAPITAL, _CV, _MANDATORY, _NAMES, _PEOPLE, _PLACE, _PREFERRED, _RESPONSIBILITY, _SALARY, _STAGED, _SURE, _TITLES, DUCK_POSTINGS, PLAN, _duck_lines,
                                     query)
from lodestone.sources.postings import CV, NOW, postings


def _web(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(lower({_duck_lines(x)}), '[–—]', '-', 'g'), '\\s+', ' ', 'g'))"


_RULE = duck.cases([
    ("NOT full_jd_verified", "'unverified'"), ("vacancy_status = 'CLOSED'", "'closed'"), (_MANDATORY, "'language'"), ("remote_type = 'remote' AND remote_eligibility = 'DENMARK EXCLUDED'", "'remote'"),
    (f"{duck.matches('title_n', L.JUNIOR_TITLE)} AND NOT {duck.matches('title_n', L.LEADING_TITLE)}", "'junior'"),
    (f"{duck.matches('text_n', *L.CONSTRUCTION)} AND (NOT {duck.matches('text_n', L.CONSTRUCTION_CORPORATE_IT)} OR len(technologies) <= 1)", "'construction'"),
    (f"({duck.matches('title_n', L.RESEARCH_TITLE)} OR ({duck.matches('body_n', *L.RESEARCH_BODY)} AND len(body_technologies) <= 1)) AND NOT {duck.matches('body_n', L.RESEARCH_CORPORATE_IT)}", "'research'"),
    (f"{duck.matches('text_n', L.MARKETING)} AND len(technologies) <= 1", "'marketing'"), (f"{duck.matches('text_n', L.RETAIL)} AND len(technologies) <= 1", "'retail'"), (duck.matches("text_n", *L.NO_OWNERSHIP), "'no_ownership'"),
    (f"len(responsibilities) <= 2 AND len(regexp_extract_all(text_n, {duck.text(L.WEB_SUPPORT)})) >= 2", "'support'"),
    (f"len(responsibilities) <= 2 AND len(regexp_extract_all(text_n, {duck.text(L.WEB_COORDINATION)})) >= 2", "'coordination'"), ("len(responsibilities) = 0", "'no_evidence'")])
_FEATURES = f"""WITH jobs AS ({DUCK_POSTINGS}), normed AS (SELECT *, {_web('title')} AS title_n, {_web('description')} AS body_n, {_web("title || ' ' || description")} AS text_n FROM jobs),
features AS (SELECT *, {duck.categories('text_n', web.RESPONSIBILITY)} AS responsibilities, {duck.categories('text_n', L.TECHNOLOGY)} AS technologies, {duck.categories('body_n', L.TECHNOLOGY)} AS body_technologies,
  {duck.categories('body_n', web.RESPONSIBILITY)} AS body_responsibilities, {duck.categories('text_n', L.EVIDENCE)} AS evidence FROM normed),
ruled AS (SELECT *, {_RULE} AS rule, {duck.contains_any('title_n', _TITLES)} OR (len(body_technologies) >= 2 AND len(body_responsibilities) >= 2) AS found FROM features)"""


@query("exclusion_reason_web", f"{_FEATURES} SELECT pos, rule, found FROM ruled")
def exclusion_reason_web(spark, sf_dir):
    rows = web.with_features(postings(spark, sf_dir))
    found = rules.contains_any(F.col("title_n"), _TITLES) | ((F.size("body_technologies") >= 2) & (F.size("body_responsibilities") >= 2))
    return rows.select("pos", web.exclusion_rule().alias("rule"), found.alias("found"))


_WEB_FINANCE = f"({duck.contains_any('text_n', L.WEB_FINANCE_TERMS)} OR {duck.matches("lower(title || ' ' || description)", L.REGULATED)})"
_WEB_SENIOR, _WEB_MANAGER = duck.matches("title_n", L.WEB_SENIOR), duck.matches("title_n", L.WEB_MANAGER)
_WEB_PLACE, _WEB_COUNTRY = _web("coalesce(location, '')"), _web("coalesce(country, '')")
_WEB_PREFERRED, _WEB_CAPITAL = duck.contains_any(_WEB_PLACE, [p.lower() for p in L.PREFERRED_LOCATIONS]), duck.contains_any(_WEB_PLACE, L.CAPITAL_REGION)
_WEB_HOME = f"({duck.contains_any(_WEB_PLACE, L.COUNTRY)} OR {duck.contains_any(_WEB_COUNTRY, L.COUNTRY)})"
_WEB_CV = duck.categories(_web(duck.text(CV)), L.EVIDENCE)
_WEB_SHARED = f"list_filter(evidence, lambda e: list_contains({_WEB_CV}, e))"
_WEB_EXPERIENCE = f"""CAST(floor((least(1000, 200 + least(500, 58 * len({_WEB_SHARED})) + least(160, 32 * len(technologies))
  + CASE WHEN {_WEB_FINANCE} AND (list_contains({_WEB_CV}, 'financial') OR list_contains({_WEB_CV}, 'regulatory')) THEN 110 ELSE 0 END) + 5) / 10.0) AS INT)"""
_WEB_GEOGRAPHY = duck.cases([
    ("remote_type = 'remote' AND remote_eligibility = 'DENMARK CONFIRMED'", "100"), ("remote_type = 'remote' AND remote_eligibility = 'UNVERIFIED'", "50"), (f"{_WEB_PREFERRED} AND remote_type = 'hybrid'", "100"), (_WEB_PREFERRED, "90"),
    (f"{_WEB_CAPITAL} AND remote_type = 'hybrid'", "80"), (f"{_WEB_CAPITAL} AND remote_type = 'onsite'", "55"), (_WEB_CAPITAL, "70"), (_WEB_HOME, "50")], "20")
_WEB_CAREER = f"""greatest(0, least(100, 55 + CASE WHEN {_WEB_SENIOR} THEN 15 WHEN {_WEB_MANAGER} THEN 5 ELSE 0 END
  - CASE WHEN {_PEOPLE} >= 2 THEN 20 ELSE 0 END - CASE WHEN {duck.matches('body_n', L.SELECTED_ONLY)} AND {duck.matches('body_n', L.PORTFOLIO)} THEN 7 ELSE 0 END + {_SALARY}))"""
_WEB_TOTALS = f"""{_FEATURES}, scored AS (SELECT *, {_RESPONSIBILITY} AS responsibility, {_WEB_EXPERIENCE} AS experience, {_WEB_GEOGRAPHY} AS geography, {_WEB_CAREER} AS career FROM ruled
  WHERE found AND coalesce(published_at >= {NOW - 7 * 86400 - 21600}, true)),
totals AS (SELECT *, CASE WHEN rule IS NULL THEN CAST(floor((40 * responsibility + 25 * experience + 20 * geography + 15 * career + 50) / 100.0) AS INT) ELSE 0 END AS total FROM scored)"""


@query("final_rank_web", f"{_WEB_TOTALS} SELECT pos, total / 10.0::DOUBLE AS score FROM totals WHERE total >= 60 ORDER BY total DESC, published_at DESC NULLS LAST, pos LIMIT 10")
def final_rank_web(spark, sf_dir):
    return web.ranked(postings(spark, sf_dir), CV, 7, NOW).select("pos", score.points(F.col("total")).alias("score"))


@query("detail_cap_web", """SELECT job_id, pos FROM (SELECT doc_id % 5000 AS job_id, doc_id AS pos, n_chars AS published FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 5000 ORDER BY doc_id) = 1) ORDER BY published DESC NULLS LAST, pos LIMIT 24""")
def detail_cap_web(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return web.capped(docs.select((F.col("doc_id") % 5000).alias("job_id"), F.col("doc_id").alias("pos"), F.col("n_chars").alias("published"))).select("job_id", "pos")


@query("detail_cap_svc", """SELECT doc_id % 5000 AS job_id, min(doc_id) AS pos, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1 ORDER BY pos LIMIT 80""")
def detail_cap_svc(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return web.first_capped(docs.select((F.col("doc_id") % 5000).alias("job_id"), F.col("doc_id").alias("pos"), "n_chars"))


_HUNDREDTHS = _RESPONSIBILITY.split("floor((")[1].rsplit(" + 5) / 10.0)", 1)[0]
_SHARED = f"list_filter(evidence, lambda e: list_contains({_CV}, e))"
_FINANCE = f"({duck.term_count('text_n', L.FINANCE_TERMS)} > 0 OR {duck.matches('text_n', L.REGULATED)})"
_HOME = f"({duck.contains_any(_PLACE, L.COUNTRY)} OR {duck.normal('country')} IN ('denmark', 'danmark'))"
_UNKNOWN = "salary_min IS NULL AND salary_max IS NULL"


def _notes(cv_name: str, shared: str, finance: str, preferred: str, capital: str, home: str, senior: str) -> tuple[str, str]:
    """Match and gaps as DuckDB expressions: the first four and three of the notes that apply, in order."""
    named = ", ".join(f"CASE WHEN list_contains({shared}, {duck.text(k)}) THEN {duck.text(v)} END" for k, v in L.EVIDENCE_NAMES.items())
    confirmed, unverified = (f"remote_type = 'remote' AND remote_eligibility = '{x}'" for x in ("DENMARK CONFIRMED", "UNVERIFIED"))
    match = [
        f"CASE WHEN len(responsibilities) > 0 THEN 'Delivery evidence: ' || array_to_string(list_filter([{_NAMES}], lambda c: c IS NOT NULL)[1:6], ', ') END", f"CASE WHEN {finance} THEN 'Financial IT / regulated-domain priority match' END",
        f"CASE WHEN len({shared}) > 0 THEN 'JD ↔ {cv_name} evidence: ' || array_to_string(list_filter([{named}], lambda c: c IS NOT NULL)[1:6], ', ') END",
        duck.cases([(confirmed, "'Remote employment from Denmark is explicitly supported'"), (unverified, "NULL"), (f"{preferred} AND remote_type = 'hybrid'", "'Preferred geography + hybrid'"), (preferred, "'Preferred geographic corridor'"),
                    (f"{capital} AND remote_type = 'hybrid'", "'Copenhagen / Capital Region hybrid'"), (f"{capital} AND remote_type <> 'onsite'", "'Copenhagen / Capital Region; work model not verified'")]),
        f"CASE WHEN {senior} THEN 'Senior/lead positioning is preserved' END",
        duck.cases([(_UNKNOWN, "NULL"), (f"employment_type = 'contract' AND {_SURE} >= 80000", "'Contract compensation has a clear premium'"), ("employment_type = 'contract'", "NULL"), ("salary_min >= 80000", "'Salary floor is at/above preferred level'"),
                    ("salary_min >= 75000", "'Salary floor is within acceptable range'")])]
    gaps = [
        f"CASE WHEN {_HUNDREDTHS} < 700 THEN 'Delivery ownership is weaker than the target profile' END", f"CASE WHEN len({shared}) = 0 THEN 'Direct JD ↔ {cv_name} evidence overlap is limited' END",
        "CASE WHEN len(technologies) = 0 THEN 'Technology/digital scope is not explicit in the JD' END",
        duck.cases([(confirmed, "NULL"), (unverified, "'REMOTE ELIGIBILITY — UNVERIFIED'"), (preferred, "NULL"), (f"{capital} AND remote_type = 'onsite'", "'Central Copenhagen onsite attendance may be unattractive'"), (capital, "NULL"),
                    (home, "'Location is in Denmark but outside the preferred corridor'")], "'Location is outside the target Denmark geography'"),
        f"CASE WHEN {_PEOPLE} >= 2 THEN 'Role carries substantial people-management responsibility relative to hands-on delivery' END",
        f"CASE WHEN {duck.matches('body_n', L.SELECTED_ONLY)} AND {duck.matches('body_n', L.PORTFOLIO)} THEN 'Direct project ownership appears limited to selected initiatives' END",
        duck.cases([(_UNKNOWN, "'Compensation: Insufficient data'"), (f"employment_type = 'contract' AND {_SURE} < 80000", "'Contract compensation premium is not evidenced'"), ("employment_type = 'contract'", "NULL"), ("salary_min >= 75000", "NULL"),
                    ("salary_min < 75000 AND salary_max >= 75000", "'Salary range overlaps the acceptable level but starts below it'"), (f"{_SURE} > 0 AND {_SURE} < 60000", "'Compensation is a strong negative'"),
                    (f"{_SURE} > 0 AND {_SURE} < 70000", "'Compensation is below preferred range'")], "'Compensation needs verification'")]
    first = lambda notes, most: f"array_to_string(list_filter([{', '.join(notes)}], lambda c: c IS NOT NULL)[1:{most}], '|')"
    reason = duck.cases([(f"rule = {duck.text(k)}", duck.text(v)) for k, v in L.REASONS.items()])
    return f"CASE WHEN rule IS NULL THEN {first(match, 4)} ELSE '' END", f"CASE WHEN rule IS NULL THEN {first(gaps, 3)} ELSE {reason} END"


_MATCH, _GAPS = _notes("Master CV", _SHARED, _FINANCE, _PREFERRED, _CAPITAL, _HOME, duck.contains_any("title_n", L.SENIOR_TITLE))
_WEB_MATCH, _WEB_GAPS = _notes("Source CV", _WEB_SHARED, _WEB_FINANCE, _WEB_PREFERRED, _WEB_CAPITAL, _WEB_HOME, _WEB_SENIOR)


@query("match_notes", f"{PLAN}, {_STAGED} SELECT pos, {_MATCH} AS match, {_GAPS} AS gaps FROM staged WHERE discovered")
def match_notes(spark, sf_dir):
    # one plan, without the drop of texts that evaluated() ends in: the notes read them
    rows = search.staged(postings(spark, sf_dir)).where("discovered").withColumn("rule", rules.exclusion_rule())
    rows = score.match_and_gaps(score.with_scores(rows, CV).withColumn("reason", rules.reason(F.col("rule"))))
    return rows.select("pos", F.array_join("match", "|").alias("match"), F.array_join("gaps", "|").alias("gaps"))


@query("evaluated_web", f"{_WEB_TOTALS} SELECT pos, total / 10.0::DOUBLE AS score, {_WEB_MATCH} AS match, {_WEB_GAPS} AS gaps FROM totals")
def evaluated_web(spark, sf_dir):
    rows = web.evaluated(postings(spark, sf_dir), CV, 7, NOW)
    return rows.select("pos", score.points(F.col("total")).alias("score"), F.array_join("match", "|").alias("match"), F.array_join("gaps", "|").alias("gaps"))
