"""The query catalogue: each operator over the driver's tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions import parse, text
from lodestone.functions.automaton import categories_of, frozen
from lodestone.operators import company, cv, evidence, identity, ranges, requirements, rules, score
from lodestone.plans import duck, search
from lodestone.sources.postings import CV, NOW, POSTINGS_SQL, job_postings, postings, table
from lodestone.streaming import keyed
from lodestone.streaming.changelog import ChangeLog
from lodestone.streaming.history import replayed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

DUCK_POSTINGS = POSTINGS_SQL.format(documents="documents")
#: Common table expressions of the SQL twins, named as the stages of the plans.
_T, _B, _X = duck.normal("title"), duck.normal("description"), duck.normal("title || ' ' || description")
WITH = f"""
WITH jobs AS ({DUCK_POSTINGS}),
normed AS (SELECT *, {_T} AS title_n, {_B} AS body_n, {_X} AS text_n FROM jobs),
features AS (SELECT *, {duck.categories('text_n', L.RESPONSIBILITY)} AS responsibilities, {duck.categories('text_n', L.TECHNOLOGY)} AS technologies,
  {duck.categories('body_n', L.TECHNOLOGY)} AS body_technologies, {duck.categories('text_n', L.EVIDENCE)} AS evidence FROM normed)
"""
_SENTENCE = duck.normal("s")
_MANDATORY = f"""len(list_filter(regexp_split_to_array(regexp_replace(title || chr(10) || description, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '\\n+'),
  lambda s: {duck.matches(_SENTENCE, L.LANGUAGE)} AND NOT {duck.matches(_SENTENCE, L.LANGUAGE_OPTIONAL)} AND {duck.matches(_SENTENCE, *L.LANGUAGE_REQUIRED)})) > 0"""
_FEW_TECH, _FEW_DUTIES = "len(technologies) <= 1", "len(responsibilities) <= 2"
_RULE = duck.cases([
    ("NOT full_jd_verified", "'unverified'"), ("vacancy_status = 'CLOSED'", "'closed'"), (_MANDATORY, "'language'"),
    ("remote_type = 'remote' AND remote_eligibility = 'DENMARK EXCLUDED'", "'remote'"),
    (f"{duck.matches('title_n', L.JUNIOR_TITLE)} AND NOT {duck.matches('title_n', L.LEADING_TITLE)}", "'junior'"),
    (f"{duck.matches('text_n', *L.CONSTRUCTION)} AND (NOT {duck.matches('text_n', L.CONSTRUCTION_CORPORATE_IT)} OR {_FEW_TECH})", "'construction'"),
    (f"({duck.matches('title_n', L.RESEARCH_TITLE)} OR {duck.matches('body_n', *L.RESEARCH_BODY)} OR ({duck.term_count('body_n', L.RESEARCH_TERMS)} >= 2 AND len(body_technologies) <= 1)) AND NOT {duck.matches('body_n', L.RESEARCH_CORPORATE_IT)}", "'research'"),
    (f"{duck.matches('text_n', L.MARKETING)} AND {_FEW_TECH}", "'marketing'"), (f"{duck.matches('text_n', L.RETAIL)} AND {_FEW_TECH}", "'retail'"),
    (duck.matches("text_n", *L.NO_OWNERSHIP), "'no_ownership'"),
    (f"{duck.term_count('text_n', L.SUPPORT_TERMS)} >= 2 AND {_FEW_DUTIES}", "'support'"),
    (f"{duck.term_count('text_n', L.COORDINATION_TERMS)} >= 2 AND {_FEW_DUTIES}", "'coordination'"),
    ("len(responsibilities) = 0", "'no_evidence'"),
])
_RESPONSIBILITY = """CAST(floor((least(1000, 220 + least(660, 66 * len(responsibilities)) + CASE WHEN list_contains(responsibilities, 'end_to_end') THEN 50 ELSE 0 END
  + CASE WHEN list_contains(responsibilities, 'accountability_outcomes') THEN 40 ELSE 0 END
  + CASE WHEN list_contains(responsibilities, 'risk_dependencies') AND list_contains(responsibilities, 'scope_schedule') THEN 30 ELSE 0 END) + 5) / 10.0) AS INT)"""
_CV = duck.categories(duck.normal(duck.text(CV)), L.EVIDENCE)
_EXPERIENCE = f"""CAST(floor((least(1000, 200 + least(500, 58 * len(list_intersect(evidence, {_CV}))) + least(160, 32 * len(technologies))
  + CASE WHEN ({duck.term_count('text_n', L.FINANCE_TERMS)} > 0 OR {duck.matches('text_n', L.REGULATED)}) AND (list_contains({_CV}, 'financial') OR list_contains({_CV}, 'regulatory')) THEN 110 ELSE 0 END) + 5) / 10.0) AS INT)"""
_PLACE = duck.normal("location")
_PREFERRED = duck.contains_any(_PLACE, [text.normal_text(x) for x in L.PREFERRED_LOCATIONS])
_CAPITAL = duck.contains_any(_PLACE, L.CAPITAL_REGION)
_GEOGRAPHY = duck.cases([
    ("remote_type = 'remote' AND remote_eligibility = 'DENMARK CONFIRMED'", "100"), ("remote_type = 'remote' AND remote_eligibility = 'UNVERIFIED'", "50"),
    (f"{_PREFERRED} AND remote_type = 'hybrid'", "100"), (_PREFERRED, "90"), (f"{_CAPITAL} AND remote_type = 'hybrid'", "80"),
    (f"{_CAPITAL} AND remote_type = 'onsite'", "55"), (_CAPITAL, "70"), (f"{duck.contains_any(_PLACE, L.COUNTRY)} OR {duck.normal('country')} IN ('denmark', 'danmark')", "50")], "20")
_SURE = "coalesce(salary_min, salary_max, 0)"
_SALARY = duck.cases([
    ("salary_min IS NULL AND salary_max IS NULL", "0"), ("employment_type = 'contract'", f"CASE WHEN {_SURE} >= 80000 THEN 20 ELSE -20 END"),
    ("salary_min >= 80000", "20"), ("salary_min >= 75000", "10"), ("salary_min < 75000 AND salary_max >= 75000", "0"),
    (f"{_SURE} > 0 AND {_SURE} < 60000", "-40"), (f"{_SURE} > 0 AND {_SURE} < 70000", "-20")], "0")
_PEOPLE = " + ".join(f"CAST({duck.matches('body_n', p)} AS INT)" for p in L.PEOPLE_MANAGEMENT)
_CAREER = f"""greatest(0, least(100, 55 + CASE WHEN {duck.contains_any('title_n', L.SENIOR_TITLE)} THEN 15 WHEN {duck.contains_any('title_n', L.MANAGER_TITLE)} THEN 5 ELSE 0 END
  - CASE WHEN {_PEOPLE} >= 2 THEN 20 ELSE 0 END - CASE WHEN {duck.matches('body_n', L.SELECTED_ONLY)} AND {duck.matches('body_n', L.PORTFOLIO)} THEN 7 ELSE 0 END + {_SALARY}))"""
_TITLES = list(dict.fromkeys(w.lower() for w in L.DISCOVERY_TITLES))
_DISCOVERED = f"""({duck.contains_any(duck.collapsed('title'), _TITLES)} OR ({duck.count_contained(duck.collapsed('description'), [w.lower() for w in L.TECHNOLOGY_SIGNALS])} >= 2
  AND {duck.count_contained(duck.collapsed('description'), [w.lower() for w in L.OWNERSHIP_SIGNALS])} >= 2))"""
_FINGERPRINT = f"""sha1(CASE WHEN coalesce(source, '') <> '' AND coalesce(source_job_id, '') <> '' THEN {duck.identity('source')} || '|' || {duck.identity('source_job_id')}
  ELSE {duck.identity('company')} || '|' || {duck.identity('title')} || '|' || {duck.identity('location')} END)"""
_MATERIAL = "sha1(concat_ws(chr(10), title, description, location, remote_type, vacancy_status, coalesce(CAST(deadline AS VARCHAR), ''), coalesce(CAST(salary_min AS VARCHAR), ''), coalesce(CAST(salary_max AS VARCHAR), '')))"
_VERDICT = "CASE WHEN total >= 90 THEN 'Strong fit' WHEN total >= 75 THEN 'Plausible fit' WHEN total >= 60 THEN 'Stretch fit' ELSE 'Poor fit' END"
_FRESH_CUT = NOW - 14 * 86400 - 24 * 3600
PLAN = f"""{WITH},
ruled AS (SELECT *, {_RULE} AS rule, {_DISCOVERED} AS discovered, {_FINGERPRINT} AS fingerprint, {_MATERIAL} AS material_hash FROM features),
scored AS (SELECT *, {_RESPONSIBILITY} AS responsibility, {_EXPERIENCE} AS experience, {_GEOGRAPHY} AS geography, {_CAREER} AS career FROM ruled),
totals AS (SELECT *, CAST(floor((40 * responsibility + 25 * experience + 20 * geography + 15 * career + 50) / 100.0) AS INT) AS total FROM scored)
"""


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.with_features(postings(spark, sf_dir))


@query("flagship_topk", WITH + f"SELECT pos, CAST({_RESPONSIBILITY} AS DOUBLE) / 10.0 AS score FROM features ORDER BY {_RESPONSIBILITY} DESC, pos LIMIT 10")
def flagship_topk(spark, sf_dir):
    # of the features only what is ranked by
    jobs = postings(spark, sf_dir).select("pos", text.normal(F.concat_ws(" ", "title", "description")).alias("text_n"))
    found = jobs.select("pos", categories_of(F.col("text_n"), frozen(responsibilities=L.RESPONSIBILITY)).alias("found")).select("pos", "found.*")
    scored = found.select("pos", score.responsibility().alias("tenths"))
    return scored.orderBy(F.desc("tenths"), "pos").limit(10).select("pos", score.points(F.col("tenths")).alias("score"))


@query("category_hits_long", WITH + "SELECT category, count(*) AS n FROM (SELECT unnest(list_concat(list_transform(responsibilities, lambda c: 'r:' || c), list_transform(technologies, lambda c: 't:' || c))) AS category FROM features) GROUP BY category")
def category_hits_long(spark, sf_dir):
    named = lambda c, p: F.transform(c, lambda x: F.concat(F.lit(p), x))
    each = features(spark, sf_dir).select(F.explode(F.concat(named("responsibilities", "r:"), named("technologies", "t:"))).alias("category"))
    return each.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("term_hits_distinct", WITH + f"SELECT pos, CAST({duck.term_count('text_n', L.SUPPORT_TERMS)} AS INT) AS support, CAST({duck.term_count('text_n', L.COORDINATION_TERMS)} AS INT) AS coordination, CAST({duck.term_count('text_n', L.FINANCE_TERMS)} AS INT) AS finance FROM normed")
def term_hits_distinct(spark, sf_dir):
    jobs = postings(spark, sf_dir).select("pos", text.normal(F.concat_ws(" ", "title", "description")).alias("t"))
    counts = {"support": L.SUPPORT_TERMS, "coordination": L.COORDINATION_TERMS, "finance": L.FINANCE_TERMS}
    return jobs.select("pos", *(text.term_count(F.col("t"), v).alias(k) for k, v in counts.items()))


@query("term_hits_occurrences", WITH + "SELECT pos, CAST(len(regexp_extract_all(text_n, 'coordination|facilitation|status reporting')) AS INT) AS occurrences FROM normed")
def term_hits_occurrences(spark, sf_dir):
    jobs = postings(spark, sf_dir).select("pos", text.normal(F.concat_ws(" ", "title", "description")).alias("t"))
    return jobs.select("pos", text.term_occurrences(F.col("t"), ("coordination", "facilitation", "status reporting")).alias("occurrences"))


_REASON = duck.cases([(f"rule = {duck.text(k)}", duck.text(v)) for k, v in L.REASONS.items()])


@query("exclusion_reason", PLAN + f"SELECT pos, rule, {_REASON} AS reason FROM ruled")
def exclusion_reason(spark, sf_dir):
    return features(spark, sf_dir).select("pos", rules.exclusion_rule().alias("rule")).withColumn("reason", rules.reason(F.col("rule")))


@query("reject_histogram", PLAN + "SELECT coalesce(rule, 'kept') AS rule, count(*) AS n FROM ruled GROUP BY 1")
def reject_histogram(spark, sf_dir):
    ruled = features(spark, sf_dir).select(F.coalesce(rules.exclusion_rule(), F.lit("kept")).alias("rule"))
    return ruled.groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("mandatory_language_sentences", WITH + f"SELECT pos, {_MANDATORY} AS mandatory FROM jobs")
def mandatory_language_sentences(spark, sf_dir):
    return postings(spark, sf_dir).select("pos", rules.mandatory_language(F.concat_ws("\n", "title", "description")).alias("mandatory"))


@query("discovery_filter_svc", WITH + f"SELECT pos FROM jobs WHERE {_DISCOVERED}")
def discovery_filter_svc(spark, sf_dir):
    return rules.with_gate(postings(spark, sf_dir).select("pos", "title", "description")).where("discovered").select("pos")


@query("discovery_filter_web", WITH + f"SELECT pos FROM features WHERE {duck.contains_any(duck.collapsed('title'), _TITLES)} OR (len(technologies) >= 2 AND len(responsibilities) >= 2)")
def discovery_filter_web(spark, sf_dir):
    found = features(spark, sf_dir).select("pos", rules.discovered_by_categories(F.col("title"), F.col("technologies"), F.col("responsibilities")).alias("found"))
    return found.where("found").select("pos")


def _freshness(grace: float, null_passes: bool):
    def run(spark, sf_dir):
        rows = postings(spark, sf_dir).select("pos", "published_at")
        return rows.where(F.coalesce(F.col("published_at") >= NOW - 7 * 86400 - int(grace * 3600), F.lit(null_passes))).select("pos")

    return run


for _name, _grace, _null in (("svc", 24, True), ("web", 6, True), ("leg", 6, False)):
    query(f"freshness_{_name}", f"WITH jobs AS ({DUCK_POSTINGS}) SELECT pos FROM jobs WHERE coalesce(published_at >= {NOW - 7 * 86400 - _grace * 3600}, {_null})")(_freshness(_grace, _null))


@query("events_grace", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 HOUR")
def events_grace(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    last = events.agg(F.max("ts").alias("m")).first()["m"]
    return events.where(F.col("ts") >= F.lit(last) - F.expr("INTERVAL 30 HOUR")).select("event_id")


@query("fingerprint", WITH + f"SELECT pos, {_FINGERPRINT} AS fingerprint FROM jobs")
def fingerprint(spark, sf_dir):
    return postings(spark, sf_dir).select("pos", identity.fingerprint().alias("fingerprint"))


@query("material_hash", WITH + f"SELECT pos, {_MATERIAL} AS material_hash FROM jobs")
def material_hash(spark, sf_dir):
    return postings(spark, sf_dir).select("pos", identity.material_hash().alias("material_hash"))


@query("dedupe_rank", WITH + "SELECT company, pos FROM (SELECT *, row_number() OVER (PARTITION BY company ORDER BY full_jd_verified DESC, length(description) DESC, published_at DESC NULLS LAST, pos) AS r FROM jobs) WHERE r = 1")
def dedupe_rank(spark, sf_dir):
    return identity.deduplicated(postings(spark, sf_dir), ["company"], "pos").select("company", "pos")


@query("dedupe_first", WITH + "SELECT company, arg_min(title, pos) AS title, min(pos) AS pos FROM jobs GROUP BY company")
def dedupe_first(spark, sf_dir):
    return identity.first_arrived(postings(spark, sf_dir).select("company", "title", "pos"), ["company"], "pos")


@query("dedupe_last", WITH + "SELECT company, arg_max(title, pos) AS title, max(pos) AS pos FROM jobs GROUP BY company")
def dedupe_last(spark, sf_dir):
    return identity.last_arrived(postings(spark, sf_dir).select("company", "title", "pos"), ["company"], "pos")


@query("dedupe_fold", WITH + """SELECT company, list_reduce(list({'pos': pos, 'at': published_at, 'n': length(description)} ORDER BY pos),
  lambda kept, x: CASE WHEN coalesce(x.at > kept.at, false) OR x.n > kept.n THEN x ELSE kept END).pos AS pos FROM jobs GROUP BY company""")
def dedupe_fold(spark, sf_dir):
    return identity.folded(postings(spark, sf_dir).select("company", "pos", "published_at", "description"), ["company"], "pos")


def _history(jobs: DataFrame) -> DataFrame:
    """What was seen before: two thirds of the postings, a part of them with other text."""
    known = jobs.where("pos % 3 <> 0").select(identity.fingerprint().alias("fingerprint"), "source", "source_job_id", "pos", identity.material_hash().alias("h"))
    return known.select("fingerprint", F.when(F.col("pos") % 3 == 2, F.concat(F.lit("old"), "h")).otherwise(F.col("h")).alias("material_hash"), "source", "source_job_id")


_HISTORY = f"history AS (SELECT {_FINGERPRINT} AS fingerprint, CASE WHEN pos % 3 = 2 THEN 'old' || {_MATERIAL} ELSE {_MATERIAL} END AS known_hash FROM jobs WHERE pos % 3 <> 0)"
_STATUS = "CASE WHEN known_hash IS NULL THEN 'NEW' WHEN known_hash <> material_hash THEN 'UPDATED' ELSE 'SEEN' END"


def _hashed(jobs: DataFrame) -> DataFrame:
    return jobs.withColumns({"fingerprint": identity.fingerprint(), "material_hash": identity.material_hash()})


@query("history_status", f"{WITH}, {_HISTORY}, own AS (SELECT pos, {_FINGERPRINT} AS fingerprint, {_MATERIAL} AS material_hash FROM jobs) SELECT pos, {_STATUS} AS history_status FROM own LEFT JOIN history USING (fingerprint)")
def history_status(spark, sf_dir):
    jobs = postings(spark, sf_dir)
    return identity.history_status(_hashed(jobs).select("pos", "fingerprint", "material_hash"), _history(jobs)).select("pos", "history_status")


@query("only_new_or_updated", f"{WITH}, {_HISTORY}, own AS (SELECT pos, {_FINGERPRINT} AS fingerprint, {_MATERIAL} AS material_hash FROM jobs) SELECT pos FROM own LEFT JOIN history USING (fingerprint) WHERE {_STATUS} <> 'SEEN'")
def only_new_or_updated(spark, sf_dir):
    return history_status(spark, sf_dir).where("history_status <> 'SEEN'").select("pos")


@query("history_remember", f"{WITH} SELECT {_FINGERPRINT} AS fingerprint, {_MATERIAL} AS material_hash FROM jobs UNION ALL SELECT 'gone' || CAST(pos AS VARCHAR), 'h' FROM jobs")
def history_remember(spark, sf_dir):
    """All arrivals are taken in, over a history that also holds postings which did not come again."""
    jobs = postings(spark, sf_dir)
    gone = jobs.select(F.concat(F.lit("gone"), F.col("pos").cast("string")).alias("fingerprint"), F.lit("h").alias("material_hash"), "source", "source_job_id")
    return identity.remembered(_history(jobs).unionByName(gone), _hashed(jobs)).select("fingerprint", "material_hash")


@query("stage_scores", PLAN + "SELECT pos, responsibility / 10.0::DOUBLE AS responsibility, experience / 10.0::DOUBLE AS experience, geography / 10.0::DOUBLE AS geography, career / 10.0::DOUBLE AS career, total / 10.0::DOUBLE AS total, " + _VERDICT + " AS verdict FROM totals")
def stage_scores(spark, sf_dir):
    out = score.with_scores(features(spark, sf_dir), CV)
    names = ("responsibility", "experience", "geography", "career", "total")
    return out.select("pos", *(score.points(F.col(c)).alias(c) for c in names), "verdict")


@query("responsibility_score", PLAN + "SELECT pos, responsibility / 10.0::DOUBLE AS score FROM scored")
def responsibility_score(spark, sf_dir):
    return features(spark, sf_dir).select("pos", score.points(score.responsibility()).alias("score"))


@query("experience_score", PLAN + "SELECT pos, experience / 10.0::DOUBLE AS score FROM scored")
def experience_score(spark, sf_dir):
    rows = features(spark, sf_dir).withColumn("cv", text.categories(text.normal(F.lit(CV)), L.EVIDENCE))
    return rows.select("pos", score.points(score.experience("cv")).alias("score"))


@query("geography_score", WITH + f"SELECT pos, {_GEOGRAPHY} / 10.0::DOUBLE AS score FROM jobs")
def geography_score(spark, sf_dir):
    return postings(spark, sf_dir).select("pos", score.points(score.geography()).alias("score"))


@query("career_score", WITH + f"SELECT pos, {_CAREER} / 10.0::DOUBLE AS score FROM normed")
def career_score(spark, sf_dir):
    rows = postings(spark, sf_dir).withColumns({"title_n": text.normal(F.col("title")), "body_n": text.normal(F.col("description"))})
    return rows.select("pos", score.points(score.career()).alias("score"))


_NAMES = ", ".join(f"CASE WHEN list_contains(responsibilities, {duck.text(k)}) THEN {duck.text(v)} END" for k, v in L.RESPONSIBILITY_NAMES.items())


@query("responsibility_notes", WITH + f"SELECT pos, CASE WHEN len(responsibilities) > 0 THEN 'Delivery evidence: ' || array_to_string(list_filter([{_NAMES}], lambda c: c IS NOT NULL)[1:6], ', ') END AS note FROM features")
def responsibility_notes(spark, sf_dir):
    return score.notes(features(spark, sf_dir)).select("pos", "note")


_STAGED = f"""staged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fingerprint ORDER BY length(description) DESC, published_at DESC NULLS LAST, pos) AS r FROM totals
  WHERE full_jd_verified AND description <> '' AND coalesce(published_at >= {_FRESH_CUT}, true)) WHERE r = 1)"""


@query("final_rank", f"""{PLAN}, {_HISTORY}, {_STAGED}
SELECT pos, total / 10.0::DOUBLE AS score, {_STATUS} AS history_status FROM staged LEFT JOIN history USING (fingerprint)
WHERE discovered AND rule IS NULL AND total >= 60 AND {_STATUS} <> 'SEEN'
ORDER BY total DESC, CASE WHEN {_STATUS} = 'NEW' THEN 1 ELSE 0 END DESC, published_at DESC NULLS LAST, pos LIMIT 10""")
def final_rank(spark, sf_dir):
    jobs = postings(spark, sf_dir)
    return search.ranked(jobs, _history(jobs)).select("pos", score.points(F.col("total")).alias("score"), "history_status")


@query("evaluated_verdicts", f"{PLAN}, {_STAGED} SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN rule IS NOT NULL THEN 'Poor fit' ELSE {_VERDICT} END AS verdict FROM staged WHERE discovered) GROUP BY verdict")
def evaluated_verdicts(spark, sf_dir):
    return search.evaluated(postings(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


_ALL_STAGED = _STAGED.replace(f"coalesce(published_at >= {_FRESH_CUT}, true)", "true")


@query("stage_stats", f"""{PLAN}, {_HISTORY}, {_ALL_STAGED}, told AS (SELECT *, discovered AND rule IS NULL AND total >= 60 AND {_STATUS} <> 'SEEN' AS worth FROM staged LEFT JOIN history USING (fingerprint))
SELECT (SELECT count(*) FROM jobs) AS fetched, (SELECT count(*) FROM jobs WHERE full_jd_verified AND description <> '') AS full_jd_verified, count(*) AS deduplicated, count(*) FILTER (WHERE discovered) AS cheap_filter_passed,
  count(*) FILTER (WHERE discovered) AS full_jd_evaluated, least(10, count(*) FILTER (WHERE worth)) AS worthwhile FROM told""")
def stage_stats(spark, sf_dir):
    jobs = postings(spark, sf_dir)
    return search.stage_stats(jobs, _history(jobs))


@query("stage_counters", ORACLE["stage_stats"])
def stage_counters(spark, sf_dir):
    """stage_stats() as counters of the search that writes the best postings."""
    jobs = postings(spark, sf_dir)
    told = search.searched(jobs, _history(jobs), keyed.shared_folder(spark, "best"), days=10_000)
    names = ("fetched", "full_jd_verified", "deduplicated", "cheap_filter_passed", "full_jd_evaluated", "worthwhile")
    return spark.createDataFrame([tuple(told[n] for n in names)], ", ".join(f"{n} long" for n in names))


@query("detail_left_join", """SELECT d.doc_id, CASE WHEN p.page_id IS NULL THEN 'failed' WHEN length(p.html) < 1000 THEN 'incomplete' ELSE 'ok' END AS status, coalesce(p.url, d.source) AS origin
FROM documents d LEFT JOIN pages p ON d.doc_id = p.page_id""")
def detail_left_join(spark, sf_dir):
    details = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url", F.length("html").alias("n"), F.lit(True).alias("got"))
    out = table(spark, sf_dir, "documents").select("doc_id", "source").join(details, "doc_id", "left")
    status = F.when(F.col("got").isNull(), "failed").when(F.col("n") < 1000, "incomplete").otherwise("ok")
    return out.select("doc_id", status.alias("status"), F.coalesce("url", "source").alias("origin"))


@query("union_sources", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def union_sources(spark, sf_dir):
    """One frame for each language, as each board is one, put together again; a null language is a frame too."""
    docs = table(spark, sf_dir, "documents").select("source", "n_chars", "lang")
    named = [r["lang"] for r in docs.select("lang").distinct().orderBy("lang").collect()]  # a handful of languages
    each = [docs.where(F.col("lang").eqNullSafe(F.lit(x))) for x in named] or [docs]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("category_intersect", WITH + f"SELECT pos, array_to_string(list_filter(evidence, lambda c: list_contains({_CV}, c)), ',') AS shared FROM features")
def category_intersect(spark, sf_dir):
    cv = text.categories(text.normal(F.lit(CV)), L.EVIDENCE)
    return features(spark, sf_dir).select("pos", F.array_join(F.array_intersect("evidence", cv), ",").alias("shared"))


@query("requirement_gap", WITH + f"SELECT pos, array_to_string(list_filter(evidence, lambda c: NOT list_contains({_CV}, c)), ',') AS gap FROM features")
def requirement_gap(spark, sf_dir):
    cv = text.categories(text.normal(F.lit(CV)), L.EVIDENCE)
    return features(spark, sf_dir).select("pos", F.array_join(F.array_except("evidence", cv), ",").alias("gap"))


def _duck_clean(x: str) -> str:
    out = f"regexp_replace(regexp_replace(coalesce({x}, ''), '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
    for entity, char in text.ENTITIES.items():
        out = f"replace({out}, {duck.text(entity)}, {duck.text(char)})"
    return f"trim(regexp_replace({out}, '[\\s\u00a0]+', ' ', 'g'))"


@query("html_clean_svc", f"SELECT page_id, {_duck_clean('html')} AS body FROM pages")
def html_clean_svc(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html(F.col("html")).alias("body"))


def _duck_lines(x: str) -> str:
    out = f"coalesce({x}, '')"
    for entity, char in text.ENTITIES.items():
        out = f"replace({out}, {duck.text(entity)}, {duck.text(char)})"
    out = f"regexp_replace({out}, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)<br\\s*/?>|</(?:p|div|li|h[1-6]|section|article|ul|ol)>', chr(10), 'g')"
    out = f"regexp_replace(regexp_replace({out}, '(?s)<[^>]+>', ' ', 'g'), '[ \\t\u00a0]+', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'))"


@query("html_clean_web", f"SELECT page_id, {_duck_lines('html')} AS body FROM pages")
def html_clean_web(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_html_lines(F.col("html")).alias("body"))


_H1 = _duck_clean("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1>', 1)")
_TITLE = _duck_clean("regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title>', 1)")


@query("html_title", f"SELECT page_id, coalesce(nullif({_H1}, ''), trim(regexp_replace({_TITLE}, '\\s+[|–—-]\\s+[^|–—-]+$', ''))) AS title FROM pages")
def html_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", company.page_title(F.col("html")).alias("title"))


@query("links_extract", f"""WITH tags AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>')) AS tag FROM pages)
SELECT page_id, regexp_extract(tag, '(?is)href=["'']([^"'']+)["'']', 1) AS href, {_duck_clean("regexp_extract(tag, '(?is)^<a[^>]*>(.*?)</a>', 1)")} AS label FROM tags""")
def links_extract(spark, sf_dir):
    return company.page_links(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "href", "label")


@query("job_id_from_url", "SELECT page_id, nullif(regexp_extract('https://board.example/jobs/view/' || replace(url, '/', '-') || '-' || CAST(1000000 + page_id AS VARCHAR) || '?a=1', '/view/(?:[^/?#]*-)?([0-9]{7,})(?:[/?#]|$)', 1), '') AS job_id FROM pages")
def job_id_from_url(spark, sf_dir):
    built = F.concat(F.lit("https://board.example/jobs/view/"), F.replace("url", F.lit("/"), F.lit("-")), F.lit("-"), (1000000 + F.col("page_id")).cast("string"), F.lit("?a=1"))
    return table(spark, sf_dir, "pages").select("page_id", parse.job_id(built).alias("job_id"))


@query("url_parts", "SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr("try_parse_url(url, 'HOST')").alias("host"), F.expr("try_parse_url(url, 'PATH')").alias("path"))


_SALARY_TEXT = """CASE doc_id % 5 WHEN 0 THEN '50,000–75,000 DKK per month' WHEN 1 THEN '50.000,00 kr./md - 75.000,00 kr./md' WHEN 2 THEN 'Annual base salary: 647,000–971,000 DKK'
 WHEN 3 THEN 'DKK 45,000 - 62,500 monthly' ELSE 'competitive pay' END"""


def _duck_amount(group: int, regex: str) -> str:
    raw = f"regexp_replace(regexp_replace(trim(regexp_extract(t, {duck.text('(?i)' + regex)}, {group})), '[.,]00$', ''), '[^0-9]', '', 'g')"
    return f"CASE WHEN TRY_CAST({raw} AS INT) BETWEEN 10000 AND 250000 THEN TRY_CAST({raw} AS INT) END"


_PAIRS = [(_duck_amount(1, r), _duck_amount(2, r)) for r in L.SALARY]


@query("salary_parse", f"""WITH t AS (SELECT doc_id, {_SALARY_TEXT} AS t FROM documents), a AS (SELECT doc_id, {', '.join(f'{a} AS a{i}, {b} AS b{i}' for i, (a, b) in enumerate(_PAIRS))} FROM t)
SELECT doc_id, {duck.cases([(f'a{i} IS NOT NULL AND b{i} IS NOT NULL', f'least(a{i}, b{i})') for i in range(3)])} AS low, {duck.cases([(f'a{i} IS NOT NULL AND b{i} IS NOT NULL', f'greatest(a{i}, b{i})') for i in range(3)])} AS high FROM a""")
def salary_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_SALARY_TEXT).alias("t"))
    return rows.select("doc_id", parse.monthly_salary(F.col("t")).alias("s")).select("doc_id", "s.low", "s.high")


_DEADLINE_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'Deadline for application: 20th August 2026' WHEN 1 THEN 'Apply by 31 february' WHEN 2 THEN 'Ansøgningsfrist: 5 maj' ELSE 'open' END"
_MONTH = "CASE regexp_extract(lower(t), " + duck.text(L.DEADLINE) + ", 2) " + " ".join(f"WHEN {duck.text(k)} THEN {v}" for k, v in L.MONTHS.items()) + " END"


@query("deadline_parse", f"""WITH t AS (SELECT doc_id, {_DEADLINE_TEXT} AS t FROM documents)
SELECT doc_id, epoch(TRY_CAST(coalesce(nullif(regexp_extract(lower(t), {duck.text(L.DEADLINE)}, 3), ''), '2026') || '-' || lpad(CAST({_MONTH} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract(lower(t), {duck.text(L.DEADLINE)}, 1), 2, '0') || ' 23:59:59' AS TIMESTAMP))::BIGINT AS deadline FROM t""")
def deadline_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_DEADLINE_TEXT).alias("t"))
    return rows.select("doc_id", F.unix_timestamp(parse.deadline(F.col("t"), 2026).cast("timestamp")).alias("deadline"))


_WORK_TEXT = """CASE doc_id % 6 WHEN 0 THEN 'A hybrid role near you' WHEN 1 THEN 'hybrid delivery approaches' WHEN 2 THEN 'at least half (50%) of our time together in the office'
 WHEN 3 THEN 'This is a fully remote position from Denmark; full-time' WHEN 4 THEN 'On-site role for contractors' ELSE 'must be based in Germany, work remotely' END"""
_KIND = duck.cases([(duck.matches("lower(t)", *L.HYBRID), "'hybrid'"), (duck.matches("lower(t)", *L.REMOTE), "'remote'"), (duck.matches("lower(t)", *L.ONSITE), "'onsite'")], "'unknown'")
_ELIGIBLE = duck.cases([("kind <> 'remote'", "'NOT APPLICABLE'"), (f"{duck.matches('lower(t)', L.ELSEWHERE_ONLY)} AND NOT {duck.matches('lower(t)', L.HERE)}", "'DENMARK EXCLUDED'"), (duck.matches("lower(t)", *L.ELIGIBLE), "'DENMARK CONFIRMED'")], "'UNVERIFIED'")
_EMPLOYMENT = duck.cases([(duck.contains_any("lower(t)", L.PERMANENT_WORDS), "'permanent'"), (duck.contains_any("lower(t)", L.CONTRACT_WORDS), "'contract'"), (duck.contains_any("lower(t)", L.FIXED_TERM_WORDS), "'fixed-term'")], "'unknown'")


@query("work_model", f"WITH t AS (SELECT doc_id, {_WORK_TEXT} AS t FROM documents), k AS (SELECT *, {_KIND} AS kind FROM t) SELECT doc_id, kind, {_ELIGIBLE} AS eligibility, {_EMPLOYMENT} AS employment FROM k")
def work_model(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_WORK_TEXT).alias("t"))
    kind = parse.remote_type(F.lit(""), F.col("t"))
    rows = rows.withColumn("kind", kind)
    return rows.select("doc_id", "kind", parse.remote_eligibility(F.col("kind"), F.lit(""), F.col("t")).alias("eligibility"), parse.employment_type(F.col("t")).alias("employment"))


_FACT_CTES = f"""lines AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS line,
    unnest(range(len(list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')))) AS ord
  FROM (SELECT doc_id, concat(text, chr(10), CASE doc_id % 3 WHEN 0 THEN '• Led platform delivery for payments in 2021' WHEN 1 THEN '- Managed the release of two products' ELSE '' END) AS text FROM documents)),
facts AS (SELECT doc_id, ord, trim(regexp_replace(line, '^[•\\-–—▪◦*]+\\s*', '')) AS line FROM lines),
useful AS (SELECT *, {duck.matches('lower(line)', evidence.FACT_ACTIONS, evidence.FACT_SIGNALS, evidence.YEAR)} AS useful FROM facts WHERE length(line) BETWEEN 24 AND 420),
firsts AS (SELECT doc_id, lower(line) AS low, min(ord) AS ord, arg_min(line, ord) AS line, bool_or(useful) AS useful FROM useful WHERE useful OR length(line) BETWEEN 30 AND 350 GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY useful DESC, ord) AS number, count(*) FILTER (WHERE useful) OVER (PARTITION BY doc_id) AS n_useful FROM firsts),
numbered AS (SELECT * FROM ranked WHERE useful OR (n_useful < 8 AND number <= 30))"""


def _facts(spark, sf_dir):
    extra = F.when(F.col("doc_id") % 3 == 0, "• Led platform delivery for payments in 2021").when(F.col("doc_id") % 3 == 1, "- Managed the release of two products").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), extra).alias("text"))
    return evidence.fact_lines(docs, "doc_id", "text")


@query("fact_lines", f"WITH {_FACT_CTES} SELECT doc_id, 'FACT-' || lpad(CAST(number AS VARCHAR), 3, '0') AS fact_id, line FROM numbered WHERE number <= 80")
def fact_lines(spark, sf_dir):
    return evidence.numbered(_facts(spark, sf_dir), "doc_id").select("doc_id", "fact_id", "line")


@query("fact_first_occurrence", f"WITH {_FACT_CTES} SELECT doc_id, count(*) AS n, min(ord) AS first_at FROM numbered GROUP BY doc_id")
def fact_first_occurrence(spark, sf_dir):
    return _facts(spark, sf_dir).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("at").cast("long").alias("first_at"))


_TERMS = "list_filter([" + ", ".join(f"CASE WHEN {duck.matches('lower(text)', rf'\b{w}\b')} THEN {duck.text(w)} END" for w in evidence.VOCABULARY) + "], lambda c: c IS NOT NULL)"


@query("relevance_sum", f"SELECT conv_id, turn, CAST(2 * len({_TERMS}) + CAST({duck.matches('lower(text)', evidence.ACTIONS)} AS INT) AS INT) AS relevance FROM (SELECT conv_id, turn, concat(text, CASE turn % 3 WHEN 0 THEN ' Led software delivery.' WHEN 1 THEN ' Risk and data.' ELSE '' END) AS text FROM conversations)")
def relevance_sum(spark, sf_dir):
    more = F.when(F.col("turn") % 3 == 0, " Led software delivery.").when(F.col("turn") % 3 == 1, " Risk and data.").otherwise("")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), more).alias("text"))
    return rows.select("conv_id", "turn", evidence.relevance(F.col("text"), evidence.review_terms(F.col("text"))).alias("relevance"))


_FACT = "concat(left(coalesce(text, ''), 200), CASE turn % 4 WHEN 0 THEN ' and so led software delivery.' WHEN 1 THEN ' managed risk and data with' WHEN 2 THEN ' built the platform' ELSE '' END)"
_FACT_CLEAN = f"trim(regexp_replace(regexp_replace({_FACT}, '^[•\\-–—▪◦*]+\\s*', ''), '\\s+', ' ', 'g'))"


@query("top_evidence", f"""WITH f AS (SELECT conv_id, turn, {_FACT_CLEAN} AS fact FROM conversations),
j AS (SELECT *, length(fact) BETWEEN 42 AND 360 AND NOT {duck.matches('lower(fact)', evidence.DANGLING)} AND {duck.matches('lower(fact)', evidence.COMPLETE_ACTIONS)} AS whole,
  2 * ({' + '.join(f"CAST(contains(lower(fact), '{w}') AS INT)" for w in ('delivery', 'risk', 'platform'))}) + CAST({duck.matches('lower(fact)', evidence.ACTIONS)} AS INT) AS relevance FROM f),
p AS (SELECT *, count(*) FILTER (WHERE whole) OVER (PARTITION BY conv_id) AS n FROM j)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY relevance DESC, turn) AS INT) AS rank FROM p WHERE CASE WHEN n >= 3 THEN whole ELSE length(fact) > 35 END QUALIFY rank <= 6""")
def top_evidence(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("turn").alias("at"), F.expr(_FACT).alias("fact"))
    terms = F.array(*map(F.lit, ("delivery", "risk", "platform")))
    rows = rows.withColumn("relevance", evidence.relevance(F.col("fact"), terms))
    return evidence.top_evidence(rows, "conv_id").select("conv_id", "turn", "rank")


_WORDS = lambda x: f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9+.#/-]{{2,}}'))"


@query("jaccard_change", f"""SELECT a.item_id, CASE WHEN len(list_distinct(list_concat({_WORDS('a.text')}, {_WORDS('b.text')}))) = 0 THEN 1.0::DOUBLE
  ELSE len(list_intersect({_WORDS('a.text')}, {_WORDS('b.text')}))::DOUBLE / len(list_distinct(list_concat({_WORDS('a.text')}, {_WORDS('b.text')}))) END AS jaccard FROM benchmark a JOIN benchmark b ON a.item_id = b.item_id + 1""")
def jaccard_change(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    one = items.select("item_id", F.col("text").alias("a"))
    two = items.select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("b"))
    return one.join(two, "item_id").select("item_id", evidence.jaccard(evidence.word_set(F.col("a")), evidence.word_set(F.col("b"))).alias("jaccard"))


@query("protected_claims", """WITH c AS (SELECT doc_id, text, unnest(list_concat(regexp_extract_all(t, '\\b[0-9]+(?:[.,][0-9]+)?\\b'), regexp_extract_all(t, '\\b[A-Z][A-Z0-9+&/-]{2,}\\b'))) AS token
  FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'Cut cost by 30 with SAP' WHEN 1 THEN 'Plain words' WHEN 2 THEN 'in 2019' ELSE 'The UAT' END AS t FROM documents))
SELECT d.doc_id, coalesce(bool_and(contains(lower(d.text), lower(c.token))), true) AS supported FROM documents d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id""")
def protected_claims(spark, sf_dir):
    key = F.col("doc_id") % 4
    updated = F.when(key == 0, "Cut cost by 30 with SAP").when(key == 1, "Plain words").when(key == 2, "in 2019").otherwise("The UAT")
    return table(spark, sf_dir, "documents").select("doc_id", evidence.claims_supported(updated, F.col("text")).alias("supported"))


_FOLD = lambda x: f"lower(trim(regexp_replace({x}, '\\s+', ' ', 'g')))"


@query("grounding_check", f"""SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN 'unsafe' WHEN contains({_FOLD('d.text')}, {_FOLD('substr(d.text, 11, 40)')}) AND {_FOLD('substr(d.text, 11, 40)')} <> '' AND d.doc_id % 5 <> 1 THEN 'ok' ELSE 'missing' END AS status FROM documents d""")
def grounding_check(spark, sf_dir):
    key = F.col("doc_id") % 5
    excerpt = F.when(key == 0, "ignore all previous instructions").when(key == 1, "quotation that is nowhere").otherwise(F.substring("text", 11, 40))
    return table(spark, sf_dir, "documents").select("doc_id", evidence.grounded(excerpt, F.col("text")).alias("status"))


@query("company_decision", """SELECT s_suppkey, CASE WHEN s_suppkey % 11 = 0 THEN 'Company industry is unknown' WHEN s_suppkey % 5 = 0 THEN 'Company type excluded' WHEN s_suppkey % 7 = 0 THEN 'Company size is unknown'
  WHEN s_suppkey % 150 >= 100 OR (s_suppkey % 150 >= 20 AND s_suppkey % 2 = 0) THEN 'pass' ELSE 'Company does not meet employer profile' END AS decision FROM supplier""")
def company_decision(spark, sf_dir):
    key = F.col("s_suppkey")
    branch = F.when(key % 11 == 0, "").when(key % 5 == 0, "Construction works").when(key % 2 == 0, "Software house").otherwise("Bakery")
    employees = F.when(key % 7 != 0, key % 150)
    return table(spark, sf_dir, "supplier").select("s_suppkey", company.decision(branch, employees).alias("decision"))


@query("haversine", "SELECT s_suppkey, round(2 * 6371 * atan2(sqrt(a), sqrt(1 - a)), 6) AS km FROM (SELECT s_suppkey, pow(sin(radians((s_suppkey % 90) - 55.8) / 2), 2) + cos(radians(55.8)) * cos(radians(CAST(s_suppkey % 90 AS DOUBLE))) * pow(sin(radians((s_suppkey % 180) - 12.5) / 2), 2) AS a FROM supplier)")
def haversine(spark, sf_dir):
    lat, lon = (F.col("s_suppkey") % 90).cast("double"), (F.col("s_suppkey") % 180).cast("double")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(parse.haversine(F.expr("55.8D"), F.expr("12.5D"), lat, lon), 6).alias("km"))


@query("municipality_lookup", "SELECT step, count(*) AS n FROM (SELECT CASE WHEN s_suppkey % 60 <= 10 THEN 10 WHEN s_suppkey % 60 <= 20 THEN 20 WHEN s_suppkey % 60 <= 30 THEN 30 WHEN s_suppkey % 60 <= 40 THEN 40 ELSE 50 END AS step FROM supplier) GROUP BY step")
def municipality_lookup(spark, sf_dir):
    return table(spark, sf_dir, "supplier").groupBy(company.radius_step(F.col("s_suppkey") % 60).alias("step")).agg(F.count(F.lit(1)).alias("n"))


_CODES = ", ".join(f"('{code}', {step})" for step, codes in company.MUNICIPALITIES.items() for code in codes)


@query("municipality_codes", f"SELECT code, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer, (VALUES {_CODES}) m(code, step) WHERE abs(c_acctbal) / 200 > step - 10 OR step = 10 GROUP BY code")
def municipality_codes(spark, sf_dir):
    """The balance as a radius: every customer with the municipalities that its radius takes in."""
    radii = table(spark, sf_dir, "customer").select("c_custkey", (F.abs("c_acctbal") / 200).alias("km"))
    return company.searched_municipalities(radii, "km").groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


@query("events_in_sessions", """WITH s AS (SELECT event_id AS opened, user_id, epoch_us(ts) // 1000000 AS low, epoch_us(ts) // 1000000 + CAST(floor(value * 60) AS BIGINT) AS high FROM events WHERE event_type = 'signup'),
e AS (SELECT event_id, epoch_us(ts) // 1000000 AS tick FROM events) SELECT opened, count(*) AS n FROM s JOIN e ON tick BETWEEN low AND high GROUP BY opened""")
def events_in_sessions(spark, sf_dir):
    """How many events, of anyone, fall into the minutes after each signup."""
    seconds = F.expr("unix_micros(CAST(ts AS timestamp)) div 1000000")  # cut towards zero, as // is in the twin
    events = table(spark, sf_dir, "events")
    spans = events.where("event_type = 'signup'").select(F.col("event_id").alias("opened"), seconds.alias("low"), (seconds + F.floor(F.col("value") * 60).cast("long")).alias("high"))
    return ranges.interval_counts(events.select(seconds.alias("at")), "at", spans, "low", "high", "opened")


@query("corporate_domain", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'firm' || CAST(s_suppkey % 3 AS VARCHAR) || '.dk' END AS domain FROM supplier")
def corporate_domain(spark, sf_dir):
    key = F.col("s_suppkey")
    own = F.when(key % 3 == 0, "me@localhost").otherwise(F.concat(F.lit("info@Firm"), (key % 3).cast("string"), F.lit(".dk")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", company.corporate_domain(F.array(F.lit("a@gmail.com"), own)).alias("domain"))


@query("stream_history_status", """SELECT event_id, CASE WHEN row_number() OVER w = 1 THEN 'NEW' WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type THEN 'SEEN' ELSE 'UPDATED' END AS history_status
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def stream_history_status(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return replayed(events, "user_id", "event_type", ["ts", "event_id"]).select("event_id", "history_status")


_DELIVERIES = 3
_ARRIVAL = "event_id long, user_id long, event_type string, ts timestamp, deadline timestamp"
_DEADLINE = "make_timestamp(epoch_us(ts) + CAST(floor(value * 3600000000.0::DOUBLE) AS BIGINT))"


def _streamed(spark, sf_dir, told, schema: str) -> DataFrame:
    """``told`` of a stream of the events, which land in deliveries; the stream is started again after each."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = F.timestamp_micros(F.unix_micros("ts") + F.floor(F.col("value") * F.lit(3600000000.0)).cast("long"))
    events = events.select("event_id", "user_id", "event_type", "ts", hours.alias("deadline"))
    folder, out, checkpoint = (keyed.shared_folder(spark, label) for label in ("arrivals", "told", "stream"))
    session = keyed.state_session(spark)
    for _ in keyed.landed_in_turn(events, "ts", folder, _DELIVERIES):
        keyed.run(told(keyed.arrivals(session, folder, _ARRIVAL)), out, checkpoint)
    return spark.read.schema(schema).parquet(out)


@query("stream_keyed_history", ORACLE["stream_history_status"])
def stream_keyed_history(spark, sf_dir):
    """The stream itself, with its state in a store: what it tells equals the replay."""
    told = lambda stream: keyed.classified(stream, "user_id", "event_type", "ts", "event_id")
    return _streamed(spark, sf_dir, told, "key string, id long, history_status string").select(F.col("id").alias("event_id"), "history_status")


@query("stream_deadlines", f"""WITH due AS (SELECT CAST(user_id AS VARCHAR) AS key, ts, {_DEADLINE} AS deadline FROM events),
told AS (SELECT *, lead(ts) OVER (PARTITION BY key ORDER BY ts, deadline) AS next FROM due)
SELECT key, epoch_us(deadline) AS deadline_us, 'CLOSED' AS status FROM told WHERE (next IS NULL OR next > deadline) AND deadline <= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def stream_deadlines(spark, sf_dir):
    """Users are open until the deadline of their newest event; timers close them once the watermark has passed it."""
    told = lambda stream: keyed.closed(stream, "user_id", "ts", "deadline", "24 hours")
    rows = _streamed(spark, sf_dir, told, "key string, deadline timestamp, status string")
    return rows.select("key", F.unix_micros("deadline").alias("deadline_us"), "status")


@query("history_log", ORACLE["history_remember"])
def history_log(spark, sf_dir):
    """history_remember() through the change log: what was known is one commit, all arrivals are the next."""
    jobs = postings(spark, sf_dir)
    gone = jobs.select(F.concat(F.lit("gone"), F.col("pos").cast("string")).alias("fingerprint"), F.lit("h").alias("material_hash"), "source", "source_job_id")
    log = ChangeLog(spark, keyed.shared_folder(spark, "history"), "struct<material_hash: string, source: string, source_job_id: string>")
    for version, rows in enumerate((_history(jobs).unionByName(gone), _hashed(jobs))):
        value = F.struct("material_hash", "source", "source_job_id").alias("value")
        log.commit(rows.select(F.col("fingerprint").alias("owner"), F.lit("").alias("item"), value, F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("at")), version)
    return log.current().select(F.col("owner").alias("fingerprint"), "value.material_hash")


_LD = """<html><script type="application/ld+json">{"@type": "JobPosting", "title": "T%s", "hiringOrganization": {"name": "C"}, "datePosted": "2026-08-01"}</script><script type="application/ld+json">{bad</script></html>"""


@query("jsonld_postings", "SELECT page_id, 'T' || CAST(page_id AS VARCHAR) AS title, 'C' AS company, '2026-08-01' AS date_posted FROM pages")
def jsonld_postings(spark, sf_dir):
    head, tail = _LD.split("%s")
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(head), F.col("page_id").cast("string"), F.lit(tail), "html").alias("html"))
    return job_postings(rows, "html").select("page_id", "title", "company", "date_posted")


#: A CV for each document, in three layouts.
_CV_TEXT = """concat('Jo Doe', chr(10), 'Professional Summary', chr(10), 'Delivery lead of ', CAST(doc_id AS STRING), ' projects', chr(10), 'Experience', chr(10),
  CASE doc_id % 3 WHEN 0 THEN 'Lead | Firm A | 2019 - Present' WHEN 1 THEN concat('Lead', chr(10), 'Firm A', chr(10), '2019 - 2021') ELSE 'Lead | 2016 to 2018' END, chr(10),
  'Runs the platform', chr(10), CASE doc_id % 2 WHEN 0 THEN 'and its releases' ELSE '- built things' END, chr(10), '- shipped', chr(10), 'Engineer | Firm B | 2017 - 2020', chr(10), 'Wrote services', chr(10), 'Analyst', chr(10), 'Firm C', chr(10), 'Mar 2012 - Jan 2015', chr(10), '• counted', chr(10), 'Education', chr(10), 'School 2001 - 2005')"""
_CV_CTES = f"""texts AS (SELECT doc_id, {_CV_TEXT} AS t FROM documents),
raw AS (SELECT doc_id, generate_subscripts(string_split(t, chr(10)), 1) - 1 AS ord, unnest(string_split(t, chr(10))) AS line FROM texts),
headed AS (SELECT *, CASE lower(line) WHEN 'professional summary' THEN 'summary' WHEN 'experience' THEN 'experience' WHEN 'education' THEN 'other' END AS heading FROM raw),
placed AS (SELECT *, coalesce(last_value(heading IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'header') AS section FROM headed),
body AS (SELECT * FROM placed WHERE heading IS NULL)"""


def _cv_lines(spark, sf_dir):
    return cv.cv_lines(table(spark, sf_dir, "documents").select("doc_id", F.expr(_CV_TEXT).alias("t")), "doc_id", "t")


@query("section_ranges", f"WITH {_CV_CTES} SELECT doc_id, section, min(ord) AS first_line, max(ord) AS last_line, count(*) AS n FROM body GROUP BY doc_id, section")
def section_ranges(spark, sf_dir):
    return _cv_lines(spark, sf_dir).groupBy("doc_id", "section").agg(F.min("pos").cast("long").alias("first_line"), F.max("pos").cast("long").alias("last_line"), F.count(F.lit(1)).alias("n"))


@query("latest_previous_role", f"""WITH {_CV_CTES},
dated AS (SELECT *, regexp_matches(line, '(19|20)[0-9][0-9] (-|to) ') AS is_date, lag(line, 1) OVER w AS b1, lag(line, 2) OVER w AS b2, regexp_matches(coalesce(lead(line, 1) OVER w, '') || '#' || coalesce(lead(line, 2) OVER w, ''), '(^|#)([A-Z][a-z]+ )?(19|20)[0-9][0-9] (-|to) [A-Za-z]* ?[0-9]+(#|$)') AS is_head FROM body WHERE section = 'experience' WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
counted AS (SELECT *, sum(CAST(is_date AS INT)) OVER (PARTITION BY doc_id ORDER BY ord) AS ordinal FROM dated),
heads AS (SELECT doc_id, ordinal, CASE WHEN contains(line, '|') THEN trim(string_split(line, '|')[1]) ELSE b2 END AS title,
  CASE WHEN len(string_split(line, '|')) = 3 THEN trim(string_split(line, '|')[2]) WHEN contains(line, '|') THEN '' ELSE b1 END AS company,
  CAST(regexp_extract(line, '((?:19|20)[0-9][0-9]) (?:-|to)', 1) AS INT) AS start_year, coalesce(TRY_CAST(regexp_extract(line, '(?:-|to) (?:[A-Z][a-z]+ )?([0-9]+)$', 1) AS INT), 9999) AS end_year FROM counted WHERE is_date),
stops AS (SELECT *, max(CAST(line LIKE '- %' AS INT)) OVER (PARTITION BY doc_id, ordinal ORDER BY ord) AS stopped FROM counted WHERE NOT is_date AND NOT is_head AND ordinal > 0),
overviews AS (SELECT doc_id, ordinal, string_agg(line, ' ' ORDER BY ord) AS overview FROM stops WHERE stopped = 0 GROUP BY doc_id, ordinal)
SELECT h.doc_id, CAST(row_number() OVER (PARTITION BY h.doc_id ORDER BY end_year DESC, start_year DESC, h.ordinal) AS INT) AS rank, title, company, start_year, end_year, coalesce(overview, '') AS overview
FROM heads h LEFT JOIN overviews o ON h.doc_id = o.doc_id AND h.ordinal = o.ordinal QUALIFY rank <= 2""")
def latest_previous_role(spark, sf_dir):
    found = cv.roles(_cv_lines(spark, sf_dir), "doc_id")
    return cv.latest_roles(found, "doc_id").select("doc_id", "rank", "title", "company", "start_year", "end_year", "overview")


@query("length_window", "SELECT item_id, CAST(greatest(0, n - b) AS INT) AS least, CAST(n + b AS INT) AS most FROM (SELECT item_id, n, greatest(CAST(round(n * 0.15::DOUBLE) AS INT), 8) AS b FROM (SELECT item_id, len(string_split(text, ' ')) AS n FROM benchmark))")
def length_window(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.size(F.split("text", " ")).alias("n"))
    return items.select("item_id", cv.length_window(F.col("n")).alias("w")).select("item_id", "w.least", "w.most")


_JOB_TEXT = "CASE doc_id % 4 WHEN 0 THEN 'End-to-end delivery, risk and governance' WHEN 1 THEN 'Integration of APIs; Agile' WHEN 2 THEN 'Release readiness and compliance' ELSE 'Plain work' END"
_FACT_TEXT = "CASE doc_id % 3 WHEN 0 THEN 'Led risk reviews and PMO roadmap' WHEN 1 THEN 'Built the production interface' ELSE 'Scrum master for full lifecycle' END"


def _duck_catalog(x: str, which: int) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {duck.matches(f'lower({x})', *row[which])} THEN {duck.text(row[0])} END" for row in requirements.CATALOG) + "], lambda c: c IS NOT NULL)"


@query("requirement_supported", f"""WITH t AS (SELECT doc_id, doc_id % 50 AS cv, {_JOB_TEXT} AS job, {_FACT_TEXT} AS fact FROM documents),
wanted AS (SELECT doc_id, cv, unnest({_duck_catalog('job', 1)}) AS requirement FROM t), shown AS (SELECT DISTINCT cv, unnest({_duck_catalog('fact', 2)}) AS requirement FROM t)
SELECT w.doc_id, w.requirement, s.cv IS NOT NULL AS supported FROM wanted w LEFT JOIN shown s ON w.cv = s.cv AND w.requirement = s.requirement""")
def requirement_supported(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50).alias("cv"), F.expr(_JOB_TEXT).alias("text"), F.expr(_FACT_TEXT).alias("fact"))
    out = requirements.supported(docs.select("cv", F.col("doc_id").alias("job"), "text"), docs.select("cv", "fact"))
    return out.select(F.col("job").alias("doc_id"), "requirement", "supported")


_PRIORITY = """{"id":"%s","rank":%s,"kind":"%s","requirement":"r","why":"w","jdEvidence":[%s]}"""


def _analysis(ids=("a", "b", "c"), ranks=(1, 2, 3), kind="important", evidence='"e"', mission="m", gaps='"gapsToAvoid":[]') -> str:
    items = ",".join(_PRIORITY % (i, r, kind, evidence) for i, r in zip(ids, ranks, strict=True))
    return '{"roleMission":"%s","candidatePositioning":"p","priorities":[%s],%s}' % (mission, items, gaps)


_ANALYSES = (
    (_analysis(), None), (_analysis(mission=" "), "text"), (_analysis(ids=("a", "b"), ranks=(1, 2)), "count"), (_analysis(ids=("a", "a", "c")), "ids"), (_analysis(kind="odd"), "kind"),
    (_analysis(evidence=""), "evidence"), (_analysis(ranks=(1, 3, 2)), "rank"), (_analysis(gaps='"x":1'), "gaps"),
)


@query("analysis_contract", "SELECT doc_id, CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {duck.text(fault) if fault else 'NULL'}" for i, (_, fault) in enumerate(_ANALYSES)) + " END AS fault FROM documents")
def analysis_contract(spark, sf_dir):
    text_ = None
    for i, (json, _) in enumerate(_ANALYSES):
        test = F.col("doc_id") % 8 == i
        text_ = F.when(test, json) if text_ is None else text_.when(test, json)
    return table(spark, sf_dir, "documents").select("doc_id", requirements.analysis_fault(text_).alias("fault"))


from lodestone.plans import board_queries, record_queries, web_queries  # noqa: E402, F401  these register their queries here
