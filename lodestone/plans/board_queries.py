"""Queries of the board readers, the multi-source search, reviews and records, with their SQL twins.

Landed bodies are built from the driver's tables in SQL that both engines share; the twin computes from
the same columns what a reader must get back out of the body.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators import multisource, observed, records, review
from lodestone.plans import duck
from lodestone.plans.queries import DUCK_POSTINGS, ORACLE, _duck_clean, _duck_lines, query
from lodestone.sources import boards, landed
from lodestone.sources.postings import NOW, postings, table
from lodestone.streaming import keyed
from lodestone.streaming.changelog import ChangeLog

# --- the multi-source search

PROFILE = multisource.Profile(
    "Project Manager, Delivery Manager; Technical Project Manager\nProgramme Manager, Store Planner", ["Denmark hybrid", "Remote EU/EMEA"], "Lyngby, Copenhagen", 65000,
    "mandatory Danish; construction; coordinator or assistant roles; scientific research discovery", 14)
_JOBS = f"""SELECT pos, title, company, CASE WHEN remote_type = 'remote' AND pos % 2 = 0 THEN 'Anywhere' ELSE location END AS location, country, description AS jd, remote_type = 'remote' AS remote,
  published_at AS posted_at, CASE WHEN pos % 5 = 4 THEN 'EUR' ELSE 'DKK' END AS salary_currency, salary_min AS salary_min_monthly, salary_max AS salary_max_monthly FROM ({{jobs}})"""


def _leg(spark, sf_dir) -> DataFrame:
    return spark.sql(_JOBS.format(jobs="SELECT * FROM {p}"), p=postings(spark, sf_dir))


def _basic(x: str) -> str:
    out = f"regexp_replace(coalesce({x}, ''), '<[^>]*>', ' ', 'g')"
    for entity, char in {"&nbsp;": " ", "&amp;": "&", "&quot;": '"', "&#39;": "'"}.items():
        out = f"regexp_replace({out}, '(?i){entity}', {duck.text(char)}, 'g')"
    return f"trim(regexp_replace({out}, '[\\s ]+', ' ', 'g'))"


def _low(x: str) -> str:
    return f"regexp_replace(lower({_basic(x)}), '[–—]', '-', 'g')"


def _any(x: str, *regexes: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {duck.text('(?is)' + r)})" for r in regexes) + ")"


_ROLES = multisource.role_list(PROFILE.roles)
_TITLE_WORDS = f"regexp_split_to_array({_low('title')}, '\\s+')"


def _fit(role: str) -> str:
    words = multisource.role_tokens(role)
    shared = " + ".join(f"CAST(list_contains({_TITLE_WORDS}, {duck.text(w)}) AS INT)" for w in words)
    title = _basic("title")
    return f"CASE WHEN {_any(title, rf'\b{re.escape(role)}\b')} THEN 100 WHEN {_any(title, *multisource.role_patterns(role))} THEN 90 ELSE CAST(floor(({shared})::DOUBLE / {len(words)}.0::DOUBLE * 75 + 0.5::DOUBLE) AS INT) END"


_TEXT = "concat_ws(' ', title, company, jd)"
_EXCLUDED = " OR ".join([
    _any(_basic(_TEXT), rf"(?:{multisource.MANDATORY_WORDS})[^.!?]{{0,35}}\bdanish\b", rf"\bdanish\b[^.!?]{{0,35}}(?:{multisource.MANDATORY_WORDS})"), _any(_TEXT, r"\bconstruction\b"),
    f"({_any(_low('title'), r'\b(coordinator|assistant)\b')} AND NOT {_any(_low('title'), r'\bmanager\b')})", " AND ".join(f"contains({_low(_TEXT)}, '{w}')" for w in ("scientific", "research", "discovery"))])
_PLACE_OK = f"""CASE WHEN remote THEN {_any(_low('location'), r'\b(worldwide|anywhere|global)\b', r'\b(europe|european|emea|eu\b|denmark|nordic|scandinavia|cet|cest)\b', r'\bdenmark|copenhagen|danmark\b')}
  ELSE {_any("coalesce(country, '')", '^$|danmark|denmark')} END"""


def _judged_sql(jobs: str, x: str = "") -> str:
    """Common table expressions that judge ``jobs``, up to named; ``x`` sets their names apart."""
    return f"""jobs{x} AS ({jobs}),
aged{x} AS (SELECT *, coalesce(greatest(0.0::DOUBLE, ({NOW} - posted_at)::DOUBLE / 86400.0::DOUBLE), 999.0::DOUBLE) AS age, {", ".join(f"{_fit(r)} AS f{i}" for i, r in enumerate(_ROLES))},
  CASE WHEN salary_currency <> 'DKK' OR salary_max_monthly IS NULL THEN 'unknown' WHEN salary_max_monthly < 65000 THEN 'below' WHEN coalesce(salary_min_monthly >= 65000, false) THEN 'pass' ELSE 'possible' END AS salary_status,
  NOT remote AND ({" OR ".join(f"contains({_low('location')}, '{p}') OR contains('{p}', {_low('location')})" for p in ("lyngby", "copenhagen"))}) AS preferred FROM jobs{x}),
best{x} AS (SELECT *, greatest({", ".join(f"f{i}" for i in range(len(_ROLES)))}) AS role_score FROM aged{x}),
named{x} AS (SELECT *, CASE WHEN role_score = 0 THEN NULL {" ".join(f"WHEN f{i} = role_score THEN {duck.text(r)}" for i, r in enumerate(_ROLES))} END AS matched_role,
  CASE WHEN age > 14.25 THEN 'freshness' WHEN role_score < 45 THEN 'role' WHEN NOT {_PLACE_OK} THEN 'geography' WHEN {_EXCLUDED} THEN 'exclusion' WHEN salary_status = 'below' THEN 'salary' END AS reject,
  CAST(greatest(0, least(100, floor(role_score * 0.55::DOUBLE + CASE WHEN remote OR preferred THEN 20 ELSE 14 END + greatest(0, floor(15 - age / 14.0::DOUBLE * 10 + 0.5::DOUBLE))
    + CASE salary_status WHEN 'pass' THEN 10 WHEN 'possible' THEN 7 WHEN 'unknown' THEN 4 ELSE 6 END + 0.5::DOUBLE))) AS INT) AS search_score FROM best{x})"""


_MULTI = "WITH " + _judged_sql(_JOBS.format(jobs=DUCK_POSTINGS))


@query("role_fit_argmax", f"{_MULTI} SELECT pos, matched_role AS role, role_score AS score FROM named")
def role_fit_argmax(spark, sf_dir):
    fit = multisource.role_fit(F.col("title"), _ROLES)
    return _leg(spark, sf_dir).select("pos", fit.alias("fit")).select("pos", "fit.role", "fit.score")


@query("search_score", f"{_MULTI} SELECT pos, search_score, salary_status, matched_role FROM named WHERE reject IS NULL")
def search_score(spark, sf_dir):
    return multisource.judged(_leg(spark, sf_dir), PROFILE, NOW).where("reject IS NULL").select("pos", "search_score", "salary_status", "matched_role")


@query("multi_source_rejects", f"{_MULTI} SELECT {', '.join(f"count(*) FILTER (WHERE reject = '{r}') AS {r}" for r in ('role', 'geography', 'exclusion', 'salary', 'freshness'))} FROM named")
def multi_source_rejects(spark, sf_dir):
    return multisource.rejected(multisource.judged(_leg(spark, sf_dir), PROFILE, NOW))


@query("multi_source_results", f"{_MULTI} SELECT pos, search_score FROM named WHERE reject IS NULL ORDER BY search_score DESC, posted_at DESC NULLS LAST, pos LIMIT 30")
def multi_source_results(spark, sf_dir):
    return multisource.results(multisource.judged(_leg(spark, sf_dir), PROFILE, NOW)).select("pos", "search_score")


@query("salary_status", f"{_MULTI} SELECT salary_status AS status, count(*) AS n FROM named GROUP BY 1")
def salary_status(spark, sf_dir):
    status = multisource.salary_status(F.col("salary_currency"), F.col("salary_min_monthly"), F.col("salary_max_monthly"), PROFILE.salary)
    return _leg(spark, sf_dir).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("details_worth_fetching", f"""{_MULTI} SELECT CAST(pos % 1000 AS STRING) AS id, pos FROM named
  QUALIFY row_number() OVER (PARTITION BY pos % 1000 ORDER BY pos) = 1 AND age <= 14.25 AND role_score >= 45 ORDER BY role_score DESC, posted_at DESC, pos LIMIT 18""")
def details_worth_fetching(spark, sf_dir):
    rows = _leg(spark, sf_dir).withColumn("id", (F.col("pos") % 1000).cast("string"))
    return multisource.worth_details(rows, _ROLES, NOW, 14).select("id", "pos")


_HERE = """SELECT * FROM named0 WHERE NOT remote QUALIFY row_number() OVER (PARTITION BY pos % 1000 ORDER BY pos) = 1 AND age <= 14.25 AND role_score >= 45 ORDER BY role_score DESC, posted_at DESC, pos LIMIT 18"""
_DETAILED = """SELECT pos, title, company, CASE WHEN pos % 3 = 0 THEN 'Kongens Lyngby' ELSE location END AS location, country, CASE WHEN pos % 4 = 3 THEN jd ELSE concat('Full text. ', jd) END AS jd, remote, posted_at, salary_currency, salary_min_monthly, salary_max_monthly FROM here"""


@query("multi_source_search", f"""WITH {_judged_sql(_JOBS.format(jobs=DUCK_POSTINGS), "0")}, here AS ({_HERE}), {_judged_sql(f"SELECT pos, title, company, location, country, jd, remote, posted_at, salary_currency, salary_min_monthly, salary_max_monthly FROM jobs0 WHERE remote UNION ALL {_DETAILED}")}
SELECT pos, location, left(jd, 10) AS opening, search_score FROM named WHERE reject IS NULL ORDER BY search_score DESC, posted_at DESC NULLS LAST, pos LIMIT 30""")
def multi_source_search(spark, sf_dir):
    """A local board, of which the best rows get their details, and a remote one; one board that is not there is reported and missed by no other."""
    rows = _leg(spark, sf_dir)
    keyed_rows = rows.withColumn("id", (F.col("pos") % 1000).cast("string"))
    local = keyed_rows.where("NOT remote")
    detail = F.when(F.col("pos") % 4 != 3, F.concat(F.lit("Full text. "), "jd")).otherwise("")
    details = local.select(F.col("id"), "pos", detail.alias("jd"), F.lit(None).cast("string").alias("url"), F.when(F.col("pos") % 3 == 0, "Kongens Lyngby").alias("location"), F.lit("").alias("country"), F.lit(None).cast("timestamp").alias("deadline"))
    sources = {
        "local": lambda: multisource.local_board(local, details, multisource.role_list(PROFILE.roles), NOW, PROFILE.days),
        "remote": lambda: rows.where("remote"), "gone": lambda: spark.read.schema(rows.schema).parquet(keyed.shared_folder(spark, "never-landed"))}
    gathered = observed.Gathered({name: (lambda read=read: read().withColumn("status", F.lit("ok"))) for name, read in sources.items()})
    found = multisource.results(multisource.judged(gathered.rows, PROFILE, NOW))
    return found.select("pos", "location", F.left("jd", F.lit(10)).alias("opening"), "search_score")


@query("combined_fit", f"""SELECT doc_id, score, CASE WHEN score >= 82 THEN 'STRONG FIT' WHEN score >= 68 THEN 'GOOD FIT' ELSE 'POSSIBLE FIT' END AS label FROM (SELECT doc_id, CAST(floor(0.68::DOUBLE * (n_chars % 101) + 0.32::DOUBLE * m + 0.5::DOUBLE) AS INT) AS score FROM (
  SELECT doc_id, n_chars, CASE WHEN n_chars % 6 = 0 THEN 50 ELSE greatest(35, least(98, CAST(floor(35 + 63 * (least(n_chars % 4, n_chars % 6)::DOUBLE / (n_chars % 6)::DOUBLE) + 0.5::DOUBLE) AS INT))) END AS m FROM documents))""")
def combined_fit(spark, sf_dir):
    n = F.col("n_chars")
    match = multisource.match_ratio(F.least(n % 4, n % 6), n % 6)
    rows = table(spark, sf_dir, "documents").select("doc_id", (n % 101).alias("s"), match.alias("m"))
    score, label = multisource.combined(F.col("s"), F.col("m"))
    return rows.select("doc_id", score.alias("score"), label.alias("label"))


# --- boards

_PLAIN = "regexp_replace(coalesce(text, ''), '[<>&]', ' '{g})"
_DATE = "CASE doc_id % 4 WHEN 0 THEN '2026-07-30T10:00:00Z' WHEN 1 THEN '2026-05-01T00:00:00+00:00' WHEN 2 THEN '' ELSE 'soon' END"
_DATE_S = f"CASE doc_id % 4 WHEN 0 THEN {1785405600} WHEN 1 THEN {1777593600} END"


def _built(spark, sf_dir, **columns: str) -> DataFrame:
    """The documents with columns of landed bodies, in the SQL that the twins share."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    return docs.select("*", *(F.expr(sql).alias(c) for c, sql in columns.items()))


def _body(html: str, n: str) -> str:
    return f"concat('<p>', left({html}, CAST({n} AS INT)), '</p>')"


_SHORT = _body(_PLAIN.format(g=""), "80 + doc_id % 90")
_DUCK_SHORT = _duck_clean(_body(_PLAIN.format(g=", 'g'"), "80 + doc_id % 90"))
_OK_LINK = "CASE WHEN doc_id % 7 <> 0 THEN concat('https://board.example/', CAST(doc_id AS STRING)) WHEN doc_id % 14 = 7 THEN 'https://apply.example/' ELSE NULL END"


@query("remote_ok_jobs", f"""SELECT CAST(doc_id AS VARCHAR) AS source_job_id, CASE WHEN doc_id % 6 = 0 THEN 'Employer' ELSE concat('Firm ', coalesce(source, '')) END AS company, CASE WHEN doc_id % 5 = 0 THEN 'Remote' ELSE 'Nordics' END AS location, url, body AS description, published,
  CASE WHEN coalesce(published < {NOW - 15 * 86400}, false) THEN 'old' WHEN url IS NULL THEN 'no_link' WHEN length(body) < 120 THEN 'incomplete' ELSE 'ok' END AS status
  FROM (SELECT doc_id, source, {_OK_LINK} AS url, {_DUCK_SHORT} AS body, {_DATE_S} AS published FROM documents)""")
def remote_ok_jobs(spark, sf_dir):
    return _remote_ok(spark, sf_dir).select("source_job_id", "company", "location", "url", "description", F.unix_timestamp("published_at").alias("published"), "status")


def _remote_ok(spark, sf_dir) -> DataFrame:
    rows = _built(spark, sf_dir, id="CAST(doc_id AS STRING)", date=_DATE, description=_SHORT, url="CASE WHEN doc_id % 7 <> 0 THEN concat('https://board.example/', CAST(doc_id AS STRING)) END",
                  apply_url="CASE WHEN doc_id % 14 = 7 THEN 'https://apply.example/' END", location="CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'Nordics' END",
                  company="CASE WHEN doc_id % 6 = 0 THEN '' ELSE concat('<b>Firm</b> ', coalesce(source, '')) END", position="'Lead'")
    item = F.to_json(F.struct("id", "date", "description", "url", "apply_url", "location", "company", "position"))
    return boards.remote_ok(rows.select(F.concat(F.lit('[{"legal": "notice"}, '), item, F.lit("]")).alias("body")), NOW, 14)


@query("jobnet_jobs", f"""SELECT CAST(doc_id AS VARCHAR) AS source_job_id, CASE WHEN doc_id % 3 = 0 THEN 'Later title' ELSE 'First title' END AS title, CASE WHEN doc_id % 4 = 3 OR doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Aarhus' ELSE 'Denmark' END ELSE 'Lyngby 2800' END AS location,
  CASE WHEN doc_id % 3 = 1 THEN 'permanent' ELSE 'unknown' END AS employment_type, CASE WHEN doc_id % 4 = 3 THEN '' ELSE {_DUCK_SHORT} END AS description,
  CASE WHEN doc_id % 4 <> 3 AND doc_id % 2 = 0 THEN 'https://firm.example/apply' ELSE 'https://jobnet.dk/find-job' END AS url, CASE WHEN doc_id % 4 <> 3 THEN 1788220799 END AS deadline,
  CASE WHEN doc_id % 4 = 3 OR length({_DUCK_SHORT}) < 120 THEN 'incomplete' ELSE 'ok' END AS status FROM documents WHERE doc_id % 4 <> 1 AND doc_id IS NOT NULL""")
def jobnet_jobs(spark, sf_dir):
    rows = _built(spark, sf_dir, jobAdId="CAST(doc_id AS STRING)", publicationDate=_DATE, municipality="CASE WHEN doc_id % 2 = 0 THEN 'Aarhus' END", employmentDurationType="CASE WHEN doc_id % 3 = 1 THEN 'Permanent' ELSE 'Other' END")
    ad = lambda title: F.to_json(F.struct(F.array(F.struct("jobAdId", F.lit(title).alias("title"), "publicationDate", "municipality", "employmentDurationType")).alias("jobAds")))
    searches = rows.select(F.lit(1).alias("pos"), ad("First title").alias("body")).unionByName(rows.where("doc_id % 3 = 0").select(F.lit(2).alias("pos"), ad("Later title").alias("body")))
    found = _built(spark, sf_dir, body=_SHORT, address="CASE WHEN doc_id % 5 <> 0 THEN named_struct('city', 'Lyngby', 'postalCode', '2800') END",
                   application="named_struct('url', CASE WHEN doc_id % 2 = 0 THEN 'https://firm.example/apply' ELSE 'mailto:me' END, 'deadlineDate', '2026-08-31T23:59:59Z')")
    details = found.where("doc_id % 4 <> 3").select(F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct("body", F.struct("address").alias("job"), "application")).alias("body"))
    out = boards.jobnet(searches, details, NOW, 14)
    return out.select("source_job_id", "title", "location", "employment_type", F.coalesce("description", F.lit("")).alias("description"), "url", F.unix_timestamp("deadline").alias("deadline"), "status")


@query("hub_jobs", f"""SELECT CAST(doc_id AS VARCHAR) AS source_job_id, concat('Lead ', coalesce(lang, '')) AS title, CASE doc_id % 3 WHEN 0 THEN concat('Firm ', coalesce(source, '')) WHEN 1 THEN 'Plain Firm' ELSE 'Employer' END AS company,
  CASE doc_id % 3 WHEN 0 THEN 'Aarhus Denmark' WHEN 1 THEN 'Remote, Denmark' ELSE 'Denmark' END AS location, CASE WHEN doc_id % 3 = 1 THEN 'remote' ELSE 'unknown' END AS remote_type, {_DUCK_SHORT} AS description,
  CASE WHEN doc_id % 5 = 0 THEN 'no_link' WHEN length({_DUCK_SHORT}) < 120 THEN 'incomplete' ELSE 'ok' END AS status FROM documents""")
def hub_jobs(spark, sf_dir):
    return _hub(spark, sf_dir).select("source_job_id", "title", "company", "location", "remote_type", "description", "status")


def _hub(spark, sf_dir) -> DataFrame:
    rows = _built(spark, sf_dir, d=_SHORT, t="concat('Lead ', coalesce(lang, ''))", u="CASE WHEN doc_id % 5 <> 0 THEN 'https://hub.example/x' END")
    one = F.to_json(F.struct(F.col("doc_id").alias("id"), F.col("t").alias("title"), F.struct(F.concat(F.lit("Firm "), F.coalesce("source", F.lit(""))).alias("name")).alias("company"), F.expr("named_struct('city', 'Aarhus', 'country', 'Denmark')").alias("location"), F.col("d").alias("description"), F.col("u").alias("url")))
    two = F.to_json(F.struct(F.col("doc_id").cast("string").alias("_id"), F.col("t").alias("jobTitle"), F.lit("Plain Firm").alias("startup"), F.lit("Remote, Denmark").alias("jobLocation"), F.col("d").alias("content"), F.col("u").alias("link")))
    three = F.to_json(F.struct(F.col("doc_id").cast("string").alias("uuid"), F.col("t").alias("position"), F.lit("").alias("location"), F.col("d").alias("text"), F.col("u").alias("applyUrl")))
    kind = F.col("doc_id") % 3
    body = (F.when(kind == 0, F.concat(F.lit('{"meta": [1, 2], "data": {"items": ['), one, F.lit("]}}"))).when(kind == 1, F.concat(F.lit('[["x"], ['), two, F.lit("]]"))).otherwise(F.concat(F.lit("["), three, F.lit("]"))))
    return boards.the_hub(rows.select(body.alias("body")).unionByName(spark.createDataFrame([("not json",), (None,)], "body string")))


_PAY = ("DKK 480,000 - 600,000 per annum", "50,000 DKK", "€60k - 70000 EUR", "competitive", "$100,000")


@query("remote_salaries", """SELECT 'remotive' AS source, CAST(doc_id AS VARCHAR) AS id, CASE doc_id % 5 WHEN 0 THEN 'DKK' WHEN 1 THEN 'DKK' WHEN 2 THEN 'EUR' WHEN 4 THEN 'USD' END AS currency,
  CASE doc_id % 5 WHEN 0 THEN 40000.0::DOUBLE WHEN 1 THEN 50000.0::DOUBLE END AS low, CASE doc_id % 5 WHEN 0 THEN 50000.0::DOUBLE WHEN 1 THEN 50000.0::DOUBLE END AS high FROM documents
UNION ALL SELECT 'jobicy', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 2 = 0 THEN 'DKK' ELSE 'USD' END, CASE WHEN doc_id % 2 = 0 THEN n_chars::DOUBLE * CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE / 12 WHEN 1 THEN 160 ELSE 1 END END, NULL FROM documents""")
def remote_salaries(spark, sf_dir):
    pay = F.array(*map(F.lit, _PAY))
    rows = _built(spark, sf_dir, id="CAST(doc_id AS STRING)", salaryCurrency="CASE WHEN doc_id % 2 = 0 THEN 'DKK' ELSE 'USD' END", salaryMin="n_chars", salaryPeriod="CASE doc_id % 3 WHEN 0 THEN 'Yearly' WHEN 1 THEN 'per hour' ELSE 'month' END")
    one = boards.remotive(rows.select(F.to_json(F.struct(F.array(F.struct("id", F.get(pay, (F.col("doc_id") % 5).cast("int")).alias("salary"))).alias("jobs"))).alias("body")))
    two = boards.jobicy(rows.select(F.to_json(F.struct(F.array(F.struct("id", "salaryCurrency", "salaryMin", "salaryPeriod")).alias("jobs"))).alias("body")))
    both = one.unionByName(two)
    return both.select("source", F.col("source_job_id").alias("id"), F.col("salary_currency").alias("currency"), F.col("salary_min_monthly").alias("low"), F.col("salary_max_monthly").alias("high"))


@query("rss_items", f"""SELECT link AS url, CASE doc_id % 3 WHEN 0 THEN concat('Firm ', coalesce(source, '')) WHEN 1 THEN 'Creator' ELSE 'Employer' END AS company, CASE doc_id % 3 WHEN 0 THEN 'Lead: Platform' WHEN 1 THEN 'Firm: Lead' ELSE 'Lead' END AS title, published,
  CASE WHEN coalesce(published < {NOW - 15 * 86400}, false) THEN 'old' WHEN length({_DUCK_SHORT}) < 80 THEN 'incomplete' ELSE 'ok' END AS status
  FROM (SELECT *, concat('https://feed.example/', CAST(doc_id AS VARCHAR)) AS link, CASE doc_id % 3 WHEN 0 THEN 1785405600 WHEN 1 THEN 1777593600 END AS published FROM documents)""")
def rss_items(spark, sf_dir):
    return _feed(spark, sf_dir).select("url", "company", "title", F.unix_timestamp("published_at").alias("published"), "status")


def _feed(spark, sf_dir) -> DataFrame:
    rows = _built(spark, sf_dir, link="concat('https://feed.example/', CAST(doc_id AS STRING))", title="CASE doc_id % 3 WHEN 0 THEN concat('Firm ', coalesce(source, ''), ': Lead: Platform') WHEN 1 THEN 'Firm: Lead' ELSE 'Lead' END",
                  description=_SHORT, pubDate="CASE doc_id % 3 WHEN 0 THEN 'Thu, 30 Jul 2026 10:00:00 +0000' WHEN 1 THEN 'Fri, 1 May 2026 02:00:00 +0200' ELSE 'never' END", creator="CASE WHEN doc_id % 3 = 1 THEN 'Creator' END", guid="''")
    return boards.feed(rows, NOW, 14)


def _counters_of(source: str, oracle: str) -> str:
    statuses = ", ".join(f"count_if(coalesce(status = '{s}', false))::BIGINT AS {s}" for s in observed.STATUSES)
    return f"SELECT '{source}' AS source, count(*) AS rows, {statuses} FROM ({oracle})"


_BOARDS = " UNION ALL ".join(_counters_of(source, ORACLE[name]) for source, name in (("Remote OK", "remote_ok_jobs"), ("The Hub", "hub_jobs"), ("We Work Remotely", "rss_items")))


@query("source_counters", f"""SELECT *, CASE WHEN rows = ok THEN NULL WHEN ok = 0 THEN 'nothing could be used' ELSE concat(CAST(rows - ok AS VARCHAR), ' of ', CAST(rows AS VARCHAR), ' could not be used') END AS warning FROM ({_BOARDS})
UNION ALL SELECT 'Gone', 0, {', '.join('0' for _ in observed.STATUSES)}, 'unavailable'""")
def source_counters(spark, sf_dir):
    """Three boards and one whose bodies never landed, gathered and written in one pass."""
    gathered = observed.Gathered({
        "Remote OK": lambda: _remote_ok(spark, sf_dir), "The Hub": lambda: _hub(spark, sf_dir), "We Work Remotely": lambda: _feed(spark, sf_dir),
        "Gone": lambda: boards.remote_ok(spark.read.schema("body string").parquet(keyed.shared_folder(spark, "never-landed")), NOW, 14)})
    gathered.rows.write.parquet(keyed.shared_folder(spark, "gathered"))
    told = gathered.counters(spark)
    return told.withColumn("warning", F.when(F.col("source") == "Gone", F.when(F.col("warning").isNotNull(), "unavailable")).otherwise(F.col("warning")))


_LANDED_AT = "CASE page_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE concat('2026-07-', CAST(10 + page_id % 20 AS STRING), 'T06:00:00Z') END"


@query("landed_pages", """SELECT page_id, length(html) AS chars FROM pages WHERE page_id % 5 > 1 AND page_id % 2 = 0 AND 10 + page_id % 20 >= 15""")
def landed_pages(spark, sf_dir):
    """Pages as ingestion lands them, read through the data source: board and freshness reach its listing."""
    pages = table(spark, sf_dir, "pages").where("page_id IS NOT NULL AND html IS NOT NULL")
    board = F.when(F.col("page_id") % 2 == 0, "even").otherwise("odd")
    folder = keyed.shared_folder(spark, "landed")
    landed.land(pages.select(board.alias("board"), F.col("page_id").cast("string").alias("id"), F.expr(_LANDED_AT).alias("at"), F.col("html").alias("body")), folder)
    rows = landed.landed(spark, folder).where((F.col("board") == "even") & (F.col("published_at") >= F.lit("2026-07-15").cast("timestamp")))
    return rows.select(F.col("id").cast("long").alias("page_id"), F.length("body").alias("chars"))


_CARD = """concat('<li class="x"><a class="c" href="https://www.board.example/jobs/view/lead-', CAST(1000000 + doc_id + {k} AS STRING), '?refId=1">go</a><h3 class="a base-search-card__title b"> Lead {k} &amp; ', coalesce(lang, ''), ' </h3><h4 class="base-search-card__subtitle">',
  coalesce(source, ''), '</h4><span class="job-search-card__location">Lyngby</span>', CASE WHEN doc_id % 2 = 0 THEN '<time class="t" datetime="2026-07-30">2 days ago</time>' ELSE '' END, '</li>')"""
_CARDS = f"""CASE WHEN doc_id % 11 = 0 THEN '<html>Please solve the CAPTCHA</html>' WHEN doc_id % 13 = 0 THEN '<div><a href="/jobs/view/1234567">x</a></div>' WHEN doc_id % 17 = 0 THEN NULL
  ELSE concat('<ul>', {_CARD.format(k=0)}, '<li>no link</li>', {_CARD.format(k=1)}, CASE WHEN doc_id % 3 = 0 THEN replace({_CARD.format(k=0)}, 'Lead 0', 'Lead again') ELSE '' END, '</ul>') END"""


def _cards_sql(last: bool) -> str:
    return f"""SELECT doc_id, CAST(1000000 + doc_id + k AS VARCHAR) AS job_id, concat('Lead ', CASE WHEN {str(last).lower()} AND k = 0 AND doc_id % 3 = 0 THEN 'again' ELSE CAST(k AS VARCHAR) END, ' & ', coalesce(lang, '')) AS title, trim(coalesce(source, '')) AS company, CASE WHEN doc_id % 2 = 0 THEN '2026-07-30' END AS published, 'ok' AS status
  FROM documents, (VALUES (0), (1)) v(k) WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0
UNION ALL SELECT doc_id, NULL, NULL, NULL, NULL, CASE WHEN doc_id % 11 = 0 THEN 'wall' ELSE 'unreadable' END FROM documents WHERE doc_id % 11 = 0 OR doc_id % 13 = 0"""


def _cards(last: bool):
    def run(spark, sf_dir):
        out = boards.search_cards(_built(spark, sf_dir, html=_CARDS), ["doc_id"], "html", last)
        return out.select("doc_id", "job_id", F.trim("title").alias("title"), "company", "published", "status")

    return run


query("search_cards", _cards_sql(False))(_cards(False))
query("search_cards_last", _cards_sql(True))(_cards(True))

_LONG = "left({plain}, CAST(250 + doc_id % 300 AS INT))"
_CLOSED_TEXT = "CASE WHEN doc_id % 9 = 0 THEN '<b>No longer accepting applications</b>' ELSE '' END"
_PLACES = "CASE doc_id % 3 WHEN 0 THEN 'Lyngby, Denmark / Aarhus, Denmark' WHEN 1 THEN 'Lyngby, Capital, Denmark' ELSE 'Row place' END"


@query("detail_pages", f"""WITH t AS (SELECT *, {_duck_lines(_LONG.format(plain=_PLAIN.format(g=", 'g'")))} AS body FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 < 3 THEN concat('Lead ', coalesce(source, '')) ELSE concat('Row ', coalesce(source, '')) END AS title, CASE WHEN doc_id % 4 < 3 THEN {_PLACES} ELSE 'Row place' END AS location,
  CASE WHEN doc_id % 4 < 3 AND doc_id % 3 < 2 THEN 'Denmark' ELSE '' END AS country, body AS description, CASE WHEN doc_id % 4 < 3 THEN CASE WHEN doc_id % 5 = 0 THEN 1784073600 WHEN doc_id % 5 = 1 THEN 1788220799 END END AS deadline,
  CASE WHEN doc_id % 19 = 0 THEN 'wall' WHEN length(body) < 350 THEN 'incomplete' WHEN doc_id % 9 = 0 OR (doc_id % 4 < 3 AND doc_id % 5 = 0) THEN 'closed' ELSE 'ok' END AS status FROM t""")
def detail_pages(spark, sf_dir):
    rows = _built(spark, sf_dir, title="concat('Lead ', coalesce(source, ''))", description=_LONG.format(plain=_PLAIN.format(g="")), validThrough="CASE doc_id % 5 WHEN 0 THEN '2026-07-15T00:00:00Z' WHEN 1 THEN '2026-08-31T23:59:59Z' END", notice=_CLOSED_TEXT)
    place = lambda *parts: F.expr("named_struct('address', named_struct(" + ", ".join(f"'{k}', {v}" for k, v in parts) + "))")
    here, there = place(("addressLocality", "'Lyngby'"), ("addressCountry", "named_struct('name', 'Denmark')")), place(("addressLocality", "'Aarhus'"), ("addressCountry", "named_struct('name', 'Denmark')"))
    whole = place(("addressLocality", "'Lyngby'"), ("addressRegion", "'Capital'"), ("addressCountry", "'Denmark'"))
    kind, shape = F.col("doc_id") % 3, F.col("doc_id") % 4
    json = lambda *more: F.to_json(F.struct(F.lit("JobPosting").alias("@type"), "title", "description", "validThrough", *more))
    item = F.when(kind == 0, json(F.array(here, there, here).alias("jobLocation"))).when(kind == 1, json(whole.alias("jobLocation"))).otherwise(json())
    item = F.when(shape == 0, item).when(shape == 1, F.concat(F.lit('[{"@type": "Thing"}, '), item, F.lit("]"))).otherwise(F.concat(F.lit('{"@graph": ['), item, F.lit("]}")))
    script = F.concat(F.lit('<script type="application/ld+json">{bad</script><script data-x="1" type="application/ld+json"> '), item, F.lit("</script>"))
    held = F.concat(F.lit('<div class="a show-more-less-html__markup b">'), "description", F.lit("</div>"))
    wall = F.when(F.col("doc_id") % 19 == 0, "authwall").otherwise("")
    html = F.concat(F.lit("<html>"), wall, "notice", F.when(shape < 3, script).otherwise(held), F.lit("</html>"))
    pages = rows.select("doc_id", html.alias("html"), F.concat(F.lit("Row "), F.coalesce("source", F.lit(""))).alias("row_title"), F.lit("Row place").alias("row_location"))
    out = boards.detail_pages(pages, ["doc_id"], "html", NOW)
    return out.select("doc_id", "title", "location", "country", "description", F.unix_timestamp("deadline").alias("deadline"), "status")


@query("coverage_status", """SELECT source, count(*) AS requests, count(*) FILTER (WHERE n_chars % 7 = 0) AS failures, count(*) FILTER (WHERE n_chars % 7 <> 0 AND n_chars < 300) AS incomplete,
  CASE WHEN count(*) FILTER (WHERE n_chars % 7 = 0) > 0 AND count(*) FILTER (WHERE n_chars % 7 <> 0 AND n_chars >= 300) = 0 THEN 'ACCESS LIMITED' WHEN count(*) FILTER (WHERE n_chars % 7 <> 0 AND n_chars >= 300) > 0 THEN 'SEARCHED' ELSE 'NO RELEVANT RESULTS' END AS coverage
  FROM documents GROUP BY source""")
def coverage_status(spark, sf_dir):
    status = F.when(F.col("n_chars") % 7 == 0, "failed").when(F.col("n_chars") < 300, "incomplete").when(F.col("n_chars").isNotNull(), "ok")
    return boards.coverage(table(spark, sf_dir, "documents").select("source", status.alias("status")), "source")


# --- records


@query("inferred_skills", "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(lower(coalesce(text, '')), {duck.text(s.lower())}) THEN {duck.text(s)} END" for s in records.SKILLS) + "], lambda s: s IS NOT NULL), ',') AS skills FROM documents")
def inferred_skills(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(records.inferred_skills(F.col("text")), ",").alias("skills"))


@query("stored_source_cvs", """SELECT doc_id, length(trim(coalesce(text, ''), ' ')) AS chars, CASE WHEN doc_id % 5 <> 0 AND trim(coalesce(source, '')) <> '' AND length(trim(coalesce(text, ''), ' ')) >= 100 THEN 'ready' ELSE 'needs-reupload' END AS status FROM documents""")
def stored_source_cvs(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, " cv.pdf ").alias("file_name"), F.lit(None).cast("string").alias("file_type"), F.lit("12").alias("file_size"), F.col("source").alias("source_version"), F.col("text").alias("cv_text"),
                                                   F.lit(None).cast("int").alias("chars"), *(F.lit(None).cast("string").alias(c) for c in ("summary", "preview", "parsed_at")))
    return records.stored_cv(rows).select("doc_id", "chars", "status")


@query("decisions_after_updates", """WITH u AS (SELECT user_id AS job_key, event_id % 5 AS change_id, CASE WHEN event_type = 'purchase' THEN 'clear' WHEN event_id % 3 = 0 THEN 'accept' ELSE 'set' END AS kind, event_type AS value, event_id AS tick FROM events),
c AS (SELECT job_key, max(tick) AS cleared FROM u WHERE kind = 'clear' GROUP BY 1),
s AS (SELECT job_key, change_id, arg_max(CASE WHEN kind = 'accept' THEN 'accepted' ELSE value END, tick) AS value, max(tick) AS tick FROM u WHERE kind <> 'clear' GROUP BY 1, 2)
SELECT s.job_key, s.change_id, s.value FROM s LEFT JOIN c USING (job_key) WHERE cleared IS NULL OR s.tick > cleared""")
def decisions_after_updates(spark, sf_dir):
    updates = _updates(spark, sf_dir)
    return records.decided(updates.select("job_key", "change_id", "value").limit(0), updates)


def _updates(spark, sf_dir) -> DataFrame:
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "clear").when(F.col("event_id") % 3 == 0, "accept").otherwise("set")
    return events.select(F.col("user_id").alias("job_key"), (F.col("event_id") % 5).alias("change_id"), kind.alias("kind"), F.col("event_type").alias("value"), F.col("event_id").alias("at"))


@query("decision_log", ORACLE["decisions_after_updates"])
def decision_log(spark, sf_dir):
    """The same through the change log: a commit for each fifth of the updates, in order, and merges where a tier is full."""
    updates = _updates(spark, sf_dir)
    log = ChangeLog(spark, keyed.shared_folder(spark, "decisions"), "string", 8)
    span = updates.agg(F.min("at").alias("low"), F.max("at").alias("high")).first()
    part = F.floor((F.col("at") - (span["low"] or 0)) * 5 / ((span["high"] or 0) - (span["low"] or 0) + 1))
    for i in range(5):
        log.commit(records.as_changes(updates.where(part == i)), 2 * i)
        log.merge(2 * i + 1)
    kinds = updates.select("job_key", "change_id").schema
    return log.current().select(F.col("owner").cast(kinds["job_key"].dataType).alias("job_key"), F.col("item").cast(kinds["change_id"].dataType).alias("change_id"), "value")


# --- reviews

_PICKED = """WITH c AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS INT) AS i, CAST(l_quantity AS INT) AS words, CAST(l_partkey % 13 + 1 AS INT) AS score, l_returnflag = 'R' AS proof, concat(l_linestatus, CAST(l_suppkey % 4 AS VARCHAR)) AS req, CAST(l_partkey % 3 AS VARCHAR) AS term FROM lineitem),
g AS (SELECT l_orderkey, list({'i': i, 'words': words, 'score': score, 'proof': proof, 'req': req, 'term': term} ORDER BY i) AS cs FROM c GROUP BY l_orderkey),
m AS (SELECT l_orderkey, cs, unnest(range(1, CAST(pow(2, len(cs)) AS BIGINT))) AS mask FROM g),
p AS (SELECT l_orderkey, cs, list_filter(cs, lambda x: (mask >> x.i) & 1 = 1) AS picked FROM m WHERE bit_count(mask) <= 4),
s AS (SELECT *, 40 + list_sum(list_transform(picked, lambda x: x.words)) AS words, len(list_distinct(list_transform(picked, lambda x: x.req))) AS kinds, len(list_distinct(list_transform(picked, lambda x: x.term))) AS terms,
  len(list_filter(picked, lambda x: x.proof)) > 0 AS proven, len(list_filter(cs, lambda x: x.proof)) > 0 AS asked FROM p),
f AS (SELECT *, (list_sum(list_transform(picked, lambda x: x.score)) + kinds * 8 + terms * 2 + CASE WHEN proven THEN 4 ELSE 0 END - (len(picked) - kinds) * 2)::DOUBLE
  + CASE WHEN words >= 90 THEN 24::DOUBLE - abs(105 - words)::DOUBLE * 0.35::DOUBLE ELSE -((90 - words)::DOUBLE * 0.45::DOUBLE) END - greatest(0, len(picked) - 3)::DOUBLE * 8 AS score,
  CASE WHEN proven OR NOT asked THEN CASE WHEN len(picked) >= least(2, len(cs)) THEN 0 ELSE 1 END ELSE 2 END AS pool FROM s WHERE words <= 120)
SELECT l_orderkey, array_to_string(list_transform(picked, lambda x: x.i), ',') AS picked FROM f QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY pool, score DESC, list_transform(picked, lambda x: x.i)) = 1"""


@query("summary_combos", _PICKED)
def summary_combos(spark, sf_dir):
    """The choice among combinations of sentences, with an order's lines in their place: words, score, proof, a requirement and a term each."""
    lines = table(spark, sf_dir, "lineitem")
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    one = F.struct(at.alias("i"), (F.col("l_partkey") % 13 + 1).cast("int").alias("score"), F.col("l_quantity").cast("int").alias("words"), (F.col("l_returnflag") == "R").alias("proof"), F.array(F.concat("l_linestatus", (F.col("l_suppkey") % 4).cast("string"))).alias("reqs"), F.array((F.col("l_partkey") % 3).cast("string")).alias("terms"))
    orders = lines.select("l_orderkey", one.alias("c")).groupBy("l_orderkey").agg(F.collect_list("c").alias("cs"))
    picked = review.picked_sentences(F.col("cs"), F.lit(40))
    # fenced, so that the choice is not made again to filter on it
    return observed.fenced(orders.select("l_orderkey", F.array_join(picked, ",").alias("picked"))).where("picked <> ''")


_CV = """concat('Jo Doe', chr(10), CASE WHEN doc_id % 4 = 3 THEN 'Tel 12345678' ELSE 'Profile' END, chr(10), 'Senior project lead ', left(regexp_replace(coalesce(lang, ''), '[^a-z]', ''), 9), ' with a record of delivery across many markets.', chr(10), 'Second line.', chr(10),
  CASE WHEN doc_id % 5 = 4 THEN 'Other' ELSE 'Experience' END, chr(10), 'Lead | Firm | 2019 - now')"""


@query("cv_summaries", f"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN concat('Senior project lead ', left(regexp_replace(coalesce(lang, ''), '[^a-z]', '', 'g'), 9), ' with a record of delivery across many markets.')
  WHEN doc_id % 5 = 4 THEN '' ELSE concat('Senior project lead ', left(regexp_replace(coalesce(lang, ''), '[^a-z]', '', 'g'), 9), ' with a record of delivery across many markets. Second line.') END AS summary FROM documents""")
def cv_summaries(spark, sf_dir):
    return _built(spark, sf_dir, cv=_CV).select("doc_id", review.summary_of(F.col("cv")).alias("summary"))
