"""Queries of employers, records, responses and the searched flow, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import company, records, review
from lodestone.plans import duck, flow
from lodestone.plans.board_queries import _CARDS, _PLAIN, _any, _basic, _built
from lodestone.plans.queries import DUCK_POSTINGS, _duck_catalog, _duck_clean, _duck_lines, query
from lodestone.sources.postings import CV, NOW, postings, table

# --- employers

_DANISH, _DOMAIN = _any(_basic("description"), *records.DANISH), _any(_basic("description"), *records.DOMAINS)


@query("employer_screening", f"""SELECT pos, {_any(_basic('title'), *records.PROFESSIONS)} AS profession, CASE WHEN {_DANISH} THEN 'Mandatory Danish' WHEN {_DOMAIN} THEN 'Excluded role/domain' END AS rejected FROM ({DUCK_POSTINGS})""")
def employer_screening(spark, sf_dir):
    """Whether a posting's title names a profession that is sought, and why its description is out."""
    return postings(spark, sf_dir).select("pos", records.profession(F.col("title")).alias("profession"), records.description_rejected(F.col("description")).alias("rejected"))


@query("employee_counts", """SELECT user_id, arg_max(CASE event_type WHEN 'view' THEN n WHEN 'click' THEN n + 9 ELSE n - 5 END, ts) FILTER (WHERE CASE event_type WHEN 'view' THEN n >= 0 WHEN 'click' THEN true ELSE n >= 5 END) AS employees
FROM (SELECT *, CAST(floor(value) AS BIGINT) AS n FROM events) GROUP BY user_id""")
def employee_counts(spark, sf_dir):
    """Each user's newest event that gives a count, an upper or a lower bound."""
    n, kind = F.floor("value").cast("long"), F.col("event_type")
    record = F.struct(F.when(kind == "view", n).alias("count"), F.when(~kind.isin("view", "click"), n - 5).alias("low"), F.when(kind == "click", n + 9).alias("high"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    users = table(spark, sf_dir, "events").select("user_id", record.alias("r")).groupBy("user_id").agg(F.collect_list("r").alias("rs"))
    return users.select("user_id", records.employees(F.col("rs")).alias("employees"))


_MARK = "(the|de|la|en|el)"


@query("site_links", f"""WITH tags AS (SELECT page_id, url, generate_subscripts(t, 1) AS i, unnest(t) AS tag FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\b[^>]*href=["''][^"'']+["''][^>]*>.*?</a>') AS t FROM pages)),
links AS (SELECT page_id, i, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_extract(tag, '(?is)href=["'']([^"'']+)["'']', 1) AS link, {_duck_clean("regexp_extract(tag, '(?is)^<a[^>]*>(.*?)</a>', 1)")} AS label FROM tags),
named AS (SELECT page_id, link, min(i) AS i, arg_min(label, i) AS label FROM links WHERE regexp_matches(label || ' ' || link, '(?i){_MARK}') GROUP BY ALL)
SELECT page_id, link AS url, label FROM named QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY i) <= 8""")
def site_links(spark, sf_dir):
    """The first eight links of each page that name one of some common words: career_links() with words that these pages have."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return company.site_links(pages, "page_id", "url", "html", lambda label, url: F.concat_ws(" ", label, url).rlike("(?i)" + _MARK), company.MOST_CAREER_LINKS).select("page_id", "url", "label")


@query("full_descriptions", f"SELECT page_id, CASE WHEN length(body) >= 500 THEN left(body, 30000) ELSE '' END AS description FROM (SELECT page_id, {_duck_clean('html')} AS body FROM pages)")
def full_descriptions(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", company.full_description(F.col("html")).alias("description"))


# --- records


@query("request_days", "SELECT doc_id, CASE WHEN n_chars IN (1, 3, 7, 14) THEN n_chars ELSE 7 END AS web, greatest(1, least(30, CASE WHEN coalesce(n_chars, 0) <> 0 THEN n_chars ELSE 7 END)) AS service FROM documents")
def request_days(spark, sf_dir):
    n = F.col("n_chars")
    return table(spark, sf_dir, "documents").select("doc_id", *(records.request_days(n, p).cast("long").alias(p) for p in ("web", "service")))


@query("profile_completion", """SELECT c_custkey, CAST(floor((CAST(coalesce(c_acctbal > 0, false) AS INT) + CAST(coalesce(c_nationkey % 2 = 0, false) AS INT) + CAST(coalesce(c_name <> '', false) AS INT)) / 3.0::DOUBLE * 100 + 0.5) AS INT) AS completion FROM customer""")
def profile_completion(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", records.completion(F.col("c_acctbal") > 0, F.col("c_nationkey") % 2 == 0, F.col("c_name") != "").alias("completion"))


@query("distinct_reasons", "SELECT user_id, array_to_string(list(event_type ORDER BY first)[1:7], ',') AS reasons FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def distinct_reasons(spark, sf_dir):
    """Each user's kinds of events in the order in which they first came."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"))
    listed = first.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("first", "event_type"))).alias("x"))
    return listed.select("user_id", F.array_join(records.distinct_reasons(F.col("x.event_type")), ",").alias("reasons"))


# --- responses


@query("response_texts", "SELECT doc_id, CASE doc_id % 3 WHEN 2 THEN '' ELSE trim(coalesce(text, '')) END AS text FROM documents")
def response_texts(spark, sf_dir):
    """Every text as a model's response, in one field, in a part of its output, or not at all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    part = F.array(F.struct(F.array(F.struct(F.lit("reasoning").alias("type"), F.lit("no").alias("text")), F.struct(F.lit("output_text").alias("type"), "text")).alias("content")))
    kind = F.col("doc_id") % 3
    body = F.when(kind == 0, F.to_json(F.struct(F.col("text").alias("output_text")))).when(kind == 1, F.to_json(F.struct(part.alias("output")))).otherwise("{broken")
    return docs.select("doc_id", records.response_text(body).alias("text"))


@query("lenient_json", "SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE coalesce(text, '') END AS text FROM documents")
def lenient_json(spark, sf_dir):
    """Every text as a value of JSON that stands alone, in a fenced block, between other words, or is broken."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("t"))).alias("json"))
    fence, kind = F.lit("```"), F.col("doc_id") % 4
    body = F.when(kind == 0, F.col("json")).when(kind == 1, F.concat(F.lit("Here: "), fence, F.lit("json\n"), "json", F.lit("\n"), fence)).when(kind == 2, F.concat(F.lit("So "), "json", F.lit(" it is"))).otherwise(F.expr("left(json, length(json) - 1)"))
    return docs.select("doc_id", F.try_variant_get(records.lenient_json(body), "$.t", "string").alias("text"))


_LETTERS = "trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' '{g}))"
#: What a model makes of a fact: shortened by half, with a number of its own, hardly changed, or in other words.
_UPDATED = """CASE doc_id % 4 WHEN 0 THEN left(fact, CAST(floor(length(fact) * 0.5) AS INT)) WHEN 1 THEN concat(fact, ' in 777 days') WHEN 2 THEN concat(fact, ' too')
  ELSE concat('delivered measurable results, namely ', trim(substr(fact, 21))) END"""
_WORDS = "list_distinct(regexp_extract_all({x}, '[a-z0-9][a-z0-9+.#/-]{{2,}}'))"
_A, _B = _WORDS.format(x="original"), _WORDS.format(x="updated")


@query("accepted_changes", f"""WITH facts AS (SELECT doc_id, trim(left({_LETTERS.format(g=", 'g'")}, CAST(60 + doc_id % 140 AS INT))) AS fact FROM documents),
made AS (SELECT doc_id, fact AS original, trim({_UPDATED}) AS updated FROM facts WHERE length(fact) >= 30),
judged AS (SELECT *, len(list_intersect({_A}, {_B})) AS shared, len(list_distinct(list_concat({_A}, {_B}))) AS either, len(list_filter({_B}, lambda w: NOT list_contains({_A}, w) AND w IN ('delivered', 'measurable'))) AS fresh FROM made)
SELECT doc_id, original, updated || '.' AS updated FROM judged WHERE doc_id % 4 <> 1 AND updated <> '' AND original <> updated AND length(updated) >= greatest(35, length(original) * 0.55::DOUBLE) AND length(updated) <= length(original) * 1.8::DOUBLE
  AND (CASE WHEN either = 0 THEN 1.0 ELSE shared::DOUBLE / either END < 0.88::DOUBLE OR fresh >= 2)""")
def accepted_changes(spark, sf_dir):
    """Of every document a fact and a model's answer about it, in a fenced block: the changes that are grounded and mean something."""
    rows = _built(spark, sf_dir, clean=_LETTERS.format(g="")).withColumn("fact", F.trim(F.expr("left(clean, CAST(60 + doc_id % 140 AS INT))"))).withColumn("updated", F.expr(_UPDATED))
    change = F.struct(F.lit("FACT-001").alias("sourceId"), "updated", F.lit("").alias("why"), F.array(F.lit("delivery")).alias("termsAligned"))
    unknown = F.struct(F.lit("FACT-009").alias("sourceId"), "updated", F.lit("").alias("why"), F.array(F.lit("delivery")).alias("termsAligned"))
    body = F.concat(F.lit("Sure:\n```json\n"), F.to_json(F.struct(F.array(unknown, change).alias("changes"))), F.lit("\n```"))
    responses = rows.select("doc_id", F.lit("measurable work is delivered").alias("jd"), body.alias("body"))
    facts = rows.select("doc_id", F.lit("FACT-001").alias("fact_id"), "fact", F.lit(1).alias("number"))
    return records.accepted_changes(responses, facts, ["doc_id"]).select("doc_id", "original", "updated")


# --- rewrites of facts

#: What is put before a text, so that each rewrite has something to do.
_OPENINGS = (
    "Led the delivery of tools, worked closely with teams in order to help", "Managed integration and vendor dependencies in the delivery lifecycle", "Owned release readiness and production cutover",
    "Ran international project teams across Denmark and India", "Kept risks, dependencies; risk, dependencies", "Drove program delivery governance helping to maintain scope", "Programme backlog governance and regulatory reporting",
    "Agile/Hybrid execution of a full lifecycle", "release readiness for go-live , delivery risks and dependencies", "Handled API integration and dependency risk in distributed international teams",
)
_OPENED = "concat(" + duck.cases([(f"doc_id % {len(_OPENINGS)} = {i}", duck.text(o)) for i, o in enumerate(_OPENINGS)]) + ", ' ', {letters})"


def _rewrites_sql() -> str:
    """The rewrites of bullets one after the other, each a step over the rows that the last has left."""
    has = lambda *regexes: " AND ".join(f"regexp_matches(text, {duck.text('(?is)' + r)})" for r in regexes)
    no = lambda regex: f"NOT {has(regex)}"
    by = lambda regex, to, of="text": f"regexp_replace({of}, {duck.text(regex)}, {duck.text(to)}, 'i')"
    programme = r"\b(programme|program)\b"
    abroad = f"(({has('denmark.*india|india.*poland')}) AND {has('international (project |engineering )?teams?')})"
    steps = {
        "end_to_end": ((f"{has('delivery lifecycle')} AND {no('end[- ]to[- ]end')}", by("delivery lifecycle", "end-to-end delivery lifecycle")), (f"{has('full lifecycle')} AND {no('end[- ]to[- ]end')}", by("full lifecycle", "end-to-end lifecycle"))),
        "distributed": ((f"{abroad} AND {has('international (project |engineering )?teams')} AND {no('distributed')}", by("(international (project |engineering )?teams)", "distributed \\1")),),
        "release": ((has("release readiness for go-live"), by("release readiness for go-live", "release and go-live readiness")), (f"{has('release readiness', 'go-live|rfs|production')} AND {no('release and go-live readiness')}", by("release readiness", "release and go-live readiness"))),
        "risk_dependency": ((has("risk,? dependenc(y|ies)"), by("risk,? dependenc(y|ies)", "risk and dependency management")), (has("delivery risks? and dependenc(y|ies)"), by("delivery risks? and dependenc(y|ies)", "delivery risk and dependency management"))),
        "integration": ((f"{has(r'\b(managed|owned|resolved|handled|coordinated)\b', 'integration', 'dependenc')} AND {no('integration dependency management')}", by("integration[^,.;]*dependenc(y|ies)", "integration dependency management")),),
        "governance": ((f"{has(programme, 'delivery governance')} AND {no('programme delivery governance')}", by("delivery governance", "programme delivery governance")), (f"{has(programme, 'backlog governance')} AND {no('programme-level backlog governance')}", by("backlog governance", "programme-level backlog governance"))),
        "regulatory": ((f"{has('regulatory', 'delivery|reporting|compliance')} AND {no('regulated */ *regulatory')}", by("regulatory", "regulated / regulatory")),),
        "agile": ((has("agile/hybrid execution"), by("Agile/Hybrid execution", "Agile/Hybrid delivery execution")),),
    }
    tight = "fact"
    for regex, to in ((r"\bLed the delivery of\b", "Led delivery of"),):
        tight = by(regex, to, tight)
    for regex, to in (("worked closely with", "collaborated with"), ("helping to maintain", "supporting"), ("helping maintain", "supporting"), ("in order to", "to")):
        tight = f"regexp_replace({tight}, {duck.text(rf'\b{regex}\b')}, {duck.text(to)}, 'gi')"
    ended = lambda x: f"CASE WHEN {x} = '' OR regexp_matches({x}, '[.!?]$') THEN {x} ELSE {x} || '.' END"
    sql = f"""WITH f AS (SELECT doc_id, trim({_OPENED.format(letters=_LETTERS.format(g=", 'g'"))}) AS fact FROM documents),
s AS (SELECT *, {_duck_catalog('fact', 2)} AS shown, regexp_replace({tight}, '\\s+,', ',', 'g') AS tight FROM f),
step0 AS (SELECT doc_id, fact, list_filter(shown, lambda n: doc_id % 3 <> 0 OR n NOT IN ('agile', 'release')) AS names, {ended('tight')} AS text, ''::VARCHAR AS applied FROM s)"""
    for i, (name, rules) in enumerate(steps.items()):
        chain = " ".join(f"WHEN {test} THEN {to}" for test, to in rules)
        sql += f""",
step{i + 1} AS (SELECT doc_id, fact, names, after AS text, CASE WHEN after <> text THEN applied || {duck.text(review.LABELS[name] + ';')} ELSE applied END AS applied
  FROM (SELECT *, CASE WHEN NOT list_contains(names, '{name}') THEN text {chain} ELSE text END AS after FROM step{i}))"""
    return sql + f""",
told AS (SELECT doc_id, fact, applied AS requirements, trim(regexp_replace(regexp_replace(text, '\\s+,', ',', 'g'), '\\s+', ' ', 'g')) AS tidy FROM step{len(steps)})
SELECT doc_id, {ended('tidy')} AS updated, requirements FROM told WHERE {ended('tidy')} <> {ended('fact')}"""


@query("bullet_rewrites", _rewrites_sql())
def bullet_rewrites(spark, sf_dir):
    """Every whole text as a fact behind one of some openings: the facts whose wording changes for what a job asks for."""
    rows = _built(spark, sf_dir, fact=_OPENED.format(letters=_LETTERS.format(g="")))
    some = F.array(*(F.lit(n) for n in review.LABELS if n not in ("agile", "release")))
    facts = rows.select("doc_id", F.trim("fact").alias("fact"), F.when(F.col("doc_id") % 3 != 0, F.array(*map(F.lit, review.LABELS))).otherwise(some).alias("wanted"))
    out = review.bullet_changes(facts, ["doc_id"])
    return out.select("doc_id", "updated", F.array_join(F.transform("requirements", lambda r: F.concat(r, F.lit(";"))), "").alias("requirements"))


# --- the searched flow

_NOTICE = "CASE WHEN doc_id % 9 = 0 THEN '<b>No longer accepting applications</b>' ELSE '' END"
_DETAIL = f"concat('<html>', {_NOTICE}, '<div class=\"show-more-less-html__markup\">', {{plain}}, '</div></html>')"
_BODY = _duck_lines(_PLAIN.format(g=", 'g'"))


def _flow_sql(rules: flow.Rules) -> str:
    service = rules is flow.SERVICE
    pick = "arg_max(doc_id, doc_id * 100000 + place) AS of, min(doc_id * 100000 + place) AS pos" if service else "min(doc_id) AS of, min(doc_id * 100000 + place) AS pos"
    order = "pos" if service else "CASE WHEN of % 2 = 0 THEN 0 ELSE 1 END, pos"
    enough = "length(body) >= 300 AND len(regexp_split_to_array(trim(body), '\\s+')) >= 60" if service else "length(body) >= 350"
    failed = "doc_id % 11 = 0 OR doc_id % 13 = 0 OR doc_id % 17 = 0" if service else "doc_id % 11 = 0 OR (doc_id % 13 <> 0 AND doc_id % 17 = 0)"
    full = "n_ok" if service else "n_ok + n_closed"
    coverage = ("CASE WHEN search_failures = search_requests THEN 'ACCESS LIMITED' WHEN full_jd_verified > 0 THEN 'SEARCHED' WHEN search_failures + detail_failures + incomplete_details > 0 THEN 'ACCESS LIMITED' ELSE 'NO RELEVANT RESULTS' END" if service
                else "CASE WHEN search_failures + detail_failures > 0 THEN 'ACCESS LIMITED' ELSE 'NO RELEVANT RESULTS' END")
    return f"""WITH cards AS (SELECT doc_id, 1000000 + doc_id + k AS job, 2 * k AS place FROM documents, (VALUES (0), (1)) v(k) WHERE doc_id % 11 <> 0 AND doc_id % 13 <> 0 AND doc_id % 17 <> 0),
ids AS (SELECT job, {pick} FROM cards GROUP BY job), chosen AS (SELECT * FROM ids ORDER BY {order} LIMIT {rules.most_details}),
told AS (SELECT CASE WHEN d.doc_id IS NULL THEN 'failed' WHEN NOT ({enough}) THEN 'incomplete' WHEN d.doc_id % 9 = 0 THEN 'closed' ELSE 'ok' END AS status FROM chosen LEFT JOIN (SELECT doc_id, {_BODY} AS body FROM documents WHERE doc_id % 7 <> 6) d ON job = 1000000 + d.doc_id),
n AS (SELECT count(*) AS detail_requests, count(*) FILTER (WHERE status = 'failed') AS detail_failures, count(*) FILTER (WHERE status = 'incomplete') AS incomplete_details, count(*) FILTER (WHERE status = 'ok') AS n_ok, count(*) FILTER (WHERE status = 'closed') AS n_closed FROM told),
s AS (SELECT count(*) AS search_requests, count(*) FILTER (WHERE {failed}) AS search_failures FROM documents),
a AS (SELECT search_requests, search_failures, (SELECT count(*) FROM cards) AS search_rows, detail_requests, detail_failures, incomplete_details, {full} AS full_jd_verified, 0::BIGINT AS evaluated, 0::BIGINT AS returned FROM s, n)
SELECT *, {coverage} AS coverage FROM a"""


def _flow(rules: flow.Rules):
    def run(spark, sf_dir) -> DataFrame:
        pages = _built(spark, sf_dir, n="doc_id", html=_CARDS).select("n", "html")
        details = _built(spark, sf_dir, job_id="CAST(1000000 + doc_id AS STRING)", html=_DETAIL.format(plain=_PLAIN.format(g=""))).where("doc_id % 7 <> 6").select("job_id", "html")
        return flow.searched(pages, details, CV, rules, 14, NOW)[1]

    return run


for _rules in (flow.WEB, flow.SERVICE):
    query(f"flow_counters_{_rules.name}", _flow_sql(_rules))(_flow(_rules))
