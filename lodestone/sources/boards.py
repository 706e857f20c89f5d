"""Landed board responses to one relation of postings.

Fetching is left to ingestion; what lands is a relation of raw bodies (JSON or HTML). Each reader returns
a row for every item that it finds, with ``status``: ok, or why the item is not usable (incomplete,
old, no_link, closed, wall, unreadable), so that failures are counted and never stop a run. The columns of
a posting are the same for all readers: ``POSTING``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import parse
from lodestone.functions.text import clean_basic, clean_html, clean_html_lines, unescaped
from lodestone.operators import multisource

POSTING = ("source", "source_job_id", "company", "title", "location", "country", "remote_type", "employment_type", "description", "url", "published_at", "deadline", "status")
WALL = r"(?i)captcha|challenge/checkpoint|authwall"
NO_LONGER = "(?i)no longer accepting applications|modtager ikke længere ansøgninger|tager ikke længere imod ansøgninger"
# The shortest description of each board, in characters.
LEAST_JSON, LEAST_FEED, LEAST_DETAIL_WORDS = 120, 80, 60
LEAST_DETAIL = {"service": 300, "web": 350}
TITLE_KEYS = ("title", "jobTitle", "position", "name")


def walled(html: Column) -> Column:
    """Whether a page is an access wall and not what was asked for."""
    return F.coalesce(html, F.lit("")).rlike(WALL)


def is_old(published: Column, now: int, days: int, grace_hours: int = 24) -> Column:
    return F.coalesce(F.unix_timestamp(published) < now - days * 86400 - grace_hours * 3600, F.lit(False))


def least_published(now: int, days: int) -> int:
    """Seconds that a source is asked to look back, at least a day: the freshness pushed down to it."""
    return max(1, days) * 86400


def first_of(*values: Column) -> Column:
    """The first value that is neither null nor empty ('', [], {})."""
    return F.coalesce(*(F.when(~v.isin("", "[]", "{}", "null"), v) for v in values))


def posting(rows: DataFrame, source: str, kept: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    kinds = {"published_at": "timestamp", "deadline": "timestamp"}
    full = {c: columns.get(c, F.lit(None)).cast(kinds.get(c, "string")) for c in POSTING} | {"source": F.lit(source)}
    return rows.select(*kept, *(full[c].alias(c) for c in POSTING))


# --- JSON boards

_ADS = "jobAds array<struct<jobAdId string, title string, hiringOrgName string, postalDistrictName string, municipality string, country string, publicationDate string, applicationDeadline string, employmentDurationType string>>"
_DETAIL = "body string, job struct<address: struct<city: string, postalCode: string, countryName: string>>, application struct<url: string, deadlineDate: string>, unpublicationDateTime string"


def jobnet(searches: DataFrame, details: DataFrame, now: int, days: int) -> DataFrame:
    """searches: pos, body. details: id, body. The last search row of an id counts; a row without its detail is incomplete."""
    rows = searches.select("pos", F.posexplode(F.from_json("body", _ADS)["jobAds"]).alias("at", "r")).where(F.col("r.jobAdId") != "")
    rows = rows.withColumn("published", parse.instant(F.col("r.publicationDate")))
    rows = rows.where(~is_old(F.col("published"), now, days)).groupBy(F.col("r.jobAdId").alias("id")).agg(F.max_by(F.struct("r", "published"), F.struct("pos", "at")).alias("x"))
    found = details.select(F.col("id"), F.from_json("body", _DETAIL).alias("d"))
    rows = rows.join(found, "id", "left").select("id", "x.r", "x.published", "d")
    body = clean_html(F.col("d.body"))
    link = F.when(F.col("d.application.url").rlike("^https?://"), F.col("d.application.url"))
    place = F.nullif(F.trim(F.concat_ws(" ", F.nullif("d.job.address.city", F.lit("")), F.nullif("d.job.address.postalCode", F.lit("")))), F.lit(""))
    return posting(
        rows, "Jobnet", source_job_id=F.col("id"), company=clean_html(first_of(F.col("r.hiringOrgName"), F.lit("Employer"))), title=clean_html(F.col("r.title")),
        location=F.coalesce(place, clean_html(first_of(F.col("r.postalDistrictName"), F.col("r.municipality"), F.lit("Denmark")))),
        country=first_of(F.col("d.job.address.countryName"), F.col("r.country"), F.lit("Denmark")), remote_type=F.lit("unknown"),
        employment_type=F.when(F.lower("r.employmentDurationType") == "permanent", "permanent").otherwise("unknown"), description=body,
        url=F.coalesce(link, F.lit("https://jobnet.dk/find-job")), published_at=F.col("published"),
        deadline=parse.instant(first_of(F.col("d.application.deadlineDate"), F.col("d.unpublicationDateTime"))),
        status=F.when(F.length(body) < LEAST_JSON, "incomplete").otherwise("ok"))


_OK_ROW = "array<struct<id string, slug string, date string, description string, url string, apply_url string, location string, company string, position string>>"


def remote_ok(responses: DataFrame, now: int, days: int) -> DataFrame:
    """responses: body, a list whose first element is a notice."""
    rows = responses.select(F.posexplode(F.from_json("body", _OK_ROW)).alias("at", "r")).where("at > 0")
    rows = rows.withColumn("published", parse.instant(F.col("r.date")))
    body, link = clean_html(F.col("r.description")), first_of(F.col("r.url"), F.col("r.apply_url"))
    return posting(
        rows, "Remote OK", source_job_id=first_of(F.col("r.id"), F.col("r.slug")), company=clean_html(first_of(F.col("r.company"), F.lit("Employer"))), title=clean_html(F.col("r.position")),
        location=clean_html(first_of(F.col("r.location"), F.lit("Remote"))), remote_type=F.lit("remote"), employment_type=F.lit("unknown"), description=body, url=link, published_at=F.col("published"),
        status=F.when(is_old(F.col("published"), now, days), "old").when(link.isNull(), "no_link").when(F.length(body) < LEAST_JSON, "incomplete").otherwise("ok"))


#: All lists and objects of JSON bodies, level by level. A path is the places from the outside in, members in the order in which they are written; texts that look like JSON stay texts.
_WALK = """
WITH RECURSIVE walk(id, path, json, kind) AS (
  SELECT id, CAST(array() AS array<int>), body, left(schema_of_variant(try_parse_json(body)), 5) FROM {bodies}
  UNION ALL
  SELECT w.id, concat(w.path, array(c.pos)), c.col.json, left(schema_of_variant(c.col.v), 5)
  FROM walk w, LATERAL posexplode(CASE
    WHEN w.kind = 'ARRAY' THEN arrays_zip(from_json(w.json, 'array<string>'), from_json(w.json, 'array<variant>'))
    ELSE arrays_zip(map_values(from_json(w.json, 'map<string, string>')), map_values(from_json(w.json, 'map<string, variant>'))) END) AS c
  WHERE w.kind IN ('ARRAY', 'OBJEC') AND left(schema_of_variant(c.col.v), 5) IN ('ARRAY', 'OBJEC'))
SELECT id, path, from_json(json, 'array<string>') AS texts, transform(from_json(json, 'array<variant>'), v -> left(schema_of_variant(v), 5) = 'OBJEC') AS objects,
  from_json(json, 'array<variant>') AS items FROM walk WHERE kind = 'ARRAY'"""


def titled_rows(responses: DataFrame) -> DataFrame:
    """responses: body. json: the objects of each body's first list of objects that have titles, wherever it stands; unreadable bodies have none.

    Lists are tried from the outside in and in the order in which they are written. The first three items have
    to be objects, and one of the first ten has to have a title.
    """
    spark = responses.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")  # bodies are finite; rows are not to be cut
    bodies = responses.select(F.monotonically_increasing_id().alias("id"), "body")
    # zipped columns are named by their place
    lists = spark.sql(_WALK.replace("c.col.json", "c.col.`0`").replace("c.col.v", "c.col.`1`"), bodies=bodies)
    titled = lambda v: F.array_contains(F.array(*(F.try_variant_get(v, f"$.{k}", "variant").isNotNull() for k in TITLE_KEYS)), True)
    named = F.exists(F.slice("items", 1, 10), titled)
    fit = lists.where((F.size("items") > 0) & F.forall(F.slice("objects", 1, 3), lambda x: x) & named)
    first = fit.groupBy("id").agg(F.min_by(F.struct("texts", "objects"), "path").alias("x"))
    whole = F.filter(F.arrays_zip(F.col("x.texts").alias("json"), F.col("x.objects").alias("there")), lambda x: x["there"])
    return first.select(F.explode(whole).alias("r")).select("r.json")


def the_hub(responses: DataFrame) -> DataFrame:
    """responses: body; pages whose list of jobs may stand anywhere and whose fields have several names."""
    rows = titled_rows(responses).withColumn("v", F.try_parse_json("json"))
    get = lambda *paths: first_of(*(F.try_variant_get("v", f"$.{p}", "string") for p in paths))
    title = clean_html(get(*TITLE_KEYS))
    company = clean_html(first_of(*(get(f"{o}.name", f"{o}.companyName") for o in ("company", "startup", "organization")), *(F.when(~x.startswith("{"), x) for x in (get("company"), get("startup"), get("organization"))), get("companyName"), F.lit("Employer")))
    parts = lambda o: F.nullif(F.concat_ws(" ", *(F.nullif(F.try_variant_get("v", f"$.{o}.{k}", "string"), F.lit("")) for k in ("city", "country", "name"))), F.lit(""))
    plain = lambda o: F.when(~get(o).startswith("{"), get(o))
    place = clean_html(F.coalesce(parts("location"), plain("location"), parts("jobLocation"), plain("jobLocation")))
    body, link = clean_html(get("description", "jobDescription", "content", "body", "text")), get("url", "jobUrl", "applyUrl", "applicationUrl", "link")
    remote = F.coalesce(get("isRemote", "remote") == "true", F.lit(False)) | F.lower(place).contains("remote")
    return posting(
        rows, "The Hub", source_job_id=first_of(get("id"), get("_id"), get("uuid"), link, title), company=company, title=title,
        location=F.when(place != "", place).when(remote, "Remote").otherwise("Denmark"), country=F.when(F.lower(place).contains("denmark"), "Denmark"),
        remote_type=F.when(remote, "remote").otherwise("unknown"), description=body, url=link,
        status=F.when(title == "", "unreadable").when(link.isNull(), "no_link").when(F.length(body) < LEAST_JSON, "incomplete").otherwise("ok"))


_JOBICY = "jobs array<struct<id string, companyName string, jobTitle string, jobGeo string, pubDate string, url string, jobDescription string, jobExcerpt string, salaryCurrency string, salaryPeriod string, salaryMin string, salaryMax string>>"
_REMOTIVE = "jobs array<struct<id string, company_name string, title string, candidate_required_location string, publication_date string, url string, description string, job_type string, salary string>>"
_PAY = ("salary_currency", "salary_min_monthly", "salary_max_monthly")


def jobicy(responses: DataFrame) -> DataFrame:
    """responses: body. A posting with its pay in DKK a month."""
    rows = responses.select(F.explode(F.from_json("body", _JOBICY)["jobs"]).alias("r"))
    pay = lambda c: multisource.monthly(F.col(f"r.{c}").try_cast("double"), F.col("r.salaryCurrency"), F.col("r.salaryPeriod"))
    rows = rows.withColumns({"salary_currency": F.nullif("r.salaryCurrency", F.lit("")), "salary_min_monthly": pay("salaryMin"), "salary_max_monthly": pay("salaryMax")})
    return posting(
        rows, "jobicy", _PAY, source_job_id=F.col("r.id"), company=clean_basic(first_of(F.col("r.companyName"), F.lit("Employer"))), title=clean_basic(F.col("r.jobTitle")),
        location=clean_basic(first_of(F.col("r.jobGeo"), F.lit("Remote"))), country=F.lit(""), remote_type=F.lit("remote"), url=F.col("r.url"), published_at=parse.instant(F.col("r.pubDate")),
        description=clean_basic(first_of(F.col("r.jobDescription"), F.col("r.jobExcerpt"))), status=F.lit("ok"))


def remotive(responses: DataFrame) -> DataFrame:
    """responses: body. A posting with what its salary text says."""
    rows = responses.select(F.explode(F.from_json("body", _REMOTIVE)["jobs"]).alias("r")).withColumn("pay", multisource.salary_of_text(F.col("r.salary")))
    rows = rows.withColumns({"salary_currency": F.col("pay.currency"), "salary_min_monthly": F.col("pay.low"), "salary_max_monthly": F.col("pay.high")})
    return posting(
        rows, "remotive", _PAY, source_job_id=F.col("r.id"), company=clean_basic(first_of(F.col("r.company_name"), F.lit("Employer"))), title=clean_basic(F.col("r.title")),
        location=clean_basic(first_of(F.col("r.candidate_required_location"), F.lit("Remote"))), country=F.lit(""), remote_type=F.lit("remote"), employment_type=clean_basic(F.col("r.job_type")),
        url=F.col("r.url"), published_at=parse.instant(F.col("r.publication_date")), description=clean_basic(F.col("r.description")), status=F.lit("ok"))


def feed(items: DataFrame, now: int, days: int) -> DataFrame:
    """items: title, link, description, pubDate, creator, guid of a feed. "Company: Title" is split where no creator is named."""
    rows = items.withColumns({"published": parse.instant(F.col("pubDate")), "raw": clean_html(F.col("title")), "named": clean_html(F.col("creator"))})
    colon = F.instr(F.col("raw"), F.lit(":"))
    split = (F.col("named").isin("", "Employer")) & (colon > 0) & (colon <= 80)
    body, link = clean_html(F.col("description")), F.nullif(F.trim("link"), F.lit(""))
    return posting(
        rows, "We Work Remotely", source_job_id=first_of(F.trim("guid"), link), company=F.when(split, F.trim(F.substring_index("raw", ":", 1))).otherwise(first_of(F.col("named"), F.lit("Employer"))),
        title=F.when(split, F.trim(F.expr("substring(raw, instr(raw, ':') + 1)"))).otherwise(F.col("raw")), location=F.lit("Remote"), remote_type=F.lit("remote"), description=body, url=link,
        published_at=F.col("published"), status=F.when(is_old(F.col("published"), now, days), "old").when(F.length(body) < LEAST_FEED, "incomplete").when(link.isNull(), "no_link").otherwise("ok"))


# --- HTML boards


def attribute(tag: Column, name: str) -> Column:
    return unescaped(F.regexp_extract(tag, rf"""(?i){name}=["']([^"']+)["']""", 1))


def class_text(block: Column, name: str) -> Column:
    """The cleaned content of the first tag whose class names ``name``."""
    return clean_html_lines(F.regexp_extract(block, rf"""(?is)<[^>]+class=["'][^"']*{name}[^"']*["'][^>]*>(.*?)</[^>]+>""", 1))


def meta_content(html: Column, name: str) -> Column:
    return unescaped(F.regexp_extract(html, rf"""(?is)<meta\b[^>]*(?:name|property)=["']{name}["'][^>]*content=["']([^"']*)["']""", 1))


def search_cards(pages: DataFrame, keys: list[str], html: str, last_wins: bool = False) -> DataFrame:
    """keys, at, job_id, title, company, location, published, status: the cards of search pages, the first of each id in a page (or the last).

    status: ok; wall for an access wall; unreadable for a page with job links of which no card could be
    read. Such pages have one row without a card.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    blocks = F.when(~walled(body), F.regexp_extract_all(body, F.lit(r"(?is)<li\b.*?</li>"), 0))
    cards = pages.select(*keys, F.posexplode(blocks).alias("at", "block"))
    link = F.regexp_extract("block", r"""(?i)<a\b[^>]*href=["']([^"']*/jobs/view/[^"']+)["'][^>]*>""", 1)
    cards = cards.withColumn("job_id", parse.job_id(unescaped(link))).where(F.col("job_id").isNotNull())
    pick = F.max_by if last_wins else F.min_by
    cards = cards.groupBy(*keys, "job_id").agg(F.min("at").alias("at"), pick("block", "at").alias("block"))
    time = F.regexp_extract("block", r"(?i)<time\b[^>]*>", 0)
    cards = cards.select(*keys, "at", "job_id", class_text(F.col("block"), "base-search-card__title").alias("title"), class_text(F.col("block"), "base-search-card__subtitle").alias("company"),
                         class_text(F.col("block"), "job-search-card__location").alias("location"), F.nullif(attribute(time, "datetime"), F.lit("")).alias("published"), F.lit("ok").alias("status"))
    readable = F.exists(F.coalesce(blocks, F.array()), lambda b: parse.job_id(unescaped(F.regexp_extract(b, r"""(?i)<a\b[^>]*href=["']([^"']*/jobs/view/[^"']+)["'][^>]*>""", 1))).isNotNull())
    bad = F.when(walled(body), "wall").when(body.rlike("(?i)/jobs/view/") & ~readable, "unreadable")
    failed = pages.select(*keys, bad.alias("status")).where(F.col("status").isNotNull())
    return cards.unionByName(failed, allowMissingColumns=True)


def posting_json(html: Column) -> Column:
    """The first JobPosting of a page's JSON-LD scripts (alone, in a list or a graph) as a variant; unreadable scripts are skipped."""
    scripts = F.regexp_extract_all(html, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    items = F.flatten(F.transform(F.transform(scripts, lambda s: F.try_parse_json(F.trim(s))), lambda v: F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, '$["@graph"]', "array<variant>"), F.when(v.isNotNull(), F.array(v)), F.array().cast("array<variant>"))))
    return F.try_element_at(F.filter(items, lambda v: F.try_variant_get(v, '$["@type"]', "string") == "JobPosting"), F.lit(1))


def places(v: Column) -> tuple[Column, Column]:
    """Location (places of a posting, each once, between slashes) and country (the first that is named)."""
    listed = F.coalesce(F.try_variant_get(v, "$.jobLocation", "array<variant>"), F.when(F.try_variant_get(v, "$.jobLocation", "variant").isNotNull(), F.array(F.try_variant_get(v, "$.jobLocation", "variant"))), F.array().cast("array<variant>"))
    get = lambda x, p: F.nullif(F.coalesce(F.try_variant_get(x, f"$.address.{p}", "string"), F.try_variant_get(x, f"$.{p}", "string")), F.lit(""))
    country = lambda x: F.coalesce(get(x, "addressCountry.name"), F.when(~get(x, "addressCountry").startswith("{"), get(x, "addressCountry")))
    each = F.filter(F.transform(listed, lambda x: F.concat_ws(", ", get(x, "addressLocality"), get(x, "addressRegion"), country(x))), lambda s: s != "")
    named = F.filter(F.transform(listed, country), lambda c: c.isNotNull())
    return F.array_join(F.array_distinct(each), " / "), F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(""))


def external_link(html: Column, host: str) -> Column:
    """The first absolute link of a page that does not lead back to ``host``; a redirect's own target counts."""
    links = F.transform(F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*href=["']([^"']+)["'][^>]*>"""), 1), unescaped)
    target = lambda u: F.coalesce(*(F.try_url_decode(F.nullif(F.regexp_extract(u, rf"[?&]{k}=(https?(?:%3A|:)[^&#]+)", 1), F.lit(""))) for k in ("url", "redirect", "target")), u)
    away = F.filter(F.transform(links, target), lambda u: u.rlike("(?i)^https?://") & ~F.lower(F.regexp_extract(u, "(?i)^https?://([^/:?#]+)", 1)).endswith(host))
    return F.try_element_at(away, F.lit(1))


def absolute(link: Column, base: Column) -> Column:
    """A link as it stands on a page at ``base``: absolute, from the host's root, from the scheme, or beside the page; only http(s), else null."""
    root = F.regexp_extract(base, r"(?i)^(https?://[^/?#]+)", 1)
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), r"^(.*/)[^/]*$", 1)
    beside = F.concat(F.when(F.length(folder) > F.length(root), folder).otherwise(F.concat(root, F.lit("/"))), link)
    link = F.trim(link)
    full = (F.when(link.rlike("(?i)^https?://"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "(?i)^(https?:)", 1), link)).when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), None)
            .when(link.startswith("/"), F.concat(root, link)).when(link == "", base).otherwise(beside))
    # a dot segment is taken out once for each that occurs in practice
    for _ in range(3):
        full = F.regexp_replace(F.regexp_replace(full, r"(?<!:/)/\./", "/"), r"(https?://[^/]+(?:/[^/]+)*?)/(?!\.\./)[^/]+/\.\./", "$1/")
    return F.when(full.rlike("(?i)^https?://"), full)


def detail_pages(pages: DataFrame, keys: list[str], html: str, now: int, policy: str = "web") -> DataFrame:
    """keys and a posting for each detail page; pages may bring title, company and location of their search row (row_title, row_company, row_location).

    JSON-LD comes first, then the description's container. status: wall, incomplete (too short), closed
    (a deadline that has passed, or a notice), ok. The service policy also asks for sixty words.
    """
    row = lambda c: F.coalesce(F.col(f"row_{c}"), F.lit("")) if f"row_{c}" in pages.columns else F.lit("")
    rows = pages.withColumn("_html", F.coalesce(F.col(html), F.lit(""))).withColumn("_v", posting_json(F.col("_html")))
    get = lambda path: F.coalesce(F.try_variant_get("_v", path, "string"), F.lit(""))
    held = clean_html_lines(F.regexp_extract("_html", r"""(?is)<div\b[^>]*class=["'][^"']*show-more-less-html__markup[^"']*["'][^>]*>(.*?)</div>""", 1))
    place, country = places(F.col("_v"))
    rows = rows.withColumn("_body", F.coalesce(F.nullif(clean_html_lines(get("$.description")), F.lit("")), held))
    rows = rows.withColumns({"_place": clean_html_lines(first_of(place, row("location"), F.lit("Denmark"))), "_country": country,
                             "_deadline": F.coalesce(parse.instant(get("$.validThrough")), parse.deadline(F.col("_body"), F.year(F.timestamp_seconds(F.lit(now)))))})
    enough = F.length("_body") >= LEAST_DETAIL[policy]
    if policy == "service":
        enough = enough & (F.size(F.split(F.trim("_body"), r"\s+")) >= LEAST_DETAIL_WORDS)
    closed = F.coalesce(F.unix_timestamp("_deadline") < now, F.lit(False)) | clean_html_lines(F.col("_html")).rlike(NO_LONGER)
    kind = get("$.employmentType")
    return posting(
        rows, "board", tuple(keys), title=clean_html_lines(first_of(get("$.title"), row("title"))), company=clean_html_lines(first_of(get("$.hiringOrganization.name"), row("company"))), location=F.col("_place"),
        country=F.col("_country"), description=F.col("_body"), remote_type=parse.remote_type(F.col("_place"), F.col("_body")), employment_type=parse.employment_type(F.concat_ws(" ", kind, "_body")),
        published_at=parse.instant(get("$.datePosted")), deadline=F.col("_deadline"),
        status=F.when(walled(F.col("_html")), "wall").when(~enough, "incomplete").when(closed, "closed").otherwise("ok"))


def diagnostics(rows: DataFrame, by: str = "source") -> DataFrame:
    """Items found, usable, and not usable for each reason, in one pass."""
    reasons = ("incomplete", "old", "no_link", "closed", "wall", "unreadable")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("status") == "ok").alias("ok"), *(F.count_if(F.col("status") == r).alias(r) for r in reasons))


def coverage(requests: DataFrame, by: str, policy: str = "service") -> DataFrame:
    """requests: status (ok, incomplete, failed, wall) of each request. by, requests, failures, incomplete, coverage.

    The service is SEARCHED as soon as any posting came; the web policy calls any failure ACCESS LIMITED. Nothing found and nothing failed: NO RELEVANT RESULTS.
    """
    ok, failed = F.count_if(F.col("status") == "ok"), F.count_if(F.col("status").isin("failed", "wall"))
    limited = failed > 0 if policy == "web" else (failed > 0) & (ok == 0)
    status = F.when(limited, "ACCESS LIMITED").when(ok > 0, "SEARCHED").otherwise("NO RELEVANT RESULTS")
    return requests.groupBy(by).agg(F.count(F.lit(1)).alias("requests"), failed.alias("failures"), F.count_if(F.col("status") == "incomplete").alias("incomplete"), status.alias("coverage"))
