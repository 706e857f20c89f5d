"""The searched flow in one plan: search pages to cards, cards to a capped choice, its details to postings, these to the best, with counters of every step.

What is fetched between the steps has landed: ``pages`` (n, the place of the request, and html, null where it failed) and
``details`` (job_id, html). The choice is at most ``most_details`` rows, so everything after it is small, whatever the pages hold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import parse
from lodestone.plans import search, web
from lodestone.sources import boards
from lodestone.streaming.keyed import shared_folder


@dataclass(frozen=True)
class Rules:
    """What differs between the policies."""

    name: str
    most_details: int
    last_wins: bool  # which row of an id counts
    closed_is_a_posting: bool
    grace_days: int | None  # rows older than the days asked for and these are left out before the cap


WEB = Rules("web", web.MOST_DETAILS, False, True, None)
SERVICE = Rules("service", 80, True, False, 1)


def chosen(cards: DataFrame, rules: Rules, days: int, now: int) -> DataFrame:
    """job_id, title, company, location, published, pos of the rows whose details are asked for."""
    rows = cards.where("status = 'ok'").select("job_id", "title", "company", "location", parse.instant(F.col("published")).alias("published"), (F.col("n") * 100_000 + F.col("at")).alias("pos"))
    if rules.grace_days is not None:
        rows = rows.where(~boards.is_old(F.col("published"), now, days + rules.grace_days, 0))
    return web.first_capped(rows, rules.most_details) if rules.last_wins else web.capped(rows, rules.most_details)


def as_postings(rows: DataFrame, details: DataFrame, rules: Rules, now: int) -> DataFrame:
    """Chosen rows with their details as postings; status also failed, for a page that did not come."""
    named = rows.select("job_id", "pos", "published", *(F.col(c).alias(f"row_{c}") for c in ("title", "company", "location")))
    pages = named.join(details.select(F.col("job_id").alias("_id"), "html"), F.col("job_id") == F.col("_id"), "left").drop("_id")
    pages = pages.withColumn("missing", F.col("html").isNull())
    found = boards.detail_pages(pages, ["job_id", "pos", "published", "missing"], "html", now, rules.name)
    status = F.when(F.col("missing") | (F.col("status") == "wall"), "failed").otherwise(F.col("status"))
    pay = parse.monthly_salary(F.col("description"))
    return found.select(
        "pos", "source", F.col("job_id").alias("source_job_id"), "company", "title", "location", "country", "remote_type", parse.remote_eligibility(F.col("remote_type"), F.col("location"), F.col("description")).alias("remote_eligibility"),
        "employment_type", pay["low"].cast("int").alias("salary_min"), pay["high"].cast("int").alias("salary_max"), F.coalesce("description", F.lit("")).alias("description"), F.lit(True).alias("full_jd_verified"),
        F.unix_timestamp(F.coalesce("published_at", "published")).alias("published_at"), F.unix_timestamp("deadline").alias("deadline"), F.when(status == "closed", "CLOSED").otherwise("ACTIVE VIA THIRD PARTY").alias("vacancy_status"), status.alias("status"))


def searched(pages: DataFrame, details: DataFrame, cv: str, rules: Rules = WEB, days: int = 7, now: int = search.NOW, history: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The best postings (pos, source_job_id, company, title, total, verdict, action), and one row of counters with the coverage.

    The chosen rows and their postings are written once; pages are read once for the cards and once, without parsing, for
    the requests that failed.
    """
    spark: SparkSession = pages.sparkSession
    cards = boards.search_cards(pages, ["n"], "html", rules.last_wins).select("n", "at", "job_id", "title", "company", "location", "published", "status")

    def written(rows: DataFrame, label: str) -> DataFrame:
        path = shared_folder(spark, label)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    cards = written(cards, "flow-cards")
    asked = pages.agg(F.count(F.lit(1)).alias("search_requests"), F.count_if(F.col("html").isNull()).alias("gone")).first()
    bad = ["wall"] if rules.name == "web" else ["wall", "unreadable"]
    seen = cards.agg(F.count_if(F.col("status") == "ok").alias("rows"), F.count_if(F.col("status").isin(bad)).alias("bad")).first()
    rows = written(chosen(cards, rules, days, now), "flow-chosen")
    postings = written(as_postings(rows, details, rules, now), "flow-postings")
    n = {r["status"]: r["count"] for r in postings.groupBy("status").count().collect()}  # a handful of statuses
    usable = postings.where(F.col("status").isin("ok", "closed") if rules.closed_is_a_posting else F.col("status") == "ok").drop("status")
    if rules.name == "web":
        judged = web.evaluated(usable, cv, days, now)
        worth, best = judged.where("rule IS NULL AND verdict <> 'Poor fit'").count(), web.best(judged)
    else:
        known = history if history is not None else spark.createDataFrame([], "fingerprint string, material_hash string")
        best = search.ranked(usable, known, only_new=history is not None, cv_text=cv)
        worth = None
    best = written(best.select("pos", "source_job_id", "company", "title", "total", "verdict", "action"), "flow-best")
    returned = best.count()
    told = {"search_requests": asked["search_requests"], "search_failures": asked["gone"] + seen["bad"], "search_rows": seen["rows"], "detail_requests": sum(n.values()), "detail_failures": n.get("failed", 0), "incomplete_details": n.get("incomplete", 0)}
    told |= {"full_jd_verified": n.get("ok", 0) + (n.get("closed", 0) if rules.closed_is_a_posting else 0), "evaluated": returned if worth is None else worth, "returned": returned}
    counters = spark.createDataFrame([(*told.values(), coverage(told, rules))], ", ".join(f"{k} long" for k in told) + ", coverage string")
    return best.orderBy(F.desc("total"), "pos"), counters


def coverage(told: dict[str, int], rules: Rules) -> str:
    """How far the result can be trusted: nothing found is not the same as nothing there."""
    if told["search_requests"] and told["search_failures"] == told["search_requests"]:
        return "ACCESS LIMITED"
    if rules.name == "web":
        return "ACCESS LIMITED" if told["search_failures"] or told["detail_failures"] else "SEARCHED" if told["evaluated"] else "NO RELEVANT RESULTS"
    if told["full_jd_verified"]:
        return "SEARCHED"
    limited = told["search_failures"] or told["detail_failures"] or told["incomplete_details"]
    return "ACCESS LIMITED" if limited else "NO RELEVANT RESULTS"
