"""The searched flow from landed pages to the best postings, with its counters."""

from __future__ import annotations

import pytest

from lodestone.plans import flow
from lodestone.sources.postings import NOW

CV = "Fifteen years of end-to-end project delivery in banking: data platforms, systems integration, agile governance, risk management, budgets, releases and senior stakeholders."
GOOD = ("Own end-to-end delivery of enterprise software and data platforms. Manage scope, timelines and milestones, risks and dependencies, budget and financial control. Accountable for delivery outcomes with senior "
        "stakeholders and the steering committee. Lead cross-functional engineering teams through systems integration, cloud migration, release readiness, cutover and go-live. Governance, roadmap and executive reporting are part of the role in a regulated bank. ")


def card(job, title="Senior IT Project Manager", company="GoodCo", date="2026-07-30"):
    return f'<li><a href="https://board.example/jobs/view/x-{job}?r=1">x</a><h3 class="base-search-card__title">{title}</h3><h4 class="base-search-card__subtitle">{company}</h4><span class="job-search-card__location">Lyngby, Denmark</span><time datetime="{date}"></time></li>'


def detail(text):
    return f'<html><h1>T</h1><div class="show-more-less-html__markup">{text}</div></html>'


def run(spark, pages, details, rules, **more):
    return flow.searched(spark.createDataFrame(list(enumerate(pages)), "n int, html string"), spark.createDataFrame(details, "job_id string, html string"), CV, rules, **more)


@pytest.mark.parametrize("rules", [flow.WEB, flow.SERVICE])
def test_from_pages_to_the_best(spark, rules):
    pages = ["<ul>" + card(4455000001) + card(4455000002, "Office Assistant", "Other") + card(4455000003) + "</ul>", "<ul>" + card(4455000001, company="Again") + card(4455000004) + card(4455000005) + "</ul>", None]
    details = [("4455000001", detail(GOOD)), ("4455000002", detail(GOOD)), ("4455000003", detail("short")), ("4455000004", detail(GOOD + " No longer accepting applications"))]
    best, told = run(spark, pages, details, rules)
    told = told.first().asDict()
    assert {k: told[k] for k in ("search_requests", "search_failures", "search_rows", "detail_requests", "detail_failures", "incomplete_details")} == {"search_requests": 3, "search_failures": 1, "search_rows": 6, "detail_requests": 5, "detail_failures": 1, "incomplete_details": 1}
    assert told["full_jd_verified"] == (3 if rules is flow.WEB else 2) and told["returned"] == 1
    assert told["coverage"] == ("ACCESS LIMITED" if rules is flow.WEB else "SEARCHED")
    row = best.first()
    assert (row["source_job_id"], row["company"]) == ("4455000001", "GoodCo" if rules is flow.WEB else "Again") and row["verdict"] != "Poor fit"
    spark.catalog.clearCache()


@pytest.mark.parametrize("rules", [flow.WEB, flow.SERVICE])
def test_an_access_wall_is_not_zero_results(spark, rules):
    best, told = run(spark, ["<html>authwall challenge/checkpoint</html>"], [], rules)
    told = told.first()
    assert best.collect() == [] and (told["coverage"], told["search_failures"], told["detail_requests"]) == ("ACCESS LIMITED", 1, 0)


def test_caps_and_freshness(spark):
    old, new = [card(4455000000 + i, date="2026-01-01") for i in range(30)], [card(4455100000 + i, date="2026-07-30") for i in range(90)]
    pages = ["<ul>" + "".join(old + new) + "</ul>"]
    _, told = run(spark, pages, [], flow.WEB)
    assert told.first()["detail_requests"] == 24
    _, told = run(spark, pages, [], flow.SERVICE, now=NOW)
    told = told.first()
    assert (told["detail_requests"], told["detail_failures"], told["coverage"]) == (80, 80, "ACCESS LIMITED")
    _, told = run(spark, ["<ul>" + "".join(old) + "</ul>"], [], flow.SERVICE, now=NOW)
    assert (told.first()["detail_requests"], told.first()["coverage"]) == (0, "NO RELEVANT RESULTS")
