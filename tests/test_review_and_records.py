"""Reviews, records and board readers on small rows with known answers."""

from __future__ import annotations

import itertools
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import cv, evidence, identity, multisource, records, requirements, review
from lodestone.sources import boards


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_conservative_and_requirement_rewrites(spark):
    rows = [
        ("• Led the delivery of  X , worked closely with Y in order to Z", ["risk_dependency"], "Led delivery of X, collaborated with Y to Z.", []),
        ("Managed integration and vendor dependencies in the delivery lifecycle", ["integration", "end_to_end"], "Managed integration dependency management in the end-to-end delivery lifecycle.", ["End-to-end delivery", "Integration dependencies"]),
        ("Owned release readiness and production cutover", ["release", "agile"], "Owned release and go-live readiness and production cutover.", ["Release readiness / go-live"]),
        ("Ran international teams across Denmark and India", ["distributed"], "Ran distributed international teams across Denmark and India.", ["Distributed / international teams"]),
        ("Kept risks, dependencies; risk, dependencies.", ["risk_dependency"], "Kept risks, dependencies; risk and dependency management.", ["Risk & dependency management"]),
        ("Drove program delivery governance", ["governance"], "Drove program programme delivery governance.", ["Programme / delivery governance"]),
        ("Plain text that stays.", ["agile"], None, None),
    ]
    facts = spark.createDataFrame([(i, f, w) for i, (f, w, _, _) in enumerate(rows)], "id int, fact string, wanted array<string>")
    got = {r["id"]: (r["updated"], r["requirements"]) for r in review.bullet_changes(facts, ["id"]).collect()}
    assert got == {i: (u, n) for i, (_, _, u, n) in enumerate(rows) if u}


def plain_choice(summary, jd):
    """The best combination by enumeration in order of generation."""
    sentences = [s.strip() for s in re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", summary) if s.strip()]
    need = [n for n, asked, _ in requirements.CATALOG if any(re.search(p, jd.lower()) for p in asked)]
    shown = {n: s for n, _, s in requirements.CATALOG}
    terms = [w for w in evidence.VOCABULARY if re.search(rf"\b{w}\b", jd.lower())]
    role = lambda s: re.search(review.IDENTITY_ROLE, s, re.I) and re.search(review.IDENTITY_FIELD, s, re.I)
    at = next((i for i, s in enumerate(sentences) if role(s) and re.search(review.YEARS, s, re.I)), next((i for i, s in enumerate(sentences) if role(s)), 0))
    cands = []
    for i, s in enumerate(sentences):
        reqs, own = [n for n in need if any(re.search(p, s.lower()) for p in shown[n])], [t for t in terms if t in s.lower()]
        proof, able = any(re.search(p, s, re.I) for p in review.PROOF), bool(re.search(review.CAPABILITY, s, re.I))
        score = 5 * len(reqs) + 2 * len(own) + 4 * proof
        score += 2 * (able and score > 0) - bool(re.search(review.RESPONSIBLE, s, re.I)) - 2 * (bool(re.search(review.SOFT, s, re.I)) and not reqs)
        if i != at and score > 0:
            cands.append((i, score, len(s.split()), proof, able, reqs, own, s))
    words = len(sentences[at].split())

    def value(combo):
        reqs = [r for c in combo for r in c[5]]
        n = words + sum(c[2] for c in combo)
        return (sum(c[1] for c in combo) + 8 * len(set(reqs)) + 2 * len({t for c in combo for t in c[6]}) + 4 * any(c[3] for c in combo) - 2 * (len(reqs) - len(set(reqs)))
                + (24 - abs(105 - n) * 0.35 if n >= 90 else -(90 - n) * 0.45) - 8 * max(0, len(combo) - 3))

    combos = sorted((c for k in range(1, 5) for c in itertools.combinations(cands, k) if words + sum(x[2] for x in c) <= 120), key=lambda c: [x[0] for x in c])
    proven = [c for c in combos if any(x[3] for x in c) or not any(x[3] for x in cands)]
    pool = [c for c in proven if len(c) >= min(2, len(cands))] or proven or combos
    if not pool:
        return [sentences[at]]
    best = max(pool, key=value)
    return [sentences[at], *(c[7] for c in sorted(best, key=lambda c: (not c[4], not c[3], -c[1], c[0])))]


def test_summary_is_the_best_combination(spark):
    parts = [
        "Comfortable with change.", "Senior IT project manager with 12+ years in delivery.", "Skilled in agile delivery and risk control across platform programmes.", "Most recently led 40 people through a data migration with release readiness and go-live.",
        "Responsible for governance and PMO reporting of cloud engineering.", "Known for calm.", "Strong in stakeholder work with regulated banking and compliance.", "Previously built integration interfaces for software products in 6 countries.", "Likes tea!",
    ]
    jds = ["Agile delivery of a data platform, risk and compliance, governance and integration with release readiness", "End-to-end software programme", "Nothing here", "Cloud migration; stakeholder; API integration in a regulated bank"]
    rows = [(i, j, " ".join(parts[k] for k in order), jd) for i, order in enumerate([range(9), (2, 1, 3), (8,), (3, 7, 1, 6, 4), (0, 5, 8)]) for j, jd in enumerate(jds)]
    out = review.tailored_summaries(spark.createDataFrame(rows, "cv int, job int, summary string, jd string"), ["cv", "job"]).collect()
    want = {(i, j): " ".join(plain_choice(s, jd)) for i, j, s, jd in rows}
    assert {(r["cv"], r["job"]): r["updated"] for r in out} == {k: v for k, v in want.items() if v != next(s for i, j, s, _ in rows if (i, j) == k)}


def test_fact_lines_fill_up(spark):
    text = "\n".join(["- Led the payments platform in Denmark", "short", "a line without any of the words but long enough", "- LED the payments platform in Denmark", "another plain one that is long enough too", "Worked with a team of testers here"])
    got = evidence.fact_lines(spark.createDataFrame([(1, text), (2, None)], "k int, t string"), "k", "t").orderBy("number").collect()
    assert [(r["line"][:12], r["useful"]) for r in got] == [("Led the paym", True), ("Worked with ", True), ("a line witho", False), ("another plai", False)]
    many = "\n".join(f"Managed project number {i} for a bank" for i in range(9)) + "\nsome other line that is long enough"
    assert evidence.fact_lines(spark.createDataFrame([(1, many)], "k int, t string"), "k", "t").count() == 9


def test_roles_end_at_the_next_header(spark):
    text = "Experience\nLead, Firm A | Aarhus Jan 2019 - Present\nRan things\nKey achievements\nhidden\nEngineer\nFirm B\nMar 2015 - Sept 2018\nWrote code\nand tests\n• bullet\nTester\nFirm C\n2012 to 2014\nTools & Platforms\nJira 2011 - 2012"
    found = cv.roles(cv.cv_lines(spark.createDataFrame([(1, text)], "k int, t string"), "k", "t"), "k").orderBy("ordinal").collect()
    assert [(r["title"], r["company"], r["start_year"], r["end_year"], r["overview"]) for r in found] == [
        ("Lead", "Firm A", 2019, 9999, "Ran things"), ("Engineer", "Firm B", 2015, 2018, "Wrote code and tests"), ("Tester", "Firm C", 2012, 2014, "")]
    assert all(re.fullmatch("role:[0-9a-f]{12}", r["role_id"]) for r in found)


def test_changes_that_are_grounded(spark):
    fact = "Led a platform migration for the payments team in 2019 with clear results"
    good = "Drove platform migration and payments delivery in 2019 with measurable regulated outcomes"
    body = '{"changes": [%s]}' % ", ".join('{"sourceId": "%s", "updated": "%s", "why": "", "termsAligned": ["a", " "]}' % x for x in [("F1", good), ("F9", good), ("F1", fact), ("F1", good.replace("2019", "2020")), ("F2", good)])
    responses = spark.createDataFrame([(1, "regulated outcomes", f"Here:\n```json\n{body}\n```"), (2, "x", "no json"), (3, "x", None)], "k int, jd string, body string")
    facts = spark.createDataFrame([(1, "F1", fact, 1), (1, "F2", "too short", 2), (2, "F1", fact, 1)], "k int, fact_id string, fact string, number int")
    got = records.accepted_changes(responses, facts, ["k"]).collect()
    assert [(r["k"], r["fact_id"], r["updated"], r["terms"]) for r in got] == [(1, "F1", good + ".", ["a"])] and got[0]["why"].startswith("Rephrased")


def test_small_values(spark):
    array = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    record = lambda c, lo, hi, at: F.struct(F.lit(c).cast("long").alias("count"), F.lit(lo).cast("long").alias("low"), F.lit(hi).cast("long").alias("high"), F.lit(at).cast("long").alias("at"))
    got = one(
        spark, records.natural_list(array()).alias("a"), records.natural_list(array("x")).alias("b"), records.natural_list(array("x", "y")).alias("c"), records.natural_list(array("x", "y", "z")).alias("d"),
        records.employees(F.array(record(None, 5, 9, 1), record(-1, None, None, 3), record(None, 20, None, 2))).alias("e"), records.completion(F.lit(True), F.lit(None).cast("boolean"), F.lit(False)).alias("f"),
        records.distinct_reasons(array("p", "q", "p"), array("", "r")).alias("g"), records.request_days(F.lit(5), "web").alias("h"), records.request_days(F.lit(99), "service").alias("i"),
        records.response_text(F.lit('{"output": [{"content": [{"type": "x", "text": "n"}, {"type": "output_text", "text": " yes "}]}]}')).alias("j"), records.salary_text(F.lit(50000), F.lit(None).cast("int")).alias("k"),
        records.age_text(F.lit(0), 2 * 86400).alias("l"), records.description_rejected(F.lit("You must speak fluent Danish")).alias("m"), records.profession(F.lit("Senior IT Project Manager")).alias("n"),
        multisource.search_queries(array("Project Manager", "Delivery Manager")).alias("o"), multisource.source_geography(array("Denmark hybrid")).alias("p"), multisource.preferred_location(F.lit(""), "Lyngby; Holte").alias("q"))
    assert list(got)[:14] == ["", "x", "x and y", "x, y, and z", 20, 33, ["p", "q", "r"], 7, 30, "yes", "From 50,000 DKK/month", "2 days ago", "Mandatory Danish", True]
    assert list(got)[14:] == [["Project Manager", "Delivery Manager", "IT Project Manager", "Software Project Manager", "Project Lead", "Delivery Lead", "IT Delivery Manager", "Software Execution Lead"], "denmark", "lyngby"]


@pytest.mark.parametrize("link, base, want", [
    ("https://x.dk/a", "https://y.dk/", "https://x.dk/a"), ("/jobs", "https://y.dk/a/b?q#f", "https://y.dk/jobs"), ("c", "https://y.dk/a/b", "https://y.dk/a/c"), ("c", "https://y.dk", "https://y.dk/c"),
    ("//z.dk/p", "https://y.dk/", "https://z.dk/p"), ("../c", "https://y.dk/a/b/d", "https://y.dk/a/c"), ("mailto:x@y", "https://y.dk/", None)])
def test_absolute_links(spark, link, base, want):
    assert one(spark, boards.absolute(F.lit(link), F.lit(base)).alias("u"))["u"] == want


def test_external_links_and_walls(spark):
    html = '<a href="/own">x</a><a href="https://www.board.com/r?url=https%3A%2F%2Ffirm.dk%2Fapply&amp;x=1">y</a><a href="https://other.dk">z</a>'
    got = one(spark, boards.external_link(F.lit(html), "board.com").alias("u"), boards.walled(F.lit("AuthWall")).alias("w"), boards.meta_content(F.lit('<meta property="og:title" content="A &amp; B">'), "og:title").alias("m"))
    assert (got["u"], got["w"], got["m"]) == ("https://firm.dk/apply", True, "A & B")


def test_selection_and_reviewed_counts(spark):
    results = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "b", "y"), (2, 0, "a", "z")], "k int, pos int, source string, id string")
    before = spark.createDataFrame([(1, "b", "y"), (2, "q", "q")], "k int, source string, id string")
    assert sorted((r["k"], r["id"]) for r in records.reselected(results, before, "k").collect()) == [(1, "y"), (2, "z")]
    changes = spark.createDataFrame([("j", "1"), ("j", "2")], "job_key string, change_id string")
    done = spark.createDataFrame([("j", "1", "accepted")], "job_key string, change_id string, value string")
    assert records.reviewed(changes, done).first()["reviewed"] == 1


def test_fold_over_many_keys_and_nulls(spark):
    rows = [(k, p, at, "x" * n) for k in ("a", "b", None) for p, (at, n) in enumerate([(5, 1), (None, 3), (4, 2), (9, 0), (9, 9)])]
    got = identity.folded(spark.createDataFrame(rows, "k string, pos int, published_at long, description string"), ["k"], "pos").collect()
    assert sorted(((r["k"] or ""), r["pos"]) for r in got) == [("", 4), ("a", 4), ("b", 4)]


def test_stream_keeps_first_arrivals(spark, tmp_path):
    from lodestone.streaming import history

    rows = [(1, "a", "2026-08-01 10:00:00"), (2, "a", "2026-08-01 12:00:00"), (3, "b", "2026-08-01 11:00:00")]
    spark.createDataFrame(rows, "n int, id string, at string").selectExpr("n", "id", "cast(at AS timestamp_ntz) AS at").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("n int, id string, at timestamp_ntz").parquet(f"{tmp_path}/in")
    query = history.first_arrivals(stream, ["id"], "at").writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]


def test_snapshots(spark, tmp_path):
    from lodestone.streaming import history

    assert history.latest_snapshot(spark, f"{tmp_path}/none", "k string").collect() == []
    for version in (1, 2, 10):
        history.snapshot(spark.createDataFrame([(str(version),)], "k string"), f"{tmp_path}/s", version)
    assert [r["k"] for r in history.latest_snapshot(spark, f"{tmp_path}/s", "k string").collect()] == ["10"]


def _candidates(chance, n, kinds):
    pool = [{"score": chance.randrange(1, 14), "words": chance.randrange(4, 45), "proof": chance.random() < 0.15, "reqs": chance.sample("abcdefgh", chance.randrange(0, 4)), "terms": chance.sample("tuvwxyz", chance.randrange(0, 3))} for _ in range(kinds)]
    return [chance.choice(pool) | {"i": i} for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_best_combination_equals_all_of_them(seed):
    import random

    chance = random.Random(seed)
    for _ in range(40):
        cands = _candidates(chance, chance.randrange(0, 13), chance.choice([2, 40]))
        words = chance.choice([10, 30, 100, 119, 130])
        every = [review.Pick(words, c) for k in range(1, 5) for c in itertools.combinations(cands, k)]
        every = [p for p in every if p.words <= review.MOST_WORDS]
        proven = [p for p in every if p.proof or not any(c["proof"] for c in cands)]
        pool = [p for p in proven if len(p.picked) >= min(2, len(cands))] or proven or every
        want = min(pool, key=lambda p: (-p.score(), p.order())).order() if pool else []
        assert review.chosen_sentences(cands, words) == want


def test_best_combination_of_many_sentences():
    """65 million combinations of 200 sentences: alike ones, and different ones."""
    import random

    for seed, kinds in ((1, 1), (2, 12), (3, 200)):
        picked = review.chosen_sentences(_candidates(random.Random(seed), 200, kinds), 20)
        assert 1 <= len(picked) <= review.MOST_SENTENCES


def test_a_batch_of_choices_equals_each_alone():
    import random

    import pyarrow as pa

    chance = random.Random(7)
    rows = []
    for _ in range(600):
        cands = _candidates(chance, chance.randrange(0, 11), chance.choice([2, 3, 40]))
        for c in cands:
            if chance.random() < 0.05:
                c["reqs"] = [*c["reqs"], *c["reqs"], *(f"r{k}" for k in range(chance.choice([0, 40])))]
        chance.shuffle(cands)
        rows.append((cands, chance.choice([0, 10, 30, 100, 119, 130])))
    kind = pa.list_(pa.struct([("i", pa.int32()), ("score", pa.int32()), ("words", pa.int32()), ("proof", pa.bool_()), ("reqs", pa.list_(pa.string())), ("terms", pa.list_(pa.string()))]))
    got = review.chosen_in_batch(pa.array([c for c, _ in rows], kind).slice(5), pa.array([w for _, w in rows], pa.int32()).slice(5)).to_pylist()
    assert got == [review.chosen_sentences(*row) for row in rows[5:]]
    assert review.chosen_in_batch(pa.array([], kind), pa.array([], pa.int32())).to_pylist() == []


def test_the_choice_is_made_once(spark, tmp_path):
    from lodestone.plans import queries  # noqa: F401
    from lodestone.plans.board_queries import summary_combos

    spark.sql("SELECT 1L AS l_orderkey, 1 AS l_linenumber, 2L AS l_partkey, 3L AS l_suppkey, 4.0D AS l_quantity, 'R' AS l_returnflag, 'O' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    plan = summary_combos(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
