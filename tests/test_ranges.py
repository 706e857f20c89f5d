"""Interval joins against all pairs."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.operators import company, ranges
from lodestone.plans import queries


def test_blocks_cover_an_interval_once(spark):
    spans = [(-9, 13), (0, 0), (5, 4), (1, 6), (None, 3), (-(2**40), 2**40), (7, 7), (-1, -1), (-8, -1)]
    rows = spark.createDataFrame(spans, "a long, b long").withColumn("blocks", ranges.dyadic_blocks(F.col("a"), F.col("b"))).collect()
    for row in rows:
        held = sorted((x["block"] << x["level"], ((x["block"] + 1) << x["level"]) - 1) for x in row["blocks"])
        if row["a"] is None or row["a"] > row["b"]:
            assert held == []
            continue
        assert held[0][0] == row["a"] and held[-1][1] == row["b"] and len(held) <= 2 * 42
        assert all(x[1] + 1 == y[0] for x, y in zip(held, held[1:], strict=False))


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_all_pairs(spark, seed):
    chance = random.Random(seed)
    points = [(i, chance.choice([None, 50, chance.randrange(-100, 1000)])) for i in range(200)]  # 50 is hot
    spans = [(i, low := chance.randrange(-200, 1000), low + chance.choice([0, 3, 900, -2, 10**12])) for i in range(60)]
    got = ranges.interval_join(spark.createDataFrame(points, "p int, x long"), "x", spark.createDataFrame(spans, "s int, low long, high long"), "low", "high")
    assert sorted((r["p"], r["s"]) for r in got.collect()) == sorted((p, s) for p, x in points if x is not None for s, low, high in spans if low <= x <= high)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_no_intervals(spark):
    points, spans = spark.range(3).selectExpr("id AS x"), spark.createDataFrame([], "low long, high long")
    assert ranges.interval_join(points, "x", spans, "low", "high").collect() == []


def test_radius_takes_in_municipalities(spark):
    rows = spark.createDataFrame([(1, 10.0), (2, 10.0001), (3, 40.0), (4, 99.0), (5, -3.0)], "id int, km double")
    got = {r["id"]: r["count"] for r in company.searched_municipalities(rows, "km").groupBy("id").count().collect()}
    assert got == {1: 4, 2: 10, 3: 25, 4: 29, 5: 4}


def test_points_are_never_broadcast(spark, tmp_path, monkeypatch):
    # small on disk, and one row for each level in the join
    spark.range(2000).selectExpr("id", "abs(id % 60) / 1.0D AS km").write.parquet(str(tmp_path / "points"))
    points = spark.read.parquet(str(tmp_path / "points"))
    got = company.searched_municipalities(points, "km")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan and "parquet" not in plan.split("BroadcastExchange")[1]
    levels = [r["_level"] for r in ranges_blocks(spark).select("_level").distinct().collect()]
    assert max(levels) <= 16
    monkeypatch.setattr(ranges, "MOST_SENT", 3)
    merged = company.searched_municipalities(points, "km")
    assert "BroadcastExchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, got.collect()))


def ranges_blocks(spark):
    return company.municipalities(spark).select(F.explode(ranges.dyadic_blocks(F.col("low"), F.col("high"))).alias("b")).select(F.col("b.level").alias("_level"))


def test_radii_out_of_the_ordinary(spark):
    rows = spark.createDataFrame([(1, None), (2, float("inf")), (3, float("nan")), (4, 1e300), (5, 65.535), (6, 65.536)], "id int, km double")
    got = {r["id"]: r["count"] for r in company.searched_municipalities(rows, "km").groupBy("id").count().collect()}
    assert got == {1: 4, 2: 29, 3: 29, 4: 29, 5: 29, 6: 29}


@pytest.mark.parametrize("seed", [1, 2])
def test_counts_equal_all_pairs(spark, seed):
    chance = random.Random(seed)
    edges = [x + d for x in (0, 2**16, 2**32, 2**48, -(2**16), -(2**32), -(2**48)) for d in (-1, 0, 1)] + [2**63 - 1, -(2**63)]
    number = lambda: chance.choice([None, 50, *edges, chance.randrange(-100, 1000)])
    points = [(number(),) for _ in range(300)] + [(50,)] * 200  # 50 is hot
    spans = [(chance.choice([None, i // 2]), number(), number()) for i in range(200)]  # keys repeat
    got = ranges.interval_counts(spark.createDataFrame(points, "x long"), "x", spark.createDataFrame(spans, "s int, low long, high long"), "low", "high", "s")
    want = {}
    for s, low, high in spans:
        if low is not None and high is not None and (n := sum(x is not None and low <= x <= high for (x,) in points)):
            want[s] = want.get(s, 0) + n
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.items(), key=str)


def test_counts_of_nothing(spark):
    points, spans = spark.range(3).selectExpr("id AS x"), spark.createDataFrame([], "s int, low long, high long")
    assert ranges.interval_counts(points, "x", spans, "low", "high", "s").collect() == []
    one = spark.createDataFrame([(1, 0, 9)], "s int, low long, high long")
    assert ranges.interval_counts(points.where("x < 0"), "x", one, "low", "high", "s").collect() == []
    assert ranges.interval_counts(points, "x", one, "low", "high", "s").collect() == [(1, 3)]


def most_rows(node) -> int:
    """The most rows that any node of an executed plan put out."""
    if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        return most_rows(node.executedPlan())
    if node.getClass().getSimpleName().endswith("QueryStageExec"):
        return most_rows(node.plan())
    made = node.metrics().get("numOutputRows")
    below = node.children()
    return max([made.get().value() if made.isDefined() else 0, *(most_rows(below.apply(i)) for i in range(below.size()))])


def landed_events(spark, folder, rows) -> str:
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_sessions_are_counted_without_pairs(spark, tmp_path):
    # 1,000 signups and 2,000 other events in the same seconds: 3 million pairs
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=i % 5), 1, "signup" if i % 3 == 0 else "view", 1.0, None) for i in range(3000)]
    got = queries.QUERIES["events_in_sessions"](spark, landed_events(spark, tmp_path, rows))
    assert sorted(map(tuple, got.collect())) == [(i, 3000 - 600 * (i % 5)) for i in range(0, 3000, 3)]
    plan = got._jdf.queryExecution().executedPlan()
    assert 1000 <= most_rows(plan) <= 10_000
    # counted once, not once for each level of running sums
    assert plan.toString().split("== Initial Plan ==")[0].count("FileScan") == 3


def test_sessions_before_1970_are_those_of_the_twin(spark, tmp_path):
    chance, at = random.Random(3), datetime.datetime(1970, 1, 1)
    rows = [(i, chance.choice([None, at + datetime.timedelta(milliseconds=chance.randrange(-9000, 3000))]), 1, chance.choice(["signup", "view"]), chance.choice([0.0, 0.01, 0.05, -0.02, None]), None) for i in range(300)]
    got = queries.QUERIES["events_in_sessions"](spark, landed_events(spark, tmp_path, rows)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(queries.ORACLE["events_in_sessions"]).fetchall())
