"""Keyed streams and the change log against plain replays."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestone.streaming import changelog, keyed
from lodestone.streaming.changelog import ChangeLog

START = datetime(2026, 8, 1)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


# --- history


def test_keyed_history_equals_replay_over_restarts(spark, tmp_path):
    chance = random.Random(4)
    rows = [(i, chance.choice(["a", "b", "c", None]), chance.choice(["x", "y", None]), START + timedelta(minutes=i)) for i in range(90)]
    schema = "id long, key string, value string, at timestamp"
    session = keyed.state_session(spark)
    for part in (rows[:40], [], rows[40:41], rows[41:]):  # a start without arrivals too
        if part:
            land(spark, f"{tmp_path}/in", part, schema)
        keyed.run(keyed.classified(keyed.arrivals(session, f"{tmp_path}/in", schema, 1), "key", "value", "at", "id"), f"{tmp_path}/out", f"{tmp_path}/c")
    known, want = {}, {}
    for i, key, value, _ in rows:
        want[i] = "NEW" if key not in known else "SEEN" if known[key] == value else "UPDATED"
        known[key] = value
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert {r["id"]: r["history_status"] for r in got} == want and len(got) == len(rows)


def test_keyed_history_touches_only_the_keys_of_a_batch(spark, tmp_path):
    schema = "id long, key string, value string, at timestamp"
    session = keyed.state_session(spark)
    land(spark, f"{tmp_path}/in", [(i, f"k{i}", "x", START) for i in range(500)], schema)
    keyed.run(keyed.classified(keyed.arrivals(session, f"{tmp_path}/in", schema), "key", "value", "at", "id"), f"{tmp_path}/out", f"{tmp_path}/c")
    land(spark, f"{tmp_path}/in", [(1000, "k3", "y", START)], schema)
    told = keyed.classified(keyed.arrivals(session, f"{tmp_path}/in", schema), "key", "value", "at", "id")
    query = told.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination()
    state = json.loads(query.lastProgress.json)["stateOperators"][0]
    assert (state["numRowsTotal"], state["numRowsUpdated"]) == (500, 1)


# --- deadlines


@pytest.mark.parametrize("size", [1000, 7])
def test_deadlines_close_once_whatever_the_batches(spark, tmp_path, size):
    chance = random.Random(size)
    hours = lambda h: START + timedelta(hours=h)
    rows = [(f"k{chance.randrange(5)}", hours(i + chance.random()), hours(i + chance.uniform(-2, 30)) if chance.random() > 0.2 else None) for i in range(60)]
    rows += [("late", hours(10), hours(12)), ("end", hours(200), None)]
    schema = "key string, at timestamp, deadline timestamp"
    session = keyed.state_session(spark)
    for n in range(0, len(rows), size):
        part = rows[n : n + size]
        chance.shuffle(part)
        land(spark, f"{tmp_path}/in", part, schema)
    # rows of one delivery and of the next may be out of order by up to a day
    keyed.run(keyed.closed(keyed.arrivals(session, f"{tmp_path}/in", schema, 1), "key", "at", "deadline", "120 hours"), f"{tmp_path}/out", f"{tmp_path}/c")
    end, want = hours(200 - 120), []
    for key, at, deadline in rows:
        later = [b for k, b, _ in rows if k == key and at < b and deadline and b <= deadline]
        if deadline and not later and max(at, deadline) <= end:
            want.append((key, deadline))
    got = [(r["key"], r["deadline"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(got) == sorted(want) and len(want) > 5


def test_a_key_has_one_timer_at_a_time():
    class Handle:
        def __init__(self):
            self.timers, self.held = [], []

        def getListState(self, *_):  # noqa: N802
            return self

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def get(self):
            return iter(self.held)

        def put(self, held):
            self.held = held

        def clear(self):
            self.held = []

    class Watermark:
        at = 0

        def getCurrentWatermarkInMs(self):  # noqa: N802
            return self.at

    handle, processor = Handle(), keyed.Deadlines()
    processor.init(handle)
    rows = pd.DataFrame({"at_us": [i * 1000 for i in range(1, 101)], "deadline": [i * 1000 + 500 for i in range(1, 101)]})
    told = [r for frame in processor.handleInputRows(("k",), iter([rows]), Watermark()) for r in frame["deadline"]]
    assert told == [] and handle.timers == [2] and len(handle.held) == 100
    while handle.held:
        Watermark.at = max(handle.timers[-1], Watermark.at + 30)
        told += [r for frame in processor.handleExpiredTimer(("k",), Watermark(), None) for r in frame["deadline"]]
    assert told == rows["deadline"].tolist() and len(handle.timers) <= 5


# --- the change log


def test_change_log_equals_a_dictionary(spark, tmp_path):
    chance, log, want, version = random.Random(2), ChangeLog(spark, f"{tmp_path}/log", "string", 4), {}, 0
    assert log.current().collect() == [] and log.merge(0) == 0
    for _ in range(9):
        changes, at = [], 0
        for _ in range(chance.choice([3, 12])):
            at += 1
            owner, item = f"o{chance.randrange(6)}", f"i{chance.randrange(4)}"
            kind = chance.random()
            if kind < 0.15:
                changes.append((owner, None, None, True, at))
                want = {k: v for k, v in want.items() if k[0] != owner}
            elif kind < 0.3:
                changes.append((owner, item, None, True, at))
                want.pop((owner, item), None)
            else:
                changes.append((owner, item, f"v{version}.{at}", False, at))
                want[owner, item] = f"v{version}.{at}"
        frame = spark.createDataFrame(changes, "owner string, item string, value string, deleted boolean, at long")
        log.commit(frame, version)
        log.commit(frame, version)  # a batch that is tried again
        version += 1
        if log.merge(version):
            version += 1
        assert {(r["owner"], r["item"]): r["value"] for r in log.current().collect()} == want
    asked = spark.createDataFrame([("o1",), ("o4",), ("none",)], "owner string")
    assert {(r["owner"], r["item"]): r["value"] for r in log.current(asked).collect()} == {k: v for k, v in want.items() if k[0] in ("o1", "o4")}
    assert log.vacuum()  # merged segments are named, and no live one is
    assert not {f"{log.folder}/segments/{s.name}/bucket={s.bucket}" for s in log.live()[1]} & set(log.vacuum())


def test_change_log_leaves_other_buckets_alone(spark, tmp_path):
    log = ChangeLog(spark, f"{tmp_path}/log", "string", 8)
    many = spark.range(400).select(F.concat(F.lit("o"), "id").alias("owner"), F.lit("").alias("item"), F.lit("v").alias("value"), F.lit(False).alias("deleted"), F.lit(0).cast("long").alias("at"))
    log.commit(many, 0)
    before = set(log.live()[1])
    for version in range(1, 1 + changelog.TIER):
        log.commit(many.where("owner = 'o7'").withColumn("value", F.lit(f"v{version}")), version)
    assert log.merge(10) == changelog.TIER  # the small segments of one bucket; its large one is of another tier
    after = set(log.live()[1])
    assert before < after and len(after) == len(before) + 1
    assert log.current(spark.createDataFrame([("o7",)], "owner string")).first()["value"] == f"v{changelog.TIER}"
    assert log.current().count() == 400


def test_tiers():
    assert [changelog.tier(n) for n in (0, 1, 4, 5, 16, 17, 64, 65)] == [0, 0, 0, 1, 1, 2, 2, 3]
