"""The data source over landed responses: pruning, pushed filters, broken lines."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lodestone.operators import company
from lodestone.sources import boards, cvs, landed


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    for board in ("alpha", "beta"):
        for day, items in {"2026-07-30": [("1", "2026-07-30T10:00:00Z", "x"), ("2", "2026-07-30T23:30:00+00:00", {"a": [1]})], "2026-08-01": [("3", "2026-08-01T00:00:00Z", "é\nline")], "unknown": [("4", None, ""), ("5", "soon", None)]}.items():
            (root / f"board={board}" / f"day={day}").mkdir(parents=True)
            text = "\n".join(json.dumps({"id": i, "at": at, "body": body}) for i, at, body in items)
            (root / f"board={board}" / f"day={day}" / "part-0").write_text(text + "\n\n{broken\n" if day == "unknown" else text)
            (root / f"board={board}" / f"day={day}" / "_SUCCESS").write_text("")
    return f"file://{root}"


def test_all_rows(spark, folder):
    rows = {(r["board"], r["id"]): r for r in landed.landed(spark, folder).collect()}
    assert len(rows) == 12 and rows["beta", None]["unreadable"] == "{broken"
    assert rows["alpha", "2"]["body"] == '{"a": [1]}' and rows["alpha", "3"]["body"] == "é\nline" and rows["alpha", "5"]["published_at"] is None


def test_filters_are_pushed_down(spark, folder):
    rows = landed.landed(spark, folder)
    since = F.lit(datetime(2026, 7, 31, tzinfo=UTC))
    kept = rows.where((F.col("board") == "beta") & (F.col("published_at") >= since) & (F.length("body") > 0))
    assert [r["id"] for r in kept.collect()] == ["3"]
    plan = kept._jdf.queryExecution().executedPlan().toString()
    above = [line for line in plan.splitlines() if "Filter" in line]
    assert not any("published_at" in line and ">=" in line for line in above) and any("length(body" in line for line in above)


def test_pruning_reads_no_other_folder(folder):
    reader = landed.LandedReader(folder, None)
    day = datetime(2026, 8, 1, tzinfo=UTC)
    left = list(reader.pushFilters([landed.EqualTo(("board",), "alpha"), landed.In(("board",), ("alpha", "beta")), landed.GreaterThan(("published_at",), day), landed.EqualTo(("id",), "3")]))
    assert left == [landed.EqualTo(("id",), "3")]
    files = [path for part in reader.partitions() for path, _ in part.files]
    assert len(files) == 1 and "board=alpha/day=2026-08-01" in files[0]
    assert not [row for part in reader.partitions() for b in reader.read(part) for row in b.to_pylist()]  # the bound itself is not above it


def test_look_back_keeps_what_has_no_date(spark, folder):
    now = int(datetime(2026, 8, 1, 12, tzinfo=UTC).timestamp())
    got = landed.landed(spark, folder, now, 86400).where("board = 'alpha'").collect()
    assert sorted(r["id"] or "" for r in got) == ["", "3", "4", "5"]


def test_partitions_hold_whole_files(folder, monkeypatch):
    monkeypatch.setattr(landed, "PARTITION_BYTES", 1)
    assert len(landed.LandedReader(folder, None).partitions()) == 6


def test_what_is_landed_is_read(spark, tmp_path):
    rows = [("a", "1", "2026-08-01T10:00:00Z", "b"), ("a", "2", "soon", None)]
    landed.land(spark.createDataFrame(rows, "board string, id string, at string, body string"), f"file://{tmp_path}/x")
    assert sorted((r["id"], r["body"]) for r in landed.landed(spark, f"file://{tmp_path}/x").collect()) == [("1", "b"), ("2", None)]
    assert landed.landed(spark, f"file://{tmp_path}/none").collect() == []


def _plain_rows(body):
    """The same by a plain walk."""

    def lists(x):
        if isinstance(x, list):
            yield x
        for item in x if isinstance(x, list) else x.values() if isinstance(x, dict) else ():
            yield from lists(item)

    try:
        payload = json.loads(body or "null")
    except ValueError:
        return []
    for items in lists(payload):
        if items and all(isinstance(x, dict) for x in items[:3]) and any(isinstance(x, dict) and set(x) & set(boards.TITLE_KEYS) for x in items[:10]):
            return [x for x in items if isinstance(x, dict)]
    return []


def test_recursive_finder_equals_a_plain_walk(spark):
    import random

    chance = random.Random(5)

    def value(depth):
        kind = chance.random()
        if depth == 0 or kind < 0.25:
            return chance.choice([1, None, True, "t", '[{"title": 1}]', "[1]", "{}", 2.5])
        if kind < 0.6:
            return [value(depth - 1) for _ in range(chance.randrange(5))]
        return {k: value(depth - 1) for k in chance.sample(["zz", "title", "position", "a", "items", "name", "data"], chance.randrange(4))}

    bodies = [json.dumps(value(5)) for _ in range(150)] + ["not json", None, "", "[]", '{"z": [{"title": null}], "a": [{"title": 2}]}', '[{"x": 1}, {"title": 1}, 3]', '[{"x": 1}, {"x": 2}, {"title": 3}, 4]']
    for lot in (bodies[:80], bodies[80:]):
        got = [json.loads(r["json"]) for r in boards.titled_rows(spark.createDataFrame([(b,) for b in lot], "body string")).collect()]
        want = [x for b in lot for x in _plain_rows(b)]
        key = lambda x: json.dumps(x, sort_keys=True)
        assert sorted(map(key, got)) == sorted(map(key, want)) and want


def test_cv_files(spark, tmp_path):
    body = "Jo Doe\r\nDelivery   lead\t of many projects.\n\n\n\n" + "Owned budgets and releases across regions. " * 4
    for name, data in {"a cv.TXT": body.encode(), "short.txt": b"hello", "b.pdf": b"%PDF", "c.doc": b"x", "big.txt": b"x" * (cvs.MOST_BYTES + 1)}.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["file_name"]: r for r in cvs.scan(spark, f"file://{tmp_path}").collect()}
    good = rows["a cv.TXT"]
    assert good["fault"] is None and good["cv_text"].startswith("Jo Doe\n\nDelivery lead of many projects.\n\nOwned") and good["chars"] == len(good["cv_text"])
    assert good["source_version"] == "sha256:" + hashlib.sha256(body.encode()).hexdigest() and good["file_type"] == "text/plain"
    assert "8 MB" in rows["big.txt"]["fault"] and rows["big.txt"]["source_version"] is None
    assert rows["b.pdf"]["fault"] == "not decoded" and "Legacy" in rows["c.doc"]["fault"] and "enough text" in rows["short.txt"]["fault"]


def test_employer_links(spark):
    html = "".join(f'<a href="{h}">{t}</a>' for h, t in [("/careers", "Work here"), ("careers", "again"), ("/careers#x", "Jobs"), ("mailto:jobs@x.dk", "Jobs"), ("/it-project-manager_2", "Open"), ("/x", "Delivery <b>Manager</b>"), ("/y", "Cook")] + [(f"/jobs/{i}", "j") for i in range(30)])
    pages = spark.createDataFrame([(1, "https://firm.example/", html), (2, "https://firm.example/", None)], "id int, url string, html string")
    career = company.career_links(pages, "id", "url", "html").orderBy("at").collect()
    assert len(career) == company.MOST_CAREER_LINKS and career[0]["url"] == "https://firm.example/careers" and career[0]["label"] == "Work here"
    assert [r["url"] for r in company.job_links(pages, "id", "url", "html").orderBy("at").collect()] == ["https://firm.example/it-project-manager_2", "https://firm.example/x"]
