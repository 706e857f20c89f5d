"""The pipeline's stages, each on what the one before kept, against plain Python on a small corpus."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

pytest.importorskip("lodestone.llm")
corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_corpus_operators import WORD, joined, prose  # noqa: E402


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(21)
    folder = tmp_path_factory.mktemp("sf")
    item = prose(25, rng)
    rows, labels = [], []
    for i in range(200):
        toxic = i % 5 == 0
        rows.append((i, prose(int(rng.integers(20, 80)), rng) + (" vilest grokkers" if toxic else ""), "en", f"s{i % 4}", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(300, rows[1][1], "en", "s1", 0), (301, rows[2][1] + " more", "en", "s1", 0), (302, prose(10, rng) + " " + item, "en", None, 0), (303, None, None, "s2", None), (304, "", "en", "s3", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows


def test_stages(spark, tables, tmp_path):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r[0]: r[1] for r in rows}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(seen[name].columns == columns for name in list(seen)[:-1])
    clean = {i for i in kept if not (i < 200 and i % 5 == 0)}
    assert {r["doc_id"] for r in seen["toxicity"].collect()} == clean
    names = {d: c for d, _, c in joined([(i, kept[i]) for i in sorted(clean)])}
    single = {i for i in clean if names[i] == i}
    assert {r["doc_id"] for r in seen["ngram_join"].collect()} == single and not {300, 301} & single
    assert {r["doc_id"] for r in seen["decontamination"].collect()} == single - {302}
    mixed = seen["mixing"].collect()
    words = Counter()
    for r in mixed:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert kept[r["doc_id"]].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert all(n <= 3 * len(WORD.findall(kept[i])) for i, n in words.items())
    total = sum(len(WORD.findall(kept[i] or "")) for i in single - {302})
    assert abs(sum(words.values()) - total) <= 0.05 * total
    tokens = seen["token_files"].collect()
    assert Counter(r["doc_id"] for r in tokens) == Counter(r["doc_id"] for r in mixed)
    assert sorted(r["start"] for r in tokens)[0] == 0


def test_rows_of_null_and_repeated_ids(spark, tables, tmp_path):
    """Each row is decided by its own text."""
    folder, _ = tables
    rng = np.random.default_rng(22)
    clean = [prose(40 + i, rng) for i in range(12)]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    toxic, leaked = prose(30, rng) + " vilest grokkers", prose(10, rng) + " " + item
    rows = [(None if i < 8 else 900, t, "en", "s0", 0) for i, t in enumerate(clean)] + [(d, t, "en", "s0", 0) for d in (None, 900) for t in (toxic, leaked)]
    rows += [(None, clean[9] + " more", "en", "s0", 0), (None, clean[3], "en", "s0", 0)]
    # the model is fitted on the documents of the stage
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    ours = lambda docs: Counter(r["text"] for r in docs.where("doc_id IS NULL OR doc_id = 900").collect())
    stages = dict(corpus_pipeline.STAGES)
    want = Counter(r[1] for r in rows)
    kept = stages["toxicity"](spark, docs, folder)
    assert ours(kept) == want - Counter({toxic: 2})
    mine = spark.createDataFrame([r for r in rows if r[1] != toxic], docs.schema)
    assert ours(stages["ngram_join"](spark, mine, folder)) == Counter([*clean, leaked])
    assert ours(stages["decontamination"](spark, mine, folder)) == want - Counter({toxic: 2, leaked: 2})
    got = stages["mixing"](spark, spark.createDataFrame(rows[:12], docs.schema), folder).collect()
    total = sum(len(WORD.findall(t)) for t in clean)
    assert abs(sum(len(WORD.findall(r["text"])) for r in got) - total) <= 20


def test_run(spark, tables):
    folder, _ = tables
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 0
