"""Toxicity by cumulative-link ordinal regression.

P(grade >= k) = sigmoid(w . x - threshold_k): one weight vector shared by all thresholds,
thresholds in order, and the expected severity is the sum of the probabilities over k. The
features are a text's distinct words (runs of letters, ASCII in lower case) and the first bytes of
longer words, which stand for stems, so x is sparse and binary. The fit is a proximal gradient with
an L1 penalty on at most ``MOST_LABELLED`` labelled documents (those with the smallest hash of their
id, a documented bound; of an id that repeats, one text). Spark counts their words; those in at least
``LEAST_ROWS`` of them compete, and the ``MOST_WORDS`` whose presence goes furthest with the grade
are fitted, so the driver holds no texts and no word sets, only which of these words a row has. The model is a sorted list of word hashes with weights, so its size is bounded and no two
words share a weight. Scoring reads every whole text of the table once, without a shuffle.

Grades come from the labels: 0 not toxic, 1 toxic, 2 toxic and of low quality. Rows of labels
with a null id or a null toxic value are not fitted; a null quality counts as good.

Defined results: a null or empty text has no words and gets the model's base rate; repeated rows
score alike; without toxic or without clean labelled rows nothing is rejected (severity 0); an
empty table gives no rows; columns besides doc_id and text are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table, written
from lodestone.llm.words import NOT_LETTER, words

MOST_LABELLED = 6_000
MOST_WORDS = 4_096
STEMS = (4, 5)
LEAST_ROWS = 5
PENALTY = 5e-4
STEPS = 800
REJECT_AT = 0.2
SEED = 23


@dataclass
class Model:
    hashes: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    gaps: np.ndarray


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def features(column: pa.Array) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, and row number and hash of each feature that occurs in them; not yet distinct."""
    for part in words(column, lower=True, between=NOT_LETTER, prefixes=STEMS):
        row = part.row_of_word()
        kinds = [(row, part.hashes), *((row[p > 0], p[p > 0]) for p in part.prefixes)]
        yield part.rows, np.concatenate([r for r, _ in kinds]), np.concatenate([h for _, h in kinds])


def distinct_words(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but text, and hashes: the distinct features of the text, as sorted 64-bit hashes."""
    kept = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, row, hashes in features(batch.column("text")):
                n = rows.stop - rows.start
                order = np.lexsort((hashes, row))
                row, hashes = row[order], hashes[order]
                fresh = np.ones(len(row), bool)
                fresh[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
                at = np.concatenate([[0], np.cumsum(np.bincount(row[fresh], minlength=n))]).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(at), pa.array(hashes[fresh].view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(rows.start, n) for c in kept), sets], [*kept, "hashes"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(kept).schema)
    return docs.select(*kept, "text").mapInArrow(run, f"{schema}, hashes array<long>")


def vocabulary(sample: DataFrame) -> np.ndarray:
    """The features of (grade, hashes) to fit on, in ascending order: at most ``MOST_WORDS`` numbers come to the driver."""
    mean = sample.agg(F.avg("grade")).first()[0]
    counts = sample.select("grade", F.explode("hashes").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("grade").alias("grades"))
    pull = F.abs(F.col("grades") - F.lit(mean) * F.col("n")) / F.sqrt("n")
    best = counts.where(F.col("n") >= LEAST_ROWS).select("hash", pull.alias("pull")).where("pull > 0").orderBy(F.col("pull").desc(), "hash").limit(MOST_WORDS)
    return np.sort(np.array([r["hash"] for r in best.select("hash").collect()], np.int64).view(np.uint64))


def indexed(sample: DataFrame, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grades of the rows of (row, grade, hashes), and each presence of a chosen feature as row and column number.

    At most two bytes for each row and feature come to the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes")
            values, sizes = hashes.flatten().to_numpy().view(np.uint64), hashes.value_lengths().to_numpy()
            place = np.minimum(np.searchsorted(chosen, values), max(0, len(chosen) - 1))
            hit = chosen[place] == values if len(chosen) else np.zeros(len(values), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)[hit]
            edge = np.searchsorted(row, np.arange(len(sizes) + 1))
            raw = place[hit].astype("<u2")
            packed = [raw[edge[i] : edge[i + 1]].tobytes() for i in range(len(sizes))]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("grade"), pa.array(packed, pa.binary())], ["row", "grade", "columns"])

    got = sample.select("row", "grade", "hashes").mapInArrow(run, "row long, grade int, columns binary").toArrow().sort_by([("row", "ascending"), ("grade", "ascending")])
    sizes = [len(x.as_buffer()) // 2 for x in got.column("columns")]
    columns = np.frombuffer(b"".join(x.as_py() for x in got.column("columns")), "<u2").astype(np.int32)
    return got.column("grade").to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), columns


def fit_model(grade: np.ndarray, row: np.ndarray, at: np.ndarray, chosen: np.ndarray) -> Model:
    """grade of each row; row and at: where a feature of ``chosen`` is present. FISTA on the mean negative log likelihood of the grades."""
    levels = np.array(sorted(set(grade.tolist())))
    if len(levels) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), np.zeros(0))
    rows, n = len(grade), len(chosen)
    # thresholds are levels[1:]; each is a free number, kept in order by sorting after a step
    above = (grade[:, None] >= levels[None, 1:]).astype(float)
    weights, theta = np.zeros(n), -np.log(above.mean(0) / (1 - above.mean(0)))
    own = np.searchsorted(levels, grade)
    seen_w, seen_t, momentum = weights, theta, 1.0
    per_row = np.bincount(row, minlength=rows)
    step = 4.0 / (1 + float(np.quantile(per_row, 0.99)))
    for _ in range(STEPS):
        score = np.bincount(row, seen_w[at], rows)
        edge = np.concatenate([[np.inf], -seen_t, [-np.inf]])
        # P(grade = j) = s(score - t_j) - s(score - t_{j+1})
        high, low = sigmoid(score + edge[own]), sigmoid(score + edge[own + 1])
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        d_score = -(d_high - d_low) / rows
        d_edge = np.bincount(own, -d_high, len(levels) + 1) + np.bincount(own + 1, d_low, len(levels) + 1)
        d_theta = -d_edge[1:-1] / rows
        moved = seen_w - step * np.bincount(at, d_score[row], n)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * PENALTY, 0)
        new_t = np.sort(seen_t - step * d_theta)
        after = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        seen_w = new_w + (momentum - 1) / after * (new_w - weights)
        seen_t = np.sort(new_t + (momentum - 1) / after * (new_t - theta))
        weights, theta, momentum = new_w, new_t, after
    kept = np.flatnonzero(weights)
    return Model(chosen[kept], weights[kept], theta, np.diff(levels).astype(float))


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled documents, one text of each.

    Words are counted and chosen by Spark; what comes to the driver is bounded by ``most`` and ``MOST_WORDS``, however long the texts.
    """
    graded = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce("quality", F.lit(1)) == 0, 2).otherwise(1)
    graded = graded.groupBy("doc_id").agg(F.max(grade).alias("grade"))
    chosen = graded.orderBy(F.xxhash64(F.col("doc_id"), F.lit(SEED)), "doc_id").limit(most)
    # at most ``most`` rows of two numbers are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # an id that repeats over many rows gives one of its texts, chosen by hash before anything is shuffled
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.length("text"))).alias("text"))
    sample = distinct_words(rows.select(F.xxhash64("doc_id", F.lit(SEED)).alias("row"), "grade", "text"))
    sample = written(sample, "toxicity-sample")
    if sample.select("grade").distinct().count() < 2:
        return fit_model(*(np.zeros(0, t) for t in (np.int64, np.int32, np.int32, np.uint64)))
    words_in_use = vocabulary(sample)
    return fit_model(*indexed(sample, words_in_use), words_in_use)


def scored(column: pa.Array, model: Model) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Rows, their p_toxic and their severity."""
    for rows, row, hashes in features(column):
        n = rows.stop - rows.start
        total = np.zeros(n)
        if len(model.hashes):
            place = np.minimum(np.searchsorted(model.hashes, hashes), len(model.hashes) - 1)
            hit = np.flatnonzero(model.hashes[place] == hashes)
            once = np.unique(row[hit] * len(model.hashes) + place[hit])  # presence, not counts
            total = np.bincount(once // len(model.hashes), model.weights[once % len(model.hashes)], n)
        above = sigmoid(total[:, None] - model.thresholds[None, :])
        yield rows, above[:, 0] if len(model.thresholds) else np.zeros(n), above @ model.gaps


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p_toxic, severity and rejected of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, p, severity in scored(batch.column("text"), model):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(rows.start, len(p)), pa.array(p), pa.array(severity), pa.array(p >= REJECT_AT)], ["doc_id", "p_toxic", "severity", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, p_toxic double, severity double, rejected boolean")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not rejected, each by its own text whatever its id."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, p, _ in scored(batch.column("text"), model):
                yield batch.slice(rows.start, len(p)).filter(pa.array(p < REJECT_AT))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
