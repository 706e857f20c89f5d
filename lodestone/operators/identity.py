"""Identity, duplicates and history of postings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import identity


def fingerprint() -> Column:
    """SHA-1 of source and id, or of company, title and place where either is missing."""
    source, own = F.coalesce("source", F.lit("")), F.coalesce("source_job_id", F.lit(""))
    by_id = F.concat_ws("|", identity(source), identity(own))
    by_text = F.concat_ws("|", identity(F.col("company")), identity(F.col("title")), identity(F.col("location")))
    return F.sha1(F.when((source != "") & (own != ""), by_id).otherwise(by_text).cast("binary"))


def material_hash() -> Column:
    """SHA-1 of the fields of which a change makes a posting new; nulls are empty."""
    parts = ("title", "description", "location", "remote_type", "vacancy_status", "deadline", "salary_min", "salary_max")
    return F.sha1(F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in parts)).cast("binary"))


def deduplicated(jobs: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """One row a key: verified first, then the longest text, then the newest, then the first to arrive.

    max_by keeps one row a key in each task before anything is shuffled, which a window would not.
    """
    rank = F.struct(F.col("full_jd_verified"), F.length(F.coalesce("description", F.lit(""))), F.col("published_at"), -F.col(pos))
    best = jobs.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in jobs.columns if c not in keys)), rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*jobs.columns)


def first_arrived(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """min_by aggregates before the shuffle, which a window would not."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), pos).alias("_row")).select(*keys, "_row.*")


def last_arrived(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), pos).alias("_row")).select(*keys, "_row.*")


def folded(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """In order of arrival, a row replaces the kept one if it is newer or its text is longer. Not a total order, so a fold.

    The rows of a key pass in order through one task, which holds the kept row and no other.
    """
    lean = rows.select(F.struct(*keys).alias("key"), F.col(pos).cast("long").alias("pos"), F.col("published_at").cast("double").alias("at"), F.length(F.coalesce("description", F.lit(""))).cast("long").alias("n"))
    sorted_rows = lean.repartition("key").sortWithinPartitions("key", "pos")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            done = []
            for key, pos_, at, n in zip(*(batch.column(c).to_pylist() for c in ("key", "pos", "at", "n")), strict=True):
                if kept is not None and kept[0] != key:
                    done.append(kept)
                    kept = None
                if kept is None or (at is not None and kept[2] is not None and at > kept[2]) or n > kept[3]:
                    kept = (key, pos_, at, n)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.column("key").type), pa.array([d[1] for d in done], pa.int64())], ["key", "pos"])
            kind = batch.column("key").type
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([kept[0]], kind), pa.array([kept[1]], pa.int64())], ["key", "pos"])

    return sorted_rows.mapInArrow(fold, f"key {lean.schema['key'].dataType.simpleString()}, pos long").select("key.*", F.col("pos").alias(pos))


def history_status(jobs: DataFrame, history: DataFrame) -> DataFrame:
    """NEW, UPDATED or SEEN against (fingerprint, material_hash). An equi-join: both sides shuffle on the fingerprint only."""
    known = history.select("fingerprint", F.col("material_hash").alias("known_hash"))
    out = jobs.join(known, "fingerprint", "left")
    status = F.when(F.col("known_hash").isNull(), "NEW").when(F.col("known_hash") != F.col("material_hash"), "UPDATED").otherwise("SEEN")
    return out.withColumn("history_status", status).drop("known_hash")


def remembered(history: DataFrame, jobs: DataFrame) -> DataFrame:
    """History with the jobs taken in: theirs replace what was known, the rest stays."""
    columns = ["fingerprint", "material_hash", "source", "source_job_id"]
    rest = history.select(columns).join(jobs.select("fingerprint"), "fingerprint", "left_anti")
    return rest.unionByName(jobs.select(columns))
