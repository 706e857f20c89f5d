"""Streaming history: each arrival is NEW, UPDATED or SEEN against keyed state."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replayed(arrivals: DataFrame, key: str, value: str, order: list[str]) -> DataFrame:
    """Batch replay: the status of each arrival against the one before it of the same key."""
    before = Window.partitionBy(key).orderBy(*order)
    known = F.lag(value).over(before)
    first = F.row_number().over(before) == 1
    status = F.when(first, "NEW").when(known.eqNullSafe(F.col(value)), "SEEN").otherwise("UPDATED")
    return arrivals.withColumn("history_status", status)


def classify_batch(batch: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One micro-batch against the state (key, value): statuses, and the state after it. Classify first, then remember."""
    known = state.select("key", F.col("value").alias("known"), F.lit(True).alias("seen"))
    order = Window.partitionBy("key").orderBy("arrival")
    out = batch.join(known, "key", "left")
    prior = F.when(F.row_number().over(order) == 1, F.col("known")).otherwise(F.lag("value").over(order))
    fresh = F.col("seen").isNull() & (F.row_number().over(order) == 1)
    status = F.when(fresh, "NEW").when(prior.eqNullSafe(F.col("value")), "SEEN").otherwise("UPDATED")
    told = out.withColumn("history_status", status).drop("known", "seen")
    latest = batch.groupBy("key").agg(F.max_by("value", "arrival").alias("value"))
    rest = state.join(latest.select("key"), "key", "left_anti")
    return told, rest.unionByName(latest)


def first_arrivals(stream: DataFrame, ids: list[str], at: str, delay: str = "1 day") -> DataFrame:
    """Each id once in a stream: further arrivals within ``delay`` of the first are dropped, and the state of older ones is forgotten.

    ``at`` is cast to a zoned timestamp, which a watermark needs.
    """
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(ids)


def snapshot(history: DataFrame, folder: str, version: int) -> None:
    """A history as a numbered snapshot; one that is written again replaces itself. Its number is written last, so a half-written one does not count."""
    history.write.mode("overwrite").parquet(f"{folder}/data/{version:012d}")
    history.sparkSession.range(version, version + 1).coalesce(1).write.mode("overwrite").parquet(f"{folder}/versions/{version:012d}")


def latest_snapshot(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The newest whole snapshot, or an empty history where there is none."""
    try:
        newest = spark.read.parquet(f"{folder}/versions/*").agg(F.max("id").alias("v")).first()["v"]
    except AnalysisException:  # no such folder
        newest = None
    return spark.createDataFrame([], schema) if newest is None else spark.read.schema(schema).parquet(f"{folder}/data/{newest:012d}")


def run_stream(spark: SparkSession, source: str, schema: str, out: str, key: str, value: str, arrival: str, checkpoint: str) -> None:
    """Read Parquet arrivals as a stream; each micro-batch writes its statuses and a new state snapshot.

    A snapshot is written under its batch number, so a replayed batch overwrites its own output and
    reads the state before it: the result is the same however often a batch is tried.
    """

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.select(F.col(key).alias("key"), F.col(value).alias("value"), F.col(arrival).alias("arrival"))
        before = f"{out}/state/{number - 1}"
        state = session.read.parquet(before) if number else session.createDataFrame([], rows.select("key", "value").schema)
        told, after = classify_batch(rows, state)
        told.write.mode("overwrite").parquet(f"{out}/status/batch={number}")
        after.write.mode("overwrite").parquet(f"{out}/state/{number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
