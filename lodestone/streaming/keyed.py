"""Keyed state over a stream: history and deadlines of postings in a RocksDB state store.

A micro-batch reads and writes the state of the keys that occur in it and no other; the store's changelog is what a
checkpoint uploads. Everything that a processor remembers is in the checkpoint, so a stream that is stopped, fails or
is started again goes on as if it had not been, and writes no row twice (the file sink logs its batches).

A key's rows of one micro-batch are put in order by the task that has the key, so that their number is bounded by the
batch (``max_files``), not by the history.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_FALLBACK: list[str] = []


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which driver and executors share; where it is unset and the master is local, one of this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="lodestone-stream-"))
        named = _FALLBACK[0]
    return f"{named.rstrip('/')}/lodestone/{label}-{uuid.uuid4().hex}"


def state_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose streams keep their state in RocksDB; ``spark`` stays as it is."""
    session = spark.newSession()
    for key, value in _STORE.items():
        session.conf.set(key, value)
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    return session


class History(StatefulProcessor):
    """Each arrival of a key is NEW, UPDATED or SEEN against the value before it. State: the last value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "value string, there boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["at", "id"], kind="stable")
        known = self.known.get() if self.known.exists() else None
        told = []
        for value in batch["value"]:
            value = None if pd.isna(value) else value
            told.append("NEW" if known is None else "SEEN" if known[0] == value else "UPDATED")
            known = (value, True)
        self.known.update(known)
        yield pd.DataFrame({"key": batch["key"], "id": batch["id"], "history_status": told})

    def close(self) -> None:
        pass


def classified(stream: DataFrame, key: str, value: str, at: str, id: str) -> DataFrame:  # noqa: A002
    """key, id, history_status of every row of a stream; rows of a key count in the order of ``at`` and ``id``, and nothing is too late.

    A null value is a value like any other; a null key is a key.
    """
    rows = stream.select(F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("null")).alias("key"), F.col(value).cast("string").alias("value"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.col(id).alias("id"))
    kind = stream.schema[id].dataType.simpleString()
    return rows.groupBy("key").transformWithStateInPandas(History(), f"key string, id {kind}, history_status string", "append", "none")


class Deadlines(StatefulProcessor):
    """A key is CLOSED at a deadline if the arrival that set it is then still the newest. State: the arrivals that may matter.

    A timer runs when the watermark has passed the next deadline that may be met. All arrivals up to then are known, in
    whatever batches they came, so the outcome does not depend on how the stream was cut. A key has one timer at a time, not one
    for each arrival: whatever is due when it runs, or when rows come, is told together.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "at long, deadline long")

    def settled(self, key: tuple, held: list[tuple[int, int]], watermark: int) -> Iterator[pd.DataFrame]:
        """Keep what may still matter after ``watermark`` (microseconds), and tell the deadlines that were met.

        ``held`` is in order. A row that comes later lies behind the watermark, so one before it can supersede nothing more.
        """
        due, left, wake = [], [], None
        for i, (at, deadline) in enumerate(held):
            superseded = i + 1 < len(held) and held[i + 1][0] <= deadline
            if superseded or max(at, deadline) <= watermark:
                if not superseded and deadline >= 0:
                    due.append(deadline)
                if at > watermark:
                    left.append((at, deadline))
            else:
                left.append((at, deadline))
                wake = max(at, deadline) if wake is None else min(wake, max(at, deadline))
        if left:
            self.open.put(left)
            # the last of ``left`` is superseded by none of the rows after it, so there is always a next time
            self.handle.registerTimer(-(-wake // 1000))
        elif held:
            self.open.clear()
        if due:
            yield pd.DataFrame({"key": [key[0]] * len(due), "deadline": due, "status": "CLOSED"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = list(self.open.get())
        for batch in rows:
            for at, deadline in zip(batch["at_us"].tolist(), batch["deadline"].tolist(), strict=True):
                held.append((at, deadline))
        yield from self.settled(key, sorted(held), timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self.settled(key, [tuple(x) for x in self.open.get()], timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def closed(stream: DataFrame, key: str, at: str, deadline: str, delay: str) -> DataFrame:
    """key, deadline, status of each deadline at which a key closes, once the watermark (``delay`` behind the newest row) has passed it.

    A row without a deadline keeps its key open; rows of one time count in the order of their deadlines; later than ``delay`` is too late.
    """
    rows = stream.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", delay)
    micros = F.coalesce(F.unix_micros(F.col(deadline).cast("timestamp")), F.lit(-1))
    rows = rows.select("at", F.col(key).cast("string").alias("key"), F.unix_micros("at").alias("at_us"), micros.alias("deadline")).where("at IS NOT NULL")
    told = rows.groupBy("key").transformWithStateInPandas(Deadlines(), "key string, deadline long, status string", "append", "eventTime")
    return told.withColumn("deadline", F.timestamp_micros("deadline"))


def run(told: DataFrame, out: str, checkpoint: str) -> None:
    """Take what has arrived since the last time, append what it tells to ``out``, and stop."""
    query = told.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
    query.awaitTermination()


def arrivals(session: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    return session.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def landed_in_turn(rows: DataFrame, at: str, folder: str, parts: int) -> Iterator[None]:
    """Land ``rows`` as ``parts`` deliveries of equal spans of time, and give way after each."""
    span = rows.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    if span["low"] is None:
        return
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    low, high = micros(F.lit(span["low"])), micros(F.lit(span["high"]))
    part = F.least(F.lit(parts - 1), F.floor((micros(F.col(at)) - low) * parts / F.greatest(high - low, F.lit(1))))
    for i in range(parts):
        rows.where(F.coalesce(part, F.lit(0)) == i).write.mode("append").parquet(folder)
        yield
