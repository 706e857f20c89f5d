"""Landed responses of the boards as a Spark data source: ``spark.read.format("landed_responses")``.

Ingestion lands a line of JSON {"id", "at", "body"} for each response under board=<name>/day=<yyyy-mm-dd>/ (day=unknown where
a response has no date). The source lists the folders once, prunes boards and days by the filters that Spark pushes
down, makes partitions of whole files of about ``PARTITION_BYTES``, and applies what it was given row by row, so that
nothing is read that a filter rules out. ``look_back`` (seconds before ``now``) is the freshness that a board is asked
for; it keeps responses without a date, which a comparison would not.

Any folder that pyarrow's file systems reach will do (file:, s3:, gs:, hdfs:). A line that is not JSON is a row with a
null body and its text in ``unreadable``: a broken response is counted, and stops nothing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual)

PARTITION_BYTES, BATCH = 32 << 20, 500
SCHEMA = "board string, id string, published_at timestamp, body string, unreadable string"
_ARROW = pa.schema([("board", pa.string()), ("id", pa.string()), ("published_at", pa.timestamp("us", "UTC")), ("body", pa.string()), ("unreadable", pa.string())])
UNKNOWN = "unknown"


def instant(text: object) -> datetime | None:
    try:
        at = datetime.fromisoformat(str(text).replace("Z", "+00:00"))
    except ValueError:
        return None
    return at if at.tzinfo else at.replace(tzinfo=UTC)


@dataclass
class Files(InputPartition):
    files: list[tuple[str, str]]  # path, board

    def __init__(self, files: list[tuple[str, str]]) -> None:
        super().__init__(None)
        self.files = files


class LandedReader(DataSourceReader):
    def __init__(self, path: str, since: datetime | None) -> None:
        self.path, self.since = path, since
        self.boards: set[str] | None = None
        self.low: tuple[datetime, bool] | None = None  # and whether the bound itself belongs to it
        self.high: tuple[datetime, bool] | None = None
        self.dated = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes board = and in, and bounds of published_at; the rest is left to Spark."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("board",) and isinstance(f, EqualTo | In):
                named = set(f.value) if isinstance(f, In) else {f.value}
                self.boards = named if self.boards is None else self.boards & named
            elif column == ("published_at",) and isinstance(f, GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and isinstance(f.value, datetime):
                bound = (f.value if f.value.tzinfo else f.value.replace(tzinfo=UTC), isinstance(f, GreaterThanOrEqual | LessThanOrEqual))
                if isinstance(f, GreaterThan | GreaterThanOrEqual):
                    self.low = bound if self.low is None else max(self.low, bound, key=lambda b: (b[0], not b[1]))
                else:
                    self.high = bound if self.high is None else min(self.high, bound)
                self.dated = True
            elif column == ("published_at",) and isinstance(f, IsNotNull):
                self.dated = True
            else:
                yield f

    def takes(self, at: datetime | None) -> bool:
        if at is None:
            return not self.dated
        if self.since and at < self.since:
            return False
        above = self.low is None or at > self.low[0] or (at == self.low[0] and self.low[1])
        return above and (self.high is None or at < self.high[0] or (at == self.high[0] and self.high[1]))

    def takes_day(self, day: str) -> bool:
        """Whether a folder may hold a row that takes() accepts."""
        if day == UNKNOWN:
            return not self.dated
        try:
            first = datetime.strptime(day, "%Y-%m-%d").replace(tzinfo=UTC)
        except ValueError:
            return True
        last = first + timedelta(days=1)
        bounds = [x for x in (self.since, self.low and self.low[0]) if x]
        return all(last > x for x in bounds) and (self.high is None or first <= self.high[0])

    def partitions(self) -> Sequence[InputPartition]:
        system, root = fs.FileSystem.from_uri(self.path)
        out, held, size = [], [], 0
        found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        for info in sorted(found, key=lambda i: i.path):
            parts = dict(p.split("=", 1) for p in info.path[len(root) :].split("/") if "=" in p)
            if info.type != fs.FileType.File or info.base_name.startswith(("_", ".")) or "board" not in parts:
                continue
            if (self.boards is not None and parts["board"] not in self.boards) or not self.takes_day(parts.get("day", UNKNOWN)):
                continue
            if held and size + info.size > PARTITION_BYTES:
                out.append(Files(held))
                held, size = [], 0
            held.append((info.path, parts["board"]))
            size += info.size
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        rows: list[tuple] = []
        for path, board in partition.files:
            with system.open_input_stream(path) as raw, pa.PythonFile(raw, mode="r") as stream:
                for line in lines(stream):
                    rows += self.row(board, line)
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    def row(self, board: str, line: str) -> list[tuple]:
        if not line.strip():
            return []
        try:
            item = json.loads(line)
            body, at = item.get("body"), instant(item.get("at"))
        except (ValueError, AttributeError):
            return [(board, None, None, None, line)] if self.takes(None) else []
        text = body if body is None or isinstance(body, str) else json.dumps(body)
        return [(board, None if item.get("id") is None else str(item["id"]), at, text, None)] if self.takes(at) else []


def lines(stream) -> Iterator[str]:
    rest = b""
    while chunk := stream.read(1 << 20):
        *whole, rest = (rest + chunk).split(b"\n")
        yield from (x.decode("utf-8", "replace") for x in whole)
    if rest:
        yield rest.decode("utf-8", "replace")


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class LandedResponses(DataSource):
    """Options: path, and look_back (seconds) with now (seconds of the epoch)."""

    @classmethod
    def name(cls) -> str:
        return "landed_responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        since = None
        if "look_back" in self.options:
            since = datetime.fromtimestamp(int(self.options["now"]) - int(self.options["look_back"]), UTC)
        return LandedReader(self.options["path"], since)


def landed(spark: SparkSession, path: str, now: int | None = None, look_back: int | None = None) -> DataFrame:
    """board, id, published_at, body, unreadable of landed responses; filters of board and published_at reach the listing."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedResponses)
    reader = spark.read.format("landed_responses").option("path", path)
    return (reader.option("now", now).option("look_back", look_back) if look_back is not None else reader).load()


def land(responses: DataFrame, path: str) -> None:
    """board, id, at (text), body: written as ingestion lands them."""
    day = F.coalesce(F.date_format(F.try_to_timestamp("at"), "yyyy-MM-dd"), F.lit(UNKNOWN))
    line = F.to_json(F.struct("id", "at", "body"))
    responses.select(F.col("board"), day.alias("day"), line.alias("value")).write.mode("append").partitionBy("board", "day").text(path)
