"""A keyed table as a log of changes: upserts and tombstones in hash buckets, merged by tiers of size, read by the newest of a key.

A row is (owner, item, value, deleted, at); an owner's rows are in one bucket. A tombstone without an item deletes
all of the owner's items that are older. A commit writes one segment, in the buckets in which it has rows, and a manifest
of the live segments of each bucket; nothing else is touched. A bucket with ``TIER`` segments of one tier of size (powers of
``TIER``) gets them merged into one, so that a row is written again some log(rows) times, and a bucket has
about TIER segments for each tier. What a commit replaced stays until ``vacuum``, for readers of an older manifest.

A version that is committed again replaces itself, so that a repeated micro-batch changes nothing. There is one writer
at a time. Manifests have a row for each live segment of a bucket, whatever the table's size, and come to the driver.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TIER, BUCKETS = 4, 16
_MANIFEST = "version long, segment string, bucket int, rows long, tombstones boolean"


def tier(rows: int) -> int:
    """0 for up to TIER rows, then a number more for each power of it."""
    out = 0
    while rows > TIER:
        rows, out = -(-rows // TIER), out + 1
    return out


@dataclass(frozen=True)
class Segment:
    name: str
    bucket: int
    rows: int
    tombstones: bool


class ChangeLog:
    def __init__(self, spark: SparkSession, folder: str, value: str, buckets: int = BUCKETS) -> None:
        """``value`` is the type of the value column."""
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.schema = f"owner string, item string, value {value}, deleted boolean, at long, version long"

    def bucket(self, owner: Column) -> Column:
        return F.pmod(F.xxhash64(owner), F.lit(self.buckets)).cast("int")

    def live(self, before: int | None = None) -> tuple[int, list[Segment]]:
        """The newest version (before ``before``) and its segments; -1 and none where nothing is committed."""
        try:
            rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifests/*")
        except AnalysisException:  # no such folder
            return -1, []
        rows = rows if before is None else rows.where(F.col("version") < before)
        newest = rows.agg(F.max("version").alias("v")).first()["v"]
        if newest is None:
            return -1, []
        held = rows.where((F.col("version") == newest) & F.col("bucket").isNotNull()).collect()
        return newest, [Segment(r["segment"], r["bucket"], r["rows"], r["tombstones"]) for r in held]

    def rows(self, segments: list[Segment]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/segments/{s.name}/bucket={s.bucket}" for s in segments))

    def newest(self, rows: DataFrame) -> DataFrame:
        """The newest row of each (owner, item): one partial aggregate a task before the shuffle."""
        order = F.struct("version", "at")
        last = F.max_by(F.struct("value", "deleted", "at", "version"), order).alias("r")
        return rows.groupBy("owner", "item").agg(last).select("owner", "item", "r.*")

    def shadowed(self, rows: DataFrame) -> DataFrame:
        """Newest rows with cleared: whether a newer tombstone of the owner deletes them."""
        clears = rows.where("item IS NULL AND deleted").select("owner", F.struct("version", "at").alias("_since"))
        rows = rows.join(clears, "owner", "left")
        older = F.struct("version", "at") < F.col("_since")
        return rows.withColumn("cleared", F.coalesce(F.col("item").isNotNull() & older, F.lit(False))).drop("_since")

    def current(self, owners: DataFrame | None = None) -> DataFrame:
        """owner, item, value as of the last commit; with ``owners`` (a column owner), theirs only, from their buckets only."""
        segments = self.live()[1]
        if owners is not None:
            asked = {r["b"] for r in owners.select(self.bucket(F.col("owner")).alias("b")).distinct().collect()}  # one row a bucket
            rows = self.rows([s for s in segments if s.bucket in asked]).join(owners.select("owner").distinct(), "owner", "left_semi")
        else:
            rows = self.rows(segments)
        return self.shadowed(self.newest(rows)).where("NOT deleted AND NOT cleared").select("owner", "item", "value")

    def commit(self, changes: DataFrame, version: int) -> None:
        """changes: owner, item, value, deleted, at. Of several of one key in a commit the one with the greatest ``at`` counts."""
        rows = changes.withColumn("version", F.lit(version).cast("long"))
        kept = [s for s in self.live(version)[1]]
        self._publish(version, kept, self._written(f"c{version:012d}", self.newest(rows)))

    def merge(self, version: int) -> int:
        """Merge the tiers that are full, as ``version``; how many bucket segments went."""
        kept, full = self.live(version)[1], []
        held = defaultdict(list)
        for s in kept:
            held[s.bucket, tier(s.rows)].append(s)
        full = [s for group in held.values() if len(group) >= TIER for s in group]
        if not full:
            return 0
        left = [s for s in kept if s not in full]
        rest = {s.bucket for s in left}
        # a tombstone may go where no other segment of its bucket is left that it could delete from
        rows = self.shadowed(self.newest(self.rows(full))).where("NOT cleared").drop("cleared")
        rows = rows.where(~F.col("deleted") | self.bucket(F.col("owner")).isin(*rest)) if rest else rows.where("NOT deleted")
        self._publish(version, left, self._written(f"m{version:012d}", rows))
        return len(full)

    def vacuum(self) -> list[str]:
        """The segments that the newest manifest no longer names: whoever keeps the folder may delete them."""
        live = {(s.name, s.bucket) for s in self.live()[1]}
        try:
            every = self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifests/*").where("bucket IS NOT NULL").select("segment", "bucket").distinct().collect()
        except AnalysisException:
            return []
        return sorted(f"{self.folder}/segments/{r['segment']}/bucket={r['bucket']}" for r in every if (r["segment"], r["bucket"]) not in live)

    def _written(self, name: str, rows: DataFrame) -> list[Segment]:
        path = f"{self.folder}/segments/{name}"
        rows.withColumn("bucket", self.bucket(F.col("owner"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        told = self.spark.read.schema(self.schema + ", bucket int").parquet(path)
        counts = told.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.max("deleted").alias("t")).collect()
        return [Segment(name, r["bucket"], r["n"], r["t"]) for r in counts]

    def _publish(self, version: int, *lists: list[Segment]) -> None:
        """The manifest is the commit: a segment without one does not count. A version without segments has one row that says so."""
        rows = [(version, s.name, s.bucket, s.rows, s.tombstones) for part in lists for s in part] or [(version, None, None, 0, False)]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifests/{version:012d}")
