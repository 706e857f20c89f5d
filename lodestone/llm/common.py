"""Shared plumbing of the corpus operators: table reads and intermediate tables."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set only where the session names no shared folder (single-machine tests).
_FALLBACK: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; on a single machine without one, a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="lodestone-"))
    return _FALLBACK[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than the tasks after the table.
    The path is fresh for each call, so reruns never meet another run's files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    release(spark)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """row (a number of its own) and doc (the columns of ``docs``): written once, so that decisions can be joined back to rows whose ids are null or repeated."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))  # whatever its columns are called
    return written(docs.select(F.monotonically_increasing_id().alias("row"), whole.alias("doc")), label)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
