"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is two shuffles and a table in the shared folder; nothing but row counts and
checksums comes to the driver. A node with very many edges meets its neighbours' minimum by a
partial aggregate and a join whose large partitions adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import written


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("u", "v") % (1 << 40))).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long, no nulls). node, root: each node's smallest reachable node; nodes without a smaller one are left out."""
    greater, less = F.greatest("a", "b"), F.least("a", "b")
    now = written(edges.where("a <> b").select(greater.alias("u"), less.alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        before, state = state, _state(now)
        if before == state:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
