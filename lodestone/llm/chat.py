"""Chat formatting: multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant, the others as named users, and the system turns as they are; the mask says which
characters are trained on (the assistant's own). One row per conversation, perspective and
turn carries the rendered piece, its place in the whole text and its mask; a conversation of
any length is never gathered into one value. Places are running sums in two levels, over
runs of ``RUN`` turns and over the runs of a perspective, so that no window spans a long
conversation's turns.

A marker opens with "<|". Where a text or a speaker's name holds these two characters, a space is put
between them, so that no turn can end itself, open another, or move what is trained on.

Defined results: a null or empty text is rendered as an empty turn; a null role speaks as
"unknown" and is a participant; a null turn comes first; equal turns are ordered by role and
text, repeated rows lie side by side; a conversation of system turns alone has no
participants and no rows; a null conv_id is a conversation like any other; an empty table
gives no rows; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table

RUN = 256


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def rotate(turns: DataFrame, run: int = RUN) -> DataFrame:
    """conv_id, speaker, turn, role, name, content, start, end, and train_start, train_end: the characters trained on, null outside the assistant's turns."""
    turns = turns.select(
        F.col("conv_id"), F.col("turn"), unmarked(F.coalesce("role", F.lit("unknown"))).alias("said_by"),
        unmarked(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce(F.floor(F.col("turn") / run), F.lit(-1)).cast("long").alias("run"),
    )
    speakers = turns.where(F.col("said_by") != "system").select(F.col("conv_id").alias("of"), F.col("said_by").alias("speaker")).distinct()
    seen = turns.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    role = F.when(F.col("said_by") == F.col("speaker"), "assistant").when(F.col("said_by") == "system", "system").otherwise("user")
    seen = seen.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("said_by")))
    head = F.concat(F.lit("<|"), F.col("role"), F.coalesce(F.concat(F.lit(" name="), "name"), F.lit("")), F.lit("|>\n"))
    seen = seen.withColumn("head", head).withColumn("content", F.concat("head", "text", F.lit("<|end|>\n")))
    seen = seen.withColumn("n", F.length("content").cast("long"))
    one = ["conv_id", "speaker"]
    order = [F.col("turn").asc_nulls_first(), F.col("said_by"), F.col("text")]
    inner = Window.partitionBy(*one, "run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    runs = seen.groupBy(*one, "run").agg(F.sum("n").alias("run_n"))
    outer = Window.partitionBy(*one).orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("run_start", F.coalesce(F.sum("run_n").over(outer), F.lit(0)))
    runs = runs.select(F.col("conv_id").alias("r_conv"), F.col("speaker").alias("r_speaker"), F.col("run").alias("r_run"), "run_start")
    seen = seen.withColumn("inner", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    out = seen.join(runs, F.col("conv_id").eqNullSafe(F.col("r_conv")) & (F.col("speaker") == F.col("r_speaker")) & (F.col("run") == F.col("r_run")))
    start = F.col("run_start") + F.col("inner")
    trained = F.col("role") == "assistant"
    return out.select(
        "conv_id", "speaker", "turn", "role", "name", "content", start.alias("start"), (start + F.col("n")).alias("end"),
        F.when(trained, start + F.length("head")).alias("train_start"), F.when(trained, start + F.col("n")).alias("train_end"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH turns AS (SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS said_by, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, said_by AS speaker FROM turns WHERE said_by <> 'system'),
seen AS (
  SELECT t.*, speaker, CASE WHEN said_by = speaker THEN 'assistant' WHEN said_by = 'system' THEN 'system' ELSE 'user' END AS role
  FROM turns t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
headed AS (
  SELECT *, CASE WHEN role = 'user' THEN said_by END AS name,
         '<|' || role || CASE WHEN role = 'user' THEN ' name=' || said_by ELSE '' END || '|>' || chr(10) AS head FROM seen),
rendered AS (SELECT *, head || text || '<|end|>' || chr(10) AS content FROM headed),
placed AS (
  SELECT *, coalesce(sum(length(content)) OVER (
    PARTITION BY conv_id, speaker ORDER BY turn ASC NULLS FIRST, said_by, text
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM rendered)
SELECT conv_id, speaker, turn, role, name, content, start, start + length(content) AS "end",
       CASE WHEN role = 'assistant' THEN start + length(head) END AS train_start,
       CASE WHEN role = 'assistant' THEN start + length(content) END AS train_end
FROM placed
"""
