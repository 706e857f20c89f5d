"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source's target is its weight's share of all words, held at three times the source's
size; what is held back is shared again by weight. Documents are dealt to shards by a hash.
Within a shard, blocks of equal length go to the sources by highest quotients
target / (2 * seats + 1), so that each source has an integer quota per shard. A source's
documents of a shard lie on a line in seeded order; the quota runs along that line, as many
whole rounds as it holds and then the first blocks of one more round.

Defined results: a null or blank text has size 0 and takes nothing; a null source is a source
of its own, ordered last; a null doc_id is an id like any other; repeated rows lie side by
side on the line; an empty table gives no rows; columns besides doc_id, text and source are
left alone. The work is sums and windows over (source, shard), and no shard is larger than
``shard_words`` on average, so a source with a third of all rows spreads over all shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import numbered, table, written

SEED = 17
SHARD_WORDS = 250_000
BLOCK_WORDS = 16
MOST_ROUNDS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, size) to one row per source: source, source_size, weight, total, target.

    Sorted by what a source can give per unit of weight, the sources below the water level
    are held at three times their size, and the level follows from prefix sums. One row per
    source goes through the window, not one per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(named) - 1) % 3 + 1).cast("long"))
    all_rows = Window.partitionBy()
    filled = Window.orderBy(F.col("room"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("room", MOST_ROUNDS * F.col("source_size") / F.col("weight")).withColumns({
        "total": F.sum("source_size").over(all_rows),
        "all_weight": F.sum("weight").over(all_rows),
        "full": F.coalesce(F.sum(MOST_ROUNDS * F.col("source_size")).over(filled), F.lit(0)),
        "full_weight": F.coalesce(F.sum("weight").over(filled), F.lit(0)),
    })
    per = per.withColumn("level", (F.col("total") - F.col("full")) / (F.col("all_weight") - F.col("full_weight")))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(all_rows))
    held = (MOST_ROUNDS * F.col("source_size")).cast("double")
    target = F.coalesce(F.least(held, F.col("level") * F.col("weight")), held)
    return per.select("source", "source_size", "weight", "total", target.alias("target"))


def quotas(cells: DataFrame, block_words: int) -> DataFrame:
    """(source, shard, cell_size, cell_target) to the same rows with n_blocks and quota.

    Starts from the divisor that would seat everyone by rounding and gives or takes the few
    seats that rounding is off by, at the highest or lowest quotients. A source can be off by
    no more than its share of (seats missing + sources), plus two, so the seats that compete
    are about as many as the shard has sources.
    """
    shard = Window.partitionBy("shard")
    cells = cells.withColumns({
        "n_blocks": F.ceil(F.col("cell_size") / block_words).cast("long"),
        "shard_target": F.sum("cell_target").over(shard),
        "n_sources": F.count(F.lit(1)).over(shard),
    })
    cells = cells.withColumn("seats", F.floor(F.col("shard_target") / block_words + 0.5).cast("long"))
    share = F.coalesce(F.try_divide(F.col("cell_target"), F.col("shard_target")), F.lit(0.0))
    cells = cells.withColumn("share", share).withColumn("start", F.floor(F.col("share") * F.col("seats") + 0.5).cast("long"))
    cells = cells.withColumn("missing", F.col("seats") - F.sum("start").over(shard))
    reach = (F.floor(F.col("share") * (F.abs(F.col("missing")) + F.col("n_sources"))) + 2).cast("long")
    cells = cells.withColumn("reach", reach)
    up, down = F.col("missing") > 0, F.col("missing") < 0
    low = F.when(up, F.col("start")).otherwise(F.greatest(F.lit(0), F.col("start") - F.col("reach")))
    high = F.when(up, F.col("start") + F.col("reach") - 1).otherwise(F.col("start") - 1)
    competing = (up | down) & (F.col("cell_target") > 0) & (high >= low)
    seat = cells.where(competing).withColumn("seat", F.explode(F.sequence(low, high)))
    quotient = F.col("cell_target") / (2 * F.col("seat") + 1)
    best = Window.partitionBy("shard").orderBy(F.when(up, -quotient).otherwise(quotient), F.col("source").asc_nulls_last(), "seat")
    moved = seat.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= F.abs(F.col("missing")))
    moved = moved.groupBy("source", "shard").agg(F.sum(F.signum("missing")).cast("long").alias("moved"))
    moved = moved.select(F.col("source").alias("m_source"), F.col("shard").alias("m_shard"), "moved")
    cells = cells.join(moved, (F.col("shard") == F.col("m_shard")) & F.col("source").eqNullSafe(F.col("m_source")), "left")
    quota = F.least(MOST_ROUNDS * F.col("n_blocks"), F.col("start") + F.coalesce("moved", F.lit(0)))
    return cells.select("source", "shard", "n_blocks", quota.alias("quota"))


def mix_sources(docs: DataFrame, seed: int = SEED, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS, kept: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, rounds, part: one row per row of ``docs``.

    A document is taken ``rounds`` times whole and then for its first ``part`` words. kept: further
    columns to return, by which rows of one id and size are ordered.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = written(docs.select("doc_id", "source", *kept, word_count(F.col("text")).alias("size"), key.alias("place")), "mix-sizes")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    shards, block = total // shard_words + 1, max(1, min(block_words, total // 10_000))
    sized = sized.withColumn("shard", F.conv(F.substring("place", 1, 8), 16, 10).cast("long") % shards)
    targets = source_targets(sized).select(F.col("source").alias("t_source"), "source_size", "target")
    cells = sized.groupBy("source", "shard").agg(F.sum("size").alias("cell_size"))
    cells = cells.join(targets, F.col("source").eqNullSafe(F.col("t_source")))
    cell_target = F.coalesce(F.col("target") * F.try_divide(F.col("cell_size"), F.col("source_size")), F.lit(0.0))
    cells = cells.withColumn("cell_target", cell_target)
    given = quotas(cells.select("source", "shard", "cell_size", "cell_target"), block)
    given = given.select(F.col("source").alias("q_source"), F.col("shard").alias("q_shard"), "n_blocks", "quota")
    cells = cells.join(given, (F.col("shard") == F.col("q_shard")) & F.col("source").eqNullSafe(F.col("q_source")))
    cells = cells.select(F.col("source").alias("c_source"), F.col("shard").alias("c_shard"), "source_size", "target", "n_blocks", "quota")
    line = Window.partitionBy("source", "shard").orderBy("place", "doc_id", "size", *kept).rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
    out = sized.join(cells, (F.col("shard") == F.col("c_shard")) & F.col("source").eqNullSafe(F.col("c_source")))
    rounds = F.coalesce(F.floor(F.try_divide(F.col("quota"), F.col("n_blocks"))), F.lit(0)).cast("long")
    last = (F.col("quota") - rounds * F.col("n_blocks")) * block
    part = F.greatest(F.lit(0), F.least(F.col("before") + F.col("size"), last) - F.col("before")).cast("long")
    out = out.withColumns({"rounds": rounds, "part": part})
    taken = (F.col("rounds") * F.col("size") + F.col("part")).alias("taken")
    return out.select("doc_id", "source", "size", "source_size", "target", taken, "rounds", "part", *kept)


def take_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes, as often as it takes them, in the columns of ``docs``.

    The document at the end of a quota is cut after its last word taken; its n_chars, where
    there is such a column, follows. Each row has its own numbers, also where ids are null or repeated.
    """
    rows = numbered(docs, "mix-rows")
    sized = rows.select("row", F.xxhash64("doc.text").alias("twin"), "doc.doc_id", "doc.source", "doc.text")
    plan = mix_sources(sized, **options, kept=("twin", "row")).where(F.col("taken") > 0).select("row", "rounds", "part")
    parts = F.concat(
        F.array_repeat(F.lit(-1).cast("long"), F.col("rounds").cast("int")),
        F.when(F.col("part") > 0, F.array("part")).otherwise(F.array().cast("array<bigint>")),
    )
    out = rows.join(plan, "row").withColumn("cut", F.explode(parts))
    # a split into so many pieces leaves what follows the last word taken in the last piece
    text, space = F.col("doc.text"), r"[\x20\x09-\x0D]+"
    pieces = F.col("cut") + 1 + text.rlike(f"^{space}").cast("long")
    split = F.split(text, space, pieces.cast("int"))
    rest = F.when(F.size(split) == pieces, F.element_at(split, -1)).otherwise(F.lit(""))
    short = F.regexp_replace(F.left(text, F.length(text) - F.length(rest)), f"{space}$", "")
    out = out.withColumn("text", F.when(F.col("cut") < 0, text).otherwise(short))
    fresh = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        fresh["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*(fresh.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS place
  FROM documents),
whole AS (SELECT coalesce(sum(size), 0)::BIGINT AS n FROM sized),
setup AS (SELECT n // {SHARD_WORDS} + 1 AS shards, greatest(1, least({BLOCK_WORDS}, n // 10000)) AS block FROM whole),
dealt AS (SELECT s.*, CAST('0x' || substr(place, 1, 8) AS BIGINT) % shards AS shard FROM sized s, setup),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight FROM per),
roomy AS (SELECT *, {MOST_ROUNDS} * source_size / weight AS room FROM weighed),
filled AS (
  SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight,
         coalesce(sum({MOST_ROUNDS} * source_size) OVER w, 0) AS full_size, coalesce(sum(weight) OVER w, 0) AS full_weight
  FROM roomy WINDOW w AS (ORDER BY room, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
levels AS (SELECT *, (total - full_size)::DOUBLE / (all_weight - full_weight)::DOUBLE AS lv FROM filled),
targets AS (
  SELECT source, source_size,
         least(({MOST_ROUNDS} * source_size)::DOUBLE, max(CASE WHEN lv <= room THEN lv END) OVER () * weight) AS target
  FROM levels),
cells AS (
  SELECT d.source, d.shard, sum(size)::BIGINT AS cell_size, any_value(t.source_size) AS source_size, any_value(t.target) AS target
  FROM dealt d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source GROUP BY d.source, d.shard),
aimed AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE target * (cell_size::DOUBLE / source_size) END AS cell_target,
         ceil(cell_size::DOUBLE / block)::BIGINT AS n_blocks, block FROM cells, setup),
summed AS (
  SELECT *, sum(cell_target) OVER (PARTITION BY shard) AS shard_target, count(*) OVER (PARTITION BY shard) AS n_sources FROM aimed),
seated AS (
  SELECT *, floor(shard_target / block + 0.5)::BIGINT AS seats,
         CASE WHEN shard_target = 0 THEN 0 ELSE cell_target / shard_target END AS share FROM summed),
started AS (SELECT *, floor(share * seats + 0.5)::BIGINT AS begun FROM seated),
lacking AS (SELECT *, seats - sum(begun) OVER (PARTITION BY shard) AS missing FROM started),
reaching AS (SELECT *, (floor(share * (abs(missing) + n_sources)) + 2)::BIGINT AS reach FROM lacking),
seat AS (
  SELECT *, unnest(range(CASE WHEN missing > 0 THEN begun ELSE greatest(0, begun - reach) END,
                         CASE WHEN missing > 0 THEN begun + reach ELSE begun END)) AS k
  FROM reaching WHERE missing <> 0 AND cell_target > 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY CASE WHEN missing > 0 THEN -1 ELSE 1 END * cell_target / (2 * k + 1),
                               source ASC NULLS LAST, k) AS rank FROM seat),
moved AS (SELECT source, shard, sum(sign(missing))::BIGINT AS moved FROM ranked WHERE rank <= abs(missing) GROUP BY source, shard),
given AS (
  SELECT r.source, r.shard, r.n_blocks, r.source_size, r.target, r.block,
         least({MOST_ROUNDS} * n_blocks, begun + coalesce(moved, 0))::BIGINT AS quota
  FROM reaching r LEFT JOIN moved m ON r.shard = m.shard AND r.source IS NOT DISTINCT FROM m.source),
lined AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source, shard ORDER BY place, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM dealt)
SELECT l.doc_id, l.size, g.source_size::BIGINT AS source_size, g.target,
       CASE WHEN n_blocks = 0 THEN 0 ELSE
         (quota // n_blocks) * l.size + greatest(0, least(before + l.size, (quota % n_blocks) * block) - before) END::BIGINT AS taken
FROM lined l JOIN given g ON l.shard = g.shard AND l.source IS NOT DISTINCT FROM g.source
"""
