"""Source divergence audit: how the term distributions of a language's sources differ.

1. Partial counts. Inside ``mapInArrow`` a slice of texts goes through Arrow kernels: ascii_lower,
   split_pattern_regex, dictionary_encode, and hash group_by first by (document, term) and then by
   (language, source, term). A task merges its slices until ``HELD_ROWS`` rows are held, and then hands them on.
2. Merged cells. One shuffle by (language, term) sums the partial counts, and tells in how many documents
   of the language a term occurs; the terms in ``LEAST_DOCS`` of them are kept.
3. Shares. A group's share of a term, in parts of ``SCALE``, is smoothed by two occurrences a term. All of it is
   integer arithmetic; what could leave 64 bits is divided in steps of 1000, or in decimals.
4. Divergences. Kept terms are dealt to shards of about ``SHARD_TERMS`` terms, and sources to blocks of ``SOURCES``.
   A task takes a shard for two blocks of sources, lays the counts out as a matrix with a column for each term, and
   sums the triangular discrimination of each two sources; Spark adds up the shards. A source's own
   terms against its language are columns in Spark, ranked behind a limit for each task.

A shard has at most some SHARD_TERMS * 2 * SOURCES cells, whatever a source or a term holds of all
rows; only (language, source) rows are joined to all cells, by Spark's choice of join.

Defined results: a null text, language or source is an empty one; a text without terms makes its (language,
source) occur; a language without kept terms has pairs of value 0 and no terms; repeated rows are
further documents; doc_id is not read; an empty table gives no rows; other columns are left alone. The pair part
has as many rows as there are ordered pairs of a language's sources, since all its ranks are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table, written

#: What lies between terms: everything of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST_DOCS, TOP, SCALE = 10, 10, 1_000_000_000
SLICE_BYTES, HELD_ROWS = 4 << 20, 1 << 18
SHARD_TERMS, SOURCES = 2048, 128
KEYS = ["lang", "source", "term"]


def summed(rows: pa.Table) -> pa.Table:
    return rows.group_by(KEYS).aggregate([("n", "sum"), ("docs", "sum")]).rename_columns([*KEYS, "n", "docs"])


def counted(batch: pa.RecordBatch) -> pa.Table:
    """lang, source, term, n (occurrences), docs of some documents; a row with a null term for each (lang, source)."""
    lang, source = (batch.column(c).dictionary_encode() for c in ("lang", "source"))
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), pattern=BETWEEN)
    terms = pc.list_flatten(lists)
    full = pc.not_equal(terms, "")
    coded = terms.filter(full).dictionary_encode()
    rows = pc.list_parent_indices(lists).filter(full)
    inside = pa.table({"row": rows, "term": coded.indices}).group_by(["row", "term"]).aggregate([([], "count_all")])
    by_group = pa.table({
        "lang": lang.indices.take(inside["row"]), "source": source.indices.take(inside["row"]), "term": inside["term"], "n": inside["count_all"],
    }).group_by(KEYS).aggregate([("n", "sum"), ([], "count_all")])
    occur = pa.table({"lang": lang.indices, "source": source.indices}).group_by(["lang", "source"]).aggregate([([], "count_all")])
    decode = lambda t: {"lang": lang.dictionary.take(t["lang"]), "source": source.dictionary.take(t["source"])}
    return pa.concat_tables([
        pa.table(decode(by_group) | {"term": coded.dictionary.take(by_group["term"]), "n": by_group["n_sum"], "docs": by_group["count_all"]}),
        pa.table(decode(occur) | {"term": pa.nulls(len(occur), pa.string()), "n": pa.repeat(pa.scalar(0, pa.int64()), len(occur)), "docs": occur["count_all"]}),
    ])


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about SLICE_BYTES of text; a longer text is one of its own."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def partial_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: counts of each task, merged as far as its memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in slices(batch):
                held.append(counted(piece))
                n += len(held[-1])
                if n > HELD_ROWS:
                    held = [summed(pa.concat_tables(held))]
                    n = len(held[0])
                    if n > HELD_ROWS // 2:  # mostly rare terms: nothing is won by holding them longer
                        yield from held[0].combine_chunks().to_batches()
                        held, n = [], 0
        if held:
            yield from summed(pa.concat_tables(held)).combine_chunks().to_batches()

    texts = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def term_cells(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """lang, source, term, n, lang_n (the language's occurrences) of the kept terms, and a row with a null term for each (lang, source)."""
    merged = partial_counts(docs).repartition("lang", "term").groupBy(*KEYS).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    merged = merged.withColumns({"lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term)})
    return written(merged.where(F.col("term").isNull() | (F.col("lang_docs") >= least_docs)).select(*KEYS, "n", "lang_n"), "divergence-cells")


def group_sizes(cells: DataFrame) -> DataFrame:
    """lang, source, size (occurrences of kept terms), lang_size, n_terms (of the language), n_sources, place (of the source in its language)."""
    per = cells.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = cells.where("term IS NOT NULL").select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n_terms"))
    whole = per.groupBy("lang").agg(F.sum("size").alias("lang_size"), F.count(F.lit(1)).alias("n_sources"))
    per = per.join(whole, "lang").join(terms, "lang", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return written(per.withColumn("place", place), "divergence-groups")


def share(n: str, size: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (size + 2 * n_terms)), in decimals."""
    return F.expr(f"1L + (CAST({SCALE} AS DECIMAL(10, 0)) * CAST({n} + 2 AS DECIMAL(20, 0))) div CAST({size} + 2 * n_terms AS DECIMAL(20, 0))")


def shares(counts: np.ndarray, size: np.ndarray, n_terms: int) -> np.ndarray:
    """The same for a matrix of counts, a row for each source: long division in steps of 1000 stays within 64 bits."""
    whole = size[:, None] + 2 * n_terms
    out, left = np.divmod(counts + 2, whole)
    for _ in range(3):
        digit, left = np.divmod(left * 1000, whole)
        out = out * 1000 + digit
    return out + 1


def own_terms(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value, rank: the terms that a source uses more than its language, the TOP of them."""
    known = cells.where("term IS NOT NULL AND n > 0").join(groups, ["lang", "source"])
    known = known.withColumns({"p": share("n", "size"), "q": share("lang_n", "lang_size")}).where("p > q")
    known = known.select("lang", "source", F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return known.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= TOP)


def source_pairs(cells: DataFrame, groups: DataFrame, shard_terms: int = SHARD_TERMS, sources: int = SOURCES) -> DataFrame:
    """lang, source, item (another source of the language), value, rank: all of them."""
    blocks = F.ceil(F.col("n_sources") / sources)
    shards = F.greatest(F.ceil(F.col("n_terms") / shard_terms), F.lit(1))
    groups = groups.withColumns({"block": F.floor(F.col("place") / sources), "blocks": blocks, "shards": shards})
    langs = groups.select("lang", "blocks", "shards", "n_terms").distinct()
    shard = F.pmod(F.xxhash64("term"), F.col("shards"))
    # three kinds of rows: the sources (in each shard), the kept terms (for each two blocks), and the counts
    named = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), "block", "blocks", "place", "size", "n_terms", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"))
    filled = cells.where("term IS NOT NULL AND n > 0").join(groups, ["lang", "source"])
    filled = filled.select("lang", shard.alias("shard"), "block", "blocks", "place", "size", "n_terms", "term", "n")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    placed = named.unionByName(filled).withColumn("other", other)
    placed = placed.select("lang", "shard", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "place", "size", "n_terms", "term", "n")
    kept = cells.where("term IS NOT NULL").select("lang", "term").distinct().join(langs, "lang")
    kept = kept.withColumn("a", other).withColumn("b", F.explode(F.sequence(F.col("a"), F.col("blocks") - 1)))
    kept = kept.select("lang", shard.alias("shard"), "a", "b", F.lit(None).cast("int").alias("place"), F.lit(0).cast("long").alias("size"), "n_terms", "term", F.lit(0).cast("long").alias("n"))

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        heads = rows.filter(pc.is_null(rows["term"])).sort_by("place")
        # a block against itself names each source once, two blocks name each of their own
        place, size = heads["place"].to_numpy(), heads["size"].to_numpy()
        a, b, n_terms = rows["a"][0].as_py(), rows["b"][0].as_py(), rows["n_terms"][0].as_py()
        column = pc.drop_null(rows["term"].combine_chunks()).dictionary_encode()
        held = rows.filter(pc.is_valid(rows["term"]))
        counts = np.zeros((len(place), len(column.dictionary)), np.int64)
        of = held["place"].combine_chunks()
        known = of.is_valid().to_numpy(zero_copy_only=False)
        counts[np.searchsorted(place, of.drop_null().to_numpy()), column.indices.to_numpy()[known]] = held["n"].to_numpy()[known]
        p = shares(counts, size, n_terms) if n_terms else np.zeros_like(counts)
        first, second, value = [], [], []
        for i in np.flatnonzero(place // sources == a):
            more = np.flatnonzero((place // sources == b) & (place > place[i]))
            apart = p[more] - p[i]
            first.append(np.full(len(more), place[i]))
            second.append(place[more])
            value.append((apart * apart // np.maximum(p[more] + p[i], 1)).sum(1))
        out = [np.concatenate(x).astype(np.int64) for x in (first, second, value)]
        return pa.table({"lang": pa.repeat(rows["lang"][0], len(out[0])), "i": out[0], "j": out[1], "value": out[2]})

    each = placed.unionByName(kept).groupBy("lang", "shard", "a", "b").applyInArrow(run, "lang string, i long, j long, value long")
    each = each.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = each.unionByName(each.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    name = groups.select("lang", F.col("place").alias("i"), "source")
    both = both.join(name, ["lang", "i"]).join(name.select("lang", F.col("i").alias("j"), F.col("source").alias("item")), ["lang", "j"])
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return both.select("lang", "source", "item", "value", F.row_number().over(best).alias("rank"))


def divergences(docs: DataFrame) -> DataFrame:
    """lang, source, part, item, value, rank: part pair and part term of every group."""
    cells = term_cells(docs)
    groups = group_sizes(cells)
    columns = ("lang", "source", "part", "item", "value", "rank")
    pairs = source_pairs(cells, groups).withColumn("part", F.lit("pair")).select(*columns)
    return pairs.unionByName(own_terms(cells, groups).withColumn("part", F.lit("term")).select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT rid, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM words GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
counts AS (SELECT w.lang, source, w.term, count(*)::HUGEINT AS n FROM words w JOIN kept k ON w.lang = k.lang AND w.term = k.term GROUP BY ALL),
sizes AS (SELECT lang, source, sum(n)::HUGEINT AS size FROM counts GROUP BY ALL),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS lang_size FROM kept GROUP BY lang),
cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (coalesce(s.size, 0) + 2 * v) AS p, 1 + (1000000000 * (lang_n + 2)) // (lang_size + 2 * v) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang JOIN langs l ON g.lang = l.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
own AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM cells WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM own))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
