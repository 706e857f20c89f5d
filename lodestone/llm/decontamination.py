"""Benchmark decontamination by template canonicalisation.

Names, numbers and units become typed placeholders, in documents and benchmark alike. Every
window of ``WINDOW`` template tokens is hashed and joined with the windows of the benchmark,
so a question that was asked again with other names and numbers still meets its template.
Windows without slots, and those whose values are all equal, match as they stand. For the rest
slots decide: in a run of windows that follow each other along one alignment of document and item,
the document's value must be a function of the item's value (two values may become one), else
those windows are a coincidence of form.

Rules: a number is a run of digits (decimal and thousands marks inside it belong to it), a
unit a known unit right after a number, a name a capitalised word that does not open a
sentence; other words are compared in lower case without punctuation. Windows with fewer
literal words than half are joined with their values, so only exact copies of them meet. An item
shorter than a window is one window of its own length. DataFrame functions only. The benchmark side is broadcast after a count has shown
it to be at most ``MOST_BROADCAST`` windows; a larger one is joined by shuffle, where adaptive
execution splits the windows of a hot passage.

Defined results: a null or blank text has no windows; benchmark items that repeat each other
are all reported; rows with one doc_id (or item_id) and different texts are aligned each by itself
and reported as one, by the best of them; a null doc_id or item_id is an id like any other; either table may be empty (no rows); other columns are left
alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import table, written

WINDOW = 10
MOST_BROADCAST = 1_000_000
#: Marks in front of a token's value: what kind of slot it fills.
NAME, NUMBER, UNIT = "\x01", "\x02", "\x03"
UNITS = ("km", "cm", "mm", "m", "kg", "g", "mg", "lb", "lbs", "oz", "l", "ml", "km/h", "mph", "hours", "hour", "minutes", "minute",
         "seconds", "second", "days", "day", "weeks", "week", "months", "month", "years", "year", "dollars", "dollar", "euros", "euro",
         "cents", "percent", "degrees", "miles", "mile", "meters", "meter", "feet", "foot", "inches", "inch")


def marked_tokens(text: Column) -> Column:
    """The tokens of a text, slots with their mark and value, all in lower case."""
    text = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "   ")
    named = F.regexp_replace(text, r"(?U)\p{Lu}(?<=[\p{Ll},;:]\s\p{Lu})\p{Ll}+", NAME + "$0")
    digits = F.regexp_replace(named, r"(?<=\d)[.,](?=\d)", "")
    digits = F.regexp_replace(digits, r"(?<![\p{L}\p{N}])\d+", NUMBER + "$0")
    units = "|".join(sorted(UNITS, key=lambda u: (-len(u), u)))
    digits = F.regexp_replace(digits, rf"(?i)(\x02\d+)\s?({units})(?![\p{{L}}\p{{N}}])", f"$1 {UNIT}$2")
    # the three passes over numbers are spared where there is no digit
    done = F.lower(F.when(named.rlike("[0-9]"), digits).otherwise(named))
    return F.filter(F.split(done, r"[^\p{L}\p{N}\x01-\x03]+"), lambda t: t != "")


def is_slot(token: Column) -> Column:
    return token < F.lit("\x04")


def text_key(text: Column) -> Column:
    """Tells apart the texts of rows that share an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def windows(tokens: DataFrame, ids: list[str], sizes: list[int]) -> DataFrame:
    """ids, at, size, h, slots: the windows of ``marked``. h is of the template, in windows with more slots than words of the values too."""
    slotted = F.exists("marked", is_slot)
    tokens = tokens.withColumn("slotted", slotted)
    # the mark alone stands for a slot
    template = F.when(F.col("slotted"), F.transform("marked", lambda t: F.when(is_slot(t), F.substring(t, 1, 1)).otherwise(t)))
    tokens = tokens.withColumn("template", F.coalesce(template, F.col("marked")))
    n = F.size("template")

    def of_size(size: int) -> Column:
        def part(name: str, i: Column) -> Column:
            return F.slice(name, i + 1, F.lit(size))

        def made(i: Column, h: Column, slots: Column) -> Column:
            return F.struct(i.alias("at"), F.lit(size).alias("size"), h.alias("h"), slots.alias("slots"))

        def plain(i: Column) -> Column:
            return made(i, F.xxhash64(part("template", i)), F.lit(None).cast("array<string>"))

        def with_slots(i: Column) -> Column:
            def of(slots: Column) -> Column:
                return made(i, F.when(2 * F.size(slots) > size, F.xxhash64(part("marked", i))).otherwise(F.xxhash64(part("template", i))), slots)

            # an array of one, so that the slots are sought once
            return F.transform(F.array(F.filter(part("marked", i), is_slot)), of)[0]

        none = F.array().cast("array<struct<at:int,size:int,h:bigint,slots:array<string>>>")
        places = F.sequence(F.lit(0), n - size)
        return F.when(n < size, none).when(F.col("slotted"), F.transform(places, with_slots)).otherwise(F.transform(places, plain))

    each = [of_size(size) for size in sizes]
    return tokens.select(*ids, F.explode(F.concat(*each) if len(each) > 1 else each[0]).alias("w")).select(*ids, "w.*")


def benchmark_windows(benchmark: DataFrame, window: int) -> tuple[DataFrame, list[int]]:
    """The windows of the items, and the window sizes in use: ``window`` and the lengths of shorter items."""
    items = written(benchmark.select("item_id", text_key(F.col("text")).alias("item_key"), marked_tokens(F.col("text")).alias("marked")), "benchmark-tokens")
    items = items.where(F.size("marked") > 0)
    short = items.where(F.size("marked") < window).select(F.size("marked").alias("n")).distinct()
    sizes = sorted({window, *(r["n"] for r in short.collect())})  # fewer than ``window`` of them
    parts = [windows(items.where(F.size("marked") >= window if s == window else F.size("marked") == s), ["item_id", "item_key"], [s]) for s in sizes]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("item_id", "item_key", F.col("at").alias("item_at"), "size", "h", F.col("slots").alias("item_slots")), sizes


def alignments(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, doc_key, item_id, item_key, shift, n_windows, n_slots, n_changed: the alignments that match in a window at least."""
    asked, sizes = benchmark_windows(benchmark, window)
    asked = written(asked, "benchmark-windows")
    if asked.count() <= MOST_BROADCAST:
        asked = F.broadcast(asked)
    text = F.col("text")
    seen = windows(docs.select("doc_id", text_key(text).alias("doc_key"), marked_tokens(text).alias("marked")), ["doc_id", "doc_key"], sizes)
    met = seen.join(asked, ["h", "size"]).select(
        "doc_id", "doc_key", "item_id", "item_key", (F.col("at") - F.col("item_at")).alias("shift"), "item_at",
        F.coalesce(F.arrays_zip(F.col("slots").alias("d"), F.col("item_slots").alias("i")), F.array().cast("array<struct<d:string,i:string>>")).alias("slots"))
    by = ["doc_id", "doc_key", "item_id", "item_key", "shift"]
    # copies of a text say nothing new: an alignment has as many rows as the item has windows
    met = met.dropDuplicates([*by, "item_at"]).withColumn("exact", F.forall("slots", lambda s: s["d"] == s["i"]))
    along = Window.partitionBy(*by).orderBy("item_at")
    met = met.withColumn("run", F.col("item_at") - F.row_number().over(along))
    united = lambda values: F.array_distinct(F.flatten(F.collect_set(values)))
    runs = met.groupBy(*by, "run").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("n_exact"), united("slots").alias("slots"), united(F.when(F.col("exact"), F.col("slots"))).alias("same"))
    renamed = F.size(F.array_distinct(F.transform("slots", lambda s: s["i"]))) == F.size("slots")
    runs = runs.select(*by, F.when(renamed, F.col("n")).otherwise(F.col("n_exact")).alias("n"), F.when(renamed, F.col("slots")).otherwise(F.col("same")).alias("slots"))
    aligned = runs.where("n > 0").groupBy(*by).agg(F.sum("n").alias("n_windows"), united("slots").alias("slots"))
    changed = F.filter("slots", lambda s: s["d"] != s["i"])
    return aligned.select(*by, "n_windows", F.size("slots").cast("long").alias("n_slots"), F.size(changed).cast("long").alias("n_changed"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, item_id, n_windows, n_slots, n_changed: one row per document and item whose windows meet.

    n_windows: most of the item's windows that one alignment matches; n_slots, n_changed: its
    pairs of slot values, and those in which the document's value differs.
    """
    best = F.max(F.struct("n_windows", "n_slots", "n_changed"))
    return alignments(docs, benchmark, window).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` whose text meets no benchmark item; other rows of the same id stay."""
    hit = alignments(docs, benchmark, window).select(F.col("doc_id").alias("hit_id"), F.col("doc_key").alias("hit_key")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["hit_id"]) & (text_key(docs["text"]) == hit["hit_key"]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
