"""CV structure: sections by heading, roles by date lines, latest and previous role."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import lines, pattern

# Headings, date ranges and bullets.
SUMMARY_HEADING = r"^(professional\s+summary|summary|professional\s+profile|profile|career\s+summary|executive\s+summary)$"
EXPERIENCE_HEADING = r"^(professional\s+experience|work\s+experience|experience|employment|career\s+history)$"
OTHER_HEADING = r"^(education(?:\s+and\s+professional\s+development)?|professional\s+development|certifications?|skills|core\s+competenc(?:e|es|ies)|key\s+skills|technical\s+skills|tools(?:\s*&\s*platforms)?|data\s*&\s*reporting\s+platforms|courses?|languages?)$"
ROLE_SUBHEADING = r"^(key\s+achievements|achievements|selected\s+achievements|responsibilities|key\s+responsibilities)$"
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|sept(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
DATE_RANGE = rf"\b(?:{MONTH}\s+)?((?:19|20)\d{{2}})\s*(?:[-–—]|to)\s*(?:(?:{MONTH}\s+)?((?:19|20)\d{{2}})|(present|current|now))\b"
BULLET = r"^[•▪◦*\-–—]\s+"


def section_of(line: Column) -> Column:
    low = F.lower(line)
    return F.when(low.rlike(SUMMARY_HEADING), "summary").when(low.rlike(EXPERIENCE_HEADING), "experience").when(low.rlike(OTHER_HEADING), "other")


def cv_lines(cvs: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, line, section: the section is that of the last heading before a line; headings themselves are left out."""
    rows = cvs.select(key, F.posexplode(lines(F.col(text))).alias("pos", "line")).withColumn("heading", section_of(F.col("line")))
    so_far = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(so_far), F.lit("header")))
    return rows.where(F.col("heading").isNull()).drop("heading")


def roles(numbered: DataFrame, key: str) -> DataFrame:
    """key, ordinal, title, company, start_year, end_year (9999: open), overview, role_id of each dated line of the experience section.

    The header stands on the dated line ("title | company | dates", "title, company | place dates"), or title and
    company on the two lines before it. A role goes on to the next one's header; its overview is the lines
    after its own header up to the first bullet or sub-heading.
    """
    order = Window.partitionBy(key).orderBy("pos")
    rows = numbered.where(F.col("section") == "experience")
    part = lambda i: F.regexp_extract(F.lower("line"), pattern(DATE_RANGE), i)
    dates = F.trim(F.regexp_extract("line", "(?i)" + pattern(DATE_RANGE), 0))
    rows = rows.withColumns({"before1": F.lag("line", 1).over(order), "before2": F.lag("line", 2).over(order), "pos1": F.lag("pos", 1).over(order), "pos2": F.lag("pos", 2).over(order),
                             "dated": F.lower("line").rlike(pattern(DATE_RANGE))})
    left = F.regexp_replace("line", r"(?i)\s*\|?\s*" + pattern(DATE_RANGE) + r"\s*$", "")
    own = F.filter(F.transform(F.split(F.when(left != F.col("line"), left).otherwise(F.lit("")), "[|]"), lambda s: F.trim(s)), lambda s: s != "")
    ahead = order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("parts", F.when(F.col("dated"), own))
    head = F.when(F.size("parts") > 0, F.col("pos")).otherwise(F.coalesce("pos2", "pos1", "pos"))
    rows = rows.withColumns({
        "header": F.when(F.col("dated"), head), "dates": F.when(F.col("dated"), dates),
        "start_year": F.when(F.col("dated"), part(1).try_cast("int")), "end_year": F.when(F.col("dated"), F.coalesce(part(2).try_cast("int"), F.lit(9999))),
        "ordinal": F.sum(F.when(F.col("dated"), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    rows = rows.withColumn("next_header", F.first("header", ignorenulls=True).over(ahead))
    comma = (F.size("parts") >= 2) & F.col("parts")[0].contains(",")
    title = F.when(comma, F.trim(F.substring_index(F.col("parts")[0], ",", 1))).when(F.size("parts") > 0, F.col("parts")[0]).otherwise(F.coalesce("before2", F.lit("")))
    company = (F.when(comma, F.trim(F.regexp_replace(F.col("parts")[0], "^[^,]*,", ""))).when(F.size("parts") > 1, F.get("parts", F.lit(1)))
               .when(F.size("parts") == 1, "").otherwise(F.coalesce("before1", F.lit(""))))
    heads = rows.where("dated").select(key, "ordinal", title.alias("title"), company.alias("company"), "dates", "start_year", "end_year")
    name = F.lower(F.concat_ws("|", F.trim("title"), F.trim("company"), F.trim("dates"), (F.col("ordinal") - 1).cast("string")))
    heads = heads.withColumn("role_id", F.concat(F.lit("role:"), F.substring(F.sha2(name, 256), 1, 12)))
    in_role = Window.partitionBy(key, "ordinal").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    body = rows.where(~F.col("dated") & (F.col("ordinal") > 0) & (F.col("pos") < F.coalesce("next_header", F.lit(2147483647))))
    body = body.withColumn("stopped", F.max(F.col("line").rlike(BULLET) | F.lower("line").rlike(ROLE_SUBHEADING)).over(in_role))
    text = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    overview = body.where(~F.col("stopped")).groupBy(key, "ordinal").agg(F.array_join(text, " ").alias("overview"))
    return heads.join(overview, [key, "ordinal"], "left").withColumn("overview", F.coalesce("overview", F.lit("")))


def latest_roles(found: DataFrame, key: str) -> DataFrame:
    """The latest (rank 1) and the previous (rank 2) role: by end, then start, then order."""
    best = Window.partitionBy(key).orderBy(F.desc("end_year"), F.desc("start_year"), "ordinal")
    return found.withColumn("rank", F.row_number().over(best)).where("rank <= 2")


def length_window(words: Column) -> Column:
    """struct(least, most): 15 % around a count of words, and 8 at least."""
    by = F.greatest(F.round(words * 0.15).cast("int"), F.lit(8))
    return F.struct(F.greatest(F.lit(0), words - by).alias("least"), (words + by).alias("most"))
