"""Scan of landed CV files: name, type, size, version, text and why a file is refused. Text files are read; PDF and DOCX have to be decoded where they land."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES, LEAST_CHARS = 8 * 1024 * 1024, 100
# Types by ending.
TYPES = {"pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "txt": "text/plain"}


def clean_cv(text: Column) -> Column:
    """Null characters are spaces, carriage returns line ends; blanks collapse, and at most two line ends stand together."""
    for regex, by in (("\u0000", " "), ("\r", "\n"), (r"[ \t]+", " "), (r"\n{3,}", "\n\n")):
        text = F.regexp_replace(text, regex, by)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def scan(spark: SparkSession, path: str) -> DataFrame:
    """file_name, file_type, file_size, source_version, cv_text, chars, fault of every file under ``path``. The bytes of a file that is too large are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = ("path", "length")
    small = files.where(F.col("length") <= MOST_BYTES).select(*columns, "content")
    large = files.where(F.col("length") > MOST_BYTES).select(*columns, F.lit(None).cast("binary").alias("content"))
    rows = small.unionByName(large).withColumn("file_name", F.try_url_decode(F.regexp_extract("path", "([^/]+)$", 1)))
    ending = F.lower(F.regexp_extract("file_name", r"\.([^.]+)$", 1))
    types = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    text = F.when(ending == "txt", clean_cv(F.decode("content", "UTF-8")))
    fault = (F.when(F.col("length") > MOST_BYTES, "CV is larger than 8 MB.").when(~ending.isin(*TYPES), "Please upload PDF or DOCX. Legacy .doc files are not supported.")
             .when(ending != "txt", "not decoded").when(F.length("cv_text") < LEAST_CHARS, "We could not extract enough text from this CV. Try a text-based PDF or DOCX."))
    version = F.when(F.col("content").isNotNull(), F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    out = rows.withColumn("cv_text", text).select("file_name", F.coalesce(F.try_element_at(types, ending), F.lit("")).alias("file_type"), F.col("length").alias("file_size"), version.alias("source_version"), "cv_text", F.length("cv_text").alias("chars"), fault.alias("fault"))
    return out
