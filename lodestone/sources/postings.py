"""Relations of postings and CVs over the driver's tables, and landed pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Postings over ``documents``. The text in both engines: phrases keyed on several moduli vary
#: categories, exclusions and scores independently. Times are seconds of the epoch.
POSTINGS_SQL = """
SELECT doc_id AS pos, source, CAST(doc_id AS STRING) AS source_job_id, concat('Company ', CAST(doc_id % 97 AS STRING)) AS company,
  CASE doc_id % 9 WHEN 0 THEN 'Senior IT Project Manager' WHEN 1 THEN 'Delivery Lead' WHEN 2 THEN 'Project Coordinator'
    WHEN 3 THEN 'Research Program Manager' WHEN 4 THEN 'Implementation Manager' WHEN 5 THEN 'Store Planner'
    WHEN 6 THEN 'Lead Platform Engineer' WHEN 7 THEN 'Assistant' ELSE 'Programme Manager' END AS title,
  CASE doc_id % 7 WHEN 0 THEN 'Kongens Lyngby (Hybrid)' WHEN 1 THEN 'Copenhagen' WHEN 2 THEN 'Aarhus, Denmark' WHEN 3 THEN 'Remote'
    WHEN 4 THEN 'Ballerup' WHEN 5 THEN 'Capital Region' ELSE 'Malmo' END AS location,
  CASE WHEN doc_id % 7 = 6 THEN NULL ELSE 'Denmark' END AS country,
  CASE doc_id % 7 WHEN 0 THEN 'hybrid' WHEN 3 THEN 'remote' WHEN 5 THEN 'onsite' ELSE 'unknown' END AS remote_type,
  CASE WHEN doc_id % 7 = 3 THEN CASE doc_id % 3 WHEN 0 THEN 'DENMARK CONFIRMED' WHEN 1 THEN 'UNVERIFIED' ELSE 'DENMARK EXCLUDED' END
    ELSE 'NOT APPLICABLE' END AS remote_eligibility,
  CASE WHEN doc_id % 5 = 0 THEN 'contract' ELSE 'permanent' END AS employment_type,
  CASE WHEN doc_id % 4 = 0 THEN NULL ELSE CAST(50000 + doc_id % 37 * 1000 AS INT) END AS salary_min,
  CASE WHEN doc_id % 6 = 0 THEN NULL ELSE CAST(62000 + doc_id % 41 * 1000 AS INT) END AS salary_max,
  concat(coalesce(text, ''),
    CASE doc_id % 2 WHEN 0 THEN ' Lead end-to-end software delivery. Own scope, budget, risks and dependencies.' ELSE ' Coordination and facilitation. Status reporting for the portfolio.' END,
    CASE doc_id % 3 WHEN 0 THEN ' Governance roadmap with senior stakeholders and steering committee.' WHEN 1 THEN ' Fintech payments platform and systems integration.' ELSE '' END,
    CASE doc_id % 5 WHEN 1 THEN ' Danish is preferred but not required.' WHEN 2 THEN ' Professional Danish is mandatory for this position.'
      WHEN 3 THEN ' Building construction project on a construction site.' WHEN 4 THEN ' Milestones, release readiness, cutover and hypercare.' ELSE '' END,
    CASE doc_id % 11 WHEN 1 THEN ' Scientific research and drug discovery.' WHEN 2 THEN ' Marketing campaign work.' WHEN 3 THEN ' No meaningful ownership.'
      WHEN 4 THEN ' IT support, service operations and incident management.' WHEN 5 THEN ' Hiring and retaining, performance management.'
      WHEN 6 THEN ' Data platform, cloud, agile delivery and implementation for cross-functional engineering teams. Accountable for business outcomes.' ELSE '' END) AS description,
  doc_id % 10 <> 9 AS full_jd_verified,
  CASE WHEN doc_id % 17 = 0 THEN NULL ELSE 1785542400 - doc_id % 23 * 43200 END AS published_at,
  CASE WHEN doc_id % 8 = 0 THEN 1788220799 ELSE NULL END AS deadline,
  CASE WHEN doc_id % 13 = 0 THEN 'CLOSED' ELSE 'ACTIVE VIA THIRD PARTY' END AS vacancy_status
FROM {documents}
"""
NOW = 1785542400
CV = "End-to-end project delivery of banking platforms, data warehouse and cloud. Agile governance, risk management, budget, release and stakeholder management across regions."


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt to all cores where the scan has no more splits than cores (a file of one row group feeds one task); a larger scan is left alone."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() <= cores else rows


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return spark.sql(POSTINGS_SQL, documents=spread(docs))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landed_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed search or detail responses, one JSON document a file or line; bad documents are null rows, not errors."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", True).json(path)


def landed_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of landed RSS files: title, link, description and dates as text; "Company: Title" is split where no creator is named."""
    items = spark.read.format("xml").option("rowTag", "item").schema("title string, link string, description string, pubDate string, creator string").load(path)
    parts = F.split("title", ": ", 2)
    named = F.col("creator").isNull() & (F.size(parts) == 2)
    return items.select(
        F.when(named, parts[0]).otherwise(F.coalesce("creator", F.lit("Employer"))).alias("company"),
        F.when(named, parts[1]).otherwise(F.col("title")).alias("title"), "link", "description", "pubDate")


def job_postings(html: DataFrame, column: str) -> DataFrame:
    """The JobPosting objects of pages' JSON-LD scripts, alone, in arrays or in @graph; unreadable scripts are skipped."""
    scripts = F.regexp_extract_all(F.col(column), F.lit(r'(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>'), 1)
    each = html.withColumn("script", F.explode(scripts)).withColumn("json", F.try_parse_json("script")).where(F.col("json").isNotNull())
    listed = F.expr("""
        CASE WHEN schema_of_variant(json) LIKE 'ARRAY%' THEN try_variant_get(json, '$', 'array<variant>')
             WHEN try_variant_get(json, '$["@graph"]', 'variant') IS NOT NULL THEN try_variant_get(json, '$["@graph"]', 'array<variant>')
             ELSE array(json) END""")
    one = each.withColumn("item", F.explode(listed))
    get = lambda path: F.try_variant_get("item", path, "string")
    out = one.where(get('$["@type"]') == "JobPosting")
    return out.select(*[c for c in html.columns if c != column], get("$.title").alias("title"), get("$.hiringOrganization.name").alias("company"), get("$.datePosted").alias("date_posted"), get("$.description").alias("description"))
