"""Stored records: source CVs, decisions, proposed changes, model responses and small profile values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_basic, pattern
from lodestone.operators import evidence

LEAST_CV, LEAST_FACT, MOST_FACTS, MOST_CHANGES, MOST_TERMS, MOST_PRIORITIES, MOST_REASONS = 100, 30, 80, 5, 6, 8, 7
# Skills, employer professions and hard rejections of a job description.
SKILLS = ("Azure DevOps", "Jira", "Confluence", "MS Project", "Azure", "SQL", "Power BI", "Agile", "Scrum", "SAFe", "FinTech", "Banking", "Regulatory", "Compliance", "Risk", "Data", "Analytics", "BI", "SIT", "UAT",
          "Cutover", "Hypercare", "Release", "Stakeholder Management", "Project Management", "Program Management", "Delivery Management")
PROFESSIONS = (r"\bsenior\s+(?:it\s+|technical\s+|software\s+|digital\s+)?project\s+manager\b", r"\bit\s+project\s+manager\b", r"\btechnical\s+project\s+manager\b", r"\bdelivery\s+manager\b",
               r"\btransformation\s+project\s+manager\b", r"\bimplementation\s+manager\b", r"\bplatform\s+delivery\s+lead\b", r"\bsoftware\s+delivery\s+lead\b")
DOMAINS = (r"(?:drug discovery|preclinical|wet lab|laboratory research|molecular biology|medicinal chemistry)", r"(?:construction project|civil engineering|building project|architecture project|site manager)",
           r"(?:hardware r&d|hardware development|product development r&d|manufacturing r&d)")
DANISH = (r"(?:must|required|mandatory|fluent|professional|native|proficient)[^.!?]{0,45}\bdanish\b", r"\bdanish\b[^.!?]{0,45}(?:must|required|mandatory|fluent|professional|native|proficient)", r"(?:flydende|professionelt|modersmål)[^.!?]{0,30}\bdansk\b")


def trimmed(text: Column) -> Column:
    return F.trim(F.coalesce(text.cast("string"), F.lit("")))


def stored_cv(rows: DataFrame) -> DataFrame:
    """Source CV records with their texts trimmed, chars counted, and status: ready, or needs-reupload without a name, a version or a hundred characters."""
    out = rows.withColumns({c: trimmed(F.col(c)) for c in ("file_name", "file_type", "source_version", "cv_text", "summary", "preview", "parsed_at")})
    size = F.col("file_size").try_cast("double")
    ready = (F.col("file_name") != "") & (F.col("source_version") != "") & (F.length("cv_text") >= LEAST_CV)
    return out.withColumns({
        "file_size": F.when(size >= 0, size), "schema_version": F.lit(1), "chars": F.when(F.length("cv_text") > 0, F.length("cv_text")).otherwise(F.coalesce(F.when(F.col("chars") >= 0, F.col("chars")), F.lit(0))),
        "status": F.when(ready, "ready").otherwise("needs-reupload")})


def cv_fault(rows: DataFrame) -> Column:
    """Why a new source CV is refused, or null."""
    return F.when(trimmed(rows["file_name"]) == "", "Source CV filename is missing.").when(F.length(trimmed(rows["cv_text"])) < LEAST_CV, "Source CV requires complete extracted text.").when(trimmed(rows["source_version"]) == "", "Source CV version is missing.")


def request_days(days: Column, policy: str) -> Column:
    """Days asked for: 1, 3, 7 or 14 on the web, else 7; 1 to 30 for several sources and the service."""
    if policy == "web":
        return F.when(days.isin(1, 3, 7, 14), days).otherwise(7)
    return F.greatest(F.lit(1), F.least(F.lit(30), F.coalesce(F.when(days != 0, days), F.lit(7))))


def inferred_skills(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.contains(s.lower()), s) for s in SKILLS)))


def profession(title: Column) -> Column:
    title = clean_basic(title)
    return title.rlike("(?i)" + pattern("|".join(PROFESSIONS)))


def description_rejected(jd: Column) -> Column:
    """Why an employer's job description is out, or null."""
    text = clean_basic(jd)
    return F.when(text.rlike("(?i)" + pattern("|".join(DANISH))), "Mandatory Danish").when(text.rlike("(?i)" + "|".join(DOMAINS)), "Excluded role/domain")


def employees(records: Column) -> Column:
    """Of (count, low, high, at) records the latest that says anything: its count, else the upper, else the lower bound. A null count is 0, as a missing number is in the source's format only if the key is absent."""
    latest = F.array_sort(records, lambda a, b: F.when(F.coalesce(a["at"], F.lit(0)) > F.coalesce(b["at"], F.lit(0)), -1).when(F.coalesce(a["at"], F.lit(0)) < F.coalesce(b["at"], F.lit(0)), 1).otherwise(0))
    good = lambda x: F.when(x >= 0, x)
    each = F.transform(latest, lambda r: F.coalesce(good(r["count"]), good(r["high"]), good(r["low"])))
    return F.try_element_at(F.filter(each, lambda n: n.isNotNull()), F.lit(1))


def completion(*fields: Column) -> Column:
    """The share of fields that are filled, in whole percent."""
    filled = sum((F.when(F.coalesce(f, F.lit(False)), 1).otherwise(0) for f in fields), F.lit(0))
    return F.floor(filled / F.lit(float(len(fields))) * 100 + 0.5).cast("int")


def distinct_reasons(*lists: Column) -> Column:
    """Reasons in order, each once, seven at most."""
    return F.slice(F.array_distinct(F.filter(F.concat(*lists), lambda r: r.isNotNull() & (r != ""))), 1, MOST_REASONS)


def query_list(values: Column) -> Column:
    """Trimmed, not empty, each once, in order."""
    return F.array_distinct(F.filter(F.transform(values, lambda q: F.trim(q)), lambda q: q != ""))


def natural_list(values: Column) -> Column:
    n = F.size(values)
    head = F.array_join(F.slice(values, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return (F.when(n == 0, "").when(n == 1, F.get(values, F.lit(0))).when(n == 2, F.array_join(values, " and "))
            .otherwise(F.concat(head, F.lit(", and "), F.element_at(F.concat(values, F.array(F.lit(""))), n))))


def age_text(published: Column, now: int) -> Column:
    days = F.greatest(F.lit(0), F.floor((F.lit(now) - published) / F.lit(86400.0)))
    return F.when(published.isNull(), "Date unavailable").when(days == 0, "Today").when(days == 1, "1 day ago").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def salary_text(low: Column, high: Column) -> Column:
    amount = lambda x: F.format_number(x, 0)
    return (F.when(low.isNull() & high.isNull(), "Insufficient data").when(low.isNotNull() & high.isNotNull(), F.concat(amount(low), F.lit("–"), amount(high), F.lit(" DKK/month")))
            .when(low.isNotNull(), F.concat(F.lit("From "), amount(low), F.lit(" DKK/month"))).otherwise(F.concat(F.lit("Up to "), amount(high), F.lit(" DKK/month"))))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


# --- model responses


def response_text(body: Column) -> Column:
    """The text of a model response: output_text, else the first output_text part of its output; '' if none."""
    v = F.try_parse_json(body)
    parts = F.flatten(F.transform(F.coalesce(F.try_variant_get(v, "$.output", "array<variant>"), F.array().cast("array<variant>")), lambda x: F.coalesce(F.try_variant_get(x, "$.content", "array<variant>"), F.array().cast("array<variant>"))))
    own = F.filter(parts, lambda p: (F.try_variant_get(p, "$.type", "string") == "output_text") & (F.trim(F.try_variant_get(p, "$.text", "string")) != ""))
    first = F.try_variant_get(F.try_element_at(own, F.lit(1)), "$.text", "string")
    return F.coalesce(F.nullif(F.trim(F.try_variant_get(v, "$.output_text", "string")), F.lit("")), F.trim(first), F.lit(""))


def lenient_json(text: Column) -> Column:
    """A variant from a text that is JSON, holds a fenced block of it, or has it between its outer braces; null if none is."""
    raw = F.trim(F.coalesce(text, F.lit("")))
    fenced = F.trim(F.regexp_extract(raw, r"(?is)```(?:json)?\s*(.*?)```", 1))
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    return F.coalesce(F.try_parse_json(raw), F.try_parse_json(fenced), F.try_parse_json(braces))


def accepted_changes(responses: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """responses: keys, jd, body (a model's answer). facts: keys, fact_id, fact, number. The first five proposed changes that are grounded.

    A change needs a known fact of 30 characters or more, no number or acronym that the fact lacks, and a
    meaningful difference; unknown ids drop out in the join.
    """
    v = responses.withColumn("v", lenient_json(F.col("body")))
    items = v.select(*keys, "jd", F.posexplode(F.coalesce(F.try_variant_get("v", "$.changes", "array<variant>"), F.array().cast("array<variant>"))).alias("at", "c"))
    get = lambda p: F.coalesce(F.try_variant_get("c", p, "string"), F.lit(""))
    terms = F.coalesce(F.try_variant_get("c", "$.termsAligned", "array<string>"), F.array().cast("array<string>"))
    items = items.select(*keys, "jd", "at", get("$.sourceId").alias("fact_id"), clean_basic(get("$.updated")).alias("updated"), clean_basic(get("$.why")).alias("why"),
                         F.slice(F.filter(F.transform(terms, clean_basic), lambda t: t != ""), 1, MOST_TERMS).alias("terms"))
    known = facts.where((F.length(clean_basic(F.col("fact"))) >= LEAST_FACT) & (F.col("number") <= MOST_FACTS)).select(*keys, "fact_id", clean_basic(F.col("fact")).alias("original"))
    out = items.where("updated <> ''").join(known, [*keys, "fact_id"])
    good = evidence.claims_supported(F.col("updated"), F.col("original")) & evidence.meaningful_change(F.col("original"), F.col("updated"), F.col("jd"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("at", "fact_id", "original", "updated", "why", "terms"))), 1, MOST_CHANGES)
    # a model's answer has a handful of changes, so a row's list is small
    out = out.where(good).groupBy(*keys).agg(first.alias("changes")).select(*keys, F.inline("changes"))
    full = F.when(F.col("updated").rlike("[.!?]$"), F.col("updated")).otherwise(F.concat("updated", F.lit(".")))
    why = F.when(F.col("why") != "", F.col("why")).otherwise("Rephrased to make verified experience more relevant to this job description.")
    return out.withColumns({"updated": full, "why": why})


# --- decisions


def decided(decisions: DataFrame, updates: DataFrame) -> DataFrame:
    """Decisions (job_key, change_id, value) after updates in order of ``at``: set, accept (as set to accepted), or clear (all of a job key).

    An update counts if no later clear of its job came; what is left of the old decisions are those without a clear and without a later set.
    """
    clears = updates.where("kind = 'clear'").groupBy("job_key").agg(F.max("at").alias("cleared"))
    value = F.when(F.col("kind") == "accept", "accepted").otherwise(F.col("value"))
    all_rows = decisions.select("job_key", "change_id", "value", F.lit(-1).cast("long").alias("at")).unionByName(updates.where("kind <> 'clear'").select("job_key", "change_id", value.alias("value"), F.col("at").cast("long").alias("at")))
    last = all_rows.groupBy("job_key", "change_id").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("at"))
    return last.join(clears, "job_key", "left").where(F.col("cleared").isNull() | (F.col("at") > F.col("cleared"))).select("job_key", "change_id", "value")


def as_changes(updates: DataFrame) -> DataFrame:
    """Updates of decided() as rows of a change log: a clear is a tombstone of all items of its job key."""
    clear = F.col("kind") == "clear"
    value = F.when(F.col("kind") == "accept", "accepted").when(~clear, F.col("value"))
    return updates.select(F.col("job_key").cast("string").alias("owner"), F.when(~clear, F.col("change_id").cast("string")).alias("item"), value.alias("value"), clear.alias("deleted"), F.col("at").cast("long").alias("at"))


def reviewed(changes: DataFrame, decisions: DataFrame) -> DataFrame:
    """changes: job_key, change_id. How many of a job's changes have a decision."""
    own = changes.join(decisions.select("job_key", "change_id", F.lit(True).alias("done")), ["job_key", "change_id"], "left")
    return own.groupBy("job_key").agg(F.count(F.lit(1)).alias("changes"), F.count_if(F.coalesce("done", F.lit(False))).alias("reviewed"))


def reselected(results: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """results: key, pos, source, id. The row selected before (key, source, id) where it is still there, else the first."""
    found = results.join(selected.select(key, "source", "id", F.lit(True).alias("_kept")), [key, "source", "id"], "left")
    rank = F.struct(F.coalesce("_kept", F.lit(False)), -F.col("pos"))
    return found.groupBy(key).agg(F.max_by(F.struct("source", "id", "pos"), rank).alias("r")).select(key, "r.*")
