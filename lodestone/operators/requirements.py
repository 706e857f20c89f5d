"""Requirements of a job against the facts of a CV, and the contract of a job analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import matches

# Requirement, patterns in a job text, patterns in a fact (lower case).
CATALOG = (
    ("end_to_end", ("end[- ]to[- ]end", "full lifecycle", "delivery lifecycle"), ("end[- ]to[- ]end", "full lifecycle", "delivery lifecycle", "sit", "sat", "rfs", "go-live", "transition to operations")),
    ("distributed", ("distributed", "international teams", "global teams", "across emea"), ("distributed", "international (?:project |engineering )?teams", "denmark.*india", "india.*poland", "dk.*in")),
    ("release", ("release readiness", "go-live", "production release", "release management"), ("release readiness", "go-live", "rfs", "production", "transition to operations")),
    ("risk_dependency", ("risk", "dependenc", "raid"), ("risk", "dependenc", "raid")),
    ("integration", ("integration", "api", "interfaces"), ("integration", "api", "interface")),
    ("governance", ("programme governance", "program governance", "delivery governance", "structured governance", r"\bgovernance\b", "pmo"), ("governance", "roadmap", "backlog governance", "pmo")),
    ("regulatory", ("regulated", "regulatory", "compliance"), ("regulated", "regulatory", "compliance", "aml")),
    ("agile", ("agile", "hybrid delivery", "scrum"), ("agile", "hybrid", "scrum", "safe")),
)
KINDS = ("must_have", "important", "supporting")
ANALYSIS = "struct<roleMission:string,candidatePositioning:string,priorities:array<struct<id:string,rank:int,kind:string,requirement:string,why:string,jdEvidence:array<string>>>,gapsToAvoid:array<string>>"


def required_of(text: Column) -> Column:
    """The requirements that a job text names, in catalogue order."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(matches(lowered, *jd), name) for name, jd, _ in CATALOG)))


def shown_by(fact: Column) -> Column:
    """The requirements that a fact is evidence of."""
    lowered = F.lower(F.coalesce(fact, F.lit("")))
    return F.array_compact(F.array(*(F.when(matches(lowered, *shown), name) for name, _, shown in CATALOG)))


def supported(jobs: DataFrame, facts: DataFrame) -> DataFrame:
    """cv, job, requirement, supported: each requirement of each job, and whether any fact of the cv shows it.

    jobs: cv, job, text. facts: cv, fact. Facts are reduced to the requirements that a cv shows (eight at
    most) before they meet the jobs, so the join never pairs facts with jobs.
    """
    wanted = jobs.select("cv", "job", F.explode(required_of(F.col("text"))).alias("requirement"))
    shown = facts.select("cv", F.explode(shown_by(F.col("fact"))).alias("requirement")).distinct().withColumn("shown", F.lit(True))
    out = wanted.join(shown, ["cv", "requirement"], "left")
    return out.select("cv", "job", "requirement", F.coalesce("shown", F.lit(False)).alias("supported"))


def analysis_fault(json: Column) -> Column:
    """What is wrong with a job analysis, by the first rule that fails; null if nothing is."""
    value = F.from_json(json, ANALYSIS)
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    items = F.coalesce(value["priorities"], F.array())
    ids = F.transform(items, lambda p: F.trim(F.coalesce(p["id"], F.lit(""))))
    each = [
        ("text", blank(value["roleMission"]) | blank(value["candidatePositioning"])),
        ("count", ~F.size(items).between(3, 5)),
        ("ids", F.exists(ids, lambda i: i == "") | (F.size(F.array_distinct(ids)) < F.size(ids))),
        ("kind", F.exists(items, lambda p: ~F.coalesce(p["kind"].isin(*KINDS), F.lit(False)))),
        ("words", F.exists(items, lambda p: blank(p["requirement"]) | blank(p["why"]))),
        ("evidence", F.exists(items, lambda p: (F.size(F.coalesce(p["jdEvidence"], F.array())) < 1) | F.exists(F.coalesce(p["jdEvidence"], F.array()), lambda e: blank(e)))),
        ("rank", ~F.forall(F.transform(items, lambda p, i: F.coalesce(p["rank"] == i + 1, F.lit(False))), lambda ok: ok)),
        ("gaps", value["gapsToAvoid"].isNull()),
    ]
    chain = F.when(value.isNull(), "json")
    for name, fails in each:
        chain = chain.when(fails, name)
    return chain
