"""The search plan: verified postings, duplicates out, discovery, exclusion, score, history, order, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import identity, rules, score
from lodestone.operators.observed import counted, fenced
from lodestone.sources.postings import CV, NOW


@dataclass(frozen=True)
class Policy:
    """What differs between the service's and the web's staging; caps and order are in plans/web.py and operators/multisource.py."""

    name: str = "service"
    grace_hours: float = 24.0
    null_date_passes: bool = True
    discovery: str = "words"


SERVICE = Policy()
WEB = Policy("web", 6.0, True, "categories")


def staged(jobs: DataFrame, policy: Policy = SERVICE, days: int = 14, now: int = NOW) -> DataFrame:
    """Verified, fresh, deduplicated postings with their fingerprint, features and discovery flag."""
    kept = jobs.where(F.col("full_jd_verified") & (F.col("description") != ""))
    fresh = F.col("published_at") >= now - days * 86400 - int(policy.grace_hours * 3600)
    kept = kept.where(F.coalesce(fresh, F.lit(policy.null_date_passes)))
    kept = kept.withColumns({"fingerprint": identity.fingerprint(), "material_hash": identity.material_hash()})
    kept = identity.deduplicated(kept, ["fingerprint"], "pos")
    if policy.discovery == "words":
        return rules.with_features(rules.with_gate(kept))
    gate = rules.discovered_by_categories(F.col("title"), F.col("technologies"), F.col("responsibilities"))
    return rules.with_features(kept).withColumn("discovered", gate)


def evaluated(jobs: DataFrame, cv_text: str = CV, policy: Policy = SERVICE) -> DataFrame:
    """Every discovered posting with rule, scores and verdict; an excluded one scores zero."""
    # fenced, so that the patterns that made a column do not run again to filter on it
    found = fenced(staged(jobs, policy))
    out = found.where("discovered").withColumn("rule", rules.exclusion_rule())
    out = fenced(score.with_scores(out, cv_text).drop("description", "title_n", "body_n", "text_n"))
    gone = F.col("rule").isNotNull()
    zero = {c: F.when(gone, 0).otherwise(F.col(c)) for c in ("responsibility", "experience", "geography", "career", "total")}
    out = out.withColumns(zero)
    return out.withColumns({"verdict": score.verdict(F.col("total"), 1), "action": score.verdict(F.col("total"), 2), "reason": rules.reason(F.col("rule"))})


def ranked(jobs: DataFrame, history: DataFrame, most: int = 10, only_new: bool = True, cv_text: str = CV) -> DataFrame:
    """The best postings: score, then new before the rest, then newest, then first to arrive. TakeOrderedAndProject, no full sort."""
    out = evaluated(jobs, cv_text).where("rule IS NULL AND verdict <> 'Poor fit'")
    out = identity.history_status(out, history)
    if only_new:
        out = out.where("history_status <> 'SEEN'")
    new_first = F.when(F.col("history_status") == "NEW", 1).otherwise(0)
    return out.orderBy(F.desc("total"), new_first.desc(), F.col("published_at").desc_nulls_last(), "pos").limit(most)


def stage_stats(jobs: DataFrame, history: DataFrame, most: int = 10, days: int = 10_000) -> DataFrame:
    """fetched, full_jd_verified, deduplicated, cheap_filter_passed, full_jd_evaluated, worthwhile: one row.

    The postings are read once for the first two counts and once for the rest.
    """
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    raw = jobs.agg(F.count(F.lit(1)).alias("fetched"), n(F.col("full_jd_verified") & (F.col("description") != "")).alias("full_jd_verified"))
    found = staged(jobs, SERVICE, days)
    # the rule and the scores of a posting matter only past the gate
    found = found.withColumn("rule", F.when(F.col("discovered"), rules.exclusion_rule()))
    found = identity.history_status(score.with_scores(found, CV), history)
    worth = F.col("discovered") & F.col("rule").isNull() & (F.col("verdict") != "Poor fit") & (F.col("history_status") != "SEEN")
    late = found.agg(F.count(F.lit(1)).alias("deduplicated"), n(F.col("discovered")).alias("cheap_filter_passed"), F.least(n(worth), F.lit(most)).alias("worthwhile"))
    return raw.crossJoin(late).select("fetched", "full_jd_verified", "deduplicated", "cheap_filter_passed", F.col("cheap_filter_passed").alias("full_jd_evaluated"), "worthwhile")


def searched(jobs: DataFrame, history: DataFrame, out: str, most: int = 10, only_new: bool = True, days: int = 14, cv_text: str = CV) -> dict[str, int]:
    """The best postings, written to ``out``, and the counters of the stages that they came through: one pass over the postings for both."""
    verified = F.col("full_jd_verified") & (F.col("description") != "")
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    jobs, raw = counted(jobs, fetched=F.count(F.lit(1)), full_jd_verified=n(verified))
    found, kept = counted(staged(jobs, SERVICE, days), deduplicated=F.count(F.lit(1)), cheap_filter_passed=n(F.col("discovered")))
    found = found.withColumn("rule", F.when(F.col("discovered"), rules.exclusion_rule()))
    found = fenced(identity.history_status(score.with_scores(found, cv_text), history))
    worth = F.col("discovered") & F.col("rule").isNull() & (F.col("verdict") != "Poor fit")
    worth = worth & (F.col("history_status") != "SEEN") if only_new else worth
    new_first = F.when(F.col("history_status") == "NEW", 1).otherwise(0)
    best = found.where(worth).orderBy(F.desc("total"), new_first.desc(), F.col("published_at").desc_nulls_last(), "pos").limit(most)
    best, last = counted(best.select("pos", "fingerprint", "material_hash", "total", "verdict", "action", "history_status"), worthwhile=F.count(F.lit(1)))
    best.write.mode("overwrite").parquet(out)
    told = raw.get | kept.get | last.get
    return told | {"full_jd_evaluated": told["cheap_filter_passed"]}
