"""Scores in exact tenths: whole hundredths are summed and rounded half up once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions.text import categories, contains_any, matches, normal, normal_text, term_count


@dataclass(frozen=True)
class Wording:
    """How a policy reads texts: what it makes of them, and what it looks for in rows of its features."""

    text: Callable[[Column], Column]
    finance: Callable[[], Column]
    senior: Callable[[Column], Column]
    manager: Callable[[Column], Column]
    at_home: Callable[[Column], Column]
    cv_name: str


SERVICE = Wording(
    text=normal,
    finance=lambda: (term_count(F.col("text_n"), L.FINANCE_TERMS) > 0) | matches(F.col("text_n"), L.REGULATED),
    senior=lambda title: contains_any(title, L.SENIOR_TITLE), manager=lambda title: contains_any(title, L.MANAGER_TITLE),
    at_home=lambda country: normal(country).isin(*L.COUNTRY), cv_name="Master CV")


def tenths(hundredths: Column) -> Column:
    return F.floor((hundredths + 5) / 10).cast("int")


def points(value: Column) -> Column:
    """Tenths as a number with one decimal."""
    return (value / F.lit(10.0)).cast("double")


def has(array: str, name: str) -> Column:
    return F.array_contains(array, name)


def responsibility() -> Column:
    return tenths(responsibility_hundredths())


def responsibility_hundredths() -> Column:
    n = F.size("responsibilities")
    extra = (
        F.when(has("responsibilities", "end_to_end"), 50).otherwise(0)
        + F.when(has("responsibilities", "accountability_outcomes"), 40).otherwise(0)
        + F.when(has("responsibilities", "risk_dependencies") & has("responsibilities", "scope_schedule"), 30).otherwise(0)
    )
    return F.least(F.lit(1000), 220 + F.least(F.lit(660), 66 * n) + extra)


def experience(cv: str, wording: Wording = SERVICE) -> Column:
    """Against the categories of the CV, an array column."""
    shared = F.size(F.array_intersect("evidence", cv))
    finance = wording.finance()
    known = has(cv, "financial") | has(cv, "regulatory")
    total = 200 + F.least(F.lit(500), 58 * shared) + F.least(F.lit(160), 32 * F.size("technologies")) + F.when(finance & known, 110).otherwise(0)
    return tenths(F.least(F.lit(1000), total))


def places(wording: Wording) -> tuple[Column, Column, Column]:
    """Whether a location is a preferred one, in the capital's region, in the country."""
    place = wording.text(F.col("location"))
    preferred = contains_any(place, [normal_text(x) for x in L.PREFERRED_LOCATIONS])
    return preferred, contains_any(place, L.CAPITAL_REGION), contains_any(place, L.COUNTRY) | F.coalesce(wording.at_home(F.col("country")), F.lit(False))


def geography(wording: Wording = SERVICE) -> Column:
    preferred, capital, country = places(wording)
    kind, eligible = F.col("remote_type"), F.col("remote_eligibility")
    return (
        F.when((kind == "remote") & (eligible == "DENMARK CONFIRMED"), 100).when((kind == "remote") & (eligible == "UNVERIFIED"), 50)
        .when(preferred & (kind == "hybrid"), 100).when(preferred, 90)
        .when(capital & (kind == "hybrid"), 80).when(capital & (kind == "onsite"), 55).when(capital, 70)
        .when(country, 50).otherwise(20)
    )


def career(wording: Wording = SERVICE) -> Column:
    title = F.when(wording.senior(F.col("title_n")), 15).when(wording.manager(F.col("title_n")), 5).otherwise(0)
    people = sum((F.when(matches(F.col("body_n"), p), 1).otherwise(0) for p in L.PEOPLE_MANAGEMENT), F.lit(0))
    selected = matches(F.col("body_n"), L.SELECTED_ONLY) & matches(F.col("body_n"), L.PORTFOLIO)
    low, high = F.col("salary_min"), F.col("salary_max")
    sure = F.coalesce(low, high, F.lit(0))
    salary = (
        F.when(low.isNull() & high.isNull(), 0)
        .when(F.col("employment_type") == "contract", F.when(sure >= L.SALARY_CONTRACT, 20).otherwise(-20))
        .when(low >= L.SALARY_TARGET, 20).when(low >= L.SALARY_ACCEPTABLE, 10)
        .when((low < L.SALARY_ACCEPTABLE) & (high >= L.SALARY_ACCEPTABLE), 0)
        .when((sure > 0) & (sure < L.SALARY_VERY_LOW), -40).when((sure > 0) & (sure < L.SALARY_LOW), -20).otherwise(0)
    )
    total = 55 + title - F.when(people >= 2, 20).otherwise(0) - F.when(selected, 7).otherwise(0) + salary
    return F.greatest(F.lit(0), F.least(F.lit(100), total))


def weighted() -> Column:
    total = sum(F.col(name) * round(100 * float(weight)) for name, weight in L.WEIGHTS.items())
    return F.floor((total + 50) / 100).cast("int")


def verdict(total: Column, which: int) -> Column:
    chain = None
    for row in L.VERDICTS:
        if row[0] is None:
            return chain.otherwise(row[which])
        test = total >= round(10 * float(row[0]))
        chain = F.when(test, row[which]) if chain is None else chain.when(test, row[which])
    raise AssertionError


def with_scores(features: DataFrame, cv_text: str, wording: Wording = SERVICE) -> DataFrame:
    """The four scores, the total (all in tenths), verdict and action of rows of with_features(). One CV text is a literal."""
    scored = features.withColumn("cv", categories(wording.text(F.lit(cv_text)), L.EVIDENCE))
    scored = scored.withColumns({"responsibility": responsibility(), "experience": experience("cv", wording), "geography": geography(wording), "career": career(wording)})
    scored = scored.withColumn("total", weighted())
    return scored.withColumns({"verdict": verdict(F.col("total"), 1), "action": verdict(F.col("total"), 2)})


def notes(features: DataFrame) -> DataFrame:
    """The note on responsibilities: the first six by name."""
    return features.withColumn("note", duties_note())


def duties_note() -> Column:
    names = F.array_compact(F.array(*(F.when(has("responsibilities", k), v) for k, v in L.RESPONSIBILITY_NAMES.items())))
    return F.when(F.size(names) > 0, F.concat(F.lit("Delivery evidence: "), F.array_join(F.slice(names, 1, 6), ", ")))


def match_and_gaps(scored: DataFrame, wording: Wording = SERVICE) -> DataFrame:
    """match (four notes at most) and gaps (three) of rows of with_scores(): on duties, experience, place and career, in this order.

    An excluded row (rule not null) has no notes and its reason as the only gap.
    """
    shared = F.array_intersect("evidence", "cv")
    named = F.transform(shared, lambda e: F.element_at(F.create_map(*(F.lit(x) for pair in L.EVIDENCE_NAMES.items() for x in pair)), e))
    finance, (preferred, capital, country) = wording.finance(), places(wording)
    kind, eligible = F.col("remote_type"), F.col("remote_eligibility")
    remote_known = (kind == "remote") & eligible.isin("DENMARK CONFIRMED", "UNVERIFIED")
    people = sum((F.when(matches(F.col("body_n"), p), 1).otherwise(0) for p in L.PEOPLE_MANAGEMENT), F.lit(0))
    low, high = F.col("salary_min"), F.col("salary_max")
    sure, contract, unknown = F.coalesce(low, high, F.lit(0)), F.col("employment_type") == "contract", low.isNull() & high.isNull()
    match = [
        duties_note(), F.when(finance, "Financial IT / regulated-domain priority match"),
        F.when(F.size(shared) > 0, F.concat(F.lit(f"JD ↔ {wording.cv_name} evidence: "), F.array_join(F.slice(named, 1, 6), ", "))),
        F.when(remote_known, F.when(eligible == "DENMARK CONFIRMED", "Remote employment from Denmark is explicitly supported")).when(preferred, F.when(kind == "hybrid", "Preferred geography + hybrid").otherwise("Preferred geographic corridor"))
        .when(capital, F.when(kind == "hybrid", "Copenhagen / Capital Region hybrid").when(kind != "onsite", "Copenhagen / Capital Region; work model not verified")),
        F.when(wording.senior(F.col("title_n")), "Senior/lead positioning is preserved"),
        F.when(unknown, None).when(contract, F.when(sure >= L.SALARY_CONTRACT, "Contract compensation has a clear premium")).when(low >= L.SALARY_TARGET, "Salary floor is at/above preferred level").when(low >= L.SALARY_ACCEPTABLE, "Salary floor is within acceptable range"),
    ]
    gaps = [
        F.when(responsibility_hundredths() < 700, "Delivery ownership is weaker than the target profile"), F.when(F.size(shared) == 0, f"Direct JD ↔ {wording.cv_name} evidence overlap is limited"),
        F.when(F.size("technologies") == 0, "Technology/digital scope is not explicit in the JD"),
        F.when(remote_known, F.when(eligible == "UNVERIFIED", "REMOTE ELIGIBILITY — UNVERIFIED")).when(preferred, None).when(capital, F.when(kind == "onsite", "Central Copenhagen onsite attendance may be unattractive"))
        .when(country, "Location is in Denmark but outside the preferred corridor").otherwise("Location is outside the target Denmark geography"),
        F.when(people >= 2, "Role carries substantial people-management responsibility relative to hands-on delivery"),
        F.when(matches(F.col("body_n"), L.SELECTED_ONLY) & matches(F.col("body_n"), L.PORTFOLIO), "Direct project ownership appears limited to selected initiatives"),
        F.when(unknown, "Compensation: Insufficient data").when(contract, F.when(sure < L.SALARY_CONTRACT, "Contract compensation premium is not evidenced")).when(low >= L.SALARY_ACCEPTABLE, None)
        .when((low < L.SALARY_ACCEPTABLE) & (high >= L.SALARY_ACCEPTABLE), "Salary range overlaps the acceptable level but starts below it").when((sure > 0) & (sure < L.SALARY_VERY_LOW), "Compensation is a strong negative")
        .when((sure > 0) & (sure < L.SALARY_LOW), "Compensation is below preferred range").otherwise("Compensation needs verification"),
    ]
    first = lambda columns, most: F.slice(F.array_compact(F.array(*columns)), 1, most)
    if "reason" not in scored.columns:
        return scored.withColumns({"match": first(match, 4), "gaps": first(gaps, 3)})
    gone = F.col("reason").isNotNull()
    return scored.withColumns({"match": F.when(gone, F.array().cast("array<string>")).otherwise(first(match, 4)), "gaps": F.when(gone, F.array("reason")).otherwise(first(gaps, 3))})
