"""Salary, deadline, work model and other values parsed from a posting's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import lexicon as L
from lodestone.functions.text import contains_any, matches


def amount(raw: Column) -> Column:
    """A monthly amount in range, else null: thousands marks and a decimal part of zeros are dropped."""
    whole = F.regexp_replace(F.regexp_replace(F.trim(raw), "[.,]00$", ""), "[^0-9]", "").try_cast("int")
    return F.when(whole.between(*L.SALARY_RANGE), whole)


def monthly_salary(text: Column) -> Column:
    """struct(low, high): from the first format that gives two amounts in range; an explicit monthly unit is required."""
    found = []
    for regex in L.SALARY:
        a, b = (amount(F.regexp_extract(text, f"(?i){regex}", i)) for i in (1, 2))
        found.append(F.when(a.isNotNull() & b.isNotNull(), F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))))
    return F.coalesce(*found)


def deadline(text: Column, reference_year: int) -> Column:
    """The last second of the day named as the deadline; null if there is none or no such day."""
    part = lambda i: F.regexp_extract(F.lower(text), L.DEADLINE, i)
    months = F.create_map(*(F.lit(x) for pair in L.MONTHS.items() for x in pair))
    month = F.try_element_at(months, part(2))
    year = F.coalesce(part(3).try_cast("int"), F.lit(reference_year))
    return F.try_make_timestamp(year, month, part(1).try_cast("int"), F.lit(23), F.lit(59), F.lit(59).cast("decimal(16,6)"))


def remote_type(location: Column, description: Column) -> Column:
    place, text = F.lower(location), F.lower(description)
    return (
        F.when(matches(place, r"\bhybrid\b"), "hybrid").when(matches(place, r"\bremote\b"), "remote")
        .when(matches(text, *L.HYBRID), "hybrid").when(matches(text, *L.REMOTE), "remote").when(matches(text, *L.ONSITE), "onsite")
        .otherwise("unknown")
    )


def remote_eligibility(kind: Column, location: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", location, description))
    return (
        F.when(kind != "remote", "NOT APPLICABLE")
        .when(matches(text, L.ELSEWHERE_ONLY) & ~matches(text, L.HERE), "DENMARK EXCLUDED")
        .when(matches(text, *L.ELIGIBLE), "DENMARK CONFIRMED").otherwise("UNVERIFIED")
    )


def employment_type(text: Column) -> Column:
    text = F.lower(text)
    return (
        F.when(contains_any(text, L.PERMANENT_WORDS), "permanent").when(contains_any(text, L.CONTRACT_WORDS), "contract")
        .when(contains_any(text, L.FIXED_TERM_WORDS), "fixed-term").otherwise("unknown")
    )


def job_id(url: Column) -> Column:
    """Seven or more digits that end a /view/ path segment, unless the query names the id."""
    named = [F.nullif(F.regexp_extract(url, rf"[?&]{key}=([0-9]+)(?:&|#|$)", 1), F.lit("")) for key in ("currentJobId", "jobId")]
    return F.coalesce(*named, F.nullif(F.regexp_extract(url, r"/view/(?:[^/?#]*-)?([0-9]{7,})(?:[/?#]|$)", 1), F.lit("")))


def instant(text: Column) -> Column:
    """ISO dates (Z, offsets, or none: UTC) and mail dates (weekday ignored); null if neither."""
    mail = F.regexp_replace(text, "^[A-Za-z]{3},\\s*", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km on a sphere of radius 6371."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * 6371 * F.atan2(F.sqrt(a), F.sqrt(1 - a))
