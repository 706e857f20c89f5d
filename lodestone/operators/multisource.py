"""The multi-source search: query lists, title fit, exclusions in the user's words, geography, pay, and the combined score.

A search profile is one row of settings, so its parts are literals here; the postings are the relation.
Postings carry title, company, location, country, jd, remote, posted_at (seconds), salary_currency,
salary_min_monthly, salary_max_monthly and pos, the order of arrival.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import clean_basic, folded_dashes, pattern

# Title aliases by role, in the order in which they are tried.
ROLE_ALIASES = (
    (r"technical\s+project\s+manager", (r"technical\s+project\s+manager", r"technical\s+program(?:me)?\s+manager", r"technology\s+project\s+manager", r"engineering\s+project\s+manager", r"implementation\s+project\s+manager", r"technical\s+delivery\s+(?:manager|lead)")),
    (r"delivery\s+manager", (r"delivery\s+manager", r"delivery\s+lead", r"it\s+delivery\s+manager", r"software\s+delivery\s+(?:manager|lead)", r"execution\s+lead", r"software\s+execution\s+lead", r"implementation\s+(?:manager|lead)")),
    (r"senior\s+project\s+manager", (r"senior\s+(?:it\s+|technical\s+|software\s+|digital\s+)?project\s+manager", r"senior\s+project\s+lead", r"lead\s+project\s+manager")),
    (r"project\s+manager", (r"(?:it|technical|software|digital|technology)\s+project\s+manager", r"project\s+manager", r"project\s+lead", r"implementation\s+manager")),
    (r"program(?:me)?\s+manager", (r"program(?:me)?\s+manager", r"program(?:me)?\s+lead", r"strategic\s+program(?:me)?\s+manager", r"portfolio\s+program(?:me)?\s+manager")),
)
# Further queries for a role list that names a role.
EXPANSIONS = (
    ("project manager", ("IT Project Manager", "Software Project Manager", "Project Lead")),
    ("delivery manager", ("Delivery Lead", "IT Delivery Manager", "Software Execution Lead")),
    ("technical project manager", ("Technical Project Manager", "Implementation Manager")),
    ("program(?:me)? manager", ("Program Manager", "Programme Manager")),
)
MANDATORY_WORDS = "must|required|mandatory|fluent|professional|native|proficient"
HARDWARE = r"(?:industrial\s+hardware|hardware\s+(?:r&d|development)|manufacturing\s+(?:r&d|research)|research\s+and\s+development)"
COORDINATOR, CONSTRUCTION_REASON, HARDWARE_REASON = "Coordinator / assistant role", "Construction", "Industrial hardware / manufacturing R&D"
LEAST_ROLE, MOST_DETAILS, MOST_RESULTS, MOST_ROLES, MOST_QUERIES = 45, 18, 30, 12, 10


def role_list(text: str) -> list[str]:
    """The roles of a profile: parts between commas, semicolons and line ends."""
    return [r for r in (" ".join(part.split()) for part in re.split("[,;\n]", text or "")) if r][:MOST_ROLES]


def roles_of(text: Column) -> Column:
    """role_list() of a column of profiles."""
    return F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;\n]"), clean_basic), lambda r: r != ""), 1, MOST_ROLES)


def search_queries(roles: Column) -> Column:
    """A role list with the queries that its roles imply, without repeats, ten at most."""
    joined = F.lower(F.array_join(roles, " | "))
    out = roles
    for named, more in EXPANSIONS:
        out = F.concat(out, F.when(joined.rlike(named), F.array(*map(F.lit, more))).otherwise(F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.filter(F.transform(out, clean_basic), lambda q: q != "")), 1, MOST_QUERIES)


def role_patterns(role: str) -> tuple[str, ...]:
    for test, aliases in ROLE_ALIASES:
        if re.search(test, role, re.I):
            return aliases
    words = [w for w in role.lower().split() if len(w) > 2 and w not in ("senior", "lead", "manager")]
    return (".*".join(map(re.escape, words)),) if words else (re.escape(role),)


def role_tokens(role: str) -> list[str]:
    return [w for w in role.lower().split() if len(w) > 3 and w not in ("senior", "manager")]


def role_fit(title: Column, roles: list[str]) -> Column:
    """struct(score, role): 100 where a title names a role, 90 for an alias, else up to 75 by shared words; the first of equals, and no role for 0."""
    title = clean_basic(title)
    words = F.split(folded_dashes(title), r"\s+")
    fits = []
    for i, role in enumerate(roles):
        tokens = role_tokens(role)
        shared = sum((F.when(F.array_contains(words, w), 1).otherwise(0) for w in tokens), F.lit(0))
        points = F.floor(shared / F.lit(float(len(tokens))) * 75 + 0.5).cast("int") if tokens else F.lit(0)
        alias = F.lit(False)
        for regex in role_patterns(role):
            alias = alias | title.rlike("(?i)" + pattern(regex))
        points = F.when(title.rlike("(?i)" + pattern(rf"\b{re.escape(role)}\b")), 100).when(alias, 90).otherwise(points)
        fits.append(F.struct(points.alias("score"), F.lit(-i).alias("order"), F.when(points > 0, role).alias("role")))
    best = F.greatest(*fits) if len(fits) > 1 else fits[0]
    return F.struct(best["score"].alias("score"), best["role"].alias("role"))


def mandatory_danish(text: Column) -> Column:
    """The whole-text rule: a demand within 35 characters of the language, in one sentence."""
    text = clean_basic(text)
    return text.rlike("(?i)" + pattern(rf"(?:{MANDATORY_WORDS})[^.!?]{{0,35}}\bdanish\b")) | text.rlike("(?i)" + pattern(rf"\bdanish\b[^.!?]{{0,35}}(?:{MANDATORY_WORDS})"))


def exclusion(title: Column, company: Column, jd: Column, exclusions: str) -> Column:
    """The first exclusion in the user's text that a posting meets, or null."""
    raw = exclusions or ""
    text = F.concat_ws(" ", title, company, jd)
    has = lambda rx: re.search(rx, raw, re.I)
    rules = []
    if has(r"mandatory\s+danish"):
        rules.append((mandatory_danish(text), "Mandatory Danish"))
    if has("coordinator|assistant"):
        name = folded_dashes(clean_basic(title))
        rules.append((name.rlike(pattern(r"\b(coordinator|assistant)\b")) & ~name.rlike(pattern(r"\bmanager\b")), COORDINATOR))
    if has("construction"):
        rules.append((text.rlike("(?i)" + pattern(r"\bconstruction\b")), CONSTRUCTION_REASON))
    if has(r"industrial\s+hardware|manufacturing\s+r&d"):
        rules.append((text.rlike("(?i)" + HARDWARE), HARDWARE_REASON))
    low = folded_dashes(clean_basic(text))
    for phrase, tokens in generic_phrases(raw):
        every = F.lit(True)
        for token in tokens:
            every = every & low.contains(token)
        rules.append((every, phrase))
    chain = F.lit(None).cast("string")
    for test, name in reversed(rules):
        chain = F.when(test, name).otherwise(chain)
    return chain


def generic_phrases(raw: str) -> list[tuple[str, list[str]]]:
    """Other phrases between semicolons, with the words of more than three letters that must all occur (two at least)."""
    phrases = [" ".join(p.split()) for p in raw.split(";")]
    phrases = [p for p in phrases if len(p) >= 5 and not re.search("mandatory danish|coordinator|assistant|construction|industrial hardware|manufacturing", p, re.I)]
    each = [(p, [w for w in re.split("[^a-z0-9+#]+", p.lower()) if len(w) > 3]) for p in phrases]
    return [(p, words) for p, words in each if len(words) >= 2]


def remote_allowed(location: Column, geography: list[str]) -> Column:
    place = folded_dashes(clean_basic(location))
    if "Remote worldwide" in geography:
        return F.lit(True)
    out = F.lit(False)
    if "Remote EU/EMEA" in geography:
        out = out | place.rlike(pattern(r"\b(worldwide|anywhere|global)\b")) | place.rlike(pattern(r"\b(europe|european|emea|eu\b|denmark|nordic|scandinavia|cet|cest)\b"))
    if any(g.startswith("Denmark") for g in geography):
        out = out | place.rlike(pattern(r"\bdenmark|copenhagen|danmark\b"))
    return out


def local_allowed(country: Column, geography: list[str]) -> Column:
    if not any(g.startswith("Denmark") for g in geography):
        return F.lit(False)
    return F.coalesce(country, F.lit("")).rlike("^$|(?i)danmark|denmark")


def preferred_location(location: Column, preferred: str) -> Column:
    """The first preference that contains a location or is contained in it, so an empty location meets the first; null if none does."""
    place = folded_dashes(clean_basic(location))
    wanted = [" ".join(p.lower().split()) for p in re.split("[,;\n]", preferred or "")]
    out = F.lit(None).cast("string")
    for p in reversed([p for p in wanted if p]):
        out = F.when(place.contains(p) | F.lit(p).contains(place), p).otherwise(out)
    return out


def salary_status(currency: Column, low: Column, high: Column, floor: int | None) -> Column:
    if not floor:
        return F.lit("not-used")
    known = F.coalesce((currency == "DKK") & high.isNotNull(), F.lit(False))
    return F.when(~known, "unknown").when(high < floor, "below").when(F.coalesce(low >= floor, F.lit(False)), "pass").otherwise("possible")


def source_geography(geography: Column) -> Column:
    """The parameter of the remote board: '' worldwide, else emea or denmark."""
    local = F.exists(geography, lambda g: g.startswith("Denmark"))
    return F.when(F.array_contains(geography, "Remote worldwide"), "").when(F.array_contains(geography, "Remote EU/EMEA"), "emea").when(local, "denmark").otherwise("emea")


def salary_of_text(text: Column) -> Column:
    """struct(currency, low, high) of a free salary text; amounts only in DKK, a month."""
    text = clean_basic(text)
    numbers = F.filter(F.transform(F.regexp_extract_all(text, F.lit("[0-9,.]+"), 0), lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())
    currency = F.when(text.rlike("(?i)DKK"), "DKK").when(text.rlike("(?i)€|EUR"), "EUR").when(text.rlike("(?i)£|GBP"), "GBP").when(text.rlike(r"(?i)\$|USD"), "USD")
    by = F.when(text.rlike("(?i)year|annual|per annum"), F.lit(12.0)).otherwise(F.lit(1.0))
    low, high = F.get(numbers, F.lit(0)), F.coalesce(F.get(numbers, F.lit(1)), F.get(numbers, F.lit(0)))
    dkk = F.coalesce(currency == "DKK", F.lit(False))
    return F.struct(currency.alias("currency"), F.when(dkk, low / by).alias("low"), F.when(dkk, high / by).alias("high"))


def monthly(amount: Column, currency: Column, period: Column) -> Column:
    """An amount a month from one a year, an hour (160 of them) or a month; DKK only."""
    period = F.lower(F.coalesce(period, F.lit("")))
    value = amount.cast("double")
    return F.when(currency == "DKK", F.when(period.rlike("year|annual"), value * (F.lit(1.0) / 12)).when(period.rlike("hour"), value * 160).otherwise(value))


def search_score(role: Column, remote: Column, preferred: Column, age_days: Column, days: int, pay: Column) -> Column:
    """0.55 of the title fit, and points for place, age and pay; 0 to 100."""
    place = F.when(remote | preferred.isNotNull(), 20).otherwise(14)
    fresh = F.greatest(F.lit(0), F.floor(15 - age_days / F.lit(float(max(1, days))) * 10 + 0.5))
    salary = F.when(pay == "pass", 10).when(pay == "possible", 7).when(pay == "unknown", 4).otherwise(6)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(role * F.lit(0.55) + place + fresh + salary + 0.5))).cast("int")


def match_ratio(matched: Column, required: Column) -> Column:
    """35 to 98 by the share of requirements that are met; 50 where none is asked for."""
    score = F.floor(35 + 63 * (matched / required) + 0.5)
    return F.when(required == 0, 50).otherwise(F.greatest(F.lit(35), F.least(F.lit(98), score))).cast("int")


def combined(search: Column, match: Column) -> tuple[Column, Column]:
    """0.68 of the search score and 0.32 of the match, and its label."""
    score = F.floor(F.lit(0.68) * search + F.lit(0.32) * match + 0.5).cast("int")
    return score, F.when(score >= 82, "STRONG FIT").when(score >= 68, "GOOD FIT").otherwise("POSSIBLE FIT")


@dataclass(frozen=True)
class Profile:
    roles: str
    geography: list[str] = field(default_factory=list)
    preferred: str = ""
    salary: int | None = None
    exclusions: str = ""
    days: int = 7

    def checked(self) -> Profile:
        """Days held between 1 and 30; roles and geography are required."""
        if not role_list(self.roles):
            raise ValueError("Add at least one target role to the search profile.")
        if not self.geography:
            raise ValueError("Select at least one geography.")
        return Profile(self.roles, self.geography, self.preferred, self.salary, self.exclusions, max(1, min(30, self.days)))


def judged(jobs: DataFrame, profile: Profile, now: int) -> DataFrame:
    """Postings with role_score, matched_role, salary_status, reject (freshness, role, geography, exclusion, salary or null) and search_score."""
    profile = profile.checked()
    age = F.coalesce(F.greatest(F.lit(0.0), (F.lit(now) - F.col("posted_at")) / F.lit(86400.0)), F.lit(999.0))
    out = jobs.withColumns({
        "age_days": age, "fit": role_fit(F.col("title"), role_list(profile.roles)),
        "salary_status": salary_status(F.col("salary_currency"), F.col("salary_min_monthly"), F.col("salary_max_monthly"), profile.salary),
        "preferred": F.when(~F.col("remote"), preferred_location(F.col("location"), profile.preferred)),
    })
    place = F.when(F.col("remote"), remote_allowed(F.col("location"), profile.geography)).otherwise(local_allowed(F.col("country"), profile.geography))
    reject = (
        F.when(F.col("age_days") > profile.days + 0.25, "freshness").when(F.col("fit.score") < LEAST_ROLE, "role").when(~place, "geography")
        .when(exclusion(F.col("title"), F.col("company"), F.col("jd"), profile.exclusions).isNotNull(), "exclusion").when(F.col("salary_status") == "below", "salary"))
    score = search_score(F.col("fit.score"), F.col("remote"), F.col("preferred"), F.col("age_days"), profile.days, F.col("salary_status"))
    return out.withColumns({"reject": reject, "role_score": F.col("fit.score"), "matched_role": F.col("fit.role")}).withColumn("search_score", F.when(F.col("reject").isNull(), score)).drop("fit")


def results(judged_jobs: DataFrame) -> DataFrame:
    """The best thirty: score, then newest, then order of arrival."""
    return judged_jobs.where(F.col("reject").isNull()).orderBy(F.desc("search_score"), F.col("posted_at").desc_nulls_last(), "pos").limit(MOST_RESULTS)


def rejected(judged_jobs: DataFrame) -> DataFrame:
    """How many postings each reason rejects, in one pass."""
    return judged_jobs.agg(*(F.count_if(F.col("reject") == r).alias(r) for r in ("role", "geography", "exclusion", "salary", "freshness")))


def worth_details(rows: DataFrame, roles: list[str], now: int, days: int) -> DataFrame:
    """The 18 search rows whose details are fetched: first of each id, fresh, in scope; best title fit, then newest."""
    first = rows.groupBy("id").agg(F.min_by(F.struct("pos", "title", "posted_at"), "pos").alias("r")).select("id", "r.*")
    first = first.withColumn("fit", role_fit(F.col("title"), roles)["score"])
    kept = first.where((F.coalesce((F.lit(now) - F.col("posted_at")) / F.lit(86400.0), F.lit(999.0)) <= days + 0.25) & (F.col("fit") >= LEAST_ROLE))
    return kept.orderBy(F.desc("fit"), F.desc("posted_at"), "pos").limit(MOST_DETAILS)


def with_details(rows: DataFrame, details: DataFrame) -> DataFrame:
    """Rows left-joined to their details by id; a detail's fields override where they are present."""
    named = details.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("jd", "url", "location", "country", "deadline")))
    out = rows.join(named, F.col("id") == F.col("_id"), "left")
    fresh = {c: F.coalesce(F.nullif(f"_{c}", F.lit("")), F.col(c)) for c in ("jd", "url", "location", "country", "deadline")}
    return out.withColumns(fresh).drop("_id", *(f"_{c}" for c in fresh))


def local_board(rows: DataFrame, details: DataFrame, roles: list[str], now: int, days: int) -> DataFrame:
    """rows: id and a posting's columns. The rows whose details are worth fetching, with what their details (id, pos of the row, jd, url, location, country, deadline) say.

    The chosen rows are MOST_DETAILS at most, so both joins have a small side whose size Spark knows or finds out.
    """
    picked = worth_details(rows, roles, now, days).select("id", "pos")
    full = rows.join(picked, ["id", "pos"])
    own = details.join(picked, ["id", "pos"]).drop("pos")
    missing = [c for c in ("url", "deadline") if c not in full.columns]
    full = full.withColumns({c: F.lit(None).cast(details.schema[c].dataType) for c in missing})
    return with_details(full, own).drop("id", *missing)
