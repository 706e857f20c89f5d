"""Employer rules: profile decision, distance steps, corporate domains, titles and links of pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import clean_html
from lodestone.operators import ranges
from lodestone.operators.records import profession
from lodestone.sources.boards import absolute

# Industries that are sought, company types that are not, and free-mail hosts.
TARGET_INDUSTRY = (
    "software|computerprogrammering|informationsteknolog|it-konsulent|it konsulent|saas",
    "bank|finans|betaling|payment|fintech|forsikring|insurance",
    "telekommunikation|telecom|kommunikationsteknolog",
    "energi|elektricitet|gasforsyning|forsyning|utility|utilities",
    "logistik|transport|lufttransport|luftfart|maritim|søtransport|skibsfart",
    "medicinsk|medtech|healthtech|sundhedsteknolog",
    "farmaceut|lægemiddel|pharma",
    "rådgivning.*informationsteknolog|informationsteknolog.*rådgivning|technology consulting|it consulting",
)
EXCLUDED_TYPE = (
    "forskning.*bioteknolog|bioteknolog.*forskning|research.*biotech|drug discovery",
    "arkitekt|architecture",
    "byggeri|bygge-? og anlæg|anlægsvirksomhed|civil engineering|construction|ejendomsudvikling|property development",
    "rekruttering|vikarbureau|recruitment|staffing agency",
    "reklamebureau|marketingbureau|creative agency|advertising agency",
)
FREE_MAIL = r"^(gmail|googlemail|hotmail|outlook|live|icloud|me|yahoo|protonmail|proton)\."
RADIUS_STEPS = (10, 20, 30, 40)
# Codes of municipalities, by the radius (km) from which each belongs to the search; each step also has those before it.
MUNICIPALITIES = {
    10: ("0230", "0223", "0173", "0157"),
    20: ("0159", "0190", "0201", "0210", "0151", "0163"),
    30: ("0101", "0147", "0219", "0240", "0217", "0175", "0165", "0169"),
    40: ("0167", "0153", "0187", "0183", "0185", "0270", "0250"),
    50: ("0155", "0253", "0269", "0265"),
}
#: A radius in metres, beyond the last step, from which on all are alike: it keeps the levels of the interval join few.
WIDEST = (1 << 16) - 1


def decision(branch: Column, employees: Column) -> Column:
    text = F.lower(F.coalesce(branch, F.lit("")))
    target = text.rlike("|".join(TARGET_INDUSTRY))
    return (
        F.when(text == "", "Company industry is unknown").when(text.rlike("|".join(EXCLUDED_TYPE)), "Company type excluded")
        .when(employees.isNull(), "Company size is unknown").when((employees >= 100) | ((employees >= 20) & target), "pass")
        .otherwise("Company does not meet employer profile")
    )


def radius_step(km: Column) -> Column:
    chain = None
    for step in RADIUS_STEPS:
        chain = F.when(km <= step, step) if chain is None else chain.when(km <= step, step)
    return chain.otherwise(50)


def municipalities(spark: SparkSession) -> DataFrame:
    """code, low, high: the radii, in whole metres, whose search takes in a municipality."""
    rows = [(code, 0 if step == 10 else (step - 10) * 1000 + 1, WIDEST) for step, codes in MUNICIPALITIES.items() for code in codes]
    return spark.createDataFrame(rows, "code string, low long, high long")


def searched_municipalities(radii: DataFrame, km: str) -> DataFrame:
    """Rows with a radius, one for each municipality (code) that it takes in. A part of a metre counts as a whole one; a radius below zero is the smallest."""
    metres = F.ceil(F.least(F.lit(float(WIDEST)), F.greatest(F.lit(0.0), F.col(km) * 1000))).cast("long")
    metres = radii.withColumn("_metres", F.when(F.col(km).isNull(), 0).otherwise(metres))
    return ranges.interval_join(metres, "_metres", municipalities(radii.sparkSession), "low", "high").drop("_metres", "low", "high")


def corporate_domain(emails: Column) -> Column:
    """The first host with a dot that is not a free-mail host."""
    hosts = F.transform(emails, lambda e: F.regexp_replace(F.lower(F.regexp_extract(e, r"@([^\s>]+)$", 1)), r"[),.;]+$", ""))
    fit = F.filter(hosts, lambda h: h.contains(".") & ~h.rlike(FREE_MAIL))
    return F.try_element_at(fit, F.lit(1))


def page_title(html: Column) -> Column:
    """The first heading, else the title without the site's name."""
    heading = clean_html(F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1))
    title = F.regexp_replace(clean_html(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title>", 1)), r"\s+[|–—-]\s+[^|–—-]+$", "")
    return F.coalesce(F.nullif(heading, F.lit("")), F.trim(title))


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, at, href, label of each link, in order."""
    tags = F.regexp_extract_all(F.col(html), F.lit(r"""(?is)<a\b[^>]*href=["'][^"']+["'][^>]*>.*?</a>"""), 0)
    out = pages.select(key, F.posexplode(tags).alias("at", "tag"))
    href = F.regexp_extract("tag", r"""(?is)href=["']([^"']+)["']""", 1)
    label = clean_html(F.regexp_extract("tag", r"(?is)^<a\b[^>]*>(.*?)</a>", 1))
    return out.select(key, "at", href.alias("href"), label.alias("label"))


# What a link to an employer's openings says, and how many links are followed.
CAREER = r"(careers?|jobs?|karriere|ledige[- ]?stillinger|vacancies|open[- ]?positions|join[- ]?us|work[- ]?with[- ]?us)"
MOST_CAREER_LINKS, MOST_JOB_LINKS, LEAST_DESCRIPTION, MOST_DESCRIPTION = 8, 20, 500, 30_000


def site_links(pages: DataFrame, key: str, base: str, html: str, keep: Callable[[Column, Column], Column], most: int) -> DataFrame:
    """key, at, url, label: of the absolute links that ``keep`` (label, url) takes, each url of a page once, the first ``most``."""
    links = page_links(pages.select(key, html), key, html).join(pages.select(key, F.col(base).alias("_base")), key)
    links = links.select(key, "at", absolute(F.col("href"), F.col("_base")).alias("url"), "label").where(F.col("url").isNotNull() & keep(F.col("label"), F.col("url")))
    first = links.groupBy(key, "url").agg(F.min("at").alias("at"), F.min_by("label", "at").alias("label"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("at"))
    return first.withColumn("_n", place).where(F.col("_n") <= most).select(key, "at", "url", "label")


def career_links(pages: DataFrame, key: str, base: str, html: str) -> DataFrame:
    return site_links(pages, key, base, html, lambda label, url: F.concat_ws(" ", label, url).rlike("(?i)" + CAREER), MOST_CAREER_LINKS)


def job_links(pages: DataFrame, key: str, base: str, html: str) -> DataFrame:
    """Links whose label or address names a profession that is sought."""
    spoken = lambda url: F.regexp_replace(F.coalesce(F.try_url_decode(url), url), "[-_/]+", " ")
    return site_links(pages, key, base, html, lambda label, url: profession(label) | profession(spoken(url)), MOST_JOB_LINKS)


def full_description(html: Column) -> Column:
    """A page's text where it is long enough for a job description, cut at its greatest length; else ''."""
    text = clean_html(html)
    return F.when(F.length(text) >= LEAST_DESCRIPTION, F.left(text, F.lit(MOST_DESCRIPTION))).otherwise("")
