"""Relevance of postings: titles, locations, freshness, score and the outcome of a detail check.

Lists are parameters with neutral defaults. Dimension lists are short and become literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import collapse, let, ngrams, normalize

TITLES = ("engineer", "analyst", "developer", "scientist")
SENIORITY = ("senior", "staff", "principal", "lead")
SKILLS = ("python", "spark", "sql", "java", "aws")

#: Fixed values of the location rules.
US_WORDS = ("usa", "us", "united states", "united states of america", "u s a", "u s", "america")
STATES = {
    "al": "alabama", "ak": "alaska", "az": "arizona", "ar": "arkansas", "ca": "california", "co": "colorado", "ct": "connecticut", "de": "delaware", "dc": "district of columbia", "fl": "florida",
    "ga": "georgia", "hi": "hawaii", "id": "idaho", "il": "illinois", "in": "indiana", "ia": "iowa", "ks": "kansas", "ky": "kentucky", "la": "louisiana", "me": "maine", "md": "maryland",
    "ma": "massachusetts", "mi": "michigan", "mn": "minnesota", "ms": "mississippi", "mo": "missouri", "mt": "montana", "ne": "nebraska", "nv": "nevada", "nh": "new hampshire", "nj": "new jersey",
    "nm": "new mexico", "ny": "new york", "nc": "north carolina", "nd": "north dakota", "oh": "ohio", "ok": "oklahoma", "or": "oregon", "pa": "pennsylvania", "ri": "rhode island", "sc": "south carolina",
    "sd": "south dakota", "tn": "tennessee", "tx": "texas", "ut": "utah", "vt": "vermont", "va": "virginia", "wa": "washington", "wv": "west virginia", "wi": "wisconsin", "wy": "wyoming",
}
#: Other countries: alpha-3, alpha-2, name; a short public list.
COUNTRIES = [
    ("aus", "au", "australia"), ("aut", "at", "austria"), ("bel", "be", "belgium"), ("bra", "br", "brazil"), ("can", "ca", "canada"), ("che", "ch", "switzerland"), ("chn", "cn", "china"), ("deu", "de", "germany"),
    ("dnk", "dk", "denmark"), ("esp", "es", "spain"), ("fin", "fi", "finland"), ("fra", "fr", "france"), ("gbr", "gb", "united kingdom"), ("ind", "in", "india"), ("irl", "ie", "ireland"), ("isr", "il", "israel"),
    ("ita", "it", "italy"), ("jor", "jo", "jordan"), ("jpn", "jp", "japan"), ("kor", "kr", "south korea"), ("mex", "mx", "mexico"), ("nld", "nl", "netherlands"), ("nor", "no", "norway"), ("phl", "ph", "philippines"),
    ("pol", "pl", "poland"), ("prt", "pt", "portugal"), ("rou", "ro", "romania"), ("sgp", "sg", "singapore"), ("swe", "se", "sweden"), ("twn", "tw", "taiwan"), ("ukr", "ua", "ukraine"), ("zaf", "za", "south africa"),
]
ALIASES = ("uk", "u k", "england uk", "korea", "holland", "emea", "apac", "latam")
NATIONS = ("scotland", "wales", "northern ireland")
#: Cities abroad under their former and present names, fixed values.
RENAMED = ("bangalore", "bengaluru", "bombay", "mumbai", "calcutta", "kolkata", "madras", "chennai", "gurgaon", "gurugram", "noida", "trivandrum")
#: A few large cities abroad and at home, for use without a gazetteer.
ABROAD = ("hyderabad", "pune", "delhi", "london", "paris", "berlin", "toronto", "dublin", "tokyo", "madrid", "warsaw")
US_CITIES = ("san francisco", "austin", "seattle", "boston", "chicago", "new york city", "atlanta", "denver", "dallas", "houston", "los angeles", "san jose", "menlo park", "burlington", "mountain view")


def normalize_location(location: Column) -> Column:
    """Any way of writing a place as lower-case words."""
    x = F.regexp_replace(location, r"\b([A-Za-z]{3})\.", "$1 ")
    x = F.regexp_replace(x, r"\b([A-Za-z]{2,3})-([A-Za-z]{2})-", "$1 $2 ")
    x = F.regexp_replace(F.regexp_replace(x, r"[()]", " "), r"\b\d+\b", " ")
    return collapse(F.lower(F.regexp_replace(x, r"[,;|/\-–—_.]+", " ")))


def signal(location: Column, countries: Sequence[tuple[str, str, str]] = tuple(COUNTRIES)) -> Column:
    """Whether a place is in the US, by the first sign that speaks: nothing written, US words, upper-case country codes, states (a code not if a country follows it), names of countries (alpha-3, alpha-2, name), nations and renamed cities; else null."""
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    codes = lambda n: F.transform(F.regexp_extract_all(F.coalesce(location, F.lit("")), F.lit(rf"(?<![A-Za-z])([A-Z]{{{n}}})(?![A-Za-z])"), 1), F.lower)
    foreign3, foreign2 = [c[0] for c in countries], [c[1] for c in countries if c[1] not in STATES]
    abroad = [*(c[2] for c in countries), *ALIASES]

    def told(tokens: Column, phrases: Column) -> Column:
        has = lambda xs: F.arrays_overlap(phrases, lit(xs))
        first3 = F.get(F.filter(F.array_intersect(tokens, codes(3)), lambda t: (t == "usa") | F.array_contains(lit(foreign3), t)), 0)
        # a state code counts unless some country is named after its first place
        after = lambda t: ngrams(F.slice(tokens, F.array_position(tokens, t).cast("int") + 1, F.greatest(F.lit(0), F.size(tokens) - F.array_position(tokens, t).cast("int"))))
        state = F.exists(F.array_intersect(tokens, lit(STATES)), lambda t: ~F.arrays_overlap(F.concat(after(t), lit(["-"])), lit(abroad)))
        return (
            F.when(F.size(tokens) == 0, True)
            .when(has(US_WORDS), True)
            .when(first3.isNotNull(), first3 == "usa")
            .when(F.arrays_overlap(codes(2), lit(foreign2)), False)
            .when(has(tuple(STATES.values())), True)
            .when(state, True)
            .when(has(abroad), False)
            .when(F.array_contains(phrases, "england") & ~F.array_contains(phrases, "new england"), False)
            .when(has(NATIONS), False)
            .when(has(RENAMED), False)
        )

    words = F.filter(F.split(normalize_location(F.coalesce(location, F.lit(""))), " "), lambda t: t != "")
    return let(words, lambda tokens: let(ngrams(tokens), lambda phrases: told(tokens, phrases)))


def is_us(location: Column) -> Column:
    """Whether a place is in the US: its own signs, then a few well-known cities, else true. With a gazetteer, see places.located."""
    phrases = ngrams(F.filter(F.split(normalize_location(F.coalesce(location, F.lit(""))), " "), lambda t: t != ""))
    has = lambda xs: F.arrays_overlap(phrases, F.array(*[F.lit(x) for x in xs]))
    return F.coalesce(signal(location), ~has(ABROAD) | has(US_CITIES))


def matches_title(title: Column, keywords: Sequence[str] = TITLES) -> Column:
    x = normalize(F.coalesce(title, F.lit("")))
    return F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(x, k))


def age_days(posted: Column, as_of: str) -> Column:
    """Whole days between, rounded down."""
    return F.floor((F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(posted.cast("timestamp"))) / 86400)


def is_fresh(posted: Column, as_of: str, days: int = 3, unknown: bool = True) -> Column:
    """At most so many days old; without a date `unknown`, which is false at first listings."""
    return F.coalesce(age_days(posted, as_of) <= days, F.lit(unknown))


def score(title: Column, text: Column, posted: Column, as_of: str, seniority: Sequence[str] = SENIORITY, skills: Sequence[str] = SKILLS) -> Column:
    """10, 5 for seniority in the title, 2 for each skill in title or text, 5, 3 or 1 for postings of today, yesterday or up to three days."""
    t = normalize(F.coalesce(title, F.lit("")))
    both = F.concat(t, F.lit(" "), normalize(F.coalesce(text, F.lit(""))))
    days = age_days(posted, as_of)
    senior = F.exists(F.array(*map(F.lit, seniority)), lambda k: F.contains(t, k))
    n = F.size(F.filter(F.array(*map(F.lit, skills)), lambda k: F.contains(both, k)))
    return (10 + F.when(senior, 5).otherwise(0) + 2 * n + F.when(days == 0, 5).when(days == 1, 3).when(days <= 3, 1).otherwise(0)).cast("bigint")


def relevant(postings: DataFrame, as_of: str, keywords: Sequence[str] = TITLES) -> DataFrame:
    """Postings (company, title, location, description, posted_at, job_id) whose title and place fit, with their score."""
    rows = postings.where(matches_title(F.col("title"), keywords) & is_us(F.col("location")))
    return rows.withColumn("score", score(F.col("title"), F.col("description"), F.col("posted_at"), as_of))


def detail_outcome(postings: DataFrame, as_of: str, keywords: Sequence[str] = TITLES, undated: Sequence[str] = ("greenhouse",)) -> DataFrame:
    """What becomes of a posting once its detail is known: country, title, place, then freshness; a hash that is known already makes it a duplicate."""
    foreign = F.coalesce(F.length("country") == 2, F.lit(False)) & (F.upper("country") != "US")
    out = (
        F.when(foreign, "filtered_country")
        .when(~matches_title(F.col("title"), keywords), "filtered_title")
        .when(~is_us(F.col("location")), "filtered_location")
        .when(~F.col("ats").isin(*undated) & ~is_fresh(F.col("posted_at"), as_of), "stale")
        .when(F.col("known"), "duplicate")
        .otherwise("new")
    )
    return postings.select("job_id", out.alias("outcome"))
