"""What the pages and digests show: filtered and ordered lists of bounded length, and kinds of titles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in titles of people who hire, surely and possibly, and of people who are not to be written to. An owner's own go in as parameters.
SURE = ("recruit", "talent acquisition", "human resources", "staffing")
PERHAPS = ("people", "hiring", "talent")
EXCLUDED = ("chief", "founder", "president", "board of")


def _any_of(text: Column, words: Sequence[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def hiring_title(title: Column, sure: Sequence[str] = SURE, perhaps: Sequence[str] = PERHAPS) -> Column:
    """auto, manual_review, or null for titles of people who don't hire."""
    t = F.trim(F.lower(F.coalesce(title, F.lit(""))))
    return F.when(_any_of(t, sure), "auto").when(_any_of(t, perhaps), "manual_review")


def excluded_title(title: Column, excluded: Sequence[str] = EXCLUDED) -> Column:
    return _any_of(F.lower(F.coalesce(title, F.lit(""))), excluded)


def listing(jobs: DataFrame, statuses: Sequence[str], since: str, until: str, search: str = "", companies: Sequence[str] = (), platforms: Sequence[str] = (), limit: int = 2000) -> DataFrame:
    """Jobs of some statuses first seen between two days, of those companies and platforms if any are given, whose title or company holds the search; the newest."""
    rows = jobs.where(F.col("status").isin(*statuses) & F.col("first_seen").between(F.lit(since).cast("date"), F.lit(until).cast("date")))
    if search:
        part = F.lit(search.lower())
        rows = rows.where(F.contains(F.lower("title"), part) | F.contains(F.lower("company"), part))
    if companies:
        rows = rows.where(F.col("company").isin(*companies))
    if platforms:
        rows = rows.where(F.col("ats").isin(*platforms))
    return rows.orderBy(F.desc("first_seen"), F.desc("id")).limit(limit)


def digest(jobs: DataFrame) -> DataFrame:
    """New jobs by company, the best scores first."""
    return jobs.where("status = 'new'").orderBy("company", F.desc("score"), "id")


def missing(jobs: DataFrame, days: int) -> DataFrame:
    """Jobs that are not settled and have been missing for so many days, the longest first."""
    rows = jobs.where(~F.col("status").isin("filled", "expired", "dismissed", "applied") & (F.col("missing_days") >= days))
    return rows.orderBy(F.desc("missing_days"), "id")


def top_occupations(breakdown: DataFrame, fein: str, k: int = 20) -> DataFrame:
    """An employer's occupations with the most certified filings."""
    return breakdown.where(F.col("fein") == fein).orderBy(F.desc("certified"), "soc").limit(k)


def pending(prospects: DataFrame, limit: int | None = None) -> DataFrame:
    """Prospects to look at next: the highest priority, then the earliest."""
    rows = prospects.where("status = 'pending'").orderBy(F.desc("priority"), "created_at", "company")
    return rows if limit is None else rows.limit(limit)
