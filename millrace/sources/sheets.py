"""Landed rows of forms: what becomes of each row, and the rows that go into the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import parse_date, portal_slug, registrable, url_host

_WEB = r"^https?://[^\s/?#]+\.[^\s/?#]+"


def _bare(name: str) -> Column:
    return F.trim(F.coalesce(F.col(name), F.lit("")))


def _first(keys: list[Column], order: Column) -> Column:
    """Whether a row is the first of its keys, of rows that could go in."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(order)) == 1


def applications(rows: DataFrame, users: DataFrame, known: DataFrame, today: str) -> DataFrame:
    """Rows of the applications' form (row, company, job_url, title, applied_on, user_name) with outcome and the values to store.

    An unknown user's rows are held back, as they can be mended and come again; rows without a
    company or with a bad address are dropped; an application that is known, or that an earlier row
    has, is a duplicate. users: (name, user_id); known: (user_id, job_url). A bad date is today's.
    """
    named = users.select(F.lower(F.trim("name")).alias("user"), "user_id")
    there = known.select("user_id", F.trim("job_url").alias("job_url")).distinct().withColumn("there", F.lit(True))
    r = rows.select("row", _bare("company").alias("company"), _bare("job_url").alias("job_url"), F.nullif(_bare("title"), F.lit("")).alias("title"), F.coalesce(parse_date(F.col("applied_on")), F.lit(today).cast("timestamp")).cast("date").alias("applied_on"), F.lower(_bare("user_name")).alias("user"))
    r = r.join(F.broadcast(named), "user", "left").join(there, ["user_id", "job_url"], "left")  # users are a few hand-kept names
    fits = F.when(F.col("user_id").isNull(), "held").when(F.col("company") == "", "invalid").when(~F.regexp_like("job_url", F.lit(_WEB)), "invalid").when(F.col("there"), "duplicate").otherwise("new")
    r = r.withColumn("fits", fits)
    outcome = F.when((F.col("fits") == "new") & ~_first([F.col("fits"), F.col("user_id"), F.col("job_url")], F.col("row")), "duplicate").otherwise(F.col("fits"))
    return r.select("row", outcome.alias("outcome"), "user_id", "company", "job_url", "title", "applied_on", registrable(url_host(F.col("job_url"))).alias("expected_domain"), portal_slug(F.col("job_url")).alias("portal"))


def prospects(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the prospects' form (row, company, job_url, career_page, domain, xml_url, curl) with outcome and how the company is to be watched.

    The first of these speaks: a curl of its listing, a feed's address, a posting's or career page's
    on a known portal, any career page. A company is one however it is written; the last row of it
    holds, as a correction.
    """
    there = known.select(F.lower(F.trim("company")).alias("name")).distinct().withColumn("there", F.lit(True))
    portal = F.coalesce(portal_slug(_bare("job_url")), portal_slug(_bare("career_page")))
    ats = F.when(_bare("curl") != "", "custom").when(F.regexp_like(_bare("xml_url"), F.lit(_WEB)), "sitemap").when(portal.isNotNull(), portal["platform"]).when(F.regexp_like(_bare("career_page"), F.lit(_WEB)), "unknown")
    slug = F.when(_bare("curl") != "", _bare("curl")).when(F.regexp_like(_bare("xml_url"), F.lit(_WEB)), _bare("xml_url")).otherwise(portal["slug"])
    domain = F.coalesce(F.nullif(F.lower(_bare("domain")), F.lit("")), F.nullif(registrable(url_host(_bare("career_page"))), F.lit("")))
    r = rows.select("row", _bare("company").alias("company"), ats.alias("ats"), slug.alias("slug"), domain.alias("domain"), F.lower(_bare("company")).alias("name")).join(there, "name", "left")
    last = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("row"))) == 1
    outcome = F.when(F.col("company") == "", "invalid").when(F.col("ats").isNull(), "incomplete").when(~last, "replaced").when(F.col("there"), "update").otherwise("new")
    return r.select("row", outcome.alias("outcome"), "company", "ats", "slug", "domain")
