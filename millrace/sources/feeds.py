"""Sources that answer in XML or HTML: feeds of postings, sitemaps and pages of links, to the common posting columns.

Responses are (company, url, body), a landed page in each row; a sitemap's parts are landed as rows
of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import absolute_url, clean_html, collapse, parse_date, url_id, url_path
from .adapters import COLUMNS, adapt
from .infer import format_of

#: Words before the values of labelled fields, fixed values, the longer first.
LABELS = ("Internal Posting Location", "Additional Locations", "Employment Type", "Expected Travel", "Country/Area", "country/area", "state/province", "State/Province", "Career Status", "Job Category", "Work Area", "Country", "Region", "City", "city")


def _tag(item: Column, *names: str) -> Column:
    """The text of the first of some tags that says anything; else null."""
    def one(name: str) -> Column:
        inner = F.regexp_extract(item, rf"(?is)<{name}(?:\s[^>]*)?>(.*?)</{name}\s*>", 1)
        return F.nullif(clean_html(F.regexp_replace(inner, r"(?s)^\s*<!\[CDATA\[(.*)\]\]>\s*$", "$1")), F.lit(""))

    return F.coalesce(*[one(n) for n in names])


def place(value: Column) -> Column:
    """A feed's place: without an office code in brackets at the end, and with commas where a city, a state and a country stand together."""
    x = F.trim(F.regexp_replace(value, r"\s*\([A-Z][A-Z0-9]{1,15}\)\s*$", ""))
    x = F.regexp_replace(x, r"([a-z])([A-Z]{2})([A-Z]{3})$", "$1, $2, $3")
    return F.regexp_replace(x, r"([a-z])([A-Z]{3})$", "$1, $2")


def _bare(value: Column) -> Column:
    return F.regexp_replace(value, rf"^(?:{'|'.join(LABELS)})", "")


def _shaped(rows: DataFrame, ats: str, **made: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    kinds = {"posted_at": F.lit(None).cast("timestamp")}
    return rows.select(*[made.get(c, F.lit(ats) if c == "ats" else kinds.get(c, none)).alias(c) for c in COLUMNS])


def feed(responses: DataFrame, ats: str = "sitemap") -> DataFrame:
    """Postings of XML feeds, those with a title and an id, each id of a company once."""
    items = responses.select("company", "url", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)<(job|item|entry)(?:\s[^>]*)?>(.*?)</\1\s*>"), 2)).alias("item"))
    x = F.col("item")
    id_ = _tag(x, "jobid", "ReqId", "id", "identifier", "guid")
    own = F.coalesce(_tag(x, "url", "link"), F.nullif(F.regexp_extract(x, r"""(?is)<link[^>]*href=["']([^"']+)""", 1), F.lit("")), _tag(x, "guid"))
    site = F.regexp_extract("url", r"^(https?://[^/?#]*successfactors[^/?#]*)", 1)
    customer = F.regexp_extract("url", r"[?&]company=([^&#]+)", 1)
    built = F.when((site != "") & (customer != ""), F.concat(site, F.lit("/career?company="), customer, F.lit("&career_job_req_id="), id_))
    parts = lambda *fields: F.nullif(F.concat_ws(", ", *[_bare(_tag(x, f)) for f in fields]), F.lit(""))
    where = F.coalesce(place(_tag(x, "location", "locations")), parts("mfield3", "mfield1"), parts("filter8", "filter7"), parts("city", "state", "country"))
    posted = parse_date(_tag(x, "published", "Posted-Date", "pubDate", "updated"))
    text = clean_html(_tag(x, "description", "Job-Description", "content", "summary"))
    out = _shaped(items, ats, company=F.col("company"), title=_tag(x, "title", "JobTitle", "name"), job_url=F.coalesce(own, built), location=where, posted_at=posted, job_id=id_, description=text)
    return out.where("title is not null and job_id is not null").dropDuplicates(["company", "job_id"])


def sitemap(responses: DataFrame, pattern: str = "", locale: str = "") -> DataFrame:
    """Postings of sitemaps: addresses that fit a pattern and, where they name a language, the one asked for; their last change stands for the day, the path's last words for the title."""
    entries = responses.select("company", F.explode(F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)<url(?:\s[^>]*)?>(.*?)</url\s*>"), 1)).alias("e"))
    rows = entries.select("company", _tag(F.col("e"), "loc").alias("loc"), _tag(F.col("e"), "lastmod").alias("day")).where("loc is not null")
    if pattern:
        rows = rows.where(F.regexp_like("loc", F.lit(pattern)))
    if locale:
        named = F.regexp_extract("loc", r"(?i)^https?://[^/]+/([a-z]{2})(?:[-_][a-z]{2})?/", 1)
        rows = rows.where((named == "") | (F.lower(named) == locale.lower()))
    path = F.regexp_replace(url_path(F.col("loc")), "/+$", "")
    last = F.regexp_extract(path, "([^/]*)$", 1)
    words = F.when(F.regexp_like(last, F.lit(r"^[\d-]*$")), F.regexp_extract(path, "([^/]*)/[^/]*$", 1)).otherwise(last)
    title = F.nullif(collapse(F.regexp_replace(F.regexp_replace(words, r"^\d+-|-\d+$", ""), "[-_]+", " ")), F.lit(""))
    id_ = F.coalesce(F.nullif(url_id(F.col("loc")), F.lit("")), F.nullif(last, F.lit("")))
    return _shaped(rows, "sitemap", company=F.col("company"), title=title, job_url=F.col("loc"), posted_at=parse_date(F.col("day")), job_id=id_).dropDuplicates(["company", "job_url"])


def links(responses: DataFrame, ats: str, pattern: str = r"/jobs?/|/job-|/careers?/|requisition|FolderDetail") -> DataFrame:
    """Postings of pages: links whose address fits a pattern and has an id, resolved against the page's, with their text as the title."""
    anchors = F.regexp_extract_all(F.coalesce("body", F.lit("")), F.lit(r"(?is)<a\b[^>]*\bhref\s*=\s*[\"'][^\"']+[\"'][^>]*>.*?</a\s*>"), F.lit(0))
    rows = responses.select("company", "url", F.explode(anchors).alias("a"))
    href = clean_html(F.regexp_extract("a", r"(?is)\bhref\s*=\s*[\"']([^\"']+)", 1))
    rows = rows.select("company", absolute_url(href, F.col("url")).alias("at"), F.nullif(clean_html(F.col("a")), F.lit("")).alias("title")).where(F.regexp_like("at", F.lit(pattern)))
    out = _shaped(rows, ats, company=F.col("company"), title=F.col("title"), job_url=F.col("at"), job_id=F.nullif(url_id(F.col("at")), F.lit("")))
    return out.where("job_id is not null and title is not null").dropDuplicates(["company", "job_id"])


#: Sources that answer in pages or feeds as well as in JSON.
MIXED: Sequence[str] = ("icims", "jobvite", "avature", "talentbrew", "successfactors")


def adapt_any(responses: DataFrame, source: str, as_of: str) -> DataFrame:
    """Postings of a source from responses (company, url, body) of any format."""
    kind = format_of(F.col("body"))
    rows = responses.withColumn("kind", kind)
    return adapt(rows.where("kind = 'json'"), source, as_of).unionByName(feed(rows.where("kind = 'xml'"), source)).unionByName(links(rows.where("kind = 'html'"), source))
