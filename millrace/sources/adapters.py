"""One projection for each listing source: landed JSON text to the common posting columns.

A source is where its rows are and which paths give each column, the first that is not null; what
is special about it is an expression. Rows come from a column of JSON text, a response in each.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_html, collapse, parse_date

COLUMNS = ("company", "title", "job_url", "location", "posted_at", "job_id", "description", "ats", "country_code")


def _at(row: Column, *paths: str) -> Column:
    return F.coalesce(*[F.nullif(F.get_json_object(row, f"$.{p}"), F.lit("")) for p in paths]) if paths else F.lit(None).cast("string")


def _relative(value: Column, as_of: str) -> Column:
    """Dates written as Posted Today, Yesterday, N Days Ago or 30+ Days Ago; else as dates."""
    day = F.lit(as_of).cast("timestamp")
    n = F.regexp_extract(F.lower(value), r"(\d+)\+?\s*days?", 1).try_cast("int")
    return F.when(value.ilike("%today%"), day).when(value.ilike("%yesterday%"), F.timestamp_add("DAY", F.lit(-1), day)).when(n.isNotNull(), F.timestamp_add("DAY", -n, day)).otherwise(parse_date(value))


def _joined(*parts: Column) -> Column:
    return F.nullif(F.concat_ws(", ", *parts), F.lit(""))


@dataclass(frozen=True)
class Source:
    """rows: path of the array of records; the others: paths in a record, or an expression of (record, as_of)."""

    rows: str
    title: tuple[str, ...]
    url: tuple[str, ...]
    id: tuple[str, ...]
    location: tuple[str, ...] = ()
    posted: tuple[str, ...] = ()
    description: tuple[str, ...] = ()
    country: tuple[str, ...] = ()
    html: bool = False
    special: dict[str, Callable[[Column, str], Column]] = field(default_factory=dict)
    filter_mode: str = "full"
    needs_detail: bool = False


SOURCES: dict[str, Source] = {
    "greenhouse": Source("jobs", ("title",), ("absolute_url",), ("id",), ("location.name",), ("first_published", "updated_at"), ("content",), html=True),
    "lever": Source("", ("text",), ("hostedUrl",), ("id",), ("categories.location", "categories.allLocations[0]"), ("createdAt",), ("descriptionPlain",)),
    "ashby": Source("jobs", ("title",), ("jobUrl",), ("id",), ("location", "locationName"), ("publishedAt",), ("descriptionHtml",), html=True),
    "smartrecruiters": Source(
        "content", ("name",), ("ref",), ("id",), posted=("releasedDate",), country=("location.country",), needs_detail=True,
        special={"location": lambda r, _: F.when(_at(r, "location.remote") == "true", "Remote").otherwise(F.coalesce(_at(r, "location.fullLocation"), _joined(_at(r, "location.city"), _at(r, "location.region"))))},
    ),
    "workday": Source("jobPostings", ("title",), ("externalPath",), ("bulletFields[0]",), ("locationsText",), needs_detail=True, special={"posted_at": lambda r, d: _relative(_at(r, "postedOn"), d)}),
    "oracle_hcm": Source("items[0].requisitionList", ("Title",), (), ("Id", "ExternalJobId", "RequisitionId"), ("PrimaryLocation",), ("PostedDate",), ("ShortDescriptionStr",), ("PrimaryLocationCountry",), needs_detail=True),
    "jibe": Source(
        "jobs", ("data.title",), (), ("data.req_id",), posted=("data.posted_date",), description=("data.description",), html=True,
        special={"job_url": lambda r, _: F.replace(_at(r, "data.apply_url"), F.lit("/login"), F.lit("/job")), "location": lambda r, _: F.coalesce(_at(r, "data.full_location"), _joined(_at(r, "data.city"), _at(r, "data.state"), _at(r, "data.country")))},
    ),
    "eightfold": Source(
        "positions", ("name",), ("canonicalPositionUrl", "positionUrl"), ("atsJobId", "displayJobId", "id"), posted=("t_create", "postedTs"), needs_detail=True,
        special={"location": lambda r, _: F.coalesce(_at(r, "standardizedLocations[0]"), F.nullif(F.trim(F.regexp_replace(_at(r, "location"), r"\s*\([A-Z]+\)", "")), F.lit("")), F.lit("Remote")), "country_code": lambda r, _: F.nullif(F.regexp_extract(_at(r, "standardizedLocations[0]"), r",\s*([A-Z]{2})$", 1), F.lit(""))},
    ),
    "adp": Source(
        "jobRequisitions", ("publishedJobTitle", "jobTitle"), (), ("reqId",), posted=("postingDate",), country=("requisitionLocations[0].address.country",),
        special={"location": lambda r, _: _joined(_at(r, "requisitionLocations[0].address.cityName"), _at(r, "requisitionLocations[0].address.state"), _at(r, "requisitionLocations[0].address.country")), "description": lambda r, _: F.concat_ws(" ", _at(r, "jobDescription"), _at(r, "jobQualifications"))},
    ),
    "icims": Source("jobs", ("title", "jobtitle"), ("url",), ("id",), ("location", "joblocation.value"), ("posted", "updateddate"), ("description",), html=True, needs_detail=True),
    "jobvite": Source("jobs", ("title",), ("detailUrl", "applyUrl"), ("eId", "id"), ("location",), ("date",), ("description",), html=True),
    "avature": Source("jobs", ("title",), ("url",), ("id",), ("location",), ("posted",), needs_detail=True),
    "phenom": Source("refineSearch.data.jobs", ("title",), ("applyUrl",), ("jobId", "reqId"), ("cityStateCountry", "location"), ("postedDate", "dateCreated"), ("descriptionTeaser",), ("country",), needs_detail=True),
    "talentbrew": Source("jobs", ("title",), ("url",), ("id",), ("location",), ("date",), needs_detail=True),
    "successfactors": Source("jobs", ("title",), ("link", "url"), ("id", "jobReqId"), ("location",), ("pubDate", "date"), ("description",), html=True),
    "google": Source("jobs", ("title",), ("apply_url", "url"), ("id",), ("locations[0].display", "location"), ("publish_date",), ("description",), ("locations[0].country_code",), html=True),
    "paycom": Source("jobs", ("jobTitle", "title"), ("url",), ("jobId", "id"), ("locations", "location"), ("postedOn",), ("description",), html=True),
    "custom": Source("jobs", ("title", "name"), ("url", "link"), ("id",), ("location",), ("date", "posted"), ("description",), html=True),
    "taleo": Source("requisitionList", (), (), ("jobId", "contestNo"), special={
        "title": lambda r, _: _at(r, "column[0]"), "location": lambda r, _: collapse(F.regexp_replace(_at(r, "column[1]"), r'[\[\]"]', " ")), "posted_at": lambda r, d: _relative(_at(r, "column[2]"), d),
    }),
}


def adapt(responses: DataFrame, source: str, as_of: str, company: str = "company", body: str = "body") -> DataFrame:
    """Postings in COLUMNS from responses (company, body), with the rows that have an address or an id."""
    s = SOURCES[source]
    path = f"$.{s.rows}" if s.rows else "$"
    records = F.from_json(F.get_json_object(F.col(body), path), "array<string>")
    rows = responses.select(F.col(company).alias("company"), F.explode(records).alias("r"))
    r = F.col("r")
    text = _at(r, *s.description)
    if s.html:
        text = clean_html(F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&quot;"), F.lit('"')))
    made = {"title": _at(r, *s.title), "job_url": _at(r, *s.url), "location": _at(r, *s.location), "posted_at": parse_date(_at(r, *s.posted)), "job_id": _at(r, *s.id), "description": text, "country_code": _at(r, *s.country)}
    made |= {c: f(r, as_of) for c, f in s.special.items()}
    out = rows.select("company", *[c.alias(n) for n, c in made.items()]).withColumn("ats", F.lit(source))
    return out.select(*COLUMNS).where("coalesce(job_url, job_id) is not null")


def registry(spark) -> DataFrame:
    """The sources as a dimension: (ats, filter_mode, needs_detail, has_country)."""
    return spark.createDataFrame([(n, s.filter_mode, s.needs_detail, bool(s.country or "country_code" in s.special)) for n, s in SOURCES.items()], "ats string, filter_mode string, needs_detail boolean, has_country boolean")


def monitorable(companies: DataFrame) -> DataFrame:
    """Companies of a known source with a slug, for custom ones one whose JSON names an address."""
    known = F.col("ats").isin(*SOURCES) & F.col("slug").isNotNull()
    return companies.where(known & ((F.col("ats") != "custom") | (F.coalesce(F.get_json_object("slug", "$.url"), F.lit("")) != "")))


#: Preferred locales, in order.
LOCALES = ("en-us", "en_us", "en", "en-gb", "")


def best_locale(urls: DataFrame, key: str = "job_id", locale: str = "locale", url: str = "url") -> DataFrame:
    """One address of each id, by locale preference and then by address."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, LOCALES)), F.lower(F.coalesce(F.col(locale), F.lit("")))), F.lit(0)), F.lit(len(LOCALES) + 1))
    return urls.groupBy(key).agg(F.min_by(url, F.struct(place, F.col(url))).alias(url))
