"""Known cases of text functions and of roles, one by one."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dashboard as D
from millrace.operators import places, stats
from millrace.sources import infer

NAMES = ("Acme Technologies Inc.", "Blue  Sky Solutions, LLC", "Q", "Delta-Wave Group", "Holdings", "Echo & Foxtrot Co.", "9 Lives Ltd")
SLUGS = ("acme|acme", "bluesky|blue-sky|blue", "q", "deltawave|delta-wave|delta", "", "echofoxtrot|echo-foxtrot|echo", "9lives|9-lives|9")
WORDS = ("acme", "blue|sky", "", "delta|wave", "", "echo|foxtrot", "lives")
BOARD_OF = ("greenhouse acme", "lever acme-co", "workday acme/wd5/Careers", "ashby acme%20inc", "lever found", "icims acme", "taleo acme/ex", None, None, "successfactors acmeP")
FORMATS = ("json", None, "html_jsonld", "html_next", "html", "xml", None, None)
PAGES = ('{"title":"Dev"}', "[1, 2]", '<html><script type="application/ld+json">{"@type":"JobPosting","description":"d"}</script></html>', '<!DOCTYPE html><script id="__NEXT_DATA__" type="application/json">{"props":{"description":"d"}}</script>', "<html><p>x</p></html>", "<?xml version='1.0'?><job/>", "plain", None)
BOARDS = (
    "https://boards.greenhouse.io/acme/jobs/1", "https://jobs.lever.co/acme-co/77", "https://acme.wd5.myworkdayjobs.com/en-US/Careers/job/1", "https://jobs.ashbyhq.com/acme%20inc/9", "https://www.google.com/url?sa=t&url=https%3A%2F%2Fjobs.lever.co%2Ffound",
    "https://careers-acme.icims.com/jobs/1", "https://acme.taleo.net/careersection/ex/jobdetail.ftl", "https://acme.com/careers", None, "https://career4.successfactors.com/career?career_ns=x&company=acmeP",
)
FIELDS = (
    ("link", "https://x/1", "url"), ("apply_url", "https://x/1", "url_apply"), ("path", "/en/jobs/12345/dev", "url"), ("when", "2024-01-05T00:00:00Z", "date"), ("posted", "1704412800", "date"), ("ref", "200033787", "id"),
    ("x", "123e4567-e89b-12d3-a456-426614174000", "id"), ("body", "w" * 201, "long_text"), ("site", '{"city":"Rome"}', "location"), ("meta", '{"a":1}', None), ("job_title", "Dev", "title"), ("city", "Rome", "location"),
    ("slug", "dev-rome", "id"), ("note", "hello", "text"), ("note", "", None), ("tags", '["Rome","Oslo"]', "location"), ("flag", "ok", None),
)


def each(spark, rows, schema, column):
    made = spark.createDataFrame([(k, *(r if isinstance(r, tuple) else (r,))) for k, r in enumerate(rows)], f"k int, {schema}")
    return [r.out for r in made.select("k", column.alias("out")).orderBy("k").collect()]


def test_company_slugs(spark):
    assert [list(dict.fromkeys(x)) for x in each(spark, NAMES, "x string", T.company_slugs(F.col("x")))] == [list(dict.fromkeys(v.split("|"))) if v else [] for v in SLUGS]
    assert ["|".join(x) for x in each(spark, NAMES, "x string", T.company_keywords(F.col("x")))] == list(WORDS)


def test_portals(spark):
    more = ("https://boards.greenhouse.io/embed/job_app?for=Stripe&token=1", "https://boards.greenhouse.io/embed/job_board/js?b=1&for=x", "https://boards.greenhouse.io/embed/job_app", "https://hire.lever.co/Acme", "https://JOBS.lever.co/ACME/1", "https://jobs.smartrecruiters.com/oneclick-ui/company/Acme/publication/1", "https://jobs.smartrecruiters.com/Acme/1")
    told = ("greenhouse stripe", "greenhouse x", None, "lever acme", "lever acme", "smartrecruiters acme", "smartrecruiters acme")
    got = each(spark, (*BOARDS, *more), "x string", T.portal_slug(F.col("x")))
    assert [f"{r.platform} {r.slug}" if r else None for r in got] == [*BOARD_OF, *told]


def test_value_roles_and_formats(spark):
    assert each(spark, [f[:2] for f in FIELDS], "n string, v string", infer.value_role(F.col("n"), F.col("v"))) == [f[2] for f in FIELDS]
    assert each(spark, PAGES, "x string", infer.detail_format(F.col("x"))) == list(FORMATS)


@pytest.mark.parametrize(("title", "kind", "excluded"), [("Senior Recruiter", "auto", False), ("Head of People", "manual_review", False), ("Chief Talent Acquisition Officer", "auto", True), ("Founder", None, True), ("Engineer", None, False), (None, None, False)])
def test_titles(spark, title, kind, excluded):
    assert each(spark, [title], "x string", D.hiring_title(F.col("x"))) == [kind] and each(spark, [title], "x string", D.excluded_title(F.col("x"))) == [excluded]
    assert each(spark, [title], "x string", D.hiring_title(F.col("x"), ("eng",), ())) == ["auto" if title == "Engineer" else None]


def test_compound_names(spark):
    names = ("capitalOne", "Capital_One", "jpmc", "a-b.c_D", "XMLFeed9", "")
    parts = ("capital|capitalone|one", "capital|capital_one|one", "jpmc", "a|a-b|a-b.c|a-b.c_d|b|b.c_d|c|c_d|d", "feed9|xml|xmlfeed9", "")
    assert ["|".join(x) for x in each(spark, names, "x string", T.compound_parts(F.col("x")))] == list(parts)


def test_codes_of_all_countries(spark):
    codes = {"USA": "US", "can": "CA", "CZE": "CZ", "XXX": "", "": "", None: ""}
    assert each(spark, list(codes), "x string", stats.alpha2(F.col("x"), places.countries(spark))) == list(codes.values())


@pytest.mark.parametrize(("platform", "slug", "want"), [
    ("workday", '{"slug":"a","wd":"wd1"}', {"slug": "a", "wd": "wd1", "path": "careers"}), ("workday", "plain", {"slug": "plain", "wd": "wd5", "path": "careers"}), ("workday", '{"slug":"b","path":"jobs"}', {"slug": "b", "path": "jobs"}),
    ("oracle_hcm", None, {"slug": "", "site": ""}), ("oracle_hcm", '{"slug":"a"}', {"slug": "a"}), ("lever", '{"slug":"a"}', {"slug": '{"slug":"a"}'}), ("lever", None, {"slug": ""}), ("custom", "plain", {}),
])
def test_slug_configs(spark, platform, slug, want):
    assert each(spark, [(platform, slug)], "p string, x string", stats.slug_config(F.col("p"), F.col("x"))) == [want]
