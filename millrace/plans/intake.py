"""Queries of listing sources, schema inference, addresses and names, and the SQL that each must equal."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dashboard as D
from ..operators import dedup as U
from ..operators import filings as L
from ..operators import health as H
from ..operators import places as G
from ..operators import retention as K
from ..session import shared_dir
from ..sources import adapters, feeds, files, infer, nested, scrape, sheets, xlsx
from .roles import AS_OF, as_text, oracle, role


def _dealt(values, by: Column) -> Column:
    """One of some values for each number, in turn."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(by, F.lit(len(values))) + 1).cast("int"))


def _sql_list(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'" for v in values) + "]"


#: Places, whether their own words tell, and what a gazetteer has.
_PLACES = ("Austin, TX", "Nairobi, Kenya", "Lima, PER", "Accra, GH", "Osaka", "Paris", "Cambridge", "Lyon Centre", "Springfield", "Remote", "Delhi, IN, India", "Hyderabad", None, "Quito", "Nowhere Special", "Bengaluru")
_SAID = (True, False, False, False, None, None, None, None, None, None, False, None, True, None, None, False)
_CITIES = (("osaka", "JP"), ("paris", "FR"), ("paris", "US"), ("cambridge", "GB"), ("cambridge", "US"), ("lyon", "FR"), ("springfield", "US"), ("hyderabad", "IN"), ("hyderabad", "PK"), ("quito", "EC"))


def _places(s, d):
    rows = role(s, d, "postings").select("job_id", _dealt(_PLACES, F.col("job_id")).alias("location"))
    return G.located(rows, s.createDataFrame(_CITIES, "name string, country string"), known=G.countries(s)).select("job_id", "is_us")


def _titles(s, d):
    """All title counts of the filings of some years, as arrays."""
    counts = lambda where: role(s, d, "filings").where(where).groupBy("fein", "title").agg(F.count("*").alias("n")).groupBy("fein").agg(F.collect_list(F.struct("title", F.col("n").alias("count"))).alias("titles"))
    merged = L.merge_titles(counts("year < 1996"), counts("year >= 1996"))
    return merged.select("fein", F.posexplode("titles").alias("p", "t")).select("fein", "t.title", F.col("t.count").alias("n"), (F.col("p") + 1).alias("rank"))


def _retained(s, d):
    apps = role(s, d, "applications").select(F.col("application_id").alias("id"), "status", F.col("applied_on").alias("applied_date"))
    seen = role(s, d, "requests").select("event_id", F.when(F.col("user_id") % 13 != 0, F.col("user_id")).alias("company"), F.col("ts").alias("last_polled"))
    firms = role(s, d, "requests").where("user_id % 3 = 0").select(F.col("user_id").alias("company")).distinct()
    rules = [r for r in K.RULES if r.table in ("applications", "application_recruiters", "seen_job_ids")]
    left = K.retained({"applications": apps, "application_recruiters": role(s, d, "bridge"), "seen_job_ids": seen, "prospective_companies": firms}, "1998-06-30 00:00:00", rules[:2])
    left |= {"seen_job_ids": K.retained({"seen_job_ids": seen, "prospective_companies": firms}, "2024-04-15 00:00:00", rules[2:])["seen_job_ids"]}
    a = left["applications"].select(F.lit("applications").alias("tbl"), "id", "status")
    b = left["application_recruiters"].groupBy("application_id").agg(F.count("*").cast("string").alias("status")).select(F.lit("application_recruiters"), "application_id", "status")
    c = left["seen_job_ids"].select(F.lit("seen_job_ids"), "event_id", F.lit("kept"))
    return a.union(b).union(c)


def _hashes(s, d):
    rows = role(s, d, "postings").select("job_id", F.when(F.col("job_id") % 9 != 0, F.md5(F.col("title").cast("binary"))).alias("content_hash"), F.md5(F.concat(F.lit("old "), "title").cast("binary")).alias("legacy_hash"))
    known = rows.where("job_id % 7 = 0").select("content_hash").union(rows.where("job_id % 5 = 0").select("legacy_hash"))
    return U.hash_known(rows, known)


_STATUSES = ("new", "digested", "dismissed", "expired", "filled")


def _jobs(s, d):
    number = F.col("job_id")
    return role(s, d, "postings").select(
        number.alias("id"), "title", "company", F.col("n_chars").alias("score"), _dealt(_STATUSES, number).alias("status"), F.date_add(F.lit("2024-01-01").cast("date"), (number % 30).cast("int")).alias("first_seen"), (number % 12).alias("missing_days"),
        F.when(number % 2 == 0, "lever").otherwise("ashby").alias("ats"),
    )


#: Links on a page, and what each is as an address.
_LINKS = ("https://x.org/a b", "/jobs/5", "x/y?z=1", "../up", "?q=1", "#f", "//h.org/p", "", "./.", "mailto:a@b")
_ADDRESS = r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^[a-z]+') AS scheme, regexp_extract(url, '^[a-z]+://[^/?#]*') AS origin, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?][^#]*') AS query FROM pages),
 q AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END AS dir FROM p)
 SELECT page_id, CASE page_id % 10 WHEN 0 THEN 'https://x.org/a b' WHEN 1 THEN origin || '/jobs/5' WHEN 2 THEN origin || dir || 'x/y?z=1' WHEN 3 THEN origin || CASE WHEN dir = '/' THEN '/' ELSE regexp_replace(dir, '[^/]*/$', '') END || 'up' WHEN 4 THEN origin || path || '?q=1'
 WHEN 5 THEN origin || path || query || '#f' WHEN 6 THEN scheme || '://h.org/p' WHEN 7 THEN '' WHEN 8 THEN origin || dir ELSE 'mailto:a@b' END AS address FROM q"""

def _compound(s, d):
    """Parts by compound names of their type, the words of their name as humps, and the number of their brand."""
    name = F.concat(F.lower("p_type"), F.lit("_"), F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), F.lit("-"), F.substring_index("p_brand", "#", -1))
    said = F.when(F.length("p_name") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("slug"), F.lit("WD5").alias("wd"), F.lit(3).alias("n")))).otherwise(F.upper("p_name"))
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(T.compound_parts(name), "|").alias("parts"), T.slug_text(said).alias("said"))



def _shown(s, d):
    """Records of orders with a number in their addresses, which is not the field that is called id."""
    o = s.read.parquet(f"{d}/orders.parquet")
    node = F.struct(F.col("o_orderpriority").alias("job_title"), F.concat(F.lit("/careers/job/"), (F.col("o_orderkey") + 10_000_000).cast("string"), F.lit("/x")).alias("link"), (F.col("o_orderkey") + 10_000_000).cast("string").alias("key"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_orderstatus").alias("city"))
    return o.select((F.col("o_custkey") % 50).alias("company"), F.floor(F.col("o_orderkey") / 400).alias("page"), F.col("o_orderkey").alias("at"), node.alias("node"))


def _bodies(s, d):
    pages = _shown(s, d).groupBy("company", "page").agg(F.array_sort(F.collect_list(F.struct("at", "node"))).alias("n"))
    return pages.select("company", "page", F.to_json(F.struct(F.struct(F.lit(7).alias("total"), F.transform("n", lambda x: F.struct(x["node"].alias("node"))).alias("edges")).alias("data"))).alias("body"))


def _records(s, d):
    return infer.records(_bodies(s, d), keep=("company", "page"))


def _url_ids(s, d):
    """Ids in addresses: the records are found once and kept in the shared store, as three steps read them."""
    path = f"{shared_dir(s)}/records-{uuid.uuid4().hex}"
    _records(s, d).write.parquet(path)
    found = s.read.parquet(path)
    return infer.ids_in_urls(found, infer.field_roles(found)).where("role = 'id'").select("company", "field", "votes")


def _nested(leaves: dict[str, Column]) -> Column:
    """A struct with leaves at paths such as a.b or a[0].b, arrays with as many items as their numbers ask for."""
    groups: dict[str, dict[str, Column]] = {}
    for path, leaf in leaves.items():
        head, _, rest = path.partition(".")
        groups.setdefault(head, {})[rest] = leaf
    fields: dict[str, dict[int, Column]] = {}
    for head, inside in groups.items():
        name, number = re.fullmatch(r"(\w+)(?:\[(\d+)\])?", head).groups()
        made = inside[""] if "" in inside else _nested(inside)
        fields.setdefault(name, {})[int(number) if number else -1] = made
    out = []
    for name, items in fields.items():
        out.append((items[-1] if -1 in items else F.array(*[items.get(k, F.lit(None)) for k in range(max(items) + 1)])).alias(name))
    return F.struct(*out)


#: Where sources that work out a column from others keep it.
_SPECIAL = {"smartrecruiters": {"location": "location.fullLocation"}, "jibe": {"job_url": "data.apply_url", "location": "data.full_location"}, "eightfold": {"location": "standardizedLocations[0]"}, "adp": {"location": "requisitionLocations[0].address.cityName"}, "taleo": {"title": "column[0]", "location": "column[1]"}}


def _portals(s, d):
    """Addresses of known portals with each page's first label, upper case, as their customer."""
    x = F.upper(F.regexp_extract("url", "^https?://([^./]+)", 1))
    forms = ("https://boards.greenhouse.io/embed/job_app?token=1&for={}&b=2", "https://job-boards.eu.greenhouse.io/{}/jobs/1", "https://hire.lever.co/{}", "https://www.google.com/url?sa=t&url=https%3A%2F%2Fjobs.lever.co%2F{}%2F7", "https://jobs.smartrecruiters.com/oneclick-ui/company/{}/publication/9", "https://{}.wd5.myworkdayjobs.com/en-US/Careers/job/1", "https://careers-{}.ICIMS.com/jobs/1", "https://{}.taleo.net/careersection/ex/jobdetail.ftl", "https://jobs.ashbyhq.com/{}/9", "https://career4.successfactors.com/career?career_ns=x&company={}", "https://boards.greenhouse.io/embed/job_board/js?for={}", "https://{}.com/careers")
    url = F.element_at(F.array(*(F.replace(F.lit(f), F.lit("{}"), x) for f in forms)), (F.col("page_id") % 12 + 1).cast("int"))
    found = T.portal_slug(url)
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", F.concat_ws(" ", found["platform"], found["slug"]).alias("found"))


def _values(s, d):
    """What a page's own values look like under different names of fields."""
    fields = F.array(*(F.struct(F.lit(n).alias("name"), v.cast("string").alias("value")) for n, v in (("link", F.col("url")), ("apply-url", F.col("url")), ("note", F.col("html")), ("x", F.col("page_id") + 1_000_000), ("posted", F.lit("2024-01-05")), ("job_title", F.substring("html", 16, 40)), ("city", F.lit(" ")), ("site", F.to_json(F.struct(F.col("url").alias("city")))))))
    rows = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(fields).alias("f"))
    return rows.select("page_id", F.col("f.name").alias("name"), infer.value_role(F.col("f.name"), F.col("f.value")).alias("role"))


def _formats(s, d):
    """Pages as they are, and with data in them."""
    pages = s.read.parquet(f"{d}/pages.parquet")
    title = F.to_json(F.struct(F.col("url").alias("title")))
    script = F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), title, F.lit("</script>"))
    ld = F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.struct(F.lit("JobPosting").alias("@type"), F.col("url").alias("description"))), F.lit("</script>"))
    body = F.when(F.col("page_id") % 5 == 0, title).when(F.col("page_id") % 5 == 1, F.concat("html", script)).when(F.col("page_id") % 5 == 2, F.concat("html", ld)).when(F.col("page_id") % 5 == 3, F.col("url")).otherwise(F.col("html"))
    return pages.select("page_id", infer.detail_format(body).alias("format"))


def _structures(s, d):
    """Pages as postings of their own: a member of data, of a script's state, linked data, nothing, or as they are."""
    n = F.col("page_id") % 5
    told = [F.col("url").alias("summary"), F.substring("html", 16, 60 + F.col("page_id") % 40).alias("blob"), F.regexp_extract("url", "://([^/]+)", 1).alias("name"), F.array("page_id").alias("office"), F.struct("page_id").alias("pay")]
    script = lambda head, value: F.concat("html", F.lit(f"<script {head}>"), F.to_json(value), F.lit("</script>"))
    body = (
        F.when(n == 0, F.to_json(F.struct(F.struct(F.struct(*told).alias("job"), F.lit(1).alias("status")).alias("data"))))
        .when(n == 1, script('id="__NEXT_DATA__" type="application/json"', F.struct(F.struct(F.struct(*told).alias("job"), F.array(F.struct(*told), F.struct(*told)).alias("more")).alias("props"))))
        .when(n == 2, script('type="application/ld+json"', F.struct(F.lit("JobPosting").alias("@type"), *told)))
        .when(n == 3, F.col("url")).otherwise(F.col("html"))
    )
    rows = s.read.parquet(f"{d}/pages.parquet").select("page_id", infer.detail_structure(body).alias("s"))
    return rows.select("page_id", "s.format", "s.path", F.array_join(F.array_sort(F.transform(F.map_entries("s.fields"), lambda e: F.concat_ws("=", e["key"], e["value"]))), "|").alias("fields"))


def _listed(s, d):
    """Each document as a posting of every source: written as that source answers, fifty to a response, and read back."""
    docs = role(s, d, "postings").select("company", F.col("job_id").cast("string").alias("id"), F.concat(F.lit("Job "), F.col("job_id").cast("string")).alias("title"), F.concat(F.lit("https://x.org/j/"), F.col("job_id").cast("string")).alias("url"), F.concat(F.lit("City "), (F.col("job_id") % 9).cast("string")).alias("place"), F.floor(F.col("job_id") / 50).alias("page"))
    out = None
    for name, source in adapters.SOURCES.items():
        special = _SPECIAL.get(name, {})
        paths = {special.get("title") or source.title[0]: F.col("title"), source.id[0]: F.col("id")}
        for path, column in ((special.get("job_url") or (source.url or (None,))[0], "url"), (special.get("location") or (source.location or (None,))[0], "place")):
            if path:
                paths[path] = F.col(column)
        rows = docs.select("company", "page", _nested(paths).alias("r")).groupBy("company", "page").agg(F.collect_list("r").alias("rows"))
        body = F.to_json(_nested({source.rows: F.col("rows")})) if source.rows else F.to_json("rows")
        got = adapters.adapt(rows.select("company", body.alias("body")), name, AS_OF).select("ats", "company", "job_id", "title", "job_url", "location")
        out = got if out is None else out.unionByName(got)
    return out


def _has(field: str, special: str) -> str:
    return ", ".join(f"'{n}'" for n, x in adapters.SOURCES.items() if getattr(x, field) or special in _SPECIAL.get(n, {}))


def _feeds(s, d):
    """Documents as items of XML feeds, fifty to a response."""
    item = F.concat(F.lit("<item><guid>"), F.col("job_id").cast("string"), F.lit("</guid><title><![CDATA[Dev & <b>"), F.col("job_id").cast("string"), F.lit("</b>]]></title><link>https://x.org/j/"), F.col("job_id").cast("string"), F.lit("</link><location>Mountain ViewCAUSA (NYC)</location><pubDate>2024-01-05</pubDate></item>"))
    bodies = role(s, d, "postings").groupBy("company", F.floor(F.col("job_id") / 50).alias("page")).agg(F.concat(F.lit("<?xml version='1.0'?><rss>"), F.array_join(F.collect_list(item), "\n"), F.lit("</rss>")).alias("body"))
    return feeds.feed(bodies.withColumn("url", F.lit("https://x.org/feed"))).select("company", "job_id", "title", "job_url", "location", F.to_date("posted_at").cast("string").alias("day"))


def _sitemaps(s, d):
    """Pages as entries of sitemaps, fifty to one."""
    entry = F.concat(F.lit("<url><loc>"), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("</loc><lastmod>2024-01-05</lastmod></url>"))
    bodies = s.read.parquet(f"{d}/pages.parquet").where("url IS NOT NULL").groupBy(F.floor(F.col("page_id") / 50).alias("page")).agg(F.array_join(F.collect_list(entry), "").alias("body"))
    found = feeds.sitemap(bodies.select(F.lit("c").alias("company"), "body"), pattern="/(?:en|fr)/", locale="en")
    return found.select("job_url", "title", "job_id")


def _links(s, d):
    """Pages with links to postings, one in five of them relative to the page."""
    body = F.concat(F.lit('<html><a class="x" href="'), F.when(F.col("page_id") % 5 == 0, F.lit("/jobs/")).otherwise(F.lit("https://x.org/jobs/")), (F.col("page_id") + 10000).cast("string"), F.lit('/dev"> <b>Dev</b>&amp;Ops </a><a href="/about">About</a></html>'))
    rows = s.read.parquet(f"{d}/pages.parquet").where("url IS NOT NULL").select(F.col("page_id").cast("string").alias("company"), "url", body.alias("body"))
    return feeds.adapt_any(rows, "icims", AS_OF).select("company", "job_id", "title", "job_url", "ats")


def _pagination(s, d):
    seen = role(s, d, "polls").groupBy("user_id").agg(F.sum("new_jobs").alias("n")).select(
        F.col("user_id").alias("company"),
        F.when(F.col("user_id") % 4 == 0, '{"offset": "0", "limit": "20"}').when(F.col("user_id") % 4 == 1, '{"page": "1"}').otherwise("{}").alias("params"),
        F.when(F.col("user_id") % 8 == 1, '{"pageSize": 250, "page": 1}').otherwise("").alias("body"),
        F.concat(F.lit('{"meta": {"x": [1], "total_count": '), (F.col("n") + 1).cast("string"), F.lit("}"), F.when(F.col("user_id") % 4 == 2, ', "next": "abc"').otherwise(""), F.lit("}")).alias("response"), F.lit(25).alias("page_size"),
    )
    plan = infer.paginations(seen)
    return plan.select("company", *(F.col(f"plan.{c}").alias(c) for c in ("type", "param", "page_size", "location", "total_field")))


def _deep(s, d):
    """Event properties, each under members and items of its own depth, found again wherever they are."""
    e = s.read.parquet(f"{d}/events.parquet")
    wrapped = [F.col("props"), F.concat(F.lit('{"a": [1, '), F.col("props"), F.lit("]}")), F.concat(F.lit('[{"a": {"b": [[], '), F.col("props"), F.lit('], "k": null}}, {"a": {"k": -1}}]')), F.concat(F.lit('{"k": {"k": 1}, "a": '), F.col("props"), F.lit("}")), F.lit('{"no": ["k"]'), F.lit(None)]
    body = F.element_at(F.array(*wrapped), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", nested.find(body, "k").alias("k"), nested.at(body, "a.k").alias("at"), nested.at(body, "a[1].k").alias("item"))


def _landed(s, rows, **options):
    """A folder in the shared store with rows as delimited text."""
    path = f"{shared_dir(s)}/landed-{uuid.uuid4().hex}"
    rows.write.options(header=True, **options).csv(path)
    return path


def _filed(s, d):
    """Filings under the headers that landed files have."""
    return role(s, d, "filings").select(
        F.when(F.col("l_linenumber") != 7, "H-1B ").otherwise("E-3").alias("Visa Class"), F.when(F.col("l_linenumber") != 6, F.col("fein")).alias("Employer Fein"), F.col("status").alias("Case Status"), F.concat(F.col("positions").cast("string"), F.lit(",000")).alias("Total Worker Positions"),
        F.col("soc").alias("SOC Code"), F.col("title").alias("Job  Title"), F.date_format("decided", "M/d/yyyy").alias("Decision-Date"), F.col("employer_state").alias("Employer State"),
    )


def _by_year(found):
    return found.groupBy("fein", "status", "year").agg(F.count("*").alias("n"), F.sum("positions").alias("positions"), F.min("title").alias("title"))


def _loaded(s, d):
    return _by_year(files.load_filings(files.read_delimited(s, _landed(s, _filed(s, d), sep="\t"), ["VISA_CLASS", "EMPLOYER_FEIN"])))


def _from_workbooks(s, d):
    """Filings written as workbooks and read back, several tasks a sheet."""
    path = f"{shared_dir(s)}/books-{uuid.uuid4().hex}"
    # a file of few row groups would be few tasks' work
    xlsx.write_workbooks(_filed(s, d).repartition(s.sparkContext.defaultParallelism), path)
    return _by_year(files.load_filings(xlsx.read_workbooks(s, path, required=["VISA_CLASS", "EMPLOYER_FEIN"], taskBytes=str(8 << 20))))


def _scraped(s, d):
    """Pages with structured data in a graph, a meta element, an unclosed element of a place, or none of these."""
    n = F.col("page_id").cast("string")
    graph = F.concat(F.lit('<script type="application/ld+json">{"@graph": [{"@type": "Thing"}, {"@type": ["X", "JobPosting"], "title": "Job '), n, F.lit('", "description": "<p>one<br>&amp; two", "employmentType": ["FULL", "PART"], "hiringOrganization": {"name": "Firm"}, "jobLocation": [{"address": {"addressRegion": "R"}}]}]}</script>'))
    added = F.array(graph, F.concat(F.lit('<meta property="og:title" content="Dev &amp; '), n, F.lit('">')), F.concat(F.lit('<ul><li class="office-location">City <b>'), n, F.lit("<li>other</ul>")), F.lit("<script type=application/ld+json>{no</script>"))
    html = F.concat(F.element_at(added, (F.col("page_id") % 4 + 1).cast("int")), "html")
    return scrape.scraped(s.read.parquet(f"{d}/pages.parquet").select("page_id", "url", html.alias("html"))).select("page_id", "posting.*")


def _texts(s, d):
    return scrape.page_text(s.read.parquet(f"{d}/pages.parquet").select("page_id", "html"), F.col("html")).select("page_id", "text")


def _petitioned(s, d):
    p = role(s, d, "petitions").select(F.col("legal_norm").alias("Employer (Petitioner) Name"), F.col("tax_id").alias("Tax ID"), F.when(F.col("o_orderkey") % 10 != 0, F.col("fiscal_year")).otherwise(1901).alias("Fiscal Year"), F.when(F.col("o_orderkey") % 9 == 0, "-1").otherwise(F.concat(F.col("a3").cast("string"), F.lit(",200"))).alias("Initial Approval"))
    df = files.read_delimited(s, _landed(s, p))
    return files.load_petitions(df, {"EMPLOYER_PETITIONER_NAME": "name", "TAX_ID": "tax_id", "FISCAL_YEAR": "fiscal_year", "INITIAL_APPROVAL": "a"}, ["a"]).groupBy("name", "fiscal_year").agg(F.sum("a").alias("a"), F.max("tax_id").alias("tax_id"))


def _crawled(s, d):
    host, path = T.url_host(F.col("url")), f"{shared_dir(s)}/index-{uuid.uuid4().hex}"
    pages = s.read.parquet(f"{d}/pages.parquet").select("url", T.registrable(host).alias("url_host_registered_domain"), T.url_path(F.col("url")).alias("url_path"), F.when(F.col("page_id") % 4 == 0, 404).otherwise(200).alias("fetch_status"), F.when(F.col("page_id") % 3 == 0, "c1").otherwise("c2").alias("crawl"), F.when(F.col("page_id") % 5 == 0, "robotstxt").otherwise("warc").alias("subset"))
    pages.write.partitionBy("crawl", "subset").parquet(path)
    return files.crawl_index(s, path, "c2", ["example.com", "example.org"]).select("url", F.col("url_host_registered_domain").alias("root"))


def _applied(s, d):
    """Orders as rows of a form, some without a user, company or good address, some twice."""
    o = s.read.parquet(f"{d}/orders.parquet")
    n = F.col("o_orderkey")
    rows = o.select(n.alias("row"), F.when(n % 11 != 0, F.concat(F.lit(" Firm "), (n % 40).cast("string"))).alias("company"), F.when(n % 7 != 0, F.concat(F.lit("https://jobs.lever.co/f"), (n % 40).cast("string"), F.lit("/"), F.floor(n / 80).cast("string"))).otherwise("lever/1").alias("job_url"), F.lit(" ").alias("title"), F.when(n % 5 != 0, "1/5/2024").otherwise("soon").alias("applied_on"), F.when(n % 13 != 0, F.concat(F.lit("User"), (n % 2).cast("string"))).alias("user_name"))
    users = s.createDataFrame([("user0", 0), (" USER1 ", 1)], "name string, user_id int")
    known = rows.where("row % 9 = 0").select((F.col("row") % 2).cast("int").alias("user_id"), "job_url")
    found = sheets.applications(rows, users, known, "2024-01-31")
    return found.select("row", "outcome", "user_id", F.col("applied_on").cast("string").alias("applied_on"), "expected_domain", F.col("portal.slug").alias("slug"))


def _prospected(s, d):
    c = s.read.parquet(f"{d}/customer.parquet")
    n = F.col("c_custkey")
    rows = c.select(n.alias("row"), F.when(n % 17 != 0, F.concat(F.when(n % 2 == 0, "FIRM ").otherwise("Firm "), F.floor(n / 2).cast("string"))).otherwise(" ").alias("company"), F.when(n % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/g"), n.cast("string"))).alias("job_url"), F.when(n % 4 == 0, "https://www.firm.com/careers").alias("career_page"), F.lit(None).cast("string").alias("domain"), F.when(n % 10 == 0, "https://x.org/feed.xml").alias("xml_url"), F.when(n % 25 == 0, "curl 'https://x'").alias("curl"))
    return sheets.prospects(rows, rows.where("row % 6 = 0").select(F.upper("company").alias("company"))).select("row", "outcome", "ats", "slug", "domain")


def _weekly(s, d):
    req = role(s, d, "requests")
    return H.weekly({"errors": lambda: H.rollup(req), "none": lambda: req.where("ms < 0"), "classes": lambda: req.groupBy("platform", "class").count(), "broken": lambda: req.select("no_such_column")}).select("part", "has_data", "rows", F.col("why").isNotNull().alias("failed"))


QUERIES = {
    "q_form_applications": _applied,
    "q_form_prospects": _prospected,
    "q_weekly_bundle": _weekly,
    "q_load_filings": _loaded,
    "q_page_scrape": _scraped,
    "q_page_text": _texts,
    "q_load_workbooks": _from_workbooks,
    "q_load_petitions": _petitioned,
    "q_crawl_index": _crawled,
    "q_place_lookup": _places,
    "q_merge_titles": _titles,
    "q_retention_rules": _retained,
    "q_hash_known": _hashes,
    "q_listing": lambda s, d: D.listing(_jobs(s, d), ("new", "digested", "filled"), "2024-01-03", "2024-01-25", search="tH", platforms=("lever",)).select("id", "status"),
    "q_digest": lambda s, d: D.digest(_jobs(s, d)).select("id", "company", "score"),
    "q_missing": lambda s, d: D.missing(_jobs(s, d), 8).select("id", "missing_days"),
    "q_top_occupations": lambda s, d: D.top_occupations(L.by_soc(role(s, d, "filings")), "12-0000001").select("soc", "certified"),
    "q_pending_prospects": lambda s, d: D.pending(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("company"), F.when(F.col("c_custkey") % 3 == 0, "pending").otherwise("done").alias("status"), (F.col("c_custkey") % 5).alias("priority"), F.col("c_acctbal").alias("created_at")), 100).select("company", "priority"),
    "q_hiring_title": lambda s, d: role(s, d, "postings").select("job_id", D.hiring_title(F.col("text"), ("ation", "ungen"), ("str", "ll")).alias("kind"), D.excluded_title(F.col("text"), ("qu", "sch")).alias("excluded")),
    "q_absolute_url": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.absolute_url(_dealt(_LINKS, F.col("page_id")), F.col("url")).alias("address")),
    "q_company_slugs": lambda s, d: s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.array_join(T.company_slugs(F.concat("p_name", F.lit(" Holdings, Inc."))), "|").alias("slugs"), F.array_join(T.company_keywords(F.concat("p_name", F.lit(" Holdings, Inc."))), "|").alias("words")),
    "q_compound_parts": _compound,
    "q_detail_structure": _structures,
    "q_cache_key": lambda s, d: role(s, d, "postings").select("job_id", T.cache_key(F.col("company"), F.col("title"), F.col("text")).alias("key")),
    "q_portal_slug": _portals,
    "q_value_role": _values,
    "q_detail_format": _formats,
    "q_records": lambda s, d: _records(s, d).select("company", "page", "path", F.get_json_object("record", "$.id").cast("bigint").alias("id"), F.get_json_object("record", "$.job_title").alias("title")),
    "q_field_roles": lambda s, d: infer.field_roles(_records(s, d)).select("company", "role", "field", "votes"),
    "q_ids_in_urls": _url_ids,
    "q_record_prints": lambda s, d: infer.record_prints(_records(s, d)).select("company", "page", F.size("prints").cast("bigint").alias("n"), F.array_min("prints").alias("first")),
    "q_pagination": _pagination,
    "q_deep_find": _deep,
    "q_adapters": _listed,
    "q_feed": _feeds,
    "q_sitemap": _sitemaps,
    "q_links": _links,
}

_R = "(SELECT o_custkey % 50 AS company, o_orderkey // 400 AS page, o_orderkey, o_orderpriority, o_orderstatus FROM orders)"
_JOBS = f", j AS (SELECT job_id AS id, title, company, n_chars AS score, ({_sql_list(_STATUSES)})[job_id % 5 + 1] AS status, DATE '2024-01-01' + (job_id % 30)::INTEGER AS first_seen, job_id % 12 AS missing_days, CASE WHEN job_id % 2 = 0 THEN 'lever' ELSE 'ashby' END AS ats FROM postings)"

_FORM = """WITH r AS (SELECT o_orderkey AS n, o_orderkey % 11 = 0 AS anonymous, o_orderkey % 7 = 0 AS bad, CASE WHEN o_orderkey % 13 <> 0 THEN o_orderkey % 2 END AS u, o_orderkey % 40 AS f, CASE WHEN o_orderkey % 7 = 0 THEN 'lever/1' ELSE 'f' || o_orderkey % 40 || '/' || o_orderkey // 80 END AS x FROM orders),
 k AS (SELECT DISTINCT n % 2 AS u, x FROM r WHERE n % 9 = 0),
 o AS (SELECT r.*, CASE WHEN u IS NULL THEN 'held' WHEN anonymous OR bad THEN 'invalid' WHEN (u, x) IN (SELECT (u, x) FROM k) THEN 'duplicate' ELSE 'new' END AS fits FROM r)
 SELECT n AS row, CASE WHEN fits = 'new' AND row_number() OVER (PARTITION BY fits, u, x ORDER BY n) > 1 THEN 'duplicate' ELSE fits END AS outcome, u::INTEGER AS user_id, CASE WHEN n % 5 <> 0 THEN '2024-01-05' ELSE '2024-01-31' END AS applied_on, CASE WHEN bad THEN '' ELSE 'lever.co' END AS expected_domain, CASE WHEN NOT bad THEN 'f' || f END AS slug FROM o"""
_PROSPECTS = """WITH r AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 17 <> 0 THEN 'firm ' || c_custkey // 2 ELSE '' END AS name, CASE WHEN c_custkey % 25 = 0 THEN 'custom' WHEN c_custkey % 10 = 0 THEN 'sitemap' WHEN c_custkey % 3 = 0 THEN 'greenhouse' WHEN c_custkey % 4 = 0 THEN 'unknown' END AS ats FROM customer)
 SELECT n AS row, CASE WHEN name = '' THEN 'invalid' WHEN ats IS NULL THEN 'incomplete' WHEN row_number() OVER (PARTITION BY name ORDER BY n DESC) > 1 THEN 'replaced' WHEN name IN (SELECT name FROM r WHERE n % 6 = 0) THEN 'update' ELSE 'new' END AS outcome, ats, CASE ats WHEN 'custom' THEN 'curl ' || chr(39) || 'https://x' || chr(39) WHEN 'sitemap' THEN 'https://x.org/feed.xml' WHEN 'greenhouse' THEN 'g' || n END AS slug, CASE WHEN n % 4 = 0 THEN 'firm.com' END AS domain FROM r"""

#: Pieces of text between tags, by expressions.
_PIECES = "list_filter(list_transform(string_split(regexp_replace(regexp_replace({x}, '(?is)<(?:script|style)\\b.*?</(?:script|style)\\s*>|<!--.*?-->', chr(1), 'g'), '(?s)<[^>]*>', chr(1), 'g'), chr(1)), lambda t: trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\\s+', ' ', 'g'))), lambda t: t <> '')"

ORACLE_SQL = {
    "q_page_text": f"SELECT page_id, coalesce(array_to_string({_PIECES.format(x='html')}, ' '), '') AS text FROM pages",
    "q_page_scrape": f"""WITH p AS (SELECT page_id, page_id % 4 AS n, array_to_string({_PIECES.format(x="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, ' ') AS h1, array_to_string({_PIECES.format(x="regexp_extract(html, '(?s)<article>(.*?)</article>', 1)")}, chr(10)) AS article, regexp_extract(url, '^https?://(?:www[.])?(?:jobs[.])?([^./]+)', 1) AS host FROM pages)
 SELECT page_id, CASE n WHEN 0 THEN 'Job ' || page_id WHEN 1 THEN 'Dev & ' || page_id ELSE h1 END AS title, CASE n WHEN 0 THEN 'Firm' ELSE array_to_string(list_transform(string_split(host, '-'), lambda w: upper(w[1]) || w[2:]), '-') END AS company, CASE n WHEN 0 THEN 'R' WHEN 2 THEN 'City ' || page_id ELSE '' END AS location,
 CASE n WHEN 0 THEN 'one' || chr(10) || '& two' ELSE article END AS description, CASE n WHEN 0 THEN 'FULL, PART' ELSE '' END AS job_type, CASE n WHEN 0 THEN 'data' WHEN 1 THEN 'meta' ELSE 'selector' END AS via FROM p""",
    "q_form_applications": _FORM,
    "q_form_prospects": _PROSPECTS,
    "q_weekly_bundle": oracle("requests", body=" SELECT part, n > 0 AS has_data, n AS rows, part = 'broken' AS failed FROM (SELECT 'errors' AS part, count(DISTINCT (date, platform, context)) AS n FROM requests UNION ALL SELECT 'none', count_if(ms < 0)::BIGINT FROM requests UNION ALL SELECT 'classes', count(DISTINCT (platform, class)) FROM requests UNION ALL SELECT 'broken', 0)"),
    "q_load_filings": oracle("filings", body="SELECT fein, status, year::INTEGER AS year, count(*) AS n, (sum(positions) * 1000)::BIGINT AS positions, min(trim(title)) AS title FROM filings WHERE l_linenumber NOT IN (6, 7) GROUP BY 1, 2, 3"),
    "q_load_petitions": oracle("petitions", body="SELECT legal_norm AS name, fiscal_year, sum(a3 * 1000 + 200)::BIGINT AS a, max(tax_id) AS tax_id FROM petitions WHERE o_orderkey % 10 <> 0 AND o_orderkey % 9 <> 0 GROUP BY 1, 2"),
    "q_crawl_index": r"SELECT url, root FROM (SELECT *, CASE WHEN len(string_split(h, '.')) <= 2 THEN h ELSE array_to_string(string_split(h, '.')[-2:], '.') END AS root FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS h FROM pages)) WHERE page_id % 4 <> 0 AND page_id % 3 <> 0 AND page_id % 5 <> 0 AND root IN ('example.com', 'example.org')",
    "q_place_lookup": oracle("postings", body=f", p AS (SELECT job_id, ({_sql_list(_PLACES)})[job_id % 16 + 1] AS place, ({_sql_list(_SAID)})[job_id % 16 + 1] AS said FROM postings), g AS (SELECT * FROM (VALUES {', '.join(map(str, _CITIES))}) t(city, country)), f AS (SELECT place, bool_or(country = 'US') AS us FROM (SELECT DISTINCT place FROM p) JOIN g ON list_contains(string_split(lower(place), ' '), city) GROUP BY 1) SELECT job_id, coalesce(said, us, true) AS is_us FROM p LEFT JOIN f USING (place)"),
    "q_merge_titles": oracle("filings", body="SELECT * FROM (SELECT fein, title, count(*)::BIGINT AS n, row_number() OVER (PARTITION BY fein ORDER BY count(*) DESC, title)::INTEGER AS rank FROM filings GROUP BY 1, 2) WHERE rank <= 15"),
    "q_retention_rules": oracle("applications", "bridge", "requests", body=""", a AS (SELECT application_id AS id, CASE WHEN status = 'active' AND applied_on < DATE '1998-06-30' - 60 THEN 'closed' ELSE status END AS status FROM applications)
 SELECT 'applications' AS tbl, id, status FROM a UNION ALL SELECT 'application_recruiters', application_id, count(*)::VARCHAR FROM bridge WHERE application_id NOT IN (SELECT id FROM a WHERE status = 'closed') GROUP BY 2
 UNION ALL SELECT 'seen_job_ids', event_id, 'kept' FROM requests WHERE (user_id % 13 = 0 OR user_id % 3 = 0) AND ts >= TIMESTAMP '2024-04-15' - INTERVAL 90 DAY"""),
    "q_hash_known": oracle("postings", body=", h AS (SELECT job_id, CASE WHEN job_id % 9 <> 0 THEN md5(title) END AS c, md5('old ' || title) AS o FROM postings), k AS (SELECT c AS x FROM h WHERE job_id % 7 = 0 AND c IS NOT NULL UNION SELECT o FROM h WHERE job_id % 5 = 0) SELECT job_id, c IS NOT NULL AND (c IN (SELECT x FROM k) OR o IN (SELECT x FROM k)) AS known FROM h"),
    "q_listing": oracle("postings", body=_JOBS + " SELECT id, status FROM j WHERE status IN ('new', 'digested', 'filled') AND first_seen BETWEEN DATE '2024-01-03' AND DATE '2024-01-25' AND (title ILIKE '%tH%' OR company ILIKE '%tH%') AND ats = 'lever' ORDER BY first_seen DESC, id DESC LIMIT 2000"),
    "q_digest": oracle("postings", body=_JOBS + " SELECT id, company, score FROM j WHERE status = 'new' ORDER BY company, score DESC"),
    "q_missing": oracle("postings", body=_JOBS + " SELECT id, missing_days FROM j WHERE status NOT IN ('filled', 'expired', 'dismissed', 'applied') AND missing_days >= 8"),
    "q_top_occupations": oracle("filings", body="SELECT soc, count_if(status = 'Certified')::BIGINT AS certified FROM filings WHERE fein = '12-0000001' AND trim(soc) <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
    "q_pending_prospects": "SELECT c_custkey AS company, c_custkey % 5 AS priority FROM customer WHERE c_custkey % 3 = 0 ORDER BY 2 DESC, c_acctbal, 1 LIMIT 100",
    "q_hiring_title": oracle("postings", body="SELECT job_id, CASE WHEN regexp_matches(lower(text), 'ation|ungen') THEN 'auto' WHEN regexp_matches(lower(text), 'str|ll') THEN 'manual_review' END AS kind, regexp_matches(lower(text), 'qu|sch') AS excluded FROM postings"),
    "q_absolute_url": _ADDRESS,
    "q_company_slugs": "WITH w AS (SELECT p_partkey, list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part) SELECT p_partkey, array_to_string(list_filter([a, CASE WHEN b <> a THEN b END, CASE WHEN c NOT IN (a, b) THEN c END, CASE WHEN e NOT IN (a, b, c) THEN e END], lambda x: x <> ''), '|') AS slugs, array_to_string(list_filter(w, lambda x: length(x) >= 3), '|') AS words FROM (SELECT p_partkey, w, array_to_string(w, '') AS a, array_to_string(w, '-') AS b, w[1] AS c, array_to_string(w[1:2], '') AS e FROM w)",
    "q_compound_parts": """WITH n AS (SELECT p_partkey, p_name, lower(p_type) AS t, string_split(p_name, ' ') AS w, regexp_extract(p_brand, '[0-9]+$') AS b FROM part), c AS (SELECT *, array_to_string(w, '') AS j FROM n)
 SELECT p_partkey, array_to_string(list_sort(list_distinct([t || '_' || j || '-' || b, t, j || '-' || b, t || '_' || j, b] || w)), '|') AS parts, p_name || CASE WHEN length(p_name) % 2 = 0 THEN ' wd5' ELSE '' END AS said FROM c""",
    "q_detail_structure": """SELECT page_id, (['json', 'html_next', 'html_jsonld', NULL, 'html'])[page_id % 5 + 1] AS format, (['data.job', 'props.job'])[page_id % 5 + 1] AS path,
 CASE WHEN page_id % 5 < 3 THEN 'description=' || CASE WHEN length(url) > 50 THEN 'summary' ELSE 'blob' END || '|location=office|salary_object=pay|title=name' WHEN page_id % 5 = 4 THEN '' END AS fields FROM pages""",
    "q_cache_key": oracle("postings", body="SELECT job_id, sha256(coalesce(company, '') || '-' || coalesce(title, '') || '-' || coalesce(text, '')) AS key FROM postings"),
    "q_portal_slug": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^./]+)', 1) AS x FROM pages) SELECT page_id, coalesce(CASE page_id % 12 WHEN 0 THEN 'greenhouse ' || x WHEN 1 THEN 'greenhouse ' || x WHEN 2 THEN 'lever ' || x WHEN 3 THEN 'lever ' || x WHEN 4 THEN 'smartrecruiters ' || x WHEN 5 THEN 'workday ' || upper(x) || '/wd5/Careers' WHEN 6 THEN 'icims ' || x WHEN 7 THEN 'taleo ' || upper(x) || '/ex' WHEN 8 THEN 'ashby ' || x WHEN 9 THEN 'successfactors ' || upper(x) WHEN 10 THEN 'greenhouse ' || x END, '') AS found FROM p""",
    "q_value_role": "SELECT page_id, name, role FROM (SELECT page_id, html FROM pages) CROSS JOIN (VALUES ('link', 'url'), ('apply-url', 'url_apply'), ('note', 'long_text'), ('x', 'id'), ('posted', 'date'), ('job_title', 'title'), ('city', NULL), ('site', 'location')) t(name, role)",
    "q_detail_format": "SELECT page_id, (['json', 'html_next', 'html_jsonld', NULL, 'html'])[page_id % 5 + 1] AS format FROM pages",
    "q_records": f"SELECT company, page, 'data.edges[*].node' AS path, o_orderkey AS id, o_orderpriority AS title FROM {_R}",
    "q_field_roles": f"SELECT company, role, field, votes FROM (SELECT company, count(*) AS votes, count_if(o_orderkey >= 1000)::BIGINT AS ids FROM {_R} GROUP BY 1) CROSS JOIN (VALUES ('title', 'job_title'), ('url', 'link'), ('id', 'id'), ('location', 'city')) t(role, field) WHERE role <> 'id' UNION ALL SELECT company, 'id', CASE WHEN true THEN 'id' END, count(*) FROM {_R} GROUP BY 1",
    "q_ids_in_urls": f"SELECT company, 'key' AS field, count(*) AS votes FROM {_R} GROUP BY 1 HAVING count(*) >= 2 UNION ALL SELECT company, 'key', 1 FROM {_R} GROUP BY 1 HAVING count(*) = 1",
    "q_record_prints": f"SELECT company, page, count(DISTINCT o_orderstatus) AS n, min(sha256('city:' || o_orderstatus)) AS first FROM {_R} GROUP BY 1, 2",
    "q_pagination": oracle("polls", body="""SELECT user_id AS company, CASE WHEN user_id % 4 = 0 THEN 'offset' WHEN user_id % 4 = 1 THEN 'page' WHEN user_id % 4 = 2 THEN 'cursor' ELSE 'none' END AS type, CASE user_id % 4 WHEN 0 THEN 'offset' WHEN 1 THEN 'page' WHEN 2 THEN 'next' END AS param,
 CASE WHEN user_id % 4 = 0 THEN 100 WHEN user_id % 8 = 1 THEN 250 ELSE 25 END::BIGINT AS page_size, CASE WHEN user_id % 4 = 0 THEN 'url' WHEN user_id % 8 = 1 THEN 'body' WHEN user_id % 4 = 1 THEN 'url' END AS location, CASE WHEN user_id % 4 < 2 THEN 'meta.total_count' END AS total_field FROM (SELECT DISTINCT user_id FROM polls)"""),
    "q_deep_find": "WITH e AS (SELECT event_id, event_id % 6 AS n, json_extract_string(props, '$.k') AS k FROM events) SELECT event_id, CASE n WHEN 0 THEN k WHEN 1 THEN k WHEN 2 THEN '-1' WHEN 3 THEN '{\"k\":1}' END AS k, CASE WHEN n = 3 THEN k END AS at, CASE WHEN n = 1 THEN k END AS item FROM e",
    "q_adapters": oracle("postings", body=f"SELECT ats, company, job_id::VARCHAR AS job_id, 'Job ' || job_id AS title, CASE WHEN ats IN ({_has('url', 'job_url')}) THEN 'https://x.org/j/' || job_id END AS job_url, CASE WHEN ats IN ({_has('location', 'location')}) THEN 'City ' || job_id % 9 END AS location FROM postings CROSS JOIN (SELECT unnest({_sql_list(adapters.SOURCES)}) AS ats)"),
    "q_feed": oracle("postings", body="SELECT company, job_id::VARCHAR AS job_id, 'Dev & ' || job_id AS title, 'https://x.org/j/' || job_id AS job_url, 'Mountain View, CA, USA' AS location, '2024-01-05' AS day FROM postings"),
    "q_sitemap": r"""WITH p AS (SELECT DISTINCT url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') AS path FROM pages WHERE url IS NOT NULL AND regexp_matches(url, '/(?:en|fr)/') AND (lower(regexp_extract(url, '(?i)^https?://[^/]+/([a-z]{2})(?:[-_][a-z]{2})?/', 1)) IN ('', 'en')))
 SELECT url AS job_url, nullif(CASE WHEN regexp_matches(regexp_extract(path, '([^/]*)$', 1), '^[0-9-]*$') THEN regexp_extract(path, '([^/]*)/[^/]*$', 1) ELSE regexp_extract(path, '([^/]*)$', 1) END, '') AS title, regexp_extract(path, '([^/]*)$', 1) AS job_id FROM p""",
    "q_links": r"""SELECT page_id::VARCHAR AS company, (page_id + 10000)::VARCHAR AS job_id, 'Dev &Ops' AS title, CASE WHEN page_id % 5 = 0 THEN regexp_extract(url, '^[a-z]+://[^/?#]*') ELSE 'https://x.org' END || '/jobs/' || (page_id + 10000) || '/dev' AS job_url, 'icims' AS ats FROM pages WHERE url IS NOT NULL""",
}

ORACLE_SQL["q_load_workbooks"] = ORACLE_SQL["q_load_filings"]
as_text(QUERIES, ORACLE_SQL, {})
