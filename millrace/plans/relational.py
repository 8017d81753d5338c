"""Relational, filing, dedup and text queries, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import bloom as B
from ..operators import dedup as D
from ..operators import filings as L
from ..operators import funnel as N
from .roles import AS_OF, AS_OF_ORDERS, as_text, oracle, role


def _abr(s, d):
    """The bridge, by far the largest of the three, is dealt to tasks by its applications."""
    return [role(s, d, "applications"), role(s, d, "bridge", lineitem="l_orderkey"), role(s, d, "recruiters")]


def _companies(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("company")).distinct()


def _seen(s, d):
    return role(s, d, "applications").select("company", F.col("applied_on").alias("seen_on"))


def _cache(s, d):
    return role(s, d, "applications").where("application_id % 3 = 0").select("company", "user_id", F.date_add("applied_on", 365).alias("expires_on")).distinct()


def _named(s, d):
    e = role(s, d, "employers").select("fein", F.col("legal_norm").alias("name"))
    return e.join(L.employers(role(s, d, "filings")).select("fein", "certified"), "fein")


def _quarter(s, d, part):
    return role(s, d, "filings").where(F.col("l_orderkey") % 3 == part)


def _merged(s, d):
    empty = L.employers(_quarter(s, d, 0)).withColumn("batches", F.array(F.lit("b0")))
    first = L.merge(empty, L.employers(_quarter(s, d, 1)), "b1")
    again = L.merge(first, L.employers(_quarter(s, d, 1)), "b1")
    rows = L.merge(again, L.employers(_quarter(s, d, 2)), "b2")
    return rows.withColumn("batches", F.array_join("batches", ","))


def _diff(s, d):
    rows = s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")
    old = rows.where("s_suppkey % 5 <> 0").select("s_suppkey", F.col("s_nationkey").alias("m"), (F.col("s_suppkey") % 2 == 0).alias("queued"))
    new = rows.where("s_suppkey % 7 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") + 1).otherwise(F.col("s_nationkey")).alias("m"))
    return D.snapshot_diff(old, new, ["s_suppkey"], "m", "queued")


def _orders(s, d, status):
    return s.read.parquet(f"{d}/orders.parquet").where(F.col("o_orderstatus") == status).select("o_custkey")


def _pages(s, d):
    return s.read.parquet(f"{d}/pages.parquet")


def _postings(s, d):
    return role(s, d, "postings")


def _hash():
    return D.content_hash(F.col("company"), F.col("title"), F.col("location"), F.col("job_id").cast("string"))

def _buffer(s, d):
    """Orders as found addresses, customers as companies and as their stored contacts."""
    o, c = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/customer.parquet")
    n = F.when(F.col("o_totalprice") < 400000, F.col("o_custkey") % 7).otherwise(F.col("o_orderkey") % 7)
    found = o.select(F.col("o_custkey").alias("company"), F.concat(F.lit("A"), F.col("o_orderkey") % 5000, F.lit("@c"), n, F.lit(".com")).alias("email"))
    stored = c.select(F.col("c_custkey").alias("contact_id"), F.col("c_custkey").alias("company"), F.concat(F.lit("a"), "c_custkey", F.lit("@c"), F.col("c_nationkey") % 7, F.lit(".org")).alias("email"), F.when((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") == "BUILDING"), "active").otherwise("gone").alias("status"))
    told = c.where("c_mktsegment <> 'MACHINERY'").select(F.col("c_custkey").alias("company"), F.concat(F.lit("c"), F.col("c_custkey") % 7).alias("root"))
    return N.checked_buffer(found, stored, told)


QUERIES = {
    "q_buffer_check": _buffer,
    "q_pending_join": lambda s, d: N.pending(*_abr(s, d)),
    "q_shortage_rows": lambda s, d: N.shortage_rows(*_abr(s, d), 3),
    "q_shortage_group": lambda s, d: N.shortage_group(*_abr(s, d), 4),
    "q_sendable": lambda s, d: N.sendable(*_abr(s, d)),
    "q_company_activity": lambda s, d: N.company_activity(_companies(s, d), _seen(s, d), AS_OF_ORDERS),
    "q_anti_missing": lambda s, d: N.anti_missing(role(s, d, "applications"), _cache(s, d), AS_OF_ORDERS),
    "q_new_ids": lambda s, d: N.new_ids(role(s, d, "requests").where("date = '2024-01-25'"), role(s, d, "requests").where("date = '2024-01-24'"), "platform", "user_id"),
    "q_employer_search": lambda s, d: N.employer_search(_named(s, d), L.by_soc(role(s, d, "filings")).select("fein", "soc"), "supplier", "%PROMO%", 1, 25),
    "q_funnel": lambda s, d: N.funnel(role(s, d, "stages")),
    "q_latest_stage": lambda s, d: N.latest_stage(role(s, d, "stages")),
    "q_queue_buckets": lambda s, d: N.queue_buckets(role(s, d, "requests").groupBy("user_id").agg(F.max(F.when(F.col("class") != "ok", F.col("date"))).alias("checked_on")), AS_OF),
    "q_daily_trend": lambda s, d: N.daily_trend(role(s, d, "requests"), "ts", AS_OF, 20),
    "q_slug_sets": lambda s, d: N.slug_sets(_pages(s, d).select(T.slug(F.col("url")).alias("x")).select("x.platform", "x.slug")),
    "q_tier": lambda s, d: role(s, d, "requests").groupBy("user_id").agg(F.max("date").alias("last")).select("user_id", N.tier(F.date_sub("last", (F.col("user_id") % 90).cast("int")), AS_OF).alias("tier")),
    "q_domain_consistency": lambda s, d: N.domain_consistency(role(s, d, "petitions").select("c_custkey", F.right("legal_norm", F.lit(1)).alias("domain"), (F.col("o_orderkey") % 10).cast("string").alias("expected")), "c_custkey", "domain", "expected"),
    "q_top_recruiters": lambda s, d: N.top_members(role(s, d, "recruiters"), "nation", F.col("status") == "active", ["recruiter_id"], 3).select("nation", "recruiter_id", "rank"),
    "q_lca_employer": lambda s, d: L.employers(role(s, d, "filings")),
    "q_lca_top_titles": lambda s, d: L.top_titles(role(s, d, "filings")),
    "q_lca_soc": lambda s, d: L.by_soc(role(s, d, "filings")),
    "q_lca_yearly": lambda s, d: L.by_year(role(s, d, "filings")),
    "q_incremental_merge": _merged,
    "q_upsert_latest": lambda s, d: L.upsert_latest(role(s, d, "petitions").select("legal_norm", "tax_id", F.when(F.col("fiscal_year") % 2 == 0, F.col("fiscal_year")).alias("fy"), "o_orderkey"), ["legal_norm", "tax_id", "fy"], [F.desc("o_orderkey")]),
    "q_entity_unmatched": lambda s, d: L.unmatched(role(s, d, "petitions"), role(s, d, "employers")),
    "q_entity_yearly": lambda s, d: L.yearly(role(s, d, "petitions"), role(s, d, "employers")),
    "q_top_entities": lambda s, d: L.top_entities(L.employers(role(s, d, "filings")).select("fein", "certified"), L.yearly(role(s, d, "petitions"), role(s, d, "employers")), 20),
    "q_content_hash": lambda s, d: _postings(s, d).select("job_id", _hash().alias("content_hash"), D.content_hash(F.col("company"), F.col("title"), F.col("location")).alias("legacy_hash")),
    "q_dedup_first": lambda s, d: D.first_of(_postings(s, d).select("job_id", D.content_hash(F.col("company"), F.col("title"), F.col("location")).alias("h")), "h", ["job_id"]),
    "q_snapshot_diff": _diff,
    "q_generations": lambda s, d: B.generations(role(s, d, "requests").where("event_id % 3 <> 0"), role(s, d, "requests").where("event_id % 3 <> 1"), "date", "user_id"),
    "q_generation_diff": lambda s, d: D.generation_diff(role(s, d, "requests").where("date = '2024-01-03'"), role(s, d, "requests").where("date = '2024-01-04'"), "platform", "user_id"),
    "q_retention": lambda s, d: D.retention(role(s, d, "applications"), AS_OF_ORDERS, "status", "applied_on", {"closed": 365, "exhausted": 1000}).select("application_id", "status"),
    "q_union_tiers": lambda s, d: D.union_tiers(_orders(s, d, "O"), _orders(s, d, "F"), "o_custkey"),
    "q_intersect": lambda s, d: _orders(s, d, "O").intersect(_orders(s, d, "P")),
    "q_except": lambda s, d: _orders(s, d, "O").exceptAll(_orders(s, d, "P")).distinct().join(_orders(s, d, "P"), "o_custkey", "left_anti"),
    "q_normalize_text": lambda s, d: _postings(s, d).select("job_id", T.normalize(F.col("title")).alias("normal")),
    "q_ngrams": lambda s, d: _postings(s, d).select("job_id", F.array_join(T.ngrams(F.split(T.normalize(F.col("title")), " ")), "|").alias("grams")),
    "q_norm_entity": lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", T.entity_name(F.concat(F.lit("The "), "s_name", F.lit(" & Sons U S Svcs Ltd d/b/a Acme"))).alias("legal"), T.entity_name(F.concat("s_name", F.lit(" Intl DBA X")), False).alias("brand")),
    "q_url_id": lambda s, d: _pages(s, d).select("page_id", T.url_id(F.col("url")).alias("job_id")),
    "q_extract_slug": lambda s, d: _pages(s, d).select("page_id", T.slug(F.col("url")).alias("x")).select("page_id", "x.platform", "x.slug"),
    "q_parse_dates": lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'MM/dd/yyyy') WHEN 2 THEN date_format(o_orderdate, 'MMMM d, yyyy') ELSE cast(unix_seconds(cast(o_orderdate as timestamp)) * 1000 as string) END").alias("v")).select("o_orderkey", T.parse_date(F.col("v")).cast("timestamp_ntz").alias("parsed_at")),
    "q_clean_html": lambda s, d: _pages(s, d).select("page_id", T.clean_html(F.col("html")).alias("text")),
    "q_jsonld": lambda s, d: _pages(s, d).select("page_id", T.json_ld(F.concat(F.lit('<script type="application/ld+json">{"@type": "JobPosting", "id": '), F.col("page_id").cast("string"), F.lit("}</script>"), "html"), "JobPosting").alias("ld")).select("page_id", F.get_json_object("ld", "$.id").alias("id")),
    "q_salary": lambda s, d: role(s, d, "applications").select("application_id", T.salary(F.concat(F.lit("pays $"), F.round("expected").cast("bigint").cast("string"), F.lit(" to $150k, or $90,000 and $"), (F.col("application_id") % 2000).cast("string"))).alias("x")).select("application_id", "x.low", "x.high"),
}

_ACTIVE = ", act AS (SELECT b.application_id, count(DISTINCT recruiter_id) AS n FROM bridge b JOIN recruiters r USING (recruiter_id) WHERE r.status = 'active' GROUP BY 1), na AS (SELECT a.*, coalesce(n, 0) AS n_active FROM applications a LEFT JOIN act USING (application_id) WHERE a.status = 'active')"
_ABR = ("applications", "bridge", "recruiters")
_EMP = """SELECT fein, count(*) AS filed, count_if(status = 'Certified')::BIGINT AS certified, count_if(status = 'Denied')::BIGINT AS denied, count_if(status = 'Withdrawn')::BIGINT AS withdrawn, sum(positions)::BIGINT AS positions,
 coalesce(sum(CASE WHEN status = 'Certified' THEN positions END), 0)::BIGINT AS certified_positions, round(100.0::DOUBLE * count_if(status = 'Certified') / count(*), 1) AS certification_rate"""
_ORD = "(decided, l_orderkey, l_linenumber, l_partkey, l_extendedprice)"
_FIT = "tax_id = right(fein, 4) AND (p.legal_norm = e.legal_norm OR p.full_norm = e.dba_norm)"
_ACC = "translate(lower({x}), 'àáâäèéêëìíîïòóôöùúûüñç', 'aaaaeeeeiiiioooouuuunc')"
_NORM = r"trim(regexp_replace(" + _ACC + r", '\s+', ' ', 'g'))"
_N = lambda x: _NORM.replace("{x}", x)
_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_SLUG = f"""(SELECT page_id, nullif(split_part(host, '.', -2), '') AS platform, coalesce(nullif(regexp_extract(host, '^(?:www\\.|m\\.|blog\\.)?([^.]+)\\.[^.]+\\.[^.]+$', 1), ''), nullif(regexp_extract(path, '^/([^/]+)', 1), '')) AS slug FROM (SELECT page_id, {_HOST} AS host, {_PATH} AS path FROM pages))"""


def _entity(x: str, strip: bool) -> str:
    out = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(upper({x}), '''', ''), '&', ' ', 'g'), '\bAND\b', ' ', 'g'), '[^A-Z0-9 ]', ' ', 'g'), '\s+', ' ', 'g'))"
    out = rf"regexp_replace({out}, '^THE ', '')"
    if strip:
        out = rf"regexp_replace({out}, ' D B A .*$', '')"
    # single letters joined, for the one pair that these names have
    out = rf"regexp_replace({out}, '\bU S\b', 'US', 'g')"
    for a, b in T.ABBREVIATIONS.items():
        out = rf"regexp_replace({out}, '\b{a}\b', '{b}', 'g')"
    return out


ORACLE_SQL = {
    "q_buffer_check": """WITH b AS (SELECT DISTINCT o_custkey AS company, 'c' || CASE WHEN o_totalprice < 400000 THEN o_custkey % 7 ELSE o_orderkey % 7 END AS root, 'a' || o_orderkey % 5000 || '@' || root || '.com' AS email FROM orders),
 k AS (SELECT b.*, CASE WHEN c_acctbal > 0 AND c_mktsegment = 'BUILDING' THEN 'c' || c_nationkey % 7 WHEN c_mktsegment <> 'MACHINERY' THEN 'c' || c_custkey % 7 END AS reference FROM b LEFT JOIN customer ON company = c_custkey)
 SELECT company, email, reference, CASE WHEN reference IS NULL THEN 'trusted' WHEN n = 1 THEN CASE WHEN hits > 0 THEN 'consistent' ELSE 'conflict' END WHEN hits > 0 THEN 'tiebreak' ELSE 'unmatched' END AS verdict, coalesce(root = reference, true) AS kept
 FROM k JOIN (SELECT company, count(DISTINCT root) AS n, count_if(root = reference) AS hits FROM k GROUP BY 1) USING (company)""",
    "q_pending_join": oracle(*_ABR, body="SELECT a.application_id, user_id, company, recruiter_id, name FROM applications a JOIN bridge b USING (application_id) JOIN recruiters r USING (recruiter_id) WHERE a.status = 'active' AND r.status = 'active'"),
    "q_shortage_rows": oracle(*_ABR, body=_ACTIVE + " SELECT company, min(application_id) AS first_application, count(*) AS n_applications FROM na WHERE n_active < 3 GROUP BY 1"),
    "q_shortage_group": oracle(*_ABR, body=_ACTIVE + " SELECT application_id, company, n_active, (4 - n_active)::BIGINT AS shortage, applied_on FROM na WHERE n_active < 4"),
    "q_sendable": oracle(*_ABR, body=_ACTIVE + " SELECT applied_on, count(*) AS sendable FROM na WHERE n_active > 0 GROUP BY 1"),
    "q_company_activity": oracle("applications", body="SELECT company, count_if(applied_on >= DATE '2001-12-01' - 30)::BIGINT AS last_30d, count_if(applied_on >= DATE '2001-12-01' - 7)::BIGINT AS last_7d, count(applied_on) AS total, max(applied_on) AS latest FROM (SELECT DISTINCT c_mktsegment AS company FROM customer) LEFT JOIN applications USING (company) GROUP BY 1"),
    "q_anti_missing": oracle("applications", body="SELECT application_id, company, user_id FROM applications a WHERE NOT EXISTS (SELECT 1 FROM applications c WHERE c.application_id % 3 = 0 AND c.applied_on + 365 > DATE '2001-12-01' AND c.company IS NOT DISTINCT FROM a.company AND c.user_id IS NOT DISTINCT FROM a.user_id)"),
    "q_new_ids": oracle("requests", body="SELECT platform, user_id FROM requests WHERE date = '2024-01-25' EXCEPT SELECT platform, user_id FROM requests WHERE date = '2024-01-24'"),
    "q_employer_search": oracle("filings", "employers", body="SELECT fein, legal_norm AS name, certified FROM employers JOIN (SELECT fein, count_if(status = 'Certified')::BIGINT AS certified FROM filings GROUP BY 1) USING (fein) WHERE legal_norm ILIKE '%supplier%' AND certified >= 1 AND fein IN (SELECT fein FROM filings WHERE soc LIKE '%PROMO%') ORDER BY certified DESC, fein LIMIT 25"),
    "q_funnel": oracle("stages", body="SELECT count_if(status = 'sent')::BIGINT AS sent, count_if(status = 'sent' AND stage = 'initial')::BIGINT AS initial, count_if(status = 'sent' AND stage = 'followup1')::BIGINT AS followup1, count_if(status = 'sent' AND stage = 'followup2')::BIGINT AS followup2, count(DISTINCT CASE WHEN status = 'sent' THEN conv_id END) AS reached, count(DISTINCT conv_id) AS total FROM stages"),
    "q_latest_stage": oracle("stages", body="SELECT conv_id, max_by(stage, turn) AS stage, max(turn) AS turn FROM stages WHERE status = 'sent' GROUP BY 1"),
    "q_queue_buckets": oracle("requests", body=", q AS (SELECT user_id, DATE '2024-01-31' - max(CASE WHEN class <> 'ok' THEN date END) AS age FROM requests GROUP BY 1) SELECT count_if(age IS NULL)::BIGINT AS never, count_if(age <= 1)::BIGINT AS day, count_if(age > 1 AND age <= 7)::BIGINT AS week, count_if(age > 7)::BIGINT AS older, count(*) AS total FROM q"),
    "q_daily_trend": oracle("requests", body="SELECT date AS day, count(*) AS n FROM requests WHERE date >= DATE '2024-01-31' - 20 GROUP BY 1"),
    "q_slug_sets": f"SELECT platform, count(DISTINCT slug) AS n_slugs, count(*) AS n_urls FROM {_SLUG} WHERE platform IS NOT NULL AND slug IS NOT NULL GROUP BY 1",
    "q_tier": oracle("requests", body="SELECT user_id, CASE WHEN age < 30 THEN 1 WHEN age < 60 THEN 2 ELSE 3 END AS tier FROM (SELECT user_id, DATE '2024-01-31' - (max(date) - (user_id % 90)::INTEGER) AS age FROM requests GROUP BY 1)"),
    "q_domain_consistency": oracle("petitions", body="SELECT c_custkey, n_domains, n, CASE WHEN n_expected = n THEN 'expected' WHEN n_domains = 1 THEN 'other' WHEN n_expected * 2 > n THEN 'mostly_expected' ELSE 'conflict' END AS verdict FROM (SELECT c_custkey, count(DISTINCT right(legal_norm, 1)) AS n_domains, count(*) AS n, count_if(right(legal_norm, 1) = (o_orderkey % 10)::VARCHAR) AS n_expected FROM petitions GROUP BY 1)"),
    "q_top_recruiters": oracle("recruiters", body="SELECT nation, recruiter_id, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY CASE WHEN status = 'active' THEN 0 ELSE 1 END, recruiter_id) AS rank FROM recruiters) WHERE rank <= 3"),
    "q_lca_employer": oracle("filings", body=f"{_EMP}, max_by(employer_state, {_ORD}) AS state, max_by(soc, {_ORD}) AS last_soc FROM filings GROUP BY 1"),
    "q_lca_top_titles": oracle("filings", body="SELECT fein, title, n, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY fein ORDER BY n DESC, title) AS rank FROM (SELECT fein, title, count(*) AS n FROM filings WHERE trim(title) <> '' GROUP BY 1, 2)) WHERE rank <= 15"),
    "q_lca_soc": oracle("filings", body="SELECT fein, soc, count(*) AS filed, count_if(status = 'Certified')::BIGINT AS certified, min_by(title, (decided, l_orderkey, l_linenumber, l_partkey, l_extendedprice, title)) AS first_title FROM filings WHERE trim(soc) <> '' GROUP BY 1, 2"),
    "q_lca_yearly": oracle("filings", body="SELECT fein, year::INTEGER AS year, count(*) AS filed, count_if(status = 'Certified')::BIGINT AS certified, sum(positions)::BIGINT AS positions FROM filings WHERE year <> 0 GROUP BY 1, 2"),
    "q_incremental_merge": oracle("filings", body=f"{_EMP}, array_to_string(list_sort(list_distinct(list('b' || (l_orderkey % 3)))), ',') AS batches FROM filings GROUP BY 1"),
    "q_upsert_latest": oracle("petitions", body="SELECT legal_norm, tax_id, coalesce((CASE WHEN fiscal_year % 2 = 0 THEN fiscal_year END)::VARCHAR, '') AS fy, max(o_orderkey) AS o_orderkey FROM petitions GROUP BY 1, 2, 3"),
    "q_entity_unmatched": oracle("petitions", "employers", body=f"SELECT legal_norm, tax_id, count(*) AS n, {', '.join(f'sum({a})::BIGINT AS {a}' for a in L.APPROVALS)} FROM petitions p WHERE NOT EXISTS (SELECT 1 FROM employers e WHERE {_FIT}) GROUP BY 1, 2"),
    "q_entity_yearly": oracle("petitions", "employers", body=f"SELECT fein, fiscal_year::INTEGER AS fiscal_year, count(*) AS n, sum({' + '.join(L.APPROVALS)})::BIGINT AS approvals FROM petitions p JOIN employers e ON {_FIT} GROUP BY 1, 2"),
    "q_top_entities": oracle("filings", "petitions", "employers", body=f"SELECT fein, coalesce(approvals, certified) AS measure, approvals IS NOT NULL AS has_petitions FROM (SELECT fein, count_if(status = 'Certified')::BIGINT AS certified FROM filings GROUP BY 1) LEFT JOIN (SELECT fein, sum({' + '.join(L.APPROVALS)})::BIGINT AS approvals FROM petitions p JOIN employers e ON {_FIT} GROUP BY 1) USING (fein) ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20"),
    "q_content_hash": oracle("postings", body=f"SELECT job_id, CASE WHEN company <> '' AND title <> '' THEN sha256({_N('company')} || '|' || {_N('title')} || '|' || {_N('location')} || '|' || job_id) END AS content_hash, CASE WHEN company <> '' AND title <> '' THEN sha256({_N('company')} || '|' || {_N('title')} || '|' || {_N('location')}) END AS legacy_hash FROM postings"),
    "q_dedup_first": oracle("postings", body=f"SELECT min(job_id) AS job_id, h FROM (SELECT job_id, CASE WHEN company <> '' AND title <> '' THEN sha256({_N('company')} || '|' || {_N('title')} || '|' || {_N('location')}) END AS h FROM postings) GROUP BY h, CASE WHEN h IS NULL THEN job_id END"),
    "q_snapshot_diff": "SELECT s_suppkey, coalesce(n.m, o.m)::INTEGER AS m, coalesce(queued, false) AS queued, CASE WHEN n.m IS NULL THEN 'delete' WHEN o.m IS NULL THEN 'insert' WHEN n.m = o.m THEN 'keep' ELSE 'update' END AS change FROM (SELECT s_suppkey, s_nationkey AS m, s_suppkey % 2 = 0 AS queued FROM supplier WHERE s_suppkey % 5 <> 0) o FULL JOIN (SELECT s_suppkey, s_nationkey + CASE WHEN s_suppkey % 3 = 0 THEN 1 ELSE 0 END AS m FROM supplier WHERE s_suppkey % 7 <> 0) n USING (s_suppkey)",
    "q_generations": oracle("requests", body=", a AS (SELECT DISTINCT date, user_id FROM requests WHERE event_id % 3 <> 0), b AS (SELECT DISTINCT date, user_id FROM requests WHERE event_id % 3 <> 1) SELECT *, 'appeared' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'vanished' FROM (FROM a EXCEPT FROM b)"),
    "q_generation_diff": oracle("requests", body=", a AS (SELECT DISTINCT platform, user_id FROM requests WHERE date = '2024-01-03'), b AS (SELECT DISTINCT platform, user_id FROM requests WHERE date = '2024-01-04') SELECT *, 'appeared' AS change FROM (FROM b EXCEPT FROM a) UNION ALL SELECT *, 'vanished' FROM (FROM a EXCEPT FROM b)"),
    "q_retention": oracle("applications", body="SELECT application_id, status FROM applications WHERE CASE status WHEN 'closed' THEN DATE '2001-12-01' - applied_on <= 365 WHEN 'exhausted' THEN DATE '2001-12-01' - applied_on <= 1000 ELSE true END"),
    "q_union_tiers": "SELECT o_custkey, min(t)::INTEGER AS tier FROM (SELECT o_custkey, 1 AS t FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, 2 FROM orders WHERE o_orderstatus = 'F') GROUP BY 1",
    "q_intersect": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "q_except": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    "q_normalize_text": oracle("postings", body=f"SELECT job_id, {_N('title')} AS normal FROM postings"),
    "q_ngrams": oracle("postings", body=f", w AS (SELECT job_id, string_split({_N('title')}, ' ') AS w FROM postings) SELECT job_id, array_to_string(flatten(list_transform([1, 2, 3], lambda n: list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' ')))), '|') AS grams FROM w"),
    "q_norm_entity": "SELECT s_suppkey, " + _entity("'The ' || s_name || ' & Sons U S Svcs Ltd d/b/a Acme'", True) + " AS legal, " + _entity("s_name || ' Intl DBA X'", False) + " AS brand FROM supplier",
    "q_url_id": "SELECT page_id, coalesce(" + ", ".join(f"nullif(regexp_extract(p, '{x}', 1), '')" for x in T.ID_PATTERNS) + f", '') AS job_id FROM (SELECT page_id, {_PATH} AS p FROM pages)",
    "q_extract_slug": f"SELECT page_id, CASE WHEN slug IS NOT NULL THEN platform END AS platform, CASE WHEN platform IS NOT NULL THEN slug END AS slug FROM {_SLUG}",
    "q_parse_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN o_orderdate ELSE o_orderdate::DATE::TIMESTAMP END AS parsed_at FROM orders",
    "q_clean_html": r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<script\b.*?</script\s*>', ' ', 'g'), '(?is)<style\b.*?</style\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""",
    "q_jsonld": "SELECT page_id, page_id::VARCHAR AS id FROM pages",
    "q_salary": oracle("applications", body="SELECT application_id, s[1] AS low, s[2] AS high FROM (SELECT application_id, list_sort(list_distinct(list_filter([round(expected)::BIGINT, 150000, 90000, application_id % 2000], lambda x: x >= 1000))) AS s FROM applications)"),
}

as_text(QUERIES, ORACLE_SQL, {"q_generations": ["date"], "q_shortage_group": ["applied_on"], "q_sendable": ["applied_on"], "q_company_activity": ["latest"], "q_daily_trend": ["day"], "q_parse_dates": ["parsed_at"]})
