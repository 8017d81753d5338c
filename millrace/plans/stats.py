"""Queries of totals, catalogue lookups and checks of queues and workers, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as A
from .roles import AS_OF, as_text, oracle, role


def _recruiters(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.when(F.col("o_orderstatus") == "F", "active").otherwise("gone").alias("status"), F.col("o_orderdate").cast("date").alias("created_at"), (F.col("o_custkey") % 70).alias("company"))


def _verified(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    return o.select(F.when(F.col("o_orderstatus") == "P", "inactive").otherwise("active").alias("status"), F.col("o_orderdate").cast("date").alias("verified_at"))


def _catalogue(s, d):
    p, n = s.read.parquet(f"{d}/part.parquet"), F.col("p_partkey")
    return p.select(n.alias("place"), F.col("p_name").alias("company"), F.concat(F.lit("p"), (n % 4).cast("string")).alias("platform"), F.concat(F.lit("s"), n.cast("string")).alias("slug"), (n % 5 != 0).alias("active"), (n % 3 == 0).alias("enriched"), F.when(n % 2 == 0, "detection").otherwise("crawl").alias("source"))


def _runs(s, d):
    day = F.col("date")
    tries = role(s, d, "requests").select(day.alias("day"), F.when(F.col("class") == "ok", "found").when(F.col("class") == "404", "exhausted").otherwise("failed").alias("status")).where("day >= DATE '2024-01-05'")
    apps = role(s, d, "requests").where("date <= DATE '2024-01-20' AND context <> 'normal'").select(day.alias("day"), (F.col("ms") > 1000).alias("sendable"))
    return A.run_metrics(tries, apps)


def _beats(s, d):
    kinds = F.array(*map(F.lit, A.SILENT))
    return role(s, d, "requests").select(F.element_at(kinds, (F.col("user_id") % len(A.SILENT) + 1).cast("int")).alias("kind"), F.col("user_id").alias("worker"), "ts")


def _snapshots(s, d, date):
    rows = role(s, d, "requests").where(F.col("date") == date).groupBy(F.col("platform").alias("queue"))
    return rows.agg(F.count_if(F.col("class") != "ok").alias("depth"), F.max("ms").alias("oldest_s"))


def _addressed(s, d):
    """Pages with their address's host, its first folder (a language), and whether it is https."""
    return s.read.parquet(f"{d}/pages.parquet").withColumns({"host": F.regexp_extract("url", "://([^/]+)", 1), "lang": F.regexp_extract("url", "://[^/]+/([a-z]+)/", 1), "secure": F.startswith("url", F.lit("https"))})


def _slug(s, d):
    """Hosts as slugs: JSON with a path or a shard for https, plain or none for others; languages as platforms."""
    queried = F.contains("url", F.lit("?"))
    slug = F.when(F.col("secure"), F.when(queried, F.to_json(F.struct(F.col("host").alias("slug"), F.col("lang").alias("path")))).otherwise(F.to_json(F.struct(F.col("host").alias("slug"), F.concat(F.lit("wd"), F.length("host")).alias("wd"))))).when(~F.contains("url", F.lit("#")), F.col("host"))
    platform = F.when(F.col("lang") == "en", "workday").when(F.col("lang") == "de", "oracle_hcm").when(F.col("lang") == "es", "lever").otherwise("custom")
    return _addressed(s, d).select("page_id", platform.alias("platform"), slug.alias("slug"))


_PLATFORMS = ("icims", "taleo", "workday", "sitemap", "custom", "lever")


def _details(s, d):
    """What each page's address tells of a posting."""
    part = lambda pattern: F.regexp_extract("url", pattern, 1)
    known = {
        "base_url": F.when(F.col("secure"), F.col("host")).otherwise(""), "contest_no": part(r"[?&]page=(\d+)"), "external_path": part("://[^/]+(/[^?#]*)"), "slug": part(r"://([^./]+)"), "wd": part("#(.*)$"), "path": F.col("lang"),
        "job_url": F.when(~F.endswith("url", F.lit(".html")), F.col("url")).otherwise(""), "feed_type": F.when(F.contains("url", F.lit("utm_source")), "xml").otherwise(""), "detail": F.col("host"), "description": F.when(F.length("html") > 3000, "d").otherwise(""),
    }
    job = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)])
    platform = F.element_at(F.array(*map(F.lit, _PLATFORMS)), (F.length("host") % 6 + 1).cast("int"))
    return _addressed(s, d).select("page_id", A.fetch_detail(platform, F.length("html") % 11 != 0, job).alias("fetch"))


#: Some countries by their three letters and their two.
_CODES = (("and", "ad"), ("are", "ae"), ("che", "ch"), ("can", "ca"), ("per", "pe"), ("est", "ee"), ("tha", "th"), ("ind", "in"), ("ira", "ir"), ("les", ""), ("mar", "ma"), ("sen", "sn"), ("ven", "ve"))


def _codes(s, d):
    """How often each country's three letters are a word of a text."""
    words = role(s, d, "postings").select(F.explode(F.split("text", " ")).alias("word"))
    return words.select(A.alpha2(F.col("word"), [(a, b, "") for a, b in _CODES]).alias("code")).groupBy("code").agg(F.count("*").alias("words"))


QUERIES = {
    "q_find_stats": lambda s, d: A.found(_recruiters(s, d), "1996-01-01"),
    "q_verify_stats": lambda s, d: A.verified(_verified(s, d), "1996-01-01"),
    "q_enrichment": lambda s, d: A.enrichment(_catalogue(s, d)),
    "q_slug_stats": lambda s, d: A.slug_stats(_catalogue(s, d)),
    "q_cache_stats": lambda s, d: A.cache_stats(_catalogue(s, d)),
    "q_run_metrics": _runs,
    "q_send_totals": lambda s, d: A.send_totals(role(s, d, "stages").select("stage", "status", (F.col("size") % 3 == 0).alias("replied"))),
    "q_application_recruiters": lambda s, d: A.recruiters_of(role(s, d, "applications").where("company = 'BUILDING'"), role(s, d, "bridge"), role(s, d, "recruiters")).select("application_id", "recruiter_id", "name"),
    "q_first_match": lambda s, d: A.first_match(s.read.parquet(f"{d}/part.parquet").select(F.substring_index("p_name", " ", -2).alias("name")), _catalogue(s, d)),
    "q_plain_company": lambda s, d: role(s, d, "recruiters").select("recruiter_id", A.plain_company(F.concat(F.upper("name"), F.lit(",  Inc. - X"))).alias("plain"), A.email_fits(F.concat(F.lit("a@"), F.lower(F.replace("name", F.lit("#"), F.lit("."))), F.lit(".com")), F.when(F.col("recruiter_id") % 2 == 0, "supplier").otherwise("other")).alias("fits")),
    "q_alpha2": _codes,
    "q_slug_config": lambda s, d: _slug(s, d).select("page_id", *[F.element_at(A.slug_config(F.col("platform"), F.col("slug")), F.lit(k)).alias(k) for k in ("slug", "wd", "path", "site")]),
    "q_fetch_detail": _details,
    "q_dead_workers": lambda s, d: A.dead_workers(_beats(s, d), "2024-01-30 20:00:00"),
    "q_dead_letter_depth": lambda s, d: A.dead_letter_depth(role(s, d, "requests").where("class <> 'ok'").select(F.col("platform").alias("queue"), F.col("ts").alias("died_at")), AS_OF),
    "q_heals": lambda s, d: A.heals(role(s, d, "requests").where("class = '5xx'").groupBy("platform", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("second")).count().select(F.col("platform").alias("kind"), "second"), window=400_000, gap=30_000, again=500_000),
    "q_queue_health": lambda s, d: A.queue_health(_snapshots(s, d, "2024-01-12"), _snapshots(s, d, "2024-01-11")),
}

_CAT = "(SELECT p_partkey AS place, p_name AS company, 'p' || p_partkey % 4 AS platform, 's' || p_partkey AS slug, p_partkey % 5 <> 0 AS active, p_partkey % 3 = 0 AS enriched, CASE WHEN p_partkey % 2 = 0 THEN 'detection' ELSE 'crawl' END AS source FROM part)"
_SNAP = "(SELECT platform AS queue, count_if(class <> 'ok') AS depth, max(ms) AS oldest_s FROM requests WHERE date = DATE '{}' GROUP BY 1)"
_SILENT = "[" + ", ".join(f"'{k}'" for k in A.SILENT) + "]"
_LIMITS = "[" + ", ".join(str(v) for v in A.SILENT.values()) + "]"

ORACLE_SQL = {
    "q_find_stats": "SELECT count(*) AS total_found, count(DISTINCT o_custkey % 70) AS companies_found FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= DATE '1996-01-01'",
    "q_verify_stats": "SELECT count(*) AS verified, count_if(o_orderstatus = 'P')::BIGINT AS inactive FROM orders WHERE o_orderdate >= DATE '1996-01-01'",
    "q_enrichment": f"SELECT count(*) AS total, count_if(enriched)::BIGINT AS enriched, count_if(NOT enriched)::BIGINT AS pending, round(100.0::DOUBLE * count_if(enriched) / count(*), 1) AS pct FROM {_CAT} WHERE active",
    "q_slug_stats": f"SELECT platform, count(*) AS total, count_if(enriched)::BIGINT AS enriched, count_if(NOT active)::BIGINT AS inactive, count_if(source = 'detection')::BIGINT AS detected FROM {_CAT} GROUP BY 1",
    "q_cache_stats": f"SELECT source, count(*) AS n, round(100.0::DOUBLE * count_if(enriched) / count(*), 1) AS enriched_pct, round(100.0::DOUBLE * sum(count_if(enriched)) OVER () / sum(count(*)) OVER (), 1) AS all_enriched_pct FROM {_CAT} WHERE active GROUP BY 1",
    "q_run_metrics": oracle("requests", body=", a AS (SELECT date AS day, count(*) AS n, count_if(class = 'ok') AS f, count_if(class = '404') AS x FROM requests WHERE date >= DATE '2024-01-05' GROUP BY 1), b AS (SELECT date AS day, count(*) AS n, count_if(ms > 1000) AS s FROM requests WHERE date <= DATE '2024-01-20' AND context <> 'normal' GROUP BY 1) SELECT day, coalesce(b.n, 0) AS applications, coalesce(a.n, 0) AS attempted, coalesce(f, 0)::BIGINT AS auto_found, coalesce(x, 0)::BIGINT AS exhausted, CASE WHEN a.n > 0 THEN round(100.0::DOUBLE * f / a.n, 1) END AS metric1, CASE WHEN b.n > 0 THEN round(100.0::DOUBLE * s / b.n, 1) END AS metric2 FROM a FULL JOIN b USING (day)"),
    "q_send_totals": oracle("stages", body="SELECT count_if(status IN ('sent', 'scheduled'))::BIGINT AS active, count_if(stage = 'followup2' AND status = 'sent')::BIGINT AS completed, count_if(status = 'sent' AND size % 3 <> 0)::BIGINT AS pending_reply FROM stages"),
    "q_application_recruiters": oracle("applications", "bridge", "recruiters", body="SELECT application_id, recruiter_id, name FROM applications JOIN bridge USING (application_id) JOIN recruiters r USING (recruiter_id) WHERE company = 'BUILDING' AND r.status = 'active'"),
    "q_first_match": f"SELECT name, arg_min(platform, place) AS platform, arg_min(slug, place) AS slug FROM (SELECT DISTINCT array_to_string(string_split(p_name, ' ')[-2:], ' ') AS name FROM part) n JOIN {_CAT} c ON active AND list_has_all(string_split(lower(company), ' '), string_split(lower(name), ' ')) GROUP BY 1",
    "q_plain_company": oracle("recruiters", body="SELECT recruiter_id, lower(name) || ' inc x' AS plain, recruiter_id % 2 = 0 AS fits FROM recruiters"),
    "q_alpha2": "WITH c(a, b) AS (VALUES ('and', 'AD'), ('are', 'AE'), ('che', 'CH'), ('can', 'CA'), ('per', 'PE'), ('est', 'EE'), ('tha', 'TH'), ('ind', 'IN'), ('ira', 'IR'), ('mar', 'MA'), ('sen', 'SN'), ('ven', 'VE'), ('usa', 'US')) SELECT coalesce(b, '') AS code, count(*) AS words FROM (SELECT lower(unnest(string_split(text, ' '))) AS w FROM documents) LEFT JOIN c ON a = w GROUP BY 1",
    "q_slug_config": """WITH x AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+/([a-z]+)/', 1) AS lang, url LIKE 'https%' AS secure, contains(url, '?') AS queried, contains(url, '#') AS marked FROM pages),
 y AS (SELECT *, CASE WHEN secure AND queried THEN '{"slug":"' || host || '","path":"' || lang || '"}' WHEN secure THEN '{"slug":"' || host || '","wd":"wd' || length(host) || '"}' WHEN NOT marked THEN host ELSE '' END AS whole FROM x)
 SELECT page_id, CASE WHEN lang = 'es' THEN whole WHEN secure THEN host WHEN lang IN ('en', 'de') THEN whole END AS slug, CASE WHEN lang = 'es' THEN NULL WHEN secure AND NOT queried THEN 'wd' || length(host) WHEN NOT secure AND lang = 'en' THEN 'wd5' END AS wd,
 CASE WHEN lang = 'es' THEN NULL WHEN secure AND queried THEN lang WHEN lang = 'en' THEN 'careers' END AS path, CASE WHEN NOT secure AND lang = 'de' THEN '' END AS site FROM y""",
    "q_fetch_detail": """SELECT page_id, CASE WHEN length(html) % 11 = 0 THEN false ELSE CASE length(regexp_extract(url, '://([^/]+)', 1)) % 6 WHEN 0 THEN url LIKE 'https%' WHEN 1 THEN url LIKE 'https%' AND regexp_matches(url, '[?&]page=[0-9]') WHEN 2 THEN regexp_matches(url, '#.') AND regexp_matches(url, '://[^/]+/[a-z]+/')
 WHEN 3 THEN url NOT LIKE '%.html' AND NOT contains(url, 'utm_source') WHEN 4 THEN length(html) <= 3000 ELSE url NOT LIKE '%.html' END END AS fetch FROM pages""",
    "q_dead_workers": oracle("requests", body=f", l AS (SELECT user_id % {len(A.SILENT)} AS k, user_id, max(ts) AS last FROM requests GROUP BY 1, 2), c AS (SELECT k, count_if(floor(epoch(TIMESTAMP '2024-01-30 20:00:00')) - floor(epoch(last)) > ({_LIMITS})[k + 1])::BIGINT AS dead FROM l GROUP BY 1) SELECT ({_SILENT})[k + 1] AS kind, dead, CASE WHEN dead >= 5 THEN 'error' WHEN dead >= 3 THEN 'warning' ELSE 'ok' END AS level FROM c"),
    "q_dead_letter_depth": oracle("requests", body=", c AS (SELECT platform AS queue, count_if(ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)::BIGINT AS depth FROM requests WHERE class <> 'ok' GROUP BY 1) SELECT queue, depth, CASE WHEN depth > 50 THEN 'warning' ELSE 'ok' END AS level FROM c"),
    "q_heals": oracle("requests", body=""", a AS (SELECT platform AS kind, (epoch_us(ts) // 1000000)::BIGINT AS sec, row_number() OVER (PARTITION BY platform ORDER BY epoch_us(ts) // 1000000) AS rn FROM requests WHERE class = '5xx' GROUP BY platform, epoch_us(ts) // 1000000),
 f AS (SELECT DISTINCT kind, 0::BIGINT AS rn, NULL::BIGINT AS sec, NULL::BIGINT AS first, NULL::BIGINT AS last, 0::BIGINT AS n, NULL::BIGINT AS esc, NULL::VARCHAR AS action FROM a UNION ALL
 SELECT kind, rn, sec, CASE WHEN action = 'heal' AND n = 0 THEN sec ELSE first END, CASE WHEN action = 'heal' THEN sec ELSE last END, CASE WHEN action = 'heal' THEN n + 1 ELSE n END, CASE action WHEN 'escalated_before' THEN esc WHEN 'escalate' THEN sec END, action FROM
 (SELECT *, CASE WHEN esc IS NOT NULL AND sec - esc < 500000 THEN 'escalated_before' WHEN n > 0 AND sec - last < 30000 THEN 'cooling_down' WHEN n >= 3 THEN 'escalate' ELSE 'heal' END AS action FROM
 (SELECT a.kind, a.rn, a.sec, CASE WHEN f.n > 0 AND a.sec - f.first < 400000 THEN f.first END AS first, CASE WHEN f.n > 0 AND a.sec - f.first < 400000 THEN f.last END AS last, CASE WHEN f.n > 0 AND a.sec - f.first < 400000 THEN f.n ELSE 0 END AS n, f.esc FROM f JOIN a ON a.kind = f.kind AND a.rn = f.rn + 1)))
 SELECT kind, sec AS second, action FROM f WHERE action IS NOT NULL""").replace("WITH ", "WITH RECURSIVE ", 1),
    "q_queue_health": oracle("requests", body=f"SELECT queue, q.depth, CASE WHEN b.depth IS NULL THEN 'new' WHEN q.depth > b.depth THEN 'growing' WHEN q.depth < b.depth THEN 'shrinking' ELSE 'steady' END AS trend, CASE WHEN q.oldest_s > 1800 THEN 'error' WHEN q.oldest_s > 600 OR (q.depth > b.depth AND b.depth = 0) THEN 'warning' ELSE 'ok' END AS level FROM {_SNAP.format('2024-01-12')} q LEFT JOIN {_SNAP.format('2024-01-11')} b USING (queue)"),
}

as_text(QUERIES, ORACLE_SQL, {"q_run_metrics": ["day"]})
