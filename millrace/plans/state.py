"""Queries of changing tables and state machines, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import health as H
from ..operators import state as S
from .roles import as_text, oracle, role


def _apps(s, d):
    return role(s, d, "applications")


def _posts(s, d):
    return role(s, d, "postings").select("job_id", F.md5(F.col("title").cast("binary")).alias("content_hash"))


def _pages(s, d):
    host, path = T.url_host(F.col("url")), T.url_path(F.col("url"))
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"), T.registrable(host).alias("root"), "html")


def _supplier(s, d):
    return s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal")


def _schedule(s, d):
    return role(s, d, "requests").groupBy(F.col("user_id").alias("company")).agg((F.col("company") % 2).alias("tier"), F.max("ms").cast("double").alias("due_at"))


def _cycles(s, d):
    """Six hours of a platform as a cycle of its queue."""
    ms = F.unix_micros(F.col("ts").cast("timestamp"))
    return role(s, d, "requests").groupBy(F.col("platform").alias("pool"), F.floor(ms / 21_600_000_000).alias("cycle")).agg((F.sum("ms") % 4000).alias("depth"), (F.count("*") % 30).cast("double").alias("delay"))


def _probes(s, d):
    counts = role(s, d, "requests").groupBy("platform", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 21_600_000_000).alias("bucket"))
    canary = F.col("context") == "canary"
    counts = counts.agg(F.count_if(canary).alias("canaries"), F.count_if(canary & (F.col("class") != "ok")).alias("failed"))
    return H.error_window(role(s, d, "requests"), 21600).join(counts, ["platform", "bucket"])


QUERIES = {
    "q_portal": lambda s, d: _pages(s, d).select("page_id", S.portal(F.col("host"), F.when(F.col("page_id") % 4 == 0, F.lit("see Lever")).otherwise(F.lit(""))).alias("portal")),
    "q_plausible_url": lambda s, d: _pages(s, d).select("page_id", S.plausible(F.col("host"), F.when(F.col("page_id") % 5 == 0, F.lit("/Careers/x")).otherwise(F.col("path")), F.col("root"), F.array(F.lit("blog"), F.lit("m"))).alias("plausible")),
    "q_promote": lambda s, d: S.promote(_posts(s, d).where("job_id % 2 = 0").select("job_id"), _posts(s, d), _posts(s, d).where("job_id % 7 = 0").select("content_hash")),
    "q_touch": lambda s, d: S.touch(_apps(s, d).where("application_id % 3 <> 0").groupBy("user_id", "company").agg(F.max("applied_on").alias("seen_on")), _apps(s, d).where("application_id % 3 = 0").select("user_id", "company", F.col("applied_on").alias("seen_on")), ["user_id", "company"], "seen_on"),
    "q_conditional_upsert": lambda s, d: S.upsert(_supplier(s, d).where("s_suppkey % 4 <> 0"), _supplier(s, d).where("s_suppkey % 3 = 0").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey") + 1).alias("s_nationkey"), (F.col("s_acctbal") * 2).alias("s_acctbal")), ["s_suppkey"], ["s_nationkey", "s_acctbal"]),
    "q_stale_slugs": lambda s, d: S.stale(role(s, d, "requests").select("event_id", "platform", "context"), role(s, d, "requests").where("user_id % 7 < 4").select("platform"), "platform", F.col("context") == "normal").select("event_id"),
    "q_reactivate": lambda s, d: S.reactivate(_apps(s, d).select("application_id", "user_id", "status"), _apps(s, d).where("expected > 300000").select("user_id"), "user_id").select("application_id", "status"),
    "q_due": lambda s, d: S.due(_schedule(s, d), 4500.0, 40),
    "q_backpressure": lambda s, d: H.backpressure(_cycles(s, d)),
    "q_admission": lambda s, d: H.admission(_cycles(s, d).where("cycle % 5 = 0")),
    "q_probed_outages": lambda s, d: S.probed_outages(_probes(s, d), 0.22, 2),
    "q_outages": lambda s, d: S.outages(H.error_window(role(s, d, "requests"), 21600), 0.22),
}

_WIN = """, win AS (SELECT platform, bucket, round((sum(e) OVER w)::DOUBLE / sum(n) OVER w, 6) AS error_rate, row_number() OVER (PARTITION BY platform ORDER BY bucket) AS rn FROM (SELECT platform, (epoch_us(ts) // 21600000000)::BIGINT AS bucket, count(*) AS n, count_if(class <> 'ok') AS e FROM requests GROUP BY 1, 2) WINDOW w AS (PARTITION BY platform ORDER BY bucket RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)),
 f AS (SELECT DISTINCT platform, 0::BIGINT AS rn, NULL::BIGINT AS bucket, false AS before, 0 AS k, false AS outage, NULL::VARCHAR AS event FROM requests UNION ALL
 SELECT w.platform, w.rn, w.bucket, NOT f.outage AND w.error_rate > 0.22 AND NOT (f.before AND f.k + 1 >= 3), CASE WHEN f.outage OR (f.before AND (w.error_rate <= 0.22 OR f.k + 1 >= 3)) THEN 0 WHEN f.before THEN f.k + 1 ELSE f.k END,
 CASE WHEN f.outage THEN w.error_rate > 0.22 ELSE f.before AND w.error_rate > 0.22 AND f.k + 1 >= 3 END,
 CASE WHEN f.outage THEN CASE WHEN w.error_rate <= 0.22 THEN 'outage_end' END WHEN f.before AND w.error_rate > 0.22 AND f.k + 1 >= 3 THEN 'outage_start' WHEN w.error_rate > 0.22 THEN 'deprioritize' END FROM f JOIN win w ON w.platform = f.platform AND w.rn = f.rn + 1)"""
_CYC = """, c AS (SELECT platform AS pool, (epoch_us(ts) // 21600000000)::BIGINT AS cycle, (sum(ms) % 4000)::BIGINT AS depth, count(*) % 30 AS delay, row_number() OVER (PARTITION BY platform ORDER BY epoch_us(ts) // 21600000000) AS rn FROM requests GROUP BY platform, epoch_us(ts) // 21600000000),
 f AS (SELECT DISTINCT platform AS pool, 0::BIGINT AS rn, NULL::BIGINT AS cycle, NULL::BIGINT AS depth, false AS active, 0::BIGINT AS quiet, 0::BIGINT AS held, NULL::VARCHAR AS event, 0::BIGINT AS inflow FROM requests UNION ALL
 SELECT pool, rn, cycle, depth, CASE WHEN was THEN NOT (q >= 3 OR h >= 60) ELSE fires END, CASE WHEN was AND NOT (q >= 3 OR h >= 60) THEN q ELSE 0 END, CASE WHEN was AND NOT (q >= 3 OR h >= 60) THEN h ELSE 0 END, CASE WHEN was AND (q >= 3 OR h >= 60) THEN 'lifted' WHEN NOT was AND fires THEN 'fired' END, grown
 FROM (SELECT c.pool, c.rn, c.cycle, c.depth, f.active AS was, CASE WHEN c.delay < 15 THEN f.quiet + 1 ELSE 0 END AS q, f.held + 1 AS h, c.depth >= 2000 AND NOT coalesce(c.depth < f.depth, false) AS fires, coalesce(greatest(0, c.depth - f.depth), 0) AS grown FROM f JOIN c ON c.pool = f.pool AND c.rn = f.rn + 1))"""
_PRB = """, win AS (SELECT platform, bucket, round((sum(e) OVER w)::DOUBLE / sum(n) OVER w, 6) AS error_rate, k AS canaries, x AS failed, row_number() OVER (PARTITION BY platform ORDER BY bucket) AS rn FROM (SELECT platform, (epoch_us(ts) // 21600000000)::BIGINT AS bucket, count(*) AS n, count_if(class <> 'ok') AS e, count_if(context = 'canary') AS k, count_if(context = 'canary' AND class <> 'ok') AS x FROM requests GROUP BY 1, 2) WINDOW w AS (PARTITION BY platform ORDER BY bucket RANGE BETWEEN 1 PRECEDING AND CURRENT ROW)),
 f AS (SELECT DISTINCT platform, 0::BIGINT AS rn, NULL::BIGINT AS bucket, false AS before, 0 AS k, false AS outage, NULL::VARCHAR AS event FROM requests UNION ALL
 SELECT w.platform, w.rn, w.bucket, NOT f.outage AND w.error_rate > 0.22 AND NOT (f.before AND f.k + 1 >= 2), CASE WHEN f.outage THEN CASE WHEN w.canaries > 0 AND w.failed = 0 THEN 0 ELSE f.k END WHEN f.before AND (w.error_rate <= 0.22 OR f.k + 1 >= 2) THEN 0 WHEN f.before THEN f.k + 1 ELSE f.k END,
 CASE WHEN f.outage THEN NOT (w.canaries > 0 AND w.failed = 0) ELSE f.before AND w.error_rate > 0.22 AND f.k + 1 >= 2 END,
 CASE WHEN f.outage THEN CASE WHEN w.canaries = 0 THEN 'probe' WHEN w.failed = 0 THEN 'outage_end' ELSE 'canary_failed' END WHEN f.before AND w.error_rate > 0.22 AND f.k + 1 >= 2 THEN 'outage_start' WHEN w.error_rate > 0.22 THEN 'deprioritize' END FROM f JOIN win w ON w.platform = f.platform AND w.rn = f.rn + 1)"""
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_PATH = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"

ORACLE_SQL = {
    "q_portal": "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'lever' ELSE 'generic' END AS portal FROM pages",
    "q_plausible_url": f"SELECT page_id, contains({_HOST}, 'blog') OR regexp_matches({_HOST} || lower(CASE WHEN page_id % 5 = 0 THEN '/Careers/x' ELSE {_PATH} END), 'career|jobs') AS plausible FROM pages",
    "q_promote": oracle("postings", body=", h AS (SELECT job_id, md5(title) AS content_hash FROM postings) SELECT job_id, content_hash, CASE WHEN content_hash NOT IN (SELECT content_hash FROM h WHERE job_id % 7 = 0) AND row_number() OVER (PARTITION BY content_hash ORDER BY job_id) = 1 THEN 'new' ELSE 'duplicate' END AS status FROM h WHERE job_id % 2 = 0"),
    "q_touch": oracle("applications", body="SELECT user_id, company, max(applied_on) AS seen_on, count_if(application_id % 3 = 0)::BIGINT AS touched FROM applications GROUP BY 1, 2"),
    "q_conditional_upsert": "SELECT s_suppkey, coalesce(n.a, o.s_nationkey)::INTEGER AS s_nationkey, coalesce(n.b, o.s_acctbal) AS s_acctbal FROM (SELECT * FROM supplier WHERE s_suppkey % 4 <> 0) o FULL JOIN (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 1 END AS a, s_acctbal * 2 AS b FROM supplier WHERE s_suppkey % 3 = 0) n USING (s_suppkey)",
    "q_stale_slugs": oracle("requests", body="SELECT event_id FROM requests WHERE context = 'normal' AND user_id % 7 >= 4"),
    "q_reactivate": oracle("applications", body="SELECT application_id, CASE WHEN status = 'closed' AND user_id IN (SELECT user_id FROM applications WHERE expected > 300000) THEN 'active' ELSE status END AS status FROM applications"),
    "q_due": oracle("requests", body="SELECT * FROM (SELECT user_id AS company, user_id % 2 AS tier, max(ms)::DOUBLE AS due_at FROM requests GROUP BY 1) WHERE due_at <= 4500 ORDER BY tier, due_at, company LIMIT 40"),
    "q_backpressure": oracle("requests", body=_CYC + " SELECT pool, cycle, event, depth, inflow FROM f WHERE event IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1),
    "q_admission": oracle("requests", body="SELECT platform AS pool, CASE WHEN sum(ms) % 4000 > 5000 THEN 'defer' WHEN sum(ms) % 4000 > 2000 THEN 'urgent_only' ELSE 'admit' END AS policy FROM requests GROUP BY platform, epoch_us(ts) // 21600000000 HAVING (epoch_us(ts) // 21600000000) % 5 = 0"),
    "q_probed_outages": oracle("requests", body=_PRB + " SELECT platform, bucket, event FROM f WHERE event IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1),
    "q_outages": oracle("requests", body=_WIN + " SELECT platform, bucket, event FROM f WHERE event IS NOT NULL").replace("WITH ", "WITH RECURSIVE ", 1),
}

as_text(QUERIES, ORACLE_SQL, {"q_touch": ["seen_on"]})
