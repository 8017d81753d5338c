"""Queries of the smaller reports, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import filings as L
from ..operators import reports as R
from ..operators import suffixes as P
from .roles import AS_OF, as_text, oracle, role


def _req(s, d):
    return role(s, d, "requests")


def _used(s, d):
    return _req(s, d).select("date", (F.col("ms") % 7).alias("used"))


def _code(kind):
    return F.element_at(F.create_map(*[F.lit(x) for p in {"ok": 200, "429": 429, "404": 404, "timeout": 0, "5xx": 503}.items() for x in p]), kind)


def _line(s, d):
    return _req(s, d).select(F.concat_ws(" ", F.col("ts").cast("string"), F.upper("class"), F.lit("user"), F.col("user_id").cast("string"), F.lit("took"), F.col("ms").cast("string"), F.lit("ms at /var/log/app.log key 'x'")).alias("line"))


def _names(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", F.lower("p_name").alias("a"), F.lower(F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " inc").when(F.col("p_partkey") % 3 == 1, " bank").otherwise(""))).alias("b"))



def _under_rules(s, d):
    """Pages' hosts with their ends replaced by ones that rules of each kind decide."""
    x = F.regexp_extract("url", "^https?://([^./]+)", 1)
    forms = ("a.{}.co.uk", "{}.ck", "b.{}.ck", "www.ck", "x.{}.www.ck", "{}.city.kawasaki.jp", "c.b.{}.kawasaki.jp", "kawasaki.jp", "{}.COM.", "co.uk", "m.{}.zz", "10.0.0.1")
    made = F.element_at(F.array(*(F.replace(F.lit(f), F.lit("{}"), x) for f in forms)), (F.col("page_id") % 12 + 1).cast("int"))
    pages = s.read.parquet(f"{d}/pages.parquet").select("page_id", F.when(F.col("page_id") % 5 == 0, T.url_host(F.col("url"))).when(F.col("page_id") % 7 != 0, made).alias("host"))
    return P.with_root(pages, F.col("host"), P.common_rules(s)).select("page_id", "root")


QUERIES = {
    "q_status_summary": lambda s, d: R.status_summary(role(s, d, "applications")),
    "q_diagnostics": lambda s, d: R.diagnostics(_req(s, d).where("class <> 'ok'").select(F.col("user_id").alias("company"), "platform", "class"), ["company", "platform"], "class", ["5xx", "429", "timeout", "404"]),
    "q_quota": lambda s, d: R.quotas(_used(s, d), 1200),
    "q_quota_streak": lambda s, d: R.quota_streak(R.quotas(_used(s, d), 1200), 1200, 3),
    "q_mean_of_top": lambda s, d: R.mean_of_top(role(s, d, "applications"), "expected", "application_id", 100),
    "q_coverage": lambda s, d: R.coverage(_req(s, d).groupBy("user_id").agg(F.max(F.when(F.col("class") == "ok", F.col("ts"))).alias("last")), "last", AS_OF, 34),
    "q_reliability": lambda s, d: R.reliability(role(s, d, "polls"), "new_jobs"),
    "q_worker_missed": lambda s, d: R.worker_missed(_req(s, d).select(F.col("user_id").alias("company")).distinct(), _req(s, d).select(F.col("user_id").alias("company"), "ts"), _req(s, d).where("user_id % 10 = 0").select(F.col("user_id").alias("company")).distinct(), AS_OF, 30),
    "q_schedule_merge": lambda s, d: R.schedule_merge(_req(s, d).where("user_id % 3 <> 0").groupBy(F.col("user_id").alias("company")).agg(F.max("ms").cast("double").alias("due_at")), _req(s, d).select(F.col("user_id").alias("company")).distinct(), 4000.0),
    "q_metric_streak": lambda s, d: R.streak_below(_req(s, d).groupBy("platform", "date").agg(F.max("ms").alias("peak"), F.count("*").alias("n")), "peak", "n", 4500, 70, 3),
    "q_fingerprints": lambda s, d: R.fingerprints(_line(s, d), "line", "429|TIMEOUT|5XX", "took 1\\d\\d ms"),
    "q_next_deadline": lambda s, d: _req(s, d).select("event_id", R.next_deadline(F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("deadline")),
    "q_error_class": lambda s, d: _req(s, d).groupBy(R.error_class(_code(F.col("class"))).alias("kind")).agg(F.count("*").alias("n")),
    "q_public_suffix": _under_rules,
    "q_registrable": lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", T.registrable(T.url_host(F.col("url"))).alias("root"), R.email_root(F.concat(F.lit("x@"), T.url_host(F.col("url")))).alias("mail_root")),
    "q_suffix_variation": lambda s, d: _names(s, d).select("p_partkey", R.suffix_variation(F.col("a"), F.col("b")).alias("varies")),
    "q_slug_fits": lambda s, d: _names(s, d).select("p_partkey", R.slug_fits(F.translate("b", " ", "-"), F.col("a")).alias("fits")),
    "q_bounce_cascade": lambda s, d: R.bounce_cascade(role(s, d, "stages"), role(s, d, "stages").where("size % 9 = 0").select("conv_id")),
    "q_tally": lambda s, d: R.tally(_req(s, d), "platform", {"slow": F.col("ms") > 1000, "failed": F.col("class") != "ok", "canary": F.col("context") == "canary"}),
    "q_processed_batches": lambda s, d: role(s, d, "filings").groupBy("fein").agg(F.collect_set(F.concat(F.lit("q"), F.quarter("decided").cast("string"))).alias("b")).select(F.explode("b").alias("batch")).distinct(),
    "q_strip_legal": lambda s, d: s.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", T.strip_legal(F.upper(F.concat("s_name", F.lit(", Inc. LLC")))).alias("name")),
    "q_json_props": lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.try_parse_json(F.when(F.col("event_id") % 5 == 0, F.lit("{bad")).otherwise(F.col("props"))).isNotNull().alias("valid")),
    "q_live_cache": lambda s, d: R.live(s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("ts").alias("expires_at")), "expires_at", "2024-01-20 00:00:00").select("event_id"),
    "q_petition_names": lambda s, d: role(s, d, "petitions").join(L.unmatched(role(s, d, "petitions"), role(s, d, "employers")).select("legal_norm", "tax_id"), ["legal_norm", "tax_id"]).select("legal_norm", "tax_id", "full_norm").distinct(),
}

_NM = "(SELECT p_partkey, lower(p_name) AS a, lower(p_name || CASE p_partkey % 3 WHEN 0 THEN ' inc' WHEN 1 THEN ' bank' ELSE '' END) AS b FROM part)"
_HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
_ROOT = "CASE WHEN len(string_split({h}, '.')) <= 2 THEN {h} ELSE array_to_string(string_split({h}, '.')[-2:], '.') END".replace("{h}", _HOST)

#: Rules as they are matched here: by a host's end in text, not by labels.
_RULES = """WITH r AS (SELECT *, len(string_split(tail, '.')) AS k FROM (VALUES ('com', 'plain'), ('net', 'plain'), ('org', 'plain'), ('io', 'plain'), ('co', 'plain'), ('uk', 'plain'), ('co.uk', 'plain'), ('jp', 'plain'), ('co.jp', 'plain'), ('kawasaki.jp', 'wild'), ('city.kawasaki.jp', 'spared'), ('ck', 'wild'), ('www.ck', 'spared')) t(tail, kind)),
 x AS (SELECT page_id, url, regexp_extract(url, '^https?://([^./]+)', 1) AS x FROM pages),
 p AS (SELECT page_id, rtrim(lower(CASE WHEN page_id % 5 = 0 THEN {h} WHEN page_id % 7 = 0 THEN NULL ELSE (['a.' || x || '.co.uk', x || '.ck', 'b.' || x || '.ck', 'www.ck', 'x.' || x || '.www.ck', x || '.city.kawasaki.jp', 'c.b.' || x || '.kawasaki.jp', 'kawasaki.jp', x || '.com', 'co.uk', 'm.' || x || '.zz', '10.0.0.1'])[page_id % 12 + 1] END), '.') AS host FROM x),
 m AS (SELECT page_id, any_value(host) AS host, coalesce(max(CASE WHEN kind = 'spared' THEN k - 1 END), max(CASE WHEN kind = 'plain' THEN k WHEN kind = 'wild' AND len(string_split(host, '.')) > k THEN k + 1 END), 1) + 1 AS kept FROM p LEFT JOIN r ON host = tail OR ends_with(host, '.' || tail) GROUP BY 1)
 SELECT page_id, CASE WHEN host = '' THEN NULL WHEN host = '10.0.0.1' OR len(string_split(host, '.')) < kept THEN host ELSE array_to_string(string_split(host, '.')[-kept:], '.') END AS root FROM m""".replace("{h}", _HOST)

ORACLE_SQL = {
    "q_public_suffix": _RULES,
    "q_status_summary": oracle("applications", body="SELECT status, count(*) AS n FROM applications GROUP BY 1"),
    "q_diagnostics": oracle("requests", body="SELECT class, count(*) AS n, count(DISTINCT user_id) AS companies, list_position(['5xx', '429', 'timeout', '404'], class)::INTEGER AS place FROM (SELECT DISTINCT user_id, platform, class FROM requests WHERE class <> 'ok') GROUP BY 1"),
    "q_quota": oracle("requests", body="SELECT date, sum(ms % 7)::BIGINT AS used, greatest(1200 - sum(ms % 7), 0)::BIGINT AS remaining FROM requests GROUP BY 1"),
    "q_quota_streak": oracle("requests", body=", q AS (SELECT date, sum(ms % 7) AS used FROM requests GROUP BY 1 ORDER BY 1 DESC LIMIT 3) SELECT count(*) = 3 AND max(used) < 480 AS under, count(*) = 3 AND min(used) >= 1200 AS exhausted FROM q"),
    "q_mean_of_top": oracle("applications", body="SELECT round(avg(expected), 4) AS mean_top, count(*) AS n FROM (SELECT expected FROM applications ORDER BY expected DESC, application_id LIMIT 100)"),
    "q_coverage": oracle("requests", body=", l AS (SELECT max(CASE WHEN class = 'ok' THEN ts END) AS last FROM requests GROUP BY user_id), m AS (SELECT count(*) AS total, count_if(last IS NULL OR epoch(TIMESTAMP '2024-01-31') - floor(epoch(last)) > 34 * 3600)::BIGINT AS missed FROM l) SELECT total, missed, least(100, floor(100 * (total - missed) / total))::BIGINT AS coverage_pct, missed > 0.25 * total AS alert FROM m"),
    "q_reliability": oracle("polls", body="SELECT round(count_if(new_jobs > 0)::DOUBLE / count(*), 4) AS reliability, count(*) AS runs FROM polls"),
    "q_worker_missed": oracle("requests", body="SELECT user_id AS company FROM requests GROUP BY 1 HAVING epoch(TIMESTAMP '2024-01-31') - floor(epoch(max(ts))) > 30 * 3600 AND user_id % 10 <> 0"),
    "q_schedule_merge": oracle("requests", body="SELECT user_id AS company, CASE WHEN user_id % 3 = 0 THEN 4000.0::DOUBLE ELSE max(ms)::DOUBLE END AS due_at, CASE WHEN user_id % 3 = 0 THEN 'new' WHEN max(ms) <= 4000 THEN 'stale' ELSE 'current' END AS bucket FROM requests GROUP BY 1"),
    "q_metric_streak": oracle("requests", body=", d AS (SELECT platform, date, max(ms) AS peak, count(*) AS n, row_number() OVER (PARTITION BY platform ORDER BY date DESC) AS r FROM requests GROUP BY 1, 2) SELECT platform, max(peak) AS max_peak, max(n) AS max_n FROM d WHERE r <= 3 GROUP BY 1 HAVING count(*) = 3 AND max(date) - min(date) = 2 AND max(peak) < 4500 AND max(n) < 70"),
    "q_fingerprints": oracle("requests", body="SELECT '<ts> ' || CASE WHEN class IN ('429', '404') THEN '<n>' WHEN class = '5xx' THEN '<n>XX' ELSE upper(class) END || ' user <n> took <n> ms at <path> key <s>' AS fingerprint, count(*) AS n FROM requests WHERE regexp_matches(ts::VARCHAR || ' ' || upper(class) || ' user ' || user_id || ' took ' || ms || ' ms', '429|TIMEOUT|5XX') AND NOT ms BETWEEN 100 AND 199 GROUP BY 1"),
    "q_next_deadline": oracle("requests", body="SELECT event_id, timezone('UTC', timezone('America/New_York', (CASE WHEN hour(l) >= 7 THEN date_trunc('day', l) + INTERVAL 1 DAY ELSE date_trunc('day', l) END) + INTERVAL 7 HOUR)) AS deadline FROM (SELECT event_id, timezone('America/New_York', timezone('UTC', ts)) AS l FROM requests)"),
    "q_error_class": oracle("requests", body="SELECT CASE class WHEN 'ok' THEN 'ok' WHEN '429' THEN 'rate_limited' WHEN '404' THEN 'not_found' WHEN 'timeout' THEN 'timeout' ELSE 'server' END AS kind, count(*) AS n FROM requests GROUP BY 1"),
    "q_registrable": f"SELECT page_id, {_ROOT} AS root, {_ROOT} AS mail_root FROM pages",
    "q_suffix_variation": f"SELECT p_partkey, p_partkey % 3 <> 1 AS varies FROM {_NM}",
    "q_slug_fits": f"SELECT p_partkey, true AS fits FROM {_NM}",
    "q_bounce_cascade": oracle("stages", body="SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT conv_id FROM stages WHERE size % 9 = 0) THEN CASE WHEN status = 'pending' THEN 'cancelled' ELSE 'bounced' END ELSE status END AS status FROM stages"),
    "q_tally": oracle("requests", body="SELECT platform, count_if(ms > 1000)::BIGINT AS slow, count_if(class <> 'ok')::BIGINT AS failed, count_if(context = 'canary')::BIGINT AS canary, count(*) AS total FROM requests GROUP BY 1"),
    "q_processed_batches": oracle("filings", body="SELECT DISTINCT 'q' || quarter(decided) AS batch FROM filings"),
    "q_strip_legal": "SELECT s_suppkey, upper(s_name) AS name FROM supplier",
    "q_json_props": "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, event_id % 5 <> 0 AS valid FROM events",
    "q_live_cache": "SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-20'",
    "q_petition_names": oracle("petitions", "employers", body="SELECT DISTINCT p.legal_norm, p.tax_id, p.full_norm FROM petitions p JOIN (SELECT DISTINCT legal_norm, tax_id FROM petitions p WHERE NOT EXISTS (SELECT 1 FROM employers e WHERE tax_id = right(fein, 4) AND (p.legal_norm = e.legal_norm OR p.full_norm = e.dba_norm))) u USING (legal_norm, tax_id)"),
}

as_text(QUERIES, ORACLE_SQL, {"q_quota": ["date"], "q_next_deadline": ["deadline"]})
