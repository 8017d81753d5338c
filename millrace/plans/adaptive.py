"""Adaptive polling queries, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive as A
from .roles import as_text, oracle, role


def _polls(s, d):
    return role(s, d, "polls")


def _seen(s, d):
    return role(s, d, "requests").withColumn("sec", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))


def _votes(s, d):
    return role(s, d, "requests").groupBy("user_id", F.col("class").alias("ats")).agg(F.count("*").alias("n"), F.round(F.avg(F.least(F.lit(100), 60 + F.col("ms") / 40)), 6).alias("confidence"))


def _queue(s, d):
    found = F.count_if(F.col("class") == "ok")
    return role(s, d, "requests").groupBy(F.col("user_id").alias("company")).agg((F.count("*") % 3).alias("checks"), (found % 4).alias("found"), F.min("ms").alias("created"), F.max("ms").alias("checked"), F.count_if(F.col("class") != "ok").alias("empty"))


QUERIES = {
    "q_adaptive_score": lambda s, d: A.scores(_polls(s, d)),
    "q_band_thresholds": lambda s, d: A.thresholds(A.scores(_polls(s, d))),
    "q_interval_fold": lambda s, d: A.intervals(_polls(s, d)),
    "q_ema": lambda s, d: A.ema(role(s, d, "requests"), "user_id", ("ts", "event_id"), "ms", 120.0),
    "q_max_gap": lambda s, d: A.max_gap(_seen(s, d), "platform", "sec", 1704844800.0, 1705190400.0, 1705017600.0),
    "q_spread": lambda s, d: A.spread(role(s, d, "requests").select("platform", "event_id"), "platform", "event_id", 0.0, 8, 1.5),
    "q_fair_share": lambda s, d: A.fair_share(role(s, d, "requests").select("platform", "user_id").distinct(), "platform", "user_id", 50),
    "q_consecutive_empty": lambda s, d: A.consecutive_empty(_polls(s, d)),
    "q_winner": lambda s, d: A.winner(_votes(s, d), "user_id", "ats", "confidence", "n", ("ok", "404", "429", "timeout", "5xx"), 65.0),
    "q_priority_queue": lambda s, d: A.priority(_queue(s, d), 50),
}

_RECENT = """(SELECT user_id, date, slot, row_number() OVER (PARTITION BY user_id ORDER BY date, slot) AS r, list_transform(array_agg(least(new_jobs, 10)::DOUBLE) OVER (PARTITION BY user_id ORDER BY date, slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), lambda x: x) AS c FROM polls)"""
_SCORE = "round(CASE WHEN len(c) >= 3 THEN list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * ([0.10, 0.15, 0.20, 0.25, 0.30]::DOUBLE[])[5 - len(c) + i])) / list_sum(([0.10, 0.15, 0.20, 0.25, 0.30]::DOUBLE[])[6 - len(c):]) END, 6)"
_SCORES = f", scores AS (SELECT user_id, date, slot, r, {_SCORE} AS score FROM {_RECENT})"

ORACLE_SQL = {
    "q_adaptive_score": oracle("polls", body=_SCORES + " SELECT user_id, date, slot, score FROM scores"),
    "q_band_thresholds": oracle("polls", body=_SCORES + """, a AS (SELECT score, row_number() OVER (ORDER BY score) AS up, row_number() OVER (ORDER BY score DESC) AS down, count(*) OVER () AS n FROM scores WHERE score > 0),
 k AS (SELECT DISTINCT n, greatest(1, ceil(n * 0.10)) AS n3, greatest(1, ceil(n * 0.15)) AS n4, greatest(1, ceil(n * 0.25)) AS n6, greatest(0, n - greatest(1, ceil(n * 0.05)) - 1) AS cap FROM a),
 t AS (SELECT k.n, max(CASE WHEN up = cap + 1 THEN score END) AS c, max(CASE WHEN down = n3 THEN score END) AS a0, max(CASE WHEN down = least(n3 + n4, k.n) THEN score END) AS m0, max(CASE WHEN down = least(n3 + n4 + n6, k.n) THEN score END) AS l0 FROM a JOIN k ON a.n = k.n GROUP BY 1),
 u AS (SELECT n, least(a0, c) AS active, least(least(m0, c), least(a0, c) - 1e-9) AS moderate, least(l0, c) AS l1 FROM t) SELECT n, active, moderate, greatest(least(l1, moderate - 1e-9), 1e-9) AS low FROM u WHERE n >= 5"""),
    "q_interval_fold": oracle("polls", body=_SCORES + """, steps AS (SELECT user_id, r, score, CASE WHEN s IS NULL OR s = 0 THEN 43200 WHEN s < 0.3 THEN 32400 WHEN s < 0.8 THEN 21600 WHEN s < 1.5 THEN 14400 ELSE 10800 END AS b, CASE WHEN s IS NOT NULL AND s > 0 AND s >= 0.8 THEN 21600 ELSE 43200 END AS most
 FROM (SELECT *, score AS s FROM scores)), n AS (SELECT user_id, max(r) AS n_polls FROM steps GROUP BY 1)
 SELECT user_id, n_polls, score, list_reduce(list_prepend(43200::BIGINT, list_transform(h, lambda x: x.b * 100000 + x.most)), lambda a, x: least(CASE WHEN x // 100000 < a THEN x // 100000 ELSE floor(0.3::DOUBLE * (x // 100000) + (1 - 0.3::DOUBLE) * a)::BIGINT END, x % 100000)) AS interval_s
 FROM n JOIN steps USING (user_id) JOIN (SELECT user_id, list({'b': b::BIGINT, 'most': most::BIGINT} ORDER BY r) AS h FROM steps GROUP BY 1) USING (user_id) WHERE r = n_polls"""),
    "q_ema": oracle("requests", body="SELECT user_id, round(list_reduce(list_prepend(120.0::DOUBLE, list(ms::DOUBLE ORDER BY ts, event_id)), lambda a, x: 0.3::DOUBLE * x + (1 - 0.3::DOUBLE) * a), 4) AS ema FROM requests GROUP BY 1"),
    "q_max_gap": oracle("requests", body=""", p AS (SELECT platform, floor(epoch_us(ts) / 1000000)::DOUBLE AS x FROM requests), e AS (SELECT * FROM p WHERE x BETWEEN 1704844800 AND 1705190400 UNION ALL SELECT DISTINCT platform, unnest([1704844800.0, 1705190400.0]) FROM p),
 g AS (SELECT platform, lead(x) OVER w - x AS gap, (x + lead(x) OVER w) / 2 AS mid FROM e WINDOW w AS (PARTITION BY platform ORDER BY x))
 SELECT platform, mid AS scheduled_at, gap FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY gap DESC, abs(mid - 1705017600), mid) AS r FROM g WHERE gap IS NOT NULL) WHERE r = 1"""),
    "q_spread": oracle("requests", body="SELECT platform, event_id, round((row_number() OVER (PARTITION BY platform ORDER BY event_id) - 1)::DOUBLE / (count(*) OVER (PARTITION BY platform)) * ceil(count(*) OVER (PARTITION BY platform) / 8) * 1.5, 4) AS start_at FROM requests"),
    "q_fair_share": oracle("requests", body="SELECT platform, user_id, least(50 // n + CASE WHEN i < 50 % n THEN 1 ELSE 0 END, 3)::BIGINT AS share FROM (SELECT platform, user_id, count(*) OVER (PARTITION BY platform) AS n, row_number() OVER (PARTITION BY platform ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT platform, user_id FROM requests))"),
    "q_consecutive_empty": oracle("polls", body="SELECT user_id, date, slot, (sum(CASE WHEN new_jobs = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY date, slot))::BIGINT AS consecutive_empty FROM (SELECT *, sum(CASE WHEN new_jobs > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY date, slot) AS island FROM polls)"),
    "q_winner": oracle("requests", body=""", v AS (SELECT user_id, class AS ats, count(*) AS n, round(avg(least(100, 60 + ms / 40)), 6) AS confidence FROM requests GROUP BY 1, 2),
 g AS (SELECT user_id, ats, round(confidence * log10(n + 1), 6) AS score, CASE ats WHEN 'ok' THEN 1 WHEN '404' THEN 2 WHEN '429' THEN 3 WHEN 'timeout' THEN 4 ELSE 5 END AS place FROM v WHERE confidence >= 65),
 r AS (SELECT *, row_number() OVER w AS r, lead(ats) OVER w AS a2, lead(score) OVER w AS s2, lead(place) OVER w AS p2 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY score DESC, ats))
 SELECT user_id, CASE WHEN s2 IS NOT NULL AND score - s2 <= 0.10 * score AND p2 < place THEN a2 ELSE ats END AS winner, CASE WHEN s2 IS NOT NULL AND score - s2 <= 0.10 * score AND p2 < place THEN s2 ELSE score END AS score,
 CASE WHEN s2 IS NOT NULL AND score - s2 <= 0.10 * score THEN 'close' ELSE 'clear' END AS call FROM r WHERE r = 1"""),
    "q_priority_queue": oracle("requests", body=""", k AS (SELECT user_id AS company, count(*) % 3 AS checks, count_if(class = 'ok') % 4 AS found, min(ms) AS created, max(ms) AS checked, count_if(class <> 'ok') AS empty FROM requests GROUP BY 1),
 p AS (SELECT *, CASE WHEN checks = 0 THEN 1 WHEN found = 0 THEN 2 ELSE 3 END AS priority FROM k) SELECT company, priority, CASE priority WHEN 1 THEN created WHEN 2 THEN checked ELSE -empty END::BIGINT AS inner_key FROM p ORDER BY 2, 3, 1 LIMIT 50"""),
}

as_text(QUERIES, ORACLE_SQL, {"q_adaptive_score": ["date"], "q_consecutive_empty": ["date"]})
