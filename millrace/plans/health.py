"""Health queries over the events table, and the SQL that each must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import health as H
from .roles import AS_OF, as_text, oracle, role

DAYS = 30


def _health(spark: SparkSession, d: str) -> DataFrame:
    return H.since(H.rollup(role(spark, d, "requests")), AS_OF, DAYS)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return H.since(H.poll_metrics(role(spark, d, "polls")), AS_OF, DAYS)


def _daily(spark: SparkSession, d: str) -> DataFrame:
    rows = H.rollup(role(spark, d, "requests")).groupBy("platform", "date")
    return rows.agg(F.max("max_response_ms").alias("peak"), F.sum("requests_made").alias("made"), F.sum("requests_error").alias("errors")).withColumn("error_pct", H.pct(F.col("errors"), F.col("made"), 4))


def _beats(spark: SparkSession, d: str) -> DataFrame:
    return role(spark, d, "requests").select(F.col("user_id").alias("worker"), "event_id", "ts", "class")


QUERIES = {
    "q_health_rollup": lambda s, d: H.rollup(role(s, d, "requests")),
    "q_health_summary": lambda s, d: H.summary(_health(s, d)),
    "q_error_rates": lambda s, d: H.error_rates(_health(s, d)),
    "q_baseline_rate": lambda s, d: H.baseline(_health(s, d)),
    "q_slow_bound": lambda s, d: H.slow_bound(_health(s, d)),
    "q_event_counts": lambda s, d: H.event_counts(role(s, d, "scaling")),
    "q_effectiveness": lambda s, d: H.effectiveness(role(s, d, "scaling")),
    "q_poll_metrics": lambda s, d: H.poll_metrics(role(s, d, "polls")),
    "q_miss_rate": lambda s, d: H.miss_rate(_metrics(s, d)),
    "q_age_buckets": lambda s, d: H.age_buckets(_metrics(s, d)),
    "q_waste_rate": lambda s, d: H.waste_rate(_metrics(s, d)),
    "q_oscillation": lambda s, d: H.oscillation(_metrics(s, d)),
    "q_early_exit": lambda s, d: H.early_exit(_metrics(s, d)),
    "q_percentiles": lambda s, d: H.scaling_params(_health(s, d), role(s, d, "polls")),
    "q_herd": lambda s, d: H.herd(role(s, d, "requests"), "ts", 1440),
    "q_error_window": lambda s, d: H.error_window(role(s, d, "requests")),
    "q_spike": lambda s, d: H.spikes(H.error_window(role(s, d, "requests"), 3600), H.baseline(_health(s, d))),
    "q_streak_alert": lambda s, d: H.streaks(_daily(s, d), "error_pct", 15.0),
    "q_run_alerts": lambda s, d: H.run_alerts(H.summary(_health(s, d))),
    "q_stall_vote": lambda s, d: H.stall_votes(_daily(s, d).select("platform", "date", F.col("errors").alias("overdue"), (F.col("made") % 3).alias("head"), (F.col("made") % 2).alias("processed"))),
    "q_hung": lambda s, d: H.hung(_beats(s, d).groupBy("worker").agg(F.max("ts").alias("last_beat")), _beats(s, d).where("class = '429'").select("worker").distinct()),
    "q_liveness_gaps": lambda s, d: H.liveness_gaps(_beats(s, d), 24),
    "q_sliding_60s": lambda s, d: H.sliding_count(role(s, d, "requests"), "platform", 60),
    "q_interarrival": lambda s, d: H.interarrival(role(s, d, "requests"), "platform", 60.0, 86400.0),
    "q_peak_buffer": lambda s, d: H.peak_buffer(_daily(s, d)),
    "q_rising": lambda s, d: H.rising(_daily(s, d)),
    "q_alert_dedup": lambda s, d: H.alert_dedup(role(s, d, "requests").where("class <> 'ok'").withColumnRenamed("class", "kind")),
    "q_backoff": lambda s, d: role(s, d, "requests").groupBy("user_id").agg(F.count_if(F.col("class") == "429").alias("failures")).select("user_id", "failures", H.backoff(F.col("failures")).alias("delay_s")),
    "q_slot": lambda s, d: s.read.parquet(f"{d}/customer.parquet").select("c_custkey", H.slot(F.col("c_name")).alias("slot")),
    "q_drain_target": lambda s, d: H.drain_target(H.summary(_health(s, d)).select("platform", F.col("total_errors").alias("depth"), (F.col("avg_response_ms") / 1000).alias("fetch_p75"), F.lit(60.0).alias("time_left"), (F.col("total_requests") / 86400).alias("arrivals"))),
}

_HEALTH = """, health AS (SELECT date, platform, context, count(*) AS requests_made, count_if(class = 'ok')::BIGINT AS requests_ok, count_if(class = 'timeout')::BIGINT AS requests_timeout,
 count_if(class = '5xx')::BIGINT AS requests_5xx, count_if(class = '429')::BIGINT AS requests_429, count_if(class = '404')::BIGINT AS requests_404, count_if(class <> 'ok')::BIGINT AS requests_error,
 sum(ms)::BIGINT AS total_ms, max(ms) AS max_response_ms, min(CASE WHEN class = '429' THEN ts END) AS first_429_at, floor(sum(ms) / count(*))::BIGINT AS avg_response_ms FROM requests GROUP BY 1, 2, 3)"""
_RECENT = _HEALTH + ", recent AS (SELECT * FROM health WHERE date >= DATE '2024-01-31' - 30)"
_METRICS = """, metrics AS (SELECT date, user_id AS company, platform, sum(new_jobs)::BIGINT AS total_new_jobs, sum(CASE WHEN tier = 1 THEN new_jobs ELSE 0 END)::BIGINT AS tier1_new_jobs,
 sum(CASE WHEN tier = 2 THEN new_jobs ELSE 0 END)::BIGINT AS tier2_new_jobs, count(*) AS total_polls, count_if(new_jobs = 0)::BIGINT AS wasted_polls, sum(found_1h)::BIGINT AS found_within_1hr, sum(found_4h)::BIGINT AS found_within_4hr,
 sum(found_24h)::BIGINT AS found_within_24hr, (sum(new_jobs) - sum(found_24h))::BIGINT AS found_after_24hr, sum(missed)::BIGINT AS early_exit_missed, sum(new_jobs)::DOUBLE / count(*) AS poll_score FROM polls GROUP BY 1, 2, 3),
 m AS (SELECT * FROM metrics WHERE date >= DATE '2024-01-31' - 30)"""
_DAILY = _HEALTH + """, daily AS (SELECT platform, date, max(max_response_ms) AS peak, sum(requests_made)::BIGINT AS made, sum(requests_error)::BIGINT AS errors, round(100.0::DOUBLE * sum(requests_error) / sum(requests_made), 4) AS error_pct FROM health GROUP BY 1, 2)"""
_SUMMARY = """SELECT platform, sum(requests_made)::BIGINT AS total_requests, sum(requests_ok)::BIGINT AS total_ok, sum(requests_429)::BIGINT AS total_429s, sum(requests_404)::BIGINT AS total_404s, sum(requests_error)::BIGINT AS total_errors,
 round(100.0::DOUBLE * sum(requests_429) / sum(requests_made), 1) AS rate_429_pct, round(100.0::DOUBLE * sum(requests_error) / sum(requests_made), 1) AS error_pct, round(sum(total_ms)::DOUBLE / sum(requests_made), 3) AS avg_response_ms,
 max(max_response_ms) AS max_response_ms, count(DISTINCT date) AS days_active FROM recent GROUP BY 1"""
_BASE = """SELECT platform, count(DISTINCT date) AS days_with_data, CASE WHEN count(DISTINCT date) >= 7 THEN round(sum(requests_error)::DOUBLE / sum(requests_made), 6) ELSE 0.0::DOUBLE END AS baseline_rate,
 round(sum(total_ms)::DOUBLE / sum(requests_made), 3) AS mean_ms FROM recent WHERE context = 'normal' AND requests_made > 0 GROUP BY 1"""
_WINDOW = """(SELECT platform, bucket, sum(n) OVER w AS requests, sum(e) OVER w AS errors, round(sum(e) OVER w::DOUBLE / sum(n) OVER w, 6) AS error_rate
 FROM (SELECT platform, (epoch_us(ts) // {us})::BIGINT AS bucket, count(*) AS n, count_if(class <> 'ok') AS e FROM requests GROUP BY 1, 2) WINDOW w AS (PARTITION BY platform ORDER BY bucket RANGE BETWEEN 1 PRECEDING AND CURRENT ROW))"""
_METRIC_PCT = "CASE WHEN sum({b}) > 0 THEN round(100.0::DOUBLE * sum({a}) / sum({b}), 1) ELSE {e} END"


def _w(seconds: int) -> str:
    return _WINDOW.replace("{us}", str(seconds * 1_000_000)).replace("sum(e) OVER w::DOUBLE", "(sum(e) OVER w)::DOUBLE")


ORACLE_SQL = {
    "q_health_rollup": oracle("requests", body=_HEALTH + " SELECT * FROM health"),
    "q_health_summary": oracle("requests", body=f"{_RECENT} {_SUMMARY}"),
    "q_error_rates": oracle("requests", body=_RECENT + """ SELECT platform, sum(requests_made)::BIGINT AS requests_made, sum(requests_error)::BIGINT AS total_errors, round(100.0::DOUBLE * sum(requests_error) / sum(requests_made), 1) AS error_rate_pct,
 round(sum(total_ms)::DOUBLE / sum(requests_made), 3) AS avg_response_ms, count(DISTINCT date) AS days_with_data FROM recent WHERE context = 'normal' GROUP BY 1"""),
    "q_baseline_rate": oracle("requests", body=f"{_RECENT} {_BASE}"),
    "q_slow_bound": oracle("requests", body=_RECENT + " SELECT platform, greatest(1000, floor(avg(max_response_ms) * 1.5)::BIGINT) AS bound_ms, quantile_cont(max_response_ms, 0.95) AS p95_of_maxima FROM recent WHERE context = 'normal' AND max_response_ms > 0 GROUP BY 1"),
    "q_event_counts": oracle("scaling", body="SELECT t AS event_type, count(event_type) AS n FROM (VALUES ('worker_add'), ('worker_remove'), ('outage_start'), ('outage_end'), ('canary_probe'), ('ceiling_learned')) k(t) LEFT JOIN scaling ON event_type = t GROUP BY 1 UNION ALL SELECT 'total_events', count(*) FROM scaling"),
    "q_effectiveness": oracle("scaling", body="""SELECT platform, count_if(event_type = 'worker_remove')::BIGINT AS reductions, count_if(event_type = 'ceiling_learned')::BIGINT AS effective_reductions, count_if(event_type = 'outage_start')::BIGINT AS escalated_to_outage,
 count_if(event_type = 'outage_end')::BIGINT AS outages_resolved, round(avg(CASE WHEN event_type = 'worker_remove' THEN error_rate END) * 100, 1) AS avg_error_at_reduce, round(avg(CASE WHEN event_type = 'ceiling_learned' THEN error_rate END) * 100, 1) AS avg_error_at_recovery,
 CASE WHEN count_if(event_type = 'worker_remove') > 0 THEN round(100.0::DOUBLE * count_if(event_type = 'ceiling_learned') / count_if(event_type = 'worker_remove'), 1) END AS effectiveness_pct
 FROM scaling GROUP BY 1 HAVING count_if(event_type IN ('worker_remove', 'outage_start', 'ceiling_learned')) > 0"""),
    "q_poll_metrics": oracle("polls", body=_METRICS + " SELECT * FROM metrics"),
    "q_miss_rate": oracle("polls", body=_METRICS + f" SELECT platform, sum(total_new_jobs)::BIGINT AS total_new_jobs, sum(tier1_new_jobs)::BIGINT AS tier1_new_jobs, sum(tier2_new_jobs)::BIGINT AS tier2_new_jobs, {_METRIC_PCT.format(a='tier2_new_jobs', b='total_new_jobs', e='0')} AS miss_rate_pct, count(DISTINCT date) AS days_with_data FROM m GROUP BY 1 HAVING sum(total_new_jobs) > 0"),
    "q_age_buckets": oracle("polls", body=_METRICS + " SELECT sum(total_new_jobs)::BIGINT AS total_new_jobs, " + ", ".join(f"sum({c})::BIGINT AS {n}, {_METRIC_PCT.format(a=c, b='total_new_jobs', e='NULL')} AS {n}_pct" for n, c in (("within_1hr", "found_within_1hr"), ("within_4hr", "found_within_4hr"), ("within_24hr", "found_within_24hr"), ("after_24hr", "found_after_24hr"))) + " FROM m"),
    "q_waste_rate": oracle("polls", body=_METRICS + f" SELECT platform, sum(total_polls)::BIGINT AS total_polls, sum(wasted_polls)::BIGINT AS wasted_polls, {_METRIC_PCT.format(a='wasted_polls', b='total_polls', e='0')} AS wasted_rate_pct, count(DISTINCT date) AS days_with_data FROM m GROUP BY 1"),
    "q_oscillation": oracle("polls", body=_METRICS + " SELECT platform, count(DISTINCT date) AS days_with_data, round(avg(poll_score), 2) AS avg_score, min(poll_score) AS min_score, max(poll_score) AS max_score, round(stddev_pop(poll_score), 3) AS score_stddev, max(poll_score) - min(poll_score) AS score_range FROM m GROUP BY 1 HAVING count(DISTINCT date) >= 3"),
    "q_early_exit": oracle("polls", body=_METRICS + f" SELECT platform, sum(early_exit_missed)::BIGINT AS total_missed, sum(total_new_jobs)::BIGINT AS total_new_jobs, {_METRIC_PCT.format(a='early_exit_missed', b='total_new_jobs', e='NULL')} AS missed_rate_pct, count(DISTINCT date) AS days_with_data FROM m GROUP BY 1 HAVING sum(early_exit_missed) + sum(total_new_jobs) > 0"),
    "q_percentiles": oracle("requests", "polls", body=_RECENT + """ SELECT platform, fetch_p75, interval_p10, delay_warn FROM (SELECT platform, quantile_cont(floor(total_ms / requests_made), 0.75) AS fetch_p75 FROM recent WHERE requests_made > 0 GROUP BY 1)
 JOIN (SELECT platform, quantile_cont(new_jobs::DOUBLE, 0.10) * 0.10 AS interval_p10, round(greatest(avg(new_jobs) * 0.10, 0.05), 6) AS delay_warn FROM polls GROUP BY 1) USING (platform)"""),
    "q_herd": oracle("requests", body="""SELECT platform, bucket, n, round(share, 6) AS share, CASE WHEN share > 0.3 THEN 'herd' WHEN share >= 0.15 THEN 'spike' ELSE 'even' END AS level
 FROM (SELECT platform, bucket, n, n::DOUBLE / sum(n) OVER (PARTITION BY platform) AS share FROM (SELECT platform, (epoch_us(ts) // 86400000000)::BIGINT AS bucket, count(*) AS n FROM requests GROUP BY 1, 2))"""),
    "q_error_window": oracle("requests", body=f"SELECT platform, bucket, requests::BIGINT AS requests, errors::BIGINT AS errors, error_rate FROM {_w(600)}"),
    "q_spike": oracle("requests", body=f"""{_RECENT}, base AS ({_BASE}) SELECT platform, bucket, error_rate, round(error_rate / (baseline_rate + 0.001), 4) AS spike_factor,
 CASE WHEN error_rate / (baseline_rate + 0.001) > 5 THEN -2 WHEN error_rate / (baseline_rate + 0.001) > 1 THEN -1 WHEN error_rate < 0.02 THEN 1 ELSE 0 END AS step FROM {_w(3600)} JOIN base USING (platform) WHERE requests >= 3"""),
    "q_streak_alert": oracle("requests", body=_DAILY + """ SELECT platform, max(date) AS last_date, min(error_pct) AS least_pct, round(avg(error_pct), 4) AS mean_pct FROM (SELECT *, row_number() OVER (PARTITION BY platform ORDER BY date DESC) AS r FROM daily) WHERE r <= 3 GROUP BY 1
 HAVING count(*) = 3 AND max(date) - min(date) = 2 AND min(error_pct) >= 15"""),
    "q_run_alerts": oracle("requests", body=f"""{_RECENT}, s AS ({_SUMMARY}) SELECT platform, 'rate_limit_critical' AS alert FROM s WHERE rate_429_pct >= 10 UNION ALL SELECT platform, 'rate_limit_warning' FROM s WHERE rate_429_pct >= 2 AND rate_429_pct < 10
 UNION ALL SELECT platform, 'errors_high' FROM s WHERE error_pct >= 20 UNION ALL SELECT platform, 'slow' FROM s WHERE avg_response_ms >= 500"""),
    "q_stall_vote": oracle("requests", body=_DAILY + """ SELECT platform, date, votes::INTEGER AS votes, CASE WHEN votes = 3 THEN 'error' WHEN votes >= 2 THEN 'warning' ELSE 'ok' END AS level FROM (SELECT platform, date, (CASE WHEN errors >= lag(errors) OVER w THEN 1 ELSE 0 END)
 + (CASE WHEN abs(made % 3 - lag(made % 3) OVER w) <= 1 THEN 1 ELSE 0 END) + (CASE WHEN made % 2 = lag(made % 2) OVER w THEN 1 ELSE 0 END) AS votes FROM daily WINDOW w AS (PARTITION BY platform ORDER BY date))"""),
    "q_hung": oracle("requests", body="SELECT user_id AS worker, max(ts) AS last_beat FROM requests GROUP BY 1 HAVING count_if(class = '429') = 0"),
    "q_liveness_gaps": oracle("requests", body="SELECT user_id AS worker, since, until FROM (SELECT user_id, ts AS until, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM requests) WHERE until - since > INTERVAL 24 HOUR"),
    "q_sliding_60s": oracle("requests", body="SELECT platform, event_id, count(*) OVER w AS requests, (sum(ms) OVER w)::BIGINT AS weight FROM (SELECT *, epoch_us(ts) AS us FROM requests) WINDOW w AS (PARTITION BY platform ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW)"),
    "q_interarrival": oracle("requests", body="SELECT platform, round(avg(gap), 3) AS mean_gap_s, round(least(greatest(avg(gap) * 2, 60.0), 86400.0), 3) AS ttl_s FROM (SELECT platform, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY platform ORDER BY ts, event_id)) / 1e6 AS gap FROM requests) GROUP BY 1"),
    "q_peak_buffer": oracle("requests", body=_DAILY + """ SELECT platform, date, max(peak) OVER (w RANGE BETWEEN 27 PRECEDING AND CURRENT ROW) AS peak_28d,
 round(greatest(coalesce((max(peak) OVER (w RANGE BETWEEN 6 PRECEDING AND CURRENT ROW))::DOUBLE / (max(peak) OVER (w RANGE BETWEEN 27 PRECEDING AND 7 PRECEDING)) - 1, 0.0), 0.0), 6) AS growth,
 round(coalesce(stddev_samp(peak) OVER (w RANGE BETWEEN 27 PRECEDING AND CURRENT ROW), 0.0) * 0.25, 6) AS volatility FROM (SELECT *, date - DATE '2000-01-01' AS day FROM daily) WINDOW w AS (PARTITION BY platform ORDER BY day)"""),
    "q_rising": oracle("requests", body=_DAILY + """ SELECT platform, date, ups::BIGINT AS ups, ups >= 3 AS rising FROM (SELECT platform, date, sum(up) OVER (PARTITION BY platform ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS ups
 FROM (SELECT platform, date, CASE WHEN peak > lag(peak) OVER (PARTITION BY platform ORDER BY date) THEN 1 ELSE 0 END AS up FROM daily))"""),
    "q_alert_dedup": oracle("requests", body="SELECT platform, class AS kind, event_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY platform, class ORDER BY ts, event_id) AS gap FROM requests WHERE class <> 'ok') WHERE gap IS NULL OR gap > INTERVAL 24 HOUR"),
    "q_backoff": oracle("requests", body="SELECT user_id, failures, CASE WHEN failures >= 5 THEN 86400 ELSE least(3600, (300 * pow(2, failures))::BIGINT) END::BIGINT AS delay_s FROM (SELECT user_id, count_if(class = '429')::BIGINT AS failures FROM requests GROUP BY 1)"),
    "q_slot": "SELECT c_custkey, list_reduce(list_transform(string_split(md5(c_name), ''), lambda x: (instr('0123456789abcdef', x) - 1)::BIGINT), lambda a, x: (a * 16 + x) % 86400) AS slot FROM customer",
    "q_drain_target": oracle("requests", body=f"{_RECENT}, s AS ({_SUMMARY}) SELECT platform, greatest(1, least(ceil(total_errors * (avg_response_ms / 1000) / 60.0 + (total_requests / 86400) * (avg_response_ms / 1000)), 50))::BIGINT AS workers FROM s"),
}

as_text(QUERIES, ORACLE_SQL, {"q_health_rollup": ["date", "first_429_at"], "q_poll_metrics": ["date"], "q_streak_alert": ["last_date"], "q_stall_vote": ["date"], "q_peak_buffer": ["date"], "q_rising": ["date"], "q_hung": ["last_beat"], "q_liveness_gaps": ["since", "until"]})
