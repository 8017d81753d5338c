"""Request health: rollups, rates, baselines, percentiles, windows, streaks and alert rules.

Each function takes DataFrames and times and returns a DataFrame. Counts are summed before the
shuffle; windows are over one platform's days or one key's few rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold

KINDS = ("timeout", "5xx", "429", "404")
SCALING_TYPES = ("worker_add", "worker_remove", "outage_start", "outage_end", "canary_probe", "ceiling_learned")

#: A stretch of time that a task counts sliding windows in, as a multiple of the window.
STRETCH = 16


def pct(part: Column, whole: Column, digits: int = 1, empty: float | None = 0.0) -> Column:
    """100 * part / whole, rounded; empty where whole is not over 0."""
    return F.when(whole > 0, F.round(F.lit(100.0).cast("double") * part / whole, digits)).otherwise(F.lit(empty).cast("double"))


def rollup(requests: DataFrame) -> DataFrame:
    """Request events to one row a date, platform and context. The mean is truncated, as counters are."""
    total, made = F.sum("ms"), F.count("*")
    return requests.groupBy("date", "platform", "context").agg(
        made.alias("requests_made"),
        F.count_if(F.col("class") == "ok").alias("requests_ok"),
        *[F.count_if(F.col("class") == k).alias(f"requests_{k}") for k in KINDS],
        F.count_if(F.col("class") != "ok").alias("requests_error"),
        total.alias("total_ms"),
        F.max("ms").alias("max_response_ms"),
        F.min(F.when(F.col("class") == "429", F.col("ts"))).alias("first_429_at"),
        F.floor(total / made).cast("bigint").alias("avg_response_ms"),
    )


def since(df: DataFrame, as_of: str, days: int, column: str = "date") -> DataFrame:
    """Rows of the days before as_of."""
    return df.where(F.col(column) >= F.date_sub(F.to_date(F.lit(as_of)), days))


def summary(health: DataFrame) -> DataFrame:
    """Per platform: sums, percentages, the mean weighted by requests, days with data."""
    made = F.sum("requests_made")
    return health.groupBy("platform").agg(
        made.alias("total_requests"),
        F.sum("requests_ok").alias("total_ok"),
        F.sum("requests_429").alias("total_429s"),
        F.sum("requests_404").alias("total_404s"),
        F.sum("requests_error").alias("total_errors"),
        pct(F.sum("requests_429"), made).alias("rate_429_pct"),
        pct(F.sum("requests_error"), made).alias("error_pct"),
        F.round(F.sum("total_ms") / made, 3).alias("avg_response_ms"),
        F.max("max_response_ms").alias("max_response_ms"),
        F.count_distinct("date").alias("days_active"),
    )


def error_rates(health: DataFrame) -> DataFrame:
    """Per platform over normal requests, the highest rate of errors first."""
    made = F.sum("requests_made")
    return health.where("context = 'normal'").groupBy("platform").agg(
        made.alias("requests_made"), F.sum("requests_error").alias("total_errors"), pct(F.sum("requests_error"), made).alias("error_rate_pct"),
        F.round(F.sum("total_ms") / made, 3).alias("avg_response_ms"), F.count_distinct("date").alias("days_with_data"),
    )


def baseline(health: DataFrame, least_days: int = 7) -> DataFrame:
    """Per platform the share of errors among normal requests, 0 before there are enough days, and the mean latency."""
    made = F.sum("requests_made")
    rows = health.where("context = 'normal' and requests_made > 0").groupBy("platform")
    rate = F.when(F.count_distinct("date") >= least_days, F.round(F.sum("requests_error") / made, 6)).otherwise(0.0)
    return rows.agg(F.count_distinct("date").alias("days_with_data"), rate.alias("baseline_rate"), F.round(F.sum("total_ms") / made, 3).alias("mean_ms"))


def slow_bound(health: DataFrame, factor: float = 1.5, least: int = 1000) -> DataFrame:
    """The named heuristic: the mean of daily maxima by a factor, whole and at least `least`; beside it the true percentile of them."""
    rows = health.where("context = 'normal' and max_response_ms > 0").groupBy("platform")
    bound = F.greatest(F.lit(least).cast("bigint"), F.floor(F.avg("max_response_ms") * factor).cast("bigint"))
    return rows.agg(bound.alias("bound_ms"), F.expr("percentile_cont(0.95) WITHIN GROUP (ORDER BY max_response_ms)").alias("p95_of_maxima"))


def event_counts(scaling: DataFrame) -> DataFrame:
    """Events of each known type, zeros included, and of all."""
    seen = scaling.groupBy("event_type").agg(F.count("*").alias("n"))
    known = scaling.sparkSession.createDataFrame([(t,) for t in SCALING_TYPES], "event_type string")
    total = scaling.agg(F.lit("total_events").alias("event_type"), F.count("*").alias("n"))
    return known.join(seen, "event_type", "left").select("event_type", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).unionByName(total)


def effectiveness(scaling: DataFrame) -> DataFrame:
    """What became of reductions, per platform: sums and means under conditions."""
    is_ = lambda t: F.col("event_type") == t
    removed = F.count_if(is_("worker_remove"))
    mean = lambda t: F.round(F.avg(F.when(is_(t), F.col("error_rate"))) * 100, 1)
    rows = scaling.groupBy("platform").agg(
        removed.alias("reductions"), F.count_if(is_("ceiling_learned")).alias("effective_reductions"), F.count_if(is_("outage_start")).alias("escalated_to_outage"), F.count_if(is_("outage_end")).alias("outages_resolved"),
        mean("worker_remove").alias("avg_error_at_reduce"), mean("ceiling_learned").alias("avg_error_at_recovery"), pct(F.count_if(is_("ceiling_learned")), removed, 1, None).alias("effectiveness_pct"),
    )
    return rows.where("reductions + escalated_to_outage + effective_reductions > 0")


def poll_metrics(polls: DataFrame) -> DataFrame:
    """Polls to one row a date and company: the producer of what the readers below read, poll_score included."""
    found = F.sum("new_jobs")
    return polls.groupBy("date", F.col("user_id").alias("company"), "platform").agg(
        found.alias("total_new_jobs"), F.sum(F.when(F.col("tier") == 1, F.col("new_jobs")).otherwise(0)).alias("tier1_new_jobs"), F.sum(F.when(F.col("tier") == 2, F.col("new_jobs")).otherwise(0)).alias("tier2_new_jobs"),
        F.count("*").alias("total_polls"), F.count_if(F.col("new_jobs") == 0).alias("wasted_polls"),
        F.sum("found_1h").alias("found_within_1hr"), F.sum("found_4h").alias("found_within_4hr"), F.sum("found_24h").alias("found_within_24hr"), (found - F.sum("found_24h")).alias("found_after_24hr"),
        F.sum("missed").alias("early_exit_missed"), (found / F.count("*")).alias("poll_score"),
    )


def miss_rate(metrics: DataFrame) -> DataFrame:
    total = F.sum("total_new_jobs")
    rows = metrics.groupBy("platform").agg(total.alias("total_new_jobs"), F.sum("tier1_new_jobs").alias("tier1_new_jobs"), F.sum("tier2_new_jobs").alias("tier2_new_jobs"), pct(F.sum("tier2_new_jobs"), total).alias("miss_rate_pct"), F.count_distinct("date").alias("days_with_data"))
    return rows.where("total_new_jobs > 0")


def age_buckets(metrics: DataFrame) -> DataFrame:
    """Cumulative counts of how soon postings were found, and their shares; one row."""
    total = F.sum("total_new_jobs")
    names = {"within_1hr": "found_within_1hr", "within_4hr": "found_within_4hr", "within_24hr": "found_within_24hr", "after_24hr": "found_after_24hr"}
    return metrics.agg(total.alias("total_new_jobs"), *[F.sum(c).alias(n) for n, c in names.items()], *[pct(F.sum(c), total, 1, None).alias(f"{n}_pct") for n, c in names.items()])


def waste_rate(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("platform").agg(F.sum("total_polls").alias("total_polls"), F.sum("wasted_polls").alias("wasted_polls"), pct(F.sum("wasted_polls"), F.sum("total_polls")).alias("wasted_rate_pct"), F.count_distinct("date").alias("days_with_data"))


def oscillation(metrics: DataFrame, least_days: int = 3) -> DataFrame:
    rows = metrics.where("poll_score is not null").groupBy("platform").agg(
        F.count_distinct("date").alias("days_with_data"), F.round(F.avg("poll_score"), 2).alias("avg_score"), F.min("poll_score").alias("min_score"), F.max("poll_score").alias("max_score"),
        F.round(F.stddev_pop("poll_score"), 3).alias("score_stddev"), (F.max("poll_score") - F.min("poll_score")).alias("score_range"),
    )
    return rows.where(F.col("days_with_data") >= least_days)


def early_exit(metrics: DataFrame) -> DataFrame:
    total, missed = F.sum("total_new_jobs"), F.sum("early_exit_missed")
    rows = metrics.groupBy("platform").agg(missed.alias("total_missed"), total.alias("total_new_jobs"), pct(missed, total, 1, None).alias("missed_rate_pct"), F.count_distinct("date").alias("days_with_data"))
    return rows.where("total_missed + total_new_jobs > 0")


def scaling_params(health: DataFrame, polls: DataFrame) -> DataFrame:
    """Ordered-set percentiles that size worker pools, with floors; one row a platform."""
    busy = health.where("requests_made > 0").select("platform", F.floor(F.col("total_ms") / F.col("requests_made")).alias("x"))
    p75 = busy.groupBy("platform").agg(F.expr("percentile_cont(0.75) WITHIN GROUP (ORDER BY x)").alias("fetch_p75"))
    seen = polls.groupBy("platform").agg((F.expr("percentile_cont(0.10) WITHIN GROUP (ORDER BY new_jobs)") * 0.10).alias("interval_p10"), F.greatest(F.avg("new_jobs") * 0.10, F.lit(0.05)).alias("delay_warn"))
    return p75.join(seen, "platform").select("platform", "fetch_p75", "interval_p10", F.round("delay_warn", 6).alias("delay_warn"))


def herd(points: DataFrame, ts: str, minutes: int, flag: float = 0.30, spike: float = 0.15) -> DataFrame:
    """Buckets of time with their counts and shares of each key's whole; flags the crowded ones."""
    slot = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (minutes * 60_000_000)).cast("bigint")
    rows = points.groupBy("platform", slot.alias("bucket")).agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("platform"))
    level = F.when(share > flag, "herd").when(share >= spike, "spike").otherwise("even")
    return rows.select("platform", "bucket", "n", F.round(share, 6).alias("share"), level.alias("level"))


def error_window(requests: DataFrame, seconds: int = 600) -> DataFrame:
    """bucket2: errors and requests of each tumbling bucket with those of the bucket just before; a span of 10 to 20 minutes at the default."""
    bucket = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000)).cast("bigint")
    rows = requests.groupBy("platform", bucket.alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("class") != "ok").alias("e"))
    w = Window.partitionBy("platform").orderBy("bucket").rangeBetween(-1, 0)
    return rows.select("platform", "bucket", F.sum("n").over(w).alias("requests"), F.sum("e").over(w).alias("errors"), F.round(F.sum("e").over(w) / F.sum("n").over(w), 6).alias("error_rate"))


def spikes(window: DataFrame, base: DataFrame, least_requests: int = 3) -> DataFrame:
    """The step that a concurrency limit takes: e / (b + 0.001) over 5 takes 2, over 1 takes 1; under 2 % gives 1."""
    factor = F.col("error_rate") / (F.col("baseline_rate") + 0.001)
    step = F.when(factor > 5, -2).when(factor > 1, -1).when(F.col("error_rate") < 0.02, 1).otherwise(0)
    rows = window.where(F.col("requests") >= least_requests).join(base.select("platform", "baseline_rate"), "platform")
    return rows.select("platform", "bucket", "error_rate", F.round(factor, 4).alias("spike_factor"), step.alias("step"))


def streaks(daily: DataFrame, measure: str, threshold: float, days: int = 3) -> DataFrame:
    """Platforms whose most recent days are successive and all reach the threshold."""
    recent = Window.partitionBy("platform").orderBy(F.col("date").desc())
    rows = daily.select("platform", "date", measure, F.row_number().over(recent).alias("rank")).where(F.col("rank") <= days)
    got = rows.groupBy("platform").agg(F.count("*").alias("n"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.min(measure).alias("low"), F.round(F.avg(measure), 4).alias("mean"), F.max("date").alias("last_date"))
    return got.where((F.col("n") == days) & (F.col("span") == days - 1) & (F.col("low") >= threshold)).select("platform", "last_date", F.col("low").alias("least_pct"), F.col("mean").alias("mean_pct"))


def run_alerts(summary_: DataFrame) -> DataFrame:
    """Alert rows by rule, from a platform's summary: errors, rate limits and latency."""
    rules = [
        ("rate_limit_critical", F.col("rate_429_pct") >= 10),
        ("rate_limit_warning", (F.col("rate_429_pct") >= 2) & (F.col("rate_429_pct") < 10)),
        ("errors_high", F.col("error_pct") >= 20),
        ("slow", F.col("avg_response_ms") >= 500),
    ]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return summary_.select("platform", F.explode(found).alias("alert"))


def stall_votes(snapshots: DataFrame) -> DataFrame:
    """Of three signs (not shrinking, same head, nothing processed), how many hold against the snapshot before; 3 is an error, 2 a warning."""
    w = Window.partitionBy("platform").orderBy("date")
    sign = lambda c: F.when(c, 1).otherwise(0)
    votes = sign(F.col("overdue") >= F.lag("overdue").over(w)) + sign(F.abs(F.col("head") - F.lag("head").over(w)) <= 1) + sign(F.col("processed") == F.lag("processed").over(w))
    rows = snapshots.select("platform", "date", votes.alias("votes"))
    return rows.select("platform", "date", "votes", F.when(F.col("votes") == 3, "error").when(F.col("votes") >= 2, "warning").otherwise("ok").alias("level"))


def hung(beats: DataFrame, progress: DataFrame) -> DataFrame:
    """Workers with a heartbeat but without progress."""
    return beats.join(progress, "worker", "left_anti").select("worker", "last_beat")


def liveness_gaps(beats: DataFrame, hours: int) -> DataFrame:
    """Gaps of more than so many hours between a worker's beats."""
    w = Window.partitionBy("worker").orderBy("ts", "event_id")
    rows = beats.select("worker", F.col("ts").alias("until"), F.lag("ts").over(w).alias("since"))
    gap = F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))
    return rows.where(gap > hours * 3_600_000_000).select("worker", "since", "until")


def sliding_count(events: DataFrame, key: str, seconds: int) -> DataFrame:
    """For each event how many of its key fell in the seconds up to it, the far end left out; two limits a row, requests and weight.

    Windows are within stretches of time, so that a key with very many events is dealt to many
    tasks; the last seconds of a stretch are copied to the next one, which looks back on them.
    """
    width, back = STRETCH * seconds * 1_000_000, seconds * 1_000_000
    rows = events.select(key, "event_id", "ms", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    own = F.floor(F.col("us") / width).cast("bigint")
    late = F.pmod("us", F.lit(width)) > width - back
    stretches = F.when(late, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = rows.select("*", F.posexplode(stretches).alias("copy", "stretch"))
    w = Window.partitionBy(key, "stretch").orderBy("us").rangeBetween(-back + 1, 0)
    counted = dealt.select(key, "event_id", "copy", F.count("*").over(w).alias("requests"), F.sum("ms").over(w).alias("weight"))
    return counted.where("copy = 0").drop("copy")


def interarrival(events: DataFrame, key: str, low: float, high: float) -> DataFrame:
    """A key's mean gap between events in seconds, twice of which, clamped, is its time to live. The gaps' sum is the last time less the first."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = events.groupBy(key).agg(F.min(us).alias("first"), F.max(us).alias("last"), F.count(us).alias("n"))
    mean = F.when(F.col("n") > 1, (F.col("last") - F.col("first")) / 1e6 / (F.col("n") - 1))
    return rows.select(key, F.round(mean, 3).alias("mean_gap_s"), F.when(mean.isNotNull(), F.round(F.least(F.greatest(mean * 2, F.lit(low)), F.lit(high)), 3)).alias("ttl_s"))


def peak_buffer(daily: DataFrame) -> DataFrame:
    """28-day peak, growth of the last week over the weeks before, and a quarter of the deviation."""
    back = lambda a, b: Window.partitionBy("platform").orderBy("day").rangeBetween(-a, -b)
    rows = daily.withColumn("day", F.datediff("date", F.lit("2000-01-01").cast("date")))
    last, before = F.max("peak").over(back(6, 0)), F.max("peak").over(back(27, 7))
    growth = F.greatest(F.coalesce(last / before - 1, F.lit(0.0)), F.lit(0.0))
    return rows.select("platform", "date", F.max("peak").over(back(27, 0)).alias("peak_28d"), F.round(growth, 6).alias("growth"), F.round(F.coalesce(F.stddev_samp("peak").over(back(27, 0)), F.lit(0.0)) * 0.25, 6).alias("volatility"))


def rising(daily: DataFrame) -> DataFrame:
    """Whether at least 3 of the last 4 steps rose."""
    w = Window.partitionBy("platform").orderBy("date")
    up = F.when(F.col("peak") > F.lag("peak").over(w), 1).otherwise(0)
    rows = daily.select("platform", "date", up.alias("up"))
    ups = F.sum("up").over(w.rowsBetween(-3, 0))
    return rows.select("platform", "date", ups.alias("ups"), (ups >= 3).alias("rising"))


def alert_dedup(alerts: DataFrame, hours: int = 24) -> DataFrame:
    """Alerts with none of their type and platform in the hours before; all earlier ones count, raised or not.

    Within stretches of that many hours the alert before is looked up by a window; before a
    stretch's first one it is the last of the stretch before, if there is any.
    """
    width = hours * 3_600_000_000
    rows = alerts.select("platform", "kind", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = rows.withColumn("stretch", F.floor(F.col("us") / width).cast("bigint"))
    last = rows.groupBy("platform", "kind", (F.col("stretch") + 1).alias("stretch")).agg(F.max("us").alias("last"))
    w = Window.partitionBy("platform", "kind", "stretch").orderBy("us", "event_id")
    rows = rows.withColumn("before", F.lag("us").over(w)).join(last, ["platform", "kind", "stretch"], "left")
    gap = F.col("us") - F.coalesce("before", "last")
    return rows.where(gap.isNull() | (gap > width)).select("platform", "kind", "event_id")


def backoff(failures: Column) -> Column:
    """Seconds to wait: 300 doubled for each failure up to 3600, a day from the fifth."""
    return F.when(failures >= 5, F.lit(86400).cast("bigint")).otherwise(F.least(F.lit(3600).cast("bigint"), (300 * F.pow(F.lit(2), failures)).cast("bigint")))


def slot(key: Column, slots: int = 86400) -> Column:
    """The MD5 of a key as a number, modulo the slots: hex digits folded, as 128 bits fit no type."""
    digits = F.split(F.md5(key.cast("string").cast("binary")), "")
    return F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0).cast("bigint"), lambda a, d: (a * 16 + F.instr(F.lit("0123456789abcdef"), d) - 1) % slots)


def drain_target(pool: DataFrame) -> DataFrame:
    """Workers that drain a queue in the time left at the 75th percentile of a fetch, with what keeps up with arrivals; clamped."""
    need = F.ceil(F.col("depth") * F.col("fetch_p75") / F.col("time_left") + F.col("arrivals") * F.col("fetch_p75"))
    return pool.select("platform", F.greatest(F.lit(1), F.least(need, F.lit(50))).cast("bigint").alias("workers"))


def bundle(parts: Mapping[str, Callable[[], DataFrame]]) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """(reports, failures): the reports that can be planned, by name, and why the others can't; one that is broken takes no other with it."""
    made: dict[str, DataFrame] = {}
    failed: dict[str, str] = {}
    for name, make in parts.items():
        try:
            made[name] = make()
        except Exception as why:  # a report may fail in any way
            failed[name] = f"{type(why).__name__}: {why}".split("\n")[0]
    return made, failed


def weekly(parts: Mapping[str, Callable[[], DataFrame]]) -> DataFrame:
    """(part, has_data, rows, why): how many rows the reports of a bundle have, and which could not be made."""
    made, failed = bundle(parts)
    rows = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("part"), (F.col("rows") > 0).alias("has_data"), "rows", F.lit(None).cast("string").alias("why")) for name, df in made.items()]
    spark = next(iter(made.values())).sparkSession if made else None
    if failed and spark:
        rows.append(spark.createDataFrame([(n, False, 0, w) for n, w in failed.items()], "part string, has_data boolean, rows long, why string"))
    return reduce(DataFrame.unionByName, rows)


def _held(state: tuple, cycle: int, depth: int, delay: float, fire: int, calm: float, stable: int, longest: int) -> tuple[tuple, list]:
    """One cycle of a pool: depth before, whether it is held, calm cycles in a row, cycles held."""
    before, active, quiet, held = state
    inflow = max(0, depth - before) if before is not None else 0
    draining = before is not None and depth < before
    if not active:
        if depth >= fire and not draining:
            return (depth, True, 0, 0), [(cycle, "fired", depth, inflow)]
        return (depth, False, 0, 0), []
    quiet, held = (quiet + 1 if delay < calm else 0), held + 1
    if quiet >= stable or held >= longest:
        return (depth, False, 0, 0), [(cycle, "lifted", depth, inflow)]
    return (depth, True, quiet, held), []


def backpressure(cycles: DataFrame, fire: int = 2000, calm: float = 15.0, stable: int = 3, longest: int = 60) -> DataFrame:
    """(pool, cycle, event, depth, inflow): when a pool's inflow is held and let go, from cycles (pool, cycle, depth, delay).

    It is held from a depth on, but while the queue drains by itself; it is let go after so many calm
    cycles in a row, or when it has been held for the longest that is allowed.
    """
    step = partial(_held, fire=fire, calm=calm, stable=stable, longest=longest)
    return fold(cycles, "pool", ["cycle"], ["cycle", "depth", "delay"], lambda: (None, False, 0, 0), step, None, "cycle bigint, event string, depth bigint, inflow bigint")


def admission(queues: DataFrame, most: int = 5000, some: int = 2000) -> DataFrame:
    """What may be put into a queue of a depth: nothing, only what is urgent, or all."""
    return queues.select("pool", F.when(F.col("depth") > most, "defer").when(F.col("depth") > some, "urgent_only").otherwise("admit").alias("policy"))
