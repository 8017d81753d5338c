"""Streams drained once over the tables; each equals a batch query."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from ..sources.xlsx import place
from ..streaming import jobs as J
from ..streaming import logs
from ..streaming import state as S
from .adaptive import ORACLE_SQL as ADAPTIVE_SQL
from .roles import as_text, oracle, role


def _places(spark: SparkSession, name: str) -> tuple[str, str, str]:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/in", f"{base}/out", f"{base}/state"


def _stream(spark: SparkSession, rows: DataFrame, folder: str) -> DataFrame:
    """rows, written once, as a stream of one batch, as files have no order that a watermark could follow."""
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder)


def s_adaptive_state(spark: SparkSession, d: str) -> DataFrame:
    """Interval and score of each key from the stateful stream; of its updates the last counts."""
    source, sink, state = _places(spark, "adaptive")
    polls = role(spark, d, "polls").select("user_id", (F.datediff("date", F.lit("2024-01-01").cast("date")) * 4 + F.col("slot")).alias("at"), "new_jobs")
    out = J.run_once(J.adaptive_state(_stream(spark, polls, source)), sink, state, "update")
    return out.groupBy("user_id").agg(F.max_by(F.struct("n_polls", "score", "interval_s"), "n_polls").alias("x")).select("user_id", "x.*")


def s_error_window(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has closed; the last ones stay open until later events come."""
    source, sink, state = _places(spark, "windows")
    rows = role(spark, d, "requests").select(F.col("ts").cast("timestamp").alias("ts"), "platform", "class")
    closing = spark.sql("SELECT TIMESTAMP '2030-01-01 00:00:00' AS ts, 'closing' AS platform, 'ok' AS class")
    out = J.run_once(J.error_windows(_stream(spark, rows.unionByName(closing), source)), sink, state)
    return out.where("platform <> 'closing'").select("platform", F.col("until").cast("timestamp_ntz").alias("until"), "requests", "errors")


def _closing(spark: SparkSession, columns: str) -> DataFrame:
    """A row so late that the watermark passes all others."""
    return spark.sql(f"SELECT TIMESTAMP '2030-01-01 00:00:00' AS ts, {columns}")


def s_dedup_day(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of each key a day's dedup lets through; a row without a time comes at no day, so none.

    The rows of ten days are put on one day, by their time, and such days far apart: of each, a key's first row
    passes and its others don't. A batch forgets what was behind the watermark before it, so two ticks are
    between the days. The first day is well after the epoch: a watermark begins there, and what is not later counts as late.
    """
    rows = role(spark, d, "requests").select("user_id", "class", F.floor((F.dayofmonth("ts") - 1) / 10).alias("n"), (F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")).alias("second"))
    timed, start = rows.where("n IS NOT NULL"), (F.col("n") + 1) * 100 * 86400
    given = timed.select(F.timestamp_seconds(start + F.col("second")).alias("ts"), "user_id", "class", (F.col("n") * 3).alias("batch"))
    ticks = timed.select("n").distinct().select(F.timestamp_seconds(start + 50 * 86400).alias("ts"), F.lit(-1).cast("bigint").alias("user_id"), F.lit("tick").alias("class"), F.explode(F.array(F.col("n") * 3 + 1, F.col("n") * 3 + 2)).alias("batch"))
    out = _in_turns(spark, given.unionByName(ticks), "batch", _places(spark, "dedup"), lambda turn: J.dedup_day(turn, "user_id", "class"))
    passed = out.where("class <> 'tick'").select("user_id", "class", F.lit(1).alias("kept"))
    return passed.unionByName(rows.where("n IS NULL").select("user_id", "class", F.lit(0).alias("kept"))).groupBy("user_id", "class").agg(F.sum("kept").alias("kept"))


def _polls(spark: SparkSession, d: str) -> DataFrame:
    r = role(spark, d, "requests")
    return r.select(F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_id").alias("poll"), (F.col("class") == "ok").alias("ok"), F.when(F.col("event_id") % 7 != 0, (F.col("ms") % 4).cast("int")).alias("new_jobs"))


def s_poll_state(spark: SparkSession, d: str) -> DataFrame:
    """Every poll's state, and where polls were overdue, from the timed stateful stream in several batches of time."""
    polls = _polls(spark, d)
    closing = _closing(spark, "-1L AS user_id, -1L AS poll, true AS ok, 0 AS new_jobs").select(polls.columns)
    # a turn a stretch of time, so that timers run between them
    rows = polls.withColumn("week", F.floor(F.dayofmonth("ts") / 10)).unionByName(closing.withColumn("week", F.lit(9).cast("bigint")))
    out = _in_turns(spark, rows, "week", _places(spark, "polls"), S.poll_states).where("user_id >= 0")
    return out.select("user_id", F.col("at").cast("timestamp_ntz").alias("moment"), "kind", "n_polls", "score", "interval_s", "warming", "errors")


def _in_turns(spark: SparkSession, rows: DataFrame, by: str, places: tuple[str, str, str], made: Callable[[DataFrame], DataFrame], stop: bool = False) -> DataFrame:
    """What the stream that `made` makes of rows gives, fed those of one value of `by` after another; stop: but for its first batch it is stopped once in each turn.

    Each turn is drained before the next one's files are there and goes on from the state that it left, so the order
    doesn't depend on the files' times, which stores cut to seconds and machines set by clocks of their own; and a turn may be many files.
    """
    source, sink, state = places
    out, columns = None, rows.drop(by)
    for r in rows.select(by).distinct().orderBy(by).collect():
        rows.where(F.col(by) == r[0]).drop(by).write.mode("append").parquet(source)
        stream = lambda: made(spark.readStream.schema(columns.schema).parquet(source))
        if stop:
            J.run_once(stream(), sink, state, batches=1)
        out = J.run_once(stream(), sink, state)
    # without rows there is no turn, and nothing to give but the columns; not all that streams do runs on a batch
    return spark.createDataFrame([], made(columns).schema) if out is None else out


def _in_files(spark: SparkSession, rows: DataFrame, by: str, folder: str) -> DataFrame:
    """rows as a stream of one file for each value of `by`, a file a batch, for results that don't depend on the batches' order."""
    for r in rows.select(by).distinct().orderBy(by).collect():
        rows.where(F.col(by) == r[0]).drop(by).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.drop(by).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def s_alert_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Alerts, resolutions and returns of each user's errors of a class."""
    found = role(spark, d, "requests").where("class <> 'ok'").select(F.col("ts").cast("timestamp").alias("ts"), F.concat_ws(":", "class", (F.col("user_id") % 20).cast("string")).alias("signature"))
    rows = found.withColumn("week", F.floor(F.dayofmonth("ts") / 10)).unionByName(_closing(spark, "'closing' AS signature, 9L AS week"))
    out = _in_turns(spark, rows, "week", _places(spark, "alerts"), lambda turn: S.alert_sweep(turn, quiet=6 * 3600)).where("signature <> 'closing'")
    return out.select("signature", F.col("at").cast("timestamp_ntz").alias("moment"), "kind", "seen")


def s_reclaim(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries and their acknowledgements as two streams; what is not acknowledged in time is reclaimed, or dead at its last attempt."""
    source, sink, state = _places(spark, "deliveries")
    r = role(spark, d, "requests").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "ms")
    bound = S.idle_bound(r.select(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)")).first()[0] / 30)
    made = r.select(F.floor(F.col("event_id") / 5).alias("message"), (F.col("event_id") % 5 + 1).cast("int").alias("attempt"), "ts", "event_id")
    later = (F.col("event_id") * 37 % 900).cast("int")
    acks = made.where("event_id % 4 <> 0").withColumn("ts", F.timestamp_add("SECOND", later, "ts")).drop("event_id")
    given = made.drop("event_id")
    closing = _closing(spark, "-1L AS message, 0 AS attempt").select(given.columns)
    streams = [_stream(spark, x.unionByName(closing), f"{source}-{n}") for n, x in enumerate((given, acks))]
    out = J.run_once(S.reclaimed(*streams, bound), sink, state).where("message >= 0")
    return out.select("message", "attempt", F.col("at").cast("timestamp_ntz").alias("moment"), "outcome")


def s_resumed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Error windows of a stream that is stopped before its batches have been committed and goes on from its checkpoint."""
    rows = role(spark, d, "requests").select(F.col("ts").cast("timestamp").alias("ts"), "platform", "class")
    rows = rows.withColumn("week", F.floor(F.dayofmonth("ts") / 7)).unionByName(_closing(spark, "'closing' AS platform, 'ok' AS class, 9L AS week"))
    out = _in_turns(spark, rows, "week", _places(spark, "resumed"), J.error_windows, stop=True)
    return out.where("platform <> 'closing'").select("platform", F.col("until").cast("timestamp_ntz").alias("until"), "requests", "errors")


def s_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of platforms and days, added up over the batches of a stream, snapshots among them."""
    source, sink, state = _places(spark, "counters")
    rows = role(spark, d, "requests").select("platform", F.col("date").cast("string").alias("date"), F.lit(1).cast("bigint").alias("requests"), (F.col("class") != "ok").cast("bigint").alias("errors"), "ms")
    stream = _in_files(spark, rows.withColumn("part", F.substring("date", 9, 1)), "part", source)
    keys, sums = ["platform", "date"], ["requests", "errors", "ms"]
    query = stream.writeStream.foreachBatch(J.add_into(sink, keys, sums, every=2)).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return J.total(spark, sink, rows.schema, keys, sums)


def _write_log(rows: DataFrame, folder: str) -> None:
    line = F.concat_ws(" ", F.col("ts").cast("string"), F.when(F.col("class") == "ok", "INFO").otherwise("ERROR"), "class", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    by = ["platform", "date"]
    rows.repartition(*by).sortWithinPartitions(*by, "event_id").select(*by, line.alias("line")).write.mode("append").partitionBy(*by).text(folder)


def s_log_tail(spark: SparkSession, d: str) -> DataFrame:
    """Lines, errors and lines of context of platforms' and days' logs: read, rotated while the stream is down, and read on from its checkpoint beside the new logs."""
    source, sink, state = _places(spark, "logs")
    store, folder = place(source)
    rows = role(spark, d, "requests").select("event_id", "ts", "user_id", "class", "platform", F.col("date").cast("string").alias("date"))
    _write_log(rows.where("event_id % 3 <> 0"), source)
    stream = lambda: logs.tail(spark, f"{folder}/*/*/*.txt*", context=2)
    J.run_once(stream(), sink, state)
    for f in store.get_file_info(fs.FileSelector(folder, recursive=True)):
        if f.path.endswith(".txt"):
            store.move(f.path, f.path + ".1")
    _write_log(rows.where("event_id % 3 = 0"), source)
    lines = J.run_once(stream(), sink, state)
    found = logs.findings(lines, [r"\bERROR\b"]).select("file", "log", "at", F.size("context").alias("near"), F.lit(1).alias("error"))
    by = lambda name: F.regexp_extract("file", f"{name}=([^/]*)", 1).alias(name)
    each = lines.select("file", "log", "at").withColumns({"near": F.lit(0), "error": F.lit(0), "line": F.lit(1)}).unionByName(found.withColumn("line", F.lit(0)))
    return each.groupBy(by("platform"), by("date")).agg(F.sum("line").alias("lines"), F.sum("error").alias("errors"), F.sum("near").alias("near"))


def s_recalibrated(spark: SparkSession, d: str) -> DataFrame:
    """A stream of scores with the interval by the thresholds of their day, which come from how many polls the day before had; the first day has the rules'."""
    source, sink, state = _places(spark, "days")
    polls = role(spark, d, "requests").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", (F.col("ms") % 200 / 100).alias("score"))
    low = (F.count("*") % 30 + 10) / 100
    days = role(spark, d, "requests").groupBy(F.date_add("date", 1).alias("day")).agg(low.alias("low"), (low + 0.4).alias("moderate"), (low + 0.9).alias("active"))
    days.write.parquet(f"{source}-days")
    stream = _in_files(spark, polls.withColumn("third", F.floor(F.dayofmonth("ts") / 10)), "third", source)
    return J.run_once(J.recalibrated(stream, spark.read.parquet(f"{source}-days")), sink, state).select("event_id", "score", "interval_s")


QUERIES = {f.__name__: f for f in (s_recalibrated, s_adaptive_state, s_error_window, s_dedup_day, s_poll_state, s_alert_sweep, s_reclaim, s_resumed_windows, s_counters, s_log_tail)}

#: One poll after another of all keys at once: r are the counts of the last five successes, i the interval, w the polls of warming that are left.
_POLL_STATE = """RECURSIVE_HERE p AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, class = 'ok' AS ok, CASE WHEN event_id % 7 <> 0 THEN ms % 4 ELSE 0 END::DOUBLE AS jobs, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM requests),
 f(user_id, k, ms, r, i, w, e, s, due) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, []::DOUBLE[], 43200::BIGINT, 3, 0, NULL::DOUBLE, NULL::BIGINT FROM (SELECT DISTINCT user_id FROM p)
 UNION ALL SELECT user_id, k, ms, r, CASE WHEN NOT ok THEN i WHEN w > 0 THEN 7200 ELSE least(CASE WHEN b < i THEN b ELSE floor(0.3::DOUBLE * b + (1 - 0.3::DOUBLE) * i)::BIGINT END, CASE WHEN s > 0 AND s >= 0.8 THEN 21600 ELSE 43200 END) END, CASE WHEN ok AND w > 0 THEN w - 1 ELSE w END, CASE WHEN ok THEN 0 ELSE e + 1 END, s, due_before FROM
 (SELECT *, CASE WHEN s IS NULL OR s = 0 THEN 43200 WHEN s < 0.3 THEN 32400 WHEN s < 0.8 THEN 21600 WHEN s < 1.5 THEN 14400 ELSE 10800 END AS b FROM
 (SELECT *, CASE WHEN NOT ok THEN 0 WHEN len(r) >= 3 THEN round(list_dot_product(r, [0.10, 0.15, 0.20, 0.25, 0.30][6 - len(r):]::DOUBLE[]) / list_sum([0.10, 0.15, 0.20, 0.25, 0.30][6 - len(r):])::DOUBLE, 6) END::DOUBLE AS s FROM
 (SELECT f.user_id, p.k, p.ms, p.ok, CASE WHEN p.ok THEN list_append(f.r, least(p.jobs, 10))[-5:] ELSE f.r END AS r, f.i, f.w, f.e, f.ms + (f.i + 3600) * 1000 AS due_before FROM f JOIN p ON f.user_id = p.user_id AND p.k = f.k + 1)))),
 g AS (SELECT *, lead(ms) OVER (PARTITION BY user_id ORDER BY k) AS next, ms + (i + 3600) * 1000 AS over FROM f WHERE k > 0)
 SELECT user_id, make_timestamp(ms * 1000) AS moment, 'poll' AS kind, k AS n_polls, round(s, 6) AS score, i AS interval_s, w AS warming, e AS errors FROM g
 UNION ALL SELECT user_id, make_timestamp(over * 1000), 'overdue', k, round(s, 6), i, w, e FROM g WHERE coalesce(next > over, true)"""

_ALERTS = """, f AS (SELECT class || ':' || user_id % 20 AS signature, epoch_us(ts) // 1000 AS ms FROM requests WHERE class <> 'ok'),
 o AS (SELECT *, lag(ms) OVER (PARTITION BY signature ORDER BY ms) AS before FROM f), s AS (SELECT *, before IS NULL AS first, coalesce(ms > before + 21600000, true) AS starts FROM o),
 e AS (SELECT *, sum(starts::INTEGER) OVER (PARTITION BY signature ORDER BY ms, starts DESC ROWS UNBOUNDED PRECEDING) AS episode FROM s),
 a AS (SELECT signature, episode, min(ms) AS since, max(ms) AS last, count(*) AS n FROM e GROUP BY 1, 2)
 SELECT signature, make_timestamp(since * 1000) AS moment, CASE WHEN episode = 1 THEN 'alert' ELSE 'realert' END AS kind, 1::BIGINT AS seen FROM a UNION ALL SELECT signature, make_timestamp((last + 21600000) * 1000), 'resolved', n FROM a"""

ORACLE_SQL = {
    "s_recalibrated": oracle("requests", body=""", c AS (SELECT date + 1 AS day, (count(*) % 30 + 10) / 100.0::DOUBLE AS low FROM requests GROUP BY 1), s AS (SELECT event_id, ms % 200 / 100.0::DOUBLE AS score, coalesce(low, 0.3) AS low, coalesce(low + 0.4::DOUBLE, 0.8) AS moderate, coalesce(low + 0.9::DOUBLE, 1.5) AS active FROM requests LEFT JOIN c ON date = day)
 SELECT event_id, score, CASE WHEN score = 0 THEN 43200 WHEN score < low THEN 32400 WHEN score < moderate THEN 21600 WHEN score < active THEN 14400 ELSE 10800 END AS interval_s FROM s"""),
    "s_adaptive_state": ADAPTIVE_SQL["q_interval_fold"],
    "s_error_window": oracle("requests", body="SELECT platform, to_timestamp(b * 600)::TIMESTAMP AS until, count(*) AS requests, count_if(class <> 'ok')::BIGINT AS errors FROM (SELECT platform, class, unnest([epoch_us(ts) // 600000000 + 1, epoch_us(ts) // 600000000 + 2]) AS b FROM requests) GROUP BY 1, 2"),
    "s_dedup_day": oracle("requests", body="SELECT user_id, class, count(DISTINCT (day(ts) - 1) // 10) AS kept FROM requests GROUP BY 1, 2"),
    "s_poll_state": oracle("requests", body=", " + _POLL_STATE.replace("RECURSIVE_HERE ", "")).replace("WITH ", "WITH RECURSIVE ", 1),
    "s_alert_sweep": oracle("requests", body=_ALERTS),
    "s_reclaim": oracle("requests", body=""", b AS (SELECT least(greatest(3 * quantile_disc(ms, 0.95) / 30, 300), 600)::INTEGER AS bound FROM requests)
 SELECT event_id // 5 AS message, (event_id % 5 + 1)::INTEGER AS attempt, ts AS moment, CASE WHEN event_id % 4 <> 0 AND event_id * 37 % 900 <= bound THEN 'done' WHEN event_id % 5 = 4 THEN 'dead' ELSE 'reclaimed' END AS outcome FROM requests, b"""),
    "s_log_tail": oracle("requests", body=""", l AS (SELECT platform, date::VARCHAR AS date, class <> 'ok' AS error, coalesce(lead(class) OVER w = 'ok', false) AS one, coalesce(lead(class, 2) OVER w = 'ok', false) AS two FROM requests WINDOW w AS (PARTITION BY platform, date, event_id % 3 = 0 ORDER BY event_id))
 SELECT platform, date, count(*) AS lines, count_if(error)::BIGINT AS errors, sum(CASE WHEN error AND one THEN 1 + two::INTEGER ELSE 0 END)::BIGINT AS near FROM l GROUP BY 1, 2"""),
    "s_counters": oracle("requests", body="SELECT platform, date::VARCHAR AS date, count(*) AS requests, count_if(class <> 'ok')::BIGINT AS errors, sum(ms)::BIGINT AS ms FROM requests GROUP BY 1, 2"),
}
ORACLE_SQL["s_resumed_windows"] = ORACLE_SQL["s_error_window"]
as_text(QUERIES, ORACLE_SQL, {"s_error_window": ["until"], "s_resumed_windows": ["until"], "s_poll_state": ["moment"], "s_alert_sweep": ["moment"], "s_reclaim": ["moment"]})
