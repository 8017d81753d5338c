"""Smaller reports and rules: summaries, quotas, coverage, reliability, log fingerprints, deadlines, merges of schedules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse


def status_summary(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def diagnostics(rows: DataFrame, key: Sequence[str], severity: str, order: Sequence[str]) -> DataFrame:
    """Open findings, one for each normalised key, counted by severity with distinct companies, the worst first."""
    one = rows.select(*[F.lower(F.coalesce(F.col(k).cast("string"), F.lit(""))).alias(k) for k in key], severity).dropDuplicates([*key, severity])
    place = F.array_position(F.array(*map(F.lit, order)), F.col(severity)).cast("int")
    return one.groupBy(severity).agg(F.count("*").alias("n"), F.count_distinct(key[0]).alias("companies")).withColumn("place", place)


def quotas(daily: DataFrame, limit: int) -> DataFrame:
    """Used and left of a daily limit."""
    return daily.groupBy("date").agg(F.sum("used").alias("used")).select("date", "used", F.greatest(F.lit(limit) - F.col("used"), F.lit(0)).cast("bigint").alias("remaining"))


def quota_streak(quota: DataFrame, limit: int, days: int, low: float = 0.4) -> DataFrame:
    """One row (under, exhausted): whether the last days all used less than a share of the limit, or all of it."""
    last = quota.orderBy(F.desc("date")).limit(days)
    enough = F.count("*") == days
    return last.agg((enough & (F.max("used") < low * limit)).alias("under"), (enough & (F.min("used") >= limit)).alias("exhausted"))


def mean_of_top(rows: DataFrame, value: str, key: str, k: int) -> DataFrame:
    """Mean over the k largest."""
    return rows.orderBy(F.desc(value), key).limit(k).agg(F.round(F.avg(value), 4).alias("mean_top"), F.count("*").alias("n"))


def coverage(rows: DataFrame, last: str, as_of: str, hours: int, limit: float = 0.25) -> DataFrame:
    """How many were not seen within the hours, the share seen in whole percent, and whether too many were missed; one row."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col(last).cast("timestamp"))
    missed = F.count_if(F.col(last).isNull() | (age > hours * 3600))
    total = F.count("*")
    pct = F.when(total > 0, F.least(F.lit(100).cast("bigint"), F.floor(100 * (total - missed) / total).cast("bigint"))).otherwise(0)
    return rows.agg(total.alias("total"), missed.alias("missed"), pct.alias("coverage_pct"), F.coalesce(missed > limit * total, F.lit(False)).alias("alert"))


def reliability(runs: DataFrame, output: str) -> DataFrame:
    """Share of runs with output; 1 without runs."""
    return runs.agg(F.coalesce(F.round(F.count_if(F.col(output) > 0) / F.nullif(F.count("*"), F.lit(0)), 4), F.lit(1.0)).alias("reliability"), F.count("*").alias("runs"))


def worker_missed(companies: DataFrame, scans: DataFrame, in_flight: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """Companies without a scan in the hours before, less those in flight."""
    recent = scans.where(F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) <= hours * 3600).select("company")
    return companies.join(recent, "company", "left_anti").join(in_flight, "company", "left_anti")


def schedule_merge(known: DataFrame, monitorable: DataFrame, as_of: float) -> DataFrame:
    """(company, due_at, bucket): known ones due or to come, and those not yet registered, due at once."""
    have = known.select("company", "due_at", F.when(F.col("due_at") <= as_of, "stale").otherwise("current").alias("bucket"))
    fresh = monitorable.join(known.select("company"), "company", "left_anti").select("company", F.lit(as_of).alias("due_at"), F.lit("new").alias("bucket"))
    return have.unionByName(fresh)


def streak_below(daily: DataFrame, a: str, b: str, low_a: float, low_b: float, days: int) -> DataFrame:
    """Keys whose last days are successive with both measures below their thresholds."""
    w = Window.partitionBy("platform").orderBy(F.desc("date"))
    rows = daily.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= days)
    got = rows.groupBy("platform").agg(F.count("*").alias("n"), F.datediff(F.max("date"), F.min("date")).alias("span"), F.max(a).alias("a"), F.max(b).alias("b"))
    return got.where((F.col("n") == days) & (F.col("span") == days - 1) & (F.col("a") < low_a) & (F.col("b") < low_b)).select("platform", F.col("a").alias(f"max_{a}"), F.col("b").alias(f"max_{b}"))


def fingerprint(line: Column) -> Column:
    """A log line with what varies left out: times, quoted text, hex, numbers, paths."""
    x = F.regexp_replace(line, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?", "<ts>")
    x = F.regexp_replace(F.regexp_replace(x, r"'[^']*'", "<s>"), r"0x[0-9a-fA-F]+|\b[0-9a-f]{12,}\b", "<hex>")
    return collapse(F.regexp_replace(F.regexp_replace(x, r"(?:/[\w.-]+){2,}", "<path>"), r"\d+", "<n>"))


def fingerprints(lines: DataFrame, line: str, flagged: str, suppressed: str) -> DataFrame:
    """Counts of fingerprints of flagged lines that are not suppressed."""
    rows = lines.where(F.regexp_like(line, F.lit(flagged)) & ~F.regexp_like(line, F.lit(suppressed)))
    return rows.groupBy(fingerprint(F.col(line)).alias("fingerprint")).agg(F.count("*").alias("n"))


def next_deadline(ts: Column, zone: str = "America/New_York", hour: int = 7) -> Column:
    """The next time that clocks of a zone show the hour, daylight saving observed."""
    local = F.from_utc_timestamp(ts, zone)
    day = F.date_add(F.to_date(local), F.when(F.hour(local) >= hour, 1).otherwise(0))
    return F.to_utc_timestamp(F.timestamp_add("HOUR", F.lit(hour), day.cast("timestamp")), zone)


def error_class(code: Column) -> Column:
    """The kind of a response code; 0 is a timeout."""
    return F.when(code == 0, "timeout").when(code == 429, "rate_limited").when(code == 404, "not_found").when(code.between(400, 499), "client").when(code >= 500, "server").otherwise("ok")


def email_root(address: Column) -> Column:
    """The registrable domain of an address."""
    return F.substring_index(F.lower(F.substring_index(address, "@", -1)), ".", -2)


def suffix_variation(a: Column, b: Column, suffixes: Sequence[str] = ("inc", "llc", "ltd", "corp", "group", "technologies")) -> Column:
    """Whether one name is the other with a legal suffix after it."""
    longer, shorter = F.when(F.length(a) >= F.length(b), a).otherwise(b), F.when(F.length(a) >= F.length(b), b).otherwise(a)
    rest = F.trim(F.substring(longer, F.length(shorter) + 1, F.length(longer)))
    return F.startswith(longer, shorter) & (rest.isin("", *suffixes))


def slug_fits(slug: Column, company: Column) -> Column:
    """Whether a slug can belong to a company: the same letters, a shared first word of three letters or more, or one within the other."""
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    s, c = bare(slug), bare(company)
    first = F.regexp_extract(F.lower(company), r"^([a-z0-9]{3,})", 1)
    return F.when((s == "") | (c == ""), False).otherwise((s == c) | ((first != "") & F.startswith(s, first)) | ((F.length(s) >= 4) & F.contains(c, s)) | ((F.length(c) >= 4) & F.contains(s, c)))


def scan_waste(pages: Column, exit_page: Column, page_size: int) -> Column:
    """Records read after the page where a scan could have stopped."""
    return F.greatest(pages - F.coalesce(exit_page + 1, pages), F.lit(0)) * page_size


def live(rows: DataFrame, expires: str, as_of: str) -> DataFrame:
    """Cache rows that have not expired."""
    return rows.where(F.col(expires) > F.lit(as_of).cast("timestamp_ntz"))


def bounce_cascade(stages: DataFrame, bounced: DataFrame) -> DataFrame:
    """After a bounce its conversation's pending stages are cancelled and the bounced ones marked; statuses worked out anew from events."""
    hit = bounced.select("conv_id", F.lit(True).alias("b")).distinct()
    status = F.when(F.col("b") & (F.col("status") == "pending"), "cancelled").when(F.col("b"), "bounced").otherwise(F.col("status"))
    return stages.join(hit, "conv_id", "left").withColumn("b", F.coalesce("b", F.lit(False))).select("conv_id", "turn", status.alias("status"))


def tally(rows: DataFrame, group: str, tests: Mapping[str, Column]) -> DataFrame:
    """Conditional counts of each group."""
    return rows.groupBy(group).agg(*[F.count_if(c).alias(n) for n, c in tests.items()], F.count("*").alias("total"))
