"""Tables that change by batches, as joins that make the next snapshot, and state machines as folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold

#: Hosts of portals, fixed values.
PORTALS = {
    "greenhouse": ("greenhouse.io",), "workday": ("myworkdayjobs.com", "workday.com"), "lever": ("lever.co",), "ashby": ("ashbyhq.com",), "smartrecruiters": ("smartrecruiters.com",), "bamboohr": ("bamboohr.com",), "icims": ("icims.com",),
    "taleo": ("taleo.net",), "indeed": ("indeed.com",), "linkedin": ("linkedin.com",), "jobvite": ("jobvite.com",), "breezy": ("breezy.hr",), "recruitee": ("recruitee.com",), "dover": ("dover.com",),
}
#: Sites that list everyone's postings, fixed values.
AGGREGATORS = ("linkedin.com", "indeed.com", "glassdoor.com", "ziprecruiter.com", "monster.com", "careerbuilder.com", "simplyhired.com", "dice.com", "hired.com", "wellfound.com", "builtin.com")


def portal(host: Column, html: Column) -> Column:
    """The portal that a host belongs to, or that its page speaks of; else generic."""
    low = F.lower(F.coalesce(html, F.lit("")))
    out = F.lit("generic")
    for name in ("lever", "workday", "greenhouse"):
        out = F.when(F.contains(low, F.lit(name)), name).otherwise(out)
    for name, parts in reversed(PORTALS.items()):
        hit = F.lit(False)
        for p in parts:
            hit = hit | F.contains(host, F.lit(p))
        out = F.when(hit, name).otherwise(out)
    return out


def plausible(host: Column, path: Column, root: Column, words: Column, known: Sequence[str] = ()) -> Column:
    """Whether an address can be a company's own career page: one of its words in the host, a known portal, or career or jobs anywhere; aggregators never."""
    named = F.exists(words, lambda w: (F.length(w) >= 3) & F.contains(host, w))
    said = F.regexp_like(F.concat(host, F.lower(path)), F.lit("career|jobs"))
    return ~root.isin(*AGGREGATORS) & (named | root.isin(*known, "") & (root != "") | said)


def promote(pending: DataFrame, details: DataFrame, known: DataFrame) -> DataFrame:
    """(job_id, content_hash, status): pending rows whose detail has come are new, or duplicates where the hash is known or an earlier row of the batch has it."""
    rows = pending.join(details, "job_id").join(known.select("content_hash", F.lit(True).alias("seen")).distinct(), "content_hash", "left")
    first = F.row_number().over(Window.partitionBy("content_hash").orderBy("job_id")) == 1
    return rows.select("job_id", "content_hash", F.when(F.col("seen").isNull() & first, "new").otherwise("duplicate").alias("status"))


def touch(state: DataFrame, batch: DataFrame, keys: Sequence[str], last: str) -> DataFrame:
    """Rows of both, the later time of each key, and how often it was inserted or touched."""
    rows = state.select(*keys, last, F.lit(0).alias("n")).unionByName(batch.select(*keys, last, F.lit(1).alias("n")))
    return rows.groupBy(*keys).agg(F.max(last).alias(last), F.sum("n").alias("touched"))


def upsert(state: DataFrame, batch: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """State with a batch's values where the batch has them."""
    new = batch.select(*keys, *[F.col(v).alias(f"_{v}") for v in values])
    return state.join(new, list(keys), "full_outer").select(*keys, *[F.coalesce(f"_{v}", v).alias(v) for v in values])


def stale(rows: DataFrame, kept: DataFrame, by: str, source: Column) -> DataFrame:
    """Rows of a source whose crawl is no longer among those kept."""
    return rows.where(source).join(kept.select(by).distinct(), by, "left_anti")


def reactivate(rows: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Closed rows that were seen again are open, the others as they were."""
    hit = seen.select(key, F.lit(True).alias("again")).distinct()
    return rows.join(hit, key, "left").withColumn("status", F.when(F.col("again") & (F.col("status") == "closed"), "active").otherwise(F.col("status"))).drop("again")


def due(schedule: DataFrame, as_of: float, limit: int) -> DataFrame:
    """The first scheduled that are due: the adaptive tier before full scans, then by time."""
    return schedule.where(F.col("due_at") <= as_of).orderBy("tier", "due_at", "company").limit(limit)


def _judged(state: tuple, bucket: int, error_rate: float, limit: float, most: int) -> tuple[tuple, list]:
    """One bucket: whether the one before was bad, how often in a row that has not helped, whether an outage is on."""
    before, ineffective, outage = state
    bad = error_rate is not None and error_rate > limit
    if outage:
        return (False, 0, bad), ([] if bad else [(bucket, "outage_end")])
    if before and bad and ineffective + 1 >= most:
        return (False, 0, True), [(bucket, "outage_start")]
    count = ineffective + 1 if before and bad else 0 if before else ineffective
    return (bad, count, False), ([(bucket, "deprioritize")] if bad else [])


def outages(windows: DataFrame, limit: float = 0.10, most: int = 3) -> DataFrame:
    """(platform, bucket, event): what a platform's error rates lead to, bucket by bucket.

    Over the limit it is deprioritised; if that has not helped so many times an outage starts; in
    one, the first bucket within the limit ends it. A fold over each platform's ordered buckets.
    """
    return fold(windows, "platform", ["bucket"], ["bucket", "error_rate"], lambda: (False, 0, False), partial(_judged, limit=limit, most=most), None, "bucket bigint, event string")


def _probed(state: tuple, bucket: int, error_rate: float, canaries: int, failed: int, limit: float, most: int, least: int) -> tuple[tuple, list]:
    """One bucket of the machine with canaries: outside outages as _judged, in one only the canaries speak."""
    if not state[2]:
        return _judged(state, bucket, error_rate, limit, most)
    if not canaries:
        return state, [(bucket, "probe")]
    if canaries >= least and not failed:
        return (False, 0, False), [(bucket, "outage_end")]
    return state, [(bucket, "canary_failed" if failed else "probe")]


def probed_outages(windows: DataFrame, limit: float = 0.10, most: int = 3, least: int = 1) -> DataFrame:
    """(platform, bucket, event) from windows (platform, bucket, error_rate, canaries, failed): as outages(), but in an outage all work is
    held and canary requests are sent; so many of them in a bucket, none failed, end it."""
    step = partial(_probed, limit=limit, most=most, least=least)
    return fold(windows, "platform", ["bucket"], ["bucket", "error_rate", "canaries", "failed"], lambda: (False, 0, False), step, None, "bucket bigint, event string")
