"""Adaptive polling: scores over recent polls, band thresholds, intervals as folds, schedules and shares.

The window forms read whole histories of a key from a shuffle by that key; folds stream through
sorted rows with one state in memory.
"""

from __future__ import annotations

import math
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold

#: Fixed values of the polling rules: weights of the last five polls, hours in seconds, shares of ranks.
WEIGHTS = (0.10, 0.15, 0.20, 0.25, 0.30)
LEAST_POLLS, MOST_JOBS = 3, 10
DEFAULT, LOW, MODERATE, ACTIVE, SHORTEST = 12 * 3600, 9 * 3600, 6 * 3600, 4 * 3600, 3 * 3600
TOP, NEXT, REST, OUTLIERS = 0.10, 0.15, 0.25, 0.05
SMOOTHING = 0.3
EPS = 1e-9


def score_of(counts: Column) -> Column:
    """Mean of an array of up to five recent counts, oldest first, weighted towards the newest; null below LEAST_POLLS."""
    n = F.size(counts)
    weights = F.slice(F.array(*map(F.lit, WEIGHTS)), F.lit(len(WEIGHTS) + 1) - n, n)
    dot = F.aggregate(F.zip_with(counts, weights, lambda c, w: c * w), F.lit(0.0), lambda a, x: a + x)
    return F.when(n >= LEAST_POLLS, dot / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))


def scores(polls: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("date", "slot"), found: str = "new_jobs") -> DataFrame:
    """The score after each poll of a key: a rolling frame of five capped counts."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-len(WEIGHTS) + 1, 0)
    counts = F.collect_list(F.least(F.col(found), F.lit(MOST_JOBS)).cast("double")).over(w)
    return polls.select(key, *order, counts.alias("recent")).select(key, *order, F.round(score_of(F.col("recent")), 6).alias("score"))


def thresholds(rows: DataFrame, score: str = "score", least: int = 5) -> DataFrame:
    """One row (n, active, moderate, low), or none below `least` positive scores: scores at the ranks that bands begin with, after the topmost are capped at the next one.

    Ranks come from counts of distinct values, so that no window spans all rows: with v values at or
    above x there are that many ranks.
    """
    counts = rows.where(F.col(score) > 0).groupBy(F.col(score).alias("v")).agg(F.count("*").alias("c"))
    # distinct scores are few (rounded means of small counts); their cumulative counts fit one window
    ranked = counts.select("v", F.sum("c").over(Window.orderBy(F.col("v").desc())).alias("upto"), F.sum("c").over(Window.partitionBy()).alias("n"))
    at = lambda r: F.max(F.when(F.col("upto") >= r, F.col("v")))
    n = F.col("n")
    slots = lambda share: F.greatest(F.lit(1), F.ceil(n * share))
    cap = F.greatest(F.lit(0), n - slots(OUTLIERS) - 1)
    one, two, three = slots(TOP), slots(NEXT), slots(REST)
    got = ranked.groupBy("n").agg(at(n - cap).alias("cap"), at(one).alias("a"), at(F.least(one + two, n)).alias("m"), at(F.least(one + two + three, n)).alias("l"))
    capped = got.where(n >= least).select("n", *[F.least(c, "cap").alias(c) for c in ("a", "m", "l")])
    moderate = F.least("m", F.col("a") - EPS)
    return capped.select("n", F.col("a").alias("active"), moderate.alias("moderate"), F.greatest(F.least(F.col("l"), moderate - EPS), F.lit(EPS)).alias("low"))


def band(score: Column, low: float, moderate: float, active: float) -> Column:
    """The interval of a score in seconds."""
    return F.when(score.isNull() | (score == 0), DEFAULT).when(score < low, LOW).when(score < moderate, MODERATE).when(score < active, ACTIVE).otherwise(SHORTEST)


def next_interval(computed: Column, current: Column) -> Column:
    """Falls at once; rises by 0.3 of the way, in whole seconds."""
    return F.when(computed < current, computed).otherwise(F.floor(SMOOTHING * computed + (1 - SMOOTHING) * current).cast("int"))


def cap(score: Column, moderate: float) -> Column:
    return F.when(score.isNotNull() & (score > 0) & (score >= moderate), MODERATE).otherwise(DEFAULT)


def _polled(state: tuple, found: float | None, low: float, moderate: float, active: float) -> tuple[tuple, list]:
    """One poll: counts kept, interval, polls so far and score."""
    recent, interval, n, _ = state
    recent = (*recent, float(min(found or 0, MOST_JOBS)))[-len(WEIGHTS) :]
    score = None
    if len(recent) >= LEAST_POLLS:
        weights = WEIGHTS[-len(recent) :]
        # as it is reported, so that no band hangs on a rounding
        score = round(sum(c * w for c, w in zip(recent, weights, strict=True)) / sum(weights), 6)
    if not score:
        to = DEFAULT
    else:
        to = LOW if score < low else MODERATE if score < moderate else ACTIVE if score < active else SHORTEST
    new = to if to < interval else math.floor(SMOOTHING * to + (1 - SMOOTHING) * interval)
    return (recent, min(new, MODERATE if score and score >= moderate else DEFAULT), n + 1, score), []


def intervals(polls: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("date", "slot"), found: str = "new_jobs", low: float = 0.3, moderate: float = 0.8, active: float = 1.5) -> DataFrame:
    """(key, n_polls, score, interval_s) after folding all polls of a key in order, from the default interval."""
    step = partial(_polled, low=low, moderate=moderate, active=active)
    end = lambda s: [(s[2], None if s[3] is None else round(s[3], 6), s[1])]
    return fold(polls, key, order, [found], lambda: ((), DEFAULT, 0, None), step, end, "n_polls bigint, score double, interval_s bigint")


def ema(rows: DataFrame, key: str, order: tuple[str, ...], value: str, seed: float, alpha: float = 0.3) -> DataFrame:
    """Exponential mean of a key's values in order; null values are passed over."""
    step = lambda a, x: (a if x is None else alpha * float(x) + (1 - alpha) * a, [])
    return fold(rows, key, order, [value], lambda: seed, step, lambda a: [(a,)], "ema double").withColumn("ema", F.round("ema", 4))


def max_gap(points: DataFrame, key: str, at: str, lo: float, hi: float, target: float) -> DataFrame:
    """(key, at): the middle of the widest gap between a key's points in [lo, hi], of equal ones that nearest the target."""
    inside = points.where(F.col(at).between(lo, hi)).select(key, F.col(at).cast("double").alias("x"))
    edges = points.select(key).distinct().select(key, F.explode(F.array(F.lit(lo), F.lit(hi))).alias("x"))
    w = Window.partitionBy(key).orderBy("x")
    gaps = inside.unionByName(edges).select(key, "x", F.lead("x").over(w).alias("y")).where("y is not null")
    gaps = gaps.select(key, (F.col("y") - F.col("x")).alias("gap"), ((F.col("x") + F.col("y")) / 2).alias("mid"))
    return gaps.groupBy(key).agg(F.min_by("mid", F.struct(-F.col("gap"), F.abs(F.col("mid") - target), F.col("mid"))).alias("scheduled_at"), F.max("gap").alias("gap"))


def spread(rows: DataFrame, group: str, order: str, now: float, workers: int, mean: float) -> DataFrame:
    """Start times evenly over a window of ceil(n / workers) * mean seconds, by place in a group."""
    w = Window.partitionBy(group)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    return rows.select(group, order, F.round(now + i / n * F.ceil(n / workers) * mean, 4).alias("start_at"))


def fair_share(rows: DataFrame, group: str, order: str, quota: int, most: int = 3) -> DataFrame:
    """A quota dealt evenly over a group's members, the first ones taking what is left over, up to `most` each."""
    w = Window.partitionBy(group)
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy(order)) - 1
    share = F.floor(F.lit(quota) / n) + F.when(i < F.lit(quota) % n, 1).otherwise(0)
    return rows.select(group, order, F.least(share, F.lit(most)).cast("bigint").alias("share"))


def consecutive_empty(polls: DataFrame, key: str = "user_id", order: tuple[str, ...] = ("date", "slot"), found: str = "new_jobs") -> DataFrame:
    """After each poll, how many in a row found nothing: islands between finds."""
    w = Window.partitionBy(key).orderBy(*order)
    rows = polls.select(key, *order, (F.col(found) == 0).alias("empty"), F.sum(F.when(F.col(found) > 0, 1).otherwise(0)).over(w).alias("island"))
    n = F.sum(F.when(F.col("empty"), 1).otherwise(0)).over(Window.partitionBy(key, "island").orderBy(*order))
    return rows.select(key, *order, n.alias("consecutive_empty"))


def winner(rows: DataFrame, group: str, name: str, confidence: str, n: str, reliable: tuple[str, ...], least: float = 80.0, close: float = 0.10) -> DataFrame:
    """(group, winner, score, call): the best of confidence * log10(n + 1) among confident ones; of two within 10 %, the more reliable."""
    score = F.round(F.col(confidence) * F.log10(F.col(n) + 1), 6)
    good = rows.where(F.col(confidence) >= least).select(group, name, score.alias("score"), F.coalesce(F.array_position(F.array(*map(F.lit, reliable)), F.col(name)), F.lit(0)).alias("p"))
    good = good.withColumn("place", F.when(F.col("p") > 0, F.col("p")).otherwise(len(reliable) + 1))
    w = Window.partitionBy(group).orderBy(F.col("score").desc(), name)
    ranked = good.select(group, name, "score", "place", F.row_number().over(w).alias("r"), F.lead(name).over(w).alias("name2"), F.lead("score").over(w).alias("score2"), F.lead("place").over(w).alias("place2")).where("r = 1")
    near = F.col("score2").isNotNull() & (F.col("score") - F.col("score2") <= close * F.col("score"))
    second = near & (F.col("place2") < F.col("place"))
    return ranked.select(group, F.when(second, F.col("name2")).otherwise(F.col(name)).alias("winner"), F.when(second, F.col("score2")).otherwise(F.col("score")).alias("score"), F.when(near, "close").otherwise("clear").alias("call"))


def priority(rows: DataFrame, limit: int) -> DataFrame:
    """Never checked first, by age; then unknown ones by time of check; then the rest, most empty first; the first `limit`."""
    rank = F.when(F.col("checks") == 0, 1).when(F.col("found") == 0, 2).otherwise(3)
    inner = F.when(rank == 1, F.col("created")).when(rank == 2, F.col("checked")).otherwise(-F.col("empty"))
    return rows.select("company", rank.alias("priority"), inner.cast("bigint").alias("inner_key")).orderBy("priority", "inner_key", "company").limit(limit)
