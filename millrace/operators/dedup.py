"""Keyed dedup, snapshot differences, retention and set operations. All exact."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize


def content_hash(company: Column, title: Column, location: Column, job_id: Column | None = None) -> Column:
    """SHA-256 of the normalised fields; null without company or title. Without job_id it is the older hash."""
    parts = [company, title, location] + ([job_id.cast("string")] if job_id is not None else [])
    joined = F.concat_ws("|", *[normalize(F.coalesce(p, F.lit(""))) for p in parts])
    return F.when((company != "") & (title != ""), F.sha2(joined.cast("binary"), 256))


def hash_known(rows: DataFrame, known: DataFrame, new: str = "content_hash", old: str = "legacy_hash", key: str = "job_id") -> DataFrame:
    """(key, known): whether either of a row's hashes is among those known; rows without a content hash are not."""
    either = rows.where(F.col(new).isNotNull()).select(key, F.explode(F.array_distinct(F.array(new, old))).alias("hash"))
    hit = either.join(known.select(F.col(new).alias("hash")).distinct(), "hash", "left_semi").select(key).distinct().withColumn("hit", F.lit(True))
    return rows.select(key).join(hit, key, "left").select(key, F.coalesce("hit", F.lit(False)).alias("known"))


def first_of(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row of each non-null key, the first in order; rows without a key all stay."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.where(F.col(key).isNull()).unionByName(rows.where(F.col(key).isNotNull()).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], measure: str, flag: str) -> DataFrame:
    """(keys, measure, flag, change): gone rows deleted, fresh inserted, others updated keeping the old flag."""
    o = old.select(*keys, F.col(measure).alias("m0"), F.col(flag).alias("f0"), F.lit(True).alias("in0"))
    n = new.select(*keys, F.col(measure).alias("m1"), F.lit(True).alias("in1"))
    change = F.when(F.col("in1").isNull(), "delete").when(F.col("in0").isNull(), "insert").when(F.col("m0").eqNullSafe(F.col("m1")), "keep").otherwise("update")
    return o.join(n, keys, "full_outer").select(*keys, F.coalesce("m1", "m0").alias(measure), F.coalesce("f0", F.lit(False)).alias(flag), change.alias("change"))


def generation_diff(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Keys that only one of two scan generations holds; exact where a Bloom filter would drop some."""
    a, b = old.select(*keys).distinct(), new.select(*keys).distinct()
    return b.join(a, list(keys), "left_anti").withColumn("change", F.lit("appeared")).unionByName(a.join(b, list(keys), "left_anti").withColumn("change", F.lit("vanished")))


def retention(rows: DataFrame, as_of: str, status: str, day: str, rules: Mapping[str, int]) -> DataFrame:
    """Rows younger than their status allows; statuses without a rule stay."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.col(day))
    kept = F.lit(True)
    for name, days in rules.items():
        kept = F.when(F.col(status) == name, age <= days).otherwise(kept)
    return rows.where(kept)


def union_tiers(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys of both tiers with the tier that comes first."""
    return first.select(key).withColumn("tier", F.lit(1)).unionByName(second.select(key).withColumn("tier", F.lit(2))).groupBy(key).agg(F.min("tier").alias("tier"))
