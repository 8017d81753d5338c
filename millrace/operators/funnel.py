"""Relational reports: outreach joins, shortages, activity, funnels, queues and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pending(applications: DataFrame, bridge: DataFrame, recruiters: DataFrame) -> DataFrame:
    """Open applications with each active recruiter, through the bridge."""
    live = recruiters.where("status = 'active'").select("recruiter_id", "name")
    return applications.where("status = 'active'").join(bridge, "application_id").join(live, "recruiter_id").select("application_id", "user_id", "company", "recruiter_id", "name")


def _active(applications: DataFrame, bridge: DataFrame, recruiters: DataFrame) -> DataFrame:
    """Each open application with the number of its distinct active recruiters; the condition is part of the join, so none is a row with 0."""
    live = bridge.join(recruiters.where("status = 'active'").select("recruiter_id"), "recruiter_id")
    counts = live.groupBy("application_id").agg(F.count_distinct("recruiter_id").alias("n_active"))
    return applications.where("status = 'active'").join(counts, "application_id", "left").withColumn("n_active", F.coalesce("n_active", F.lit(0)))


def shortage_rows(applications: DataFrame, bridge: DataFrame, recruiters: DataFrame, least: int) -> DataFrame:
    """Companies with an application short of recruiters, and the first such application."""
    return _active(applications, bridge, recruiters).where(F.col("n_active") < least).groupBy("company").agg(F.min("application_id").alias("first_application"), F.count("*").alias("n_applications"))


def shortage_group(applications: DataFrame, bridge: DataFrame, recruiters: DataFrame, cap: int) -> DataFrame:
    """How many recruiters an application lacks up to a cap; the largest shortage and then the most recent first."""
    rows = _active(applications, bridge, recruiters).withColumn("shortage", F.lit(cap) - F.col("n_active")).where("shortage > 0")
    return rows.select("application_id", "company", "n_active", F.col("shortage").cast("bigint").alias("shortage"), "applied_on").orderBy(F.desc("shortage"), F.desc("applied_on"), "application_id")


def sendable(applications: DataFrame, bridge: DataFrame, recruiters: DataFrame) -> DataFrame:
    """Open applications with any active recruiter, counted by day."""
    rows = _active(applications, bridge, recruiters).where("n_active > 0")
    return rows.groupBy("applied_on").agg(F.count_distinct("application_id").alias("sendable"))


def company_activity(companies: DataFrame, postings: DataFrame, as_of: str) -> DataFrame:
    """Per company, also without postings: how many in 30 and in 7 days, of all, and the latest."""
    day = F.to_date(F.lit(as_of))
    joined = companies.join(postings, "company", "left")
    recent = lambda n: F.count_if(F.col("seen_on") >= F.date_sub(day, n))
    return joined.groupBy("company").agg(recent(30).alias("last_30d"), recent(7).alias("last_7d"), F.count("seen_on").alias("total"), F.max("seen_on").alias("latest"))


def anti_missing(applications: DataFrame, cache: DataFrame, as_of: str) -> DataFrame:
    """Applications without a live cache entry; keys are compared so that nulls match nulls."""
    live = cache.where(F.col("expires_on") > F.to_date(F.lit(as_of))).select(F.col("company").alias("c"), F.col("user_id").alias("u"))
    return applications.join(live, F.col("company").eqNullSafe(F.col("c")) & F.col("user_id").eqNullSafe(F.col("u")), "left_anti").select("application_id", "company", "user_id")


def new_ids(fetched: DataFrame, seen: DataFrame, *keys: str) -> DataFrame:
    """Fetched keys that were not seen."""
    return fetched.select(*keys).distinct().join(seen.select(*keys), list(keys), "left_anti")


def employer_search(employers: DataFrame, soc: DataFrame, part: str, soc_like: str, least_certified: int, limit: int) -> DataFrame:
    """Employers whose name has a part, with enough certified filings, that hold a matching occupation; the most certified first."""
    rows = employers.where(F.col("name").ilike(f"%{part}%") & (F.col("certified") >= least_certified))
    return rows.join(soc.where(F.col("soc").like(soc_like)).select("fein").distinct(), "fein", "left_semi").orderBy(F.desc("certified"), "fein").limit(limit)


def funnel(stages: DataFrame) -> DataFrame:
    """Conditional counts and distinct counts of outreach; one row."""
    sent = F.col("status") == "sent"
    one = lambda s: F.count_if(sent & (F.col("stage") == s))
    return stages.agg(F.count_if(sent).alias("sent"), one("initial").alias("initial"), one("followup1").alias("followup1"), one("followup2").alias("followup2"), F.count_distinct(F.when(sent, F.col("conv_id"))).alias("reached"), F.count_distinct("conv_id").alias("total"))


def latest_stage(stages: DataFrame) -> DataFrame:
    """The last sent stage of each conversation."""
    return stages.where("status = 'sent'").groupBy("conv_id").agg(F.max_by("stage", "turn").alias("stage"), F.max("turn").alias("turn"))


def queue_buckets(rows: DataFrame, as_of: str) -> DataFrame:
    """How long ago companies were last checked, in buckets; one row."""
    age = F.datediff(F.to_date(F.lit(as_of)), F.col("checked_on"))
    bucket = F.when(F.col("checked_on").isNull(), "never").when(age <= 1, "day").when(age <= 7, "week").otherwise("older")
    b = rows.select(bucket.alias("bucket"))
    return b.agg(*[F.count_if(F.col("bucket") == n).alias(n) for n in ("never", "day", "week", "older")], F.count("*").alias("total"))


def daily_trend(rows: DataFrame, ts: str, as_of: str, days: int = 90) -> DataFrame:
    day = F.to_date(F.col(ts))
    return rows.where(day >= F.date_sub(F.to_date(F.lit(as_of)), days)).groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def slug_sets(rows: DataFrame) -> DataFrame:
    """Distinct slugs by platform."""
    return rows.where("platform is not null and slug <> ''").groupBy("platform").agg(F.count_distinct("slug").alias("n_slugs"), F.count("*").alias("n_urls"))


def tier(last: Column, as_of: str) -> Column:
    """Verification tier by age in days: under 30, under 60, else or never."""
    age = F.datediff(F.to_date(F.lit(as_of)), last)
    return F.when(age < 30, 1).when(age < 60, 2).otherwise(3)


def domain_consistency(rows: DataFrame, group: str, domain: str, expected: str) -> DataFrame:
    """Verdict on the domains of a group: all the expected one, all one other, or mixed."""
    got = rows.groupBy(group).agg(F.count_distinct(domain).alias("n_domains"), F.count_if(F.col(domain) == F.col(expected)).alias("n_expected"), F.count("*").alias("n"))
    verdict = F.when(F.col("n_expected") == F.col("n"), "expected").when(F.col("n_domains") == 1, "other").when(F.col("n_expected") * 2 > F.col("n"), "mostly_expected").otherwise("conflict")
    return got.select(group, "n_domains", "n", verdict.alias("verdict"))


def _root(email: str) -> Column:
    """The first label of an address's domain, lower case; null without a domain."""
    return F.nullif(F.lower(F.regexp_extract(email, r"^[^@]*@([^@.]+)", 1)), F.lit(""))


def stored_roots(contacts: DataFrame) -> DataFrame:
    """(company, stored): the domain's first label of each company's first active contact by contact_id that has an address. contacts: (contact_id, company, email, status)."""
    rows = contacts.where("status = 'active'").select("company", "contact_id", _root("email").alias("root")).where("root is not null and company is not null")
    return rows.groupBy("company").agg(F.min_by("root", F.struct("contact_id", "root")).alias("stored"))


def checked_buffer(buffer: DataFrame, contacts: DataFrame, expected: DataFrame) -> DataFrame:
    """(company, email, reference, verdict, kept): found addresses (company, email) against what is known of their companies.

    An address that the company has already is left out, and each counts once. The reference is the
    domain of the company's stored contacts, else the one that is expected (company, root). Without one
    all are kept (trusted). A company's addresses of one domain are all kept if it is the reference
    (consistent), else all dropped (conflict); of several domains those of the reference are kept
    (tiebreak), or none is where none has it (unmatched). An address without a domain has one of its own.
    """
    known = contacts.select("company", F.lower("email").alias("email"))
    rows = buffer.where("company is not null and email is not null").select("company", F.lower("email").alias("email")).distinct().join(known, ["company", "email"], "left_anti")
    told = stored_roots(contacts).join(expected.groupBy("company").agg(F.min(F.lower("root")).alias("root")), "company", "full_outer")
    rows = rows.join(told.select("company", F.coalesce("stored", F.nullif("root", F.lit(""))).alias("reference")), "company", "left")
    domain = F.coalesce(F.nullif(F.regexp_extract("email", r"@([^@]*)$", 1), F.lit("")), F.concat(F.lit("@"), "email"))
    rows = rows.withColumn("domain", domain).withColumn("fits", F.coalesce(_root("email") == F.col("reference"), F.lit(False)))
    # sums of a company come back by a join, so that one of very many addresses is no task of its own
    sums = rows.groupBy("company").agg(F.min("domain").alias("first"), F.max("domain").alias("last"), F.bool_or("fits").alias("any"))
    one = F.col("first") == F.col("last")
    verdict = F.when(F.col("reference").isNull(), "trusted").when(one & F.col("any"), "consistent").when(one, "conflict").when(F.col("any"), "tiebreak").otherwise("unmatched")
    return rows.join(sums, "company").select("company", "email", "reference", verdict.alias("verdict"), (F.col("reference").isNull() | F.col("fits")).alias("kept"))


def top_members(rows: DataFrame, group: str, first: Column, order: list, k: int) -> DataFrame:
    """The k first members of each group, those with `first` ahead."""
    w = Window.partitionBy(group).orderBy(F.when(first, 0).otherwise(1), *order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
