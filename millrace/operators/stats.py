"""Totals of weekly reports and runs, catalogue lookups, and checks of queues and workers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fold import fold
from .health import pct


def found(recruiters: DataFrame, since: str) -> DataFrame:
    """How many active recruiters were found since a day, and at how many companies."""
    rows = recruiters.where((F.col("status") == "active") & (F.col("created_at") >= F.lit(since).cast("date")))
    return rows.agg(F.count("*").alias("total_found"), F.count_distinct("company").alias("companies_found"))


def verified(recruiters: DataFrame, since: str) -> DataFrame:
    """How many recruiters were verified since a day, and how many of these turned out to be inactive."""
    rows = recruiters.where(F.col("verified_at") >= F.lit(since).cast("date"))
    return rows.agg(F.count("*").alias("verified"), F.count_if(F.col("status") == "inactive").alias("inactive"))


def enrichment(catalogue: DataFrame) -> DataFrame:
    """How far the active part of a catalogue is enriched."""
    n, done = F.count("*"), F.count_if("enriched")
    return catalogue.where("active").agg(n.alias("total"), done.alias("enriched"), (n - done).alias("pending"), pct(done, n).alias("pct"))


def slug_stats(catalogue: DataFrame) -> DataFrame:
    """For each platform, its slugs, those enriched, inactive, and found by detection."""
    return catalogue.groupBy("platform").agg(F.count("*").alias("total"), F.count_if("enriched").alias("enriched"), F.count_if(~F.col("active")).alias("inactive"), F.count_if(F.col("source") == "detection").alias("detected"))


def cache_stats(catalogue: DataFrame) -> DataFrame:
    """For each source its active slugs, with the shares enriched of it and of all."""
    rows = catalogue.where("active").groupBy("source").agg(F.count("*").alias("n"), F.count_if("enriched").alias("enriched"))
    whole = Window.partitionBy()  # sources are a handful
    return rows.select("source", "n", pct(F.col("enriched"), F.col("n")).alias("enriched_pct"), pct(F.sum("enriched").over(whole), F.sum("n").over(whole)).alias("all_enriched_pct"))


def run_metrics(attempts: DataFrame, applications: DataFrame) -> DataFrame:
    """One row a day: companies attempted, found and exhausted, with the share found, and the share of applications that can be written to; null where there are none."""
    a = attempts.groupBy("day").agg(F.count("*").alias("attempted"), F.count_if(F.col("status") == "found").alias("auto_found"), F.count_if(F.col("status") == "exhausted").alias("exhausted"))
    b = applications.groupBy("day").agg(F.count("*").alias("applications"), F.count_if("sendable").alias("sendable"))
    rows = a.join(b, "day", "full_outer").fillna(0, ["attempted", "auto_found", "exhausted", "applications", "sendable"])
    return rows.select("day", "applications", "attempted", "auto_found", "exhausted", pct(F.col("auto_found"), F.col("attempted"), empty=None).alias("metric1"), pct(F.col("sendable"), F.col("applications"), empty=None).alias("metric2"))


def send_totals(outreach: DataFrame) -> DataFrame:
    """Sequences that are under way, that have come to their last stage, and that wait for a reply; one row."""
    s = F.col("status")
    return outreach.agg(F.count_if(s.isin("sent", "scheduled")).alias("active"), F.count_if((F.col("stage") == "followup2") & (s == "sent")).alias("completed"), F.count_if((s == "sent") & ~F.col("replied")).alias("pending_reply"))


def recruiters_of(applications: DataFrame, bridge: DataFrame, recruiters: DataFrame) -> DataFrame:
    """The active recruiters of each application."""
    active = recruiters.where("status = 'active'")
    return applications.select("application_id").join(bridge, "application_id").join(active, "recruiter_id")


def first_match(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """(name, platform, slug): for each name the first catalogue row, by its place, whose company has all of the name's words.

    Joined on the name's word that the fewest rows have, then all words are tested.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != ""))
    rows = catalogue.where("active AND company <> ''").select("place", "platform", "slug", words(F.col("company")).alias("v"))
    exploded = rows.select("place", "platform", "slug", "v", F.explode("v").alias("word"))
    counts = exploded.groupBy("word").agg(F.count("*").alias("n"))
    asked = names.select("name", words(F.col("name")).alias("w")).distinct()
    key = asked.select("name", "w", F.explode("w").alias("word")).join(counts, "word").groupBy("name", "w").agg(F.min_by("word", F.struct("n", "word")).alias("word"))
    hits = key.join(exploded, "word").where(F.size(F.array_except("w", "v")) == 0)
    return hits.groupBy("name").agg(F.min_by(F.struct("platform", "slug"), "place").alias("hit")).select("name", "hit.*")


def plain_company(name: Column) -> Column:
    """Lower case without stops, commas and hyphens; legal forms stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"[.,\-]", ""), r"\s+", " "))


def email_fits(email: Column, root: Column) -> Column:
    """Whether the first label of an address's domain is the one that is expected."""
    return F.coalesce((F.instr(email, "@") > 0) & (F.substring_index(F.substring_index(F.substring_index(email, "@", 2), "@", -1), ".", 1) == root), F.lit(False))


def alpha2(code: Column, countries: Sequence[tuple[str, str, str]]) -> Column:
    """The two letters of a country's three, upper case; empty for none that is known. countries as in places.countries()."""
    pairs = F.create_map(*[F.lit(x) for a, b, _ in [*countries, ("usa", "us", "")] for x in (a, b)])
    return F.coalesce(F.upper(F.element_at(pairs, F.lower(code))), F.lit(""))


def slug_config(platform: Column, slug: Column, json_platforms: Sequence[str] = ("workday", "oracle_hcm", "custom")) -> Column:
    """A slug as a map: of text platforms itself, of the others their JSON with what is missing filled in, or defaults where it is none."""
    bad = F.try_parse_json(slug).isNull()
    read = F.from_json(slug, "map<string,string>")
    plain = F.create_map(F.lit("slug"), F.coalesce(slug, F.lit("")))
    careers = F.create_map(F.lit("path"), F.lit("careers"))
    filled = F.when((platform == "workday") & ~F.map_contains_key(read, "path"), F.map_concat(read, careers)).otherwise(read)
    default = (
        F.when(platform == "workday", F.map_concat(plain, F.create_map(F.lit("wd"), F.lit("wd5")), careers))
        .when(platform == "oracle_hcm", F.map_concat(plain, F.create_map(F.lit("site"), F.lit(""))))
        .otherwise(F.create_map().cast("map<string,string>"))
    )
    return F.when(~platform.isin(*json_platforms), plain).when(bad, default).otherwise(filled)


#: What a posting of a platform must have before its own page is asked for, fixed values.
NEEDED: Mapping[str, Sequence[str]] = {"icims": ("base_url",), "jobvite": ("slug",), "smartrecruiters": ("company_slug",), "taleo": ("contest_no", "base_url"), "workday": ("external_path", "slug", "wd", "path")}


def fetch_detail(platform: Column, has_detail: Column, job: Column) -> Column:
    """Whether a posting's own page is to be asked for; job is a map of what is known of it."""
    has = lambda *keys: F.forall(F.array(*map(F.lit, keys)), lambda k: F.coalesce(F.element_at(job, k), F.lit("")) != "")
    out = F.when(~has_detail, False)
    for name, keys in NEEDED.items():
        out = out.when(platform == name, has(*keys))
    out = out.when(platform == "sitemap", has("job_url") & (F.coalesce(F.element_at(job, F.lit("feed_type")), F.lit("")) != "xml"))
    return out.when(platform == "custom", has("detail") & ~has("description")).otherwise(has("job_url"))


#: Seconds without a heartbeat after which a worker of a kind is taken for dead, fixed values.
SILENT = {"scheduler": 20, "scan_worker": 45, "detail_worker": 45, "fullscan_worker": 1900, "match_worker": 60, "email_processor": 60}


def dead_workers(beats: DataFrame, as_of: str, warn: int = 3, error: int = 5) -> DataFrame:
    """(kind, dead, level) from heartbeats (kind, worker, ts): workers whose last one is too old, and what that many of a kind mean."""
    limits = F.create_map(*[F.lit(x) for pair in SILENT.items() for x in pair])
    last = beats.groupBy("kind", "worker").agg(F.max("ts").cast("timestamp").alias("last"))
    silent = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("last") > F.element_at(limits, F.col("kind"))
    dead = last.groupBy("kind").agg(F.count_if(silent).alias("dead"))
    return dead.select("kind", "dead", F.when(F.col("dead") >= error, "error").when(F.col("dead") >= warn, "warning").otherwise("ok").alias("level"))


def dead_letter_depth(letters: DataFrame, as_of: str, days: int = 7, most: int = 50) -> DataFrame:
    """(queue, depth, level) of dead-letter queues (queue, died_at) once what is older than so many days has gone."""
    young = F.col("died_at").cast("timestamp") >= F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    depth = letters.groupBy("queue").agg(F.count_if(young).alias("depth"))
    return depth.select("queue", "depth", F.when(F.col("depth") > most, "warning").otherwise("ok").alias("level"))


def _healed(state: tuple, at: int, gap: int, window: int, most: int, again: int) -> tuple[tuple, list]:
    """One alert: times of attempts still in the window, time of the last escalation."""
    attempts, escalated = state
    # the count of attempts lives as long as the window from its first one
    attempts = attempts if attempts and at - attempts[0] < window else ()
    if escalated is not None and at - escalated < again:
        return (attempts, escalated), [(at, "escalated_before")]
    if attempts and at - attempts[-1] < gap:
        return (attempts, None), [(at, "cooling_down")]
    if len(attempts) >= most:
        return (attempts, at), [(at, "escalate")]
    return ((*attempts, at), None), [(at, "heal")]


def heals(alerts: DataFrame, gap: int = 150, window: int = 1800, most: int = 3, again: int = 86400) -> DataFrame:
    """(kind, second, action) for alerts (kind, second): a restart, at most so many in a window and none soon after another; then it is escalated, once in a day."""
    step = partial(_healed, gap=gap, window=window, most=most, again=again)
    return fold(alerts, "kind", ["second"], ["second"], lambda: ((), None), step, None, "second bigint, action string")


def queue_health(queues: DataFrame, before: DataFrame, warn_s: int = 600, error_s: int = 1800) -> DataFrame:
    """(queue, depth, trend, level) from snapshots (queue, depth, oldest_s): growing against the snapshot before, and how long the oldest has been waiting."""
    rows = queues.join(before.select("queue", F.col("depth").alias("was")), "queue", "left")
    trend = F.when(F.col("was").isNull(), "new").when(F.col("depth") > F.col("was"), "growing").when(F.col("depth") < F.col("was"), "shrinking").otherwise("steady")
    level = F.when(F.col("oldest_s") > error_s, "error").when((F.col("oldest_s") > warn_s) | ((trend == "growing") & (F.col("depth") > 0) & (F.col("was") == 0)), "warning").otherwise("ok")
    return rows.select("queue", "depth", trend.alias("trend"), level.alias("level"))
