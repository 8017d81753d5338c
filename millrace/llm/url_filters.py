"""URL filters: rules by host and path, and link-graph propagation for urls that no rule fits.

Trust flows from trusted seed hosts along links (personalised PageRank); distrust flows from
blocked seed hosts against them, so that who links to blocked hosts shares their distrust.
Both are thresholded per host.

Defined results: a null url, or one without "://", has empty host and path, fits no rule and is
allowed; of rules of one length that fit, a blocking one wins; a null html has no links; an html of
any length is read whole; repeated pages count once a row; links of a host to itself carry nothing;
a host whose distrust equals its trust is allowed; an empty table gives no rows. Columns beyond
those named are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: The host of an absolute address: of a link, source, form or meta content, or anywhere with http or https before it.
_LINK = r"""(?i)(?:\bhttps?:|\s(?:href|src|action|content)\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?)//([^/?#"'<>\s\\]+)"""
#: Of threshold / hosts, what the scores may still lack in sum when the propagation ends.
REST = 0.01


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null. rules: (verdict, "host/path") pairs.

    A rule fits its host and all subdomains if the path starts with its path. Rules are literals of
    the plan: keep them to some hundreds.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", r[1])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(src, dst, n): links between different hosts, summed before they are shuffled."""
    dst = F.explode(F.regexp_extract_all(F.col(html), F.lit(_LINK), 1))
    links = pages.where(F.col(host) != "").select(F.col(host).alias("src"), dst.alias("dst"))
    links = links.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return links.where("src <> dst and dst <> ''").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(edges: DataFrame, seeds: DataFrame, tolerance: float, damping: float = 0.85) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, n) and seeds (host, trust, distrust).

    Scores are scaled so that the seeds of a kind hold 1 in all; mass at hosts without links is lost.
    It ends once what the scores still lack is less than tolerance in sum: a round changes them by
    damping times the round before at most, so that this takes log(tolerance) / log(damping) rounds.
    A hub is one row of the scores and many of the edges, which adaptive execution splits; sums are
    combined before the shuffle.
    """
    total = seeds.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d")).first()
    t, d = (float(total["t"] or 0) or 1.0), (float(total["d"] or 0) or 1.0)
    kinds = F.explode(F.array(F.struct(F.lit("t").alias("kind"), (F.col("trust") / t).alias("score")), F.struct(F.lit("d").alias("kind"), (F.col("distrust") / d).alias("score")))).alias("k")
    start = materialize(seeds.select("host", kinds).select("host", "k.kind", "k.score").where("score > 0"), "seeds")
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    back = edges.groupBy("dst").agg(F.sum("n").alias("all"))
    ways = edges.join(out, "src").select(F.col("src").alias("host"), F.col("dst").alias("to"), (F.col("n") / F.col("all")).alias("w"), F.lit("t").alias("kind"))
    ways = materialize(ways.unionByName(edges.join(back, "dst").select(F.col("dst").alias("host"), F.col("src").alias("to"), (F.col("n") / F.col("all")).alias("w"), F.lit("d").alias("kind"))), "ways")
    restart = start.select("host", "kind", (F.col("score") * (1 - damping)).alias("score"), F.lit(0.0).alias("was"))
    scores = start
    while True:
        moved = scores.join(ways, ["host", "kind"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("w") * damping).alias("score"), F.lit(0.0).alias("was"))
        before = scores.select("host", "kind", F.lit(0.0).alias("score"), F.col("score").alias("was"))
        new = moved.unionByName(restart).unionByName(before).groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("was").alias("was"))
        new = materialize(new, "scores")
        change = new.agg(F.sum(F.abs(F.col("score") - F.col("was")))).first()[0] or 0.0
        if scores is not start:
            discard(scores)
        scores = new.select("host", "kind", "score")
        if change * damping / (1 - damping) <= tolerance:
            break
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("score"))), F.lit(0.0))
    return scores.groupBy("host").agg(one("t").alias("trust"), one("d").alias("distrust"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], threshold: float = 0.5, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, host, path, rule, verdict, trust, distrust), a row for each page.

    Seeds are the hosts of pages that a rule allows or blocks, weighted by those pages. A host is
    blocked if its distrust is over its trust and reaches threshold times the mean over hosts.
    """
    parsed = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"), F.col(html).alias("html"))
    ruled = parsed.select("*", rule_for(F.col("host"), F.col("path"), rules).alias("r"))
    hosts = ruled.where("host <> ''").groupBy("host").agg(F.count_if(F.col("r.verdict") == "allow").cast("double").alias("trust"), F.count_if(F.col("r.verdict") == "block").cast("double").alias("distrust"))
    hosts = materialize(hosts, "hosts")
    edges = materialize(host_edges(parsed), "edges")
    n = hosts.count()
    scores = propagate(edges, hosts, REST * threshold / max(1, n))
    scores = scores.select("host", "trust", "distrust", ((F.col("distrust") > F.col("trust")) & (F.col("distrust") * n >= threshold)).alias("bad"))
    judged = ruled.select(key, "host", "path", "r").join(scores, "host", "left")
    verdict = F.coalesce("r.verdict", F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow"))
    zero = F.lit(0.0)
    return judged.select(key, "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"), F.coalesce("trust", zero).alias("trust"), F.coalesce("distrust", zero).alias("distrust"))
