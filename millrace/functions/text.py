"""Text, name, date, URL and number functions from columns to columns, all native."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accents that are replaced, fixed values, and their plain letters.
ACCENTS, PLAIN = "àáâäèéêëìíîïòóôöùúûüñç", "aaaaeeeeiiiioooouuuunc"
#: Abbreviations in employer names, fixed values.
ABBREVIATIONS = {
    "SVCS": "SERVICES", "SRVCS": "SERVICES", "TECHNOL": "TECHNOLOGIES", "INTL": "INTERNATIONAL", "MGMT": "MANAGEMENT", "MGT": "MANAGEMENT",
    "NATL": "NATIONAL", "MFG": "MANUFACTURING", "GRP": "GROUP", "LTD": "LIMITED", "PWC": "PRICEWATERHOUSECOOPERS", "UNIV": "UNIVERSITY",
}
#: Legal forms at the end of names, fixed values.
LEGAL_SUFFIXES = "INCORPORATED|INC|LLC|LLP|LP|CORPORATION|CORP|COMPANY|CO|LIMITED|LTD|PLC|GMBH"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize(text: Column) -> Column:
    """Lower case, accents replaced, white space collapsed."""
    return collapse(F.translate(F.lower(text), ACCENTS, PLAIN))


def ngrams(tokens: Column, most: int = 3) -> Column:
    """Phrases of one to `most` successive tokens, the shorter first."""
    n = F.size(tokens)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " "))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[of(k) for k in range(1, most + 1)]))


def entity_name(name: Column, strip_dba: bool = True) -> Column:
    """An employer's name in the form that both sources are matched in: upper case, no punctuation, no leading THE, nothing after DBA or AKA, single letters joined, abbreviations in full."""
    x = F.regexp_replace(F.upper(F.coalesce(name, F.lit(""))), "'", "")
    x = F.regexp_replace(F.regexp_replace(x, "&", " "), r"\bAND\b", " ")
    x = F.regexp_replace(collapse(F.regexp_replace(x, "[^A-Z0-9 ]", " ")), "^THE ", "")
    if strip_dba:
        spaced, plain = F.instr(x, " D B A "), F.instr(x, " DBA ")
        cut = F.when(spaced > 0, spaced).when(plain > 0, plain).otherwise(F.instr(x, " AKA "))
        x = F.when(cut > 0, F.substring(x, F.lit(1), cut - 1)).otherwise(x)
    x = F.regexp_replace(x, r"(?<=\b[A-Z]) (?=[A-Z]\b)", "")
    for short, full in ABBREVIATIONS.items():
        x = F.regexp_replace(x, rf"\b{short}\b", full)
    return collapse(x)


def strip_legal(name: Column) -> Column:
    """Without legal suffixes at the end, however many."""
    return F.trim(F.regexp_replace(name, rf"(?:[ ,.]+(?:{LEGAL_SUFFIXES})\b\.?)+$", ""))


def parse_date(value: Column) -> Column:
    """A moment from seconds, milliseconds, ISO forms or, in this order, common written forms; else null. Month before day where both fit."""
    v = F.trim(value)
    number = F.when(F.regexp_like(v, F.lit(r"^\d{10,13}$")), v.cast("bigint"))
    of_number = F.when(number > 100_000_000_000, F.timestamp_millis(number)).otherwise(F.timestamp_seconds(number))
    # fixed forms, in order
    forms = ["yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy"]
    iso = F.when(F.regexp_like(v, F.lit(r"^\d{4}-\d{2}-\d{2}")), F.lit("1"))
    parsed = [F.when(iso.isNotNull(), F.try_to_timestamp(F.regexp_replace(v, " ", "T")))] + [F.try_to_timestamp(v, F.lit(f)) for f in forms]
    return F.coalesce(of_number, *parsed)


#: Where an id stands in a path, fixed values, in order of preference.
ID_PATTERNS = (
    r"/(\d{15,})-",
    r"/(\d{5,})/[a-z0-9\-]+$",
    r"--(\d{5,})(?:/|$)",
    r"/(\d{4,})(?:/|$)",
    r"/[a-z][a-z0-9\-]+-(\d{5,})(?:$|/)",
    r"(?i)/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})(?:/|$)",
)


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_id(url: Column) -> Column:
    """A posting's id from its address; else empty."""
    path = url_path(url)
    return F.coalesce(*[F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in ID_PATTERNS], F.lit(""))


def registrable(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def slug(url: Column) -> Column:
    """struct(platform, slug) of a posting address: the middle label of the registrable domain, and the host's own part or, where that says nothing, the first part of the path; null where neither fits."""
    host, path = url_host(url), url_path(url)
    platform = F.nullif(F.substring_index(registrable(host), ".", 1), F.lit(""))
    sub = F.regexp_extract(host, r"^(?:www\.|m\.|blog\.)?([^.]+)\.[^.]+\.[^.]+$", 1)
    own = F.coalesce(F.nullif(sub, F.lit("")), F.nullif(F.regexp_extract(path, r"^/([^/]+)", 1), F.lit("")))
    return F.when(platform.isNotNull() & own.isNotNull(), F.struct(platform.alias("platform"), own.alias("slug")))


def salary(text: Column) -> Column:
    """struct(low, high): the two smallest of the distinct amounts of at least 1000 in a text, k for thousands."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\$\s*(\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*(k?)"), 0)
    amount = lambda x: F.regexp_replace(F.regexp_extract(x, r"(\d[\d,]*)", 1), ",", "").cast("bigint") * F.when(x.endswith("k"), 1000).otherwise(1)
    sums = F.array_sort(F.array_distinct(F.filter(F.transform(found, amount), lambda x: x >= 1000)))
    return F.when(F.size(sums) > 0, F.struct(F.get(sums, 0).alias("low"), F.coalesce(F.get(sums, 1), F.get(sums, 0)).alias("high")))


def clean_html(html: Column) -> Column:
    """Text of a page: comments, script and style bodies and tags go, the common entities are written out, white space collapses. Native; scripts' text is dropped on purpose."""
    x = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?s)<[^>]*>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return collapse(x)


def json_ld(html: Column, type_: str) -> Column:
    """The first JSON-LD object of a type in a page, as text; else null."""
    bodies = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), 1)
    good = F.filter(bodies, lambda b: F.get_json_object(b, "$.@type") == type_)
    return F.get(good, 0)


def absolute_url(value: Column, base: Column) -> Column:
    """A page's link as an address: as it is with http or https, else resolved against the page's; empty for a blank one, itself without a base."""
    v, b = F.trim(F.coalesce(value, F.lit(""))), F.coalesce(base, F.lit(""))
    scheme = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1)
    origin = F.regexp_extract(b, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path, query = F.regexp_extract(b, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.regexp_extract(b, r"(\?[^#]*)", 1)
    own, rest = F.regexp_extract(v, r"^([^?#]*)", 1), F.regexp_extract(v, r"^[^?#]*(.*)$", 1)
    at = F.when(own.startswith("/"), own).otherwise(F.concat(F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1)), own))
    parts = F.split(at, "/")
    last = F.element_at(parts, -1)
    # . stays where it is and .. goes up one; both at the end leave a folder
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda s, p: F.when(p == ".", s).when(p == "..", F.when(F.size(s) > 1, F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(s)).otherwise(F.concat(s, F.array(p))))
    resolved = F.concat(F.array_join(walk, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    return (
        F.when(v == "", "")
        .when(F.regexp_like(v, F.lit("(?i)^https?:")), v)
        .when(origin == "", v)
        .when(F.regexp_like(v, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), v)
        .when(v.startswith("//"), F.concat(scheme, F.lit(":"), v))
        .when(own == "", F.concat(origin, path, F.when(v.startswith("?"), v).otherwise(F.concat(query, v))))
        .otherwise(F.concat(origin, resolved, rest))
    )


def slug_text(slug: Column) -> Column:
    """What a slug says: of a JSON object its text values, else itself; lower case."""
    values = F.map_values(F.from_json(slug, "map<string,string>"))
    texts = F.filter(values, lambda x: x.isNotNull() & ~F.regexp_like(x, F.lit(r"^(?:-?\d+(?:\.\d+)?|true|false|null|[\[{].*)$")))
    return F.lower(F.when(F.try_parse_json(slug).isNotNull() & F.ltrim(slug).startswith("{"), F.array_join(texts, " ")).otherwise(F.coalesce(slug, F.lit(""))))


def compound_parts(name: Column) -> Column:
    """The parts of a compound name in order: itself, its pieces between underscores, hyphens and dots, and its humps; lower case, each once."""
    split = [F.split(name, p) for p in ("_", "-", r"\.")]
    humps = F.regexp_extract_all(name, F.lit(r"[A-Z]?[a-z0-9]+|[A-Z]+(?=[A-Z]|$)"), F.lit(0))
    whole = F.concat(F.array(name), *split, humps)
    return F.array_sort(F.array_distinct(F.filter(F.transform(whole, F.lower), lambda p: p != "")))


#: Words that say nothing about which company it is, fixed values.
COMPANY_WORDS = "inc|corp|llc|ltd|co|company|technologies|tech|systems|solutions|services|group|holding|holdings"


def company_words(name: Column) -> Column:
    """A company's name in lower case without the words that say nothing."""
    x = F.trim(F.regexp_replace(F.lower(F.trim(name)), rf"\b({COMPANY_WORDS})\.?\b", ""))
    return F.regexp_replace(x, r"^[.,]+|[.,]+$", "")


def company_keywords(name: Column) -> Column:
    """The words of a company's name that tell it from others, of three letters at least."""
    return F.filter(F.split(company_words(name), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)


def company_slugs(name: Column) -> Column:
    """Slugs that a company may have, the likeliest first: joined, hyphened, its first word, its first two."""
    x = company_words(name)
    words = F.filter(F.split(x, "[^a-z0-9]+"), lambda w: w != "")
    joined = F.regexp_replace(x, "[^a-z0-9]", "")
    hyphened = F.regexp_replace(F.regexp_replace(x, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    two = F.when(F.size(words) >= 2, F.array_join(F.slice(words, 1, 2), "")).otherwise(joined)
    return F.array_distinct(F.filter(F.array(joined, hyphened, F.element_at(F.split(x, "[^a-z0-9]"), 1), two), lambda v: v != ""))


def cache_key(*parts: Column) -> Column:
    """The SHA-256 of parts joined by hyphens, nulls as empty."""
    return F.sha2(F.concat_ws("-", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


#: How addresses of known portals name their customers: platform, pattern, and whether names are the same in any case. A pattern's groups are joined by slashes; the first that fits counts, so an embedded board comes before its host's own pages.
PORTAL_PATTERNS = (
    ("greenhouse", r"(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/embed/[^?#\s]*\?(?:[^#\s]*&)?for=([A-Za-z0-9_-]+)", True),
    ("greenhouse", r"(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?!embed\b)([A-Za-z0-9_-]+)", True),
    ("lever", r"(?:jobs|hire)(?:\.eu)?\.lever\.co/([A-Za-z0-9_-]+)", True),
    ("ashby", r"jobs\.ashbyhq\.com/([A-Za-z0-9_.%-]+)", True),
    ("smartrecruiters", r"jobs\.smartrecruiters\.com/oneclick-ui/company/([A-Za-z0-9_-]+)", True),
    ("smartrecruiters", r"(?:jobs|careers)\.smartrecruiters\.com/([A-Za-z0-9_-]+)", True),
    ("workday", r"([A-Za-z0-9_-]+)\.(wd\d+)\.myworkdayjobs\.com/(?:[a-z]{2}-[A-Z]{2}/)?([A-Za-z0-9_-]+)", False),
    ("oracle_hcm", r"([A-Za-z0-9-]+)\.fa\.[A-Za-z0-9]+\.oraclecloud\.com/.*?/sites/([A-Za-z0-9_-]+)", False),
    ("icims", r"(?:careers-|jobs-)?([A-Za-z0-9-]+)\.icims\.com", True),
    ("jobvite", r"jobs\.jobvite\.com/(?:careers/)?([A-Za-z0-9_-]+)", True),
    ("bamboohr", r"([A-Za-z0-9-]+)\.bamboohr\.com", True),
    ("taleo", r"([A-Za-z0-9-]+)\.taleo\.net/careersection/([A-Za-z0-9_-]+)", False),
    ("successfactors", r"career\d*\.(?:successfactors|sapsf)\.(?:com|eu)/.*?company=([A-Za-z0-9_-]+)", False),
    ("eightfold", r"([A-Za-z0-9-]+)\.eightfold\.ai", True),
    ("avature", r"([A-Za-z0-9-]+)\.avature\.net", True),
    ("paycom", r"paycomonline\.net/.*?clientkey=([A-Fa-f0-9]+)", False),
)


def portal_slug(url: Column, patterns: tuple[tuple[str, str, bool], ...] = PORTAL_PATTERNS) -> Column:
    """struct(platform, slug) of the first pattern that an address fits, hosts in any case; a search engine's redirect counts as what it leads to; else null."""
    target = F.try_url_decode(F.nullif(F.regexp_extract(url, r"^https?://(?:www\.)?google\.[a-z.]+/url\?(?:.*&)?(?:q|url)=([^&]+)", 1), F.lit("")))
    at = F.coalesce(target, url)
    out = F.lit(None).cast("struct<platform:string,slug:string>")
    for platform, pattern, folded in reversed(patterns):
        groups = len(re.findall(r"(?<!\\)\((?!\?)", pattern))
        slug = F.concat_ws("/", *[F.regexp_extract(at, f"(?i){pattern}", g + 1) for g in range(groups)])
        out = F.when(F.regexp_like(at, F.lit(f"(?i){pattern}")), F.struct(F.lit(platform).alias("platform"), (F.lower(slug) if folded else slug).alias("slug"))).otherwise(out)
    return out
