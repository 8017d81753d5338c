"""The queries of the training-data operators, one for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import align, decontaminate, language_id, negatives, packing, prob_minhash, quality_rules, resample, secret_scan, substring_dedup, token_counts, url_filters, warc
from .common import folder, sized, table

#: Fixed values of the contract: verdict and rule.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prob_minhash.classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.ledger_of(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"] < len(secret_scan.BASE_RULES))
    number = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [number(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(secret_scan.written(base).cast("binary"), 256).alias("base_sha256"), secret_scan.written(F.col("spans")).alias("spans"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    return cut.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    # as the contract sets labels: every seventh row has the next one
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", label.alias("label"), "embedding"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = folder(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), to)
    return warc.read_warc(spark, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALL = (op1_best_fit_packing, op2_token_counts, op3_decontamination, op4_quality_classifier, op5_quality_rules, op6_minhash_dedup, op7_language_id, op8_secret_scan, op9_suffix_dedup, op10_url_filters, op11_hard_negatives, op12_token_alignment, op13_warc)


def _sized(query):
    """The query, its result in as many parts as the size of its table asks for."""
    name = {op10_url_filters: "pages", op13_warc: "pages", op11_hard_negatives: "embeddings"}.get(query, "documents")
    return lambda spark, sf_dir: sized(query(spark, sf_dir), table(spark, sf_dir, name))


QUERIES = {f.__name__: _sized(f) for f in _ALL}
#: Word shingles as arrays of five; documents are matched on the joined string.
_OP3 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM b WHERE len(w) >= 5),
n AS (SELECT item_id, count(*) AS n_shingles FROM bs GROUP BY 1)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles, count(*)::DOUBLE / any_value(n_shingles) AS containment
FROM ds JOIN bs USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= 0.8 * any_value(n_shingles) - 1e-9
"""



#: Each kind's matches are set off by marks and cut out; places are the lengths of what is before them. Kinds in the contract's order, then those that the method adds.
_OP8_KINDS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
    "pem": r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "forge": r"gh[pousr]_[A-Za-z0-9]{30,}",
}


def _op8() -> str:
    quoted = {kind: pattern.replace("'", "''") for kind, pattern in _OP8_KINDS.items()}
    kinds = " UNION ALL ".join(f"SELECT doc_id, {k} AS o, '{kind}' AS kind, string_split(regexp_replace(t, '(?:{p})', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM d WHERE regexp_matches(t, '{p}')" for k, (kind, p) in enumerate(quoted.items()))
    return f"""
WITH d AS (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents), k AS ({kinds}),
s AS (SELECT doc_id, o, kind, p[i] AS m, list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS a FROM k, unnest(range(2, len(p) + 1, 2)) AS u(i) WHERE (o <> 1 OR length(p[i]) >= 20) AND (o <> 2 OR length(p[i]) >= 24) AND (o <> 0 OR length(regexp_extract(p[i], '{quoted["assign"]}', 1)) >= 6)),
g AS (SELECT doc_id, o, a, kind || ':' || a || ':' || (a + length(m)) AS w FROM s),
n AS (SELECT doc_id, count_if(o = 0)::BIGINT AS n0, count_if(o = 1)::BIGINT AS n1, count_if(o = 2)::BIGINT AS n2, string_agg(w, ',' ORDER BY a, o) FILTER (o < 3) AS base, string_agg(w, ',' ORDER BY a, o) AS whole FROM g GROUP BY 1)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(whole, '') AS spans FROM d LEFT JOIN n USING (doc_id)
"""


#: Weighted shingles, the probability Jaccard of every pair that shares one, and what links lead to.
_OP6 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
c AS (SELECT doc_id, s, count(*)::DOUBLE AS x FROM g GROUP BY ALL), t AS (SELECT doc_id, sum(x) AS t FROM c GROUP BY 1),
m AS (SELECT a.doc_id AS a, b.doc_id AS b, a.x AS x, b.x AS y FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id),
p AS (SELECT a, b, sum(x) AS sx, sum(y) AS sy FROM m GROUP BY 1, 2), r AS (SELECT a, b, x / y AS r, sum(x) AS xd FROM m GROUP BY 1, 2, 3),
i AS (SELECT r.a, r.b, r.r, any_value(xd) AS xd, sum(greatest(m.x, r.r * m.y)) AS i FROM r JOIN m ON r.a = m.a AND r.b = m.b GROUP BY 1, 2, 3),
j AS (SELECT i.a, i.b, sum(xd / (i + ta.t - sx + r * (tb.t - sy))) AS j FROM i JOIN p ON i.a = p.a AND i.b = p.b JOIN t ta ON i.a = ta.doc_id JOIN t tb ON i.b = tb.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM j WHERE j >= 0.8 - 1e-9 UNION SELECT b, a FROM j WHERE j >= 0.8 - 1e-9),
z(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT z.a, l.b FROM z JOIN l ON z.b = l.a),
k AS (SELECT a AS doc_id, min(b) AS class_id FROM z GROUP BY 1)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_class FROM k
"""

#: Every window of 100 bytes by its content and its least place.
_OP9 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i:i + 99] AS s FROM d, unnest(range(1, octet_length(b) - 98)) AS t(i)),
m AS (SELECT s, min(doc_id * 4294967296 + i) AS first FROM w GROUP BY 1),
f AS (SELECT doc_id, i FROM w JOIN m USING (s) WHERE doc_id * 4294967296 + i > first),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM f)),
p AS (SELECT doc_id, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY doc_id, island),
k AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 1) AS a, s - 1 AS z FROM p UNION ALL SELECT d.doc_id, coalesce(max(e), 1), any_value(octet_length(b)) FROM d LEFT JOIN p USING (doc_id) GROUP BY 1),
h AS (SELECT doc_id, string_agg(hex(b[a:z]), '' ORDER BY a) AS x FROM k JOIN d USING (doc_id) GROUP BY 1),
r AS (SELECT doc_id, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM p GROUP BY 1)
SELECT doc_id, octet_length(b) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(x)) AS kept_sha256 FROM d JOIN h USING (doc_id) LEFT JOIN r USING (doc_id)
"""


#: The same rules, seeds and links; the shares of all rounds that carry anything, summed.
_OP10 = r"""
WITH RECURSIVE p AS (SELECT page_id, html, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
v AS (SELECT *, CASE
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
  CASE rule WHEN 'example.com/de/' THEN 'block' WHEN 'example.net/en/' THEN 'allow' WHEN 'org/fr/' THEN 'allow' WHEN 'net/' THEN 'block' END AS said FROM p),
h AS (SELECT host, count_if(said = 'allow')::DOUBLE AS trust, count_if(said = 'block')::DOUBLE AS distrust FROM v WHERE host <> '' GROUP BY 1),
e AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, translate(dst, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)(?:\bhttps?:|\s(?:href|src|action|content)\s*=\s*["'']?(?:[a-z][a-z0-9+.-]*:)?)//([^/?#"''<>\s\\]+)', 1)) AS dst FROM p WHERE host <> '')) WHERE src <> dst GROUP BY 1, 2),
ways AS (SELECT src AS host, dst, 't' AS kind, n / sum(n) OVER (PARTITION BY src) AS w FROM e UNION ALL SELECT dst, src, 'd', n / sum(n) OVER (PARTITION BY dst) FROM e),
s0 AS (SELECT host, 't' AS kind, trust / (SELECT sum(trust) FROM h) AS score FROM h WHERE trust > 0 UNION ALL SELECT host, 'd', distrust / (SELECT sum(distrust) FROM h) FROM h WHERE distrust > 0),
r AS (SELECT 0 AS k, host, kind, 0.15::DOUBLE * score AS score FROM s0 UNION ALL SELECT k + 1, w.dst, r.kind, sum(0.85::DOUBLE * score * w) FROM r JOIN ways w ON r.host = w.host AND r.kind = w.kind WHERE k < 300 GROUP BY ALL),
s AS (SELECT host, coalesce(sum(score) FILTER (kind = 't'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'd'), 0) AS distrust FROM r GROUP BY 1),
b AS (SELECT host FROM s WHERE distrust > trust AND distrust * (SELECT count(*) FROM h) >= 0.5)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN host IN (SELECT host FROM b) THEN 'block' ELSE 'allow' END) AS verdict FROM v
"""

#: Every pair of an anchor and another row; the last select is by windows over them.
_OP11 = """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS s FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INTEGER AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s QUALIFY rank <= 3
"""

#: SHA-1 in base 32: five hexadecimal digits are four of its digits.
_OP13 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(t))::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY t) AS keeper, list_transform(range(8), lambda g: ('0x' || substr(h, (5 * g + 1)::INTEGER, 5))::BIGINT) AS n FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(n, lambda x: array_to_string(list_transform([32768, 1024, 32, 1], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x // b) % 32 + 1)::INTEGER, 1)), '')), '') AS payload_digest,
 CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to FROM d
"""

ORACLE_SQL: dict[str, str] = {"op3_decontamination": _OP3, "op6_minhash_dedup": _OP6, "op8_secret_scan": _op8(), "op9_suffix_dedup": _OP9, "op10_url_filters": _OP10, "op11_hard_negatives": _OP11, "op13_warc": _OP13}
