"""Relevance, resolution and page queries, and the SQL that each must equal where there is some."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages as P
from ..operators import relevance as R
from ..operators import resolve as E
from .roles import AS_OF, oracle, role

_PLACES = ("Austin, TX", "Delhi, IN, India", "Jordan, UT", "Dublin, IE", "IND.Chennai", "US-CA-Menlo Park", "Remote", "England", "New England", "Toronto, CAN", "PUNE 05", "Wales", "Springfield", "", "Seattle (WA)", "Berlin, Germany")
_US = (True, False, True, False, False, True, True, False, True, False, False, False, True, True, True, False)


def _posts(s, d):
    """Postings with places, dates and keywords dealt by number, as the tables have none."""
    place = F.element_at(F.array(*map(F.lit, _PLACES)), (F.pmod("job_id", F.lit(len(_PLACES))) + 1).cast("int"))
    return role(s, d, "postings").select(
        "job_id", "company", F.concat("title", F.when(F.col("job_id") % 3 == 0, " Senior Engineer").when(F.col("job_id") % 3 == 1, " Data Analyst").otherwise("")).alias("title"), place.alias("location"),
        F.when(F.col("job_id") % 2 == 0, "uses Python and SQL").otherwise("uses Spark").alias("description"), F.when(F.col("job_id") % 11 != 0, F.timestamp_add("DAY", -(F.col("job_id") % 6).cast("int"), F.lit(AS_OF).cast("timestamp"))).alias("posted_at"),
        F.when(F.col("job_id") % 13 == 0, "DE").when(F.col("job_id") % 13 == 1, "US").alias("country"), F.when(F.col("job_id") % 5 == 0, "greenhouse").otherwise("lever").alias("ats"), (F.col("job_id") % 17 == 0).alias("known"),
    )


def _left(s, d):
    return s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("left_id"), F.lower("text").alias("name"), F.lower(F.substring_index("text", " ", 1)).alias("block"))


def _right(s, d):
    return s.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("right_id"), F.lower("text").alias("name"), F.lower(F.substring_index("text", " ", 1)).alias("block"))


def _parts(s, d, key, name):
    return s.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias(key), F.lower(name).alias("name"))


def _scan(s, d):
    e = role(s, d, "requests")
    return e.select(F.col("user_id").alias("scan"), F.floor(F.col("event_id") / 500).alias("page"), (F.col("class") == "ok").alias("known"))


QUERIES = {
    "q_location": lambda s, d: _posts(s, d).select("job_id", R.is_us(F.col("location")).alias("is_us")),
    "q_score": lambda s, d: _posts(s, d).select("job_id", R.score(F.col("title"), F.col("description"), F.col("posted_at"), AS_OF).alias("score")),
    "q_relevance_filter": lambda s, d: R.relevant(_posts(s, d), AS_OF).select("job_id", "score"),
    "q_detail_outcome": lambda s, d: R.detail_outcome(_posts(s, d), AS_OF),
    "q_fuzzy_candidates": lambda s, d: E.candidates(_left(s, d), _right(s, d)),
    "q_fuzzy_decision": lambda s, d: E.decide(E.candidates(_left(s, d), _right(s, d))),
    "q_keyword_subset": lambda s, d: E.keyword_links(_parts(s, d, "left_id", F.substring_index("p_name", " ", 2)), _parts(s, d, "right_id", F.col("p_name"))),
    "q_keyword_classes": lambda s, d: E.keyword_classes(_parts(s, d, "left_id", F.substring_index("p_name", " ", 2)), _parts(s, d, "right_id", F.col("p_name"))),
    "q_early_exit_page": lambda s, d: P.early_exit(_scan(s, d)),
    "q_dead_letter": lambda s, d: P.dead_letters(role(s, d, "requests").select(F.floor(F.col("event_id") / 4).alias("message"), (F.col("class") == "429").alias("ok")), 4),
}

_POSTS = f""", x AS (SELECT job_id, title || CASE job_id % 3 WHEN 0 THEN ' Senior Engineer' WHEN 1 THEN ' Data Analyst' ELSE '' END AS title, ([{', '.join(str(u).lower() for u in _US)}])[job_id % {len(_US)} + 1] AS is_us,
 CASE WHEN job_id % 2 = 0 THEN 'uses python and sql' ELSE 'uses spark' END AS about, CASE WHEN job_id % 11 <> 0 THEN job_id % 6 END AS age, CASE job_id % 13 WHEN 0 THEN 'DE' WHEN 1 THEN 'US' END AS country, job_id % 5 = 0 AS dated, job_id % 17 = 0 AS known FROM postings),
 y AS (SELECT *, regexp_matches(lower(title), 'engineer|analyst|developer|scientist') AS fits, (10 + CASE WHEN regexp_matches(lower(title), 'senior|staff|principal|lead') THEN 5 ELSE 0 END
 + 2 * len(list_filter(['python', 'spark', 'sql', 'java', 'aws'], lambda k: contains(translate(lower(title), 'àáâäèéêëìíîïòóôöùúûüñç', 'aaaaeeeeiiiioooouuuunc') || ' ' || about, k))) + CASE WHEN age = 0 THEN 5 WHEN age = 1 THEN 3 WHEN age <= 3 THEN 1 ELSE 0 END)::BIGINT AS score FROM x)"""

#: Token-set similarity of whole texts in a block. With the common words in front, two sorted texts' longest common
#: subsequence is that stretch and the rest's; the rest's is worked out a character of the shorter at a time, for all
#: places in the longer at once: what it was there, or one more than it was before the last place with that character.
_FUZZY = r"""
WITH RECURSIVE
t AS (SELECT item_id AS left_id, doc_id AS right_id, list_sort(list_distinct(list_filter(string_split_regex(lower(b.text), '\s+'), lambda w: w <> ''))) AS x, list_sort(list_distinct(list_filter(string_split_regex(lower(d.text), '\s+'), lambda w: w <> ''))) AS y
 FROM benchmark b JOIN documents d ON lower(split_part(b.text, ' ', 1)) = lower(split_part(d.text, ' ', 1))),
s AS (SELECT left_id, right_id, len(x) AS nx, len(y) AS ny, array_to_string(list_filter(x, lambda w: list_contains(y, w)), ' ') AS bw, array_to_string(list_filter(x, lambda w: NOT list_contains(y, w)), ' ') AS ox, array_to_string(list_filter(y, lambda w: NOT list_contains(x, w)), ' ') AS oy FROM t),
c AS (SELECT left_id, right_id, j, substr(oy, j::INTEGER, 1) AS c, ox FROM s, unnest(range(1, length(oy) + 1)) u(j) WHERE ox <> '' AND oy <> ''),
dp(left_id, right_id, j, i, v) USING KEY (left_id, right_id, j) AS (
 SELECT left_id, right_id, j, 0, 0 FROM c
 UNION
 SELECT left_id, right_id, j, i + 1, greatest(v, coalesce(max(up) OVER (PARTITION BY left_id, right_id ORDER BY j), 0)) FROM
 (SELECT dp.left_id, dp.right_id, dp.j, dp.i, dp.v, CASE WHEN c.c = substr(c.ox, dp.i + 1, 1) THEN coalesce(lag(dp.v) OVER (PARTITION BY dp.left_id, dp.right_id ORDER BY dp.j), 0) + 1 END AS up FROM dp JOIN c ON c.left_id = dp.left_id AND c.right_id = dp.right_id AND c.j = dp.j WHERE dp.i < length(c.ox))),
k AS (SELECT left_id, right_id, max(v) AS common FROM dp GROUP BY 1, 2),
r AS (SELECT left_id, right_id, CASE WHEN nx = 0 OR ny = 0 THEN 0 WHEN bw <> '' AND (ox = '' OR oy = '') THEN 100 ELSE greatest(200.0::DOUBLE * (p + coalesce(common, 0)) / (2 * p + length(ox) + length(oy)), CASE WHEN bw <> '' THEN 200.0::DOUBLE * length(bw) / (length(bw) + p + least(length(ox), length(oy))) ELSE 0 END) END AS score
 FROM (SELECT *, CASE WHEN bw <> '' THEN length(bw) + 1 ELSE 0 END AS p FROM s) LEFT JOIN k USING (left_id, right_id)),
q AS (SELECT left_id, right_id, round(score, 4) AS score, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 4) DESC, right_id)::INTEGER AS rank FROM r WHERE round(score, 4) >= 40)
"""

ORACLE_SQL = {
    "q_fuzzy_candidates": _FUZZY + " SELECT left_id, right_id, score, rank FROM q WHERE rank <= 3",
    "q_fuzzy_decision": _FUZZY + """ SELECT left_id, right_id, score, CASE WHEN score >= 95 THEN 'auto' WHEN score >= 80 AND score - coalesce(next, 0) >= 25 THEN 'dominant' ELSE 'ambiguous' END AS decision
 FROM (SELECT *, lead(score) OVER (PARTITION BY left_id ORDER BY rank) AS next FROM q WHERE rank <= 3) WHERE rank = 1""",
    "q_location": oracle("postings", body=_POSTS + " SELECT job_id, is_us FROM y"),
    "q_score": oracle("postings", body=_POSTS + " SELECT job_id, score FROM y"),
    "q_relevance_filter": oracle("postings", body=_POSTS + " SELECT job_id, score FROM y WHERE fits AND is_us"),
    "q_detail_outcome": oracle("postings", body=_POSTS + " SELECT job_id, CASE WHEN coalesce(country <> 'US', false) THEN 'filtered_country' WHEN NOT fits THEN 'filtered_title' WHEN NOT is_us THEN 'filtered_location' WHEN NOT dated AND NOT coalesce(age <= 3, true) THEN 'stale' WHEN known THEN 'duplicate' ELSE 'new' END AS outcome FROM y"),
    "q_keyword_subset": """WITH l AS (SELECT p_partkey AS id, array_to_string(string_split(lower(p_name), ' ')[1:2], ' ') AS name FROM part), r AS (SELECT p_partkey AS id, lower(p_name) AS name FROM part),
 a AS (SELECT name, min(id) AS class_id, count(*) AS n, list_filter(string_split(name, ' '), lambda x: x <> '') AS w FROM l GROUP BY 1), b AS (SELECT name, min(id) AS class_id, count(*) AS n, list_filter(string_split(name, ' '), lambda x: x <> '') AS v FROM r GROUP BY 1),
 k AS (SELECT a.name AS x, b.name AS y, a.n AS nx, b.n AS ny FROM a JOIN b ON list_has_all(v, w) AND (len(w) > 1 OR len(v) = 1) WHERE len(w) > 0)
 SELECT 'left' AS side, l.id, class_id, coalesce(links, 0)::BIGINT AS links, r.id AS linked_id FROM l JOIN a ON l.name IS NOT DISTINCT FROM a.name LEFT JOIN (SELECT x, sum(ny) AS links FROM k GROUP BY 1) s ON s.x = l.name LEFT JOIN (k JOIN r ON r.name = k.y) ON k.x = l.name
 UNION ALL SELECT 'right', id, class_id, coalesce(links, 0)::BIGINT, NULL FROM r JOIN b ON r.name IS NOT DISTINCT FROM b.name LEFT JOIN (SELECT y, sum(nx) AS links FROM k GROUP BY 1) ON y = r.name""",
    "q_keyword_classes": "WITH l AS (SELECT left_name, count(*) AS left_rows, list_filter(string_split(left_name, ' '), lambda x: x <> '') AS w FROM (SELECT array_to_string(string_split(lower(p_name), ' ')[1:2], ' ') AS left_name FROM part) GROUP BY 1), r AS (SELECT lower(p_name) AS right_name, count(*) AS right_rows, list_filter(string_split(lower(p_name), ' '), lambda x: x <> '') AS v FROM part GROUP BY 1) SELECT left_name, right_name, left_rows, right_rows FROM l JOIN r ON list_has_all(v, w) AND (len(w) > 1 OR len(v) = 1) WHERE len(w) > 0",
    "q_early_exit_page": oracle("requests", body=", p AS (SELECT user_id AS scan, event_id // 500 AS page, count(*) AS n, count_if(class = 'ok') AS k FROM requests GROUP BY 1, 2), r AS (SELECT scan, page, k = n OR sum(CASE WHEN k >= 0.8 * n THEN 1 ELSE 0 END) OVER (PARTITION BY scan ORDER BY page ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) >= 2 AS stop FROM p) SELECT scan, min(CASE WHEN stop THEN page END) AS exit_page, count(*) AS n_pages FROM r GROUP BY 1"),
    "q_dead_letter": oracle("requests", body="SELECT event_id // 4 AS message, count(*) AS n, CASE WHEN bool_or(class = '429') THEN 'done' WHEN count(*) >= 4 THEN 'dead' ELSE 'retry' END AS state FROM requests GROUP BY 1"),
}
