"""The roles that the driver's tables play, as DataFrames and as SQL for the oracles.

events is the log of requests, of polls and of scaling events; lineitem with part are the filings;
supplier the employers; customer with orders the petitions; orders the applications. Times are
relative to a given moment, never to the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

AS_OF = "2024-01-31 00:00:00"
AS_OF_ORDERS = "2001-12-01"
#: Rows of a table that one task holds, where the table is dealt to tasks by a column.
TASK_ROWS = 500_000

#: Each is one SELECT that Spark and DuckDB both run.
SQL = {
    "requests": """SELECT event_id, ts, user_id, concat('p', cast(user_id % 7 AS string)) AS platform, cast(ts AS date) AS date, cast(floor(value * 10) AS bigint) AS ms,
        CASE WHEN event_type <> 'error' THEN 'ok' WHEN event_id % 4 = 0 THEN '429' WHEN event_id % 4 = 1 THEN '404' WHEN event_id % 4 = 2 THEN 'timeout' ELSE '5xx' END AS class,
        CASE WHEN event_id % 29 = 0 THEN 'canary' WHEN event_id % 13 = 0 THEN 'backoff' ELSE 'normal' END AS context FROM events""",
    "polls": """SELECT user_id, concat('p', cast(user_id % 7 AS string)) AS platform, cast(ts AS date) AS date, cast(floor(extract(hour FROM ts) / 6) AS int) AS slot,
        CASE WHEN min(extract(hour FROM ts)) < 18 THEN 1 ELSE 2 END AS tier,
        sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS new_jobs,
        sum(CASE WHEN event_type = 'signup' AND event_id % 30 < 1 THEN 1 ELSE 0 END) AS found_1h,
        sum(CASE WHEN event_type = 'signup' AND event_id % 30 < 4 THEN 1 ELSE 0 END) AS found_4h,
        sum(CASE WHEN event_type = 'signup' AND event_id % 30 < 24 THEN 1 ELSE 0 END) AS found_24h,
        sum(CASE WHEN event_type = 'signup' AND event_id % 10 = 9 THEN 1 ELSE 0 END) AS missed FROM events GROUP BY 1, 2, 3, 4""",
    "scaling": """SELECT event_id, ts AS occurred_at, concat('p', cast(user_id % 7 AS string)) AS platform,
        CASE event_type WHEN 'view' THEN 'worker_add' WHEN 'click' THEN 'worker_remove' WHEN 'error' THEN 'outage_start' WHEN 'signup' THEN 'outage_end' ELSE 'ceiling_learned' END AS event_type,
        value / 500 AS error_rate FROM events""",
    "filings": """SELECT concat('12-', lpad(cast(l_suppkey AS string), 7, '0')) AS fein, CASE l_returnflag WHEN 'A' THEN 'Certified' WHEN 'R' THEN 'Denied' ELSE 'Withdrawn' END AS status,
        cast(l_quantity AS bigint) AS positions, p_type AS soc, p_name AS title, year(l_shipdate) AS year, l_linestatus AS employer_state, cast(l_shipdate AS date) AS decided,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "employers": """SELECT concat('12-', lpad(cast(s_suppkey AS string), 7, '0')) AS fein, upper(replace(s_name, '#', ' ')) AS legal_norm, concat('BRAND ', cast(s_suppkey AS string)) AS dba_norm, s_nationkey, s_acctbal FROM supplier""",
    "petitions": """SELECT concat('SUPPLIER ', lpad(cast(c_custkey % 120 AS string), 9, '0')) AS legal_norm, concat('BRAND ', cast(c_custkey % 90 AS string)) AS full_norm, lpad(cast(c_custkey % 120 AS string), 4, '0') AS tax_id,
        year(o_orderdate) AS fiscal_year, o_orderkey % 2 AS a1, o_orderkey % 3 AS a2, o_orderkey % 5 AS a3, o_orderkey % 7 AS a4, o_orderkey % 11 AS a5, o_orderkey % 13 AS a6, o_orderkey, c_custkey
        FROM customer JOIN orders ON c_custkey = o_custkey""",
    "applications": """SELECT o_orderkey AS application_id, c_custkey AS user_id, c_mktsegment AS company, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'P' THEN 'exhausted' ELSE 'closed' END AS status, cast(o_orderdate AS date) AS applied_on, o_totalprice AS expected
        FROM orders JOIN customer ON o_custkey = c_custkey""",
    "bridge": "SELECT DISTINCT l_orderkey AS application_id, l_suppkey AS recruiter_id FROM lineitem",
    "recruiters": "SELECT s_suppkey AS recruiter_id, s_name AS name, s_nationkey AS nation, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'inactive' END AS status FROM supplier",
    "stages": """SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'initial' WHEN turn = 1 THEN 'followup1' ELSE 'followup2' END AS stage, CASE WHEN role = 'user' THEN 'sent' ELSE 'pending' END AS status, length(text) AS size FROM conversations""",
    "postings": """SELECT doc_id AS job_id, source AS company, substr(text, 1, 60) AS title, lang AS location, n_chars, text FROM documents""",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def role(spark: SparkSession, sf_dir: str, name: str, **dealt: str) -> DataFrame:
    """The role over the tables of sf_dir; only columns that are used are read.

    dealt: of a table a column by which its rows go to tasks before all other steps, as many tasks as it has TASK_ROWS, so that what
    one holds doesn't grow with the table; steps by that column need no other exchange.
    """
    text = SQL[name]
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in text.replace("\n", " ")}
    for t, key in dealt.items():
        args[t] = args[t].repartition(max(-(-args[t].count() // TASK_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))), key)
    for t in sorted(args, key=len, reverse=True):
        for word in ("FROM", "JOIN"):
            text = text.replace(f"{word} {t}", f"{word} {{{t}}}")
    return spark.sql(text, **args)


def oracle(*names: str, body: str) -> str:
    """SQL with the roles as common table expressions before its body."""
    given = ", ".join(f"{n} AS ({SQL[n].replace(' AS string)', ' AS varchar)')})" for n in names)
    return f"WITH {given} {'SELECT' if not body.lstrip().startswith((',', 'SELECT')) else ''} {body}" if names else body


def as_text(queries: dict, sql: dict, columns: dict[str, list[str]]) -> None:
    """Give dates and times as text on both sides, for engines hold them differently."""
    from pyspark.sql import functions as F

    for name, cols in columns.items():
        made = queries[name]
        queries[name] = lambda s, d, made=made, cols=cols: made(s, d).withColumns({c: F.col(c).cast("string") for c in cols})
        if name in sql:
            sql[name] = f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in cols)}) FROM ({sql[name]})"
