"""The registered queries on the smallest tables: against SQL where there is some, else their contracts' columns and whole rows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_file

from ..test_queries import plain

SF = "/root/testdata/sf0.001"
OPS = {k: v for k, v in entry_file.queries().items() if k.startswith("op")}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in OPS) == list(range(1, 14)) and "pipeline" in entry_file.queries()


@pytest.mark.parametrize("name", sorted(n for n in OPS if n in entry_file.oracle_sql()))
def test_op_equals_sql(spark, duck, name):
    got = OPS[name](spark, SF)
    want = duck.sql(entry_file.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("op1_best_fit_packing", "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"),
        ("op2_token_counts", "doc_id bigint, n_tokens bigint, n_pretokens bigint"),
        ("op4_quality_classifier", "doc_id bigint, log_weight double, n_grams bigint, gumbel_key double, kept boolean"),
        ("op5_quality_rules", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
        ("op7_language_id", "doc_id bigint, lang string, posterior double, evidence double, kept boolean"),
        ("op12_token_alignment", "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"),
    ],
)
def test_op_has_its_columns_and_all_documents(spark, name, columns):
    got = OPS[name](spark, SF)
    assert ", ".join(f"{n} {t}" for n, t in got.dtypes) == columns
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_url_query_on_pages_with_links_equals_sql(spark, tmp_path):
    """A table whose hosts link to each other, at the level of the query."""
    import random

    rng = random.Random(2)
    hosts = [f"h{k}.{rng.choice(['example.com', 'example.net', 'org', 'io'])}" for k in range(40)]
    forms = ['<a href="https://{}/x">', "<link rel=canonical href=//{}>", '<meta property="og:url" content="http://{}/">', "<script>f('https://{}?a')</script>"]
    rows = [(k, f"https://{rng.choice(hosts)}/{rng.choice(['de', 'en', 'fr', 'x'])}/{k}", "".join(rng.choice(forms).format(rng.choice(hosts)) for _ in range(rng.randint(0, 4)))) for k in range(300)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, want = OPS["op10_url_filters"](spark, str(tmp_path)), con.sql(entry_file.oracle_sql()["op10_url_filters"])
    mine = plain([tuple(r) for r in got.collect()], got.columns)
    assert mine == plain(want.fetchall(), want.columns)
    judged = [r for r in got.collect() if r.rule is None]
    assert {r.verdict for r in judged} == {"allow", "block"}
