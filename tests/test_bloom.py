"""The Bloom filter: no key is lost, few others pass, and what is joined is counted."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import bloom as B


def test_no_key_is_lost_and_few_others_pass(spark):
    known = spark.range(20_000).select(F.col("id").alias("a"), (F.col("id") % 7).cast("string").alias("b"))
    count = B.blocks(20_000)
    bits = B.build(known, ["a", "b"], count)
    assert bits.count() == count == 8 and {r.n for r in bits.select(F.length("bits").alias("n")).collect()} == {4096}
    assert B.with_maybe(known, ["a", "b"], bits, count).where("NOT maybe").count() == 0
    others = spark.range(20_000, 60_000).select(F.col("id").alias("a"), F.lit("0").alias("b"))
    passed = B.with_maybe(others, ["a", "b"], bits, count).where("maybe").count()
    # of 40,000 some 1 in 100 pass, so that few reach the exact join
    assert 0 < passed < 1000


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_unseen_is_an_anti_join(spark, monkeypatch, most):
    monkeypatch.setattr(B, "MOST_BYTES", most)
    rows = spark.createDataFrame([(k % 50 if k % 9 else None, f"x{k}") for k in range(400)], "k int, v string")
    known = spark.createDataFrame([(k,) for k in [*range(0, 50, 2), None, 4, 4]], "k int")
    got = B.unseen(rows, known, "k")
    want = rows.join(known, "k", "left_anti")
    assert got.columns == ["k", "v"] and got.count() == want.count() > 0 and got.exceptAll(want.select("k", "v")).count() == 0


def test_empty_sides(spark):
    some, none = spark.range(3), spark.range(0)
    assert B.unseen(some, none, "id").count() == 3
    assert B.unseen(none, some, "id").count() == 0
    assert sorted(map(tuple, B.generations(some, spark.range(2, 4), "id").collect())) == [(0, "vanished"), (1, "vanished"), (3, "appeared")]
