import os

from pyspark.sql import functions as F

from millrace.llm import common


def test_written_tables_and_cleanup(spark):
    df = common.materialize(spark.range(1000).select("id", (F.col("id") % 7).alias("m")), "numbers")
    assert df.count() == 1000 and df.columns == ["id", "m"]
    empty = common.materialize(spark.range(0), "none")
    assert empty.count() == 0 and empty.columns == ["id"]
    folder = common.shared_dir(spark).removeprefix("file:")
    assert any(n.startswith("numbers-") for n in os.listdir(folder))
    common.discard(df)
    assert not any(n.startswith("numbers-") for n in os.listdir(folder))
    common.cleanup(spark)
    assert not any(n.startswith("none-") for n in os.listdir(folder))


def test_release_keeps_what_is_read(spark):
    since = common.written()
    one = common.materialize(spark.range(5), "one")
    two = common.materialize(one.selectExpr("id + 1 AS id"), "two")
    folder = common.shared_dir(spark).removeprefix("file:")
    common.release(since, two)
    assert two.count() == 5 and not any(n.startswith("one-") for n in os.listdir(folder)) and common.written() == since + 1


def test_running_carries_a_state(spark):
    df = spark.createDataFrame([(list(range(n)),) for n in (0, 1, 3, 600)] + [(None,)], "a array<int>")
    sums = common.running(F.col("a"), F.lit(0), lambda s, x: s + x, lambda s, x: F.struct(s.alias("s"), x.alias("x")), "struct<s:int,x:int>", block=7)
    for r in df.select("a", sums.alias("o")).collect():
        assert [(o.s, o.x) for o in r.o or []] == [(sum(range(x)), x) for x in r.a or []]


def test_let_works_a_value_out_once(spark):
    row = spark.range(1).select(common.let(F.lit(3), lambda x: F.transform(F.sequence(F.lit(1), x), lambda i: i * x)).alias("y")).first()
    assert row.y == [3, 6, 9]


def test_words(spark):
    rows = spark.createDataFrame([(" a\tb\x0b c d \n",), ("",), (None,)], "t string")
    assert [r.w for r in rows.select(common.words(F.col("t")).alias("w")).collect()] == [["a", "b", "c d"], [], []]
