import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import adaptive as A
from millrace.plans import streams
from millrace.streaming import jobs as J


def test_scores(spark):
    given = [[0, 0, 2, 3, 1], [5, 0, 0, 0, 0], [0, 0, 0, 0, 5], [1, 1], [3, 3, 3]]
    rows = spark.createDataFrame([(i, [float(x) for x in g]) for i, g in enumerate(given)], "i int, c array<double>")
    got = [r.s for r in rows.select("i", A.score_of(F.col("c")).alias("s")).orderBy("i").collect()]
    assert got[3] is None and [round(got[k], 6) for k in (0, 1, 2, 4)] == [1.45, 0.5, 1.5, 3.0]


def bands(scores):
    """The rule, on a sorted list."""
    positive = sorted((s for s in scores if s > 0), reverse=True)
    n = len(positive)
    if n < 5:
        return None
    cap = sorted(positive)[max(0, n - max(1, math.ceil(n * 0.05)) - 1)]
    down = [min(s, cap) for s in positive]
    a, b, c = (max(1, math.ceil(n * x)) for x in (0.10, 0.15, 0.25))
    active = down[a - 1]
    moderate = min(down[min(a + b, n) - 1], active - 1e-9)
    return active, moderate, max(min(down[min(a + b + c, n) - 1], moderate - 1e-9), 1e-9)


@pytest.mark.parametrize("seed", range(6))
def test_thresholds(spark, seed):
    rng = random.Random(seed)
    scores = [0.2, 0.3, 0.4, 0.5, 0.7, 0.9, 1.2, 1.4, 1.8, 8.0] if seed == 0 else [round(rng.choice([0.0, rng.random() * 3]), 2) for _ in range(rng.randint(1, 120))]
    got = A.thresholds(spark.createDataFrame([(s,) for s in scores], "score double")).collect()
    want = bands(scores)
    assert (want is None and not got) or tuple(got[0][1:]) == want
    if seed == 0:
        assert tuple(round(x, 6) for x in want) == (1.8, 1.4, 0.7)


def test_fold_equals_plain_steps(spark):
    rng = random.Random(3)
    rows = [(k, d, 0, rng.choice([0, 0, 0, 1, 2, 15])) for k in range(20) for d in range(rng.randint(1, 30))]
    got = {r.user_id: (r.n_polls, r.score, r.interval_s) for r in A.intervals(spark.createDataFrame(rows, "user_id long, date int, slot int, new_jobs int")).collect()}
    for k in range(20):
        recent, interval, score, n = [], A.DEFAULT, None, 0
        for r in rows:
            if r[0] == k:
                recent, interval, score = J._step(recent, interval, r[3], 0.3, 0.8, 1.5)
                n += 1
        assert got[k] == (n, None if score is None else pytest.approx(score, abs=1e-6), interval)


def test_no_band_hangs_on_a_rounding():
    """Scores that are a band's edge but for their last binary digit are that edge, in the stream as in the fold."""
    for counts in itertools.product(range(4), repeat=5):
        recent, interval, score = J._step(list(map(float, counts[:4])), A.DEFAULT, counts[4], 0.3, 0.8, 1.5)
        (_, want, _, rounded), _ = A._polled((counts[:4], A.DEFAULT, 4, None), counts[4], 0.3, 0.8, 1.5)
        assert (interval, score) == (want, rounded), counts


def test_a_stream_of_many_files_is_one_batch(spark):
    """More files than a batch may have had: their order is no order of time."""
    rng = random.Random(5)
    rows = [(k, d, rng.choice([0, 0, 1, 4])) for k in range(2) for d in range(130)]
    polls = spark.createDataFrame(rows, "user_id long, at int, new_jobs int").repartition(130)
    out = J.run_once(J.adaptive_state(streams._stream(spark, polls, streams._places(spark, "many")[0])), *streams._places(spark, "many")[1:], "update")
    batch = A.intervals(spark.createDataFrame([(k, d, 0, j) for k, d, j in rows], "user_id long, date int, slot int, new_jobs int"))
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, batch.select(out.columns).collect()))


def test_stream_equals_batch_in_many_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(k, d, rng.choice([0, 0, 1, 4])) for k in range(9) for d in range(12)]
    for part in range(3):
        chunk = [r for r in rows if r[1] // 4 == part]
        spark.createDataFrame(chunk, "user_id long, at int, new_jobs int").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, at int, new_jobs int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = J.run_once(J.adaptive_state(stream), str(tmp_path / "out"), str(tmp_path / "state"), "update")
    last = {}
    for r in sorted(out.collect(), key=lambda r: r.n_polls):
        last[r.user_id] = (r.n_polls, r.score, r.interval_s)
    batch = A.intervals(spark.createDataFrame([(k, d, 0, j) for k, d, j in rows], "user_id long, date int, slot int, new_jobs int"))
    assert last == {r.user_id: (r.n_polls, r.score, r.interval_s) for r in batch.collect()}


def test_merge_into_keeps_the_last_row(spark, tmp_path):
    write = J.merge_into(str(tmp_path), ["k"], "at")
    batches = [[(1, 1, "a"), (2, 1, "b"), (1, 2, "c")], [(2, 5, "d")], [(3, 1, "e")]]
    for number, rows in enumerate(batches):
        write(spark.createDataFrame(rows, "k int, at int, v string"), number)
    write(spark.createDataFrame(batches[2], "k int, at int, v string"), 2)
    assert {(r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/batch=2").collect()} == {(1, "c"), (2, "d"), (3, "e")}
