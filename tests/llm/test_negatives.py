import math
import random

import numpy as np
import pytest

from millrace.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, scale=256):
    own = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, label, tuple(math.floor(float(np.float32(x)) * scale) for x in v))
        if row not in own:
            own.append(row)
    out = []
    for a, label, x in own:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, v)), i, k) for i, k, v in own if i != a and len(v) == len(x))
        for s, p, _ in [t for t in scored if t[1] is not None and t[2] == label][:5]:
            fits = [(t, i) for t, i, k in scored if k != label and 50 * -s <= 100 * -t <= 95 * -s][:3]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i) in enumerate(fits)]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in negatives.mine(df, **kw).collect())


def table(seed, n, d, kinds=4, spread=1.0):
    rng = random.Random(seed)
    return [(k, rng.randrange(kinds), [rng.gauss(0.3, spread) for _ in range(d)]) for k in range(n)]


def test_equals_brute_force_with_small_leaves_and_blocks(spark):
    rows = table(1, 400, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert len(want) > 30
    assert mined(df) == want
    assert mined(df, leaf=4, block=2) == want


def test_nulls_ties_repeats_lengths_and_clashing_columns(spark):
    rows = table(2, 120, 2) + [(120, None, [1.0, 2.0]), (121, 1, None), (122, 1, [None, 1.0]), (123, 2, [float("nan"), 1.0]), (124, 2, [float("inf"), 0.0]), (None, 1, [1.0, 1.0])]
    # one vector that a third of the rows share, rows that repeat, another length, no length
    rows += [(200 + k, k % 3, [1.0, 0.5]) for k in range(60)] + rows[:5] + [(300 + k, k % 2, [0.5, 0.4, 0.3 + k / 50]) for k in range(30)] + [(400, 1, []), (401, 1, []), (402, 2, [])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS tag", "2 AS rank", "3 AS dim", "4 AS score", "5 AS v")
    want = brute(rows)
    assert len(want) > 10
    assert mined(df, leaf=8) == want
    assert negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_sums_are_exact(spark):
    """Products that a double can't tell apart."""
    big = float(2**30)
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, 3.0]), (2, 1, [big, 2.0]), (3, 2, [big * 0.75, 5.0]), (4, 2, [big * 0.75, 5.00390625]), (5, 2, [big * 0.75, 4.0]), (6, 2, [big * 0.75, 4.99609375])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = negatives.mine(df, scale=1 << 20).orderBy("positive_id", "rank").collect()
    assert [r.negative_id for r in got if r.positive_id == 1] == [4, 3, 6] and [r.positive_id for r in got[::3]] == [1, 2]
    assert all(r.positive_score is None for r in got)


def test_leaves_hold_each_row_once_and_boxes_bound_it(spark):
    rows = table(3, 500, 6) + [(1000 + k, 1, [0.25] * 6) for k in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "CAST(label AS BIGINT) AS label", "CAST(embedding AS array<double>) AS v")
    ids = []
    for r in negatives.index(df, leaf=16).collect():
        own, v = np.frombuffer(r.ids, dtype=np.int64), np.frombuffer(r.vectors, dtype=np.float64).reshape(-1, 6)
        assert 1 <= len(own) <= 16 and list(own) == sorted(own)
        assert (np.frombuffer(r.low) == v.min(axis=0)).all() and (np.frombuffer(r.high) == v.max(axis=0)).all()
        ids += own.tolist()
    assert sorted(ids) == sorted(i for i, _, _ in rows)


def test_boxes_are_pruned():
    """On vectors of few coordinates most boxes are never opened; a search that opened all would."""
    rng = np.random.default_rng(4)
    x = np.floor(rng.normal(0, 100, (4000, 2)))
    tiles = negatives._tiles(x, np.arange(len(x)), 32)
    leaves = [(1, t, x[t]) for t in tiles]
    low, high = np.array([x[t].min(axis=0) for t in tiles]), np.array([x[t].max(axis=0) for t in tiles])
    who = np.arange(0, 4000, 100)
    search = negatives.Search(x[who], who, np.ones(len(who)), np.array([[(-np.inf, np.inf)]] * len(who)), 5, True)
    for k in range(0, len(leaves), 40):
        search.chunk(leaves[k : k + 40], low[k : k + 40], high[k : k + 40])
    assert search.opened < len(who) * len(leaves) / 4
    for a, row in zip(who, search.ids[:, 0], strict=True):
        s = x @ x[a]
        assert row.tolist() == sorted((j for j in range(4000) if j != a), key=lambda j: (-s[j], j))[:5]


@pytest.mark.parametrize("window", [(0, 100), (50, 95)])
def test_negative_scores_and_empty_windows(spark, window):
    rows = [(k, k % 2, [(-1.0) ** k * (k + 1) / 64]) for k in range(101)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA), window=window)
    assert all(window[0] * r.positive_score <= 100 * r.negative_score <= window[1] * r.positive_score for r in got.collect())
