"""Stateful streams in many batches, stopped and run again, against folds in plain Python."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.plans import streams
from millrace.streaming import jobs as J
from millrace.streaming import state as S

START = datetime(2024, 1, 1)


def batches(spark, folder, rows, schema, size):
    """Rows, a file for each run of `size`, as a stream of a file a batch."""
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def folded(polls, warming=S.WARMING_POLLS):
    """A key's polls one after the other: what is said of each, and of each gap."""
    weights, out = (0.10, 0.15, 0.20, 0.25, 0.30), []
    interval, recent, left, errors, score = 43200, [], warming, 0, None
    for n, (at, ok, jobs) in enumerate(polls, 1):
        if n > 1 and at > due:
            out.append((due, "overdue", n - 1, score, interval, left, errors))
        if ok:
            recent = [*recent, min(jobs or 0, 10)][-5:]
            score = round(sum(c * w for c, w in zip(recent, weights[-len(recent) :])) / sum(weights[-len(recent) :]), 6) if len(recent) >= 3 else None
            band = 43200 if not score else 32400 if score < 0.3 else 21600 if score < 0.8 else 14400 if score < 1.5 else 10800
            interval = min(band if band < interval else int(0.3 * band + 0.7 * interval), 21600 if score and score >= 0.8 else 43200)
            errors = 0
            if left:
                interval, left = 7200, left - 1
        else:
            errors, score = errors + 1, 0.0
        out.append((at, "poll", n, score, interval, left, errors))
        due = at + timedelta(seconds=interval + 3600)
    return [*out, (due, "overdue", len(polls), score, interval, left, errors)]


@pytest.mark.parametrize("size", [7, 1000])
def test_polls_equal_a_fold_in_many_batches_and_in_one(spark, tmp_path, size):
    rng = random.Random(5)
    rows = sorted((START + timedelta(minutes=rng.randint(0, 20_000)), k, rng.random() < 0.8, rng.choice([0, 0, 1, 3, None, 20])) for k in range(4) for _ in range(15))
    rows = [(at, k, n, ok, jobs) for n, (at, k, ok, jobs) in enumerate(rows)]
    closing = [(START + timedelta(days=400 + n), -1, 1000 + n, True, 0) for n in range(1)]
    schema = "ts timestamp, user_id long, poll long, ok boolean, new_jobs int"
    stream = batches(spark, str(tmp_path / "in"), rows, schema, size)
    spark.createDataFrame(closing, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = J.run_once(S.poll_states(stream, keep=10**8), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r.user_id, r.at, r.kind, r.n_polls, r.score, r.interval_s, r.warming, r.errors) for r in out.where("user_id >= 0").collect())
    want = [(k, *said) for k in range(4) for said in folded([(at, ok, jobs) for at, u, _, ok, jobs in rows if u == k])]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[2] for r in got} == {"poll", "overdue"} and any(r[6] == 0 for r in got) and any(r[7] for r in got)


def test_an_idle_key_is_forgotten(spark, tmp_path):
    """After the keep time a key warms again."""
    days = [0, 1, 200, 201, 600]
    rows = [(START + timedelta(days=d), 1 if d < 600 else 2, n, True, 5) for n, d in enumerate(days)]
    ticks = [(START + timedelta(days=d), 9, 100 + d, True, 0) for d in (60, 120, 121)]
    schema = "ts timestamp, user_id long, poll long, ok boolean, new_jobs int"
    stream = batches(spark, str(tmp_path / "in"), sorted([*rows, *ticks]), schema, 1)
    out = J.run_once(S.poll_states(stream), str(tmp_path / "out"), str(tmp_path / "state"))
    polls = [(r.n_polls, r.warming) for r in out.where("user_id = 1 and kind = 'poll'").orderBy("at").collect()]
    assert polls == [(1, 2), (2, 1), (1, 2), (2, 1)]


def test_keys_that_share_a_part_stay_apart(spark, tmp_path):
    """Many keys, a null one among them, in three parts: a fold each, one state and one timer a part however many keys there are."""
    rng = random.Random(8)
    keys = [*range(120), None, 2**60 + 1]
    rows = sorted(((START + timedelta(minutes=rng.randint(0, 9000)), k, n, rng.random() < 0.8, rng.choice([0, 1, None])) for n, k in enumerate(keys * 5)), key=lambda r: (r[0], r[2]))
    schema = "ts timestamp, user_id long, poll long, ok boolean, new_jobs int"
    stream = batches(spark, str(tmp_path / "in"), [*rows, (START + timedelta(days=400), -1, 9999, True, 0)], schema, 250)
    out = J.run_once(S.poll_states(stream, parts=3, keep=10**8), str(tmp_path / "out"), str(tmp_path / "state"))
    got = [(r.user_id, r.at, r.kind, r.n_polls, r.score, r.interval_s, r.warming, r.errors) for r in out.where("user_id is null or user_id >= 0").collect()]
    want = [(k, *said) for k in keys for said in folded([(at, ok, jobs) for at, u, _, ok, jobs in rows if u == k])]
    assert sorted(map(str, got)) == sorted(map(str, want))
    held = spark.read.format("statestore").option("stateVarName", "held").load(str(tmp_path / "state"))
    found = held.selectExpr("size(value.user_id) AS n").collect()
    assert len(found) <= 3 and sum(r.n for r in found) == len(keys) + 1


def test_an_idle_key_is_forgotten_within_a_batch_too(spark, tmp_path):
    rows = [(START + timedelta(days=d), 1, n, True, 5) for n, d in enumerate([0, 1, 200, 201])]
    schema = "ts timestamp, user_id long, poll long, ok boolean, new_jobs int"
    out = J.run_once(S.poll_states(batches(spark, str(tmp_path / "in"), rows, schema, 9)), str(tmp_path / "out"), str(tmp_path / "state"))
    polls = [(r.n_polls, r.warming) for r in out.where("kind = 'poll'").orderBy("at").collect()]
    assert polls == [(1, 2), (2, 1), (1, 2), (2, 1)]


def test_alerts_resolve_and_return(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted((START + timedelta(minutes=rng.randint(0, 3000)), f"s{rng.randint(0, 3)}") for _ in range(80))
    want = []
    for name in sorted({n for _, n in rows}):
        last, seen, first = None, 0, True
        for at in (t for t, n in rows if n == name):
            if last is not None and at > last + timedelta(hours=1):
                want.append((name, last + timedelta(hours=1), "resolved", seen))
                last = None
            if last is None:
                want.append((name, at, "alert" if first else "realert", 1))
                first, seen = False, 0
            last, seen = at, seen + 1
        want.append((name, last + timedelta(hours=1), "resolved", seen))
    for size in (9, 500):
        stream = batches(spark, str(tmp_path / f"in{size}"), [*rows, (START + timedelta(days=90), "closing")], "ts timestamp, signature string", size)
        spark.createDataFrame([(START + timedelta(days=99), "closing")], "ts timestamp, signature string").coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{size}"))
        out = J.run_once(S.alert_sweep(stream), str(tmp_path / f"out{size}"), str(tmp_path / f"state{size}"))
        assert sorted(tuple(r) for r in out.where("signature <> 'closing'").collect()) == sorted(want)


def test_unacknowledged_deliveries_come_back(spark, tmp_path):
    assert [S.idle_bound(x) for x in (None, 10, 150, 900)] == [300, 300, 450, 600]
    t = lambda s: START + timedelta(seconds=s)
    given = [(1, 1, t(0)), (2, 1, t(0)), (2, 2, t(400)), (3, 5, t(10)), (4, 1, t(20)), (-1, 0, t(10**6)), (-1, 0, t(10**6 + 1))]
    acked = [(1, 1, t(300)), (2, 1, t(301)), (2, 2, t(450)), (4, 2, t(30)), (-1, 0, t(10**6)), (-1, 0, t(10**6 + 1))]
    schema = "message long, attempt int, ts timestamp"
    d, a = (batches(spark, str(tmp_path / n), rows, schema, 3) for n, rows in (("d", given), ("a", acked)))
    out = J.run_once(S.reclaimed(d, a, 300), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.message, r.attempt, r.outcome) for r in out.where("message > 0").collect()) == [(1, 1, "done"), (2, 1, "reclaimed"), (2, 2, "done"), (3, 5, "dead"), (4, 1, "reclaimed")]


def test_a_stopped_stream_goes_on_where_it_was(spark, tmp_path):
    """Stopped before a batch has been committed, whose rows its sink has already: the same rows as without a stop, and state as it was."""
    rng = random.Random(7)
    rows = sorted((START + timedelta(minutes=rng.randint(0, 4000)), f"p{rng.randint(0, 2)}", rng.choice(["ok", "429"])) for _ in range(300))
    rows.append((START + timedelta(days=50), "closing", "ok"))
    schema = "ts timestamp, platform string, class string"
    stream = lambda: J.error_windows(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")))
    batches(spark, str(tmp_path / "in"), rows, schema, 60)
    where = lambda name: (str(tmp_path / f"out-{name}"), str(tmp_path / f"state-{name}"))
    whole = J.run_once(stream(), *where("whole")).collect()
    J.run_once(stream(), *where("stopped"), batches=2)
    offsets = len(list((tmp_path / "state-stopped" / "offsets").glob("[0-9]*")))
    commits = len(list((tmp_path / "state-stopped" / "commits").glob("[0-9]*")))
    assert (offsets, commits) == (3, 2)
    held = spark.read.format("statestore").load(where("stopped")[1])
    open_ = held.select(F.col("key.platform").alias("platform"), F.col("value.*")).count()
    assert open_ > 0
    resumed = J.run_once(stream(), *where("stopped")).collect()
    assert sorted(map(tuple, resumed)) == sorted(map(tuple, whole)) and len(whole) > 100


def test_sums_count_a_batch_once(spark, tmp_path):
    path, keys, sums = str(tmp_path / "sums"), ["k"], ["n", "m"]
    write = J.add_into(path, keys, sums, every=2)
    parts = [[(1, 1, 5), (2, 1, 0)], [(1, 1, 1)], [(3, 1, 7), (1, 2, 0)], [(2, 5, 5)], [(1, 1, 1)]]
    schema = "k int, n long, m long"
    want: dict = {}
    for number, rows in enumerate(parts):
        for _ in range(2 if number in (1, 2, 4) else 1):
            write(spark.createDataFrame(rows, schema), number)
        for k, n, m in rows:
            want[k] = (want.get(k, (0, 0))[0] + n, want.get(k, (0, 0))[1] + m)
        got = {r.k: (r.n, r.m) for r in J.total(spark, path, schema, keys, sums).collect()}
        assert got == want
    # what a lost driver left half written does not count
    spark.createDataFrame(parts[0], schema).write.parquet(f"{path}/snapshot=5")
    (tmp_path / "sums" / "snapshot=5" / "_SUCCESS").unlink()
    assert {r.k: (r.n, r.m) for r in J.total(spark, path, schema, keys, sums).collect()} == want
    assert J._numbers(spark, f"{path}/snapshot") == [1, 3]


def test_the_order_of_turns_is_not_that_of_file_times(spark, tmp_path, monkeypatch):
    """Files whose times run backwards, as clocks of several machines may: each stretch of days lets each key through once."""
    rows = [(n, datetime(2024, 1, day, 5, n % 60), n % 3, "view", 1.0, "{}") for n, day in enumerate((1, 1, 5, 12, 12, 13, 25, 26, 27, 31, 31, 31))]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    drain, seen = J.run_once, {}

    def backwards(stream, *args, **more):
        for f in sorted((tmp_path / "in").glob("*.parquet"), key=os.path.getmtime):
            seen.setdefault(f.name, 1_700_000_000 - len(seen))
            os.utime(f, (seen[f.name], seen[f.name]))
        return drain(stream, *args, **more)

    monkeypatch.setattr(streams, "_places", lambda s, name: tuple(str(tmp_path / x) for x in ("in", "out", "state")))
    monkeypatch.setattr(J, "run_once", backwards)
    got = streams.QUERIES["s_dedup_day"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(k, "ok", 4) for k in range(3)]


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _kept(spark, folder, rows):
    spark.createDataFrame(rows, EVENTS).write.mode("overwrite").parquet(f"{folder}/events.parquet")
    return sorted((tuple(r) for r in streams.QUERIES["s_dedup_day"](spark, str(folder)).collect()), key=str)


def test_rows_at_midnight_of_the_first_day_are_not_late(spark, tmp_path):
    """A key's only row of ten days may be within the first second of its day."""
    rows = [(n, at, n, "view", 1.0, "{}") for n, at in enumerate((datetime(2024, 1, 1), datetime(2024, 1, 9, 0, 0, 0, 999_999), datetime(2024, 1, 2, 0, 0, 1), datetime(2024, 1, 11), datetime(2024, 1, 31)))]
    assert _kept(spark, tmp_path, rows) == [(n, "ok", 1) for n in range(5)]


def test_dedup_of_keys_below_zero_and_of_nulls(spark, tmp_path):
    """Users that are null or have any number are keys; rows without a time are of no day, but their key is given; without rows there is no key."""
    at = datetime(2024, 1, 2, 3)
    rows = [(0, at, None, "view", 1.0, "{}"), (4, at, None, "view", 1.0, "{}"), (1, at, -1, "view", 1.0, "{}"), (2, at, -2, "error", 1.0, "{}"), (3, None, 7, "view", 1.0, "{}"), (5, None, -1, "view", 1.0, "{}")]
    assert _kept(spark, tmp_path, rows) == [(-1, "ok", 1), (-2, "timeout", 1), (7, "ok", 0), (None, "ok", 1)]
    assert _kept(spark, tmp_path, [(3, None, 7, "view", 1.0, "{}")]) == [(7, "ok", 0)]
    assert _kept(spark, tmp_path, []) == []
