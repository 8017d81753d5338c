"""Places, feeds, inference, folds, windows and retention against brute force and known cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import dedup, filings, fold, health, places, relevance, resolve, retention, state
from millrace.sources import feeds, infer, nested
from millrace.streaming import jobs as J


def test_places(spark):
    """Known cases, with all countries and a small gazetteer."""
    cases = {
        "San Francisco, CA": True, "Austin": True, "US-CA-Menlo Park": True, "Seattle (WA)": True, "Burlington Massachusetts": True, "USA Remote Worksite": True, "Remote": True, "": True, None: True,
        "IND.Chennai": False, "PUNE 05": False, "Delhi, IN, India": False, "Jordan, UT": True, "Amman, Jordan": False, "Dublin, IE": False, "London, GB": False, "Singapore, SG": False, "Remote - India": False,
        "New England": True, "Leeds, England": False, "Cardiff Wales": False, "Belfast, Northern Ireland": False, "Bangalore": False, "Cambridge": True, "Paris": False, "Tbilisi": False, "Georgia": True, "Harare, ZWE": False,
    }
    gazetteer = spark.createDataFrame([("Pune", "IN"), ("Cambridge", "GB"), ("Cambridge", "US"), ("Paris", "FR"), ("Tbilisi", "GE"), ("Austin", "us")], "name string, country string")
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(cases)] * 2, "i int, location string")
    known = places.countries(spark)
    assert len(known) > 200 and ("ind", "in", "india") in known and not any(c[2] == "georgia" for c in known)
    got = places.located(rows, gazetteer, known=known).collect()
    assert len(got) == 2 * len(cases) and {r.location: r.is_us for r in got} == cases
    short = {r.location: r.is_us for r in rows.select("location", relevance.is_us(F.col("location")).alias("is_us")).collect()}
    assert {k for k in cases if short[k] != cases[k]} <= {"Tbilisi", "Harare, ZWE"}


def test_fold_streams_by_key(spark):
    rows = [(k, i, (i * 7 + k) % 5) for k in range(6) for i in range(50)] + [(None, 1, 3)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k int, i int, x int").repartition(5)
    got = fold.fold(df, "k", ["i"], ["i", "x"], lambda: 0, lambda s, i, x: ((s * 3 + x) % 1009, [(i, s)] if i % 25 == 0 else []), lambda s: [(-1, s)], "i bigint, s bigint").collect()
    want = set()
    for k in {r[0] for r in rows}:
        s = 0
        for _, i, x in sorted(r for r in rows if r[0] == k):
            if i % 25 == 0:
                want.add((k, i, s))
            s = (s * 3 + x) % 1009
        want.add((k, -1, s))
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert fold.fold(df.limit(0), "k", ["i"], ["x"], lambda: 0, lambda s, x: (s, []), lambda s: [(s,)], "s bigint").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_windows_over_stretches(spark, seed):
    """Sliding counts and alerts without a near one before, where stretches of time meet."""
    rng = random.Random(seed)
    times = sorted(rng.choice([0, 959_999_999, 960_000_000, 1_919_999_999, rng.randrange(4_000_000_000)]) + rng.choice([0, 1, 59_999_999, 60_000_000]) for _ in range(120))
    rows = [(k, rng.choice("ab"), us, rng.randint(1, 9)) for k, us in enumerate(times)]
    df = spark.createDataFrame(rows, "event_id long, platform string, us long, ms long").withColumn("ts", F.timestamp_micros("us"))
    got = {r.event_id: (r.requests, r.weight) for r in health.sliding_count(df, "platform", 60).collect()}
    for k, p, us, _ in rows:
        near = [r for r in rows if r[1] == p and us - 60_000_000 < r[2] <= us]
        assert got[k] == (len(near), sum(r[3] for r in near))
    hour = 3_600_000_000
    alerts = [(k, rng.choice("ab"), rng.choice("xy"), rng.choice([0, hour - 1, hour, 2 * hour, rng.randrange(9 * hour)])) for k in range(40)]
    df = spark.createDataFrame(alerts, "event_id long, platform string, kind string, us long").withColumn("ts", F.timestamp_micros("us"))
    kept = {r.event_id for r in health.alert_dedup(df, hours=1).collect()}
    for k, p, kind, us in alerts:
        earlier = [r[3] for r in alerts if r[1:3] == (p, kind) and (r[3], r[0]) < (us, k)]
        assert (k in kept) == (not earlier or us - max(earlier) > hour)


def test_interarrival_of_one_event(spark):
    df = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("b", 3, 16), ("b", 4, 12)], "k string, event_id long, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert {(r.k, r.mean_gap_s, r.ttl_s) for r in health.interarrival(df, "k", 1.0, 5.0).collect()} == {("a", None, None), ("b", 3.0, 5.0)}


def test_blocks_are_dealt(spark):
    """A block of many right rows in parts: the same pairs as at once, and the best of them."""
    left = spark.createDataFrame([(k, f"alpha beta{k}", "alpha") for k in range(5)], "left_id long, name string, block string")
    right = spark.createDataFrame([(k, f"alpha beta{k % 7} gamma{k}", "alpha") for k in range(40)], "right_id long, name string, block string")
    pairs = resolve.in_blocks(left.select("left_id", "block"), right.select("right_id", "block"), "block", "right_id", most=3)
    assert pairs.count() == 200 and pairs.select("left_id", "right_id").distinct().count() == 200 and pairs.select("part").distinct().count() > 5
    got = resolve.candidates(left, right).orderBy("left_id", "rank").collect()
    for k in range(5):
        scores = sorted(((-round(resolve.token_set_ratio(f"alpha beta{k}", f"alpha beta{j % 7} gamma{j}"), 4), j) for j in range(40)))[:3]
        assert [(-r.score, r.right_id) for r in got if r.left_id == k] == scores


def test_retention_rules(spark):
    seen = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-01-01"), (None, "2024-01-01"), ("a", "2023-01-01")], "company string, last_polled string")
    none = spark.createDataFrame([], "company string")
    some = spark.createDataFrame([("a",)], "company string")
    left = lambda firms: sorted(map(str, retention.retained({"seen_job_ids": seen, "prospective_companies": firms}, "2024-02-01 00:00:00")["seen_job_ids"].collect()))
    assert left(some) == ["Row(company='a', last_polled='2024-01-01')", "Row(company=None, last_polled='2024-01-01')"]
    assert left(none) == ["Row(company=None, last_polled='2024-01-01')"]
    posts = spark.createDataFrame([(1, "new", "2024-01-01", "x"), (2, "new", "2024-01-30", "x"), (3, "applied", None, None), (4, "dismissed", "2023-01-01", "x"), (5, "filled", None, "x")], "id int, status string, first_seen string, description string").withColumn("stale_since", F.lit("2024-01-20"))
    diag = spark.createDataFrame([(1, 0, "2023-11-01", None), (2, 1, "2023-01-01", "2024-01-30 00:00:00"), (3, 1, "2023-01-01", None), (4, 0, "2024-01-30", None)], "id int, resolved int, created_at string, resolved_at string")
    out = retention.retained({"job_postings": posts, "custom_ats_diagnostics": diag, "other": none}, "2024-02-01 00:00:00")
    assert {(r.id, r.status, r.description) for r in out["job_postings"].collect()} == {(1, "expired", None), (2, "new", "x")}
    assert {(r.id, r.resolved) for r in out["custom_ats_diagnostics"].collect()} == {(1, 1), (2, 1), (4, 0)} and out["other"] is none


def test_merging_titles_and_hashes(spark):
    made = "fein string, titles array<struct<title:string,count:long>>"
    old = spark.createDataFrame([("f", [("a", 3), ("", 9), ("c", 1)]), ("g", None)], made)
    new = spark.createDataFrame([("f", [("a", 1), ("b", 4)]), ("h", [("z", 1)])], made)
    got = {r.fein: [(t.title, t["count"]) for t in r.titles] for r in filings.merge_titles(old, new, k=2).collect()}
    assert got == {"f": [("a", 4), ("b", 4)], "h": [("z", 1)]}
    rows = spark.createDataFrame([(1, "x", "y"), (2, "q", "y"), (3, None, "y"), (4, "z", None)], "job_id int, content_hash string, legacy_hash string")
    known = spark.createDataFrame([("y",), (None,)], "content_hash string")
    assert {(r.job_id, r.known) for r in dedup.hash_known(rows, known).collect()} == {(1, True), (2, True), (3, False), (4, False)}


def test_feeds_and_links(spark):
    bodies = [
        ("a", "https://x.org/f", "<jobs><job><jobid>1</jobid><title>Dev &amp; Ops</title><url>https://x/1</url><city>Rome</city><country>Italy</country><description>&lt;p&gt;Hi&lt;/p&gt;</description></job><job><jobid>1</jobid><title>again</title></job><job><title>no id</title></job></jobs>"),
        ("b", "https://career4.successfactors.com/career?company=acmeP", "<?xml version='1.0'?><Job-Listing><Job><ReqId>7</ReqId><JobTitle>Lead</JobTitle><Posted-Date>01/05/2024</Posted-Date><mfield1>Country/AreaIndia</mfield1><mfield3>state/provinceGoa</mfield3></Job></Job-Listing>"),
        ("c", "https://x.org/f", None),
    ]
    got = {r.company: r for r in feeds.feed(spark.createDataFrame(bodies, "company string, url string, body string")).collect()}
    assert set(got) == {"a", "b"} and got["a"].location == "Rome, Italy" and got["a"].description == "Hi"
    assert got["b"].job_url == "https://career4.successfactors.com/career?company=acmeP&career_job_req_id=7" and got["b"].location == "Goa, India" and str(got["b"].posted_at)[:10] == "2024-01-05"
    page = "<html><a href='/jobs/12345/dev'>Dev</a><a href='../jobs/12346/ops?x=1'>\n Ops </a><a href='/jobs/12345/dev'>twice</a><a href='/jobs/list'>no id</a></html>"
    found = feeds.links(spark.createDataFrame([("d", "https://x.org/en/all", page)], "company string, url string, body string"), "avature").collect()
    assert {(r.job_id, r.title, r.job_url) for r in found} == {("12345", "Dev", "https://x.org/jobs/12345/dev"), ("12346", "Ops", "https://x.org/jobs/12346/ops?x=1")}


def test_absolute_urls_are_those_of_the_standard_library(spark):
    from urllib.parse import urljoin

    bases = ["https://x.org", "https://x.org/", "https://x.org/a/b", "http://x.org/a/b/?q#f", "https://x.org:8080/a/b/c?d=1"]
    links = ["g", "./g", "g/", "/g", "?y", "#s", "g?y#s", "../g", "../../g", ".", "./", "..", "../", "g/../h", "g/./h", "//h.org/i", "a/b/../../c"]
    rows = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, x string")
    for r in rows.select("*", T.absolute_url(F.col("x"), F.col("b")).alias("u")).collect():
        assert r.u == urljoin(r.b, r.x), (r.b, r.x)


def _one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items())).select(column.alias("out")).first().out


def test_totals(spark):
    total = lambda data: _one(spark, infer.total_at(F.col("r")), r=data if isinstance(data, str) else json.dumps(data))
    assert total({"a": {"b": {"totalResults": 5}}, "count": 3}) == "count"
    assert total({"a": {"b": {"total-Results": 5}}}) == "a.b.total-Results"
    assert total({"a": {"b": {"c": {"d": {"total": 5}}}}}) is None and total([1]) is None and total("{bad") is None
    assert total({"total": {"low": 4, "high": 0}}) == "total" and total({"total": True}) is None and total({"total": "5"}) is None and total({"total": -1}) is None
    assert total({"rows": [{"count": 5}]}) is None


def test_pagination(spark):
    def plan(params, body, response, size=7):
        text = lambda x: x if isinstance(x, str) or x is None else json.dumps(x)
        return _one(spark, infer.pagination(F.col("p"), F.col("b"), F.col("r"), F.col("n")), p=text(params) or "", b=text(body) or "", r=text(response) or "", n=size).asDict()

    none = dict.fromkeys(("type", "param", "location", "page_size", "page_size_param", "total_field", "cursor_field"))
    assert plan({}, {"from": 0, "size": 10}, {"hits": 9}) == none | {"type": "offset", "param": "from", "location": "body", "page_size": 100, "page_size_param": "size", "total_field": "hits"}
    assert plan({"pg": 1}, "not json", None)["type"] == "page" and plan({}, "", {"next": ""}) == none | {"type": "none", "page_size": 7}
    # an offset before a page number, whatever else there is; sizes that are no numbers
    assert plan({"page": 1, "limit": "all"}, {"offset": 5}, {"next": "x"}) == none | {"type": "offset", "param": "offset", "location": "body", "page_size": 7, "page_size_param": "limit"}
    assert plan({"page": 1, "limit": "250"}, "", [])["page_size"] == 250 and plan({"page": 1, "limit": None}, "", [])["page_size"] == 7
    # a body with variables, and a cursor's parameter
    assert plan({}, {"query": "q", "variables": {"offset": 0, "limit": 20}}, {}) == none | {"type": "offset", "param": "offset", "location": "variables", "page_size": 100, "page_size_param": "limit"}
    assert plan({"after": ""}, "", {"nextCursor": "abc", "next": "u"}) == none | {"type": "cursor", "param": "after", "location": "url", "page_size": 7, "cursor_field": "nextCursor"}
    assert plan("{bad", "[1]", {"cursor": "z"}) == none | {"type": "cursor", "param": "cursor", "page_size": 7, "cursor_field": "cursor"}


def test_records_of_nested_responses(spark):
    shapes = {
        "root": [{"a": 1}, {"a": 2}, 3],
        "larger": {"small": [{"a": 1}], "x": {"y": [{"b": k} for k in range(3)]}},
        "inside": {"rows": [{"tags": [{"t": k} for k in range(5)]}, {"tags": []}]},
        "shorter": {"bb": [{"a": 1}], "c": [{"a": 2}], "d": [{"a": 3}]},
        "half": {"edges": [{"node": {"a": 1}}, {"other": 1}]},
        "deep": {"1": {"2": {"3": {"4": {"5": {"6": [{"a": 1}]}}}}}},
        "too deep": {"1": {"2": {"3": {"4": {"5": {"6": {"7": [{"a": 1}]}}}}}}},
        "none": {"a": [1, [2]], "b": "x"},
    }
    rows = [(k, json.dumps(v)) for k, v in shapes.items()] + [("bad", "{"), ("null", None), ("too nested", "[" * 3000 + "]" * 3000)]
    found: dict = {}
    for r in infer.records(spark.createDataFrame(rows, "company string, body string")).orderBy("place").collect():
        found.setdefault((r.company, r.path), []).append(json.loads(r.record))
    assert found == {
        ("root", ""): [{"a": 1}, {"a": 2}], ("larger", "x.y"): [{"b": 0}, {"b": 1}, {"b": 2}], ("inside", "rows[0].tags"): [{"t": k} for k in range(5)], ("shorter", "c"): [{"a": 2}],
        ("half", "edges"): shapes["half"]["edges"], ("deep", "1.2.3.4.5.6"): [{"a": 1}],
    }


def test_find_and_at(spark):
    one = lambda raw, c: _one(spark, c, b=raw)
    assert one('{"a": {"x": null, "b": [{"x": 5}]}, "c": {"d": {"x": 6}}}', nested.find(F.col("b"), "x")) == "6"
    assert one('{"a": [{"b": {"x": [1, 2]}}]}', nested.find(F.col("b"), "x")) == "[1,2]" and one('{"a": 1}', nested.find(F.col("b"), "x")) is None
    assert one('[{"b": {"x": "y"}}]', nested.at(F.col("b"), "[0].b.x")) == '"y"' and one("{bad", nested.at(F.col("b"), "a")) is None and one('{"a": null}', nested.at(F.col("b"), "a")) is None


def test_pages_that_come_again(spark):
    opening = "https://x.org/" + "a" * 80
    rows = [("c", p, json.dumps({"none": "", "id": f"{i}", "x": {"a": 1}})) for p, i in ((1, 5), (1, 6), (2, 6), (2, 5), (3, 7), (4, f"{opening}1"), (5, f"{opening}2"))]
    found = spark.createDataFrame(rows, "company string, page int, record string")
    got = {r.page: r.prints for r in infer.record_prints(found).collect()}
    assert got[1] == got[2] and len(got[1]) == 2 and got[3] != got[4] != got[5]


def test_canaries_end_an_outage(spark):
    rates = [0.5, 0.5, 0.5, 0.5, 0.0, 0.0, 0.0]
    canaries = [(0, 0), (0, 0), (0, 0), (0, 0), (0, 0), (2, 1), (2, 0)]
    rows = spark.createDataFrame([("p", k, r, *c) for k, (r, c) in enumerate(zip(rates, canaries, strict=True))], "platform string, bucket long, error_rate double, canaries long, failed long")
    assert [r.event for r in state.probed_outages(rows, 0.1, 3).orderBy("bucket").collect()] == ["deprioritize", "deprioritize", "deprioritize", "outage_start", "probe", "canary_failed", "outage_end"]


def test_stream_takes_its_days_thresholds(spark, tmp_path):
    polls = spark.createDataFrame([(1, "2024-01-01 01:00:00", 1.0), (2, "2024-01-02 01:00:00", 1.0), (3, "2024-01-03 01:00:00", 0.0)], "user_id long, ts string, score double").withColumn("ts", F.to_timestamp("ts"))
    polls.coalesce(1).write.parquet(str(tmp_path / "in"))
    days = spark.createDataFrame([("2024-01-01", 0.1, 0.2, 0.5)], "day string, low double, moderate double, active double").withColumn("day", F.to_date("day"))
    stream = spark.readStream.schema(polls.schema).parquet(str(tmp_path / "in"))
    got = J.run_once(J.recalibrated(stream, days), str(tmp_path / "out"), str(tmp_path / "check"))
    assert {r.user_id: r.interval_s for r in got.collect()} == {1: 3 * 3600, 2: 4 * 3600, 3: 12 * 3600}
    assert J.throttled(spark, "/root/testdata/sf0.001", 9000) is None and J.throttled(spark, "/root/testdata/sf0.001", 2500).isStreaming


def test_merge_parts_rewrites_what_a_batch_touches(spark, tmp_path):
    schema = "k int, at int, v string"
    write = J.merge_parts(str(tmp_path / "t"), ["k"], "at", parts=8)
    assert J.current(spark, str(tmp_path / "t"), schema).count() == 0
    batches = [[(k, 1, "a") for k in range(40)], [(3, 2, "b"), (3, 1, "old")], [(100, 1, "c"), (3, 3, "d")]]
    for number, rows in enumerate(batches):
        write(spark.createDataFrame(rows, schema), number)
    write(spark.createDataFrame(batches[2], schema), 2)
    got = {r.k: (r.at, r.v) for r in J.current(spark, str(tmp_path / "t"), schema).collect()}
    assert got == {k: (1, "a") for k in range(40)} | {3: (3, "d"), 100: (1, "c")}
    assert len(list((tmp_path / "t" / "batch=1").glob("part=*"))) == 1
