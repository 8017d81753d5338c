import json
import re

from pyspark.sql import functions as F

from millrace.operators import filings as L
from millrace.sources import adapters, files, infer


def test_sniff_and_read(spark, tmp_path):
    assert files.sniff(b"\xff\xfe" + "a\tb\nc".encode("utf-16-le")) == ("UTF-16LE", "\t")
    assert files.sniff(b"\xef\xbb\xbfa,b\n") == ("UTF-8", ",")
    path = tmp_path / "lca.tsv"
    path.write_bytes("Visa Class\tEmployer Fein\tCase Status\tTotal Worker Positions\tSoc Code\tJob Title\tDecision Date\tEmployer State\nH-1B\t12-1\tCertified\t1,200\t15\tDev\t1/5/2024\tCA\nH-1B\t\tDenied\t1\t15\tDev\t1/5/2024\tCA\nE-3\t12-2\tDenied\t1\t15\tDev\t1/5/2024\tCA\n".encode())
    got = files.load_filings(files.read_delimited(spark, str(path), ["VISA_CLASS"])).collect()
    assert [(r.fein, r.positions, r.year) for r in got] == [("12-1", 1200, 2024)]


def test_adapters(spark):
    bodies = {
        "greenhouse": {"jobs": [{"id": 7, "title": "Dev", "absolute_url": "https://x/7", "location": {"name": "Austin"}, "content": "&lt;p&gt;Hi&lt;/p&gt;", "first_published": "2024-01-05"}]},
        "lever": [{"id": "a", "text": "Dev", "hostedUrl": "https://x/a", "categories": {"allLocations": ["Rome"]}, "createdAt": 1704412800000}],
        "workday": {"jobPostings": [{"title": "Dev", "externalPath": "/j/1", "bulletFields": ["R1"], "locationsText": "NY", "postedOn": "Posted 3 Days Ago"}]},
        "smartrecruiters": {"content": [{"id": "s", "name": "Dev", "location": {"remote": True, "city": "X"}, "releasedDate": "2024-01-05T00:00:00.000Z"}]},
        "jibe": {"jobs": [{"data": {"title": "Dev", "apply_url": "https://x/login", "req_id": "9", "city": "A", "country": "B"}}]},
        "eightfold": {"positions": [{"name": "Dev", "positionUrl": "/p", "id": 3, "standardizedLocations": ["Oslo, NO"], "postedTs": 1704412800}]},
    }
    got = {}
    for ats, body in bodies.items():
        r = adapters.adapt(spark.createDataFrame([("c", json.dumps(body)), ("c", "not json"), ("c", None)], "company string, body string"), ats, "2024-01-31 00:00:00").collect()
        assert len(r) == 1 and r[0].title == "Dev" and r[0].ats == ats
        got[ats] = r[0]
    assert got["greenhouse"].description == "Hi" and got["greenhouse"].job_id == "7" and str(got["greenhouse"].posted_at)[:10] == "2024-01-05"
    assert got["lever"].location == "Rome" and str(got["workday"].posted_at)[:10] == "2024-01-28"
    assert got["smartrecruiters"].location == "Remote" and got["jibe"].job_url == "https://x/job" and got["jibe"].location == "A, B"
    assert got["eightfold"].country_code == "NO"
    assert adapters.registry(spark).count() == len(adapters.SOURCES)


def test_infer(spark):
    body = json.dumps({"meta": [1, 2], "data": {"edges": [{"node": {"jobId": f"R{100 + k}", "name": "Dev", "link": f"https://x/{k}", "city": "Rome"}} for k in range(4)]}})
    df = spark.createDataFrame([("c", body), ("d", "oops"), ("e", None)], "company string, body string")
    found = infer.records(df)
    assert {(r.company, r.path) for r in found.select("company", "path").distinct().collect()} == {("c", "data.edges[*].node")}
    roles = {r.role: r.field for r in infer.field_roles(found).collect()}
    assert roles == {"id": "jobId", "title": "name", "url": "link", "location": "city"}
    assert infer.apply_roles(found, infer.field_roles(found)).where("id = 'R102'").count() == 1
    raw = ['{"a":1}', 'cb({"a":1});', "<html><script id='__NEXT_DATA__'>{}</script>", "<?xml version='1.0'?><rss/>", "<p>x</p>", None]
    kinds = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", infer.format_of(F.col("r")).alias("k")).orderBy("i").collect()
    assert [r.k for r in kinds] == ["json", "jsonp", "next_data", "xml", "html", "html"]


def test_merge_in_batches_equals_one(spark):
    rows = [(f"f{i % 3}", ["Certified", "Denied", "Withdrawn"][i % 3 if i % 2 else 0], i, "s", "t", 2020, "CA", i, i, i, i, float(i)) for i in range(60)]
    schema = "fein string, status string, positions long, soc string, title string, year int, employer_state string, decided int, l_orderkey int, l_linenumber int, l_partkey int, l_extendedprice double"
    df = spark.createDataFrame(rows, schema)
    state = L.employers(df.where("l_orderkey < 20")).withColumn("batches", F.array(F.lit("a")))
    for name, part in (("b", "l_orderkey between 20 and 39"), ("b", "l_orderkey between 20 and 39"), ("c", "l_orderkey >= 40")):
        state = L.merge(state, L.employers(df.where(part)), name)
    one = {r.fein: r[1:8] for r in L.employers(df).collect()}
    assert {r.fein: r[1:8] for r in state.collect()} == one


def test_locales_and_archive(spark, tmp_path):
    urls = spark.createDataFrame([("1", "fr", "u2"), ("1", "en-US", "u3"), ("2", None, "u1"), ("2", "xx", "u0")], "job_id string, locale string, url string")
    assert {(r.job_id, r.url) for r in adapters.best_locale(urls).collect()} == {("1", "u3"), ("2", "u1")}
    files.append_archive(urls, str(tmp_path / "a"))
    files.append_archive(urls, str(tmp_path / "a"))
    assert spark.read.csv(str(tmp_path / "a"), header=True).count() == 8
    assert files.copy_shared_columns(urls.drop("locale"), urls).where("locale is null").count() == 4


def test_roles_of_values_are_worked_out_once(spark):
    """No filter looks at a value again."""
    df = spark.createDataFrame([("a", '{"x": {"jobs": [{"id": "R101", "url": "/careers/job/10000001"}, {"id": "R102", "url": "/careers/job/10000002"}, 5]}}'), ("b", "no"), ("c", "[]"), ("d", None)], "company string, body string")
    found = infer.records(df)
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    again = lambda x: [line for line in plan(x).splitlines() if re.search(r"Filter.*(size\(|RLIKE|CASE WHEN)", line)]
    assert [(r.company, r.place) for r in found.orderBy("place").collect()] == [("a", 0), ("a", 1)]
    kept = spark.createDataFrame(found.collect(), found.schema)
    roles = infer.field_roles(kept)
    assert not again(roles)
    assert {(r.role, r.field, r.votes) for r in roles.collect()} == {("id", "id", 2), ("url", "url", 2)}
