"""Found addresses against stored contacts, and the labels of feeds."""

from pyspark.sql import functions as F

from millrace.operators import funnel, stats
from millrace.sources import feeds


def test_checked_buffer(spark):
    found = [
        ("db", "a@acme.com"), ("db", "b@other.com"), ("db", "A@ACME.com"), ("db", "known@acme.com"), ("db", "bare"),  # the stored domain counts before the expected one
        ("one", "a@right.com"), ("one", "b@right.com"), ("bad", "a@wrong.com"), ("bad", "b@wrong.com"),
        ("mixed", "a@x.com"), ("mixed", "b@y.com"), ("free", "a@x.com"), ("free", "b@y.com"), ("same", "a@right.com"), ("same", "b@right.org"), (None, "a@x.com"), ("one", None),
    ]
    stored = [(3, "db", "known@Acme.com", "active"), (2, "db", "gone@old.com", "inactive"), (1, "db", "no address", "active"), (4, "free", None, "active")]
    told = [("db", "other"), ("one", "right"), ("bad", "right"), ("mixed", "right"), ("same", "Right"), ("free", "")]
    out = funnel.checked_buffer(spark.createDataFrame(found, "company string, email string"), spark.createDataFrame(stored, "contact_id int, company string, email string, status string"), spark.createDataFrame(told, "company string, root string"))
    got = {(r.company, r.email): (r.reference, r.verdict, r.kept) for r in out.collect()}
    assert got == {
        ("db", "a@acme.com"): ("acme", "tiebreak", True), ("db", "b@other.com"): ("acme", "tiebreak", False), ("db", "bare"): ("acme", "tiebreak", False),
        ("one", "a@right.com"): ("right", "consistent", True), ("one", "b@right.com"): ("right", "consistent", True), ("bad", "a@wrong.com"): ("right", "conflict", False), ("bad", "b@wrong.com"): ("right", "conflict", False),
        ("mixed", "a@x.com"): ("right", "unmatched", False), ("mixed", "b@y.com"): ("right", "unmatched", False), ("free", "a@x.com"): (None, "trusted", True), ("free", "b@y.com"): (None, "trusted", True),
        ("same", "a@right.com"): ("right", "tiebreak", True), ("same", "b@right.org"): ("right", "tiebreak", True),
    }
    assert out.count() == len(got)
    assert funnel.checked_buffer(spark.createDataFrame([], "company string, email string"), spark.createDataFrame(stored, "contact_id int, company string, email string, status string"), spark.createDataFrame(told, "company string, root string")).count() == 0


def test_verified(spark):
    rows = spark.createDataFrame([("2024-01-02", "inactive"), ("2024-01-01", "active"), ("2023-12-31", "inactive"), (None, "inactive")], "verified_at string, status string").withColumn("verified_at", F.to_date("verified_at"))
    assert [tuple(r) for r in stats.verified(rows, "2024-01-01").collect()] == [(2, 1)]


def test_labels_of_feeds(spark):
    body = "<rss><job><id>1</id><title>Dev</title><mfield3>Additional LocationsRome</mfield3><mfield1>CountryItaly</mfield1></job><job><id>2</id><title>Dev</title><mfield3>cityOslo</mfield3><mfield1>Job CategoryNorth</mfield1></job></rss>"
    rows = spark.createDataFrame([("c", "https://x.org", body)], "company string, url string, body string")
    assert sorted((r.job_id, r.location) for r in feeds.feed(rows).collect()) == [("1", "Rome, Italy"), ("2", "Oslo, North")]
