"""Registrable domains: rules of each kind, and lists that are read."""

from millrace.operators import suffixes as P


def roots(spark, rules, *hosts):
    rows = spark.createDataFrame([(k, h, "x") for k, h in enumerate(hosts)], "n int, host string, root string").drop("root")
    got = P.with_root(rows, rows.host, spark.createDataFrame([(r,) for r in rules], "rule string"))
    assert got.columns == ["n", "host", "root"]
    return [r.root for r in got.orderBy("n").collect()]


def test_each_kind_of_rule(spark):
    want = {
        "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "uk": "uk", "x.ck": "x.ck", "a.x.ck": "a.x.ck", "b.a.x.ck": "a.x.ck", "www.ck": "www.ck", "a.www.ck": "www.ck", "ck": "ck",
        "city.kawasaki.jp": "city.kawasaki.jp", "a.city.kawasaki.jp": "city.kawasaki.jp", "c.b.a.kawasaki.jp": "b.a.kawasaki.jp", "kawasaki.jp": "kawasaki.jp", "JOBS.Stripe.com.": "stripe.com",
        "a.b.unknown": "b.unknown", "host": "host", "127.0.0.1": "127.0.0.1", "::1": "::1", "": None, None: None,
    }
    assert roots(spark, P.COMMON, *want) == list(want.values())


def test_no_rules_and_repeated_hosts(spark):
    assert roots(spark, [], "a.b.co.uk", "a.b.co.uk", None) == ["co.uk", "co.uk", None]


def test_many_rules_are_joined_alike(spark, monkeypatch):
    monkeypatch.setattr(P, "MOST_SENT", 3)
    assert roots(spark, P.COMMON, "a.b.co.uk", "a.www.ck", "a.b.ck") == ["b.co.uk", "www.ck", "a.b.ck"]


def test_a_list_is_read(spark, tmp_path):
    (tmp_path / "list").write_text("// remark\n\nCOM\n*.ck  rest of the line\n!www.ck\ncom\n")
    assert sorted(r.rule for r in P.read_rules(spark, str(tmp_path / "list")).collect()) == ["!www.ck", "*.ck", "com"]
