import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators import relevance as R
from millrace.operators import resolve as E


def one(spark, column, *values, schema="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {schema}")
    return [r.y for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_entity_names(spark):
    given = ["FIDELITY TECHNOLOGY GROUP LLC D B A FIDELITY INVESTMENTS", "ARTECH LLC DBA ARTECH INFORMATION SYSTEMS LLC", "THE BOSTON CONSULTING GROUP", "TATA CONSULTANCY SVCS LTD", "ERNST AND YOUNG U S LLP", "Moody's & Sons, Inc.", None, " "]
    want = ["FIDELITY TECHNOLOGY GROUP LLC", "ARTECH LLC", "BOSTON CONSULTING GROUP", "TATA CONSULTANCY SERVICES LIMITED", "ERNST YOUNG US LLP", "MOODYS SONS INC", "", ""]
    assert one(spark, T.entity_name, *given) == want


def test_normalize_and_ngrams(spark):
    assert one(spark, T.normalize, "  Señor  DÉJÀ\tVu ", None) == ["senor deja vu", None]
    assert one(spark, lambda c: T.ngrams(F.split(c, " ")), "a b c", "a") == [["a", "b", "c", "a b", "b c", "a b c"], ["a"]]


LOCATIONS = [
    ("", True), (None, True), ("New York, NY", True), ("IND.Chennai", False), ("US-CA-Menlo Park", True), ("Seattle (WA)", True), ("PUNE 05", False), ("Burlington Massachusetts", True), ("USA Remote Worksite", True),
    ("Menlo Park, CA; New York, NY", True), ("Jordan, UT", True), ("Delhi, IN, India", False), ("Dublin, IE", False), ("Remote - India", False), ("London, England", False), ("New England", True), ("Remote", True), ("Toronto, CAN", False), ("u.s.a.", True),
]


def test_locations(spark):
    assert one(spark, R.is_us, *[x for x, _ in LOCATIONS]) == [y for _, y in LOCATIONS]


def test_dates(spark):
    got = one(spark, lambda c: F.date_format(T.parse_date(c), "yyyy-MM-dd HH:mm"), "2026-01-05", "01/05/2026", "25/01/2026", "January 5, 2026", "Jan 5 2026", "5 January 2026", "1767571200", "1767571200000", "2026-01-05T10:30:00Z", "soon", "", None)
    assert got == ["2026-01-05 00:00", "2026-01-05 00:00", "2026-01-25 00:00", *["2026-01-05 00:00"] * 5, "2026-01-05 10:30", None, None, None]


def test_url_ids(spark):
    given = ["https://x.com/en/jobs/3152869/title", "https://x.com/careers/job/title--248705", "https://x.com/results/80662660827226822-eng", "https://x.com/job/slug/12345", "https://x.com/JobDetail/499961", "https://x.com/a?b=/99999", None]
    assert one(spark, T.url_id, *given) == ["3152869", "248705", "80662660827226822", "12345", "499961", "", ""]


def test_salary_and_html(spark):
    got = one(spark, T.salary, "$120,000 - $150k, bonus $5000", "$90k", "none", None)
    assert [tuple(g) if g else None for g in got] == [(5000, 120000), (90000, 90000), None, None]
    html = '<p>a &amp; b<br>c</p><script>var t="</p>";</script><!-- x --><style>p{}</style>d'
    assert one(spark, T.clean_html, html, None) == ["a & b c d", ""]
    assert one(spark, T.strip_legal, "ACME, INC. LLC", "CO OP") == ["ACME", "CO OP"]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("new york mets", "new york mets", 100, 100), ("mets new york", "new york mets", 100, 100), ("new york mets vs atlanta", "new york mets", 100, 100), ("abc", "xyz", 0, 0), ("acme software group", "acme softwares grp", 75, 95), ("", "a", 0, 0)])
def test_token_set_ratio(a, b, low, high):
    assert low <= E.token_set_ratio(a, b) <= high


def test_common_length_equals_a_table():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert E.common_length(a, b) == t[-1][-1]


def test_two_field_match(spark):
    m = spark.createDataFrame([(1, "p", "Acme Software", "Senior Data Engineer"), (2, "p", "Zeta", None), (3, "q", "Acme Software", None), (4, "p", None, "x")], "message_id int, platform string, company string, title string")
    a = spark.createDataFrame([(10, "p", "ACME Software Inc", "Data Engineer Senior"), (11, "p", "Acme Software", "Janitor"), (12, "p", "zeta", "any"), (13, "r", "Acme Software", None)], "application_id int, platform string, company string, title string")
    assert {tuple(r) for r in E.match_two_fields(m, a).collect()} == {(1, 10), (2, 12)}
    assert E.partial_ratio("abcd", "xxabcdxx") == 100 and E.weighted_ratio("", "a") == 0


def test_token_set_ratio_is_the_largest_of_three():
    """Against the three ratios worked out on whole strings, and with a least value from which on it is exact."""
    import random

    rng = random.Random(5)
    for _ in range(400):
        a, b = (" ".join(rng.choice("ab bc cd de ef fgh hij x yz".split()) for _ in range(rng.randint(0, 8))) for _ in range(2))
        x, y = set(a.split()), set(b.split())
        both, one, two = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
        if not x or not y:
            want = 0.0
        elif both and (not one or not two):
            want = 100.0
        else:
            p, q = f"{both} {one}".strip(), f"{both} {two}".strip()
            want = max([E.ratio(p, q)] + ([E.ratio(both, p), E.ratio(both, q)] if both else []))
        assert abs(E.token_set_ratio(a, b) - want) < 1e-9
        for least in (40.0, want):
            assert E.token_set_ratio(a, b, least) <= want + 1e-9 and (want < least or abs(E.token_set_ratio(a, b, least) - want) < 1e-9)
