import hashlib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from millrace.llm import quality_rules, secret_scan

BASE = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), ("access", "AKIA[A-Z0-9]+", 0), ("hex", "[0-9a-f]+", 0)]


def base(text):
    out = []
    for k, (_, pattern, flags) in enumerate(BASE):
        for m in re.finditer(pattern, text or "", flags):
            if (k == 0 and len(m[2]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def secrets_corpus():
    rng = random.Random(1)
    parts = ["password: hunter2hunter2", "token=abc", "PassWord = 'Xy/z+1=='", "secret: token: abcdefgh", "AKIA" + "A1" * 9, "AKIAAKIA" + "B" * 16, "AKIAshort", "0123456789abcdef01234567", "deadbeef", "api_key==abc==", "APIKEY:\"q.w.e.r.t\"", "é🙂", "\x01", "\n", " words here ", "-----BEGIN RSA PRIVATE KEY-----", "eyJhbGciOi.eyJzdWIiOiIx.c2lnbmF0dXJl"]
    rows = [(k, rng.choice(["", " ", "x"]).join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(200)]
    return [*rows, (200, None), (201, ""), (None, rows[3][1]), rows[5], (202, "a" * 30_000 + " token = abcdefg" * 300)]


def test_scan_equals_brute_force(spark, tmp_path):
    rows = secrets_corpus()
    got = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), str(tmp_path / "ledger")).collect()
    found = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.spans if s.kind < 3)) for r in got)
    assert found == Counter((k, tuple(base(t))) for k, t in rows)
    assert any(s.kind == 3 for r in got for s in r.spans) and any(s.kind == 4 for r in got for s in r.spans)


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    rows = secrets_corpus()[:60]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    path, version = str(tmp_path / "ledger"), secret_scan.rule_version(secret_scan.RULES)
    held = lambda: [r.blob for r in secret_scan.read_ledger(spark, path, version).collect()]
    some = secret_scan.scan(df.where("doc_id < 40"), path).collect()
    old = {hashlib.sha256((t or "").encode()).hexdigest() for k, t in rows if k < 40}
    assert sorted(held()) == sorted(old) and len(some) == sum(k < 40 for k, _ in rows)
    blobs = df.select(secret_scan.address(F.col("text")).alias("blob"), F.col("doc_id").alias("k")).groupBy("blob").agg(F.min("k").alias("k"))
    new = secret_scan.unseen(df, blobs, secret_scan.read_ledger(spark, path, version))
    assert {r.blob for r in new.collect()} == {hashlib.sha256((t or "").encode()).hexdigest() for _, t in rows} - old
    whole, parts = ({(r.doc_id, str(r.spans)) for r in x.collect()} for x in (secret_scan.scan(df, str(tmp_path / "other")), secret_scan.scan(df, path)))
    assert whole == parts
    # a second run over the same texts scans none, with equal results
    before = sorted(held())
    assert secret_scan.unseen(df, blobs, secret_scan.read_ledger(spark, path, version)).count() == 0
    assert {(r.doc_id, str(r.spans)) for r in secret_scan.scan(df, path).collect()} == whole and sorted(held()) == before
    # other rules have a version of their own
    secret_scan.scan(df, path, rules=secret_scan.BASE_RULES)
    assert secret_scan.read_ledger(spark, path, secret_scan.rule_version(secret_scan.BASE_RULES)).count() == len({t or "" for _, t in rows})
    assert secret_scan.scan(df.limit(0), path).count() == 0


def test_redaction(spark, tmp_path):
    df = spark.createDataFrame([(1, "é token = abcdef0123456789abcdef01 end", 99, "k"), (2, "clean", 5, None), (3, None, None, None)], "doc_id long, text string, n_chars long, blob string")
    got = {r.doc_id: r for r in secret_scan.redacted(df, str(tmp_path / "a")).collect()}
    assert got[1].text == "é [secret] end" and got[1].n_chars == len(got[1].text) and got[1].blob == "k"
    assert got[2].text == "clean" and got[3].text is None and got[3].n_chars is None


def test_redaction_keeps_columns_of_any_name(spark, tmp_path):
    names = ["address", "spans", "new", "__address", "__blob", "__spans", "__new", "k", "k0", "b0"]
    df = spark.createDataFrame([(1, "token = abcdef0123", *range(10))], f"doc_id long, text string, {', '.join(f'{n} long' for n in names)}")
    got = secret_scan.redacted(df, str(tmp_path / "a"))
    assert got.columns == df.columns and tuple(got.first()) == (1, "[secret]", *range(10))
    assert secret_scan.scan(df, str(tmp_path / "b")).count() == 1


def plainly(text):
    """The text with all spans of the base rules, merged where they overlap, replaced."""
    spans = sorted((a, b) for a, _, b in base(text))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[secret]"
        at = max(at, b)
    return out + text[at:]


def test_redaction_equals_brute_force(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, t) for k, t in secrets_corpus() if t is not None and k is not None and "\x01" not in t]
    for k in range(6):
        gap = lambda: "é🙂x " * rng.choice([0, 1, 3, 1023, 1024, 1025, 3000])
        rows.append((300 + k, "".join(gap() + rng.choice(["token=abcdefgh", "a1" * 14, "AKIA" + "B" * 16]) + rng.choice(["", " "]) for _ in range(20)) + gap()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in secret_scan.redacted(df, str(tmp_path / "a"), rules=secret_scan.BASE_RULES).collect())
    assert got == Counter((k, plainly(t)) for k, t in rows)


def test_many_matches_cost_in_proportion(spark, tmp_path):
    """Twice the matches in one text take at most about twice the time to scan and to redact, not four times."""
    import time

    took = []
    for n in (20_000, 40_000):
        df = spark.createDataFrame([(1, "token=abcdef x " * n)], "doc_id long, text string")
        began = time.time()
        row = secret_scan.redacted(df, str(tmp_path / str(n))).first()
        took.append(time.time() - began)
        assert row.text == "[secret] x " * n
    assert took[1] < 3 * took[0] + 2


def counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["a", "b", "c", "é#", "x|y", "\u00a0", "🙂"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t", " \r\n"]) for _ in range(rng.choice([0, 2, 3, 5, 60, 400])))) for k in range(120)]
    rows += [(120, None), (121, ""), (None, "a a a a"), (122, "a a"), (123, "w " * 30_000), (124, " ".join(map(str, range(20_000))))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("w", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.statistics(df).collect())
    assert got == sorted((str(k), *counts(t)) for k, t in rows)


def test_learned_rules_reject_the_bad_and_keep_the_good(spark):
    rng = random.Random(9)
    good = lambda: " ".join(f"w{rng.randint(0, 5000)}" for _ in range(100))
    bad = lambda: " ".join(f"w{rng.randint(0, 5000)}###" for _ in range(100))
    rows = [(k, good() if k % 4 else bad()) for k in range(800)]
    labels = spark.createDataFrame([(k, 1 if k % 4 else 0) for k in range(0, 600)] + [(5, None), (9999, 0)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, rules = quality_rules.apply_rules(docs, labels)
    assert rules and all(r.kept == bool(r.doc_id % 4) for r in got.collect())
    assert str(quality_rules.verdict(rules)).count("WHEN") == len(rules)
    again, none = quality_rules.apply_rules(docs, labels.limit(0))
    assert none == [] and again.where("not kept").count() == 0
    assert quality_rules.apply_rules(docs.limit(0), labels)[0].count() == 0


def test_a_conjunction_is_learned(spark):
    """Bad are only texts that are both full of symbols and in one line: neither threshold alone tells them."""
    rng = random.Random(11)

    def made(symbols, one_line):
        words = [f"w{rng.randint(0, 5000)}{'###' if symbols else ''}" for _ in range(90)]
        return " ".join(words) if one_line else "\n".join(" ".join(words[i : i + 3]) for i in range(0, 90, 3))

    rows = [(k, made(k % 2 == 0, k // 2 % 2 == 0)) for k in range(1200)]
    bad = lambda k: k % 4 == 0
    labels = spark.createDataFrame([(k, 0 if bad(k) else 1) for k in range(900)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS quality", "2 AS bad", "3 AS n_words", "4 AS fold", "5 AS w", "6 AS lines")
    got, rules = quality_rules.apply_rules(docs, labels)
    assert rules and max(map(len, rules)) >= 2
    for rule in rules:
        assert {name for name, _, _ in rule} & {"symbol_share", "mean_word"} and {name for name, _, _ in rule} & {"words_a_line", "dup_line_share"}
    assert {r.doc_id for r in got.collect() if not r.kept} == {k for k in range(1200) if bad(k)}
    # a rule's later conditions that the held rows don't bear out are pruned: with noise alone nothing is kept
    noise = spark.createDataFrame([(k, rng.randint(0, 1)) for k in range(900)], "doc_id long, quality int")
    assert quality_rules.apply_rules(docs, noise)[1] == []
