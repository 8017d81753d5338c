import math
import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import language_id, resample, url_filters

SF = "/root/testdata/sf0.01"


def test_three_hundred_declared_languages(spark, monkeypatch):
    """More than are in memory at once: the same scores as with all of them, and a bounded part of the models in each closure."""
    monkeypatch.setattr(language_id, "BUCKETS", 4096)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tags = [a + b for a in letters[:20] for b in letters[:15]]
    rows = [(3 * k + j, f"{tag}{tag}x {tag[::-1]}{tag}o " * 8, tag) for k, tag in enumerate(tags) for j in range(3)] + [(9000, "one row", "zzz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sizes = []
    real = language_id.map_batches

    def spied(frame, made, schema, *args):
        if made is language_id._scored:
            sizes.append(args[0].shape)
        return real(frame, made, schema, *args)

    monkeypatch.setattr(language_id, "map_batches", spied)
    monkeypatch.setattr(language_id, "LANGUAGES", 100)
    model = language_id.fit(df, buckets=4096)
    assert model.languages == sorted(tags)
    some = df.where("doc_id % 40 = 0 or doc_id = 9000")
    few = {r.doc_id: (r.lang, round(r.evidence, 4)) for r in language_id.identify(some, model, host=None).collect()}
    assert sizes == [(100, language_id.FOLDS * 4096)] * 3
    monkeypatch.setattr(language_id, "LANGUAGES", 1000)
    whole = {r.doc_id: (r.lang, round(r.evidence, 4)) for r in language_id.identify(some, model, host=None).collect()}
    assert few == whole and sum(lang != "und" for lang, _ in few.values()) > 10


def test_models_take_little_of_the_drivers_memory(spark):
    """Counts of every bucket in every fold: as Python objects they would take a few hundred bytes each."""
    names, buckets, folds = list("abcdefgh"), 1 << 14, language_id.FOLDS
    rows = spark.range(len(names) * folds * buckets)
    count = F.pmod(F.xxhash64("id"), F.lit(1000)) + 1
    at = lambda size, most: F.pmod(F.floor(F.col("id") / size), F.lit(most)).cast("int")
    counts = rows.select(F.get(F.array(*[F.lit(x) for x in names]), at(folds * buckets, len(names))).alias("lang"), at(buckets, folds).alias("fold"), at(1, buckets).alias("bucket"), count.alias("n"))
    tracemalloc.start()
    try:
        (ratio,) = language_id.TextModel(names, counts, buckets).parts()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6
    seen = np.array([r.n for r in counts.where("lang = 'c'").orderBy("fold", "bucket").collect()], dtype=float).reshape(folds, buckets)
    others = np.array([np.delete(seen, k, axis=0).sum(axis=0) for k in range(folds)])
    want = np.log((others + 0.05) / (others.sum(axis=1, keepdims=True) + 0.05 * buckets) * buckets)
    assert ratio.shape == (8, folds * buckets) and np.allclose(ratio[2], want.reshape(-1), atol=1e-5)


def test_language_accuracy_on_rows_that_did_not_train(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    got = language_id.identify(held, model, declared=None, host=None).join(held.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    n, right, kept = got.agg(F.count("*"), F.count_if(F.col("lang") == F.col("truth")), F.count_if("kept")).first()
    assert right >= 0.99 * n and kept >= 0.98 * n


def test_evidence_is_fused(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    rows = [(1, "xq", "de", None), (2, "xq", None, "a.example.fr"), (3, None, "de", "x.de"), (4, " \n", "fr", None), (None, "the and of ththe reat", None, None), (5, "the and of and the ing", "pt-BR", "h"), (5, "the and of and the ing", "pt-BR", "h")]
    rows += [(100 + k, "der die und das ist nicht gebe ung lich", None, "h.de") for k in range(60)] + [(200, "qz", None, "h.de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("score", F.lit("x"))
    got = language_id.identify(df, model, least_evidence=-99.0).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[1].lang == "de" and by[2].lang == "fr" and by[200].lang == "de"
    assert by[3].lang == by[4].lang == "und" and not by[3].kept and by[None].lang == "en" and by[5].lang == "en"
    junk = spark.createDataFrame([(1, "".join(random.Random(1).choice("0123456789#%&") for _ in range(2000)), "en", "s")], "doc_id long, text string, lang string, source string")
    assert not language_id.identify(junk, model).first().kept
    kept = language_id.keep_known(df, model)
    assert kept.columns == df.columns and {3, 4}.isdisjoint({r.doc_id for r in kept.collect()})
    assert language_id.identify(df.limit(0), model).count() == 0
    none = language_id.fit(df.where("lang = 'zz'"))
    assert {r.kept for r in language_id.identify(df, none).collect()} == {False}


def test_resampling_prefers_the_target(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 2 = 0")
    got = resample.resample(docs, train, share=0.85)
    assert got.where("kept").count() == math.ceil(0.85 * docs.count())
    held = got.join(labels.where("doc_id % 2 = 1"), "doc_id")
    good, bad = (held.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("int"))).first()[0] for q in (1, 0))
    assert good > 0.95 and bad < 0.15


def test_resampling_edges(spark):
    rows = [(1, "a b a"), (2, None), (2, None), (None, "a b"), (3, ""), (4, "c d " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("good", F.lit("x")).withColumn("q", F.lit(1))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, None), (None, 1), (4, 0)], "doc_id long, quality int")
    got = resample.resample(docs, labels, share=0.5).collect()
    assert len(got) == 6 and {r.log_weight for r in got if r.doc_id in (2, 3)} == {0.0}
    assert {r.kept for r in resample.resample(docs, labels.limit(0)).collect()} == {True}
    assert resample.resample(docs.limit(0), labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.randrange(2**50), 7, 2**40]) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "q long")
    for k in (1, 50, 151, 300):
        assert resample.kth_largest(df, "q", k) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_largest(df, "q", 301) is None


def pagerank(edges, seeds, reverse, damping=0.85, rounds=300):
    nodes = sorted({x for e in edges for x in e[:2]} | set(seeds))
    at = {n: i for i, n in enumerate(nodes)}
    w = np.zeros((len(nodes), len(nodes)))
    for a, b, n in edges:
        w[(at[b], at[a]) if reverse else (at[a], at[b])] += n
    out = w.sum(axis=1, keepdims=True)
    w = np.divide(w, out, out=np.zeros_like(w), where=out > 0)
    start = np.array([seeds.get(n, 0.0) for n in nodes])
    start = start / (start.sum() or 1)
    score = start
    for _ in range(rounds):
        score = (1 - damping) * start + damping * score @ w
    return dict(zip(nodes, score, strict=True))


def test_propagation_equals_matrix_products(spark):
    rng = random.Random(4)
    edges = sorted({(f"h{rng.randint(0, 25)}", f"h{rng.randint(0, 25)}") for _ in range(90)})
    edges = [(a, b, rng.randint(1, 5)) for a, b in edges if a != b]
    trust, distrust = {"h1": 3.0, "h2": 1.0}, {"h5": 2.0, "h30": 1.0}
    seeds = [(h, trust.get(h, 0.0), distrust.get(h, 0.0)) for h in {*trust, *distrust}]
    got = url_filters.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), tolerance=1e-12)
    t, d = pagerank(edges, trust, False), pagerank(edges, distrust, True)
    for r in got.collect():
        assert abs(r.trust - t.get(r.host, 0)) < 1e-9 and abs(r.distrust - d.get(r.host, 0)) < 1e-9


def test_url_rules_and_verdicts(spark):
    rules = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    pages = [
        (1, "http://A.Example.NET/en/1?x#y", None), (2, "http://a.example.net/de/1", ""), (3, "https://www.example.com/de/", link("spam.net", "spam.net")), (4, "https://notexample.com/de/", ""), (5, None, ""), (6, "nothing", ""), (7, "x://Net", ""), (8, "x://y.org/fr/?q", link("good.io")),
        (9, "http://farm.io/1", link("spam.net", "b.spam.net")), (10, "http://good.io/", ""), (11, "http://spam.net/", ""), (12, "http://b.spam.net/", ""), (12, "http://b.spam.net/", ""), (None, "http://h.org/fr", ""), (13, "http://h#frag", ""),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "path", "rule", "verdict", "r", "trust", "distrust", "bad")})
    rows = url_filters.filter_urls(df, rules).collect()
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}
    assert len(rows) == len(pages)
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4][2] is None and got[5] == got[6] == ("", "", None, "allow") and got[7] == ("net", "", None, "allow") and got[8] == ("y.org", "/fr/", "org/fr/", "allow")
    assert got[9][2:] == (None, "block") and got[10][2:] == (None, "allow") and got[13][:2] == ("h", "")
    assert url_filters.filter_urls(df.limit(0), rules).count() == 0


def test_distrust_reaches_hosts_far_from_blocked_ones(spark):
    """A chain of 60 hosts that leads to a blocked one, among few others: the verdict far away is that of the limit."""
    edges = [(f"h{k}", f"h{k + 1}", 1) for k in range(60)]
    seeds = [("h60", 0.0, 1.0)]
    got = {r.host: r.distrust for r in url_filters.propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), 1e-9).collect()}
    assert all(abs(got[f"h{60 - k}"] - 0.15 * 0.85**k) < 1e-9 for k in range(60))


def test_links_in_attributes_scripts_and_text(spark):
    html = """<link rel="canonical" href="https://A.com/x"><meta property="og:url" content='//b.com'><script>go("http://c.com?x")</script> see https://d.com. <a href=/local> <img src="ftp://e.com/1"> xhttp://no.com"""
    df = spark.createDataFrame([("me.com", html * 2), ("a.com", html), ("", html)], "host string, html string")
    got = {(r.src, r.dst, r.n) for r in url_filters.host_edges(df).collect()}
    assert got == {("me.com", h, 2) for h in ("a.com", "b.com", "c.com", "d.com.", "e.com")} | {("a.com", h, 1) for h in ("b.com", "c.com", "d.com.", "e.com")}


def splitmix(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ (x >> 31)


def ngram_buckets(text, n, buckets):
    words = [w for w in (text or "").lower().split() if not any(c in "0123456789" for c in w)]
    data = f" {' '.join(words)} ".encode() if words else b""
    out = []
    for i in range(len(data) - n + 1):
        value = 0
        for c in data[i : i + n]:
            value = (value * 257 + c + 1) & (1 << 64) - 1
        out.append(splitmix(value) % buckets)
    return out


def fused(spark, rows):
    """{key: (logs by language, evidence)} of rows (key, text, lang, source): models, priors and fusion by plain loops. Languages in order."""
    df = spark.createDataFrame([(r[0],) for r in rows], "doc_id long")
    fold = {r.doc_id: r.f for r in df.select("doc_id", language_id.fold_of(F.col("doc_id")).alias("f")).collect()}
    said = {k: (lang or "").split("_")[0].lower() for k, _, lang, _ in rows}
    names, buckets = sorted({x for x in said.values() if len(x) in (2, 3)}), language_id.BUCKETS
    counts = np.zeros((language_id.FOLDS, len(names), buckets))
    grams = {k: ngram_buckets(t, 4, buckets) for k, t, _, _ in rows}
    for k, *_ in rows:
        if said[k] in names:
            for other in set(range(language_id.FOLDS)) - {fold[k]}:
                np.add.at(counts[other, names.index(said[k])], np.array(grams[k], dtype=int), 1)
    logp = np.log((counts + 0.05) / (counts.sum(axis=2, keepdims=True) + 0.05 * buckets)) + np.log(buckets)
    score = {k: np.array([logp[fold[k], i, grams[k]].sum() for i in range(len(names))]) for k, *_ in rows}
    best = {k: int(score[k].argmax()) for k, *_ in rows if grams[k]}
    whole = np.array([sum(b == i for b in best.values()) for i in range(len(names))])
    corpus = (whole + 1) / (whole.sum() + len(names))
    suffix = lambda h: h.split(".")[-1] if h and "." in h else None
    host_of = {k: h for k, *_, h in rows}
    tally = lambda pick: np.array([sum(b == i for k, b in best.items() if host_of[k] is not None and pick(host_of[k])) for i in range(len(names))])
    toward = lambda c, p: (c + 10 * p) / (c.sum() + 10)
    prior = {h: toward(tally(lambda x, h=h: x == h), toward(tally(lambda x, h=h: suffix(x) == suffix(h)), corpus)) for h in set(host_of.values()) if h is not None}
    out = {}
    for k, _, _, h in rows:
        logs = 0.25 * score[k] + np.log(corpus if h is None else prior[h])
        for name in (said[k], language_id.SUFFIXES.get(suffix(h), "")):
            if name in names:
                logs = logs + [np.log(0.9 if x == name else 0.1 / (len(names) - 1)) for x in names]
        out[k] = logs, score[k][int(logs.argmax())] / len(grams[k]) if grams[k] else None
    return names, out


def test_posteriors_equal_brute_force(spark):
    rng = random.Random(6)
    sounds = {"de": ["der", "und", "ung"], "en": ["the", "and", "ing"], "fr": ["le", "et", "eau"]}
    hosts = [None, "a.de", "b.de", "c.fr", "plain"]
    rows = [(k, " ".join(rng.choice([*sounds[lang], "7x", "x-9"]) for _ in range(rng.randint(0, 30))), rng.choice([lang, lang, lang.upper() + "_X", "en", "q", None]), rng.choice(hosts)) for k, lang in ((k, rng.choice(list(sounds))) for k in range(120))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names, want = fused(spark, rows)
    got = {r.doc_id: r for r in language_id.identify(df, language_id.fit(df)).collect()}
    assert names == ["de", "en", "fr"] and len(got) == 120
    for k, (logs, evidence) in want.items():
        mass = np.exp(logs - logs.max())
        assert abs(got[k].posterior - 1 / mass.sum()) < 1e-4
        assert (got[k].evidence is None) == (evidence is None) and (evidence is None or abs(got[k].evidence - evidence) < 1e-4)
        if evidence is not None and evidence > 0.31 and sorted(logs)[-1] - sorted(logs)[-2] > 1e-3:
            assert got[k].lang == names[int(logs.argmax())]


def test_rare_declared_languages_keep_their_models(spark):
    """Each declared language has its own sample, so that few rows among many of another have a model too."""
    rows = [(k, "the and of this that with", "en") for k in range(300)] + [(1000 + k, "gwlad ynys mynydd cymru", "CY-gb") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df, sample_rows=40)
    assert model.languages == ["cy", "en"]
    got = language_id.identify(df, model, host=None).where("doc_id >= 1000").collect()
    assert {r.lang for r in got} == {"cy"} and all(r.kept for r in got)


def test_markup_and_address_evidence_of_pages(spark):
    """Pages: the text's models are of documents; the markup's lang attribute and the host are evidence beside it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("markup"), url_filters.host_of(F.col("url")).alias("host"), F.regexp_replace(F.regexp_extract("html", "(?s)<article>(.*)</article>", 1), "<[^>]*>", " ").alias("text"))
    # pages of shouted or marked-up noise are rejected as no language; here it is about names
    settings = dict(key="page_id", declared="markup", host="host", least_evidence=-99.0)
    bare = {r.page_id: r for r in language_id.identify(pages, model, **settings | dict(declared=None, host=None)).collect()}
    got = language_id.identify(pages, model, **settings).join(pages.select("page_id", "markup"), "page_id").collect()
    assert len(got) == 250 and sum(r.lang == r.markup for r in got) >= 0.99 * len(got)
    assert sum(r.posterior >= bare[r.page_id].posterior - 1e-9 for r in got if r.lang == r.markup == bare[r.page_id].lang) >= 0.9 * len(got)
    # a short text whose models leave it open goes where markup or suffix points
    short = spark.createDataFrame([(1, "es", "x.org", "de"), (2, None, "x.es", "de"), (3, None, "x.fr", "de")], "page_id long, markup string, host string, text string")
    open_ = {r.page_id: r.lang for r in language_id.identify(short, model, **settings).collect()}
    assert open_[1] == "es" and open_[2] == "es" and open_[3] == "fr"


def test_log_weights_equal_brute_force(spark):
    """Both models and all weights of a small table worked out again by plain loops over strings."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(40)]
    rows = [(k, " ".join(rng.choice(words[: 20 if k % 2 else 40]) for _ in range(rng.randint(0, 40)))) for k in range(80)] + [(80, None)]
    labels = [(k, k % 2) for k in range(60)] + [(70, 2), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *[f"1 AS {c}" for c in ("chosen", "key", "good", "label", "q", "n_grams", "log_weight", "bucket")])
    got = resample.resample(docs, spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "1 AS key", "2 AS label", "3 AS chosen"), buckets=1 << 20).collect()
    split = {k: (t or "").split() for k, t in rows}
    own = {k: w + list(zip(w, w[1:], strict=False)) for k, w in split.items()}
    raw, target = {}, {}
    for k, grams in own.items():
        for g in grams:
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (k < 60 and k % 2 == 1)
    n, m, b = sum(raw.values()), sum(target.values()), 1 << 20
    p = {g: (raw[g] + 0.5) / (n + 0.5 * b) for g in raw}
    ratio = {g: math.log((0.7 * (target[g] + p[g]) / (m + 1) + 0.3 * p[g]) / p[g]) for g in raw}
    noise = {r.doc_id: r.u for r in docs.select("doc_id", ((F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(17), F.lit("gumbel")), 11).cast("double") + 0.5) * 2.0**-53).alias("u")).collect()}
    keys = {}
    for r in got:
        want = sum(ratio[g] for g in own[r.doc_id])
        keys[r.doc_id] = want - math.log(-math.log(noise[r.doc_id]))
        assert r.n_grams == len(own[r.doc_id]) and abs(r.log_weight - want) < 1e-6 and abs(r.gumbel_key - keys[r.doc_id]) < 1e-6
    most = sorted(keys, key=keys.get, reverse=True)[: math.ceil(0.5 * len(rows))]
    assert {r.doc_id for r in got if r.kept} == set(most)
