import random
import re

from millrace.llm import decontaminate


def grams(text):
    w = [x for x in re.split(r"[\W_]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs, items, threshold=0.8):
    out = {}
    for d, text in docs:
        for i, test in items:
            s = grams(test)
            n = len(s & grams(text))
            if d is not None and i is not None and s and n >= threshold * len(s) - 1e-9:
                out[d, i] = (n, len(s))
    return out


def test_contained_equals_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, text(rng.randint(4, 60))) for i in range(40)] + [(40, None), (41, ""), (None, text(20))]
    docs = []
    for d in range(120):
        body = text(rng.choice([3, 20, 200, 3000]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            w = (rng.choice(items[:40])[1]).split()
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            body += ". " + " ".join(w).upper() + ", " + text(5)
        docs.append((d, body))
    docs += [(500, None), (501, ""), (None, items[0][1]), docs[7]]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.n_shared, r.n_shingles) for r in decontaminate.contained(d, i).collect()}
    want = brute(docs, items)
    assert got == want and len(want) > 30
    kept = decontaminate.drop(d, i)
    assert kept.columns == d.columns
    leaks = {k for k, _ in want}
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(k) for k, _ in docs if k not in leaks)


def test_shuffled_way_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", -1)
    d = spark.createDataFrame([(1, "a b c d e f g h i j", "x"), (2, "z y x w v u", "y")], "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(9, "B c d e f g.")], "item_id long, text string")
    d = d.drop("item_id")
    assert [(r.doc_id, r.item_id, r.containment) for r in decontaminate.contained(d, i).collect()] == [(1, 9, 1.0)]
    assert decontaminate.contained(d.limit(0), i).count() == 0
    assert decontaminate.contained(d, i.limit(0)).count() == 0


def test_common_opening_makes_no_candidates(spark):
    """2,000 documents and 2,000 items with one opening and else nothing in common: what all have is in no sketch."""
    opening = "these five words open all "
    d = spark.createDataFrame([(k, opening + " ".join(f"d{k}x{i}" for i in range(20))) for k in range(2000)], "doc_id long, text string")
    i = spark.createDataFrame([(k, opening + " ".join(f"i{k}x{i}" for i in range(20))) for k in range(2000)], "item_id long, text string")
    docs, items = d.selectExpr("doc_id AS key", "text"), i.selectExpr("item_id AS key", "text")
    own = decontaminate.hashes(items, 5)
    hits = docs.select(decontaminate.terms(docs.text).alias("w")).selectExpr("size(w) AS n").first()[0]
    assert hits == 25 and decontaminate.candidates(docs, own, 0.8, 5).count() == 0
    frequency = spark.createDataFrame([], "h long, documents long")
    sketch = decontaminate.sketches(own, frequency, 0.8)
    # 21 shingles an item; its partition's largest item has as many, so 21 - 17 + 1 hashes
    assert {r["count"] for r in sketch.groupBy("key").count().collect()} == {5}
    assert decontaminate.contained(d, i).count() == 0


def test_columns_of_any_name(spark):
    names = ["key", "doc", "item", "h", "w", "n", "shingle", "documents", "both"]
    more = [f"{k} AS {c}" for k, c in enumerate(names)]
    d = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "z y x w v u")], "doc_id long, text string").selectExpr("*", *more)
    i = spark.createDataFrame([(9, "B c d e f g.")], "item_id long, text string").selectExpr("*", *more)
    assert [(r.doc_id, r.item_id, r.containment) for r in decontaminate.contained(d, i).collect()] == [(1, 9, 1.0)]
    kept = decontaminate.drop(d, i)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [2]


def test_ties_with_the_threshold_and_one_shingle(spark):
    words = [f"t{k}" for k in range(14)]
    d = spark.createDataFrame([(1, " ".join(words[:12])), (2, " ".join(words[:11])), (3, "a b c d e")], "doc_id long, text string")
    i = spark.createDataFrame([(1, " ".join(words)), (2, "A, B; c d e")], "item_id long, text string")
    assert {(r.doc_id, r.item_id, r.n_shared) for r in decontaminate.contained(d, i).collect()} == {(1, 1, 8), (3, 2, 1)}
