"""The matching queries that have no SQL."""

import random

from pyspark.sql import functions as F

from millrace.operators import resolve
from millrace.plans import matching

SF = "/root/testdata/sf0.001"


def test_fuzzy_names_are_whole_texts(spark, tmp_path):
    """One opening of over 60 characters with another rest is no sure match; a match in the rest counts."""
    opening = "alpha " + " ".join(f"common{i}" for i in range(10))
    rest = " ".join(f"left{i}" for i in range(40))
    spark.createDataFrame([(1, f"{opening} {rest}")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = [(1, f"{opening} " + " ".join(f"zq{i}zq" for i in range(40))), (2, "alpha " + " ".join(f"other{i}" for i in range(10)) + f" {rest}")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {r.right_id: r.score for r in matching.QUERIES["q_fuzzy_candidates"](spark, str(tmp_path)).collect()}
    assert found.get(1, 0.0) < 80 and found[2] > found.get(1, 0.0)
    got = matching.QUERIES["q_fuzzy_decision"](spark, str(tmp_path)).collect()
    assert [(r.right_id, r.decision == "auto") for r in got] == [(2, False)]


def test_keyword_subset_of_all_parts(spark):
    """Pairs of the whole table on both sides, against brute force."""
    parts = [(r.p_partkey, [w for w in r.p_name.lower().split(" ") if w]) for r in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name").collect()]
    want = set()
    for a, v in parts:
        # the left name is the first two words, cut at spaces
        w = v[:2]
        for b, u in parts:
            if w and set(w) <= set(u) and (len(w) > 1 or len(u) == 1):
                want.add((a, b))
    # pairs of names and the rows behind them are the pairs of rows, and each row's links are counted
    lefts, rights = {}, {}
    for a, v in parts:
        lefts.setdefault(" ".join(v[:2]), []).append(a)
        rights.setdefault(" ".join(v), []).append(a)
    pairs = [(r.left_name, r.right_name) for r in matching.QUERIES["q_keyword_classes"](spark, SF).collect()]
    got = [(a, b) for x, y in pairs for a in lefts[x] for b in rights[y]]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(a % 10 and b % 7 and a != b for a, b in got)
    rows = {(r.side, r.id): (r.class_id, r.links) for r in matching.QUERIES["q_keyword_subset"](spark, SF).collect()}
    assert rows == {(side, a): (min(ids), sum(p[k] == a for p in want)) for k, side, names in ((0, "left", lefts), (1, "right", rights)) for ids in names.values() for a in ids}


def test_keyword_subset_of_copies_is_a_row_each(spark):
    """Names that many rows share, no name, and words that no other name has: as many rows out as in, whatever they link."""
    names = ["red bolt"] * 3000 + ["bolt", "Red bolt nut", "zinc", " ", None, None]
    side = lambda key: spark.createDataFrame(list(enumerate(names)), f"{key} long, name string")
    got = {(r.side, r.id): (r.class_id, r.links) for r in resolve.keyword_subset(side("left_id"), side("right_id")).collect()}
    assert len(got) == 2 * len(names)
    assert {got["left", k] for k in range(3000)} == {(0, 3000)} == {got["right", k] for k in range(3000)}
    assert [got["left", k] for k in range(3000, 3006)] == [(3000, 1), (3001, 1), (3002, 1), (3003, 0), (3004, 0), (3004, 0)]
    assert [got["right", k] for k in range(3000, 3006)] == [(3000, 1), (3001, 1), (3002, 1), (3003, 0), (3004, 0), (3004, 0)]


def test_keyword_subset_has_each_pair_of_rows(spark, tmp_path, monkeypatch):
    """Names dealt to several parts and tasks, as large ones are: a left row once for each right row it is linked to, as in all pairs; other rows once."""
    monkeypatch.setattr(resolve, "LINKED_ROWS", 3)
    monkeypatch.setattr(resolve, "TASK_LINKS", 5)
    names = ["red bolt"] * 10 + ["Red  bolt nut", "bolt red", "red bolt nut", "bolt", "bolt bolt", "zinc", "", " ", None, "nut red bolt"]
    parts = list(enumerate(names, 1))
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(str(tmp_path / "part.parquet"))
    words = {k: [w for w in (name or "").lower().split(" ") if w] for k, name in parts}
    # a left name is what comes before the second space, which may be less than two words
    first = {k: [w for w in (name or "").lower().split(" ")[:2] if w] for k, name in parts}
    want = sorted((a, b) for a, w in first.items() for b, v in words.items() if w and set(w) <= set(v) and (len(w) > 1 or len(v) == 1))
    rows = matching.QUERIES["q_keyword_subset"](spark, str(tmp_path)).collect()
    linked = [r for r in rows if r.linked_id is not None]
    assert sorted((r.id, r.linked_id) for r in linked) == want and len(want) > 100
    assert {r.side for r in linked} == {"left"} and all(r.links == sum(a == r.id for a, _ in want) for r in linked)
    alone = sorted((r.side, r.id, r.links) for r in rows if r.linked_id is None)
    assert alone == sorted([("left", a, 0) for a in words if all(a != x for x, _ in want)] + [("right", b, sum(b == y for _, y in want)) for b in words])


def _companies(seed, n):
    """Names with shared words, words of other names, typing errors, one word repeated, and none at all."""
    rng = random.Random(seed)
    words = ["acme", "global", "systems", "services", "tech", "solutions", "bank", "of", "north", "data", "inc", "llc", "consulting", "group"]
    out = []
    for _ in range(n):
        name = [rng.choice(words) if rng.random() < 0.7 else "".join(rng.choice("abcdexyz") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.3:
            k = rng.randrange(len(name))
            name[k] = name[k][:-1] + rng.choice("aeq")
        out.append("  ".join(name))
    return [*out, "", " ", None, "acme acme", "acme"]


def test_fuzzy_candidates_equal_all_pairs(spark):
    """Every pair of a block compared, for several least scores and ranks; few of them reach Python."""
    left, right = list(enumerate(_companies(1, 60))), list(enumerate(_companies(2, 150)))
    make = lambda rows, key: spark.createDataFrame([(k, n, str(k % 2)) for k, n in rows], f"{key} long, name string, block string")
    a, b = make(left, "left_id"), make(right, "right_id")
    product = sum(i % 2 == j % 2 for i, _ in left for j, _ in right)
    for least, k in ((40.0, 3), (80.0, 2), (95.0, 1), (1.0, 4)):
        want = []
        for i, x in left:
            scored = sorted((-round(resolve.token_set_ratio(x, y), 4), j) for j, y in right if i % 2 == j % 2)
            want += [(i, j, -s, n + 1) for n, (s, j) in enumerate([t for t in scored if -t[0] >= least][:k])]
        got = sorted(map(tuple, resolve.candidates(a, b, least, k).collect()))
        assert got == sorted(want)
        if least >= 80:
            open_ = resolve.bounded_pairs(a, b, least, k).where(F.col("high") > F.col("low"))
            assert open_.where(F.col("high") < least - 1e-4).count() == 0 and open_.count() < product / 8


def test_rare_words_find_a_short_name_in_a_long_one(spark):
    """Lengths too far apart for whole lines to be alike: found by words alone, and only where enough of them weigh enough."""
    short, long = "zebra quartz", " ".join(["common"] + [f"filler{i}" for i in range(200)])
    a = spark.createDataFrame([(1, short, "b"), (2, "common q", "b")], "left_id long, name string, block string")
    b = spark.createDataFrame([(1, f"{long} zebra quartz", "b"), (2, long, "b"), (3, f"{long} zebra", "b")], "right_id long, name string, block string")
    pairs = {(r.left_id, r.right_id) for r in resolve.likely_pairs(a, b, 80.0).collect()}
    assert pairs == {(1, 1), (2, 1), (2, 2), (2, 3)}
    assert [(r.right_id, r.score) for r in resolve.candidates(a.where("left_id = 1"), b, 80.0).collect()] == [(1, 100.0)]


def test_rows_of_other_blocks_are_left_alone(spark):
    """Of the right rows only those in a block of the left ones have their words looked at, once, and kept."""
    left = spark.createDataFrame([(1, "red bolt", "red"), (2, "no block", None)], "left_id long, name string, block string")
    right = spark.createDataFrame([(1, "red bolt", "red"), (2, "blue bolt", "blue"), (3, "red nut", "red"), (4, "no block", None)], "right_id long, name string, block string")
    a, b = resolve._sides(left, right)
    assert {r.left_id for r in a.collect()} == {1} and {r.right_id for r in b.collect()} == {1, 3}
    assert b.inputFiles()
    assert [(r.left_id, r.right_id, r.score) for r in resolve.candidates(left, right, 95.0, 1).collect()] == [(1, 1, 100.0)]
