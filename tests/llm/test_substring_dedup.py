import random

import numpy as np
import pytest

from millrace.llm import column_bwt, substring_dedup


def brute(rows, least):
    """{(key, text): removed places}, by a table of all windows."""
    seen = {}
    coded = [(-1 if k is None else k, (t or "").encode()) for k, t in rows]
    for k, b in coded:
        for i in range(len(b) - least + 1):
            w = b[i : i + least]
            seen[w] = min(seen.get(w, (k, i)), (k, i))
    out = []
    for k, b in coded:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] < (k, i):
                gone[i : i + least] = True
        out.append((k, bytes(x for x, g in zip(b, gone, strict=True) if not g), int(gone.sum())))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"é{i}w" for i in range(200)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(rng.randint(15, 60)) for _ in range(5)]
    rows = []
    for k in range(150):
        parts = [make(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, len(p) // 2)
            parts += [p[cut:] if rng.random() < 0.5 else p[: len(p) - cut], make(rng.randint(0, 20))]
        rows.append((k, rng.choice(["", "\n", " "]).join(parts)))
    rows += [(200, None), (201, ""), (202, "ab" * 700), (203, "x" * 900), (204, "ab" * 90), (205, rows[3][1]), (206, rows[3][1]), (None, rows[7][1]), rows[9], (207, make(6000)), (208, "y" * 99), (209, "z" * 100), (210, "z" * 100)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"wide": 10, "block": 7}), (3, {"wide": 60, "block": 100}), (1, {"one_of": 2, "heavy_rows": 4})])
def test_dedup_equals_brute_force(spark, seed, settings):
    rows = corpus(seed)
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), **settings).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept), sum(s.end - s.start for s in r.spans)) for r in got)
    assert mine == brute(rows, 100)
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:], strict=False))


def test_long_windows(spark):
    """Runs of more windows and anchors further in than seven bits hold."""
    rows = [*corpus(5), (300, "q" * 1500), (301, "q" * 1200)]
    got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least=300).collect()
    mine = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept), sum(s.end - s.start for s in r.spans)) for r in got)
    assert mine == brute(rows, 300) and sum(n > 0 for _, _, n in mine) > 5
    with pytest.raises(ValueError, match="least"):
        substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), least=70_000)


def test_segments(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 257)
    rng = random.Random(4)
    data = np.frombuffer(bytes(rng.choice(b"abc ") for _ in range(3000)) + b"\n", dtype=np.uint8)
    starts = np.array([0, 1500, 3001])
    text, start, count, offset, anchor, _ = substring_dedup.runs(data, starts, 100, 32)
    assert count.sum() == (1500 - 1 - 99) + (1500 - 99)
    assert (offset >= count - 1).all() and (offset <= 68).all() and len(anchor) == len(text) == len(start)


def test_texts_of_one_key_are_told_apart(spark, monkeypatch):
    """Two texts of one key whose 16-bit hashes agree: the repeated one goes, the other stays."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    made = [(k, "".join(rng.choice("abcdefgh ") for _ in range(140))) for k in range(2000)]
    hashed = spark.createDataFrame(made, "k long, text string").select("k", "text", F.xxhash64("text").bitwiseAND(0xFFFF).alias("h")).collect()
    seen, pair = {}, None
    for r in hashed:
        if r.h in seen:
            pair = (seen[r.h], r.text)
            break
        seen[r.h] = r.text
    rows = [(1, pair[0]), (5, pair[0]), (5, pair[1]), (None, pair[1]), (None, "c" * 120), (None, pair[1]), (9, None)]
    for most in (500_000, 0):
        monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", most)
        got = substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tag", F.lit(1)).withColumn("k", F.lit("x"))).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.kept), sum(s.end - s.start for s in r.spans)) for r in got) == brute(rows, 100)


def test_empty_table(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string, kept int")).count() == 0


def test_column_construction_equals_sorted_suffixes():
    rng = random.Random(1)
    for _ in range(100):
        strings = [bytes(rng.choice(b"ab"[: rng.randint(1, 2)]) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 8))]
        bwt, common, owner, size = column_bwt.build([np.frombuffer(s, dtype=np.uint8) for s in strings])
        suffixes = [strings[i][len(strings[i]) - n :] for i, n in zip(owner, size, strict=True)]
        assert suffixes == sorted(suffixes) and len(suffixes) == sum(map(len, strings)) + len(strings)
        for a, b, c in zip(suffixes, suffixes[1:], common[1:], strict=False):
            n = 0
            while n < min(len(a), len(b)) and a[n] == b[n]:
                n += 1
            assert n == c
        for i, n, x in zip(owner, size, bwt, strict=True):
            assert x == (0 if n == len(strings[i]) else strings[i][len(strings[i]) - n - 1] + 1)
