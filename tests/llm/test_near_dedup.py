import itertools
import random
from collections import Counter

import numpy as np
import pytest

from millrace.llm import prob_minhash


def bag(text):
    w = (text or "").lower().split()
    if not w:
        return Counter()
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])


def likeness(a, b):
    out = 0.0
    for d in a.keys() & b.keys():
        out += 1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys())
    return out


def brute(rows, threshold=0.8):
    bags = {k: bag(t) for k, t in rows if k is not None}
    parent = {k: k for k in bags}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(bags), 2):
        if bags[a] and bags[b] and likeness(bags[a], bags[b]) >= threshold:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in bags}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, k = [], 0
    for group in range(8):
        base = make(rng.choice([6, 40, 200, 700]))
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 60))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "  \n"), (k + 3, "one two"), (k + 4, "One  Two"), (k + 5, "two one"), (k + 6, "a b " * 300), (k + 7, "a b " * 290)]
    rows += [rows[0], (k + 8, rows[3][1]), (k + 9, " ".join(make(20_000)))]
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus()
    random.Random(0).shuffle(rows)
    got = prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.n_class == sizes[r.class_id] for r in got)


def test_long_chain_of_near_copies(spark):
    """Each text is close to the next only: the links of neighbours must join all into one class."""
    words = [f"v{i}" for i in range(260)]
    rows = [(i, " ".join(words[i * 4 : i * 4 + 100])) for i in range(30)]
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_large_group_and_one_heavy_pivot(spark, monkeypatch):
    monkeypatch.setattr(prob_minhash, "PARTS", 16)
    rng = random.Random(5)
    base = [f"x{i}" for i in range(150)]
    rows = []
    for i in range(300):
        w = list(base)
        w[rng.randrange(150)] = f"y{i}"
        rows.append((1000 - i, " ".join(w)))
    got = prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {701} and {r.n_class for r in got} == {300}


def test_null_keys_empty_tables_and_other_columns(spark):
    docs = spark.createDataFrame([(None, "a b c d e f", 1), (2, "a b c d e f", None), (3, "A b c  d e f", 3)], "doc_id long, text string, rep int")
    assert {(r.doc_id, r.class_id) for r in prob_minhash.classes(docs).collect()} == {(None, None), (2, 2), (3, 2)}
    kept = prob_minhash.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {None, 2}
    assert prob_minhash.classes(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_signatures_estimate_the_similarity(seed):
    rng = np.random.default_rng(seed)
    u = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
    a = (u, rng.integers(1, 4, len(u)))
    keep = rng.random(len(u)) < 0.8
    b = (u[keep], np.maximum(1, a[1][keep] + rng.integers(-1, 2, keep.sum())))
    sig = prob_minhash.signatures([a, b], 4000)
    assert abs((sig[0] == sig[1]).mean() - prob_minhash.similarity(a, b)) < 0.04
    x, y = (Counter(dict(zip(s[0].tolist(), s[1].tolist(), strict=True))) for s in (a, b))
    assert abs(likeness(x, y) - prob_minhash.similarity(a, b)) < 1e-9


def borderline(q=17, planted=12):
    """Texts of which any two are likely candidates, at 0.75 or a little more, and some pairs that reach 0.8."""
    base = [f"b{i}" for i in range(5 * q * 6)]
    slots = {(a, b): [(r, (a * r + b) % q) for r in range(6)] for a in range(q) for b in range(q)}
    place = lambda r, c: 5 * (r * q + c)
    stretch = base[: place(4, q - 1) + 5]
    texts = []
    for k, line in enumerate(sorted(slots)[:200]):
        w = list(stretch)
        for r, c in slots[line][:5] + [(0, (7 * k + 3) % q)]:
            w[place(r, c) + 2] = f"t{k}r{r}c{c}"
        texts.append(w)
    for k in range(planted):
        w = list(texts[10 * k])
        changed = [i for i, v in enumerate(w) if v != stretch[i]]
        for i in changed[2:]:
            w[i] = stretch[i]
        for r in range(4):
            w[place(r, (5 * k + 3 * r + 1) % q) + 2] = f"p{k}r{r}"
        texts.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(texts)]


def joined(rows, linked):
    """Classes, where linked(a, b) tells whether rows of these numbers have a link."""
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {rows[k][0]: rows[root(k)][0] for k in range(len(rows))}


def test_links_beyond_the_most_agreeing_members(spark):
    rows = borderline()
    sets = [set(bag(t)) for _, t in rows]
    want = joined(rows, lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    assert len(set(want.values())) < len(rows)
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


@pytest.mark.parametrize("block", [256, 16])
def test_all_pairs_of_a_band_are_compared(spark, monkeypatch, block):
    """With two bands of one register, no pair agrees in as many bands as rounds ask for; the classes are those of all pairs that share one."""
    monkeypatch.setattr(prob_minhash, "BLOCK", block)
    monkeypatch.setattr(prob_minhash, "PART", 4 * block)
    rows = borderline() + [(1000 + k, "a b c d e f g " * (20 + k)) for k in range(12)]
    sets = prob_minhash.weighted([t for _, t in rows])
    sig = prob_minhash.signatures(sets, 2)
    assert max(Counter(sig[:, 0].tolist()).values()) > 8
    want = joined(rows, lambda a, b: (sig[a] == sig[b]).any() and prob_minhash.similarity(sets[a], sets[b]) >= 0.8)
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), bands=2, rows=1).collect()}
    assert got == want


def test_classes_do_not_rest_on_the_round(spark, monkeypatch):
    """With a round that finds no link at all, the classes are still those of all pairs."""

    def none(batches, best, block):
        for _ in batches:
            yield [[], []]

    monkeypatch.setattr(prob_minhash, "_neighbours", none)
    monkeypatch.setattr(prob_minhash, "FEW", 1)
    rows = borderline()
    sets = [set(bag(t)) for _, t in rows]
    want = joined(rows, lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def edited(n, changes, seed, words=220):
    """n copies of one text, each with some words changed."""
    rng = random.Random(seed)
    base = [f"m{i}" for i in range(words)]
    rows = []
    for k in range(n):
        w = list(base)
        for i in rng.sample(range(words), rng.choice(changes)):
            w[i] = f"e{k}x{i}"
        rows.append((k, " ".join(w)))
    return rows


@pytest.mark.parametrize(("n", "changes"), [(900, [3, 4, 5]), (400, [2, 3, 4, 5, 6]), (400, [3, 4, 4, 5, 5, 5])])
def test_edited_copies_at_the_threshold(spark, n, changes):
    """Most pairs of these are just below the threshold or just above; no link is lost, and no class is wrong."""
    rows = edited(n, changes, seed=len(changes))
    sets = prob_minhash.weighted([t for _, t in rows])
    _, ids = np.unique(np.concatenate([u for u, _ in sets]), return_inverse=True)
    has = np.zeros((n, ids.max() + 1), dtype=np.float32)
    has[np.repeat(np.arange(n), [len(u) for u, _ in sets]), ids] = 1
    size, both = has.sum(axis=1), has @ has.T
    near = both / (size[:, None] + size[None, :] - both) >= 0.8 - 1e-6
    want = joined(rows, lambda a, b: near[a, b])
    assert 20 < len(set(want.values())) < n
    got = {r.doc_id: r.class_id for r in prob_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
