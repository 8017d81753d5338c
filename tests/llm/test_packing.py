import random
import sys

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from millrace.llm import packing, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_are_those_of_the_tokenizers_library(spark):
    tokenizer = Tokenizer.from_file(PATH)
    encode = vocab.byte_encoder(PATH)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    texts += ["<|endoftext|> x<|endoftext|>", "\x00\x01 \u2028\u3000", "🙂" * 50, "a" * 5000, "  \n \t x", "I'LL we'll ٣٤ ½ e\u0301", "١٢٣abc_-"]
    for t in texts:
        assert encode(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def packed_well(rows, capacity=2048):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= capacity
    return len(bins)


def test_pack_round_trip(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gämma", "δ", "\n", "12"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 50, 500, 1500, 6000])))) for k in range(80)] + [(80, None), (81, ""), (None, "x y"), (90, "again"), (90, "again")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    packed_well(got)
    tokenizer = Tokenizer.from_file(PATH)
    want = sorted([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for k, t in rows if k != 90)
    pieces = {}
    for r in got:
        if r.doc_id != 90:
            pieces.setdefault(r.doc_id, []).append(r)
    found = []
    for own in pieces.values():
        own.sort(key=lambda r: r.piece)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist() and all(r.length == 2048 for r in own[1:])
        found.append(np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in own]).tolist())
    assert sorted(found) == want
    assert len([r for r in got if r.doc_id == 90]) == 2
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, uid int"), PATH).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "a b c"), (2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS piece", "3 AS start", "4 AS length", "5 AS ids", "6 AS bin")
    got = packing.pack(df, PATH)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"] and got.count() == 2


def test_regions_and_rounds(spark):
    rng = random.Random(2)
    lengths = [min(2048, int(rng.lognormvariate(6.3, 0.9)) + 1) for _ in range(6000)]
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    got = packing.assign(items, region_pieces=700).join(items, "uid").collect()
    assert sorted(r.uid for r in got) == list(range(6000))
    assert packed_well(got) <= -(-sum(lengths) // 2048) + 2


def hard(seed, n=300):
    rng = random.Random(seed)
    return [rng.choice([350, 683, 700, 900, 1100, 1366, 400]) for _ in range(n)]


def test_crossings_turn_random_packings_into_good_ones():
    """From random packings alone, on lengths of documents and on hard ones."""
    rng = random.Random(3)
    for lengths in ([min(2047, int(rng.lognormvariate(6.3, 0.9)) + 1) for _ in range(3000)], *map(hard, range(5))):
        order = list(range(len(lengths)))
        rng.shuffle(order)
        start = packing.best_fit(order, lengths, 2048)
        best, crossings, bound = packing.evolve(lengths, seed=rng.randint(0, 99))
        assert crossings > 0 and bound <= len(best) and packing.fitness(best, 2048) > packing.fitness(start, 2048)
        assert len(lengths) < 3000 or len(best) <= bound + 1 < len(start)
        assert sorted(i for _, m in best for i in m) == sorted(order)
        assert all(sum(lengths[i] for i in m) + room == 2048 and room >= 0 for room, m in best)


def test_bound_is_one():
    """Against the best of all packings of few pieces."""

    def least(lengths, rooms=()):
        if not lengths:
            return len(rooms)
        n, rest = lengths[0], lengths[1:]
        out = least(rest, (*rooms, 100 - n))
        for k, room in enumerate(rooms):
            if room >= n:
                out = min(out, least(rest, (*rooms[:k], room - n, *rooms[k + 1 :])))
        return out

    rng = random.Random(4)
    tight = 0
    for _ in range(150):
        lengths = [rng.randint(1, 100) for _ in range(rng.randint(1, 7))]
        found, bound = least(lengths), packing.least_bins(lengths, 100)
        assert bound <= found
        tight += bound == found
    assert tight > 120
    assert packing.least_bins([1100] * 10, 2048) == 10


def test_elites_cross_islands_and_none_is_worse_than_best_fit(spark, monkeypatch):
    seen = []
    real = packing.map_batches

    def spied(df, made, *args):
        if made is packing._island:
            seen.append([(r.island, r.source) for r in df.select("island", "source", "bin").where("bin >= 0").distinct().collect()])
        return real(df, made, *args)

    monkeypatch.setattr(packing, "map_batches", spied)
    lengths = hard(7, 400)
    items = spark.createDataFrame(list(enumerate(lengths)), "uid long, length long")
    got = packing.assign(items, generations=3).join(items, "uid").collect()
    falling = packing.best_fit(sorted(range(400), key=lambda i: -lengths[i]), lengths, 2048)
    assert packed_well(got) <= len(falling) and len(got) == 400
    assert seen[0] == [] and {(0, 0), (0, 1), (1, 0), (1, 1)} <= set(seen[1])


def test_documents_need_crossings_and_meet_the_bound(spark, monkeypatch):
    """From random packings alone, which crossings bring to the bound and nothing else does."""
    items = packing.tokenise(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), PATH).select("uid", "length")
    lengths = [r.length for r in items.where("length < 2048").collect()]
    for seed in range(5):
        best, crossings, bound = packing.evolve(lengths, seed=seed)
        assert crossings > 0 and len(best) == bound
    with monkeypatch.context() as m:
        m.setattr(packing, "cross", lambda one, *rest: one)
        assert all(len(packing.evolve(lengths, seed=seed)[0]) > bound for seed in range(5))
    assert packed_well(packing.assign(items).join(items, "uid").collect()) == items.where("length = 2048").count() + bound


def test_long_runs_of_white_space(spark):
    """Longer than tiktoken's pattern can go back over; the tokenizers library encodes them."""
    tokenizer = Tokenizer.from_file(PATH)
    rows = [(1, "a" + " " * 1_000_000 + "b"), (2, "\n" * 1_000_000), (3, "c")]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    packed_well(got)
    for k, text in rows:
        own = sorted((r for r in got if r.doc_id == k), key=lambda r: r.piece)
        assert np.concatenate([np.frombuffer(r.ids, dtype="<u4") for r in own]).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_best_fit_leaves_kept_bins_as_they_are():
    """Beside kept bins, each piece in the fullest bin with room, against a plain search; the kept ones, which other packings hold too, don't change."""
    rng = random.Random(11)
    length = [rng.randint(1, 60) for _ in range(300)]
    kept = packing.best_fit(range(100), length, 100)
    before = [(room, list(members)) for room, members in kept]
    got = packing.best_fit(range(100, 300), length, 100, kept)
    assert kept == before
    rooms = sorted(room for room, _ in kept)
    for n in length[100:]:
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 100) - n)
    assert sorted(r for r, _ in got) == sorted(rooms)
    assert sorted(i for _, m in got for i in m) == list(range(300)) and all(r == 100 - sum(length[i] for i in m) for r, m in got)


def test_falling_lengths_are_put_by_runs_as_one_at_a_time():
    """The same bins, beside others too, and a crossing keeps every piece once; steps are by lengths, not by pieces."""
    rng = random.Random(12)
    for _ in range(40):
        length = np.array(sorted((rng.randint(1, rng.choice([9, 100])) for _ in range(rng.randint(0, 200))), reverse=True), dtype=np.int64)
        room = np.array([rng.randint(0, 100) for _ in range(rng.randint(0, 30))], dtype=np.int64)
        placed, left = packing._refill(length, 100, room)
        one_by_one, want = packing._fill(length.tolist(), 100, room)
        assert sorted(left.tolist()) == sorted(want.tolist()) and len(placed) == len(one_by_one) == len(length)
        filled = np.bincount(np.array(placed, dtype=np.int64), weights=length, minlength=len(left))
        assert (filled + left == np.concatenate((room, np.full(len(left) - len(room), 100)))).all()
    steps = [0]

    def counted(frame, event, _):
        steps[0] += event == "line"
        return counted

    before = sys.gettrace()
    sys.settrace(counted)
    try:
        _, left = packing._refill(np.repeat([1500, 1200, 500], 20_000), 2048, np.empty(0, dtype=np.int64))
    finally:
        sys.settrace(before)
    assert len(left) == 40_000 and steps[0] < 20_000


def test_crossed_packings_hold_every_piece_once():
    rng = np.random.default_rng(13)
    length = np.sort(rng.integers(1, 900, 500))[::-1]
    made = []
    for _ in range(2):
        order, to = rng.permutation(500), np.empty(500, dtype=np.int64)
        to[order], room = packing._fill(length[order].tolist(), 1000, np.empty(0, dtype=np.int64))
        made.append((to, room))
    for _ in range(20):
        to, room = packing.cross(*made, length, 1000, rng)
        assert (np.bincount(to, weights=length, minlength=len(room)) + room == 1000).all() and (room >= 0).all() and np.bincount(to).min() > 0
        made = [made[1], (to, room)]


def test_no_random_packings_once_one_meets_the_bound(monkeypatch):
    monkeypatch.setattr(packing, "_fill", None)
    best, crossings, bound = packing.evolve([1024] * 10, falling=True)
    assert (len(best), crossings, bound) == (5, 0, 5)
