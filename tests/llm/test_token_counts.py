import math
import random

import public_tokenizers
import pytest

from millrace.llm import token_counts as T


def plain(pieces, word):
    """The tokens of the best segmentation by (score, tokens), kept apart, over all last pieces. Scores are worked out here from the ranks."""
    total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
    cost = lambda r: round(1e4 * (math.log(r + 1) + total))
    unknown, longest = cost(len(pieces) + 1), max(map(len, pieces))
    best = [(0, 0)]
    for n in range(1, len(word) + 1):
        found = []
        if word[n - 1] not in pieces:
            size = len(word[n - 1].encode())
            found.append((best[n - 1][0] + size * unknown, best[n - 1][1] + size))
        for k in range(1, min(n, longest) + 1):
            r = pieces.get(word[n - k : n])
            if r is not None:
                found.append((best[n - k][0] + cost(r), best[n - k][1] + 1))
        best.append(min(found))
    return best[-1][1]


@pytest.fixture(scope="module")
def pieces():
    return {p: r for r, p in enumerate(dict.fromkeys(T.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))))}


def test_trie_and_plain_agree(pieces):
    rng = random.Random(2)
    trie = T.Trie(T.Unigram(pieces))
    words = ["▁" + "".join(rng.choice("etaoinshr日é\U0001f642") for _ in range(rng.randint(0, 90))) for _ in range(500)]
    assert [trie.insert(w) for w in words] == [plain(pieces, w) for w in words]
    assert trie.steps == len(trie.forward) - 1 < sum(map(len, words))
    long = "▁" + "".join(rng.choice("abcdefgh") for _ in range(5000))
    assert trie.insert(long) == plain(pieces, long) and trie.insert(long) == trie.insert(long)
    assert trie.steps < sum(map(len, words)) + T.DEPTH + 1


def test_counts_of_very_long_words(pieces):
    """Tokens do not reach into the scores: not for 6,000,000 unknown characters of three bytes, nor for a string of the greatest size."""
    model = T.Unigram(pieces)
    assert -(18_000_000 * model.byte) % T.TOKEN == 18_000_000 and -((1 << 31) * model.byte) % T.TOKEN == 1 << 31
    assert "\ue000" not in pieces
    assert T.Trie(model).insert("\ue000" * 200_000) == 600_000


def test_counts_by_row(spark, pieces):
    rng = random.Random(5)
    vocabulary = ["the", "hanter", "étage", "x" * 300, "日本", "-", "a.b,c"]
    rows = [(k, " \n".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for k in range(60)] + [(60, None), (60, None), (None, "the a\x0bb c"), (62, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS n_pretokens", "3 AS k")
    got = T.count_tokens(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    want = [(k, sum(plain(pieces, T.MARK + w) for w in T._WORDS.findall(t or "")), len(T._WORDS.findall(t or ""))) for k, t in rows]
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={k}, n_tokens={n}, n_pretokens={p})" for k, n, p in want)
    assert T.count_tokens(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_bounds_change_no_count(monkeypatch):
    import pyarrow as pa

    texts = ["one two three four"] * 5 + ["five six seven"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], names=["k", "text"])
    full = [c for c in T._counted(iter([batch]), public_tokenizers.path("piece_bpe_32k.model"))]
    monkeypatch.setattr(T, "MOST_WORDS", 1)
    assert [c[1:] for c in T._counted(iter([batch]), public_tokenizers.path("piece_bpe_32k.model"))] == [c[1:] for c in full]
