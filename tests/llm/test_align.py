import hashlib
import random
from collections import Counter

import public_tokenizers
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from millrace.llm import align, vocab

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def byte_level():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def brute(texts):
    """All of it a token, a byte and a pair at a time."""
    tokenizer, pieces, byte = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B), byte_level()
    tokenizer.encode_special_tokens = True
    per_doc, docs_with = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            ids_a = tokenizer.encode(" " + text, add_special_tokens=False).ids
            ids_b = pieces.encode(text)
            bytes_a = [bytes(byte[c] for c in tokenizer.id_to_token(i)) for i in ids_a]
            names = [pieces.id_to_piece(i) for i in ids_b]
            bytes_b = [bytes([int(n[3:5], 16)]) if pieces.is_byte(i) else n.replace("▁", " ").encode() for i, n in zip(ids_b, names)]
            if b"".join(bytes_a) == (" " + text).encode() == b"".join(bytes_b):
                spans = []
                for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
                    at, own = 0, []
                    for i, p in zip(ids, parts):
                        own.append((at, at + len(p), i))
                        at += len(p)
                    spans.append(own)
                ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
                start = 0
                for end in ends:
                    groups.append([[i for s, e, i in own if start <= s and e <= end] for own in spans])
                    start = end
                links = [(i, j) for s, e, i in spans[0] for t, f, j in spans[1] if s < f and t < e]
        docs_with.update(set(links))
        per_doc.append((groups, links))
    best = {}
    for (a, _), n in docs_with.items():
        best[a] = max(best.get(a, 0), n)
    out = []
    for groups, links in per_doc:
        written = ";".join("|".join(",".join(map(str, side)) for side in g) for g in groups)
        digest = hashlib.sha256(written.encode()).hexdigest() if groups else ""
        out.append((sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links), sum(docs_with[p] == best[p[0]] for p in links), sum(docs_with[p] for p in links), digest))
    return out


def texts():
    rng = random.Random(1)
    words = ["alpha", "Bergström", "naïve", "12345", "foo_bar", "日本語", "🙂", "\n", "\t", "  ", "ing", "don't", "<|endoftext|>", "<s>", "</s>", "<0x41>", "xyzzyq", "%%%", "á"]
    out = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    return [*out, *out[:5], None, "", " ", "▁ is no space", "x", "  two", "end ", "\x00", "\r\n"]


def check(spark, own, **kw):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(own)], "doc_id long, text string")
    got = sorted(align.align(df, A, B, **kw).collect(), key=lambda r: r.doc_id)
    assert [(r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got] == brute(own)
    return got


def test_equals_brute_force(spark):
    got = check(spark, texts())
    assert sum(r.n_links > r.n_groups for r in got) > 20 and sum(r.n_a == 0 for r in got) >= 3


def test_counts_that_are_not_broadcast(spark):
    """With room for few pairs, or none, the rest are joined."""
    own = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    for most in (0, 40):
        check(spark, [t[:400] for t in own], heavy_pairs=most)


def test_long_texts_in_stretches():
    rng = random.Random(2)
    pieces = SentencePieceProcessor(model_file=B)
    encode = vocab.piece_encoder(B)
    words = ["word", "zwei", " ", "", "\n", "ñandú", "x" * 300, "1 000"]
    long = [" ".join(rng.choice(words) for _ in range(60_000)), "y" * 200_000, " " * 100_000, "a" * 70_000 + " ", "a " * 40_000]
    assert all(len(vocab.stretches(t)) > 1 for t in (long[0], long[4]))
    for text, found in zip(long, encode(long), strict=True):
        assert found.tolist() == pieces.encode(text)


def test_a_long_run_of_white_space(spark):
    for fill in (" ", "\n"):
        text = "a" + fill * 300_000 + "b"
        row = align.align(spark.createDataFrame([(1, text)], "doc_id long, text string"), A, B).first()
        assert row.n_a > 0 and row.n_links >= row.n_groups > 0


def test_null_keys_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "one two"), (1, "one two"), (1, "one two"), (2, None)], "doc_id long, text string").selectExpr("*", "1 AS uid", "2 AS pair", "3 AS n_a", "4 AS twin", "5 AS n")
    got = align.align(df, A, B).collect()
    assert len(got) == 4 and sorted(r.count_sum for r in got)[0] == 0 and all(r.count_sum == 3 * r.n_links for r in got)
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), A, B).count() == 0


def test_twins_prefer_pieces_to_single_bytes():
    found = align.twins([b"a", b"b", b"cc", b""], [b"a", b"b", b"a", b"cc", b""])
    assert found.tolist() == [2, 1, 3, -1]
