import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from .test_decontaminate import brute as leaks
from .test_models import fused
from .test_near_dedup import brute as classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_keep_the_columns(spark, steps):
    for before, after in steps[:-1]:
        assert after.columns == before.columns
        assert [f.dataType for f in after.schema] == [f.dataType for f in before.schema]


def test_each_stage_equals_brute_force(spark, steps):
    before, after = rows(steps[0][0]), rows(steps[0][1])
    assert len(after) >= 0.98 * len(before)
    _, judged = fused(spark, [(k, r.text, r.lang, r.source) for k, r in before.items()])
    good = {k for k, (logs, evidence) in judged.items() if evidence is not None and evidence >= 0.3 and np.exp(logs - logs.max()).sum() <= 2}
    open_ = {k for k, (_, evidence) in judged.items() if evidence is not None and abs(evidence - 0.3) < 1e-4}
    assert set(after) - open_ == good - open_
    before, after = rows(steps[1][0]), rows(steps[1][1])
    want = classes([(k, r.text) for k, r in before.items()])
    assert set(after) == set(want.values())
    before, after = rows(steps[2][0]), rows(steps[2][1])
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {d for d, _ in leaks([(k, r.text) for k, r in before.items()], items)}
    before, after = rows(steps[3][0]), rows(steps[3][1])
    assert set(before) == set(after)
    secret = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}""", re.I)
    for k, r in before.items():
        if not secret.search(r.text):
            assert after[k] == r
        else:
            assert not re.search("[0-9a-f]{24,}", after[k].text) and len(after[k].text) == after[k].n_chars


def test_packing_is_whole(steps):
    docs, packed = rows(steps[4][0]), steps[4][1].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, room = {}, {}
    for p in packed:
        pieces.setdefault(p.doc_id, []).append(p)
        room.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(pieces) == set(docs)
    for k, own in pieces.items():
        own.sort(key=lambda p: p.piece)
        ids = np.concatenate([np.frombuffer(p.ids, dtype="<u4") for p in own])
        assert ids.tolist() == [*tokenizer.encode(docs[k].text, add_special_tokens=False).ids, 0]
        assert [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert all(p.length == 2048 for p in own[1:]) and own[0].length <= 2048
    for own in room.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and sum(own[-1]) <= 2048


def test_run_gives_checksums(spark, steps):
    got = corpus_pipeline.run(spark, SF).collect()
    want = {(p.doc_id, p.piece): zlib.crc32(p.ids) for p in steps[4][1].collect()}
    assert {(p.doc_id, p.piece): p.ids_crc32 for p in got} == want and len(got) == len(want)
