import base64
import gzip
import hashlib
import io
import os
import random

import pytest

from millrace.llm import common, warc

SCHEMA = "page_id long, url string, html string"


def expected(rows, least=0):
    """(page_id, url, payload) to (page_id, payload_bytes, digest, type, refers_to), all rows compared with all."""
    out, kept = [], set()
    bodies = [(i, u, (h or "").encode()) for i, u, h in rows]
    rank = lambda i, u: (i is not None, i or 0, u is not None, u or "")
    for i, u, body in bodies:
        best = max((rank(j, v), j, v) for j, v, other in bodies if other == body)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        alone = len(body) < least or (rank(i, u) == best[0] and (body, best[0]) not in kept)
        kept.add((body, rank(i, u)))
        out.append((i, len(body), digest, "response" if alone else "revisit", None if alone else best[1]))
    return sorted(out, key=str)


def written(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    to = common.folder(spark, "warc-test")
    manifest = warc.write_warc(df, to, **kw)
    got = sorted([tuple(r) for r in warc.read_warc(spark, to).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=str)
    return to, manifest.collect(), got


def pages(seed=1, n=300):
    rng = random.Random(seed)
    rows = [(k, rng.choice([f"http://h{k % 7}.org/ü {k}", None, "http://x/"]), rng.choice(["", None, "<p>same</p>", f"<p>{rng.random()}</p>" * rng.randint(1, 200)])) for k in range(n)]
    # rows that repeat, ids that repeat with other payloads, no id
    return rows + rows[:20] + [(5, "http://other/", "<p>same</p>"), (7, None, "x"), (7, None, "y"), (None, "http://n/", "<p>same</p>"), (None, None, "z"), (None, None, "z")] + [(400, "http://h/", "hot")] * 3000


def test_records_equal_brute_force(spark):
    rows = pages()
    for least in (0, 12):
        _, _, got = written(spark, rows, least=least)
        assert got == expected(rows, least)


def test_files_do_not_depend_on_partitions_and_roll(spark):
    rows = pages(2)
    folders = []
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame(order, SCHEMA).repartition(3 if order is rows else 11)
        to = common.folder(spark, "warc-test")
        folders.append((to, warc.write_warc(df, to, shard_bytes=1 << 18, roll_bytes=1 << 14).orderBy("name").collect()))
    (one, a), (other, b) = folders
    assert a == b and len({r.shard for r in a}) > 4 and max(r.part for r in a) > 0
    assert sum(r.records for r in a) == len(rows)
    before = ""
    for r in a:
        data = open(f"{one.removeprefix('file:')}/{r.name}", "rb").read()
        assert data == open(f"{other.removeprefix('file:')}/{r.name}", "rb").read() and len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256
        ids = [int(h["warc-page-id"]) for h, _ in warc.parse(io.BytesIO(gzip.decompress(data))) if "warc-page-id" in h]
        assert ids == sorted(ids) and before < r.name
        before = r.name
    assert set(os.listdir(one.removeprefix("file:"))) - {"_manifest"} == {r.name for r in a}


def test_headers_are_those_of_the_format(spark):
    to, manifest, _ = written(spark, [(1, "http://a/ü\r\nx", "päge"), (2, "http://b/", "päge"), (3, None, None)])
    records = [r for m in manifest for r in warc.parse(gzip.open(f"{to.removeprefix('file:')}/{m.name}"))]
    assert [h["warc-type"] for h, _ in records] == ["warcinfo", "revisit", "response", "response"]
    info, revisit, response, empty = records
    assert response[1].endswith(b"\r\n\r\n" + "päge".encode()) and b"Content-Length: 5\r\n" in response[1] and revisit[1].endswith(b"\r\n\r\n")
    assert revisit[0]["warc-refers-to"] == response[0]["warc-record-id"] and revisit[0]["warc-refers-to-target-uri"] == "http://b/" and revisit[0]["warc-profile"] == warc.REVISIT
    assert revisit[0]["warc-target-uri"] == "http://a/%C3%BC%0D%0Ax" and "warc-target-uri" not in empty[0]
    assert len({h["warc-record-id"] for h, _ in records}) == 4
    body = warc.read_warc(spark, to, with_payload=True).where("page_id = 2").first()
    assert body.payload.decode() == "päge" and body.uri == "http://b/"


def test_only_the_manifest_counts(spark):
    """Files that a lost attempt has left are no part of the archive; a folder is written once; changed bytes are noticed."""
    rows = pages(3, 40)[:40]
    to, manifest, got = written(spark, rows)
    local = to.removeprefix("file:")
    with open(f"{local}/shard-99999-00000.warc.gz", "wb") as f:
        f.write(b"left over")
    assert warc.read_warc(spark, to).count() == len(rows)
    with pytest.raises(Exception, match="manifest"):
        warc.write_warc(spark.createDataFrame(rows, SCHEMA), to)
    name = f"{local}/{manifest[0].name}"
    record = gzip.decompress(open(name, "rb").read()).replace(b"<p>0", b"<p>1")
    os.chmod(name, 0o644)
    with open(name, "wb") as f:
        f.write(gzip.compress(record))
    with pytest.raises(Exception, match="digest"):
        warc.read_warc(spark, to).collect()


def test_renaming_again_is_harmless(tmp_path):
    import pyarrow as pa

    (tmp_path / "t").write_bytes(b"abc")
    batch = pa.RecordBatch.from_pydict({"temporary": ["t"], "name": ["final"], "bytes": [3]})
    for _ in range(2):
        list(warc._rename(iter([batch]), str(tmp_path)))
        assert (tmp_path / "final").read_bytes() == b"abc"


def test_empty_table_and_clashing_columns(spark):
    assert written(spark, [])[1:] == ([], [])
    df = spark.createDataFrame([(1, "u", "x")], SCHEMA).selectExpr("*", "1 AS copy", "2 AS sha", "3 AS shard", "4 AS payload", "5 AS n", "6 AS keeper")
    to = common.folder(spark, "warc-test")
    warc.write_warc(df, to)
    assert warc.read_warc(spark, to).count() == 1
