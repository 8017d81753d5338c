"""A deterministic, sharded writer of WARC archives, and their reader.

Every page becomes one record. Of records with equal payloads (length and SHA-256) of at least so
many bytes, one is a response and the others revisit it, without the payload: the keeper is the one
with the largest page_id, then the largest url, then the first copy. Records are sorted by
(page_id, url, SHA-256, copy), nulls first. A first pass over digests alone sums the sizes in that
order, so that a shard's bounds depend on the rows only, not on how Spark deals them; a second one
sends each record to its shard, where a task writes it. Files roll once so many compressed bytes are
in them. Each record is a gzip member of its own with headers, ids and digests made anew from the
row, so equal tables give equal files, byte by byte.

Tasks write under temporary names that hold an attempt's number and return what they wrote. The
table of these rows has each shard once, whichever attempt ended first; its files are then renamed
and it becomes, by one rename, the folder's manifest. Readers go by the manifest alone.

Defined results: null html is an empty payload; a null page_id or url leaves its header out; page_id
is an integer; a url is percent-encoded where it is not printable ASCII; rows that repeat in id, url
and payload are copies, made from their count where there are several, the first being the keeper;
one payload is in memory at a time, several times over, with no other bound on its length; an empty
table gives a manifest without rows; columns beyond id, url and payload are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .common import hadoop, materialize

#: A shard's bytes before compression, at least, and the most shards: their bounds go to every task.
SHARD_BYTES, MOST_SHARDS = 256 << 20, 20_000
#: Compressed bytes at which a file ends.
ROLL_BYTES = 64 << 20
#: What a record's headers take, for the sums only.
HEADER_BYTES = 600
#: Copies of a row that one row of counts stands for.
COPIES = 1000
#: Bytes of tables that are broadcast.
BROADCAST_BYTES = 16 << 20
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
KEYS = ("page_id", "url", "sha", "copy")


def _same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for name in names:
        out = out & a[name].eqNullSafe(b[name])
    return out


def _small(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def _copied(rows: DataFrame) -> DataFrame:
    """Each row n times, numbered from 0 in `copy`; a large n is made of rows of COPIES each."""
    block = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / COPIES))))
    last = F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1
    return block.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES, last))).drop("block")


def _roles(rows: DataFrame, keepers: DataFrame, n: int) -> DataFrame:
    """rows with (is_kept, ref_id, ref_url): what each revisits, null where it is a response."""
    k = _small(keepers, n, 200).select(F.col("sha").alias("k_sha"), "keeper")
    own = F.col("keeper.page_id").eqNullSafe(F.col("page_id")) & F.col("keeper.url").eqNullSafe(F.col("url")) & (F.col("copy") == 0)
    met = rows.join(k, rows["sha"] == k["k_sha"], "left").withColumn("is_kept", F.col("k_sha").isNull() | own)
    ref = lambda c: F.when(~F.col("is_kept"), F.col(f"keeper.{c}"))
    return met.select(*rows.columns, "is_kept", ref("page_id").alias("ref_id"), ref("url").alias("ref_url"))


def _bounds(rows: DataFrame, shard_bytes: int) -> list[tuple]:
    """The first key of each shard but the first: rows' sizes are summed in the order of their keys, whatever the partitions."""
    sized = rows.select(*KEYS, (F.lit(HEADER_BYTES) + F.when(F.col("is_kept"), F.col("n_bytes")).otherwise(0)).alias("size"))
    dealt = materialize(sized.repartitionByRange(*KEYS).withColumn("part", F.spark_partition_id()), "sizes")
    sums = {r.part: r.size for r in dealt.groupBy("part").agg(F.sum("size").alias("size")).collect()}
    total, before = 0, {}
    for part in sorted(sums):
        before[part], total = total, total + sums[part]
    target = max(shard_bytes, -(-total // MOST_SHARDS))
    if total <= target:
        return []
    offset = F.element_at(F.create_map(*[F.lit(v) for kv in before.items() for v in kv]), F.col("part"))
    up_to = F.sum("size").over(Window.partitionBy("part").orderBy(*KEYS).rowsBetween(Window.unboundedPreceding, -1))
    shard = F.floor((offset + F.coalesce(up_to, F.lit(0))) / target)
    firsts = dealt.select(*KEYS, shard.alias("shard")).groupBy("shard").agg(F.min(F.struct(*KEYS)).alias("key")).where("shard > 0")
    return sorted(_order(*r.key) for r in firsts.collect())


def _order(page_id: int | None, url: str | None, sha: bytes, copy: int) -> tuple:
    """A key as Spark orders it: nulls first, strings as their bytes, which is by code points."""
    return page_id is not None, page_id or 0, url is not None, url or "", bytes(sha), copy


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha: bytes, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, repr((page_id, url, sha.hex(), copy)))}>"


def _uri(url: str) -> str:
    return quote(url, safe="".join(map(chr, range(33, 127))))


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, sha: bytes, copy: int, n_bytes: int, digest: str, payload: bytes | None, ref_id: int | None, ref_url: str | None, date: str) -> bytes:
    """A response with its payload, or without one a revisit of another record's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    headers: list[tuple[str, object]] = [("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id, url, sha, copy)), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _uri(url))] if url is not None else []
    headers += [("WARC-Page-ID", page_id)] if page_id is not None else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"), ("Content-Type", "application/http; msgtype=response")]
    if payload is None:
        headers += [("WARC-Profile", REVISIT), ("WARC-Refers-To", record_id(ref_id, ref_url, sha, 0)), ("WARC-Refers-To-Date", date)]
        headers += [("WARC-Refers-To-Target-URI", _uri(ref_url))] if ref_url is not None else []
        headers += [("WARC-Refers-To-Page-ID", ref_id)] if ref_id is not None else []
    return _record(headers, block)


def _member(record: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(record) + packed.flush()


class _Files:
    """The files of one shard, under the names of one attempt."""

    def __init__(self, folder: str, date: str, roll: int) -> None:
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(folder)
        self.attempt, self.date, self.roll = uuid.uuid4().hex, date, roll
        self.fs.create_dir(f"{self.root}/_temporary", recursive=True)
        self.done: list[tuple] = []
        self.out = None

    def add(self, shard: int, record: bytes, page_id: int | None) -> None:
        if self.out and self.shard != shard:
            self.close()
        if not self.out:
            part = self.done[-1][1] + 1 if self.done and self.done[-1][0] == shard else 0
            self.shard, self.part, self.name = shard, part, f"shard-{shard:05d}-{part:05d}.warc.gz"
            self.temporary = f"_temporary/{self.attempt}-{self.name}"
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary}", compression=None)
            self.records, self.bytes, self.sum, self.ids = 0, 0, hashlib.sha256(), []
            about = f"software: millrace\r\nformat: {VERSION}\r\n".encode()
            first = uuid.uuid5(uuid.NAMESPACE_URL, self.name)
            self._put(_member(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{first}>"), ("WARC-Date", self.date), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], about)))
        self._put(_member(record))
        self.records += 1
        if self.bytes >= self.roll:
            self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sum.update(data)
        self.bytes += len(data)

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.sum.hexdigest()))
            self.out = None


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str, roll: int) -> Iterator[list]:
    files = _Files(folder, date, roll)
    for batch in batches:
        for k in range(len(batch)):
            shard, page_id, url, sha, copy, n_bytes, sha1, payload, ref_id, ref_url = (c[k].as_py() for c in batch.columns)
            digest = base64.b32encode(bytes.fromhex(sha1)).decode()
            files.add(shard, page_record(page_id, url, sha, copy, n_bytes, digest, payload, ref_id, ref_url, date), page_id)
    files.close()
    if files.done:
        yield [list(c) for c in zip(*files.done, strict=True)]


def _rename(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[list]:
    """A task that runs again finds what it has renamed before."""
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for batch in batches:
        for temporary, name, size in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if fs.get_file_info(f"{root}/{temporary}").type != pyarrow.fs.FileType.NotFound:
                fs.move(f"{root}/{temporary}", f"{root}/{name}")
            if fs.get_file_info(f"{root}/{name}").size != size:
                raise OSError(f"{name} is not as it was written")
        yield [batch.column(k) for k in (1, 2)]


_FILE = "shard int, part int, temporary string, name string, records bigint, bytes bigint, sha256 string"


def write_warc(pages: DataFrame, folder: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write pages as archives into a new folder that all machines share; the manifest: (shard, part, name, records, bytes, sha256).

    Payloads of fewer than `least` bytes are always responses.
    """
    spark = pages.sparkSession
    body = F.coalesce(pages[html].cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(pages[key].cast("bigint").alias("page_id"), pages[url].alias("url"), body.alias("payload")).withColumn("sha", F.unhex(F.sha2("payload", 256))).withColumn("n_bytes", F.octet_length("payload").cast("bigint"))
    own = ("page_id", "url", "sha")
    distinct = materialize(rows.groupBy(*own, "n_bytes").agg(F.count("*").alias("n")), "digests")
    keepers = distinct.where(F.col("n_bytes") >= least).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("keeper"), F.sum("n").alias("copies")).where("copies > 1").drop("copies")
    keepers = materialize(keepers, "keepers")
    several = materialize(distinct.where("n > 1"), "several")
    n_keepers, n_several = keepers.count(), several.count()
    bounds = _bounds(_roles(_copied(distinct), keepers, n_keepers), shard_bytes)

    once = rows
    if n_several:
        again = _small(several, n_several, 200)
        once = rows.join(again, _same(rows, again, *own), "left_anti")
        bodies = rows.join(again, _same(rows, again, *own), "left_semi").groupBy(*own, "n_bytes").agg(F.first("payload").alias("payload"))
        counted = bodies.join(several.select(*own, "n"), _same(bodies, several, *own)).select(*(bodies[c] for c in bodies.columns), "n")
        once = once.withColumn("copy", F.lit(0).cast("bigint")).unionByName(_copied(counted).drop("n"))
    else:
        once = once.withColumn("copy", F.lit(0).cast("bigint"))

    @F.arrow_udf("int")
    def shard_of(page_id: pa.Array, url: pa.Array, sha: pa.Array, copy: pa.Array) -> pa.Array:
        found = zip(*(c.to_pylist() for c in (page_id, url, sha, copy)), strict=True)
        return pa.array([bisect_right(bounds, _order(*k)) for k in found], type=pa.int32())

    shards = len(bounds) + 1
    records = _roles(once.withColumn("sha1", F.sha1("payload")), keepers, n_keepers).withColumn("payload", F.when(F.col("is_kept"), F.col("payload")))
    records = records.withColumn("shard", shard_of(*KEYS) if bounds else F.lit(0))
    dealt = records.repartitionById(shards, "shard").sortWithinPartitions("shard", *KEYS)
    dealt = dealt.select("shard", *KEYS, "n_bytes", "sha1", "payload", "ref_id", "ref_url")
    files = materialize(map_batches(dealt, _write, _FILE, folder, date, roll_bytes), "files")
    named = map_batches(files.select("temporary", "name", "bytes").repartition(max(1, min(shards, spark.sparkContext.defaultParallelism))), _rename, "name string, bytes bigint", folder)
    return _commit(files.drop("temporary").join(named.select("name"), "name"), folder)


def _commit(manifest: DataFrame, folder: str) -> DataFrame:
    spark = manifest.sparkSession
    new = f"{folder}/_temporary/manifest-{uuid.uuid4().hex}"
    manifest.coalesce(1).write.parquet(new)
    fs, path = hadoop(spark, new)
    _, to = hadoop(spark, f"{folder}/_manifest")
    if fs.exists(to) or not fs.rename(path, to):
        raise FileExistsError(f"{folder} has a manifest already")
    _, rest = hadoop(spark, f"{folder}/_temporary")
    fs.delete(rest, True)
    return spark.read.schema(manifest.schema).parquet(f"{folder}/_manifest")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) for each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record starts with {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) != int(headers["content-length"]):
            raise ValueError("a record is cut short")
        yield headers, block


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[list]:
    fs, root = pyarrow.fs.FileSystem.from_uri(folder)
    for batch in batches:
        for name in batch.column(0).to_pylist():
            held: list[tuple] = []
            weight = 0
            with fs.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                for headers, block in parse(stream):
                    kind = headers["warc-type"]
                    if kind == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    digest = headers["warc-payload-digest"].removeprefix("sha1:")
                    length = int(re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http).group(1))
                    if headers["warc-block-digest"].removeprefix("sha1:") != base32_sha1(block):
                        raise ValueError(f"{name}: a block has another digest than its header")
                    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError(f"{name}: a payload has another digest or length than its header")
                    number = lambda h: int(headers[h]) if h in headers else None  # noqa: B023, E731
                    held.append((number("warc-page-id"), headers.get("warc-target-uri"), headers["warc-record-id"], length, digest, kind, number("warc-refers-to-page-id"), headers.get("warc-refers-to"), payload if with_payload and kind == "response" else None))
                    weight += len(payload) if with_payload else 0
                    if len(held) >= 1000 or weight >= 1 << 22:
                        yield [list(c) for c in zip(*held, strict=True)]
                        held, weight = [], 0
            if held:
                yield [list(c) for c in zip(*held, strict=True)]


def read_warc(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """(page_id, uri, record_id, payload_bytes, payload_digest, record_type, refers_to, refers_to_id, payload): the records of the manifest's files, their digests checked, a file a task."""
    files = spark.read.parquet(f"{folder}/_manifest").select("name", "bytes")
    # a task has files of about ROLL_BYTES together
    rows, total = files.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    tasks = max(1, min(rows, max(spark.sparkContext.defaultParallelism, -(-total // ROLL_BYTES))))
    schema = "page_id bigint, uri string, record_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, refers_to_id string, payload binary"
    return map_batches(files.select("name").repartition(tasks, "name"), _read, schema, folder, with_payload)
