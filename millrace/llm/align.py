"""Alignment of two tokenizers over a corpus: groups of tokens that cover the same bytes, and counts of linked ids.

Both vocabularies' tokens cover the same bytes, so their ends cut a text into stretches; each stretch
lies in one token of either side, which is a link, and where both end at once a group ends.

An id of A that has an id of B with the same bytes is its twin's partner: the map of all of them is an
array as long as A's vocabulary. Links of twins, which is what all one-to-one groups of the same bytes
are, are counted in vectors of that length, one a task. Only other pairs, out of irregular groups,
are counted by a shuffle. How many documents hold a pair, and whether that is the most of its A id, goes
back to the documents: from the vectors for twins, from a broadcast table for the pairs in most
documents, of which there are at most HEAVY_PAIRS, and by a join for the rest, in which no key is hot.

Defined results: a text that is null, empty, or whose tokens' bytes are not the text with a space
before it has no tokens: zeros and an empty digest. Every row is a document: repeated rows and
null keys count each for itself. Ties for an A id's highest count all win. A text of any length is
tokenised whole, at some 200 bytes of a worker for each of its bytes. An empty table gives no rows; columns beyond
key and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from .arrow import map_batches, slices
from .common import materialize
from .vocab import byte_encoder, byte_tokens, piece_encoder, piece_tokens

#: Pairs that are broadcast with their counts: some 24 bytes each.
HEAVY_PAIRS = 500_000
#: A pair is a * SHIFT + b.
SHIFT = 1 << 32


def twins(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """For each A id the B id with the same bytes, the one that is no single byte's stand-in if there are two; -1: none."""
    by_bytes: dict[bytes, int] = {}
    for k, token in enumerate(b):
        if token:
            by_bytes[token] = k
    return np.array([by_bytes.get(token, -1) if token else -1 for token in a], dtype=np.int64)


class _Names:
    """Each id's decimal with what may follow it."""

    def __init__(self, n: int, within: str, after: str) -> None:
        self.within = np.array([f"{k}{within}" for k in range(n)], dtype=object)
        self.after = np.array([f"{k}{after}" for k in range(n)], dtype=object)

    def __call__(self, ids: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.where(last, self.after[ids], self.within[ids])


def _runs(group: np.ndarray, n: int) -> np.ndarray:
    """How many tokens are in the groups up to each."""
    return np.cumsum(np.bincount(group, minlength=n))


def aligned(ids_a: np.ndarray, ids_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(linked A ids, linked B ids, group of each A token, group of each B token) of two tokenisations of the same bytes."""
    end_a, end_b = np.cumsum(size_a[ids_a]), np.cumsum(size_b[ids_b])
    ends = np.union1d(end_a, end_b)
    both = np.intersect1d(end_a, end_b, assume_unique=True)
    return ids_a[np.searchsorted(end_a, ends)], ids_b[np.searchsorted(end_b, ends)], np.searchsorted(both, end_a), np.searchsorted(both, end_b)


def _written(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, a: _Names, b: _Names) -> str:
    """The groups as `a1,a2|b1;a3|b2,b3`."""
    n = group_a[-1] + 1
    upto_a, upto_b = _runs(group_a, n), _runs(group_b, n)
    out = np.empty(len(ids_a) + len(ids_b), dtype=object)
    # before an A token are the B tokens of earlier groups, before a B token the A tokens of its own group too
    out[np.arange(len(ids_a)) + upto_b[group_a] - np.bincount(group_b, minlength=n)[group_a]] = a(ids_a, np.append(group_a[1:] != group_a[:-1], True))
    out[np.arange(len(ids_b)) + upto_a[group_b]] = b(ids_b, np.append(group_b[1:] != group_b[:-1], True))
    return "".join(out)[:-1]


def _linked(batches: Iterator[pa.RecordBatch], path_a: str, path_b: str) -> Iterator[list]:
    tokens_a, tokens_b = byte_tokens(path_a), piece_tokens(path_b)
    encode_a, encode_b = byte_encoder(path_a, special=False), piece_encoder(path_b)
    size_a, size_b = (np.array([len(t) for t in tokens], dtype=np.int64) for tokens in (tokens_a, tokens_b))
    twin = twins(tokens_a, tokens_b)
    names_a, names_b = _Names(len(tokens_a), ",", "|"), _Names(len(tokens_b), ",", ";")
    none = np.array([], dtype=np.int64)
    for batch in batches:
        for part in slices(batch):
            texts = [t or "" for t in part.column(1).to_pylist()]
            out: list[list] = [[] for _ in range(9)]
            for text, ids_b in zip(texts, encode_b(texts), strict=True):
                row = (0, 0, 0, 0, "", none, none, none, none)
                if text:
                    want = f" {text}".encode()
                    ids_a = encode_a(f" {text}").astype(np.int64)
                    if b"".join([tokens_a[i] for i in ids_a.tolist()]) == want and b"".join([tokens_b[i] for i in ids_b.tolist()]) == want:
                        a, b, group_a, group_b = aligned(ids_a, ids_b, size_a, size_b)
                        same = twin[a] == b
                        ones, n_ones = np.unique(a[same], return_counts=True)
                        pairs, n_pairs = np.unique(a[~same] * SHIFT + b[~same], return_counts=True)
                        digest = hashlib.sha256(_written(ids_a, ids_b, group_a, group_b, names_a, names_b).encode()).hexdigest()
                        row = (len(ids_a), len(ids_b), int(group_a[-1]) + 1, len(a), digest, ones, n_ones, pairs, n_pairs)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield [part.column(0), *out]


def _vectors(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list]:
    """In how many of a task's documents each A id is linked with its twin."""
    held = np.zeros(size, dtype=np.int64)
    for batch in batches:
        held += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
    at = np.flatnonzero(held)
    if len(at):
        yield [pa.array(at), pa.array(held[at])]


def _twin_sums(batches: Iterator[pa.RecordBatch], counts: np.ndarray, best: np.ndarray) -> Iterator[list]:
    for batch in batches:
        ids, n = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
        sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(batch)), sizes)
        sums = np.zeros((2, len(batch)), dtype=np.int64)
        np.add.at(sums[0], row, n * best[ids])
        np.add.at(sums[1], row, n * counts[ids])
        yield [batch.column(0), pa.array(sums[0]), pa.array(sums[1])]


def link(texts: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, n_a, n_b, n_groups, n_links, groups_sha256, twin, n_twin, pair, n_pair): a row for each document, with its links by id and how often it has them."""
    longs = ArrayType(LongType(), False)
    numbers = [StructField(n, LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    schema = StructType([texts.schema[key], *numbers, StructField("groups_sha256", StringType()), *(StructField(n, longs) for n in ("twin", "n_twin", "pair", "n_pair"))])
    made = map_batches(texts.select(key, texts[text].alias("text")), _linked, schema, path_a, path_b)
    return materialize(made.select(F.monotonically_increasing_id().alias("uid"), "*"), "links", wide=True)


def pair_counts(linked: DataFrame, path_a: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """((pair, n, best) of irregular pairs, documents of each A id with its twin, whether that is its most): in how many documents each pair is linked."""
    size = len(byte_tokens(path_a))
    vector = map_batches(linked.select("twin"), _vectors, "a bigint, n bigint", size).groupBy("a").agg(F.sum("n").alias("n"))
    counts = linked.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = materialize(counts.withColumn("a", F.shiftright("pair", 32)), "pairs")
    twin_n, most = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    # both tables have at most a row for each id of the vocabulary
    for a, n in vector.collect():
        twin_n[a] = n
    top = counts.groupBy("a").agg(F.max("n").alias("most"))
    for a, n in top.collect():
        most[a] = n
    highest = np.maximum(twin_n, most)
    beaten = counts.sparkSession.createDataFrame([(int(a), int(highest[a])) for a in np.flatnonzero(most)], "a bigint, highest bigint")
    rated = counts.join(F.broadcast(beaten), "a").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))
    return rated, twin_n, (twin_n == highest) & (twin_n > 0)


def _heavy(counts: DataFrame, most: int) -> tuple[int, bool]:
    """(least count of the pairs that are broadcast, whether those are all), by a histogram of powers of two."""
    rows = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("power")).agg(F.count("*").alias("pairs")).collect()
    total, least = 0, 1 << 62
    for power, pairs in sorted(((r.power, r.pairs) for r in rows), reverse=True):
        if total + pairs > most:
            return least, False
        total, least = total + pairs, 1 << power
    return least, True


def align(texts: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", heavy_pairs: int = HEAVY_PAIRS) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), a row for each document."""
    linked = link(texts, path_a, path_b, key, text)
    counts, twin_n, twin_best = pair_counts(linked, path_a)
    counts = materialize(counts, "rated")
    sums = map_batches(linked.select("uid", "twin", "n_twin"), _twin_sums, "uid bigint, best bigint, sum bigint", twin_n, twin_best.astype(np.int64))
    found = linked.select("uid", F.explode(F.arrays_zip("pair", "n_pair")).alias("p")).select("uid", "p.pair", "p.n_pair")
    least, whole = _heavy(counts, heavy_pairs)
    known = F.broadcast(counts.where(F.col("n") >= least))
    added = lambda df: df.select("uid", (F.col("n_pair") * F.col("best").cast("bigint")).alias("best"), (F.col("n_pair") * F.col("n")).alias("sum"))
    sums = sums.unionByName(added(found.join(known, "pair")))
    if not whole:
        light = found.join(known.select("pair"), "pair", "left_anti").join(counts.where(F.col("n") < least), "pair")
        sums = sums.unionByName(added(light))
    sums = sums.groupBy("uid").agg(F.sum("best").alias("n_best"), F.sum("sum").alias("count_sum"))
    return linked.join(sums, "uid").select(key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
