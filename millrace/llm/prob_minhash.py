"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and verification.

Similarity is the probability Jaccard of the shingles' multiplicities: the sum over common
shingles d of 1 / sum over all e of max(a[e]/a[d], b[e]/b[d]); with all multiplicities one, the
plain Jaccard. A shingle is five successive lower-cased words between ASCII white space.

A signature register keeps the shingle that arrives first in a Poisson process whose rate is the
shingle's weight; each further arrival goes to a random register, and a document's processes end
once no arrival can still come first. Equal bands of registers make candidates.

Exact copies are one representative from the start. Each member of a bucket is compared with its
least one. Then, once, members not of their bucket's commonest class meet the BEST others of their
part of the bucket by how many bands they share; in buckets of up to FEW members all pairs of
different classes are compared. This only saves work: in larger buckets that are still of several
classes all pairs of different classes are compared in the end, each in the first band that it
shares: what is not of the bucket's commonest class is dealt to blocks, and each block meets the
whole bucket, a part at a time. Candidates are verified on whole texts. Classes are connected
components.

Defined results: a null text, or one without words, is a class of its own; a text of fewer than
five words has one shingle, all its words; a text of any length is compared whole; a null key has
no class and stays; repeated rows of a key are one document; texts at the threshold are linked; a
class is named by its least key; an empty table gives no rows. Keys are integers (others fail).
classes() ignores other columns, whatever their names, and keep_one() keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .arrow import map_batches, slices
from .common import discard, materialize, narrow

SIZE = 5
#: At a similarity of 0.8 two documents share a band with probability 0.99994.
BANDS, ROWS = 25, 5
#: Tasks that the pairs of one document are dealt to.
PARTS = 64
#: Buckets up to so many members have all their pairs of different classes compared.
FEW = 8
#: In larger ones a member is first compared with so many others of its part, those that agree in most bands.
BEST, LEAST_AGREED = 4, 3
#: Members of a bucket beyond which it is dealt to several tasks for that, those that agree in a further band to the same.
BUCKET = 1000
#: Members outside a larger bucket's commonest class, and their characters, that make a block in the end; members that a task reads past a block.
BLOCK, BLOCK_CHARS, PART = 512, 8 << 20, 4096
BROADCAST_ROWS = 500_000


def weighted(texts: list[str | None], size: int = SIZE) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct shingles' hashes in order, and how often it has each."""
    data, starts = textvec.join([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    start, end, first = textvec.word_spans(data, starts)
    word = textvec.spans_hash(textvec.running(data), start, end)
    h, text = textvec.shingle_hashes(word, first, size)
    order = np.argsort(text, kind="stable")
    cut = np.searchsorted(text[order], np.arange(len(texts) + 1))
    h = h[order]
    return [np.unique(h[cut[k] : cut[k + 1]], return_counts=True) for k in range(len(texts))]


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """ProbMinHash signatures, a row for each set; rows of empty sets mean nothing."""
    n = np.array([len(u) for u, _ in sets], dtype=np.int64)
    first = np.full(len(sets) * registers, np.inf)
    sig = np.zeros(len(sets) * registers, dtype=np.uint64)
    h = np.concatenate([u for u, _ in sets]) if n.sum() else np.zeros(0, dtype=np.uint64)
    rate = np.concatenate([c for _, c in sets]).astype(np.float64) if n.sum() else np.zeros(0)
    doc = np.repeat(np.arange(len(sets)), n)
    at = np.zeros(len(h))
    salt = 0
    while len(h):
        salt += 1
        draw = textvec.mix(h + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        # a second draw, for the register, from the first
        where = doc * registers + (textvec.mix(draw ^ np.uint64(0xA5A5A5A5A5A5A5A5)) % np.uint64(registers)).astype(np.int64)
        better = np.flatnonzero(at < first[where])
        if len(better):
            spot, when = where[better], at[better]
            order = np.lexsort((when, spot))
            lead = order[np.concatenate(([True], np.diff(spot[order]) != 0))]
            first[spot[lead]] = when[lead]
            sig[spot[lead]] = h[better[lead]]
        last = first.reshape(-1, registers).max(axis=1)
        alive = at < last[doc]
        if not alive.all():
            h, rate, doc, at = h[alive], rate[alive], doc[alive], at[alive]
    return sig.reshape(len(sets), registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard of two weighted sets."""
    (u, p), (v, q) = a, b
    if not len(u) or not len(v):
        return 0.0
    _, i, j = np.intersect1d(u, v, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if p.max() == 1 and q.max() == 1:
        return len(i) / (len(u) + len(v) - len(i))
    only_p, only_q = p.sum() - p[i].sum(), q.sum() - q[j].sum()
    x, y = p[i].astype(np.float64), q[j].astype(np.float64)
    ratio, which = np.unique(x / y, return_inverse=True)
    # sum over all e of max(p[e], r q[e]) for each ratio r that occurs
    whole = np.array([only_p + r * only_q + np.maximum(x, r * y).sum() for r in ratio])
    return float((x / whole[which]).sum())


def _signed(batches: Iterator[pa.RecordBatch], bands: int, rows: int, size: int) -> Iterator[list]:
    salts = textvec.mix(np.arange(1, bands + 1, dtype=np.uint64))
    kind = pa.list_(pa.int64())
    for batch in batches:
        for part in slices(batch):
            texts = part.column(1).to_pylist()
            sets = weighted(texts, size)
            sig = textvec.mix(signatures(sets, bands * rows)).reshape(len(sets), bands, rows)
            value = np.tile(salts, (len(sets), 1))
            for r in range(rows):
                value = textvec.mix(value ^ sig[:, :, r])
            flat = value.view(np.int64)
            some = [len(u) > 0 for u, _ in sets]
            content = [hashlib.blake2b(t.lower().encode("utf-8", "surrogatepass"), digest_size=16).digest() if ok else None for t, ok in zip(texts, some, strict=True)]
            yield [part.column(0), pa.array(content, type=pa.binary()), pa.array([flat[k] if some[k] else None for k in range(len(sets))], type=kind), [len(t or "") for t in texts]]


def _compared(batches: Iterator[pa.RecordBatch], threshold: float, size: int) -> Iterator[list]:
    """Rows (pivot, part, lead, key, text), sorted so that a pivot's own text comes before those to compare with it."""
    now: tuple | None = None
    pivot: tuple = (np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
    for batch in batches:
        for part in slices(batch):
            group, salt, lead, key = (part.column(k).to_pylist() for k in range(4))
            found: list[tuple] = []
            for k, own in enumerate(weighted(part.column(4).to_pylist(), size)):
                if lead[k]:
                    now, pivot = (group[k], salt[k]), own
                elif now == (group[k], salt[k]) and similarity(pivot, own) >= threshold - 1e-12:
                    found.append((key[k], group[k]))
            yield [[a for a, _ in found], [b for _, b in found]]


def verified(texts: DataFrame, pairs: DataFrame, threshold: float, size: int = SIZE) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold. texts: (key, text).

    A b's pairs are dealt to PARTS tasks by a, and its own text goes to each that gets any, so that
    a b with very many pairs holds up no task.
    """
    dealt = pairs.select(F.col("b").alias("pivot"), F.pmod(F.xxhash64("a"), F.lit(PARTS)).cast("int").alias("part"), F.lit(False).alias("lead"), F.col("a").alias("key"))
    leads = dealt.select("pivot", "part").distinct().select("pivot", "part", F.lit(True).alias("lead"), F.col("pivot").alias("key"))
    wanted = materialize(dealt.unionByName(leads), "wanted")
    small = wanted.count() <= BROADCAST_ROWS
    rows = texts.join(F.broadcast(wanted) if small else wanted.hint("shuffle_hash"), "key")
    rows = rows.select("pivot", "part", "lead", "key", "text").repartition("pivot", "part").sortWithinPartitions("pivot", "part", F.col("lead").desc())
    return map_batches(rows, _compared, "a bigint, b bigint", threshold, size)


def components(links: DataFrame) -> DataFrame:
    """(key, class): the least key that links (a, b) lead to, for every key in them. Alternates large and small stars."""
    now = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = materialize(small.distinct(), "stars")
        seen = new.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        discard(now)
        now = new
        if tuple(seen) == mark:
            return now.select(F.col("a").alias("key"), F.col("b").alias("class")).unionByName(now.select(F.col("b").alias("key"), F.col("b").alias("class")).distinct())
        mark = tuple(seen)


def _likely(rows: list[tuple], few: bool, best: int) -> set[tuple]:
    """Of rows (key, class, bands), pairs of different classes: all where there are few, else each that is not of the commonest class with the `best` others that agree with it in most bands, LEAST_AGREED at least."""
    if len({r[1] for r in rows}) < 2:
        return set()
    key, kind = (np.array([r[k] for r in rows]) for k in (0, 1))
    value = np.array([r[2] for r in rows])
    out: set[tuple] = set()
    names, counts = np.unique(kind, return_counts=True)
    asking = np.arange(len(rows)) if few else np.flatnonzero(kind != names[np.argmax(counts)])
    for lo in range(0, len(asking), 128):
        some = asking[lo : lo + 128]
        agree = (value[some, None, :] == value[None, :, :]).sum(axis=2)
        agree[kind[some, None] == kind[None, :]] = 0
        if few:
            mine, others = np.nonzero(agree)
        else:
            others = np.argpartition(agree, -min(best, len(rows)), axis=1)[:, -best:]
            mine = np.repeat(np.arange(len(others)), others.shape[1])
            others = others.ravel()
            good = agree[mine, others] >= LEAST_AGREED
            mine, others = mine[good], others[good]
        a, b = key[some][mine], key[others]
        out.update(zip(np.maximum(a, b).tolist(), np.minimum(a, b).tolist(), strict=True))
    return out


def _neighbours(batches: Iterator[pa.RecordBatch], best: int, block: int) -> Iterator[list]:
    """Rows (band, part, key, class, few, bands) in order to likely pairs of each part, a block of it at a time."""
    now, rows = None, []
    for batch in batches:
        out: set[tuple] = set()
        for band, part, key, kind, few, bands in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if now != (band, part, few) or len(rows) >= block:
                out |= _likely(rows, now[2], best) if rows else set()
                now, rows = (band, part, few), []
            rows.append((key, kind, bands))
        yield [[a for a, _ in out], [b for _, b in out]]
    out = _likely(rows, now[2], best) if rows else set()
    yield [[a for a, _ in out], [b for _, b in out]]


class _Block:
    """Sets that later ones are compared with, by the places of their shingles in one sorted vocabulary."""

    def __init__(self, sets: list[tuple[np.ndarray, np.ndarray]], key: list[int], kind: list[int], earlier: np.ndarray) -> None:
        self.sets, self.key, self.kind, self.earlier = sets, key, kind, earlier
        self.vocabulary = np.unique(np.concatenate([u for u, _ in sets]))
        self.places = [np.searchsorted(self.vocabulary, u) for u, _ in sets]
        self.mark = np.zeros(len(self.vocabulary) + 1)


def _links(block: _Block, sets: list[tuple[np.ndarray, np.ndarray]], key: list[int], kind: list[int], earlier: np.ndarray, own: bool, threshold: float, merged: dict[int, int]) -> list[tuple[int, int]]:
    """Links of a block's sets to others of different classes that agree in no earlier band; merged: what the links found so far lead classes to.

    own: the others are the block itself. Where a multiplicity is not one, pairs are excluded by
    the sum of the lesser shares of each shingle: none of the similarity's terms exceeds the
    shingle's share in either set.
    """

    def root(k: int) -> int:
        while k in merged:
            k = merged[k]
        return k

    n = np.array([len(u) for u, _ in sets])
    flat = np.concatenate([u for u, _ in sets])
    share = np.concatenate([c / c.sum() for _, c in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    place = np.searchsorted(block.vocabulary, flat)
    known = block.vocabulary[np.minimum(place, len(block.vocabulary) - 1)] == flat
    place, owner, share = place[known], owner[known], share[known]
    plain = np.array([c.max() == 1 for _, c in sets])
    now = np.array([root(k) for k in kind])
    out: list[tuple[int, int]] = []
    for a, (u, c) in enumerate(block.sets):
        mine = root(block.kind[a])
        open_ = (now != mine) & ~(earlier == block.earlier[a]).any(axis=1)
        if own:
            open_[: a + 1] = False
        if not open_.any():
            continue
        block.mark[block.places[a]] = c / c.sum()
        both = block.mark[place]
        block.mark[block.places[a]] = 0
        common = np.bincount(owner, weights=both > 0, minlength=len(sets))
        good = open_ & (common / (len(u) + n - common) >= threshold - 1e-12)
        loose = open_ if c.max() > 1 else open_ & ~plain
        if loose.any():
            most = np.bincount(owner, weights=np.minimum(both, share), minlength=len(sets))
            for k in np.flatnonzero(loose):
                good[k] = most[k] >= threshold - 1e-9 and similarity((u, c), sets[k]) >= threshold - 1e-12
        linked = np.flatnonzero(good)
        for other, k in zip(*np.unique(now[linked], return_index=True), strict=True):
            out.append((block.key[a], key[linked[k]]))
            merged[int(other)] = mine
        now[np.isin(now, now[linked])] = mine
    return out


def _crossed(batches: Iterator[pa.RecordBatch], threshold: float, size: int) -> Iterator[list]:
    """Rows (band, block, part, i, lead, key, class, bands, text) in order, a block's own sets first, to the links of each block with its part of the bucket."""
    now: tuple | None = None
    held: list[tuple] = []
    block: _Block | None = None
    merged: dict[int, int] = {}

    def packed(rows: list[tuple]) -> tuple:
        sets, key, kind, bands = (list(c) for c in zip(*rows, strict=True))
        return sets, key, kind, np.array(bands)[:, : now[3]]

    def closed() -> list[tuple[int, int]]:
        """The block from the leads held; in one of its parts its own sets are compared with each other."""
        nonlocal block
        if block is not None or not held:
            return []
        block = _Block(*packed(held))
        return _links(block, *packed(held), True, threshold, merged) if now[2] == 0 else []

    for batch in batches:
        for part in slices(batch):
            found: list[tuple[int, int]] = []
            cell = list(zip(*(part.column(k).to_pylist() for k in range(4)), strict=True))
            lead, key, kind, bands = (part.column(k).to_pylist() for k in range(4, 8))
            others: list[tuple] = []
            for k, own in enumerate(weighted(part.column(8).to_pylist(), size)):
                if now != cell[k]:
                    if now is not None:
                        found += closed()
                    if others:
                        found += _links(block, *packed(others), False, threshold, merged)
                    now, held, block, others, merged = cell[k], [], None, [], {}
                if lead[k]:
                    held.append((own, key[k], kind[k], bands[k]))
                elif held:
                    found += closed()
                    others.append((own, key[k], kind[k], bands[k]))
            if others:
                found += _links(block, *packed(others), False, threshold, merged)
            yield [[max(p) for p in found], [min(p) for p in found]]
    if now is not None:
        found = closed()
        yield [[max(p) for p in found], [min(p) for p in found]]


def crossed(texts: DataFrame, members: DataFrame, bands: DataFrame, threshold: float, size: int) -> DataFrame:
    """Links (a, b) between all members (band, i, key, class, chars) of different classes of a band, each pair in the first band that it shares.

    Of any two of different classes one is not of the band's commonest class. Those are dealt to
    blocks, and each block meets the band's other members, dealt to parts: tasks hold one block and
    read one part, so rows grow with the members times the blocks of the less common ones.
    """
    of_class = materialize(members.groupBy("band", "class").agg(F.count("*").alias("n"), F.sum("chars").alias("chars")), "counts")
    common = of_class.groupBy("band").agg(F.max_by("class", F.struct("n", "class")).alias("top"), F.sum("n").alias("all"))
    rest = of_class.join(common, "band").where("class <> top").groupBy("band", "top", "all").agg(F.sum("n").alias("others"), F.sum("chars").alias("chars"))
    blocks = F.greatest(F.ceil(F.col("others") / BLOCK), F.ceil(F.col("chars") / BLOCK_CHARS)).cast("int")
    dealt = members.drop("chars").join(rest.select("band", "top", blocks.alias("blocks"), F.ceil(F.col("all") / PART).cast("int").alias("parts")), "band")
    own = F.when(F.col("class") != F.col("top"), F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = dealt.withColumn("own", own).withColumn("stand", F.pmod(F.xxhash64("key", F.lit("part")), "parts").cast("int"))
    to = lambda p, part, lead: F.struct(p.alias("block"), part.alias("part"), F.lit(lead).alias("lead"))
    upto = F.coalesce("own", "blocks") - 1
    visits = F.when(upto < 0, F.array().cast("array<struct<block:int,part:int,lead:boolean>>")).otherwise(F.transform(F.sequence(F.lit(0), upto), lambda p: to(p, F.col("stand"), False)))
    leads = F.when(F.col("own").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: to(F.col("own"), q, True))).otherwise(F.array().cast("array<struct<block:int,part:int,lead:boolean>>"))
    wanted = materialize(dealt.select("band", F.explode(F.concat(visits, leads)).alias("at"), "i", "key", "class").select("band", "at.*", "i", "key", "class"), "wanted")
    keys = materialize(wanted.select("key").distinct(), "keys")
    n = keys.count()
    # a key is 8 bytes, its bands 8 each
    near = lambda df, most: F.broadcast(df) if n <= most else df.hint("shuffle_hash")
    rows = texts.join(near(keys, BROADCAST_ROWS), "key", "left_semi").join(near(bands.join(keys, "key", "left_semi"), BROADCAST_ROWS // 25), "key").join(wanted, "key")
    rows = rows.select("band", "block", "part", "i", "lead", "key", "class", "bands", "text").repartition("band", "block", "part").sortWithinPartitions("band", "block", "part", F.desc("lead"), "key")
    return map_batches(rows, _crossed, "a bigint, b bigint", threshold, size)


def _mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members with their class, of bands that have several classes."""
    placed = members.join(found, "key", "left").withColumn("class", F.coalesce("class", "key"))
    mixed = materialize(placed.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("band"), "mixed")
    return materialize(placed.join(mixed, "band", "left_semi"), "open")


def classes(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """(key, class_id, n_class): for each row of docs its class, named by the class's least key, and how many documents that has."""
    texts = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    signed = materialize(map_batches(texts, _signed, "key bigint, content binary, bands array<bigint>, chars bigint", bands, rows, size), "signed", wide=True)
    # written before they are joined, so that a content or a band with very many rows can be split
    least = materialize(signed.where("content is not null").groupBy("content").agg(F.min("key").alias("rep")), "least")
    members = materialize(signed.join(least, "content", "left").select("key", F.coalesce("rep", "key").alias("rep"), F.when(F.col("key") == F.col("rep"), F.col("bands")).alias("bands"), "chars"), "members")
    own = members.where("bands is not null").dropDuplicates(["key"]).select("key", "bands", "chars")
    banded = own.select("key", "chars", F.posexplode("bands").alias("i", "band"))
    heads = materialize(banded.groupBy("band").agg(F.min("key").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "heads")
    open_ = materialize(banded.join(heads, "band"), "open")
    links = materialize(verified(texts, open_.where("key <> pivot").select(F.col("key").alias("a"), F.col("pivot").alias("b")).distinct(), threshold, size), "links")
    found = components(links)
    placed = _mixed(open_, found)
    # members that also agree in a further band stand together
    other = F.get("bands", F.pmod(F.col("i") + F.lit(1), F.lit(bands)))
    part = F.pmod(F.xxhash64(other), F.ceil(F.col("n") / BUCKET)).cast("int")
    ordered = placed.join(own.drop("chars"), "key").select("band", part.alias("part"), "key", "class", (F.col("n") <= FEW).alias("few"), "bands", other.alias("o"))
    near = ordered.repartition("band", "part").sortWithinPartitions("band", "part", "few", "o", "key").drop("o")
    near = materialize(map_batches(near, _neighbours, "a bigint, b bigint", BEST, 2 * BUCKET).distinct(), "pairs")
    new = materialize(verified(texts, near, threshold, size), "links")
    if new.count():
        links = links.unionByName(new)
        found = components(links)
    # smaller buckets have had all their pairs compared
    rest = _mixed(placed.where(F.col("n") > FEW).drop("class"), found)
    new = materialize(crossed(texts, rest.select("band", "i", "key", "class", "chars"), own.select("key", "bands"), threshold, size), "links")
    if new.count():
        found = components(links.unionByName(new))
    named = members.join(found.withColumnRenamed("key", "rep"), "rep", "left").select("key", F.coalesce("class", "rep").alias("class_id")).distinct()
    named = materialize(named, "named")
    sizes = named.groupBy("class_id").agg(F.count("*").alias("n_class"))
    rows_ = docs.select(key).join(named.join(sizes, "class_id").withColumnRenamed("key", key), key, "left")
    return narrow(rows_.select(key, "class_id", "n_class"))


def keep_one(docs: DataFrame, key: str = "doc_id", **settings: object) -> DataFrame:
    """The rows of docs that name their class, and those without a key; all columns."""
    found = classes(docs, key=key, **settings)
    gone = materialize(found.where(F.col(key) != F.col("class_id")).select(key).distinct(), "gone")
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, key, "left_anti")
