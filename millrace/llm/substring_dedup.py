"""Removal of long repeated byte strings across a corpus, exact.

A window is `least` bytes of one document. A byte goes if a window that also starts earlier (in a
document of smaller key, or in the same one further left) covers it.

1. Each window has an anchor: its leftmost k-gram of least hash. Successive windows with one anchor
   are a run. Equal windows have equal anchors at equal places in them, so only runs of one anchor
   hash are compared; most anchors occur once and end there. Runs with the same bytes are alike
   window by window: all but the earliest go, without a look at their bytes.
2. The earliest runs of each distinct content, where an anchor has several, are strings of at most
   2 * least - k bytes. Their collection's Burrows-Wheeler transform and common prefixes are built
   column by column (column_bwt), block by block: suffixes whose common prefixes reach `least` are
   equal windows, of which all but the earliest go.
3. An anchor with very many distinct runs is not brought together, if it shows in one of 64
   documents from the start: its windows are grouped by 128-bit hashes and compared with the least
   place of each, combined before the shuffle.

The construction takes one round for each byte of the longest string, so over whole documents it
would need as many rounds as the longest document has bytes; step 1 bounds the strings, and so the
rounds, by 2 * least - k.

Defined results: a null text is an empty one; texts shorter than `least` are kept whole, texts of
any length are read whole; rows with one key and one text do not make each other repeated; of rows
with one key and different texts neither is earlier, at equal starts; a null key comes before all
others; an empty table gives no rows. Rows of one key are told apart by the SHA-256 of their texts.
Keys are integers (others fail). Columns beyond key and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import column_bwt, textvec
from .arrow import gathered, map_batches, slices
from .common import materialize

LEAST, GRAM = 100, 32
#: Bytes whose windows are worked on at once; place numbers take 24 bits.
SEGMENT = 1 << 22
#: Distinct runs of an anchor up to which they are brought together.
WIDE = 4000
#: Strings whose transform is built at once.
BLOCK = 3000
MOST_HEAVY = 10_000
BROADCAST_ROWS = 500_000
_RUN = "anchor bigint, content bigint, k bigint, at bigint, kind int, tag bigint"
_SPAN = "k bigint, tag bigint, start bigint, end bigint"
REPEATED, ALONE, OPEN, WIDE_RUN = 0, 1, 2, 3


def anchors(gram: np.ndarray, windows: int, width: int) -> np.ndarray:
    """For each window of width successive grams the place of the leftmost least one. By doubling."""
    low = (gram & np.uint64((1 << 64) - (1 << 24))) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    low = np.minimum(low[:windows], low[width - span : width - span + windows])
    return (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs(data: np.ndarray, starts: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, start, windows, offset, anchor, content) of all runs of texts joined with one byte between.

    start counts from the text's start; offset is where in a run's first window its anchor stands.
    """
    sums = textvec.running(data)
    out: list[tuple[np.ndarray, ...]] = []
    width = least - gram + 1
    for lo in range(0, max(0, len(data) - least), SEGMENT):
        windows = min(SEGMENT, len(data) - least - lo)
        place = np.arange(lo, lo + windows + width - 1)
        value = textvec.spans_hash(sums, place, place + gram)
        spot = anchors(value, windows, width)
        first = np.arange(windows) + lo
        text = np.searchsorted(starts, first, side="right") - 1
        inside = np.flatnonzero(first + least < starts[text + 1])
        if not len(inside):
            continue
        first, spot, text = first[inside], spot[inside], text[inside]
        cut = np.flatnonzero(np.concatenate(([True], (np.diff(spot) != 0) | (np.diff(text) != 0))))
        count = np.diff(np.append(cut, len(first)))
        begin, spot, text = first[cut], spot[cut], text[cut]
        offset = spot + lo - begin
        content = textvec.spans_hash(sums, begin, begin + count - 1 + least)
        content = textvec.mix(content ^ (offset.astype(np.uint64) << np.uint64(FIELD)) ^ count.astype(np.uint64))
        out.append((text, begin - starts[text], count, offset, value[spot], content))
    if not out:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


#: A run's place in one number: its start above its anchor's offset and its number of windows, of so many bits each.
FIELD = 16


def _pack(start: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    return (start.astype(np.int64) << 2 * FIELD) | (offset.astype(np.int64) << FIELD) | count.astype(np.int64)


def _start(at):
    return at >> 2 * FIELD


def _count(at):
    return at & ((1 << FIELD) - 1)


def _lead(*columns: np.ndarray) -> np.ndarray:
    """Which rows of sorted columns differ from the row before."""
    out = np.ones(len(columns[0]), dtype=bool)
    if len(out):
        out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _later(group: np.ndarray, k: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows sorted by group, k and at, with the starts of groups given, those after their group's first place."""
    first = np.maximum.accumulate(np.where(group, np.arange(len(group)), 0))
    return (k != k[first]) | (_start(at) != _start(at[first]))


def _found(batches: Iterator[pa.RecordBatch], least: int, gram: int, heavy: np.ndarray) -> Iterator[list]:
    """Runs of texts (k, tag, text). Those with an earlier like one in the same slice are REPEATED from the start, others of heavy anchors WIDE_RUN."""
    for batch in batches:
        for part in slices(batch):
            key, tag = part.column(0).to_numpy(), part.column(1).to_numpy()
            data, starts = textvec.join([(t or "").encode("utf-8", "surrogatepass") for t in part.column(2).to_pylist()])
            text, start, count, offset, anchor, content = runs(data, starts, least, gram)
            k, at, tag = key[text], _pack(start, offset, count), tag[text]
            anchor, content = anchor.view(np.int64), content.view(np.int64)
            by = np.lexsort((at, k, content, anchor))
            anchor, content, k, at, start, count, tag = anchor[by], content[by], k[by], at[by], start[by], count[by], tag[by]
            later = _later(_lead(anchor, content), k, at) if len(by) else np.zeros(0, dtype=bool)
            end = start + count - 1 + least
            kind = np.where(later, REPEATED, np.where(np.isin(anchor, heavy), WIDE_RUN, ALONE)).astype(np.int32)
            # those that are judged go to any task; the content of repeated ones holds their end
            spread = textvec.mix(k.view(np.uint64) ^ at.view(np.uint64)).view(np.int64)
            yield [np.where(kind == ALONE, anchor, spread), np.where(later, end, content), k, at, kind, tag]


def _compared(batches: Iterator[pa.RecordBatch], least: int, wide: int) -> Iterator[list]:
    """Rows of _RUN, sorted by anchor, content, k and at: what is repeated, and what is open, with its anchor."""
    names = 6
    rest = [np.zeros(0, dtype=np.int64) for _ in range(names)]
    last: tuple | None = None  # (anchor, content, k, at) of the last first place, of an anchor that went on
    broad: int | None = None

    def judged(rows: list[np.ndarray], whole: bool) -> list:
        nonlocal last, broad
        anchor, content, k, at, kind, tag = rows
        given = kind != ALONE
        first = _lead(anchor, content)
        if last is not None and len(anchor) and (anchor[0], content[0]) == last[:2]:
            first[0] = False
        place = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
        fk = np.where(place >= 0, k[place], last[2] if last else 0)
        fs = np.where(place >= 0, _start(at[place]), _start(last[3]) if last else 0)
        later = ~given & ((k != fk) | (_start(at) != fs))
        fresh = ~given & ~later
        group = np.cumsum(_lead(anchor)) - 1
        distinct = np.bincount(group[first & ~given], minlength=group[-1] + 1 if len(group) else 0)
        many = distinct[group] > 1
        out_kind = np.where(given, kind, np.where(later, REPEATED, np.where(many & fresh, OPEN, ALONE)))
        if broad is not None or not whole:
            edge = np.zeros(len(anchor), dtype=bool)
            if broad is not None:
                edge |= anchor == broad
            if not whole:
                edge |= anchor == anchor[-1]
            out_kind = np.where(edge & fresh, WIDE_RUN, out_kind)
        if len(anchor):
            p = place[-1]
            if p >= 0:
                last = (anchor[p], content[p], k[p], at[p])
            if not whole:
                broad = anchor[-1]
        content = np.where(given, content, np.where(later, _start(at) + _count(at) - 1 + least, content))
        keep = out_kind != ALONE
        return [anchor[keep], content[keep], k[keep], at[keep], out_kind[keep].astype(np.int32), tag[keep]]

    for batch in gathered(batches, 20_000):
        rows = [np.concatenate((r, batch.column(c).to_numpy().astype(np.int64))) for c, r in enumerate(rest)]
        if not len(rows[0]):
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
        if cut:
            yield judged([r[:cut] for r in rows], True)
            rows = [r[cut:] for r in rows]
        if len(rows[0]) > wide:
            yield judged(rows, False)
            rows = [r[:0] for r in rows]
        rest = rows
    if len(rest[0]):
        yield judged(rest, True)


def _cut(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list]:
    """Rows (k, tag, list of (anchor, at, kind), text) to the strings of the open runs."""
    for batch in batches:
        for part in slices(batch):
            out: list[tuple] = []
            for k, tag, marks, text in zip(*(part.column(c).to_pylist() for c in range(4)), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for m in marks:
                    start, count = _start(m["at"]), _count(m["at"])
                    out.append((m["anchor"], k, m["at"], m["kind"], tag, data[start : start + count - 1 + least]))
            yield [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(6)]


def _sharing(rows: list[tuple], least: int, gram: int) -> list[tuple]:
    """Rows (anchor, k, at, tag, bytes) without those that can share no window.

    Two windows of one anchor share all bytes beside it, so at least half of those on one side of
    it: rows stay whose half before the anchor, or after it, another row of that anchor has too.
    """
    half = (least - gram + 1) // 2
    sides = []
    for anchor, _, at, _, data in rows:
        p = _count(at >> FIELD)
        sides.append(((anchor, data[p - half : p]) if p >= half else None, (anchor, data[p + gram : p + gram + half], 0) if len(data) >= p + gram + half else None))
    seen = Counter(side for pair in sides for side in pair)
    return [row for row, (a, b) in zip(rows, sides, strict=True) if (a and seen[a] > 1) or (b and seen[b] > 1)]


def _resolved(batches: Iterator[pa.RecordBatch], least: int, gram: int, block: int) -> Iterator[list]:
    """Strings (anchor, k, at, tag, bytes), sorted by anchor, to spans (k, tag, start, end) of windows with an earlier equal."""

    def solved(rows: list[tuple]) -> list:
        rows = _sharing(rows, least, gram)
        k, at, tag = (np.array([r[c] for r in rows], dtype=np.int64) for c in (1, 2, 3))
        group, owner, start = column_bwt.repeats([np.frombuffer(r[4], dtype=np.uint8) for r in rows], least)
        k, start, tag = k[owner], _start(at[owner]) + start, tag[owner]
        by = np.lexsort((start, k, group))
        group, k, start, tag = group[by], k[by], start[by], tag[by]
        first = np.maximum.accumulate(np.where(_lead(group), np.arange(len(group)), 0)) if len(group) else group
        later = (k != k[first]) | (start != start[first])
        k, start, tag = k[later], start[later], tag[later]
        # successive windows of one document are one span
        by = np.lexsort((start, tag, k))
        k, start, tag = k[by], start[by], tag[by]
        cut = np.flatnonzero(_lead(k, tag, start - np.arange(len(start))))
        count = np.diff(np.append(cut, len(k)))
        return [k[cut], tag[cut], start[cut], start[cut] + count - 1 + least]

    rows: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
            if len(rows) >= block and row[0] != rows[-1][0]:
                yield solved(rows)
                rows = []
            rows.append(row)
    if rows:
        yield solved(rows)


def _hashed(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list]:
    """Strings (anchor, k, at, tag, bytes) to their windows (h1, h2, k, tag, start)."""
    for batch in batches:
        for part in slices(batch, "bytes"):
            k, at, tag = (part.column(c).to_numpy() for c in (1, 2, 3))
            data, starts = textvec.join(part.column(4).to_pylist())
            count = _count(at)
            row = np.repeat(np.arange(len(k)), count)
            step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            begin = starts[row] + step
            one = textvec.spans_hash(textvec.running(data), begin, begin + least)
            two = textvec.spans_hash(textvec.running(textvec.mix(data.astype(np.uint64) + np.uint64(977)) >> np.uint64(40)), begin, begin + least)
            yield [one.view(np.int64), two.view(np.int64), k[row], tag[row], _start(at[row]) + step]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """Rows (key, spans, text) to (key, kept bytes, maximal spans)."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for part in slices(batch):
            kept, merged = [], []
            for spans, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                own: list[dict] = []
                for s in sorted(spans or (), key=lambda s: (s["start"], s["end"])):
                    if own and s["start"] <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], s["end"])
                    else:
                        own.append(dict(s))
                edges = [0, *(e for s in own for e in (s["start"], s["end"])), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[0::2], edges[1::2], strict=True)) if own else data)
                merged.append(own)
            yield [part.column(0), pa.array(kept, type=pa.binary()), pa.array(merged, type=kind)]


def _told_apart(docs: DataFrame) -> DataFrame:
    """docs (k, text, key) with a tag: 0 where k has one row, else the number of the text among the distinct ones of its k."""
    shared = materialize(docs.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k"), "shared")
    n = shared.count()
    if not n:
        return docs.withColumn("tag", F.lit(0).cast("bigint"))
    content = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("content")
    small = lambda df, count: F.broadcast(df) if count <= BROADCAST_ROWS else df
    texts = docs.join(small(shared, n), "k", "left_semi").select("k", content).distinct()
    texts = materialize(texts.select("k", "content", (F.monotonically_increasing_id() + 1).alias("tag")), "texts")
    return docs.select("*", content).join(small(texts, texts.count()), ["k", "content"], "left").select("k", "text", "key", F.coalesce("tag", F.lit(0).cast("bigint")).alias("tag"))


def heavy_anchors(docs: DataFrame, least: int, gram: int, one_of: int, rows: int) -> np.ndarray:
    """Anchors with at least so many runs, once alike ones in a slice are one, in one of so many documents; at most MOST_HEAVY.

    Which ones they are decides only by which way their windows are compared.
    """
    part = docs.where(F.pmod(F.xxhash64("k", F.lit("heavy")), F.lit(one_of)) == 0).select("k", "tag", "text")
    seen = map_batches(part, _found, _RUN, least, gram, np.zeros(0, dtype=np.int64)).where(F.col("kind") == ALONE)
    counts = seen.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") >= rows)
    return np.sort(np.array([r.anchor for r in counts.orderBy(F.desc("n"), "anchor").limit(MOST_HEAVY).collect()], dtype=np.int64))


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, wide: int = WIDE, block: int = BLOCK, one_of: int = 64, heavy_rows: int = 500) -> DataFrame:
    """(k, tag, start, end): spans of repeated bytes of docs (k, tag, text); they may overlap. least - gram is below 65,535, and a text below 2 GB."""
    if not gram <= least < gram + (1 << FIELD) - 1:
        raise ValueError(f"least must be from gram ({gram}) to {gram + (1 << FIELD) - 2}")
    heavy = heavy_anchors(docs, least, gram, one_of, heavy_rows)
    found = map_batches(docs.select("k", "tag", "text"), _found, _RUN, least, gram, heavy)
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "content", "k", "at")
    judged = materialize(map_batches(dealt, _compared, _RUN, least, wide), "runs", wide=True)
    done = judged.where(F.col("kind") == REPEATED).select("k", "tag", F.shiftright("at", 2 * FIELD).alias("start"), F.col("content").alias("end"))
    marks = judged.where(F.col("kind") >= OPEN).groupBy("k", "tag").agg(F.collect_list(F.struct("anchor", "at", "kind")).alias("marks"))
    marks = materialize(marks, "marks", wide=True)
    small = marks.count()
    ids = marks.select("k").distinct()
    body = docs.join(F.broadcast(ids), "k", "left_semi") if small <= BROADCAST_ROWS else docs
    opened = body.select("k", "tag", "text").join(marks.hint("shuffle_hash"), ["k", "tag"]).select("k", "tag", "marks", "text")
    strings = materialize(map_batches(opened, _cut, "anchor bigint, k bigint, at bigint, kind int, tag bigint, bytes binary", least), "strings", wide=True)
    near = strings.where(F.col("kind") == OPEN).select("anchor", "k", "at", "tag", "bytes").repartition("anchor").sortWithinPartitions("anchor", "k", "at")
    near = map_batches(near, _resolved, _SPAN, least, gram, block)
    windows = map_batches(strings.where(F.col("kind") == WIDE_RUN).select("anchor", "k", "at", "tag", "bytes"), _hashed, "h1 bigint, h2 bigint, k bigint, tag bigint, start bigint", least)
    windows = materialize(windows, "windows", wide=True)
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("k", "start")).alias("first"))
    far = windows.join(first, ["h1", "h2"]).where(F.struct("k", "start") != F.col("first")).select("k", "tag", "start", (F.col("start") + least).alias("end"))
    return done.unionByName(near).unionByName(far)


def dedup(texts: DataFrame, least: int = LEAST, key: str = "doc_id", text: str = "text", **settings: int) -> DataFrame:
    """(key, n_bytes, kept binary, spans array of (start, end)), a row for each row of texts."""
    from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

    least_key = F.lit(-(1 << 63)).cast("bigint")
    docs = _told_apart(texts.select(F.coalesce(F.col(key).cast("bigint"), least_key).alias("k"), F.col(text).alias("text"), F.col(key).alias("key")))
    spans = repeated_spans(docs, least, **settings)
    spans = spans.groupBy("k", "tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    joined = docs.join(spans.hint("shuffle_hash"), ["k", "tag"], "left").select("key", "spans", "text")
    schema = StructType([StructField(key, texts.schema[key].dataType), StructField("kept", BinaryType()), StructField("spans", ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())])))])
    return map_batches(joined, _kept, schema).select("*", (F.octet_length("kept") + F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])).cast("bigint").alias("n_bytes"))
