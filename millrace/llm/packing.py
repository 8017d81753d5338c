"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

A document's ids and an end id are one piece, or, beyond the capacity, pieces of the capacity, the
first of them shorter. Full pieces are sequences as they are. The others are dealt to regions of a
bounded number of pieces, and each region to several islands: tasks that hold the same pieces and
other packings of them. An island starts from packings in random order, each piece put best-fit. A
generation crosses two packings: well-filled bins of one are injected whole into the other, bins
that hold any of the same pieces are removed, with some others at random, and the pieces displaced by
that are put back best-fit. A child as good as a member, which is mostly one of its copies, doesn't join. After some generations each island's best packing, its elite, migrates as rows to the next
island of the region, for the next epoch; from the second on a best-fit-decreasing packing is in each
population too, so that no region ends worse than that. A region ends once an elite meets a lower
bound of its sequences, and all do once an epoch saves none.

Then well-filled bins stay, and the others are dealt, whole, to fewer regions, where they are an
elite from the start; so on until they are dealt to no fewer.

Defined results: a null or empty text is the end id alone; a text of any length is cut whole into
pieces; a null key and repeated rows are packed like others; among packings of as many bins the one
whose bins are fuller is better, and one found earlier wins ties; an empty table gives no rows;
columns beyond key and text are ignored, whatever their names. The vocabulary's file is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import map_batches, slices
from .common import materialize
from .vocab import byte_encoder

CAPACITY = 2048
REGION_PIECES = 40_000
#: Bins at least so full stay where they are when the others are dealt to fewer regions.
WELL_FILLED = 0.998
#: Islands of a region, packings of an island, and generations of an epoch.
ISLANDS, POPULATION, GENERATIONS = 2, 12, 60
#: Share of the well-filled bins that a crossing dissolves beside those that hold injected pieces.
DISSOLVED = 0.3
BROADCAST_ROWS = 500_000
Bin = tuple[int, list[int]]
#: The bin of each piece and the room of each bin.
Packing = tuple[np.ndarray, np.ndarray]


def _tokenised(batches: Iterator[pa.RecordBatch], path: str, end: int, capacity: int) -> Iterator[list]:
    encode = byte_encoder(path)
    tail = np.array([end], dtype="<u4")
    for batch in batches:
        for part in slices(batch):
            row, piece, start, length, ids = [], [], [], [], []
            for k, text in enumerate(part.column(1).to_pylist()):
                own = np.concatenate((encode(text).astype("<u4"), tail)) if text else tail
                at, number = 0, 0
                while at < len(own):
                    n = min(capacity, len(own) - at) if at or len(own) <= capacity else (len(own) - 1) % capacity + 1
                    row.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(n)
                    ids.append(own[at : at + n].tobytes())
                    at, number = at + n, number + 1
            yield [part.column(0).take(pa.array(row, type=pa.int64())), piece, start, length, ids]


def tokenise(texts: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(uid, key, piece, start, length, ids): pieces with their ids as little-endian unsigned 32-bit numbers."""
    from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

    schema = StructType([texts.schema[key], StructField("piece", IntegerType()), StructField("start", LongType()), StructField("length", LongType()), StructField("ids", BinaryType())])
    made = map_batches(texts.select(key, texts[text].alias("text")), _tokenised, schema, path, end, capacity)
    return materialize(made.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces", wide=True)


def _open(room: np.ndarray, capacity: int, least: int) -> tuple[list[list[int]], int]:
    """(bins by the room in them, mask of the rooms that there are), of bins with at least so much room: the least sufficient room for a piece is then the lowest set bit."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k in np.flatnonzero(room >= least).tolist():
        by_room[room[k]].append(k)
    return by_room, sum(1 << k for k, row in enumerate(by_room) if row)


def _closed(by_room: list[list[int]], room: np.ndarray, bins: int) -> np.ndarray:
    """Room of each of so many bins, those that were not opened as before."""
    room = np.concatenate((room, np.zeros(bins - len(room), dtype=np.int64)))
    room[list(chain.from_iterable(by_room))] = np.repeat(np.arange(len(by_room)), [len(row) for row in by_room])
    return room


def _fill(length: list[int], capacity: int, room: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bin of each piece, room of each bin) after putting pieces, given by their lengths, in this order beside bins that have so much room: each into the fullest bin that has room, or a new one."""
    by_room, mask = _open(room, capacity, 0)
    bit = [1 << k for k in range(capacity + 1)]
    bins, placed = len(room), []
    put = placed.append
    for n in length:
        fit = mask >> n
        if fit:
            at = n + (fit & -fit).bit_length() - 1
            row = by_room[at]
            found = row.pop()
            if not row:
                mask ^= bit[at]
            at -= n
        else:
            found, at = bins, capacity - n
            bins += 1
        put(found)
        row = by_room[at]
        if not row:
            mask |= bit[at]
        row.append(found)
    return placed, _closed(by_room, room, bins)


def best_fit(order: Sequence[int], length: Sequence[int], capacity: int, keep: Sequence[Bin] = ()) -> list[Bin]:
    """Bins as (room, pieces) after putting pieces, in the order given, beside bins that are kept: each into the fullest bin that has room, or a new one."""
    placed, room = _fill([length[i] for i in order], capacity, np.array([r for r, _ in keep], dtype=np.int64))
    bins = [*(list(members) for _, members in keep), *([] for _ in range(len(room) - len(keep)))]
    for i, k in zip(order, placed, strict=True):
        bins[k].append(i)
    return list(zip(room.tolist(), bins, strict=True))


def _refill(length: np.ndarray, capacity: int, room: np.ndarray) -> tuple[list[int], np.ndarray]:
    """As _fill() for lengths that fall: pieces of one length go together, and the bins of the least sufficient room each take as many of them as they hold."""
    starts = np.flatnonzero(np.diff(length, prepend=0))
    by_room, mask = _open(room, capacity, length[-1] if len(length) else capacity)
    bit = [1 << k for k in range(capacity + 1)]
    bins, placed = len(room), []
    for n, left in zip(length[starts].tolist(), np.diff(starts, append=len(length)).tolist(), strict=True):
        while left:
            fit = mask >> n
            if fit:
                at = n + (fit & -fit).bit_length() - 1
                row, each = by_room[at], at // n
                found = row[-(-(-left // each)) :]
                del row[-len(found) :]
                if not row:
                    mask ^= bit[at]
            else:
                at, each = capacity, capacity // n
                found = list(range(bins, bins - (-left // each)))
                bins += len(found)
            most = min(len(found), left // each)
            for taking, those in ((each, found[:most]), (left - most * each, found[most:])):
                if those:
                    placed += those if taking == 1 else [i for i in those for _ in range(taking)]
                    left -= taking * len(those)
                    to = at - taking * n
                    if not by_room[to]:
                        mask |= bit[to]
                    by_room[to] += those
    return placed, _closed(by_room, room, bins)


def cross(one: Packing, other: Packing, length: np.ndarray, capacity: int, rng: np.random.Generator) -> Packing:
    """Inject bins of other whole into one: a random half of its well-filled ones, or of its fullest tenth.

    Bins of one that hold any of the same pieces are removed, and so are those that are not well
    filled and a share of the others, so that the pieces displaced find partners when they are put back
    best-fit, largest first, as pieces are numbered.
    """
    most = (1 - WELL_FILLED) * capacity
    good = np.flatnonzero(other[1] <= most)
    if not len(good):
        good = np.argsort(other[1], kind="stable")[: max(1, len(other[1]) // 10)]
    injected = good[rng.random(len(good)) < 0.5]
    if not len(injected):
        injected = good[:1]
    number = np.full(len(other[1]), -1)
    number[injected] = np.arange(len(injected))
    to = number[other[0]]
    kept = (one[1] <= most) & (rng.random(len(one[1])) >= DISSOLVED)
    kept[one[0][to >= 0]] = False
    number = np.full(len(one[1]), -1)
    number[kept] = np.arange(len(injected), len(injected) + np.count_nonzero(kept))
    to = np.where(to >= 0, to, number[one[0]])
    displaced = np.flatnonzero(to < 0)
    to[displaced], room = _refill(length[displaced], capacity, np.concatenate((other[1][injected], one[1][kept])))
    return to, room


def _worth(room: np.ndarray, capacity: int) -> tuple[int, float]:
    return -len(room), float(((1 - room / capacity) ** 2).sum()) / max(1, len(room))


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return _worth(np.array([b[0] for b in bins], dtype=np.float64), capacity)


def least_bins(length: Sequence[int], capacity: int) -> int:
    """A lower bound of the bins: for each size t, pieces over capacity - t stand alone, those over half have a bin each, and what is from t to half fills at best their rooms and then whole bins."""
    sizes = np.bincount(np.asarray(length, dtype=np.int64), minlength=capacity + 1)
    count, total = np.concatenate(([0], np.cumsum(sizes))), np.concatenate(([0], np.cumsum(sizes * np.arange(len(sizes)))))
    half = capacity // 2
    t = np.arange(half + 1)
    large = len(length) - count[half + 1]
    middle = count[capacity - t + 1] - count[half + 1]
    room = middle * capacity - (total[capacity - t + 1] - total[half + 1])
    small = total[half + 1] - total[t]
    return int(large + np.maximum(0, -(-(small - room) // capacity)).max(initial=0))


def evolve(length: Sequence[int], capacity: int = CAPACITY, seed: int = 0, elites: Sequence[list[Bin]] = (), falling: bool = False, size: int = POPULATION, generations: int = GENERATIONS) -> tuple[list[Bin], int, int]:
    """(packing, crossings, bound): an island's best packing of pieces given by their lengths, how often it crossed two, and the least bins there can be.

    It starts from the elites, if falling from the best-fit-decreasing packing, and from random ones. In here pieces are numbered by length, largest first.
    """
    rng = np.random.default_rng(seed % (1 << 63))
    bound, crossings = least_bins(length, capacity), 0
    order = np.argsort(-np.asarray(length, dtype=np.int64), kind="stable")
    sizes = np.asarray(length, dtype=np.int64)[order]
    number = np.argsort(order)
    none = np.empty(0, dtype=np.int64)
    population = []
    for bins in elites:
        to = np.empty(len(order), dtype=np.int64)
        to[number[list(chain.from_iterable(members for _, members in bins))]] = np.repeat(np.arange(len(bins)), [len(members) for _, members in bins])
        population.append((to, np.array([room for room, _ in bins], dtype=np.int64)))
    if falling:
        placed, room = _refill(sizes, capacity, none)
        population.append((np.array(placed, dtype=np.int64), room))
    worth = [_worth(room, capacity) for _, room in population]
    while len(population) < size and (not worth or -max(worth)[0] > bound):
        shuffled, to = rng.permutation(len(order)), np.empty(len(order), dtype=np.int64)
        to[shuffled], room = _fill(sizes[shuffled].tolist(), capacity, none)
        population.append((to, room))
        worth.append(_worth(room, capacity))
    while crossings < generations and -max(worth)[0] > bound:
        a, b = rng.choice(len(population), 2, replace=False)
        child = cross(population[a], population[b], sizes, capacity, rng)
        crossings += 1
        worst = min(range(len(population)), key=worth.__getitem__)
        if (found := _worth(child[1], capacity)) > worth[worst] and found not in worth:
            population[worst], worth[worst] = child, found
    to, room = population[max(range(len(population)), key=worth.__getitem__)]
    members, ends = order[np.argsort(to, kind="stable")].tolist(), np.cumsum(np.bincount(to, minlength=len(room))).tolist()
    return [(r, members[start:end]) for r, start, end in zip(room.tolist(), [0, *ends], ends)], crossings, bound


def _island(batches: Iterator[pa.RecordBatch], capacity: int, epoch: int, generations: int) -> Iterator[list]:
    """Rows (region, island, source, uid, length, bin), an island's together, all its pieces once for each source of an elite (bin -1: none): its best packing."""

    def solved(where: tuple, sources: dict[int, list[tuple]]) -> list:
        rows = next(iter(sources.values()))
        length = [n for _, n, _ in rows]
        elites = []
        for own in sources.values():
            if own[0][2] >= 0:
                bins: dict[int, list[int]] = {}
                for i, (_, _, number) in enumerate(own):
                    bins.setdefault(number, []).append(i)
                elites.append([(capacity - sum(length[i] for i in m), m) for m in bins.values()])
        best, crossings, bound = evolve(length, capacity, seed=hash((*where, epoch)), elites=elites, falling=epoch > 0, generations=generations)
        out: list[tuple] = []
        for number, (room, members) in enumerate(best):
            at = 0
            for i in members:
                out.append((rows[i][0], length[i], number, room, at))
                at += length[i]
        n = len(out)
        return [[where[0]] * n, [where[1]] * n, *(list(c) for c in zip(*out, strict=True)), [len(best)] * n, [len(best) <= bound] * n, [crossings] * n]

    now: tuple | None = None
    held: dict[int, list[tuple]] = {}
    for batch in batches:
        for region, island, source, uid, length, number in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (region, island) != now:
                if held:
                    yield solved(now, held)
                now, held = (region, island), {}
            held.setdefault(source, []).append((uid, length, number))
    if held:
        yield solved(now, held)


_ELITE = "region bigint, island int, uid bigint, length bigint, bin bigint, room bigint, offset bigint, bins bigint, solved boolean, crossings bigint"


def _epochs(dealt: DataFrame, capacity: int, generations: int) -> DataFrame:
    """Pieces (region, uid, length, bin) to each region's best packing, after as many epochs as save sequences."""
    seeded = dealt.select("region", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(0).alias("source"), "uid", "length", "bin")
    kept: DataFrame | None = None
    before, epoch = None, 0
    while True:
        rows = seeded.repartition("region", "island").sortWithinPartitions("region", "island", "source", "uid")
        elites = materialize(map_batches(rows, _island, _ELITE, capacity, epoch, generations), "elites")
        best = elites.where("offset = 0").groupBy("region").agg(F.min_by("island", F.struct("bins", "island")).alias("island"), F.min("bins").alias("bins"), F.bool_or("solved").alias("solved"))
        best = materialize(best, "best")
        n, opened, bins = best.agg(F.count("*"), F.count_if(~F.col("solved")), F.coalesce(F.sum(F.when(~F.col("solved"), F.col("bins"))), F.lit(0))).first()
        small = lambda df: F.broadcast(df) if n <= BROADCAST_ROWS else df
        # what was open before and is solved now has saved something
        ended = not opened or (before is not None and before == (opened, bins))
        done = elites.join(small(best.where("true" if ended else "solved").select("region", "island")), ["region", "island"], "left_semi")
        kept = done if kept is None else kept.unionByName(done)
        if ended:
            return kept
        before, epoch = (opened, bins), epoch + 1
        left = elites.join(small(best.where("not solved").select("region")), "region", "left_semi")
        to = F.explode(F.array_distinct(F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS))))).alias("to")
        seeded = left.select("region", to, F.col("island").alias("source"), "uid", "length", "bin").withColumnRenamed("to", "island")


def assign(items: DataFrame, capacity: int = CAPACITY, region_pieces: int = REGION_PIECES, generations: int = GENERATIONS) -> DataFrame:
    """(uid, sequence_id, offset) for items (uid, length) with lengths from 1 to capacity."""
    full = items.where(F.col("length") == capacity).select("uid", (F.lit(1 << 62) + F.col("uid")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left = items.where(F.col("length") < capacity).select("uid", "length", F.lit(-1).cast("bigint").alias("bin"), F.col("uid").alias("by"))
    regions, turn, out = -(-left.count() // region_pieces), 0, full
    while regions:
        dealt = left.select(F.pmod(F.xxhash64("by", F.lit(turn)), F.lit(regions)).alias("region"), "uid", "length", "bin")
        sequence = F.lit((turn + 1) << 56) + F.shiftleft("region", 24) + F.col("bin")
        packed = _epochs(dealt, capacity, generations).select("uid", "length", sequence.alias("sequence_id"), "offset", "room")
        loose = F.col("room") > (1 - WELL_FILLED) * capacity
        left = packed.where(loose).select("uid", "length", F.col("sequence_id").alias("bin"), F.col("sequence_id").alias("by"))
        fewer = -(-left.count() // region_pieces)
        if fewer >= regions:
            fewer = 0
        done = packed.where(~loose) if fewer else packed
        out = out.unionByName(done.select("uid", "sequence_id", "offset"))
        regions, turn = fewer, turn + 1
    return out


def pack(texts: DataFrame, path: str, end: int = 0, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids, sequence_id, offset), a row for each piece."""
    pieces = tokenise(texts, path, end, capacity, key, text)
    places = assign(pieces.select("uid", "length"), capacity)
    return pieces.join(places, "uid").drop("uid")
