"""Hard negatives by exact search in a packed R-tree of vectors.

Components become floor(scale * x), and a score is the whole-number inner product with the anchor.
An anchor's positives are its best rows of the same label; for each of them, negatives are the best
rows of other labels whose score is within a window of shares of the positive's.

The tree is packed by sort, tile, recurse: rows are range-sorted by length, label and first
coordinate over the cluster; each slab of that order is tiled on by the coordinates that vary most in it,
down to leaves of at most LEAF rows of one label. Ties are cut by vec_id, so a vector that a third of
all rows share fills many leaves. A leaf is one row with its minimum bounding box, which bounds each
inner product: coordinate by coordinate an interval, and their sum.

Anchors are held in blocks. A block goes to a number of lots, and every leaf to one lot of each block; where they
meet, leaves come in chunks, and each anchor takes a chunk's boxes best first, all anchors of the block a step at
a time. A box is not opened if no score in it can be within a window that is still asked for, or all
are strictly below that window's k-th one; what a chunk has found bounds the next. Lots of one block are merged
by rank, of at most k rows each.

Defined results: rows with a null id, label or vector, or any null or non-finite component, take no
part, and only vectors of the same length meet. Higher scores first, ties by smaller vec_id. Rows that
agree in id, label and vector count once; other rows with one id are rows of their own, by label and then by
vector in ties, but never an anchor's own positive or negative. Scores are exact: where a
double may not hold a sum, whole numbers of any length do; those beyond a long are null in the
result, and those of more than 38 digits leave their row out. Fewer rows than asked for give what there is; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow import map_batches
from .common import materialize

#: Rows of a leaf, rows of a slab, leaves that are searched at once, anchors of a block.
LEAF, SLAB, CHUNK, BLOCK = 128, 65_536, 256, 4_096
#: Negatives' scores are from so many to so many hundredths of the positive's.
WINDOW = (50, 95)
_EXACT = 1 << 53


def _tiles(x: np.ndarray, rows: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Rows, sorted by vec_id, to leaves: each level sorts by the coordinate that varies most and cuts as many tiles as bring all levels to the leaf's size."""
    n = len(rows)
    if n <= leaf or not x.shape[1]:
        return [rows[k : k + leaf] for k in range(0, n, leaf)]
    spread = x[rows].var(axis=0)
    levels = max(1, min(4, int(np.log2(-(-n // leaf)))))
    tiles = max(2, int(np.ceil((n / leaf) ** (1 / levels))))
    ordered = rows[np.argsort(x[rows, int(spread.argmax())], kind="stable")]
    size = -(-n // tiles)
    # a tile is whole leaves, but for the last
    size = -(-size // leaf) * leaf
    return [part for k in range(0, n, size) for part in _tiles(x, np.sort(ordered[k : k + size]), leaf)]


def _leaves(batches: Iterator[pa.RecordBatch], leaf: int, slab: int) -> Iterator[list]:
    """Rows (dim, label, vec_id, v) sorted by length, label, first coordinate and id to leaves, a slab of one label at a time."""

    def out(dim: int, label: int, held: list[tuple[np.ndarray, np.ndarray]]) -> list:
        ids, x = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
        # rows come by the vector where ids are equal, and keep that order
        by = np.argsort(ids, kind="stable")
        ids, x = ids[by], x[by]
        tiles = _tiles(x, np.arange(len(ids)), leaf)
        return [[dim] * len(tiles), [label] * len(tiles), *([f(t).tobytes() for t in tiles] for f in (lambda t: ids[t], lambda t: x[t].min(axis=0), lambda t: x[t].max(axis=0), lambda t: x[t]))]

    key: tuple | None = None
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        dims, labels, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
        starts = np.concatenate(([0], np.cumsum(dims)))
        cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(labels) != 0)) + 1).tolist(), len(ids)]
        for s, e in zip(cuts, cuts[1:], strict=False):
            own = (int(dims[s]), int(labels[s])) if e > s else key
            if held and (own != key or sum(len(i) for i, _ in held) >= slab):
                yield out(*key, held)
                held = []
            if e > s:
                key = own
                held.append((ids[s:e], flat[starts[s] : starts[e]].reshape(e - s, dims[s])))
    if held:
        yield out(*key, held)


def index(rows: DataFrame, leaf: int = LEAF, slab: int = SLAB) -> DataFrame:
    """(number, dim, label, ids, low, high, vectors): the leaves over (vec_id, label, v), arrays of doubles and, of ids, of longs as bytes."""
    keyed = rows.select(F.size("v").alias("dim"), "label", "vec_id", "v", F.try_element_at("v", F.lit(1)).alias("first"))
    dealt = keyed.repartitionByRange("dim", "label", "first", "vec_id").sortWithinPartitions("dim", "label", "first", "vec_id", "v")
    made = map_batches(dealt.select("dim", "label", "vec_id", "v"), _leaves, "dim int, label bigint, ids binary, low binary, high binary, vectors binary", leaf, slab)
    return materialize(made.select(F.monotonically_increasing_id().alias("number"), "*"), "leaves", wide=True)


def _interval(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the most that any inner product of a query with a vector in a box can be."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    return up @ low.T + down @ high.T, up @ high.T + down @ low.T


class Search:
    """The best k rows of each (anchor, window) so far, by score and then by id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, label: np.ndarray, windows: np.ndarray, k: int, same: bool) -> None:
        self.x, self.own, self.label, self.windows, self.k, self.same = x, ids, label, windows, k, same
        shape = (*windows.shape[:2], k)
        self.score = np.full(shape, -np.inf)
        self.ids = np.full(shape, np.iinfo(np.int64).max)
        self.opened = 0

    def wanted(self, least: np.ndarray, most: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Whether a box with such bounds can hold what one of an anchor's windows still asks for."""
        low, high = self.windows[who, :, 0], self.windows[who, :, 1]
        return ((most[:, None] >= low) & (least[:, None] <= high) & (most[:, None] >= self.score[who, :, -1])).any(axis=1)

    def chunk(self, leaves: list[tuple[int, np.ndarray, np.ndarray]], low: np.ndarray, high: np.ndarray) -> None:
        """Leaves (label, ids, vectors) and their boxes, each anchor's best box first, a step of all anchors at a time."""
        least, most = _interval(self.x, low, high)
        kinds = np.array([leaf[0] for leaf in leaves])
        most[(kinds[None, :] == self.label[:, None]) != self.same] = -np.inf
        order = np.argsort(-most, axis=1, kind="stable")
        going = np.arange(len(self.x))
        for step in range(len(leaves)):
            box = order[going, step]
            top = most[going, box]
            # boxes come by their highest bound: below every window and k-th score, none that follows counts
            floor = np.maximum(self.windows[going, :, 0], self.score[going, :, -1]).min(axis=1)
            on = (top >= floor) & (top > -np.inf)
            going, box = going[on], box[on]
            if not len(going):
                return
            asked = self.wanted(least[going, box], most[going, box], going)
            who, where = going[asked], box[asked]
            by = np.argsort(where, kind="stable")
            who, where = who[by], where[by]
            cuts = np.flatnonzero(np.diff(where)) + 1
            for some, at in zip(np.split(who, cuts), np.split(where, cuts), strict=True):
                if len(some):
                    self.open(some, *leaves[at[0]][1:])

    def open(self, who: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.opened += len(who)
        scores = self.x[who] @ vectors.T
        scores[self.own[who][:, None] == ids[None, :]] = -np.inf
        for w in range(self.windows.shape[1]):
            low, high = self.windows[who, w, 0][:, None], self.windows[who, w, 1][:, None]
            fits = (scores >= low) & (scores <= high) & (scores >= self.score[who, w, -1][:, None]) & (scores > -np.inf)
            some = np.flatnonzero(fits.any(axis=1))
            if not len(some):
                continue
            # a leaf's ids ascend, so a stable sort keeps the smaller of two with one score
            found = np.where(fits[some], scores[some], -np.inf)
            best = np.argsort(-found, axis=1, kind="stable")[:, : self.k]
            score = np.concatenate((self.score[who[some], w], np.take_along_axis(found, best, axis=1)), axis=1)
            named = np.concatenate((self.ids[who[some], w], ids[best]), axis=1)
            named[score == -np.inf] = np.iinfo(np.int64).max
            top = np.lexsort((named, -score), axis=1)[:, : self.k]
            self.score[who[some], w] = np.take_along_axis(score, top, axis=1)
            self.ids[who[some], w] = np.take_along_axis(named, top, axis=1)


def _exact(anchors: list[dict], leaves: list[tuple], k: int, same: bool) -> Iterator[tuple]:
    """(tag, window, id, score) where doubles can't hold the sums: every row of every leaf, in whole numbers of any length."""
    rows = [(label, int(i), [int(c) for c in v]) for label, ids, vectors in leaves for i, v in zip(ids, vectors, strict=True)]
    for a in anchors:
        x = [int(c) for c in a["v"]]
        scores = [(-sum(c * d for c, d in zip(x, v, strict=True)), i) for label, i, v in rows if (label == a["label"]) == same and i != a["id"]]
        for w, (low, high) in enumerate(a["windows"]):
            for s, i in sorted(t for t in scores if (low is None or -t[0] >= low) and (high is None or -t[0] <= high))[:k]:
                yield a["tag"], w, i, str(-s)


class _Cell:
    """A block's anchors and the leaves of a lot, a chunk at a time."""

    def __init__(self, anchors: list[dict], k: int, same: bool) -> None:
        self.anchors, self.k, self.same = anchors, k, same
        x = np.array([a["v"] for a in anchors], dtype=np.float64).reshape(len(anchors), anchors[0]["dim"])
        self.most = float(np.abs(x).max(initial=0)) * x.shape[1]
        # anchors with fewer windows than others get empty ones
        n = max(len(a["windows"]) for a in anchors)
        bounds = [[*a["windows"], *[(1, 0)] * (n - len(a["windows"]))] for a in anchors]
        windows = np.array([[(-np.inf if w[0] is None else float(w[0]), np.inf if w[1] is None else float(w[1])) for w in row] for row in bounds])
        self.search = Search(x, np.array([a["id"] for a in anchors], dtype=np.int64), np.array([a["label"] for a in anchors]), windows, k, same)
        self.exact: list[tuple] = []

    def take(self, rows: list[dict]) -> None:
        dim = self.anchors[0]["dim"]
        low, high = (np.array([np.frombuffer(r[c], dtype=np.float64) for r in rows]).reshape(len(rows), dim) for c in ("low", "high"))
        ids = [np.frombuffer(r["ids"], dtype=np.int64) for r in rows]
        leaves = [(r["label"], i, np.frombuffer(r["vectors"], dtype=np.float64).reshape(len(i), dim)) for r, i in zip(rows, ids, strict=True)]
        if self.most * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) < _EXACT:
            self.search.chunk(leaves, low, high)
        else:
            self.exact += _exact(self.anchors, leaves, self.k, self.same)

    def found(self) -> list[list]:
        tags = np.array([a["tag"] for a in self.anchors], dtype=np.int64)
        a, w, r = np.nonzero(self.search.score > -np.inf)
        rows = [*zip(tags[a].tolist(), w.tolist(), self.search.ids[a, w, r].tolist(), map(str, self.search.score[a, w, r].astype(np.int64).tolist()), strict=True), *self.exact]
        return [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], [], []]


def _met(batches: Iterator[pa.RecordBatch], k: int, same: bool, chunk: int) -> Iterator[list]:
    """Sorted rows of cells, a cell's anchors (number null) before its leaves: (tag, window, id, score) of the best k."""
    now, cell, anchors, leaves = None, None, [], []
    for batch in batches:
        for row in batch.to_pylist():
            if (own := (row["dim"], row["block"], row["lot"])) != now:
                if leaves:
                    cell.take(leaves)
                if cell:
                    yield cell.found()
                now, cell, anchors, leaves = own, None, [], []
            if row["number"] is None:
                bounds = row["windows"] if row["windows"] is not None else [{"low": None, "high": None}]
                anchors.append(row | {"windows": [tuple(None if b is None else int(b) for b in (w["low"], w["high"])) for w in bounds]})
            elif anchors:
                cell = cell or _Cell(anchors, k, same)
                leaves.append(row)
                if len(leaves) >= chunk:
                    cell.take(leaves)
                    leaves = []
    if leaves:
        cell.take(leaves)
    if cell:
        yield cell.found()


def search(anchors: DataFrame, leaves: DataFrame, k: int, same: bool, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """(tag, window, other_id, score): for each window of each anchor (tag, dim, label, id, v, windows) the best k rows of its own label, or of others."""
    sizes = anchors.groupBy("dim").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cores = anchors.sparkSession.sparkContext.defaultParallelism
    blocks = sizes.agg(F.coalesce(F.sum("blocks"), F.lit(0))).first()[0]
    lots = max(1, -(-3 * cores // max(1, blocks)))
    sent = anchors.join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("tag"), "blocks").cast("int")).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1)))).drop("blocks")
    boxes = leaves.join(sizes, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("lot", F.pmod(F.xxhash64("number"), F.lit(lots)).cast("int")).drop("blocks")
    rows = sent.unionByName(boxes, allowMissingColumns=True)
    order = ("dim", "block", "lot", "number")
    dealt = rows.repartition(max(1, blocks * lots), *order[:3]).sortWithinPartitions(*order)
    found = map_batches(dealt.select(*order, "tag", "label", "id", "v", "windows", "ids", "low", "high", "vectors"), _met, "tag bigint, window int, other_id bigint, score string", k, same, chunk)
    best = Window.partitionBy("tag", "window").orderBy(F.desc("score"), "other_id")
    ranked = found.withColumn("score", F.expr("try_cast(score AS decimal(38, 0))")).where("score IS NOT NULL").withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, window: tuple[int, int] = WINDOW, scale: int = 256, key: str = "vec_id", label: str = "label", vector: str = "embedding", leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors are rows whose id is divisible by `every`."""
    scaled = F.transform(rows[vector], lambda x: x.cast("double") * scale)
    # a double of 2 ** 52 or more is whole
    whole = F.transform("s", lambda y: F.when(F.abs(y) < 1 << 52, F.floor(y).cast("double")).otherwise(y))
    own = rows.select(rows[key].cast("bigint").alias("vec_id"), rows[label].cast("bigint").alias("label"), scaled.alias("s"))
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("s").isNotNull() & F.forall("s", lambda y: F.coalesce(F.abs(y) < float("inf"), F.lit(False)))
    own = own.where(fit).select("vec_id", "label", whole.alias("v")).distinct()
    leaves = index(own, leaf)
    anchors = own.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("tag"), F.size("v").alias("dim"), "label", F.col("vec_id").alias("id"), "v")
    anchors = materialize(anchors, "anchors")
    found = search(anchors.withColumn("windows", F.lit(None).cast("array<struct<low: string, high: string>>")), leaves, positives, True, block)
    share = lambda n, up: (F.ceil if up else F.floor)(F.col("score") * n / 100).cast("decimal(38, 0)").cast("string")
    bounds = F.struct("rank", "other_id", "score", share(window[0], True).alias("low"), share(window[1], False).alias("high"))
    asked = materialize(found.groupBy("tag").agg(F.sort_array(F.collect_list(bounds)).alias("p")), "positives")
    windows = F.transform("p", lambda p: F.struct(p["low"].alias("low"), p["high"].alias("high")))
    found = search(anchors.join(asked.select("tag", windows.alias("windows")), "tag"), leaves, negatives, False, block)
    named = asked.select("tag", F.posexplode("p").alias("window", "p")).join(anchors.select("tag", "id"), "tag")
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return found.join(named, ["tag", "window"]).select(F.col("id").alias("anchor_id"), F.col("p.other_id").alias("positive_id"), found["rank"], F.col("other_id").alias("negative_id"), long("p.score").alias("positive_score"), long("score").alias("negative_score"))
