"""Entity resolution: blocked candidates, token-set similarity, decisions.

Token-set similarity is the largest of three normalised insertion-deletion similarities of sorted
token strings (100 where one set holds the other); edit distance by substitutions is not the same,
and no built-in has its longest common subsequence. Candidates are therefore joined by what a score needs, rare
words in common or lengths and letters in proportion, bounded from both sides natively, and only pairs
whose score the bounds leave open go to an Arrow function.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from ..session import shared_dir, ship


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows, one for each character of the shorter."""
    if len(b) > len(a):
        a, b = b, a
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = row = (1 << len(a)) - 1
    for c in b:
        match = where.get(c, 0) & row
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 if not a and not b else 200.0 * common_length(a, b) / (len(a) + len(b))


def token_set_ratio(a: str | None, b: str | None, least: float = 0.0) -> float:
    """The largest ratio of the common tokens, and of these with each side's others, sorted; below `least` it may be given as less."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, only_x, only_y = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if both and (not only_x or not only_y):
        return 100.0
    # what two texts have in front in common is in their longest common subsequence
    n, m, p = len(only_x), len(only_y), len(both) + 1 if both else 0
    out = 200.0 * len(both) / (len(both) + p + min(n, m)) if both else 0.0
    whole = 2 * p + n + m
    if 200.0 * (p + min(n, m)) / whole >= least:
        out = max(out, 200.0 * (p + common_length(only_x, only_y)) / whole)
    return out


def token_sort_ratio(a: str | None, b: str | None) -> float:
    return ratio(" ".join(sorted((a or "").split())), " ".join(sorted((b or "").split())))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter with a stretch of the longer of its length, or shorter at the ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 0.0
    n = len(short)
    return max(ratio(short, long[max(0, k) : k + n]) for k in range(1 - n, len(long)))


def weighted_ratio(a: str | None, b: str | None) -> float:
    """The largest of plain, sorted, set and partial ratios, the latter scaled down as lengths differ."""
    x, y = a or "", b or ""
    if not x or not y:
        return 0.0
    lengths = max(len(x), len(y)) / min(len(x), len(y))
    found = [ratio(x, y)]
    if lengths < 1.5:
        return max(*found, 0.95 * token_sort_ratio(x, y), 0.95 * token_set_ratio(x, y))
    scale = 0.9 if lengths < 8 else 0.6
    return max(*found, scale * partial_ratio(x, y), 0.95 * scale * token_set_ratio(x, y))


def _two_fields(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
    for a, b, t, u in parts:
        yield pd.Series([weighted_ratio(w, x) >= 80 and (not y or not z or token_sort_ratio(y, z) >= 70) for w, x, y, z in zip(a, b, t, u, strict=True)], dtype="bool")


#: Right rows of a block that one task pairs with the block's left ones.
BLOCK_ROWS = 10_000


def in_blocks(left: DataFrame, right: DataFrame, block: str, by: str, most: int = BLOCK_ROWS) -> DataFrame:
    """left and right joined on a block; a block of many right rows is dealt by them to parts, each of which meets all of the block's left rows."""
    parts = right.groupBy(block).agg(F.count("*").alias("n")).select(block, F.ceil(F.col("n") / most).cast("int").alias("parts"))
    dealt = right.join(parts, block).withColumn("part", F.pmod(F.xxhash64(by), "parts").cast("int")).drop("parts")
    copied = left.join(parts, block).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return copied.join(dealt, [block, "part"])


def match_two_fields(messages: DataFrame, applications: DataFrame) -> DataFrame:
    """(message_id, application_id): the same platform, alike companies and, where both have one, alike titles."""
    ship(messages.sparkSession)
    pairs = messages.select("message_id", "platform", F.lower("company").alias("a"), F.lower("title").alias("t"))
    pairs = in_blocks(pairs, applications.select("application_id", "platform", F.lower("company").alias("b"), F.lower("title").alias("u")), "platform", "application_id")
    good = F.pandas_udf(_two_fields, BooleanType())("a", "b", "t", "u")
    return pairs.where(good).select("message_id", "application_id")


#: Letters that are counted apart, and together all others, for an upper bound of what two texts have in common.
LETTERS = ("a", "e", "i", "o", "u", "s", "t", "n", "r", "lm", "cdk", "bfgp", "hvwy", " ")


def _side(df: DataFrame, key: str) -> DataFrame:
    """(key, block, words, size, letters): distinct words in order, the length of their line, how often each of LETTERS is in it, and the others; kept in the shared store, as several steps read it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/names-{uuid.uuid4().hex}"
    words = F.sort_array(F.array_distinct(F.filter(F.split(F.coalesce("name", F.lit("")), r"\s+"), lambda w: w != "")))
    # a file of long texts may be one task's; dealt out by their keys they are many
    rows = df.where("block is not null").select(key, "block", "name").repartition(key).select(key, "block", words.alias("words")).withColumn("line", F.array_join("words", " "))
    size = F.char_length("line")
    counts = [size - F.char_length(F.translate("line", own, "")) for own in LETTERS]
    others = F.char_length(F.translate("line", "".join(LETTERS), ""))
    made = rows.select(key, "block", "words", size.alias("size"), F.array(*counts, others).alias("letters"))
    made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path).where("size > 0")


def _places(side: DataFrame, key: str, rarity: DataFrame) -> DataFrame:
    """(key, block, size, word, rest): each word with the weight of itself and all commoner words of its row; a word weighs its length and a space."""
    words = side.select(key, "block", "size", F.explode("words").alias("word")).join(rarity, ["block", "word"])
    common_first = Window.partitionBy(key).orderBy(F.desc("rows"), F.desc("word"))
    return words.select(key, "block", "size", "word", F.sum(F.char_length("word") + 1).over(common_first).alias("rest"))


def _held(small: DataFrame, large: DataFrame, share: float, strict: bool) -> DataFrame:
    """Pairs of a block in which words of at least so large a share of the smaller row may be common, by the smaller row's rarest words.

    All words that two rows have in common are as common as their rarest one or commoner, so at that
    one what is left of either row must weigh enough; a row's words that leave too little after
    them are never looked up.
    """
    need = (F.col("small.size") + 1) * share
    fits = (F.col("small.size") < F.col("large.size")) if strict else (F.col("small.size") <= F.col("large.size"))
    rare = small.where(F.col("rest") >= (F.col("size") + 1) * share).alias("small")
    return rare.join(large.alias("large"), [F.col("small.block") == F.col("large.block"), F.col("small.word") == F.col("large.word"), fits, F.col("large.rest") >= need])


def _shared(x: str, y: str) -> Column:
    """No more characters than the sum, over letters, of the lesser count can be in a common subsequence."""
    n = len(LETTERS) + 1
    return sum((F.least(F.get(x, k), F.get(y, k)) for k in range(1, n)), F.least(F.get(x, 0), F.get(y, 0)))


def _sides(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides' words and counts; of the right one only what is in a block of the left one."""
    blocks = left.select("block").where("block is not null").distinct()
    return _side(left, "left_id"), _side(right.join(blocks, "block", "left_semi"), "right_id")


def likely_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left_id, right_id): pairs of a block that may score `least`; no others that could are left out."""
    return _likely(*_sides(left, right), least)


def _likely(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """likely_pairs of two _sides.

    A score is that of the common words alone, which needs enough of the smaller row's weight in
    common and is found by rare words; or that of whole lines, which needs lengths in
    proportion, found by bands of lengths, and enough letters in common.
    """
    share = least / (200 - least)
    rarity = b.select("block", F.explode("words").alias("word")).groupBy("block", "word").agg(F.count("*").alias("rows"))
    x, y = _places(a, "left_id", rarity), _places(b, "right_id", rarity)
    ids = ("left_id", "right_id")
    by_words = _held(x, y, share, False).select(*ids).union(_held(y, x, share, True).select(*ids))
    band = F.floor(F.ln("size") / math.log(1 / share)).cast("int")
    near = a.select("left_id", "block", "size", F.col("letters").alias("l"), F.explode(F.array(band - 1, band, band + 1)).alias("band")).withColumn("block", F.struct("block", "band")).withColumnRenamed("size", "n").drop("band")
    far = b.select("right_id", F.struct("block", band.alias("band")).alias("block"), F.col("size").alias("m"), F.col("letters").alias("r"))
    alike = in_blocks(near, far, "block", "right_id").where((F.least("n", "m") >= share * F.greatest("n", "m")) & (200 * _shared("l", "r") >= (least - 1e-4) * (F.col("n") + F.col("m"))))
    # words that no right row has are in no table of places, but in the lengths
    return by_words.union(alike.select(*ids)).distinct()


def bounded_pairs(left: DataFrame, right: DataFrame, least: float, k: int) -> DataFrame:
    """(left_id, right_id, only_x, only_y, p, low, high): likely pairs whose score, between low and high, may be `least` and among a left row's k best; p is the length of their common words and the space after them."""
    a, b = _sides(left, right)
    x = a.select("left_id", F.col("words").alias("x"), F.col("size").alias("size_x"), F.col("letters").alias("l"))
    y = b.select("right_id", F.col("words").alias("y"), F.col("size").alias("size_y"), F.col("letters").alias("r"))
    both = F.char_length(F.array_join(F.array_intersect("x", "y"), " "))
    rows = _likely(a, b, least).join(x, "left_id").join(y, "right_id").select("left_id", "right_id", both.alias("b"), "size_x", "size_y", _shared("l", "r").alias("shared"))
    rows = rows.withColumn("p", F.when(F.col("b") > 0, F.col("b") + 1).otherwise(0))
    # what is left of a line without the common words and a space after each
    rows = rows.withColumn("n", F.greatest(F.col("size_x") - F.col("p"), F.lit(0))).withColumn("m", F.greatest(F.col("size_y") - F.col("p"), F.lit(0)))
    whole = 2 * F.col("p") + F.col("n") + F.col("m")
    words = F.when(F.col("b") > 0, 200.0 * F.col("b") / (F.col("b") + F.col("p") + F.least("n", "m"))).otherwise(0.0)
    held = (F.col("b") > 0) & (F.least("n", "m") == 0)
    low = F.when(held, 100.0).otherwise(F.greatest(words, 200.0 * F.col("p") / whole))
    high = F.when(held, 100.0).otherwise(F.greatest(words, 200.0 * F.least(F.col("p") + F.least("n", "m"), "shared") / whole))
    rows = rows.select("left_id", "right_id", "p", low.alias("low"), high.alias("high"))
    # the k-th best of what pairs score at least, once k of them have been seen; only numbers are ranked, and the words of what stays are looked up again
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("left_id").orderBy(F.desc("low"), "right_id")))
    best = ranked.withColumn("sure", F.max(F.when(F.col("rank") == k, F.col("low"))).over(Window.partitionBy("left_id")))
    best = best.where((F.col("high") >= least - 1e-4) & (F.col("high") >= F.coalesce("sure", F.lit(0.0)) - 1e-4))
    found = best.join(x.select("left_id", "x"), "left_id").join(y.select("right_id", "y"), "right_id")
    return found.select("left_id", "right_id", F.array_join(F.array_except("x", "y"), " ").alias("only_x"), F.array_join(F.array_except("y", "x"), " ").alias("only_y"), "p", "low", "high")


def _common(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for u, v in parts:
        yield pd.Series([common_length(x, y) for x, y in zip(u, v, strict=True)], dtype="int64")


def candidates(left: DataFrame, right: DataFrame, least: float = 40.0, k: int = 3) -> DataFrame:
    """(left_id, right_id, score, rank): of the right rows in a left row's block, the k most alike by name, at least `least` (1 or more). Ids are keys.

    Only the longest common subsequence of the words that are not common runs in Python, for pairs whose bounds leave the score open.
    """
    ship(left.sparkSession)
    # ranked by left rows, pairs are in as many tasks as these fill; dealt out by pairs they are in all
    rows = bounded_pairs(left, right, least, k).repartition("left_id", "right_id")
    open_ = F.col("high") > F.col("low")
    common = F.pandas_udf(_common, LongType())(*(F.when(open_, F.col(c)).otherwise("") for c in ("only_x", "only_y")))
    whole = 200.0 * (F.col("p") + F.col("common")) / (2 * F.col("p") + F.char_length("only_x") + F.char_length("only_y"))
    score = F.when(open_, F.greatest("low", whole)).otherwise(F.col("low"))
    scored = rows.withColumn("common", common).select("left_id", "right_id", F.round(score, 4).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("left_id").orderBy(F.desc("score"), "right_id")
    return scored.select("*", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def decide(ranked: DataFrame, sure: float = 95.0, good: float = 80.0, gap: float = 25.0) -> DataFrame:
    """(left_id, right_id, score, decision): auto from `sure`, dominant from `good` with the next one `gap` behind, else ambiguous."""
    rows = ranked.withColumn("next", F.lead("score").over(Window.partitionBy("left_id").orderBy("rank"))).where("rank = 1")
    decision = F.when(F.col("score") >= sure, "auto").when((F.col("score") >= good) & (F.col("score") - F.coalesce("next", F.lit(0.0)) >= gap), "dominant").otherwise("ambiguous")
    return rows.select("left_id", "right_id", "score", decision.alias("decision"))


def _names(df: DataFrame, rows: str) -> DataFrame:
    """Distinct names, their words and how many rows have each."""
    return df.groupBy("name").agg(F.count("*").alias(rows)).withColumn("words", F.filter(F.split("name", " "), lambda t: t != ""))


def keyword_classes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_name, right_name, left_rows, right_rows): distinct names, every word of the left one in the right one; one-word names need an equal name.

    Joined on the left word that the fewest right names have, so a name that many rows share is one row; the
    rows behind a class are found by its name.
    """
    a = _names(left, "left_rows")
    a = a.select(F.col("name").alias("left_name"), "left_rows", F.array_distinct("words").alias("w"), F.size("words").alias("n")).where("n > 0")
    words = _names(right, "right_rows").select(F.col("name").alias("right_name"), "right_rows", F.col("words").alias("v"), F.explode(F.array_distinct("words")).alias("key"))
    counts = words.groupBy("key").agg(F.count("*").alias("names"))
    # a word that no right name has rules its left name out; of the others the rarest makes the fewest pairs
    rated = a.select("left_name", "left_rows", "w", "n", F.explode("w").alias("key")).join(counts, "key")
    rarest = rated.groupBy("left_name", "left_rows", "w", "n").agg(F.count("*").alias("known"), F.min_by("key", F.struct("names", "key")).alias("key")).where(F.col("known") == F.size("w"))
    fits = (F.size(F.array_except("w", "v")) == 0) & ((F.col("n") > 1) | (F.size("v") == 1))
    return rarest.join(words, "key").where(fits).select("left_name", "right_name", "left_rows", "right_rows")


def _linked(df: DataFrame, side: str, classes: DataFrame, rows: str) -> DataFrame:
    """(side, id, class_id, links, name) of one side's rows, a class the rows of one name, by its smallest id; links from how many rows the names have that a name is paired with."""
    ids = df.select(F.col(f"{side}_id").alias("id"), "name")
    links = classes.groupBy(F.col(f"{side}_name").alias("linked")).agg(F.sum(rows).alias("links"))
    names = ids.groupBy("name").agg(F.min("id").alias("class_id")).join(links, F.col("name") == F.col("linked"), "left")
    names = names.select(F.col("name").alias("own"), "class_id", F.coalesce("links", F.lit(0)).alias("links"))
    return ids.join(names, F.col("name").eqNullSafe(F.col("own"))).select(F.lit(side).alias("side"), "id", "class_id", "links", "name")


def keyword_subset(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, id, class_id, links): each row of either side with its class, and with how many rows of the other keyword_classes() links it.

    Rows of one name have the same links, so pairs of rows are those of their classes, which keyword_classes() lists; written
    out they grow with the square of the rows, as keyword_links() has them.
    """
    classes = keyword_classes(left, right)
    return _linked(left, "left", classes, "right_rows").union(_linked(right, "right", classes, "left_rows")).drop("name")


#: Right rows of one name that one task pairs with the left rows linked to it, and pairs that one task writes.
LINKED_ROWS, TASK_LINKS = 1000, 20_000_000


def keyword_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, id, class_id, links, linked_id): the rows of keyword_subset(), a left row once for each right row that it is linked to.

    Every pair of linked rows is a row of the left side. A left row without links and the rows of the right side come once, with no linked_id.
    Pairs are few bytes of input each, so as many tasks write them as their number asks for, from parts of names.
    """
    spark, path = left.sparkSession, f"{shared_dir(left.sparkSession)}/classes-{uuid.uuid4().hex}"
    made = keyword_classes(left, right)
    made.write.parquet(path)
    classes = spark.read.schema(made.schema).parquet(path)
    pairs = classes.agg(F.sum(F.col("left_rows").cast("decimal(38)") * F.col("right_rows"))).first()[0] or 0
    tasks = max(-(-int(pairs) // TASK_LINKS), int(spark.conf.get("spark.sql.shuffle.partitions")))
    lefts, rights = _linked(left, "left", classes, "right_rows"), _linked(right, "right", classes, "left_rows")
    parts = F.ceil(F.col("right_rows") / LINKED_ROWS).cast("int")
    names = classes.select(F.col("left_name").alias("name"), F.col("right_name").alias("block"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    dealt = right.join(classes.select(F.col("right_name").alias("name"), parts.alias("parts")).distinct(), "name")
    dealt = dealt.select(F.col("name").alias("block"), F.pmod(F.xxhash64("right_id"), "parts").cast("int").alias("part"), F.col("right_id").alias("linked_id"))
    linked = lefts.join(names, "name").drop("name").repartition(tasks, "block", "part").join(dealt.repartition(tasks, "block", "part"), ["block", "part"])
    columns = ("side", "id", "class_id", "links")
    none = F.lit(None).cast(right.schema["right_id"].dataType).alias("linked_id")
    return linked.select(*columns, "linked_id").union(lefts.where("links = 0").union(rights).select(*columns, none))
