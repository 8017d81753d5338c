"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Test items are short and documents long, so the whole-document signature of a containment search
would have to find Jaccard values of about one in a hundred, which no banding does without
misses. The sketch is therefore taken of the items. They are partitioned by their number n of
distinct shingles, a power of two to the next; a partition whose largest item has u keeps
u - ceil(t u) + 1 hashes of each of its items, or all that one has: the first in order of how many
documents have them, and among those of as many the least (bottom-k MinHash). A document with at
least t of an item's shingles lacks at most n - ceil(t n) of them and so meets the sketch: no
containing document is missed, and what is common to very many documents is in no sketch while an
item has enough that is not.

Met pairs are counted by their hashes first, and the pairs that reach the threshold in these are
verified by the shingles themselves. Nothing is ever joined on a shingle alone: rows grow with the
documents' hashes that any item has, and with the candidate pairs times their items' shingles. Only
DataFrame operations.

A shingle is five successive words, lower-cased runs of letters and digits.

Defined results: null or empty texts, items and documents of fewer than five words have no
shingles and give no rows; a text of any length is read whole; pairs at the threshold are found;
repeated rows of a key give one row, of all the shingles that they have; null keys of documents are
left out of the matches, and kept by drop(); an empty table on either side gives no rows. Columns
beyond those named are ignored by contained(), whatever their names, and kept by drop().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, narrow

#: A table with fewer rows than this is broadcast (16 bytes a row); a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 50_000_000


def terms(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(w: Column, size: int) -> Column:
    """64-bit hashes of the windows of an array of words that is a plain column; null if it has fewer."""
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))


def shingles(w: Column, size: int) -> Column:
    return F.when(F.size(w) >= size, F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def _small(df: DataFrame, size: Column | None = None) -> DataFrame:
    """df marked for broadcast if it has few rows and, where a column's bytes are given, few of those."""
    rows, total = df.agg(F.count("*"), F.sum(size) if size is not None else F.lit(0)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (total or 0) <= BROADCAST_BYTES else df


def hashes(items: DataFrame, size: int) -> DataFrame:
    """(key, h): the distinct hashes of each key's shingles."""
    return items.select("key", terms(F.col("text")).alias("w")).select("key", F.explode(shingle_hashes(F.col("w"), size)).alias("h")).distinct()


def sketches(own: DataFrame, frequency: DataFrame, threshold: float) -> DataFrame:
    """(key, n, h): each item's sketch from its hashes (key, h), by how many documents have them (h, documents)."""
    ranked = own.join(frequency, "h", "left").groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), "h"))).alias("s"))
    sized = ranked.select("key", F.size("s").alias("n"), "s").withColumn("partition", F.floor(F.log2("n")))
    lengths = sized.groupBy("partition").agg(F.max("n").alias("u"))
    lengths = lengths.select("partition", (F.col("u") - F.ceil(F.lit(threshold) * F.col("u") - 1e-9).cast("int") + 1).alias("length"))
    kept = sized.join(F.broadcast(lengths), "partition")  # some thirty partitions at most
    return kept.select("key", "n", F.explode(F.slice("s", F.lit(1), F.col("length"))).alias("x")).select("key", "n", "x.h")


def candidates(texts: DataFrame, own: DataFrame, threshold: float, size: int) -> DataFrame:
    """(doc, item) of the pairs that share enough hashes. own: (key, h) of the items."""
    any_item = _small(own.select("h").distinct())
    # a document's hash counts once; hits are at most its shingles
    hits = texts.select("key", terms(F.col("text")).alias("w")).select(F.col("key").alias("doc"), F.explode(shingle_hashes(F.col("w"), size)).alias("h"))
    hits = materialize(hits.join(any_item, "h", "left_semi").distinct(), "hits")
    frequency = materialize(hits.groupBy("h").agg(F.count("*").alias("documents")), "frequency")
    sketch = materialize(sketches(own, frequency, threshold), "sketch")
    met = hits.join(_small(sketch), "h").select("doc", F.col("key").alias("item"), "n").distinct()
    met = materialize(met, "met")
    shared = met.join(_small(own.select(F.col("key").alias("item"), "h")), "item").join(hits, ["doc", "h"], "left_semi")
    return shared.groupBy("doc", "item", "n").agg(F.count("*").alias("both")).where(F.col("both") >= threshold * F.col("n") - 1e-9).select("doc", "item")


def contained(texts: DataFrame, items: DataFrame, threshold: float = 0.8, size: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item_key, n_shared, n_shingles, containment) of all pairs that reach the threshold."""
    docs = texts.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null")
    tests = items.select(F.col(item_key).alias("key"), F.col(item_text).alias("text")).where("key is not null")
    own = materialize(hashes(tests, size), "own")
    pairs = materialize(candidates(docs, own, threshold, size), "pairs")
    met = _small(materialize(pairs.select(F.col("doc").alias("key")).distinct(), "met"))
    found = docs.join(met, "key", "left_semi").select(F.col("key").alias("doc"), terms(F.col("text")).alias("w"))
    found = found.select("doc", F.explode(F.array_distinct(shingles(F.col("w"), size))).alias("shingle"))
    test = tests.select(F.col("key").alias("item"), terms(F.col("text")).alias("w")).select("item", F.explode(F.array_distinct(shingles(F.col("w"), size))).alias("shingle")).distinct()
    test = materialize(test, "items")
    counts = _small(test.groupBy("item").agg(F.count("*").alias("n_shingles")))
    asked = pairs.join(_small(test, F.octet_length("shingle")), "item").select("doc", "item", "shingle")
    shared = asked.join(found.distinct(), ["doc", "shingle"], "left_semi").groupBy("doc", "item").agg(F.count("*").alias("n_shared"))
    shared = narrow(shared.join(counts, "item"))
    share = F.col("n_shared") / F.col("n_shingles")
    return shared.where(share >= threshold - 1e-9).select(F.col("doc").alias(key), F.col("item").alias(item_key), "n_shared", "n_shingles", share.alias("containment"))


def drop(texts: DataFrame, items: DataFrame, key: str = "doc_id", **settings: object) -> DataFrame:
    """The rows of texts that contain no item; all columns."""
    found = materialize(contained(texts, items, key=key, **settings).select(key).distinct(), "leaks")
    return texts.join(_small(found), key, "left_anti")
