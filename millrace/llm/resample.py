"""Quality classifier by importance resampling over hashed n-grams.

Two generative models over hashed word unigrams and bigrams are counted: one of the raw text, over
all rows, and one of the target text, over rows with a good label. A document's log importance
weight is the sum over its n-grams of log p(target) - log p(raw). With Gumbel noise added, the k
largest are a sample without replacement in proportion to the weights.

Target rows are a sample bounded by target_rows (those with the least hashes of their keys); raw
counts and scores cover all rows and whole texts. k is a share of all rows: by default the share of
good ones among the labels. The k-th largest is found by counting digits, four passes over numbers,
so that no task sorts the whole; rows that tie with it are all kept.

Defined results: a null or empty text has no n-grams and weight 0; the noise depends on key and
seed alone, so repeated rows share it; a text of any length is counted whole; labels other than 0 and
1 are left out; without good labels the weights are 0 and k is all rows; rows that tie with the k-th
are all kept; an empty table gives no rows; columns beyond those named are ignored, whatever their
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec
from .arrow import map_batches, slices
from .common import materialize

BUCKETS = 10_000
#: Share of the raw model in the target's, so that what the target lacks by chance weighs little.
TOWARDS_RAW = 0.3
#: Keys are taken in steps of 2**-20, from -2**32 to 2**32.
SCALE, OFFSET, DIGIT = 1 << 20, 1 << 52, 14


def grams(texts: list[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the unigrams and bigrams of lower-cased words between ASCII white space."""
    data, starts = textvec.join([(t or "").lower().encode("utf-8", "surrogatepass") for t in texts])
    start, end, first = textvec.word_spans(data, starts)
    word = textvec.spans_hash(textvec.running(data), start, end)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    pair = textvec.mix(word[:-1] * np.uint64(3) + textvec.mix(word[1:]))[text[:-1] == text[1:]] if len(word) else word
    both = np.concatenate((word, pair))
    return (both % np.uint64(buckets)).astype(np.int64), np.concatenate((text, text[:-1][text[:-1] == text[1:]] if len(word) else text))


def _tallied(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[list]:
    raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
    for batch in batches:
        for part in slices(batch):
            bucket, text = grams(part.column(1).to_pylist(), buckets)
            good = np.array(part.column(0).to_pylist(), dtype=bool)
            raw += np.bincount(bucket, minlength=buckets)
            target += np.bincount(bucket[good[text]], minlength=buckets) if len(bucket) else 0
    at = np.flatnonzero(raw)
    yield [at, raw[at], target[at]]


def _weighed(batches: Iterator[pa.RecordBatch], ratio: np.ndarray) -> Iterator[list]:
    for batch in batches:
        for part in slices(batch):
            bucket, text = grams(part.column(1).to_pylist(), len(ratio))
            yield [part.column(0), np.bincount(text, weights=ratio[bucket], minlength=len(part)), np.bincount(text, minlength=len(part))]


def kth_largest(rows: DataFrame, q: str, k: int) -> int | None:
    """The k-th largest value of a column of whole numbers from 0 to 2**56, by digits of DIGIT bits; None if there are fewer."""
    prefix, left = 0, k
    for level in range(3, -1, -1):
        shift = level * DIGIT
        here = rows.where(F.shiftright(q, shift + DIGIT) == prefix)
        counts = here.groupBy(F.shiftright(q, shift).alias("p")).agg(F.count("*").alias("n")).collect()
        for p, n in sorted(counts, reverse=True):
            if n >= left:
                prefix = p
                break
            left -= n
        else:
            return None
    return prefix


def resample(texts: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17, target_rows: int = 50_000, key: str = "doc_id", text: str = "text", label: str = "quality", buckets: int = BUCKETS) -> DataFrame:
    """(key, log_weight, n_grams, gumbel_key, kept), a row for each row of texts."""
    from pyspark.sql.types import DoubleType, LongType, StructField, StructType

    # only the columns named go on, under names of their own
    rows = texts.select(F.col(key).alias("key"), F.col(text).alias("text"))
    marks = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("label").isin(0, 1) & F.col("key").isNotNull())
    n, good = marks.agg(F.count("*"), F.count_if(F.col("label") == 1)).first()
    share = (good / n if good else 1.0) if share is None else share
    chosen = marks.where("label = 1").select("key").distinct().orderBy(F.xxhash64("key", F.lit(seed))).limit(target_rows)
    chosen = F.broadcast(materialize(chosen.select(F.col("key").alias("chosen")), "target"))
    marked = rows.join(chosen, F.col("key") == F.col("chosen"), "left").select(F.col("chosen").isNotNull().alias("good"), "text")
    found = map_batches(marked, _tallied, "bucket int, raw bigint, target bigint", buckets).groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[found["bucket"].to_numpy(dtype=int)], target[found["bucket"].to_numpy(dtype=int)] = found["raw"], found["target"]
    p = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
    t = (1 - TOWARDS_RAW) * (target + p) / (target.sum() + 1) + TOWARDS_RAW * p
    ratio = np.log(t / p) if target.sum() else np.zeros(buckets)
    schema = StructType([StructField("key", texts.schema[key].dataType), StructField("log_weight", DoubleType()), StructField("n_grams", LongType())])
    weighed = map_batches(rows, _weighed, schema, ratio)
    u = (F.shiftrightunsigned(F.xxhash64("key", F.lit(seed), F.lit("gumbel")), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    weighed = weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(u)))
    held = F.greatest(F.least(F.col("gumbel_key"), F.lit(2.0**31)), F.lit(-(2.0**31)))
    weighed = materialize(weighed.withColumn("q", F.floor(held * SCALE).cast("bigint") + OFFSET), "weighed", wide=True)
    k = math.ceil(share * weighed.count())
    least = kth_largest(weighed, "q", k) if k else 1 << 60
    return weighed.select(F.col("key").alias(key), "log_weight", "n_grams", "gumbel_key", (F.col("q") >= F.lit(least if least is not None else 0)).alias("kept"))
