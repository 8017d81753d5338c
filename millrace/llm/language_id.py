"""Language ID by Bayesian fusion of evidence.

log p(language | all) is, but for a constant, the sum of
- the text's log likelihood under byte n-gram models with hashed buckets, trained here, tempered,
  as successive n-grams repeat one another's evidence; words with digits in them are left out;
- the declared markup language's log likelihood: a declaration is right with a given probability;
- the address suffix's (.de, .fr ...), in the same way;
- the host's log prior, smoothed hierarchically: host towards suffix towards the whole corpus, from
  counts of the texts' own best languages by grouped aggregation over all rows.
A background model (any byte) stands for "und": a text that no language explains better than
chance is rejected, whatever was declared.

Models are fitted on a bounded sample of declared rows of each language (about sample_rows, those
with the least hashes of their keys); counts and scores cover all rows and whole texts. As a
declaration is evidence of its own, no text is scored by a model that its own declaration has
trained: keys are dealt to FOLDS folds, and each fold is scored by models of the others' rows
(a language with rows in one fold only has one model). Counts of n-grams are a table; what is in the
driver or a task's closure at once is the models of LANGUAGES languages, and texts of a corpus with
more pass through one Arrow function for each such part.

Defined results: a null or blank text, or one of such words only, is "und" and rejected; a declaration, suffix or host that is
null or unknown is no evidence; a language with fewer than least_rows declared rows has no model; a declaration counts by its primary subtag, two or three letters,
others are none; ties go to the language first in order; a text of any length is scored whole; null
keys and repeated rows are kept; a table without declared rows gives "und" for all; an empty table
gives no rows. identify() ignores columns beyond those named, whatever their names, and keep_known()
keeps them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec
from .arrow import give_back, map_batches, slices
from .common import materialize

NGRAM = 4
FOLDS = 5
#: Words with digits speak for no language.
_NUMBERS = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*")
BUCKETS = 1 << 16
#: Share of a text's n-grams that count as independent.
TEMPER = 0.25
RIGHT = 0.9
SALTS = 16
#: Languages whose models are in memory at once, of FOLDS * BUCKETS numbers each; rows that a language needs.
LANGUAGES, LEAST_ROWS = 8, 2
BROADCAST_ROWS = 500_000
#: Country suffixes and the language that they speak for, fixed values.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def _grams(texts: list[str | None], n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of the n-grams of bytes of lower-cased texts without words that have digits, white space runs as one space."""
    worded = [" ".join(_NUMBERS.sub("", (t or "").lower()).split()) for t in texts]
    clean = [f" {t} ".encode("utf-8", "surrogatepass") if t else b"" for t in worded]
    data, starts = textvec.join(clean)
    value = np.zeros(max(0, len(data) - n + 1), dtype=np.uint64)
    for k in range(n):
        value = value * np.uint64(257) + data[k : len(data) - n + 1 + k].astype(np.uint64) + np.uint64(1) if len(value) else value
    text = np.repeat(np.arange(len(texts)), np.diff(starts))[: len(value)]
    inside = np.arange(len(value)) + n < starts[1:][text] if len(value) else np.zeros(0, dtype=bool)
    return (textvec.mix(value[inside]) % np.uint64(buckets)).astype(np.int64), text[inside]


def _tallied(batches: Iterator[pa.RecordBatch], n: int, buckets: int) -> Iterator[list]:
    """Rows (lang, text): counts of buckets by language, one row for each that occurs in the task."""
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch):
            names, code = np.unique(np.array(part.column(0).to_pylist(), dtype=str), return_inverse=True)
            bucket, text = _grams(part.column(1).to_pylist(), n, buckets)
            code = code[text]
            for k, lang in enumerate(names.tolist()):
                counts[lang] = counts.get(lang, 0) + np.bincount(bucket[code == k], minlength=buckets)
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield [[lang] * len(at), at, c[at]]


class TextModel:
    """log p(bucket | language) less the background's, by the fold that they score, worked out from counts (lang, fold, bucket, n) as it is asked for; languages in order."""

    def __init__(self, languages: list[str], counts: DataFrame | None, buckets: int) -> None:
        self.languages, self.counts, self.buckets = languages, counts, buckets

    def seen(self, names: list[str]) -> np.ndarray:
        """Counts (language, fold, bucket) of some languages. They come as numbers in Arrow, so that the driver holds no row as an object."""
        place = (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("lang")) - 1).cast("int") * F.lit(FOLDS) + F.col("fold")
        out = np.zeros((len(names), FOLDS, self.buckets))
        for batch in self.counts.where(F.col("lang").isin(names)).select(place.alias("part"), "bucket", "n").toArrow().to_batches():
            part, bucket, n = (c.to_numpy() for c in batch.columns)
            np.add.at(out.reshape(-1), part.astype(np.int64) * self.buckets + bucket, n)
        return out

    def parts(self) -> Iterator[np.ndarray]:
        """(language, fold * buckets + bucket) in floats, of LANGUAGES languages at a time."""
        smooth, buckets = 0.05, self.buckets
        for start in range(0, len(self.languages), LANGUAGES):
            names = self.languages[start : start + LANGUAGES]
            out = np.empty((len(names), FOLDS * buckets), dtype=np.float32)
            for own, to in zip(self.seen(names), out, strict=True):
                # a fold is scored by what the others have seen
                others = own.sum(axis=0, keepdims=True) - own
                own = np.where(others.sum(axis=1, keepdims=True) > 0, others, own.sum(axis=0, keepdims=True))
                logp = np.log((own + smooth) / (own.sum(axis=1, keepdims=True) + smooth * buckets))
                to[:] = (logp + np.log(buckets)).reshape(-1)
            give_back()
            yield out


def primary(declared: Column) -> Column:
    """The primary subtag of a declared language, lower-cased, if it has two or three letters; else null."""
    tag = F.lower(F.substring_index(F.translate(F.trim(declared.cast("string")), "_", "-"), "-", 1))
    return F.when(F.regexp_like(tag, F.lit("^[a-z]{2,3}$")), tag)


def fold_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key, F.lit("fold")), F.lit(FOLDS)).cast("int")


def fit(rows: DataFrame, sample_rows: int = 10_000, key: str = "doc_id", text: str = "text", lang: str = "lang", n: int = NGRAM, buckets: int = BUCKETS, least_rows: int = LEAST_ROWS) -> TextModel:
    """Fit text models on about sample_rows rows of each language that at least least_rows rows declare. Their counts are written as a table; the driver gets the languages' names."""
    named = rows.select(F.col(key).alias("key"), primary(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = named.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least_rows).select(F.col("lang").alias("of"), (F.lit(float(sample_rows)) / F.col("n")).alias("share"))
    counts = materialize(counts, "declared")  # at most one row for each tag of two or three letters
    order = F.shiftrightunsigned(F.xxhash64("key", F.lit("sample")), 11).cast("double") * F.lit(2.0**-53)
    sample = named.join(F.broadcast(counts), F.col("lang") == F.col("of")).where(order < F.col("share"))
    sample = sample.select(F.concat_ws(" ", "lang", fold_of(F.col("key"))).alias("lang"), "text")
    found = map_batches(sample, _tallied, "lang string, bucket int, n bigint", n, buckets).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = materialize(found.select(F.substring_index("lang", " ", 1).alias("lang"), F.substring_index("lang", " ", -1).cast("int").alias("fold"), "bucket", "n"), "grams")
    return TextModel(sorted(r.lang for r in found.select("lang").distinct().collect()), found, buckets)


def _scored(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, buckets: int, n: int, last: bool) -> Iterator[list]:
    """Rows (key, declared, host, fold, text, score) to (key, declared, host, fold, text, scores and these, n-grams); after the last part no text. ratio: for each language a row, the folds' buckets one after the other."""
    for batch in batches:
        for part in slices(batch):
            rows = len(part)
            bucket, text = _grams(part.column(4).to_pylist(), n, buckets)
            at = (part.column(3).to_numpy().astype(np.int64) * buckets)[text] + bucket
            score = np.stack([np.bincount(text, weights=own[at], minlength=rows) for own in ratio], axis=1)
            before = part.column(5).flatten().to_numpy(zero_copy_only=False)
            score = np.concatenate((before.reshape(rows, -1), score), axis=1)
            count = np.bincount(text, minlength=rows)
            yield [*[part.column(k) for k in range(4)], pa.nulls(rows, pa.string()) if last else part.column(4), pa.array(list(score), type=pa.list_(pa.float64())), count]


def suffix_of(host: Column) -> Column:
    """The last label of a host name with a dot in it, lower-cased; else null."""
    return F.when(F.instr(host, ".") > 0, F.lower(F.substring_index(host, ".", -1)))


def identify(rows: DataFrame, model: TextModel, key: str = "doc_id", text: str = "text", declared: str | None = "lang", host: str | None = "source", strength: float = 10.0, least_posterior: float = 0.5, least_evidence: float = 0.3) -> DataFrame:
    """(key, lang, posterior, evidence, kept) for each row.

    evidence: the text's log likelihood ratio against the background, nats an n-gram, under the
    language chosen. strength: how many rows of a host its parent's shares weigh as much as.
    """
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

    n = len(model.languages)
    if not n:
        none = F.lit(None)
        return rows.select(F.col(key), F.lit("und").alias("lang"), none.cast("double").alias("posterior"), none.cast("double").alias("evidence"), F.lit(False).alias("kept"))
    lit = lambda c: F.col(c) if c else F.lit(None).cast("string")
    given = rows.select(F.col(key).alias("key"), primary(lit(declared)).alias("declared"), lit(host).cast("string").alias("host"), fold_of(F.col(key)).alias("fold"), F.col(text).alias("text"))
    fields = [StructField("key", rows.schema[key].dataType), StructField("declared", StringType()), StructField("host", StringType()), StructField("fold", IntegerType()), StructField("text", StringType())]
    schema = StructType([*fields, StructField("score", ArrayType(DoubleType())), StructField("grams", LongType())])
    scored = given.withColumn("score", F.array().cast("array<double>"))
    for k, ratio in enumerate(model.parts()):
        scored = map_batches(scored.select("key", "declared", "host", "fold", "text", "score"), _scored, schema, ratio, model.buckets, NGRAM, (k + 1) * LANGUAGES >= n)
    scored = scored.drop("fold", "text")
    names = F.array(*[F.lit(x) for x in model.languages])
    best = F.array_position("score", F.array_max("score")).cast("int")
    scored = materialize(scored.select("*", suffix_of(F.col("host")).alias("suffix"), F.when(F.col("grams") > 0, best).alias("best")), "scored", wide=True)

    counts = [F.count_if(F.col("best") == k + 1).cast("double") for k in range(n)]
    by_host = materialize(scored.where("host is not null").groupBy("host", "suffix").agg(F.array(*counts).alias("c")), "hosts")
    sums = [F.sum(F.get("c", k)) for k in range(n)]
    by_suffix = by_host.groupBy("suffix").agg(F.array(*sums).alias("s"))
    whole = scored.agg(*counts).first()
    total = sum(whole) + n
    corpus = F.array(*[F.lit((w + 1) / total) for w in whole])
    toward = lambda c, p: F.transform(c, lambda x, k: (x + strength * F.get(p, k)) / (F.aggregate(c, F.lit(0.0), lambda a, b: a + b) + strength))
    by_suffix = by_suffix.select("suffix", toward(F.col("s"), corpus).alias("sp"))
    priors = by_host.join(by_suffix, by_host["suffix"].eqNullSafe(by_suffix["suffix"])).select("host", toward(F.col("c"), F.col("sp")).alias("prior"))
    # a host may hold a third of all rows: its rows are dealt to SALTS tasks, its prior copied to each
    salted = priors.select("host", "prior", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    row = scored.withColumn("salt", F.pmod(F.xxhash64("key", "grams"), F.lit(SALTS)).cast("int"))
    joined = row.join(salted, ["host", "salt"], "left")

    by_address = F.create_map(*[F.lit(x) for pair in SUFFIXES.items() for x in pair])
    said = lambda it, name: F.when(F.array_contains(names, it), F.when(it == name, np.log(RIGHT)).otherwise(np.log((1 - RIGHT) / max(1, n - 1)))).otherwise(0.0)
    logs = F.transform("score", lambda s, k: s * TEMPER + said(F.col("speaks"), F.get(names, k)) + said(F.col("spoken"), F.get(names, k)) + F.log(F.get(F.coalesce("prior", corpus), k)))
    fused = joined.withColumns({"speaks": F.coalesce("declared", F.lit("")), "spoken": F.coalesce(F.element_at(by_address, F.col("suffix")), F.lit(""))}).select("key", "score", "grams", logs.alias("logs"))
    chosen = fused.select("key", "score", "grams", "logs", F.array_position("logs", F.array_max("logs")).cast("int").alias("top"))
    mass = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.array_max("logs")))
    out = chosen.select("key", F.get(names, F.col("top") - 1).alias("name"), (1 / mass).alias("posterior"), F.when(F.col("grams") > 0, F.get("score", F.col("top") - 1) / F.col("grams")).alias("evidence"))
    good = F.coalesce(F.col("evidence") >= least_evidence, F.lit(False)) & (F.col("posterior") >= least_posterior)
    return out.select(F.col("key").alias(key), F.when(F.coalesce(F.col("evidence") >= least_evidence, F.lit(False)), F.col("name")).otherwise("und").alias("lang"), "posterior", "evidence", good.alias("kept"))


def keep_known(rows: DataFrame, model: TextModel, key: str = "doc_id", **settings: object) -> DataFrame:
    """The rows of a table but those that are rejected; all columns. A key goes if all its rows are rejected; rows without a key stay."""
    judged = identify(rows, model, key, **settings).where(F.col(key).isNotNull())
    gone = materialize(judged.groupBy(key).agg(F.bool_or("kept").alias("kept")).where("not kept").select(key), "rejected")
    return rows.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, key, "left_anti")
