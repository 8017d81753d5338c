"""Labour filings: employer aggregates, breakdowns, incremental merge, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDINAL = ("decided", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
_SUMS = ("filed", "certified", "denied", "withdrawn", "positions", "certified_positions")


def employers(filings: DataFrame) -> DataFrame:
    """Per employer: counts by status, positions, the rate, and attributes of the last row by ordinal."""
    is_ = lambda s: F.col("status") == s
    last = F.struct(*ORDINAL)
    rows = filings.groupBy("fein").agg(
        F.count("*").alias("filed"), F.count_if(is_("Certified")).alias("certified"), F.count_if(is_("Denied")).alias("denied"), F.count_if(is_("Withdrawn")).alias("withdrawn"),
        F.sum("positions").alias("positions"), F.coalesce(F.sum(F.when(is_("Certified"), F.col("positions"))), F.lit(0)).alias("certified_positions"),
        F.max_by(F.struct("employer_state", "soc"), last).alias("attributes"),
    )
    return rows.select("fein", *_SUMS, rate().alias("certification_rate"), F.col("attributes.employer_state").alias("state"), F.col("attributes.soc").alias("last_soc"))


def rate():
    return F.when(F.col("filed") > 0, F.round(F.lit(100.0).cast("double") * F.col("certified") / F.col("filed"), 1)).otherwise(0.0)


def top_titles(filings: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent non-blank titles of each employer, from exact counts; ties by title."""
    counts = filings.where("trim(title) <> ''").groupBy("fein", "title").agg(F.count("*").alias("n"))
    w = Window.partitionBy("fein").orderBy(F.desc("n"), "title")
    return counts.select("fein", "title", "n", F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def merge_titles(state: DataFrame, batch: DataFrame, key: str = "fein", titles: str = "titles", k: int = 15) -> DataFrame:
    """(key, titles): the counts of both, titles an array of (title, count), summed by title; the k most frequent, ties by title."""
    item = F.explode(titles).alias("t")
    rows = state.select(key, item).unionByName(batch.select(key, item)).where("t.title <> ''").groupBy(key, "t.title").agg(F.sum("t.count").alias("n"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "title"))).where(F.col("rank") <= k)
    listed = F.array_sort(F.collect_list(F.struct("rank", "title", "n")))
    return ranked.groupBy(key).agg(F.transform(listed, lambda x: F.struct(x["title"].alias("title"), x["n"].alias("count"))).alias(titles))


def by_soc(filings: DataFrame) -> DataFrame:
    return filings.where("trim(soc) <> ''").groupBy("fein", "soc").agg(F.count("*").alias("filed"), F.count_if(F.col("status") == "Certified").alias("certified"), F.min_by("title", F.struct(*ORDINAL, "title")).alias("first_title"))


def by_year(filings: DataFrame) -> DataFrame:
    return filings.where("year <> 0").groupBy("fein", "year").agg(F.count("*").alias("filed"), F.count_if(F.col("status") == "Certified").alias("certified"), F.sum("positions").alias("positions"))


def merge(state: DataFrame, batch: DataFrame, name: str) -> DataFrame:
    """Totals plus a batch's, the rate anew, the batch's name among those done; a batch already there changes nothing.

    state: (fein, sums, certification_rate, batches). The new state is to be written elsewhere and
    swapped in.
    """
    done = state.where(F.array_contains("batches", name)).select("fein")
    fresh = batch.select("fein", *_SUMS).join(done, "fein", "left_anti").withColumn("batches", F.array(F.lit(name)))
    both = state.select("fein", *_SUMS, "batches").unionByName(fresh).groupBy("fein")
    rows = both.agg(*[F.sum(c).alias(c) for c in _SUMS], F.array_sort(F.array_distinct(F.flatten(F.collect_list("batches")))).alias("batches"))
    return rows.select("fein", *_SUMS, rate().alias("certification_rate"), "batches")


def upsert_latest(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key; null keys are as empty ones."""
    filled = rows.withColumns({k: F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    w = Window.partitionBy(*keys).orderBy(*order)
    return filled.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


APPROVALS = [f"a{i}" for i in range(1, 7)]


def unmatched(petitions: DataFrame, employers_: DataFrame, mapped: DataFrame | None = None) -> DataFrame:
    """Petitions that no employer fits by (legal name, or brand) and the last four digits, nor a fuzzy map; summed by name and digits.

    The digits are the equal part of the join key; the names are tested on what shares them.
    """
    e = employers_.select(F.col("legal_norm").alias("e_legal"), F.col("dba_norm").alias("e_dba"), F.right("fein", F.lit(4)).alias("e_tax"))
    rest = petitions.join(e, (F.col("tax_id") == F.col("e_tax")) & ((F.col("legal_norm") == F.col("e_legal")) | (F.col("full_norm") == F.col("e_dba"))), "left_anti")
    if mapped is not None:
        rest = rest.join(mapped.select("legal_norm", "tax_id"), ["legal_norm", "tax_id"], "left_anti")
    return rest.groupBy("legal_norm", "tax_id").agg(F.count("*").alias("n"), *[F.sum(a).alias(a) for a in APPROVALS])


def yearly(petitions: DataFrame, employers_: DataFrame) -> DataFrame:
    """Approvals by employer and year over petitions that fit it."""
    e = employers_.select("fein", F.col("legal_norm").alias("e_legal"), F.col("dba_norm").alias("e_dba"), F.right("fein", F.lit(4)).alias("e_tax"))
    got = petitions.join(e, (F.col("tax_id") == F.col("e_tax")) & ((F.col("legal_norm") == F.col("e_legal")) | (F.col("full_norm") == F.col("e_dba"))))
    return got.groupBy("fein", "fiscal_year").agg(F.count("*").alias("n"), F.sum(sum((F.col(a) for a in APPROVALS[1:]), F.col(APPROVALS[0]))).alias("approvals"))


def top_entities(filed: DataFrame, approved: DataFrame, k: int) -> DataFrame:
    """The k employers with the most approvals, or, without any, certified filings."""
    totals = approved.groupBy("fein").agg(F.sum("approvals").alias("approvals"))
    return filed.join(totals, "fein", "left").select("fein", F.coalesce("approvals", "certified").alias("measure"), F.col("approvals").isNotNull().alias("has_petitions")).orderBy(F.desc_nulls_last("measure"), "fein").limit(k)
