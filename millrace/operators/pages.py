"""Listing pages: where a scan may stop, and deliveries that are given up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def early_exit(pages: DataFrame, share: float = 0.8, pages_in_row: int = 2) -> DataFrame:
    """(scan, exit_page, n_pages): the first page at which so many in a row have that share of known ids, or one has nothing else."""
    by_page = pages.groupBy("scan", "page").agg(F.count("*").alias("n"), F.count_if("known").alias("k"))
    high = F.when(F.col("k") >= share * F.col("n"), 1).otherwise(0)
    w = Window.partitionBy("scan").orderBy("page").rowsBetween(1 - pages_in_row, 0)
    rows = by_page.select("scan", "page", (F.col("k") == F.col("n")).alias("whole"), F.sum(high).over(w).alias("run"))
    stop = F.col("whole") | (F.col("run") >= pages_in_row)
    return rows.groupBy("scan").agg(F.min(F.when(stop, F.col("page"))).alias("exit_page"), F.count("*").alias("n_pages"))


def dead_letters(deliveries: DataFrame, most: int = 5) -> DataFrame:
    """(message, n, state): messages delivered that often without success are set aside; others are retried or done."""
    rows = deliveries.groupBy("message").agg(F.count("*").alias("n"), F.bool_or("ok").alias("done"))
    return rows.select("message", "n", F.when(F.col("done"), "done").when(F.col("n") >= most, "dead").otherwise("retry").alias("state"))
