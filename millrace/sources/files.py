"""Landed files: encoding and delimiter by their first bytes, all-string reads, coercion, archives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"), (b"\xef\xbb\xbf", "UTF-8"))


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, delimiter) from a file's first bytes: byte-order mark, then whether the first line has more tabs or commas."""
    encoding = next((name for mark, name in MARKS if head.startswith(mark)), "UTF-8")
    line = head.decode(encoding, "replace").lstrip("﻿").split("\n", 1)[0]
    return encoding, "\t" if line.count("\t") > line.count(",") else ","


def head_of(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    """The first bytes of a file, from any store that Spark reads, no more of it; of a folder or pattern, of its first file that holds data."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s for s in store.globStatus(at) or ()]
    files = [f for s in found for f in (store.listStatus(s.getPath()) if s.isDirectory() else [s])]
    named = sorted(f.getPath().toString() for f in files if f.isFile() and f.getLen() and not f.getPath().getName().startswith(("_", ".")))
    if not named:
        return b""
    stream = store.open(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named[0]))
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def header(name: str) -> str:
    """A column's name as the readers give it: upper case, one underscore for anything else."""
    import re

    return re.sub(r"[^A-Z0-9]+", "_", name.strip().lstrip("﻿").upper()).strip("_")


def read_delimited(spark: SparkSession, path: str, required: Sequence[str] = ()) -> DataFrame:
    """A delimited file with all columns as strings and plain names; a missing required column is an error."""
    encoding, sep = sniff(head_of(spark, path))
    df = spark.read.csv(path, header=True, sep=sep, encoding=encoding, inferSchema=False)
    df = df.toDF(*[header(c) for c in df.columns])
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"columns missing: {', '.join(missing)}")
    return df


def number(c: Column) -> Column:
    """A whole number written with thousands commas or blanks; 0 if it is none."""
    return F.coalesce(F.regexp_replace(F.trim(c), ",", "").try_cast("bigint"), F.lit(0))


def load_filings(df: DataFrame, visa_class: str = "H-1B") -> DataFrame:
    """Filings of one visa class with an employer number, as strings but for year and positions; rows keep an ordinal."""
    rows = df.withColumn("ordinal", F.monotonically_increasing_id()).where((F.trim("VISA_CLASS") == visa_class) & (F.trim(F.coalesce("EMPLOYER_FEIN", F.lit(""))) != ""))
    year = F.coalesce(F.year(F.coalesce(F.try_to_timestamp("DECISION_DATE", F.lit("yyyy-MM-dd")), F.try_to_timestamp("DECISION_DATE", F.lit("M/d/yyyy")))), F.lit(0))
    return rows.select("ordinal", F.trim("EMPLOYER_FEIN").alias("fein"), F.trim("CASE_STATUS").alias("status"), number(F.col("TOTAL_WORKER_POSITIONS")).alias("positions"), F.trim("SOC_CODE").alias("soc"), F.trim("JOB_TITLE").alias("title"), year.alias("year"), F.trim("EMPLOYER_STATE").alias("employer_state"))


def load_petitions(df: DataFrame, names: Mapping[str, str], counts: Sequence[str]) -> DataFrame:
    """Petitions under given names: counts as numbers, bad years and negative counts left out."""
    rows = df.select(*[F.col(a).alias(b) for a, b in names.items()])
    rows = rows.withColumns({c: number(F.col(c)) for c in counts} | {"fiscal_year": number(F.col("fiscal_year"))})
    good = F.col("fiscal_year").between(1990, 2100)
    for c in counts:
        good = good & (F.col(c) >= 0)
    return rows.where(good)


def crawl_index(spark: SparkSession, path: str, crawl: str, hosts: Sequence[str]) -> DataFrame:
    """Addresses of a partitioned columnar crawl index; crawl, subset and status prune partitions and row groups."""
    rows = spark.read.parquet(path).where((F.col("crawl") == crawl) & (F.col("subset") == "warc") & (F.col("fetch_status") == 200))
    return rows.where(F.col("url_host_registered_domain").isin(*hosts)).select("url", "url_host_registered_domain", "url_path")


def append_archive(rows: DataFrame, path: str) -> None:
    """Rows that are about to be deleted, kept as compressed text."""
    rows.write.mode("append").option("header", True).option("compression", "gzip").csv(path)


def copy_shared_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """source in target's columns and types, those that it lacks null."""
    empty = target.limit(0)
    cast = source.select(*[F.col(c).cast(target.schema[c].dataType).alias(c) for c in source.columns if c in target.columns])
    return empty.unionByName(cast, allowMissingColumns=True)
