"""Registrable domains by a table of public suffixes, its wildcard and exception rules among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Some public suffixes, for small jobs and tests; a whole list is read by read_rules.
COMMON = ("com", "net", "org", "io", "co", "uk", "co.uk", "ac.uk", "gov.uk", "org.uk", "au", "com.au", "br", "com.br", "in", "co.in", "nz", "co.nz", "za", "co.za", "jp", "co.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck", "de", "fr", "eu")
#: Rules up to which they go to every task; beyond, they are joined by a shuffle.
MOST_SENT = 100_000


def common_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in COMMON], "rule string")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a list in the public form: a rule a line up to its first blank, // before remarks."""
    line = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    return spark.read.text(path).select(line.alias("rule")).where("rule <> '' AND NOT startswith(rule, '//')").distinct()


def _tails(labels: Column) -> Column:
    """A host's ends of one label, two labels and so on, as structs with their number of labels."""
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.struct(F.array_join(F.slice(labels, -k, k), ".").alias("tail"), k.alias("k")))


def host_roots(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, root) of distinct lower-case hosts.

    An exception rule wins and gives the suffix without its first label; else the longest rule; else the last label.
    The root is the suffix and one label more; a host that is itself a suffix, or an address in numbers, is its own.
    Rules are joined by the ends that they name: a wildcard's is what follows its star.
    """
    named = rules.where("rule <> ''").select(
        F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("tail"),
        F.col("rule").startswith("!").alias("spared"),
        F.col("rule").startswith("*.").alias("wild"),
    )
    by_tail = named.groupBy("tail").agg(F.bool_or("spared").alias("spared"), F.bool_or("wild").alias("wild"), F.bool_or(~F.col("spared") & ~F.col("wild")).alias("plain"))
    if rules.limit(MOST_SENT + 1).count() <= MOST_SENT:
        by_tail = F.broadcast(by_tail)
    labels = F.split("host", r"\.")
    ends = hosts.select("host", F.size(labels).alias("n"), F.explode(_tails(labels)).alias("e")).select("host", "n", "e.tail", "e.k")
    met = ends.join(by_tail, "tail", "left")
    length = F.when(F.col("wild") & (F.col("n") > F.col("k")), F.col("k") + 1).when(F.col("plain"), F.col("k"))
    found = met.groupBy("host").agg(F.max(F.when(F.col("spared"), F.col("k") - 1)).alias("spared"), F.max(length).alias("longest"), F.max("n").alias("n"))
    kept = F.coalesce("spared", "longest", F.lit(1)) + 1
    numbers = F.regexp_like("host", F.lit(r"^[0-9.]+$|:"))
    return found.select("host", F.when(numbers | (F.col("n") < kept), F.col("host")).otherwise(F.array_join(F.slice(labels, -kept, kept), ".")).alias("root"))


def with_root(rows: DataFrame, host: Column, rules: DataFrame, name: str = "root") -> DataFrame:
    """rows with the registrable domain of a host; null for a null or empty one. Ends and rules meet once a distinct host."""
    plain = F.nullif(F.regexp_replace(F.lower(F.trim(host)), r"\.$", ""), F.lit(""))
    given = rows.withColumn("__host", plain)
    roots = host_roots(given.where(F.col("__host").isNotNull()).select(F.col("__host").alias("host")).distinct(), rules)
    return given.join(roots.select(F.col("host").alias("__host"), F.col("root").alias("__root")), "__host", "left").drop("__host").withColumnRenamed("__root", name)
