"""Whether places are in the US, with every country and a gazetteer of cities as tables.

What a place's own words say comes first (relevance.signal); places that they leave open are looked
up, phrase by phrase, in a gazetteer (name, country) of any size, by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams
from .relevance import STATES, normalize_location, signal

#: Distinct places whose answers are broadcast.
BROADCAST_ROWS = 500_000


def countries(spark: SparkSession) -> list[tuple[str, str, str]]:
    """(alpha-3, alpha-2, name) in lower case of every country but the US, from the ISO 3166 table that comes with Java."""
    locale = spark.sparkContext._jvm.java.util.Locale
    out = []
    for code in locale.getISOCountries():
        one = locale.Builder().setRegion(code).build()
        name = one.getDisplayCountry(locale.ENGLISH).lower()
        if code != "US" and name not in STATES.values():
            out.append((one.getISO3Country().lower(), code.lower(), name))
    return sorted(out)


def located(rows: DataFrame, gazetteer: DataFrame, location: str = "location", known: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """rows with is_us. A city's name counts as in the US if the gazetteer has it there too; what nothing speaks for is taken to be in the US.

    gazetteer: (name, country), country as two letters. Each distinct place is looked up once.
    """
    from .relevance import COUNTRIES

    known = known if known is not None else COUNTRIES
    places = rows.select(F.col(location).alias("place")).distinct().select("place", signal(F.col("place"), known).alias("said"))
    cities = gazetteer.groupBy(F.lower("name").alias("phrase")).agg(F.bool_or(F.upper("country") == "US").alias("us"))
    phrases = places.where("said IS NULL").select("place", F.explode(ngrams(F.filter(F.split(normalize_location(F.coalesce("place", F.lit(""))), " "), lambda t: t != ""))).alias("phrase"))
    # a null place has been told already, so that plain joins do
    found = phrases.join(cities, "phrase").groupBy(F.col("place").alias("at")).agg(F.bool_or("us").alias("us"))
    answers = places.join(found, F.col("place") == F.col("at"), "left").select(F.coalesce("place", F.lit("")).alias("__at"), F.coalesce("said", "us", F.lit(True)).alias("is_us"))
    answers = answers.dropDuplicates(["__at"])
    small = answers.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(answers) if small else answers, F.coalesce(F.col(location), F.lit("")) == F.col("__at"), "left").drop("__at")
