"""Structured Streaming forms: windows of errors, dedup within a day, state per key, liveness, sinks.

Event times are cast to instants at the source, as watermarks need; sessions run in UTC.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import adaptive as A
from ..session import ship
from .state import ROCKS


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """events as a stream of files, so many a batch, ts an instant."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def error_windows(requests: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Requests and errors in windows of 20 minutes every 10: a bucket and the one before it."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", "20 minutes", "10 minutes"), "platform")
    return w.agg(F.count("*").alias("requests"), F.count_if(F.col("class") != "ok").alias("errors")).select("platform", F.col("window.end").alias("until"), "requests", "errors")


def dedup_day(rows: DataFrame, *keys: str) -> DataFrame:
    """The first row of each key within a day of event time."""
    return rows.withWatermark("ts", "24 hours").dropDuplicatesWithinWatermark(list(keys))


def liveness(beats: DataFrame, gap: str = "24 hours") -> DataFrame:
    """Sessions of a worker's beats; the end of one is where it fell silent."""
    return beats.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), "worker").agg(F.count("*").alias("beats")).select("worker", F.col("session_window.start").alias("since"), F.col("session_window.end").alias("until"), "beats")


def _step(recent: list[float], interval: int, jobs: float, low: float, moderate: float, active: float) -> tuple[list[float], int, float | None]:
    """One poll: the rule of operators.adaptive folds itself, scores rounded before they are compared with bands."""
    (kept, interval, _, score), _ = A._polled((tuple(recent), interval, 0, None), jobs, low, moderate, active)
    return list(kept), interval, score


def adaptive_state(polls: DataFrame, low: float = 0.3, moderate: float = 0.8, active: float = 1.5) -> DataFrame:
    """(user_id, n_polls, score, interval_s) after each batch that touches a key; state is five counts, an interval and a number."""

    ship(polls.sparkSession)

    def update(key: tuple[Any, ...], parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, interval, n = (list(state.get[0]), state.get[1], state.get[2]) if state.exists else ([], A.DEFAULT, 0)
        rows = pd.concat(list(parts)).sort_values("at")
        score = None
        for jobs in rows["new_jobs"]:
            recent, interval, score = _step(recent, interval, jobs, low, moderate, active)
            n += 1
        state.update((recent, interval, n))
        yield pd.DataFrame({"user_id": [key[0]], "n_polls": [n], "score": [score], "interval_s": [interval]})

    return polls.groupBy("user_id").applyInPandasWithState(update, "user_id long, n_polls long, score double, interval_s long", "recent array<double>, interval long, n long", "update", GroupStateTimeout.NoTimeout)


def merge_into(path: str, keys: list[str], order: str):
    """A foreachBatch function that keeps the last row of each key in a table of snapshots, one folder a batch.

    A batch that is run again writes its folder again, so results are the same however often.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*")
        if number:
            old = spark.read.schema(batch.schema).parquet(f"{path}/batch={number - 1}")
            new = new.unionByName(old.join(new.select(*keys), keys, "left_anti"))
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


@contextmanager
def _rocks(spark: SparkSession) -> Iterator[None]:
    """The provider that transformWithState needs, for the queries that start in here."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def run_once(rows: DataFrame, sink: str, checkpoint: str, mode: str = "append", batches: int | None = None) -> DataFrame:
    """Drain a stream into Parquet, a folder a batch, and read that; or stop it, as a lost driver would, before batch number `batches` has been committed.

    A batch that is run again writes its folder again. Started anew with the same folders, a stream that was stopped goes on.
    """
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        if batches is not None and number >= batches:
            raise InterruptedError(f"stopped in batch {number}")

    with _rocks(spark):
        query = rows.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        except StreamingQueryException:
            if batches is None:
                raise
    return spark.read.schema(rows.schema).option("recursiveFileLookup", True).parquet(sink)


def add_into(path: str, keys: list[str], sums: list[str], every: int = 10):
    """A foreachBatch function that adds a batch's numbers to a table of sums.

    A batch writes its own sums, whatever was there, so one that is run again counts once. Every so many
    batches the sums so far become a snapshot, from the one before and the deltas after it, so a
    reader reads one snapshot and few deltas. total() reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        delta = batch.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))
        delta.write.mode("overwrite").parquet(f"{path}/delta={number}")
        if (number + 1) % every == 0:
            total(batch.sparkSession, path, delta.schema, keys, sums, number).write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return write


def _numbers(spark: SparkSession, pattern: str) -> list[int]:
    """The numbers of folders whose writing has ended."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{pattern}=*/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(s.getPath().getParent().getName().partition("=")[2]) for s in found or ())


def total(spark: SparkSession, path: str, schema, keys: list[str], sums: list[str], upto: int | None = None) -> DataFrame:
    """The sums that add_into() keeps: of the last snapshot and the batches after it."""
    last = [n for n in _numbers(spark, f"{path}/snapshot") if upto is None or n < upto][-1:]
    deltas = [n for n in _numbers(spark, f"{path}/delta") if n > (last[0] if last else -1) and (upto is None or n <= upto)]
    folders = [f"{path}/snapshot={n}" for n in last] + [f"{path}/delta={n}" for n in deltas]
    rows = spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
    return rows.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def recalibrated(polls: DataFrame, thresholds: DataFrame, score: str = "score") -> DataFrame:
    """Polls of a stream with the interval that the thresholds of their day give their score.

    thresholds: (day, low, moderate, active), a static table with a row a day; Spark reads it anew
    for each batch of the stream, so that each day's calibration holds from the batch after it came.
    A day without thresholds has those of the rules.
    """
    fixed = {"low": 0.3, "moderate": 0.8, "active": 1.5}
    joined = polls.join(F.broadcast(thresholds.select("day", *fixed)), F.to_date("ts") == F.col("day"), "left")
    at = {c: F.coalesce(c, F.lit(v)) for c, v in fixed.items()}
    s = F.col(score)
    interval = F.when(s.isNull() | (s == 0), A.DEFAULT).when(s < at["low"], A.LOW).when(s < at["moderate"], A.MODERATE).when(s < at["active"], A.ACTIVE).otherwise(A.SHORTEST)
    return joined.select(*polls.columns, interval.alias("interval_s"))


def throttled(spark: SparkSession, folder: str, depth: int, most: int = 5000, some: int = 2000, pattern: str = "events.parquet") -> DataFrame | None:
    """The stream's source under backpressure: nothing over `most` waiting, one file a batch over `some`, else as many as there are."""
    if depth > most:
        return None
    return read_events(spark, folder, pattern, 1 if depth > some else 1000)


def _folders(spark: SparkSession, path: str, before: int | None) -> dict[int, tuple[int, str]]:
    """{part: (batch, folder)}: the last folder of each part, of batches before one if that is given."""
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/part=*")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern)
    last: dict[int, tuple[int, str]] = {}
    for status in found or ():
        folder = status.getPath().toString()
        batch, part = (int(x.partition("=")[2]) for x in folder.rsplit("/", 2)[1:])
        if (before is None or batch < before) and batch > last.get(part, (-1, ""))[0]:
            last[part] = (batch, folder)
    return last


def merge_parts(path: str, keys: list[str], order: str, parts: int = 64):
    """A foreachBatch function that keeps the last row of each key in a table dealt to parts by key; a batch rewrites only the parts that it touches.

    A batch that is run again writes its folder again from the same ones before it, so results are
    the same however often. current() reads the table.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy(*keys).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")).persist()
        touched = {r.part for r in new.select("part").distinct().collect()}  # at most so many as there are parts
        old = [folder for part, (_, folder) in _folders(spark, path, number).items() if part in touched]
        merged = new
        if old:
            rows = spark.read.schema(batch.schema).parquet(*old).withColumn("part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int"))
            merged = new.unionByName(rows.join(new.select(*keys), keys, "left_anti"))
        merged.repartition("part").write.partitionBy("part").mode("overwrite").parquet(f"{path}/batch={number}")
        new.unpersist()

    return write


def current(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table that merge_parts() keeps, as of its last batch."""
    folders = [folder for _, folder in _folders(spark, path, None).values()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)
