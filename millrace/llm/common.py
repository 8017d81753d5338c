"""What the operators share: the shared folder, written intermediate tables, let-bindings."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
WAVES = 1
FILE_BYTES = 8 << 20
_WRITE = {"compression": "zstd", "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}


def narrow(df: DataFrame) -> DataFrame:
    """df in at most WAVES tasks a core, for small tables: each task that writes makes a file, and local stores start a process for each."""
    return df.coalesce(WAVES * df.sparkSession.sparkContext.defaultParallelism)


_written: list[str] = []


def sized(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """df in no more tasks than its source has pieces of FILE_BYTES, two a core at least: small tables cut into many parts would make as many small files."""
    plan = (df if source is None else source)._jdf.queryExecution().optimizedPlan()
    parts = -(-int(str(plan.stats().sizeInBytes())) // FILE_BYTES)
    return df.coalesce(min(1 << 30, max(2 * df.sparkSession.sparkContext.defaultParallelism, parts)))


def materialize(df: DataFrame, name: str, wide: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, keeps column pruning.

    wide: for tables that grow with the texts, as many files as their size asks for.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (sized(df) if wide else narrow(df)).write.options(**_WRITE).parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables this process has written and not yet let go: a mark for release()."""
    return len(_written)


def release(since: int, keep: DataFrame) -> None:
    """Delete the tables written since a mark but the one that keep reads, once it has been written from them."""
    spark = keep.sparkSession
    own = {f.rsplit("/", 1)[0].rsplit("/", 1)[-1] for f in keep.inputFiles()}
    gone = [path for path in _written[since:] if path.rsplit("/", 1)[-1] not in own]
    for name in gone:
        _written.remove(name)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def hadoop(spark: SparkSession, name: str) -> tuple:
    """The file system of a path, and the path, as the JVM has them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared one, which cleanup() deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def discard(df: DataFrame) -> None:
    """Delete the files behind a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Delete all intermediate tables that this process has written, once no result that reads them is needed any more."""
    while _written:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, also where body refers to it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str, block: int = 256) -> Column:
    """emit(state, item) for each item of an array, with the state that step carried there; kind: emit's type.

    Arrays only grow within a block and by one for each block, so that long ones don't cost the square of their length.
    """
    none, nones = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")
    one = lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(emit(s["at"], x))).alias("out"))
    inner = lambda s, part: F.aggregate(part, F.struct(s["at"].alias("at"), none.alias("out")), one)
    outer = lambda s, part: let(inner(s, part), lambda r: F.struct(r["at"].alias("at"), F.concat(s["out"], F.array(r["out"])).alias("out")))
    parts = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / block).cast("int")), lambda b: F.slice(a, b * block + 1, F.lit(block)))
    whole = lambda a: F.flatten(F.aggregate(parts(a), F.struct(state.alias("at"), nones.alias("out")), outer, lambda s: s["out"]))
    return let(items, lambda a: F.when(F.size(a) > 0, whole(a)).otherwise(none))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores after it as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


def exists(spark: SparkSession, path: str) -> bool:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text, split at ASCII white space; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")
