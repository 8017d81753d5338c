"""A blocked Bloom filter as a table, and scan generations compared through it. Exact: what the filter lets through is joined.

A key's bits all lie in one block of 32,768, so a filter is a small table (block, bits), and a probe is one join on the block.
It is sized from the count of keys. All of it is built-in functions; the filter goes to every task only up to a size that is checked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a block (fixed by bitmap_construct_agg), bits for a key, positions of a key, bytes of a filter that is sent to every task.
BLOCK, BITS, TESTS, MOST_BYTES = 32768, 12, 4, 32 << 20


def blocks(n: int) -> int:
    return max(1, -(-n * BITS // BLOCK))


def _block(keys: Sequence[str], count: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(count)).cast("int")


def _positions(keys: Sequence[str]) -> Column:
    """Places in the block, from 15 bits each of another hash."""
    h = F.xxhash64(F.lit(2), *keys)
    return F.array(*(F.shiftrightunsigned(h, 15 * k).bitwiseAND(F.lit(BLOCK - 1)) for k in range(TESTS)))


def build(known: DataFrame, keys: Sequence[str], count: int) -> DataFrame:
    """(block, bits) of the keys of known; blocks without a key have no row. Bits are set map-side before the shuffle."""
    places = known.select(_block(keys, count).alias("block"), F.explode(_positions(keys)).alias("at"))
    return places.groupBy("block").agg(F.bitmap_construct_agg("at").alias("bits"))


def with_maybe(rows: DataFrame, keys: Sequence[str], bits: DataFrame, count: int, name: str = "maybe") -> DataFrame:
    """rows with whether their key may be known; false is certain."""
    byte = lambda p: F.conv(F.hex(F.substring("__bits", (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    is_set = lambda p: F.getbit(byte(p), p.bitwiseAND(F.lit(7)).cast("int")) == 1
    met = rows.withColumn("__block", _block(keys, count)).join(F.broadcast(bits.select(F.col("block").alias("__block"), F.col("bits").alias("__bits"))), "__block", "left")
    return met.withColumn(name, F.col("__bits").isNotNull() & F.forall(_positions(keys), is_set)).drop("__block", "__bits")


def unseen(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key is not among known's; those with a null key all stay, as by an anti join.

    Rows that the filter excludes take no part in the join's shuffle. Above MOST_BYTES there is the join alone.
    """
    count = blocks(known.count())
    exact = lambda x: x.join(known.select(*keys).distinct(), list(keys), "left_anti")
    if count * BLOCK // 8 > MOST_BYTES:
        return exact(rows).select(rows.columns)
    tested = with_maybe(rows, keys, build(known.select(*keys), keys, count), count, "__maybe")
    sure = tested.where(~F.col("__maybe")).drop("__maybe")
    return sure.select(rows.columns).unionByName(exact(tested.where("__maybe").drop("__maybe")).select(rows.columns))


def generations(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """Keys of the new scan that the last whole one did not hold (appeared), and those that only the last one held (vanished)."""
    fresh = unseen(new.select(*keys).distinct(), old, *keys).withColumn("change", F.lit("appeared"))
    return fresh.unionByName(unseen(old.select(*keys).distinct(), new, *keys).withColumn("change", F.lit("vanished")))
