"""Bloom filters of chunk ids: which rows of a delivery are surely new, without a shuffle.

A filter is a table of bitmaps of 32,768 bits, made by a bit-or aggregate that is reduced in the tasks; an id has one bitmap and
BITS bits in it.  A row with a bit that isn't set is new; of the others, some one in a hundred of the new ones and all that are there, an anti-join tells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDTH, BITS, PER_ID = 32_768, 4, 12
#: Bitmaps (4 KB each) that are broadcast at most.
MOST_BITMAPS = 8192


def bitmaps(n: int) -> int:
    """How many bitmaps hold n ids."""
    return max(1, -(-n * PER_ID // WIDTH))


def _bitmap(keys: list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*keys, F.lit(-1)), F.lit(count)).cast("int")


def _positions(keys: list[str]) -> list[Column]:
    return [F.pmod(F.xxhash64(*keys, F.lit(i)), F.lit(WIDTH)) for i in range(BITS)]


def build(ids: DataFrame, keys: list[str], count: int) -> DataFrame:
    """bitmap, bits of the ids (columns keys) in `count` bitmaps."""
    each = ids.select(_bitmap(keys, count).alias("bitmap"), F.explode(F.array(*_positions(keys))).alias("at"))
    return each.groupBy("bitmap").agg(F.bitmap_construct_agg("at").alias("bits"))


def tested(rows: DataFrame, keys: list[str], found: DataFrame, count: int) -> DataFrame:
    """rows with a column __maybe: whether the id may be among those of the filter."""
    def there(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, 1)), 16, 10).cast("int")
        return F.expr("1") == F.getbit(byte, (at % 8).cast("int")).cast("int")

    own = found.select(F.col("bitmap").alias("__bitmap"), F.col("bits").alias("__bits"))
    met = rows.withColumn("__bitmap", _bitmap(keys, count)).join(F.broadcast(own) if count <= MOST_BITMAPS else own, "__bitmap", "left")
    every = F.lit(True)
    for at in _positions(keys):
        every = every & there(at)
    return met.withColumn("__maybe", F.coalesce(F.col("__bits").isNotNull() & every, F.lit(False))).drop("__bitmap", "__bits")
