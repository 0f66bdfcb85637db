"""Rows whose key is among others, behind a bitmap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a bitmap, and the bits of each (those of bitmap_construct_agg).
SLOTS, SLOT_BITS = 1024, 1 << 15


def among(docs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of docs whose key is among keys (a column of that name; nulls are not).

    A bitmap of hashes, 4 MB at most, tells first which rows may be, so that texts of few others are exchanged. The join
    behind it is exact, and of one form at every size: its shuffle grows in proportion to the rows. It is no semi-join, as
    Spark would move that below the bitmap.
    """
    at = F.xxhash64(key)
    slot, bit = F.pmod(at, F.lit(SLOTS)).cast("int"), F.pmod(F.shiftrightunsigned(at, 32), F.lit(SLOT_BITS))
    held = keys.where(F.col(key).isNotNull()).select(slot.alias("_slot"), bit.alias("_bit"))
    held = held.groupBy("_slot").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    maybe = docs.withColumn("_slot", slot).join(F.broadcast(held), "_slot").where(byte.bitwiseAND(F.pow(F.lit(2), bit % 8).cast("int")) != 0)
    return maybe.select(*[F.col(f"`{c}`") for c in docs.columns]).join(keys.select(key).distinct().hint("merge"), key)
