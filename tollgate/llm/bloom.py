"""Blocked Bloom filters as DataFrames, from Spark's bitmap functions only.

A filter is one row per block: `block` and `bits`, 32,768 bits each.  A key's 64-bit hash
picks one block and two bits in it.  `geometry` sizes a filter at 16 bits a key and at most
`MAX_BITS`, so a filter never exceeds 128 MB: that is the proven bound behind the broadcast
in `probe`.  Past it the filter only lets more keys through; callers confirm exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
MAX_BITS = 1 << 30


def geometry(n_keys: int) -> int:
    """Number of blocks for `n_keys` keys: a power of two, 1 to 32,768."""
    bits = BLOCK_BITS
    while bits < 16 * n_keys and bits < MAX_BITS:
        bits *= 2
    return bits // BLOCK_BITS


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1))


def _places(h: Column) -> list[Column]:
    return [F.shiftrightunsigned(h, s).bitwiseAND(F.lit(BLOCK_BITS - 1)) for s in (34, 49)]


def _slots(keys: DataFrame, h: Column, blocks: int) -> DataFrame:
    """One row per key and bit: slot = block * 32,768 + place."""
    base = _block(h, blocks) * F.lit(BLOCK_BITS)
    return keys.select(F.explode(F.array(*[base + p for p in _places(h)])).alias("slot"))


def _bits(slots: DataFrame) -> DataFrame:
    return slots.groupBy(F.floor(F.col("slot") / BLOCK_BITS).cast("long").alias("block")).agg(
        F.bitmap_construct_agg(F.col("slot") % BLOCK_BITS).alias("bits"))


def build(keys: DataFrame, h: Column, blocks: int) -> DataFrame:
    """Filter of all keys."""
    return _bits(_slots(keys, h, blocks).distinct())


def build_repeated(keys: DataFrame, h: Column, blocks: int) -> DataFrame:
    """Filter of the bits that are set at least twice: every repeated key passes it.

    The first pass: bits are counted with map-side sums, so a key on a third of the rows
    is one partial sum per task; a row moves two bit numbers and no text.
    """
    twice = _slots(keys, h, blocks).groupBy("slot").agg(F.count("*").alias("n")).where("n > 1")
    return _bits(twice)


def probe(df: DataFrame, h: Column, filt: DataFrame, blocks: int, name: str = "maybe") -> DataFrame:
    """`df` with the boolean `name`: may the key be in the filter?  No false negatives."""
    hit = df.withColumn("__h", h).withColumn("__block", _block(F.col("__h"), blocks))
    f = F.broadcast(filt.select(F.col("block").alias("__block"), F.col("bits").alias("__bits")))
    hit = hit.join(f, "__block", "left")
    tests = []
    for p in _places(F.col("__h")):
        byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(p, 3) + 1).cast("int"), F.lit(1))), 16, 10)
        tests.append(F.call_function("shiftright", byte.cast("int"), (p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
    ok = F.coalesce(tests[0] & tests[1], F.lit(False))
    return hit.withColumn(name, ok).drop("__h", "__block", "__bits")
