"""A Bloom filter over keys, to test membership where rows are read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

BLOCK_BITS = 4096
HASHES = 5
BITS_PER_KEY = 12
# 512 MiB. Up to some 350 million keys, less than one foreign row in a hundred passes; with more
# keys more pass by chance, and are dropped by the join that follows.
MOST_BLOCKS = 1 << 20


def among(rows: DataFrame, key: Column, keys: DataFrame, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """The ``rows`` whose ``key`` may be in the one column of ``keys``, which should be staged.

    No row with such a key is lost. The filter has ``bits_per_key`` bits for each key, in blocks of
    4096 bits: a hash of the key names its block, and five more hashes the bits in it, so a row
    meets one block. Blocks are made by an aggregation and broadcast; neither side's rows are shuffled by key.
    """
    blocks = max(1, min(-(-keys.count() * bits_per_key // BLOCK_BITS), MOST_BLOCKS))

    def block(value: Column) -> Column:
        return F.pmod(F.xxhash64(value), F.lit(blocks))

    def places(value: Column) -> list[Column]:
        mixed = F.xxhash64(value, F.lit("place"))
        return [F.shiftrightunsigned(mixed, 12 * k).bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int") for k in range(HASHES)]

    own = F.col(keys.columns[0])
    words = keys.select(block(own).alias("_block"), F.explode(F.array(*places(own))).alias("_place")).groupBy(
        "_block", F.shiftright("_place", 6).alias("_word")).agg(
        F.expr("bit_or(shiftleft(1L, _place & 63))").alias("_bits"))
    filled = words.groupBy("_block").agg(
        F.map_from_entries(F.collect_list(F.struct("_word", "_bits"))).alias("_held")).select(
        "_block", F.transform(F.sequence(F.lit(0), F.lit(BLOCK_BITS // 64 - 1)), lambda k: F.coalesce(
            F.col("_held")[k], F.lit(0).cast("long"))).alias("_words"))

    def is_set(place: Column) -> Column:
        word = F.get("_words", F.shiftright(place, 6))
        return F.call_function("shiftrightunsigned", word, place.bitwiseAND(F.lit(63))).bitwiseAND(
            F.lit(1).cast("long")) == 1

    met = rows.withColumn("_block", block(key)).join(F.broadcast(filled), "_block")
    return met.where(reduce(lambda a, b: a & b, [is_set(place) for place in places(key)])).select(*rows.columns)
