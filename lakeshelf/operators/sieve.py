"""Picking rows of a wide table by keys without a shuffle of its rows.

Bits of the keys go to all executors as a few maps of 4 KB each. A map of places (numbers within a
group, such as a row's number in its file) is exact; one of hashed keys tells which rows surely lack a
key, and only the others meet the keys in a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: As a map has 32768 bits.
_BLOCK = 15
#: At most so many hashed bits, 32 MB; beyond some 16 million keys more rows than need be are joined.
_MOST = 28


def _maps(places: DataFrame, group: list[str], at: str) -> DataFrame:
    """The maps of places; of a bit more than once it is the same map."""
    block = places.select(*group, F.shiftright(at, _BLOCK).alias("_block"), F.col(at).bitwiseAND((1 << _BLOCK) - 1).alias("_bit"))
    maps = block.groupBy(*group, "_block").agg(F.bitmap_construct_agg("_bit").alias("_map"), F.max("_bit").alias("_last"))
    # without the zeros at its end: a group of few places has a map of few bytes
    return maps.select(*group, "_block", F.substring("_map", F.lit(1), (F.shiftright("_last", 3) + 1).cast("int")).alias("_map"))


def _bit(at: Column) -> Column:
    """Whether a row's bit is set in the map beside it; null without a map or beyond its end."""
    byte = F.substring(F.col("_map"), (F.shiftright(at.bitwiseAND((1 << _BLOCK) - 1), 3) + 1).cast("int"), F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("long"), at.bitwiseAND(7).cast("int")) == 1


def _tested(rows: DataFrame, maps: DataFrame, group: list[str], at: Column, inside: bool) -> DataFrame:
    own = rows.withColumn("_block", F.shiftright(at, _BLOCK)).withColumn("_at", at)
    maps = F.broadcast(maps)
    if inside:
        return own.join(maps, [*group, "_block"]).where(F.coalesce(_bit(F.col("_at")), F.lit(False))).select(*rows.columns)
    return own.join(maps, [*group, "_block"], "left").where(~F.coalesce(_bit(F.col("_at")), F.lit(False))).select(*rows.columns)


def at_places(rows: DataFrame, places: DataFrame, group: list[str], at: str, inside: bool = True) -> DataFrame:
    """The rows whose place (group and at, which both tables have) is among places, or is not."""
    return _tested(rows, _maps(places, group, at), group, F.col(at), inside)


def _hashed(column: str, bits: int) -> Column:
    return F.xxhash64(column).bitwiseAND((1 << bits) - 1)


def _by_hash(rows: DataFrame, keys: DataFrame, column: str, bits: int, inside: bool) -> DataFrame:
    maps = _maps(keys.select(_hashed(column, bits).alias("_hash")), [], "_hash")
    return _tested(rows, maps, [], _hashed(column, bits), inside)


def lacking(rows: DataFrame, keys: DataFrame, column: str, known: DataFrame | None = None) -> DataFrame:
    """The rows whose column isn't among the keys (a table of that column, cheap to read); null is no key.
    With known, a table of the column of all rows, those whose column is a key go without a join as well."""
    n = keys.count()
    if not n:
        return rows
    bits, keys = max(_BLOCK, min(_MOST, (16 * n).bit_length())), keys.select(column).distinct()
    near = _by_hash(rows, keys, column, bits, True)
    if known is not None:
        spared = _by_hash(known.select(column), keys, column, bits, True).join(keys, column, "left_anti")
        near = _by_hash(near, spared, column, bits, True)
    # no anti join, which would be moved to below the maps, and all rows with it
    rest = near.join(keys.withColumn("_key", F.lit(True)), column, "left").where("_key is null").select(*rows.columns)
    return _by_hash(rows, keys, column, bits, False).unionByName(rest)


def having(rows: DataFrame, keys: DataFrame, column: str, bits: int = 26) -> DataFrame:
    """The rows whose column is among the keys."""
    keys = keys.select(column)
    # no semi join, which would be moved to below the map
    return _by_hash(rows, keys, column, bits, True).join(keys.distinct(), column).select(*rows.columns)
