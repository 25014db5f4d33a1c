"""Sharding by jump consistent hashing (Lamping and Veach, 2014); DataFrame functions only.

The shard depends on the hash of doc_id and the number of shards alone, and with one more shard a row stays or
moves into the new one. The algorithm's 64-bit generator runs in decimals, whose products fit 38 digits; it jumps
ln(n) times on average and at most n times.

Slots number the rows of a shard from 0. Rows are numbered within hash ranges of a shard, and each range starts
where the counts of the ranges before it end, so no task orders a whole shard.

Cases: a null text has size 1 and the CRC of an empty text; all null doc_ids share a shard (the key decides), but
their slots are dealt by text; repeated rows share a shard and have slots of their own, interchangeable; an empty
table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Sealed, small, stored

NEW = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
#: The generator's multiplier.
MULTIPLIER = 2862933555777941757
_WRAP = 2**64
RANGE_ROWS = 5000


def key_hash(key: Column) -> Column:
    """The first 64 bits of MD5, as a decimal."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, 10).cast("decimal(20,0)")


def jump(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key (a decimal from 0 to 2^64 - 1) among ``shards``."""
    number = lambda x: F.lit(str(x)).cast("decimal(20,0)")

    def step(state: Column, _: Column) -> Column:
        drawn = ((state["key"] * F.lit(MULTIPLIER).cast("decimal(19,0)") + number(1)) % number(_WRAP)).cast("decimal(20,0)")
        top = F.floor(drawn / F.lit(2**33).cast("decimal(11,0)")).cast("double")
        landed = F.floor((state["at"] + 1).cast("double") * (F.lit(float(2**31)) / (top + 1))).cast("long")
        # a jump past the last shard ends the walk: the row stays where it was
        return F.struct(drawn.alias("key"), F.when(landed < shards, landed).otherwise(state["at"]).alias("at"), (landed >= shards).alias("done"))

    start = F.struct(key.alias("key"), F.lit(0).cast("long").alias("at"), F.lit(False).alias("done"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, lambda s, i: F.when(s["done"], s).otherwise(step(s, i)))
    return walked["at"].cast("int")


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``docs`` with size, text_crc32, law, shard, slot and grown_shard (the shard under one more)."""
    sealed = Sealed(docs)
    raw = F.coalesce(sealed["text"], F.lit("")).cast("binary")
    ranges = max(1, min(65536, docs.count() // (shards * RANGE_ROWS) + 4))
    hashed = sealed.df.withColumns({"id": sealed["doc_id"], "size": F.octet_length(raw).cast("long") + 1, "text_crc32": F.crc32(raw), "key": key_hash(sealed["doc_id"])})
    hashed = hashed.withColumns({"shard": jump(F.col("key"), shards), "grown_shard": jump(F.col("key"), shards + 1)})
    order = F.md5(F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("text_crc32").cast("string")).cast("binary"))
    hashed = hashed.withColumn("order", order)
    hashed = hashed.withColumn("range", F.floor(F.conv(F.substring("order", 1, 4), 16, 10).cast("long") * ranges / 65536).cast("int"))
    counts = hashed.groupBy("shard", "range").agg(F.count("*").alias("rows"))
    before = W.partitionBy("shard").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("shard").alias("s_shard"), F.col("range").alias("s_range"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    in_range = W.partitionBy("shard", "range").orderBy("order", "id", "size")
    placed = hashed.withColumn("slot", F.row_number().over(in_range).cast("long") - 1)
    placed = placed.join(small(stored(starts)), (F.col("shard") == F.col("s_shard")) & (F.col("range") == F.col("s_range")))
    placed = placed.withColumn("slot", F.col("slot") + F.col("start")).withColumn("law", F.lit("key"))
    return placed.select(*sealed.back(NEW), *NEW)
