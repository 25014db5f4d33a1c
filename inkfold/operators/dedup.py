"""Content deduplication by digest, before anything dear is computed, and table fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_digest(rows: DataFrame, digest: str, item: str) -> DataFrame:
    """(digest, representative, duplicates): the smallest id of each digest and how many have it."""
    return rows.groupBy(F.col(digest).alias("digest")).agg(F.min(item).alias("representative"), F.count("*").alias("duplicates"))


def members(rows: DataFrame, digest: str, item: str) -> DataFrame:
    """(item, representative): every id with that of its digest; a group is never gathered into one row."""
    return rows.join(rows.groupBy(digest).agg(F.min(item).alias("representative")), digest).select(item, "representative")


def two_level(rows: DataFrame, first: str, second: str, item: str) -> DataFrame:
    """(digest, representative, duplicates) by the second digest; only one row of each first digest needs it.

    ``second`` is the name of a column that depends on the content of ``first``; rows without it drop out.
    """
    one = rows.groupBy(first).agg(F.min(item).alias("item"), F.min(second).alias("second"), F.count("*").alias("n"))
    return one.where(F.col("second").isNotNull()).groupBy(F.col("second").alias("digest")).agg(F.min("item").alias("representative"), F.sum("n").alias("duplicates"))


def histogram(rows: DataFrame, value: str, dimension: DataFrame) -> DataFrame:
    """Counts of ``value`` with a row for each value of ``dimension``, 0 where it doesn't occur."""
    counts = rows.groupBy(value).agg(F.count("*").alias("n"))
    return dimension.join(counts, value, "left").select(value, F.coalesce("n", F.lit(0)).alias("n"))


def row_fingerprint(*columns: str):
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def table_fingerprint(rows: DataFrame, *columns: str) -> DataFrame:
    """One digest for a table, whatever the order of its rows: sums of the rows' digests by 32-bit pieces."""
    pieces = [F.sum(F.conv(F.substring("h", 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)")).alias(f"p{k}") for k in range(8)]
    summed = rows.select(row_fingerprint(*columns).alias("h")).agg(F.count("*").alias("rows"), *pieces)
    return summed.select("rows", F.sha2(F.concat_ws(":", "rows", *[f"p{k}" for k in range(8)]), 256).alias("fingerprint"))


def available(icons: DataFrame, digests: DataFrame, group: str) -> DataFrame:
    """The icons whose blob is there, with its digest and their place (from 0) in the order of digest and id within ``group``.

    ``digests``: icon_id, digest; a null digest marks an icon that the source doesn't have.
    """
    rows = icons.join(digests.where(F.col("digest").isNotNull()).select("icon_id", "digest"), "icon_id")
    return rows.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy("digest", "icon_id")) - 1)
