"""Datasets: seeded stratified samples, hold-outs, class maps, split profiles, range partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Drawings of a class in each split.
EXPECTED_SPLITS = {"train": 70_000, "valid": 2_500, "test": 2_500}


def seeded_order(seed: int, *keys: str) -> Column:
    """The digest that orders rows for a draw; the same in every engine with SHA-256."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]), 256)


def stratified_sample(rows: DataFrame, strata: list[str], item: str, n: int, seed: int) -> DataFrame:
    """Exactly ``n`` rows of each stratum (all of a smaller one), without replacement, whatever the partitions."""
    drawn = W.partitionBy(*strata).orderBy(seeded_order(seed, *strata, item), item)
    return rows.withColumn("draw", F.row_number().over(drawn)).where(F.col("draw") <= n)


def holdout(rows: DataFrame, key: str, item: str, k: int, seed: int) -> DataFrame:
    """``rows`` with ``split``: up to ``k`` of each class are held out (1), but two stay for training (0)."""
    order = W.partitionBy(key).orderBy(seeded_order(seed, key, item), item)
    size = F.count("*").over(W.partitionBy(key))
    held = F.row_number().over(order) <= F.least(F.lit(k), size - 2)
    return rows.withColumn("split", held.cast("int"))


def remap_classes(rows: DataFrame, mapping: DataFrame, key: str = "label") -> DataFrame:
    """Rows of the mapped classes with their new index; ``mapping`` has old and new."""
    return rows.join(mapping.select(F.col("old").alias(key), "new"), key).drop(key).withColumnRenamed("new", key)


def split_profile(drawings: DataFrame, splits: DataFrame) -> DataFrame:
    """Count, shortest and longest of each split (0 where it is empty); ``drawings`` has split and length."""
    found = drawings.groupBy("split").agg(F.count("*").alias("n"), F.min("length").alias("lo"), F.max("length").alias("hi"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return splits.join(found, "split", "left").select("split", zero("n").alias("count"), zero("lo").alias("min_length"), zero("hi").alias("max_length"))


def distinct_values(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The sorted distinct values of each key, distinct before they are gathered."""
    return rows.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(value))


def wrong_splits(profile: DataFrame, expected: dict[str, int] = EXPECTED_SPLITS) -> DataFrame:
    """The splits whose counts differ from the expected ones."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    return profile.withColumn("expected", F.try_element_at(want, F.col("split"))).where(~F.col("count").eqNullSafe(F.col("expected")))


def short_strata(rows: DataFrame, strata: list[str], requested: int) -> DataFrame:
    """Strata with fewer rows than requested."""
    return rows.groupBy(*strata).agg(F.count("*").alias("available")).where(F.col("available") < requested)


def contiguous_part(position: Column, total: Column, jobs: int) -> Column:
    """The job whose contiguous slice floor(n*i/jobs) .. floor(n*(i+1)/jobs) holds a position."""
    return F.floor(((position + 1) * jobs - 1) / total).cast("int")


def sample_seed(seed: int, class_index: Column, split: Column) -> Column:
    """The seed of a class's draw in a split: the first eight bytes of a digest, the lowest first, as a decimal."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), class_index.cast("string"), split), 256)
    turned = F.concat(*[F.substring(digest, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(turned, 16, 10).cast("decimal(20,0)")


def same_commit(*sources: DataFrame) -> DataFrame:
    """One row: how many commits the sources name (each has a column commit), and whether they all agree."""
    named = reduce(DataFrame.unionByName, [s.select("commit") for s in sources]).select(F.coalesce("commit", F.lit("")).alias("commit")).distinct()
    return named.agg(F.count("*").alias("commits")).select("commits", (F.col("commits") == 1).alias("agree"))


def planned_icons(classes: DataFrame, candidates: DataFrame, digests: DataFrame) -> DataFrame:
    """(class_index, class_name, icon_id, path, digest): every class with the stored blobs of its candidates.

    ``classes``: class_index, class_name; ``candidates``: class_name, icon_id, path; ``digests``: icon_id, digest. A
    class that the candidates don't know raises; a candidate without a digest is skipped.
    """
    missing = classes.join(candidates, "class_name", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no candidates for class {missing[0]['class_name']}")
    rows = classes.join(candidates, "class_name").join(digests.where(F.col("digest").isNotNull()), "icon_id")
    return rows.select("class_index", "class_name", "icon_id", "path", "digest")


def untrusted(requested: DataFrame, trusted: DataFrame, key: str = "name") -> DataFrame:
    """The requested archives for which there is no trusted digest; a run must not start while there are any."""
    return requested.select(key).distinct().join(trusted.select(key), key, "left_anti")


def class_coverage(classes: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: the classes there are, and those with a candidate."""
    have = candidates.select("class").distinct().withColumn("has", F.lit(1))
    return classes.select("class").distinct().join(have, "class", "left").agg(F.count("*").alias("classes"), F.count("has").alias("covered"))


def stale(requests: DataFrame, cached: DataFrame, key: str = "name") -> DataFrame:
    """Requests whose fingerprint isn't that of the cached artifact: these must be built again."""
    have = cached.select(F.col(key).alias("k"), F.col("fingerprint").alias("f"))
    return requests.join(have, (F.col(key) == F.col("k")) & (F.col("fingerprint") == F.col("f")), "left_anti")
