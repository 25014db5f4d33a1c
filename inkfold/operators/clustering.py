"""Spherical k-means as DataFrame steps, and the build of an inverted-file index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .numbering import written

CLUSTERS, ITERATIONS, SEED = 256, 25, 20260817
#: Rounds of k-means|| and rows that each draws, in clusters.
ROUNDS, OVERSAMPLING = 5, 2.0


def assign(items: DataFrame, centroids: DataFrame) -> DataFrame:
    """``items`` (id, v) with cluster and similarity: the closest centroid (cluster, c), ties to the smaller cluster.

    Centroids are a bounded table (a few hundred rows), so all of them go to every task as one row, and nothing is
    shuffled.
    """
    table = centroids.agg(F.collect_list(F.struct("cluster", "c")).alias("cs"))
    scores = F.transform("cs", lambda x: F.struct(vectors.dot(F.col("v"), x["c"]).alias("similarity"), (-x["cluster"]).alias("minus")))
    best = items.join(F.broadcast(table), F.lit(True)).withColumn("m", F.array_max(scores))
    return best.select("id", "v", (-F.col("m.minus")).alias("cluster"), F.col("m.similarity").alias("similarity"))


def lloyd_step(assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster, c): sums of the assigned vectors at length 1; an empty cluster, or one whose sum is zero, keeps its centroid."""
    sums = assigned.select("cluster", F.posexplode("v").alias("axis", "x")).groupBy("cluster", "axis").agg(F.sum(F.col("x").cast("double")).alias("x"))
    rows = sums.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("axis", "x"))).alias("s"))
    fresh = rows.select("cluster", F.transform("s", lambda p: p["x"]).alias("sum")).where(vectors.norm(F.col("sum")) > 1e-12).select("cluster", vectors.normalize(F.col("sum")).alias("fresh"))
    return centroids.join(fresh, "cluster", "left").select("cluster", F.coalesce("fresh", F.transform("c", lambda x: x.cast("double"))).alias("c"))


def _closest(matrix: np.ndarray):
    """A pandas UDF that assigns vectors by one matrix product per Arrow batch."""

    @F.pandas_udf("cluster int, similarity double")
    def closest(v: pd.Series) -> pd.DataFrame:
        scores = np.stack(v.to_numpy()).astype(np.float64) @ matrix.T
        best = scores.argmax(axis=1)
        return pd.DataFrame({"cluster": best.astype("int32"), "similarity": scores[np.arange(len(best)), best]})

    return closest


def _partial_sums(matrix: np.ndarray):
    """For mapInArrow: the similarities and vectors of each cluster, summed over a partition by one matrix product per batch."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, likeness = np.zeros(matrix.shape), np.zeros(len(matrix))
        for batch in batches:
            v = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)
            scores = v @ matrix.T
            best = scores.argmax(axis=1)
            likeness += np.bincount(best, scores[np.arange(len(best)), best], len(matrix))
            np.add.at(sums, best, v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix)), pa.int32()), pa.array(likeness), pa.array(list(sums), pa.list_(pa.float64()))], names=["cluster", "s", "x"])

    return summed


def _points(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def _drawn(centers: np.ndarray, most: int, seed: str):
    """For mapInArrow over (id, v): of each batch the ``most`` rows that come first in a race by distance.

    A row's time is exponential with its distance to the closest center as the rate, drawn from a digest of its id; the
    first of all are a sample without replacement, weighted by distance, whatever the partitions.
    """

    def race(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = np.maximum(1 - (_points(batch) @ centers.T).max(axis=1), 0)
            heads = b"".join(hashlib.sha256(f"{seed}:{i}".encode()).digest()[:8] for i in batch.column("id").to_pylist())
            uniform = (np.frombuffer(heads, ">u8") >> np.uint64(11)).astype(np.float64) + 0.5
            with np.errstate(divide="ignore"):
                time = -np.log(uniform / 2**53) / np.where(far > 1e-12, far, 0)
            at = np.sort(np.argsort(time, kind="stable")[:most])
            at = pa.array(at[np.isfinite(time[at])])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("v").take(at), pa.array(time).take(at)], names=["id", "v", "time"])

    return race


def seeds(items: DataFrame, k: int, seed: int = SEED, rounds: int = ROUNDS, oversampling: float = OVERSAMPLING) -> np.ndarray:
    """Starting centers of ``items`` (id, v) by k-means||: each round draws oversampling * k rows by their distance.

    Every round and the weights are one pass over all items; at most 1 + rounds * oversampling * k candidates reach the
    driver, each with the number of items next to it, and are thinned to k there by weighted k-means++.
    """
    each = int(np.ceil(oversampling * k))
    kind = items.schema["id"].dataType.simpleString()
    first = items.orderBy(F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")), 256), "id").limit(1).toPandas()
    if not len(first):
        return np.empty((0, 0))
    found = np.stack(first["v"].to_numpy()).astype(np.float64)
    for n in range(rounds):
        race = items.select("id", "v").mapInArrow(_drawn(found, each, f"{seed}:{n}"), f"id {kind}, v array<float>, time double")
        rows = race.orderBy("time", "id").limit(each).select("id", "v").collect()
        if not rows:
            break
        found = np.concatenate((found, np.array([r["v"] for r in sorted(rows)], np.float64)))
    found = np.unique(found, axis=0)
    weights = np.zeros(len(found))
    for r in items.select("v").mapInArrow(_counts(found), "cluster int, n long").groupBy("cluster").agg(F.sum("n").alias("n")).collect():
        weights[r["cluster"]] = r["n"]
    return _thinned(found, weights, k, np.random.Generator(np.random.PCG64(seed)))


def _counts(matrix: np.ndarray):
    """For mapInArrow: how many vectors of a partition are closest to each center."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(matrix), np.int64)
        for batch in batches:
            n += np.bincount((_points(batch) @ matrix.T).argmax(axis=1), minlength=len(matrix))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(matrix)), pa.int32()), pa.array(n)], names=["cluster", "n"])

    return counted


def _thinned(points: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, trials: int = 8, steps: int = 10) -> np.ndarray:
    """``k`` unit centers of weighted points: the best of some draws by weighted distance, each after a few weighted steps."""
    best, likeness = None, -np.inf
    for _ in range(trials):
        at = [int(rng.choice(len(points), p=weights / weights.sum()))]
        far = np.maximum(1 - points @ points[at[0]], 0)
        while len(at) < min(k, len(points)):
            pull = weights * far
            pull[at] = 0
            rest = np.setdiff1d(np.arange(len(points)), at)
            at.append(int(rng.choice(len(points), p=pull / pull.sum())) if pull.sum() > 1e-12 else int(rest[0]))
            far = np.minimum(far, np.maximum(1 - points @ points[at[-1]], 0))
        centers = points[at].copy()
        for _ in range(steps):
            closest = (points @ centers.T).argmax(axis=1)
            sums = np.zeros_like(centers)
            np.add.at(sums, closest, points * weights[:, None])
            size = np.linalg.norm(sums, axis=1)
            good = size > 1e-12
            centers[good] = sums[good] / size[good, None]
        total = float((weights * (points @ centers.T).max(axis=1)).sum())
        if total > likeness:
            best, likeness = centers, total
    return best


def fit(items: DataFrame, k: int = CLUSTERS, iterations: int = ITERATIONS, seed: int = SEED) -> DataFrame:
    """(cluster, c): unit centroids of ``items`` (id, v).

    Seeds come from k-means||, and every iteration sums over all items. The k centroids, a bounded table, pass through
    the driver.
    """
    spark = items.sparkSession
    centers, before = seeds(items, k, seed), None
    if not len(centers):
        return spark.createDataFrame([], "cluster int, c array<double>")
    k, dim = centers.shape
    for _ in range(iterations):
        # each task sends one row per cluster, the driver gets one for each
        sums = items.select("v").mapInArrow(_partial_sums(centers), "cluster int, s double, x array<double>").select("cluster", "s", F.posexplode("x").alias("axis", "x"))
        rows = sums.groupBy("cluster", "axis").agg(F.sum("x").alias("x"), F.sum("s").alias("s")).collect()
        fresh, total = np.zeros((k, dim)), 0.0
        for r in sorted(rows):
            fresh[r["cluster"], r["axis"]] = r["x"]
            total += r["s"] if r["axis"] == 0 else 0.0
        size = np.linalg.norm(fresh, axis=1)
        good = size > 1e-12
        centers[good] = fresh[good] / size[good, None]
        if before is not None and abs(total - before) <= 1e-9 * max(1.0, abs(before)):
            break
        before = total
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centers)], "cluster int, c array<double>")


def build_index(items: DataFrame, k: int = CLUSTERS, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(vectors, centroids) of an index over ``items`` (icon_id, path, duplicates, aux_class, embedding).

    Vectors carry their shard, codes and scale and are stored by shard, so that a probe reads only its shards; centroids
    carry theirs, the number of vectors (0 for an empty shard), and what bounds them: see with_bounds().
    """
    centers = fit(items.select(F.col("icon_id").alias("id"), F.col("embedding").alias("v")), k, iterations, seed)
    matrix = np.array([r["c"] for r in centers.orderBy("cluster").collect()], dtype=np.float64)
    shard = _closest(matrix)("embedding")["cluster"]
    stored = items.withColumn("shard", shard).withColumn("q", vectors.quantize(F.col("embedding")))
    stored = written(stored.select("shard", "icon_id", "path", "duplicates", "aux_class", "q.codes", "q.scale"), by="shard")
    coded = centers.select(F.col("cluster").alias("shard"), vectors.quantize(F.transform("c", lambda x: x.cast("float"))).alias("q"))
    return stored, with_bounds(stored, coded.select("shard", "q.codes", "q.scale"))


def with_bounds(stored: DataFrame, centroids: DataFrame) -> DataFrame:
    """Centroids (shard, codes, scale) with count, radius (the widest angle between the centroid and a vector of the shard)
    and the lengths of its shortest and longest vector, all of vectors as they are coded."""
    table = centroids.select("shard", F.col("codes").alias("c_codes"), F.col("scale").alias("c_scale"))
    rows = stored.join(F.broadcast(table), "shard")  # a row for each shard
    length = vectors.norm(F.col("codes")) * F.col("scale").cast("double")
    other = vectors.norm(F.col("c_codes")) * F.col("c_scale").cast("double")
    cosine = vectors.scaled_dot(F.col("codes"), F.col("scale"), F.col("c_codes")) * F.col("c_scale").cast("double") / (length * other)
    angle = F.when((length > 0) & (other > 0), F.acos(F.greatest(F.least(cosine, F.lit(1.0)), F.lit(-1.0)))).otherwise(F.lit(float(np.pi)))
    found = rows.select("shard", length.alias("length"), angle.alias("angle")).groupBy("shard").agg(F.count("*").alias("count"), F.max("angle").alias("radius"), F.min("length").alias("shortest"), F.max("length").alias("longest"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    return centroids.join(found, "shard", "left").select("shard", "codes", "scale", F.coalesce("count", F.lit(0)).alias("count"), zero("radius"), zero("shortest"), zero("longest"))


def write_index(stored: DataFrame, centroids: DataFrame, path: str) -> None:
    """One folder per shard, so that a probe reads only its shards."""
    stored.repartition("shard").sortWithinPartitions("shard", "icon_id").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/vectors")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")

