"""Vector retrieval: exhaustive and inverted-file top-k with a hybrid score and a total order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text, vectors
from . import blocked
from .numbering import written

LIMIT, PROBES, LEXICAL_WEIGHT = 12, 16, 0.25
#: Up to so many rows a side goes to all executors.
MOST_BROADCAST = 20_000


def bounded(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """``df`` marked for broadcast if its count is within the bound, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def paired(items: DataFrame, stated: DataFrame, key: str, most: int = MOST_BROADCAST) -> DataFrame:
    """Every row of ``items`` with every row of a stated, smaller set, which is broadcast in blocks of about ``most`` rows.

    ``items`` is read once for each block and never shuffled.
    """
    blocks = max(1, -(-stated.count() // most))
    block = F.pmod(F.xxhash64(key), F.lit(blocks))
    return reduce(DataFrame.unionByName, [items.join(F.broadcast(stated if blocks == 1 else stated.where(block == i)), F.lit(True)) for i in range(blocks)])


def probe(queries: DataFrame, centroids: DataFrame, probes: int = PROBES) -> DataFrame:
    """(qid, shard, probe_score): the best shards of each query by score, then shard; empty shards use up a probe and go last.

    ``queries`` has qid and embedding, ``centroids`` shard, codes, scale and count: a small fixed table per index.
    """
    best = top_k(blocked.top_k(queries, centroids.select("shard", "codes", "scale", "count"), probes, item="shard"), probes, item="shard")
    return best.where(F.col("count") > 0).select("qid", "shard", F.col("score").alias("probe_score"))


def prior(predictions: Column, aux_class: Column, name_tokens: Column) -> Column:
    """The probability of the icon's class (of several entries the last), or a larger one whose label's tokens are all in the name."""
    by_class = F.aggregate(predictions, F.lit(0.0), lambda p, x: F.when(x["class_index"] == aux_class, x["probability"]).otherwise(p))
    return F.aggregate(predictions, by_class, lambda p, x: F.when((x["probability"] > p) & text.contains_all(name_tokens, text.tokenize(F.coalesce(x["label"], F.lit("")))), x["probability"]).otherwise(p))


def hybrid_score(cosine: Column, prior_value: Column, weight: float) -> Column:
    return (1 - weight) * cosine + weight * prior_value


def top_k(scored: DataFrame, limit: int | None = LIMIT, key: str = "qid", item: str = "icon_id") -> DataFrame:
    """The best rows of each query by (score descending, id), numbered by rank; all rows for no limit."""
    out = scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), item)))
    return out if limit is None else out.where(F.col("rank") <= limit)


def exhaustive(queries: DataFrame, items: DataFrame, limit: int | None = LIMIT) -> DataFrame:
    """(qid, icon_id, score, rank) over all vectors, for a stated set of queries; all of them for no limit."""
    if limit is not None:
        return top_k(blocked.top_k(queries, items.select("icon_id", "embedding"), limit), limit).select("qid", "icon_id", "score", "rank")
    pairs = paired(items.select("icon_id", F.col("embedding").alias("item")), queries.select("qid", "embedding"), "qid")
    return top_k(pairs.select("qid", "icon_id", vectors.dot(F.col("item"), F.col("embedding")).alias("score")), None)


def described(hits: DataFrame, classes: DataFrame, slug: str | None = None, commit: str | None = None) -> DataFrame:
    """Winners with category, pack, name, label, class label, probability, URL; an unconfined path or a missing id raises."""
    parts = text.path_parts(F.col("path"))
    checked = F.when(~text.confined_path(F.col("path")) | F.col("icon_id").isNull(), F.raise_error(F.concat(F.lit("malformed icon: "), F.coalesce("path", F.lit("null"))))).otherwise(F.col("path"))
    aux = classes.select(F.col("idx").alias("aux_class"), F.col("label").alias("aux_label"))
    out = hits.join(bounded(aux), "aux_class", "left").withColumn("path", checked).withColumn("parts", parts)
    url = text.canonical_url(F.lit(slug), F.lit(commit), F.col("path")) if slug and commit else F.lit(None).cast("string")
    keep = [c for c in ("qid", "rank", "icon_id", "score", "cosine", "prior", "duplicates", "probability", "path") if c in out.columns]
    return out.select(*keep, "parts.category", "parts.pack", "parts.name", text.display_label(F.col("parts.name")).alias("label"), F.coalesce("aux_label", F.lit("")).alias("aux_label"), url.alias("url"), F.lit(True).alias("approved"))


def retrieve(queries: DataFrame, vectors_by_shard: DataFrame, centroids: DataFrame | None = None, limit: int | None = LIMIT, probes: int | None = PROBES, lexical_weight: float = LEXICAL_WEIGHT) -> DataFrame:
    """Top-k of each query over its probed shards (over all for ``probes`` None).

    ``queries``: qid, embedding and, for a lexical weight above 0, predictions. ``vectors_by_shard``: shard, icon_id,
    path, duplicates, aux_class, codes, scale. The join on shard prunes partitions of a table that is stored by shard.
    """
    if limit is not None and limit < 1 or probes is not None and probes < 1 or not 0 <= lexical_weight <= 1:
        raise ValueError("limit and probes must be positive, the weight between 0 and 1")
    weight = lexical_weight if "predictions" in queries.columns else 0.0
    chosen = None if probes is None or centroids is None else probe(queries, centroids, probes).select("qid", "shard")
    if limit is None:
        return _full_ranking(queries, vectors_by_shard, chosen, weight)
    return top_k(candidates(queries, vectors_by_shard, chosen, weight, limit), limit)


def candidates(queries: DataFrame, vectors_by_shard: DataFrame, chosen: DataFrame | None, weight: float, limit: int) -> DataFrame:
    """Each task's best of every query, over the chosen (qid, shard) or over all shards; only chosen shards are read."""
    items = vectors_by_shard if chosen is None else vectors_by_shard.join(bounded(chosen.select("shard").distinct()), "shard", "left_semi")
    if weight > 0:
        items = items.withColumn("name_tokens", text.tokenize(text.path_parts(F.col("path"))["name"]))
    return blocked.top_k(queries, items, limit, weight, chosen=chosen).drop("name_tokens")


def _full_ranking(queries: DataFrame, vectors_by_shard: DataFrame, chosen: DataFrame | None, weight: float) -> DataFrame:
    """Every pair of a query and a vector of its shards, ranked: as many rows as there are pairs."""
    if chosen is None:
        pairs = paired(vectors_by_shard, queries, "qid")
    else:
        pairs = vectors_by_shard.join(bounded(chosen.join(queries, "qid")), "shard")
    pairs = pairs.withColumn("cosine", vectors.scaled_dot(F.col("codes"), F.col("scale"), F.col("embedding")))
    if weight > 0:
        lexical = prior(F.col("predictions"), F.col("aux_class"), text.tokenize(text.path_parts(F.col("path"))["name"]))
        own = F.aggregate("predictions", F.lit(0.0), lambda p, x: F.when(x["class_index"] == F.col("aux_class"), x["probability"]).otherwise(p))
        pairs = pairs.withColumn("prior", F.coalesce(lexical, F.lit(0.0))).withColumn("probability", F.coalesce(own, F.lit(0.0)))
    else:
        pairs = pairs.withColumn("prior", F.lit(0.0)).withColumn("probability", F.lit(0.0))
    pairs = pairs.withColumn("score", hybrid_score(F.col("cosine"), F.col("prior"), weight))
    return top_k(pairs.drop("codes", "scale", "embedding", "predictions"), None)


def _reachable(centroids: DataFrame, weight: float):
    """For mapInArrow over (qid, embedding, highest, cutoff): (qid, shard) of the shards that may hold a better vector.

    No vector of a shard is closer to the query, by angle, than the centroid's angle less the shard's radius.
    """
    rows = [r for r in centroids.orderBy("shard").collect() if r["count"] > 0]  # the index's small fixed table
    shards = np.array([r["shard"] for r in rows], np.int32)
    directions = np.array([[c * r["scale"] for c in r["codes"]] for r in rows], np.float64)
    lengths = np.linalg.norm(directions, axis=1) if rows else np.empty(0)
    radius, shortest, longest = (np.array([r[c] for r in rows], np.float64) for c in ("radius", "shortest", "longest"))

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not rows:
                continue
            q = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            norm = np.linalg.norm(q, axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                angle = np.arccos(np.clip(np.nan_to_num(q @ directions.T / (norm[:, None] * lengths), nan=1.0), -1, 1))
            cosine = np.cos(np.maximum(angle - radius - 1e-7, 0))
            bound = norm[:, None] * np.where(cosine >= 0, longest, shortest) * cosine
            highest, cutoff = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("highest", "cutoff"))
            at, shard = np.nonzero((1 - weight) * bound + weight * highest[:, None] + 1e-6 * (1 + norm[:, None]) >= cutoff[:, None])
            yield pa.RecordBatch.from_arrays([batch.column("qid").take(pa.array(at)), pa.array(shards[shard])], names=["qid", "shard"])

    return reach


def retrieve_exact(queries: DataFrame, vectors_by_shard: DataFrame, centroids: DataFrame, limit: int = LIMIT, probes: int = 1, lexical_weight: float = LEXICAL_WEIGHT) -> tuple[DataFrame, DataFrame]:
    """The top-k that all shards together have, from the shards that can hold it; and (qid, shard), those that were read.

    The first ``probes`` shards of a query give a score that its answer must reach; of the others only those are read whose
    bound (see clustering.with_bounds) reaches it. The answer is exact for every query, however little that prunes.
    """
    if limit < 1 or probes < 1 or not 0 <= lexical_weight <= 1:
        raise ValueError("limit and probes must be positive, the weight between 0 and 1")
    weight = lexical_weight if "predictions" in queries.columns else 0.0
    near = written(probe(queries, centroids, probes).select("qid", "shard"))
    first = written(top_k(candidates(queries, vectors_by_shard, near, weight, limit), limit).drop("rank"))
    cutoff = first.groupBy("qid").agg(F.when(F.count("*") == limit, F.min("score")).alias("cutoff"))
    highest = F.coalesce(F.array_max(F.transform("predictions", lambda x: x["probability"])), F.lit(0.0)) if weight > 0 else F.lit(0.0)
    asked = queries.where(F.col("embedding").isNotNull()).join(cutoff, "qid", "left").select("qid", "embedding", F.greatest(highest, F.lit(0.0)).alias("highest"), F.coalesce("cutoff", F.lit(float("-inf"))).alias("cutoff"))
    kinds = f"qid {queries.schema['qid'].dataType.simpleString()}, shard int"
    more = written(asked.mapInArrow(_reachable(centroids, weight), kinds).join(near, ["qid", "shard"], "left_anti"))
    second = candidates(queries, vectors_by_shard, more, weight, limit)
    return top_k(first.unionByName(second.select(*first.columns)), limit), near.unionByName(more)


def scan_set(probed: DataFrame, resident: DataFrame) -> DataFrame:
    """(qid, shard) to scan: the probed shards of each query, and all resident ones, which cost nothing to score."""
    everywhere = paired(probed.select("qid").distinct(), resident.select("shard").distinct(), "shard")
    return probed.select("qid", "shard").unionByName(everywhere.select("qid", "shard")).distinct()


def payload_totals(shards: DataFrame, probes: int = PROBES) -> DataFrame:
    """One row: the bytes of all shards (shard, bytes, meta_bytes), and of the largest ``probes``, the worst a query can ask for."""
    sized = shards.select("shard", (F.col("bytes") + F.col("meta_bytes")).alias("payload"))
    worst = sized.orderBy(F.desc("payload"), "shard").limit(probes).agg(F.coalesce(F.sum("payload"), F.lit(0)).alias("worst_probe"))
    return sized.agg(F.count("*").alias("shards"), F.coalesce(F.sum("payload"), F.lit(0)).alias("payload")).join(F.broadcast(worst))  # one row


def coverage(shards: DataFrame, resident: DataFrame) -> DataFrame:
    """One row: shards and vectors there are, and of those that are resident."""
    joined = shards.join(resident.select("shard", F.lit(1).alias("here")).distinct(), "shard", "left")
    here = F.col("here").isNotNull()
    return joined.agg(
        F.count("*").alias("shards"), F.coalesce(F.sum(here.cast("long")), F.lit(0)).alias("resident_shards"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("vectors"), F.coalesce(F.sum(F.when(here, F.col("count")).otherwise(0)), F.lit(0)).alias("resident_vectors"),
    )


def validate_index(index: DataFrame, dim: int, classes: int) -> DataFrame:
    """(problem, rows): vectors that break the index contract; empty for a sound index."""
    problem = (
        F.when(F.col("icon_id").isNull(), F.lit("missing id"))
        .when(F.size("codes") != dim, F.lit("dimension"))
        .when((F.col("scale") <= 0) | F.isnan("scale"), F.lit("scale"))
        .when((F.col("aux_class") < 0) | (F.col("aux_class") >= classes), F.lit("class"))
        .when(~text.confined_path(F.col("path")), F.lit("path"))
    )
    return index.select(problem.alias("problem")).where(F.col("problem").isNotNull()).groupBy("problem").agg(F.count("*").alias("rows"))
