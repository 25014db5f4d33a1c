"""Evaluation: accuracy, recall, log-loss, parity and release gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from . import blocked
from .retrieval import top_k


def ranked(logits: str = "logits"):
    """Classes by (logit descending, index), as an array of indices."""
    keyed = F.transform(logits, lambda x, i: F.struct((-x.cast("double")).alias("k"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def accuracy_report(rows: DataFrame, k: int = 5) -> DataFrame:
    """One row: accuracy, top-k accuracy and mean cross-entropy of rows (label, logits); 0 on no rows."""
    order = rows.select("label", ranked().alias("r"), F.get(vectors.log_softmax(F.col("logits")), F.col("label").cast("int")).alias("logp"))
    share = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    hit, among = F.get("r", F.lit(0)) == F.col("label"), F.array_contains(F.slice("r", 1, k), F.col("label").cast("int"))
    return order.agg(F.count("*").alias("n"), share(hit).alias("accuracy"), share(among).alias("top_k"), F.coalesce(-F.avg("logp"), F.lit(0.0)).alias("loss"))


def per_class_accuracy(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(label, n, accuracy) for every class, 0 for one without rows."""
    order = rows.select("label", (F.get(ranked(), F.lit(0)) == F.col("label")).cast("double").alias("hit"))
    found = order.groupBy("label").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"))
    return classes.join(found, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"))


def recall_at(hits: DataFrame, queries: DataFrame, ks: tuple = (1, 5, 10)) -> DataFrame:
    """One row: the share of queries with a hit of their label in the first k; ``hits`` has qid, rank and label_match."""
    best = hits.where("label_match").groupBy("qid").agg(F.min("rank").alias("best"))
    joined = queries.select("qid").join(best, "qid", "left")
    return joined.agg(*[F.coalesce(F.avg(F.coalesce(F.col("best") <= k, F.lit(False)).cast("double")), F.lit(0.0)).alias(f"recall_{k}") for k in ks])


def per_class_recall(hits: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(label, recall) of the queries of each label."""
    found = hits.where(F.col("label_match") & (F.col("rank") <= k)).select("qid").distinct().withColumn("hit", F.lit(1.0))
    return queries.join(found, "qid", "left").groupBy("label").agg(F.avg(F.coalesce("hit", F.lit(0.0))).alias("recall"))


def parity(actual: DataFrame, expected: DataFrame, key: str, value: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: the largest difference after a join by key, and how many exceed the tolerance or lack a partner."""
    a, b = actual.select(key, F.col(value).alias("a")), expected.select(key, F.col(value).alias("b"))
    gap = F.abs(F.col("a") - F.col("b"))
    return a.join(b, key, "full").agg(F.max(gap).alias("max_difference"), F.coalesce(F.sum((F.coalesce(gap, F.lit(float("inf"))) > tolerance).cast("long")), F.lit(0)).alias("offenders"))


def gate(per_class: DataFrame, floor: float, mean_floor: float) -> DataFrame:
    """One row: the mean, whether all floors hold, and the sorted classes below theirs: one weak class fails a good mean."""
    weak = per_class.where(F.col("accuracy") < floor).agg(F.sort_array(F.collect_list("label")).alias("offenders"))
    mean = per_class.agg(F.avg("accuracy").alias("mean"))
    return mean.join(F.broadcast(weak)).select("mean", ((F.col("mean") >= mean_floor) & (F.size("offenders") == 0)).alias("passed"), "offenders")


def sparse_classes(rows: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """Counts of all classes with 0 for those without rows, and which have fewer than ``least``."""
    counts = rows.groupBy("label").agg(F.count("*").alias("c"))
    return classes.join(counts, "label", "left").select("label", F.coalesce("c", F.lit(0)).alias("n")).withColumn("sparse", F.col("n") < least)


def nearest_first(queries: DataFrame, items: DataFrame, k: int, own: bool = True) -> DataFrame:
    """(qid, item_id, rank, label_match) of a stated set of queries with labels against all labelled items.

    Where the queries are items themselves, ``own`` False leaves each one's own row out of its ranking.
    """
    table = items.select("item_id", F.col("label").alias("item_label"), F.col("v").alias("embedding"))
    near = blocked.top_k(queries.select("qid", F.col("v").alias("embedding")), table, k if own else k + 1, item="item_id")
    near = top_k(near if own else near.where(F.col("qid") != F.col("item_id")), k, item="item_id")
    return near.join(queries.select("qid", "label"), "qid").select("qid", "item_id", (F.col("label") == F.col("item_label")).alias("label_match"), "rank")
