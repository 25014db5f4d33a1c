"""Streams: debounced sessions, the newest version of a result, and the fold of a decision log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import retrieval
from ..operators.curation import fold_decisions


def debounced(events: DataFrame, key: str, ts: str, gap: str, late: str | None = None) -> DataFrame:
    """(key, started, ended, events): runs of events no further apart than the gap; the same for batch and stream.

    A stream needs ``late``, the watermark after which a session is closed.
    """
    rows = events.withWatermark(ts, late) if late else events
    out = rows.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("events"), F.max(ts).alias("ended"))
    return out.select(key, F.col("w.start").alias("started"), "ended", "events")


def newest(results: DataFrame, key: str, version: str) -> DataFrame:
    """The result of the largest version of each key; older ones that arrive late change nothing."""
    others = [c for c in results.columns if c not in (key, version)]
    return results.groupBy(key).agg(F.max(F.struct(version, *others)).alias("m")).select(key, f"m.{version}", *[f"m.{c}" for c in others])


def fold_stream(log: DataFrame, state: str, checkpoint: str):
    """A stream that folds a decision log into a Parquet table, a version per batch, and can be started again.

    Each version is the fold of the one before with the new records, so a repeated batch changes nothing.
    """
    columns = ["class", "candidate_id", "decision", "seq"]

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.select(*columns)
        if number > 0:
            rows = rows.unionByName(spark.read.parquet(f"{state}/version={number - 1}").select(*columns))
        last = rows.groupBy("class", "candidate_id").agg(F.max(F.struct("seq", "decision")).alias("m"))
        last.select("class", "candidate_id", "m.decision", "m.seq").write.mode("overwrite").parquet(f"{state}/version={number}")

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)


def warming_top_k(resident: DataFrame, queries: DataFrame, vectors_by_shard: DataFrame, state: str, checkpoint: str, limit: int = retrieval.LIMIT, lexical_weight: float = retrieval.LEXICAL_WEIGHT):
    """A stream of shards (a column shard) that become resident: each query's best hits over all shards so far.

    A version of the table ``hits`` per batch: the best of the version before and of the batch's shards, which alone are
    read. At every step it is the answer of a batch query over the resident shards; a shard that comes again, and a batch
    that is repeated, change nothing. ``shards`` has the resident ones.
    """
    weight = lexical_weight if "predictions" in queries.columns else 0.0

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("shard").distinct()
        if number > 0:
            seen = spark.read.parquet(f"{state}/shards/version={number - 1}")
            fresh = fresh.join(seen, "shard", "left_anti")
        every = fresh.unionByName(seen) if number > 0 else fresh
        every.write.mode("overwrite").parquet(f"{state}/shards/version={number}")
        items = vectors_by_shard.join(retrieval.bounded(fresh), "shard", "left_semi")
        hits = retrieval.candidates(queries, items, None, weight, limit)
        if number > 0:
            hits = hits.unionByName(spark.read.parquet(f"{state}/hits/version={number - 1}").drop("rank"))
        retrieval.top_k(hits, limit).write.mode("overwrite").parquet(f"{state}/hits/version={number}")

    return resident.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


__all__ = ["debounced", "fold_decisions", "fold_stream", "newest", "warming_top_k"]
