"""Mixing sources to target weights by capped water-filling; DataFrame functions only.

Targets. The budget is shared among the sources by weight; a source stops at ``max_epochs`` times its size and
what it can't take goes to the others by weight, until nobody is above. Sorted by cap over weight, the capped
sources are a prefix, so one window over the small table of sources finds the fixed point without a loop.

Sample. A source whose target is r times its size is taken floor(r) times whole; for the rest of r its documents
stand in the order of a seeded hash and are taken from the front until their words reach the rest (the document
on the edge is in if its middle is). Hash buckets are summed first, four million of them and then parts of a thousand:
whole buckets are decided by those sums, and only the bucket of each source on the edge is ordered row by row (where
the rest ends with a bucket, also those that follow as far as no words lie between), so no task ever sorts a source.

Cases: a null text has size 0; a null source is a source of its own, last in order; documents of size 0 take no
words; a row without doc_id is drawn by its text; repeated rows are interchangeable; an empty table
gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Sealed, small, stored, word_count

WEIGHTS = (5, 2, 1)
#: Buckets of the draw, and parts that hold as many of them each.
BUCKETS, PARTS = 1 << 22, 1 << 12
NEW = ["size", "source_size", "target", "copies", "taken"]


def source_targets(sizes: DataFrame, budget: float, max_epochs: float, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size); the window has a row per source."""
    ranked = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", max_epochs * F.col("source_size"))
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    before, rest = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(W.currentRow, W.unboundedFollowing)
    everyone = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("rank")
    filled = ranked.withColumn("level", (budget * F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    # the level at the first source that stays below its cap
    filled = filled.withColumn("water", F.max(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("level"))).over(everyone))
    target = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.col("weight") * F.col("water")).otherwise(F.col("cap"))
    return filled.select("source", "source_size", target.alias("target"))


def _draw(seed: int, key: Column, text: Column) -> Column:
    """A seeded number below 2^32 for each key, or for each text where there is no key."""
    named = F.coalesce(key.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), named).cast("binary")), 1, 8), 16, 10).cast("long")


def _edges(sums: DataFrame, quotas: DataFrame) -> DataFrame:
    """(e_source, edge, last_edge, before): the buckets of each source in which its quota runs out, and the words before them.

    ``sums``: source, at (the bucket), words, start (the words before all buckets listed); ``quotas``: source, quota.
    """
    in_order = W.partitionBy("source").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    placed = sums.withColumn("before", F.col("start") + F.coalesce(F.sum("words").over(in_order), F.lit(0)))
    placed = placed.join(quotas.select(F.col("source").alias("e_source"), "quota"), F.col("source").eqNullSafe(F.col("e_source")))
    placed = placed.where((F.col("quota") > 0) & (F.col("before") <= F.col("quota")) & (F.col("before") + F.col("words") >= F.col("quota")))
    return placed.groupBy("e_source").agg(F.min("at").alias("edge"), F.max("at").alias("last_edge"), F.min("before").alias("before"))


def mix(docs: DataFrame, budget: float = 1.5, max_epochs: float = 2.0, weights: tuple = WEIGHTS, seed: int = 1) -> DataFrame:
    """``docs`` with size, source_size, target, copies (how often the mix has the document) and taken (its words there)."""
    sealed = Sealed(docs)
    drawn = sealed.df.withColumns({"of": sealed["source"], "id": sealed["doc_id"], "size": word_count(sealed["text"]), "draw": _draw(seed, sealed["doc_id"], sealed["text"])})
    drawn = drawn.withColumn("bucket", F.floor(F.col("draw") / (2**32 // BUCKETS)))
    fine = stored(drawn.groupBy(F.col("of").alias("source"), "bucket").agg(F.sum("size").alias("words")))
    part = F.floor(F.col("bucket") / (BUCKETS // PARTS))
    coarse = stored(fine.groupBy("source", part.alias("at")).agg(F.sum("words").alias("words")).withColumn("start", F.lit(0).cast("long")))
    targets = source_targets(coarse.groupBy("source").agg(F.sum("words").alias("source_size")), budget, max_epochs, weights)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    targets = targets.withColumn("whole", F.floor(ratio)).withColumn("quota", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = stored(targets)
    # first by parts, then by the buckets of the part on the edge
    parts = small(stored(_edges(coarse, targets)))
    inside = fine.join(parts, F.col("source").eqNullSafe(F.col("e_source")) & part.between(F.col("edge"), F.col("last_edge")))
    edges = _edges(inside.select("source", F.col("bucket").alias("at"), "words", F.col("before").alias("start")), targets)
    plan = targets.join(edges, F.col("source").eqNullSafe(F.col("e_source")), "left").drop("e_source")
    # without an edge the quota is nothing or the whole source
    plan = plan.withColumn("edge", F.coalesce("edge", F.when(F.col("quota") > 0, F.lit(BUCKETS)).otherwise(F.lit(-1))))
    plan = stored(plan.withColumn("last_edge", F.coalesce("last_edge", "edge")))
    planned = drawn.join(small(plan), F.col("of").eqNullSafe(F.col("source")))
    on_edge = F.col("bucket").between(F.col("edge"), F.col("last_edge"))
    clear = planned.where(~on_edge).withColumn("copies", F.col("whole") + (F.col("bucket") < F.col("edge")).cast("long"))
    row = W.partitionBy("of").orderBy("draw", "id", "size").rowsBetween(W.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("size").over(row) - F.col("size") / 2
    close = planned.where(on_edge).withColumn("copies", F.col("whole") + (middle <= F.col("quota")).cast("long"))
    out = clear.unionByName(close).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*sealed.back(NEW), *NEW)


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of the mix as often as the mix has it."""
    sealed = Sealed(mixed)
    times = F.sequence(F.lit(1), sealed["copies"].cast("int"))
    return sealed.df.where(sealed["copies"] > 0).withColumn("copy", F.explode(times)).select(*sealed.back())


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, '')))), 1, 8) AS BIGINT) AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CAST(CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size)::DOUBLE FROM s)
        - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, CASE WHEN cap > level * weight
        THEN weight * (SELECT max(level) FROM l WHERE cap > level * weight) ELSE cap END AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2 AS middle
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN middle <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM q
"""
