"""Every query of the engine by name, over the driver's tables, with its SQL where SQL can say the same.

The tables stand in for the engine's own: parts for icons (brand = category, type = pack), embeddings with their
labels for vectors with their classes, events for strokes and logs, labels for decisions, pages for addresses.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import raster, strokes, text, vectors
from ..operators import clustering, curation, dataset, dedup, encoder, lexical, metrics, numbering, retrieval
from ..sources import files
from ..streaming import folds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COMMIT = "0123456789abcdef0123456789abcdef01234567"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _icons(spark: SparkSession, sf: str) -> DataFrame:
    part = _read(spark, sf, "part")
    name = F.concat_ws("-", F.col("p_partkey").cast("string"), F.replace("p_name", F.lit(" "), F.lit("-")))
    return part.select(F.col("p_partkey").alias("icon_id"), F.col("p_brand").alias("category"), F.col("p_type").alias("pack"), F.col("p_name").alias("filename"), F.concat(text.join_path(F.col("p_brand"), F.col("p_type"), name), F.lit(".svg")).alias("path"), text.tokenize(F.col("p_name")).alias("tokens"))


_ICONS = """icons AS (SELECT p_partkey AS icon_id, p_brand AS category, p_type AS pack, p_name AS filename,
  p_brand || '/' || p_type || '/' || p_partkey || '-' || replace(p_name, ' ', '-') || '.svg' AS path,
  list_filter(regexp_split_to_array(lower(p_name), '[^a-z]+'), lambda t: t <> '') AS tokens FROM part)"""
_DOT = "list_dot_product(%s::DOUBLE[], %s::DOUBLE[])"


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("icon_id"), "embedding", "label")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """The stated query set: every vector whose id is divisible by 50."""
    return _read(spark, sf, "embeddings").where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), "embedding", "label")


# --- vectors and retrieval


@query(f"""SELECT qid, icon_id, round(score, 6) AS score, rank FROM (
  SELECT q.vec_id AS qid, v.vec_id AS icon_id, {_DOT % ('v.embedding', 'q.embedding')} AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT % ('v.embedding', 'q.embedding')} DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) WHERE rank <= 12""")
def vector_topk_exhaustive(spark, sf):
    out = retrieval.exhaustive(_queries(spark, sf), _vectors(spark, sf))
    return out.select("qid", "icon_id", F.round("score", 6).alias("score"), "rank")


#: Of the ten shards of _index, so many hold nine of ten true neighbours: the labels hardly tell the vectors apart.
_PROBES = 9


def _index(spark, sf) -> tuple[DataFrame, DataFrame]:
    """An index by label: the shard's centroid is the mean direction of its vectors, the icon's path that of the part with its number."""
    icons = _icons(spark, sf).select("icon_id", "path")
    rows = _vectors(spark, sf).join(icons, "icon_id", "left").select(F.col("label").alias("shard"), "icon_id", F.coalesce("path", F.lit("Other/none/0-none.svg")).alias("path"), F.lit(1).alias("duplicates"), F.col("label").alias("aux_class"), vectors.quantize(F.col("embedding")).alias("q"), "embedding")
    firsts = rows.groupBy("shard").agg(F.min_by("embedding", "icon_id").alias("c"), F.count("*").alias("count"))
    means = clustering.lloyd_step(rows.select(F.col("shard").alias("cluster"), F.col("embedding").alias("v")), firsts.select(F.col("shard").alias("cluster"), "c"))
    coded = means.select(F.col("cluster").alias("shard"), vectors.quantize(F.transform("c", lambda x: x.cast("float"))).alias("q"))
    centers = coded.join(firsts.select("shard", "count"), "shard")
    return rows.select("shard", "icon_id", "path", "duplicates", "aux_class", "q.codes", "q.scale"), centers.select("shard", "q.codes", "q.scale", "count")


_CODES = "list_transform({0}, lambda x: greatest(least(round_even((x::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE, 0), 127), -127)::TINYINT) AS codes"
_SCALE = "(list_max(list_transform({0}, lambda x: abs(x)))::DOUBLE / 127.0::DOUBLE)::FLOAT AS scale"
_Q = f"""qz AS (SELECT vec_id, label, embedding, {_SCALE.format('embedding')} FROM embeddings),
  coded AS (SELECT vec_id, label, embedding, scale, {_CODES.format('embedding')} FROM qz),
  axes AS (SELECT label, axis, sum(x) AS x FROM (SELECT label, unnest(range(64)) AS axis, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL),
  lens AS (SELECT label, sqrt(sum(x * x)) AS n FROM axes GROUP BY label),
  means AS (SELECT label, list((x / n)::FLOAT ORDER BY axis) AS e FROM axes JOIN lens USING (label) GROUP BY label),
  centers AS (SELECT label AS shard, {_CODES.format('e')}, scale, (SELECT count(*) FROM embeddings v WHERE v.label = m.label) AS count FROM (SELECT label, e, {_SCALE.format('e')} FROM means) m),
  probes AS (SELECT * FROM (SELECT q.vec_id AS qid, q.embedding, c.shard, list_dot_product(c.codes::DOUBLE[], q.embedding::DOUBLE[]) * c.scale::DOUBLE AS probe_score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(c.codes::DOUBLE[], q.embedding::DOUBLE[]) * c.scale::DOUBLE DESC, c.shard) AS rn
    FROM embeddings q, centers c WHERE q.vec_id % 50 = 0) WHERE rn <= {_PROBES})"""


@query(f"WITH {_Q} SELECT qid, shard, round(probe_score, 6) AS probe_score FROM probes")
def ivf_probe(spark, sf):
    out = retrieval.probe(_queries(spark, sf), _index(spark, sf)[1], _PROBES)
    return out.select("qid", "shard", F.round("probe_score", 6).alias("probe_score"))


@query(f"""WITH {_Q} SELECT qid, icon_id, round(score, 6) AS score, rank FROM (
  SELECT p.qid, v.vec_id AS icon_id, list_dot_product(v.codes::DOUBLE[], p.embedding::DOUBLE[]) * v.scale::DOUBLE AS score,
    row_number() OVER (PARTITION BY p.qid ORDER BY list_dot_product(v.codes::DOUBLE[], p.embedding::DOUBLE[]) * v.scale::DOUBLE DESC, v.vec_id) AS rank
  FROM probes p JOIN coded v ON v.label = p.shard) WHERE rank <= 12""")
def ivf_retrieve(spark, sf):
    stored, centers = _index(spark, sf)
    out = retrieval.retrieve(_queries(spark, sf).select("qid", "embedding"), stored, centers, probes=_PROBES, lexical_weight=0.0)
    return out.select("qid", "icon_id", F.round("score", 6).alias("score"), "rank")


def _stored_index(items: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The index that build_index makes, with its small table of centroids stored as well."""
    icons = items.select("icon_id", F.lit("a/b.svg").alias("path"), F.lit(1).alias("duplicates"), F.lit(0).alias("aux_class"), "embedding")
    stored, centers = clustering.build_index(icons, k=k, iterations=10)
    return stored, numbering.written(centers)


def _letters(spark, sf) -> DataFrame:
    """A vector for each document: how often it has each letter, at length 1; documents without letters have none."""
    count = lambda low, c: (F.length(low) - F.length(F.replace(low, F.lit(c), F.lit("")))).cast("double")
    counts = vectors.once(F.lower(F.coalesce("text", F.lit(""))), lambda low: F.array(*[count(low, c) for c in _ALPHABET]))
    rows = _read(spark, sf, "documents").select(F.col("doc_id").alias("icon_id"), counts.alias("n")).where(vectors.norm(F.col("n")) > 0)
    # every pass of the fit reads it
    return numbering.written(rows.select("icon_id", F.transform(vectors.normalize(F.col("n")), lambda x: x.cast("float")).alias("embedding")))


_ALPHABET = "abcdefghijklmnopqrstuvwxyz"
_LETTERS = f"""counted AS (SELECT doc_id AS vec_id, [{', '.join(f"(length(low) - length(replace(low, '{c}', '')))::DOUBLE" for c in _ALPHABET)}] AS n FROM (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents)),
  embedded AS (SELECT vec_id, list_transform(n, lambda x: (x / sqrt(list_dot_product(n, n)))::FLOAT) AS embedding FROM counted WHERE list_dot_product(n, n) > 0)"""
_EXACT = f"""qz AS (SELECT vec_id, embedding, {_SCALE.format('embedding')} FROM embedded), coded AS (SELECT vec_id, embedding, scale, {_CODES.format('embedding')} FROM qz)
  SELECT qid, icon_id, round(score, 6) AS score, rank FROM (SELECT q.vec_id AS qid, v.vec_id AS icon_id, list_dot_product(v.codes::DOUBLE[], q.embedding::DOUBLE[]) * v.scale::DOUBLE AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.codes::DOUBLE[], q.embedding::DOUBLE[]) * v.scale::DOUBLE DESC, v.vec_id) AS rank FROM embedded q, coded v WHERE q.vec_id % 50 = 0) WHERE rank <= 12"""


def _stated(items: DataFrame) -> DataFrame:
    return items.where(F.col("icon_id") % 50 == 0).select(F.col("icon_id").alias("qid"), "embedding")


@query(f"WITH embedded AS (SELECT vec_id, embedding FROM embeddings), {_EXACT}")
def index_exact_embeddings(spark, sf):
    """The exact answer through the built index: these vectors are spread evenly, so hardly any shard is left out."""
    items = _vectors(spark, sf)
    hits, _ = retrieval.retrieve_exact(_stated(items), *_stored_index(items, 16), probes=4)
    return hits.select("qid", "icon_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_LETTERS}, {_EXACT}")
def index_exact_letters(spark, sf):
    items = _letters(spark, sf)
    hits, _ = retrieval.retrieve_exact(_stated(items), *_stored_index(items, 48), probes=4)
    return hits.select("qid", "icon_id", F.round("score", 6).alias("score"), "rank")


@query()
def index_probed_letters(spark, sf):
    """The approximate answer from a quarter of the shards."""
    items = _letters(spark, sf)
    hits = retrieval.retrieve(_stated(items), *_stored_index(items, 48), probes=12, lexical_weight=0.0)
    return hits.select("qid", "icon_id", F.round("score", 6).alias("score"), "rank")


@query()
def index_shards_read(spark, sf):
    """How many of the shards each query had to read for its exact answer."""
    items = _letters(spark, sf)
    stored, centers = _stored_index(items, 48)
    _, read = retrieval.retrieve_exact(_stated(items), stored, centers, probes=4)
    return read.groupBy("qid").agg(F.count("*").alias("read")).join(F.broadcast(centers.where("count > 0").agg(F.count("*").alias("shards"))))  # one row


def _predicted(spark, sf) -> DataFrame:
    """Queries with two predictions: their own label, and one whose label is a word of part names."""
    own = F.struct(F.col("label").alias("class_index"), F.lit("none").alias("label"), F.lit(0.6).alias("probability"))
    other = F.struct((F.col("label") + 100).alias("class_index"), F.lit("red ring").alias("label"), F.lit(0.9).alias("probability"))
    return _queries(spark, sf).select("qid", "embedding", F.array(own, other).alias("predictions"))


@query(f"""WITH {_Q}, {_ICONS}, scored AS (
  SELECT q.vec_id AS qid, v.vec_id AS icon_id, list_dot_product(v.codes::DOUBLE[], q.embedding::DOUBLE[]) * v.scale::DOUBLE AS cosine,
    CASE WHEN list_contains(i.tokens, 'red') AND list_contains(i.tokens, 'ring') THEN 0.9::DOUBLE WHEN v.label = q.label OR (i.icon_id IS NULL) THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS prior
  FROM embeddings q CROSS JOIN coded v LEFT JOIN icons i ON i.icon_id = v.vec_id WHERE q.vec_id % 50 = 0)
  SELECT qid, icon_id, round(cosine, 6) AS cosine, prior, round(0.75::DOUBLE * cosine + 0.25::DOUBLE * prior, 6) AS score, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY 0.75::DOUBLE * cosine + 0.25::DOUBLE * prior DESC, icon_id) AS rank FROM scored) WHERE rank <= 12""")
def vector_topk_hybrid(spark, sf):
    out = retrieval.retrieve(_predicted(spark, sf), _index(spark, sf)[0], probes=None)
    return out.select("qid", "icon_id", F.round("cosine", 6).alias("cosine"), "prior", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {_Q}, used AS (SELECT DISTINCT shard FROM probes WHERE rn = 1)
  SELECT count(*) AS shards, count(u.shard) AS resident_shards, sum(c.count)::BIGINT AS vectors, coalesce(sum(CASE WHEN u.shard IS NOT NULL THEN c.count END), 0)::BIGINT AS resident_vectors
  FROM centers c LEFT JOIN used u USING (shard)""")
def ivf_coverage(spark, sf):
    centers = _index(spark, sf)[1]
    return retrieval.coverage(centers, retrieval.probe(_queries(spark, sf), centers, 1))


@query(f"""WITH {_Q} SELECT qid, shard FROM probes WHERE rn <= 3 UNION SELECT q.vec_id, c.shard FROM embeddings q, centers c WHERE q.vec_id % 50 = 0 AND c.shard % 4 = 0""")
def scan_set(spark, sf):
    centers = _index(spark, sf)[1]
    return retrieval.scan_set(retrieval.probe(_queries(spark, sf), centers, 3), centers.where("shard % 4 = 0"))


@query("""WITH s AS (SELECT doc_id % 40 AS shard, sum(strlen(text) + 7)::BIGINT AS payload FROM documents GROUP BY 1)
  SELECT count(*) AS shards, sum(payload)::BIGINT AS payload, (SELECT sum(payload)::BIGINT FROM (SELECT payload FROM s ORDER BY payload DESC, shard LIMIT 16)) AS worst_probe FROM s""")
def payload_totals(spark, sf):
    sizes = _read(spark, sf, "documents").groupBy((F.col("doc_id") % 40).alias("shard"))
    return retrieval.payload_totals(sizes.agg(F.sum(F.octet_length("text")).alias("bytes"), (7 * F.count("*")).alias("meta_bytes")))


@query("""SELECT problem, count(*) AS rows FROM (SELECT CASE WHEN vec_id % 11 = 1 THEN 'missing id' WHEN vec_id % 11 = 2 THEN 'dimension' WHEN vec_id % 11 = 3 THEN 'scale' WHEN vec_id % 11 = 4 OR label = 9 THEN 'class' WHEN vec_id % 11 = 5 THEN 'path' END AS problem FROM embeddings)
  WHERE problem IS NOT NULL GROUP BY problem""")
def index_problems(spark, sf):
    """The index with one kind of damage in each of five residues, and one class too few."""
    k = F.col("icon_id") % 11
    broken = _index(spark, sf)[0].withColumns({
        "codes": F.when(k == 2, F.slice("codes", 1, 63)).otherwise(F.col("codes")), "scale": F.when(k == 3, F.lit(0.0).cast("float")).otherwise(F.col("scale")),
        "aux_class": F.when(k == 4, F.lit(-1)).otherwise(F.col("aux_class")), "path": F.when(k == 5, F.lit("../x.svg")).otherwise(F.col("path")), "icon_id": F.when(k != 1, F.col("icon_id")),
    })
    return retrieval.validate_index(broken, 64, 9)


@query(f"""WITH {_Q}, {_ICONS} SELECT icon_id, category, pack, name, label, aux_label, url FROM (
  SELECT i.icon_id, i.category, i.pack, i.icon_id || '-' || replace(i.filename, ' ', '-') AS name, replace(i.filename, '-', ' ') AS label, 'class ' || v.label AS aux_label,
    'https://cdn.jsdelivr.net/gh/owner/icons@{COMMIT}/' || replace(i.path, '#', '%23') AS url,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(v.codes::DOUBLE[], q.embedding::DOUBLE[]) * v.scale::DOUBLE DESC, v.vec_id) AS rank, q.vec_id AS qid
  FROM embeddings q, coded v JOIN icons i ON i.icon_id = v.vec_id WHERE q.vec_id % 50 = 0) WHERE rank <= 12""")
def retrieval_described(spark, sf):
    stored = _index(spark, sf)[0].join(_icons(spark, sf).select("icon_id"), "icon_id", "left_semi")
    hits = retrieval.retrieve(_queries(spark, sf).select("qid", "embedding"), stored, probes=None)
    classes = _vectors(spark, sf).select(F.col("label").alias("idx")).distinct().withColumn("label", F.concat(F.lit("class "), F.col("idx")))
    return retrieval.described(hits, classes, "owner/icons", COMMIT).select("icon_id", "category", "pack", "name", "label", "aux_label", "url")


@query("""WITH q AS (SELECT vec_id, embedding, (list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127.0::DOUBLE)::FLOAT AS scale FROM embeddings)
  SELECT vec_id, scale, list_aggregate(c, 'sum')::BIGINT AS code_sum, list_max(c)::INTEGER AS code_max, array_to_string(c, ',') AS codes FROM (
    SELECT vec_id, scale, list_transform(embedding, lambda x: greatest(least(round_even((x::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE, 0), 127), -127)::INTEGER) AS c FROM q)""")
def quantize_int8(spark, sf):
    q = _vectors(spark, sf).select(F.col("icon_id").alias("vec_id"), vectors.quantize(F.col("embedding")).alias("q")).select("vec_id", "q.codes", "q.scale")
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return q.select("vec_id", "scale", total.alias("code_sum"), F.array_max("codes").cast("int").alias("code_max"), F.array_join(F.transform("codes", lambda x: x.cast("string")), ",").alias("codes"))


@query(f"WITH {_Q} SELECT vec_id, round(list_dot_product(codes::DOUBLE[], embedding::DOUBLE[]) * scale::DOUBLE, 6) AS self_score FROM coded")
def dequantized_dot(spark, sf):
    q = _vectors(spark, sf).withColumn("q", vectors.quantize(F.col("embedding")))
    return q.select(F.col("icon_id").alias("vec_id"), F.round(vectors.scaled_dot(F.col("q.codes"), F.col("q.scale"), F.col("embedding")), 6).alias("self_score"))


@query("""SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm,
  abs(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) <= 0.001 AS unit FROM embeddings""")
def l2_norm_check(spark, sf):
    return _vectors(spark, sf).select(F.col("icon_id").alias("vec_id"), F.round(vectors.norm(F.col("embedding")), 6).alias("norm"), vectors.is_unit(F.col("embedding")).alias("unit"))


@query("""SELECT vec_id, i AS axis, round(x / n, 6) AS x FROM (
  SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n, unnest(range(64))::INTEGER AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)""")
def l2_normalize(spark, sf):
    return _vectors(spark, sf).select(F.col("icon_id").alias("vec_id"), F.posexplode(vectors.normalize(F.col("embedding"))).alias("axis", "x")).withColumn("x", F.round("x", 6))


def _seeds(spark, sf, k: int = 8) -> DataFrame:
    """The first vectors as centroids: a stated set."""
    return _vectors(spark, sf).where(F.col("icon_id") < k).select(F.col("icon_id").cast("int").alias("cluster"), F.col("embedding").alias("c"))


_ASSIGN = f"""assigned AS (SELECT id, v, cluster, similarity FROM (SELECT e.vec_id AS id, e.embedding AS v, s.vec_id::INTEGER AS cluster, {_DOT % ('e.embedding', 's.embedding')} AS similarity,
  row_number() OVER (PARTITION BY e.vec_id ORDER BY {_DOT % ('e.embedding', 's.embedding')} DESC, s.vec_id) AS rn FROM embeddings e, embeddings s WHERE s.vec_id < 8) WHERE rn = 1)"""


@query(f"WITH {_ASSIGN} SELECT id, cluster, round(similarity, 6) AS similarity FROM assigned")
def kmeans_assign(spark, sf):
    items = _vectors(spark, sf).select(F.col("icon_id").alias("id"), F.col("embedding").alias("v"))
    return clustering.assign(items, _seeds(spark, sf)).select("id", "cluster", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_ASSIGN}, sums AS (SELECT cluster, axis, sum(x) AS x FROM (SELECT cluster, unnest(range(64))::INTEGER AS axis, unnest(v)::DOUBLE AS x FROM assigned) GROUP BY ALL),
  norms AS (SELECT cluster, sqrt(sum(x * x)) AS n FROM sums GROUP BY cluster)
  SELECT cluster, axis, round(x / n, 6) AS x FROM sums JOIN norms USING (cluster)""")
def kmeans_lloyd_step(spark, sf):
    items = _vectors(spark, sf).select(F.col("icon_id").alias("id"), F.col("embedding").alias("v"))
    seeds = _seeds(spark, sf)
    out = clustering.lloyd_step(clustering.assign(items, seeds), seeds)
    return out.select("cluster", F.posexplode("c").alias("axis", "x")).withColumn("x", F.round("x", 6))


@query()
def index_build(spark, sf):
    items = _vectors(spark, sf).select("icon_id", F.lit("a/b.svg").alias("path"), F.lit(1).alias("duplicates"), F.col("label").alias("aux_class"), "embedding")
    stored, centers = clustering.build_index(items, k=16)
    return centers.select("shard", "count", F.size("codes").alias("dim"))


def _logits(spark, sf) -> DataFrame:
    """Rows of ten logits: the products with the first vector of each label."""
    firsts = _vectors(spark, sf).groupBy("label").agg(F.min_by("embedding", "icon_id").alias("e"))
    table = firsts.agg(F.array_sort(F.collect_list(F.struct("label", "e"))).alias("cs"))
    rows = _vectors(spark, sf).join(F.broadcast(table), F.lit(True))  # one row of ten vectors
    return rows.select(F.col("icon_id").alias("id"), "label", F.transform("cs", lambda c: 8 * vectors.dot(F.col("embedding"), c["e"])).alias("logits"))


_LOGITS = f"""firsts AS (SELECT label, arg_min(embedding, vec_id) AS e FROM embeddings GROUP BY label),
  l AS (SELECT v.vec_id AS id, v.label, f.label AS class_index, 8 * {_DOT % ('v.embedding', 'f.e')} AS logit FROM embeddings v, firsts f),
  r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY logit DESC, class_index) AS rank, exp(logit - max(logit) OVER (PARTITION BY id)) AS power FROM l),
  p AS (SELECT *, power / sum(power) OVER (PARTITION BY id) AS probability FROM r)"""


@query(f"WITH {_LOGITS} SELECT id, rank, class_index, round(probability, 6) AS probability FROM p WHERE rank <= 5")
def softmax_topk(spark, sf):
    rows = _logits(spark, sf).select("id", F.posexplode(vectors.top_predictions(F.col("logits"))).alias("pos", "p"))
    return rows.select("id", (F.col("pos") + 1).alias("rank"), "p.class_index", F.round("p.probability", 6).alias("probability"))


# --- evaluation


@query(f"WITH {_LOGITS}, s AS (SELECT id, max((rank = 1 AND class_index = label)::INT) AS hit, max((rank <= 5 AND class_index = label)::INT) AS top, max(CASE WHEN class_index = label THEN ln(probability) END) AS logp FROM p GROUP BY id) SELECT count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(top), 6) AS top_k, round(-avg(logp), 6) AS loss FROM s")
def accuracy_report(spark, sf):
    out = metrics.accuracy_report(_logits(spark, sf))
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "top_k", "loss")])


def _all_labels(spark) -> DataFrame:
    return spark.range(12).select(F.col("id").cast("int").alias("label"))


@query(f"WITH {_LOGITS}, s AS (SELECT label, count(*) AS n, avg((class_index = label)::INT) AS accuracy FROM p WHERE rank = 1 GROUP BY label) SELECT d.label::INTEGER AS label, coalesce(n, 0) AS n, round(coalesce(accuracy, 0.0), 6) AS accuracy FROM range(12) d(label) LEFT JOIN s USING (label)")
def per_class_accuracy(spark, sf):
    return metrics.per_class_accuracy(_logits(spark, sf), _all_labels(spark)).withColumn("accuracy", F.round("accuracy", 6))


@query(f"WITH {_LOGITS}, s AS (SELECT label, avg((class_index = label)::INT) AS accuracy FROM p WHERE rank = 1 GROUP BY label) SELECT round(avg(accuracy), 6) AS mean, (avg(accuracy) >= 0.5 AND count_if(accuracy < 0.9) = 0) AS passed, array_to_string(list_sort(list(label) FILTER (accuracy < 0.9)), ',') AS offenders FROM s")
def gate_offenders(spark, sf):
    rows = _logits(spark, sf)
    out = metrics.gate(metrics.per_class_accuracy(rows, rows.select("label").distinct()), 0.9, 0.5)
    return out.select(F.round("mean", 6).alias("mean"), "passed", F.array_join(F.transform("offenders", lambda x: x.cast("string")), ",").alias("offenders"))


_NEAR = f"""near AS (SELECT q.vec_id AS qid, q.label, (q.label = v.label) AS label_match,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DOT % ('q.embedding', 'v.embedding')} DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)"""


def _near(spark, sf):
    queries = _queries(spark, sf).withColumnRenamed("embedding", "v")
    items = _vectors(spark, sf).select(F.col("icon_id").alias("item_id"), "label", F.col("embedding").alias("v"))
    return metrics.nearest_first(queries, items, 10, own=False), queries


@query(f"WITH {_NEAR}, b AS (SELECT qid, min(CASE WHEN label_match THEN rank END) AS best FROM near GROUP BY qid) SELECT round(avg((coalesce(best, 99999999) <= 1)::INT), 6) AS recall_1, round(avg((coalesce(best, 99999999) <= 5)::INT), 6) AS recall_5, round(avg((coalesce(best, 99999999) <= 10)::INT), 6) AS recall_10 FROM b")
def recall_at_k(spark, sf):
    hits, queries = _near(spark, sf)
    return metrics.recall_at(hits, queries).select(*[F.round(f"recall_{k}", 6).alias(f"recall_{k}") for k in (1, 5, 10)])


@query(f"WITH {_NEAR}, b AS (SELECT qid, any_value(label) AS label, coalesce(min(CASE WHEN label_match THEN rank END) <= 10, false)::INT AS hit FROM near GROUP BY qid) SELECT label, round(avg(hit), 6) AS recall FROM b GROUP BY label")
def per_class_recall(spark, sf):
    return metrics.per_class_recall(*_near(spark, sf)).withColumn("recall", F.round("recall", 6))


@query("SELECT max(abs(c_acctbal - round(c_acctbal, 1))) < 0.0501 AS close, count_if(abs(c_acctbal - round(c_acctbal, 1)) > 0.02) AS offenders FROM customer")
def parity_check(spark, sf):
    customer = _read(spark, sf, "customer")
    rounded = customer.select("c_custkey", F.round("c_acctbal", 1).alias("c_acctbal"))
    return metrics.parity(customer, rounded, "c_custkey", "c_acctbal", 0.02).select((F.col("max_difference") < 0.0501).alias("close"), "offenders")


@query("SELECT d.label::INTEGER AS label, coalesce(n, 0) AS n, coalesce(n, 0) < 45 AS sparse FROM range(12) d(label) LEFT JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY label) USING (label)")
def sparse_classes(spark, sf):
    return metrics.sparse_classes(_vectors(spark, sf), _all_labels(spark), 45)


# --- lexical


@query("""SELECT doc_id, t.n AS n_tokens, array_to_string(t.l, ' ') AS tokens FROM (
  SELECT doc_id, text, list_filter(regexp_split_to_array(lower(strip_accents(replace(text, 'ß', ' '))), '[^a-z]+'), lambda x: x <> '') AS a FROM documents) d,
  LATERAL (SELECT len(list_distinct(a)) AS n, list_transform(list_sort(list_transform(list_distinct(a), lambda x: {'p': list_position(a, x), 't': x})), lambda s: s.t) AS l) t""")
def tokenize(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"WITH {_ICONS} SELECT token, count(*) AS n, array_to_string(list(icon_id ORDER BY icon_id), ',') AS icon_ids FROM (SELECT DISTINCT icon_id, unnest(tokens) AS token FROM icons) GROUP BY token")
def inverted_index(spark, sf):
    return lexical.inverted_index(_icons(spark, sf)).select("token", F.size("icon_ids").cast("long").alias("n"), F.array_join(F.transform("icon_ids", lambda x: x.cast("string")), ",").alias("icon_ids"))


@query(f"WITH {_ICONS} SELECT count(*) AS icon_count, count(DISTINCT category) AS category_count, count(DISTINCT (category, pack)) AS pack_count, (SELECT count(DISTINCT t) FROM (SELECT unnest(tokens) AS t FROM icons)) AS token_count FROM icons")
def corpus_counts(spark, sf):
    return lexical.corpus_counts(_icons(spark, sf))


@query("SELECT p_brand, row_number() OVER (ORDER BY first, p_brand) - 1 AS id FROM (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY p_brand)")
def dictionary_build(spark, sf):
    return lexical.dictionary(_read(spark, sf, "part"), "p_brand", "p_partkey")


_PHRASES = [("red ring", 0, "red ring"), ("red ring", 1, "ring"), ("red ring", 2, "hot"), ("gizmo", 0, "gizmo"), ("gizmo", 1, "small gear"), ("nothing", 0, "???"), ("nothing", 1, "unheard")]
_PH = "ph(class, phrase_index, tokens) AS (VALUES " + ", ".join(f"('{c}', {i}, {[t for t in p.split() if t.isalpha()]}::VARCHAR[])" for c, i, p in _PHRASES) + ")"
_MATCH = "m AS (SELECT p.class, p.phrase_index, p.tokens AS wanted, i.* FROM ph p JOIN icons i ON len(p.tokens) > 0 AND list_has_all(i.tokens, p.tokens))"


def _phrases(spark) -> DataFrame:
    return spark.createDataFrame(_PHRASES, "class string, phrase_index int, phrase string").select("class", "phrase_index", text.tokenize(F.col("phrase")).alias("tokens"))


@query(f"WITH {_ICONS}, {_PH}, {_MATCH} SELECT class, phrase_index::INTEGER AS phrase_index, icon_id FROM m")
def phrase_match(spark, sf):
    return lexical.match_phrases(_phrases(spark), lexical.postings(_icons(spark, sf)))


@query(f"WITH {_ICONS}, {_PH}, {_MATCH} SELECT class, phrase_index::INTEGER AS phrase_index, icon_id FROM m")
def phrase_match_bitmaps(spark, sf):
    return lexical.match_bitmaps(_phrases(spark), lexical.posting_bitmaps(_icons(spark, sf)))


@query(f"""WITH {_ICONS}, {_PH}, {_MATCH}, b AS (SELECT class, icon_id, max(CASE WHEN phrase_index = 0 THEN 100 ELSE 50 + greatest(0, 40 - 10 * phrase_index) END + 10 * len(wanted) + CASE WHEN tokens = wanted THEN 20 ELSE 0 END) AS relevance FROM m GROUP BY ALL),
  s AS (SELECT b.class, b.icon_id, relevance + CASE WHEN (b.class = 'red ring' AND category = 'Brand#2') OR (b.class = 'gizmo' AND category = 'Brand#5') THEN 30 ELSE 0 END + CASE category WHEN 'Brand#3' THEN -15 WHEN 'Brand#4' THEN -40 ELSE 0 END AS score
    FROM b JOIN icons i USING (icon_id) WHERE NOT (b.class = 'gizmo' AND list_contains(i.tokens, 'blue')))
  SELECT class, rank::INTEGER AS rank, icon_id, score::INTEGER AS score FROM (SELECT *, row_number() OVER (PARTITION BY class ORDER BY score DESC, icon_id) AS rank FROM s) WHERE rank <= 12""")
def candidate_score_topk(spark, sf):
    liked = spark.createDataFrame([("red ring", "Brand#2"), ("gizmo", "Brand#5")], "class string, category string")
    points = spark.createDataFrame([("Brand#3", -15), ("Brand#4", -40)], "category string, points int")
    banned = spark.createDataFrame([("gizmo", "blue")], "class string, token string")
    return lexical.score_candidates(_phrases(spark), _icons(spark, sf), liked, points, banned)


@query("SELECT n_nationkey AS icon_id, n_regionkey AS pack_id, r_name || '/' || 'REGION ' || r_regionkey || '/' || n_name || '.svg' AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def dictionary_decode(spark, sf):
    region = _read(spark, sf, "region")
    packs = region.select(F.col("r_regionkey").alias("pack_id"), F.col("r_regionkey").alias("category_id"), F.concat(F.lit("REGION "), F.col("r_regionkey")).alias("pack"))
    categories = region.select(F.col("r_regionkey").alias("category_id"), F.col("r_name").alias("name"))
    icons = _read(spark, sf, "nation").select(F.col("n_nationkey").alias("icon_id"), F.col("n_regionkey").alias("pack_id"), F.concat("n_name", F.lit(".svg")).alias("filename"))
    return lexical.icon_paths(icons, packs, categories)


@query(f"WITH {_ICONS} SELECT icon_id, category, pack, icon_id || '-' || replace(filename, ' ', '-') AS name, filename AS label, true AS confined FROM icons")
def path_parts(spark, sf):
    icons = _icons(spark, sf).select("icon_id", "path", text.path_parts(F.col("path")).alias("p"))
    return icons.select("icon_id", "p.category", "p.pack", "p.name", text.display_label(F.col("p.name")).alias("label"), text.confined_path(F.col("path")).alias("confined"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) || CASE page_id % 3 WHEN 0 THEN '.svg' WHEN 1 THEN '/../x.svg' ELSE '.SVG' END AS path FROM pages)
  SELECT page_id, path, (ends_with(path, '.svg') AND NOT contains(path, '\') AND len(string_split(path, '/')) >= 2 AND len(list_filter(string_split(path, '/'), lambda s: s IN ('', '.', '..'))) = 0) AS confined FROM p""")
def confined_path(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, F.lit(".svg")).when(F.col("page_id") % 3 == 1, F.lit("/../x.svg")).otherwise(F.lit(".SVG"))
    path = F.concat(F.regexp_extract("url", r"://[^/?#]*/?([^?#]*)", 1), tail)
    return _read(spark, sf, "pages").select("page_id", path.alias("path"), text.confined_path(path).alias("confined"))


@query(f"""SELECT page_id, 'https://cdn.jsdelivr.net/gh/owner/icons@{COMMIT}/' || replace(replace(replace(replace(replace(replace(replace(url_encode(url), '%2F', '/'), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*'), '%7E', '~') AS url FROM pages""")
def canonical_url(spark, sf):
    return _read(spark, sf, "pages").select("page_id", text.canonical_url(F.lit("owner/icons"), F.lit(COMMIT), F.col("url")).alias("url"))


@query("SELECT p_brand, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 3")
def first_n_per_pack(spark, sf):
    return lexical.first_per_pack(_read(spark, sf, "part"), 3, "p_brand", "p_partkey").select("p_brand", "p_partkey")


@query("SELECT DISTINCT l_partkey AS icon_id FROM lineitem")
def candidate_union(spark, sf):
    lists = _read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("candidate_ids"))
    return lexical.candidate_union(lists)


@query("""SELECT page_id AS seq, string_split(path, '/')[1] AS category, string_split(path, '/')[2] AS pack, string_split(path, '/')[3] AS filename FROM (
  SELECT page_id, 'pages/' || (page_id % 7) || '/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.SVG' ELSE '.png' END AS path FROM pages) WHERE lower(path) LIKE '%.svg'""")
def tree_listing(spark, sf):
    path = F.concat_ws("/", F.lit("pages"), (F.col("page_id") % 7).cast("string"), F.concat(F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, F.lit(".SVG")).otherwise(F.lit(".png"))))
    return lexical.icons_of_tree(_read(spark, sf, "pages").select(F.col("page_id").alias("seq"), path.alias("path"))).select("seq", "category", "pack", "filename")


@query("SELECT o_orderkey, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN printf('%.1f KB', floor(b / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(b / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS size FROM (SELECT o_orderkey, floor(o_totalprice * 10)::BIGINT AS b FROM orders)")
def format_bytes(spark, sf):
    return _read(spark, sf, "orders").select("o_orderkey", text.format_bytes(F.floor(F.col("o_totalprice") * 10)).alias("size"))


# --- fetched files, addresses, names


@query("""WITH o AS (SELECT o_orderkey, 200 + (o_orderkey * 7) % 400 AS status, o_orderkey % 8 AS attempt, (o_orderkey % 4) / 4.0::DOUBLE AS jitter, CASE o_orderkey % 3 WHEN 0 THEN 'evil.example' ELSE 'cdn.jsdelivr.net' END AS host,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN ' Image/SVG+XML ; charset=utf-8' WHEN 2 THEN 'text/html' ELSE 'text/xml' END AS kind, CASE WHEN o_orderkey % 7 <> 0 THEN floor(o_totalprice)::BIGINT END AS size FROM orders)
  SELECT o_orderkey, CASE WHEN status BETWEEN 200 AND 299 THEN 'ok' WHEN status IN (404, 410) THEN 'missing' WHEN status IN (403, 408, 425, 429) OR status >= 500 THEN 'retry' ELSE 'failed' END AS outcome,
    least(1000.0::DOUBLE * pow(2, attempt), 30000.0::DOUBLE) + jitter * 250 AS delay, host = 'cdn.jsdelivr.net' AND coalesce(kind LIKE '%mage/%' OR kind = 'text/xml', false) AND (size IS NULL OR size <= 200000) AS trusted FROM o""")
def fetch_outcomes(spark, sf):
    k = F.col("o_orderkey")
    host = F.when(k % 3 == 0, F.lit("evil.example")).otherwise(F.lit("cdn.jsdelivr.net"))
    kind = F.when(k % 5 == 1, F.lit(" Image/SVG+XML ; charset=utf-8")).when(k % 5 == 2, F.lit("text/html")).when(k % 5 > 2, F.lit("text/xml"))
    size = F.when(k % 7 != 0, F.floor("o_totalprice"))
    trusted = files.trusted_response(host, kind, size, 200_000)
    return _read(spark, sf, "orders").select("o_orderkey", files.fetch_status(200 + (k * 7) % 400).alias("outcome"), files.retry_delay((k % 8).cast("double"), (k % 4) / 4).alias("delay"), trusted.alias("trusted"))


_CDN = "https://cdn.jsdelivr.net/gh/owner/icons@"


@query(f"""WITH p AS (SELECT page_id, 'a b/' || page_id || '+x.svg' AS path FROM pages), u AS (SELECT *, CASE page_id % 5 WHEN 0 THEN '{_CDN}{COMMIT}/a%20b/' || page_id || '%2Bx.svg' WHEN 1 THEN '{_CDN}{COMMIT}/a%20b/0-other.svg'
    WHEN 2 THEN 'https://cdn.example/gh/owner/icons@{COMMIT}/a%20b/' || page_id || '%2Bx.svg' WHEN 3 THEN '{_CDN}0123/a%20b/' || page_id || '%2Bx.svg' ELSE '{_CDN}{COMMIT[::-1]}/a%20b/' || page_id || '+x.svg' END AS url FROM p)
  SELECT page_id, url = '{_CDN}{COMMIT}/' || replace(url_encode(path), '%2F', '/') AS of_source, url_decode(replace(regexp_extract(url, '^https://cdn\\.jsdelivr\\.net/gh/[^/]+/[^/@]+@[0-9a-f]{{40}}/([^?#]+)$', 1), '+', '%2B')) = path AS pinned FROM u""")
def approved_urls(spark, sf):
    k, number = F.col("page_id"), F.col("page_id").cast("string")
    path = F.concat(F.lit("a b/"), number, F.lit("+x.svg"))
    at = lambda base, tail: F.concat(F.lit(f"{base}/a%20b/"), number, F.lit(tail))
    url = F.when(k % 5 == 0, at(_CDN + COMMIT, "%2Bx.svg")).when(k % 5 == 1, F.lit(f"{_CDN}{COMMIT}/a%20b/0-other.svg")).when(k % 5 == 2, at(f"https://cdn.example/gh/owner/icons@{COMMIT}", "%2Bx.svg"))
    url = url.when(k % 5 == 3, at(_CDN + "0123", "%2Bx.svg")).otherwise(at(_CDN + COMMIT[::-1], "+x.svg"))
    return _read(spark, sf, "pages").select(k, text.approved_url(url, path, F.lit("owner/icons"), F.lit(COMMIT)).alias("of_source"), text.approved_url(url, path).alias("pinned"))


@query(f"WITH {_ICONS} SELECT icon_id, category, digest, row_number() OVER (PARTITION BY category ORDER BY digest, icon_id) - 1 AS place FROM (SELECT icon_id, category, sha256(text) AS digest FROM icons JOIN documents ON doc_id = icon_id WHERE icon_id % 4 <> 0)")
def available_icons(spark, sf):
    digests = _read(spark, sf, "documents").select(F.col("doc_id").alias("icon_id"), F.when(F.col("doc_id") % 4 != 0, F.sha2("text", 256)).alias("digest"))
    return dedup.available(_icons(spark, sf).select("icon_id", "category"), digests, "category")


@query("SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[^a-z]+'), lambda t: t NOT IN ('', 'svg')), ' ') AS tokens FROM part")
def tokenize_filename(spark, sf):
    name = F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, F.lit(".svg")).otherwise(F.lit(".SVG")))
    return _read(spark, sf, "part").select("p_partkey", F.array_join(text.tokenize_filename(name), " ").alias("tokens"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM documents""")
def xml_escape(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", F.md5(text.xml_escape(F.col("text")).cast("binary")).alias("escaped"))


@query("""SELECT r, array_to_string(list(name ORDER BY name COLLATE de), '|') AS names FROM (SELECT n_regionkey AS r, CASE n_nationkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN 'The ' || n_name ELSE n_name END AS name FROM nation) GROUP BY r""")
def reviewed_in_order(spark, sf):
    name = F.when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 3 == 1, F.concat(F.lit("The "), F.col("n_name"))).otherwise(F.col("n_name"))
    rows = _read(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("r")).agg(F.collect_list(name).alias("n"))
    return rows.select("r", F.array_join(curation.locale_sorted(F.col("n")), "|").alias("names"))


# --- deduplication


@query("SELECT sha256(text) AS digest, min(doc_id) AS representative, count(*) AS duplicates FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("d"))
    return dedup.by_digest(docs, "d", "doc_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS representative FROM documents")
def content_members(spark, sf):
    return dedup.members(_read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("d")), "d", "doc_id")


@query(r"SELECT sha256(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')) AS digest, min(doc_id) AS representative, count(*)::BIGINT AS duplicates FROM documents GROUP BY 1")
def two_level_dedup(spark, sf):
    docs = _read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("d"), F.sha2(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), 256).alias("e"))
    return dedup.two_level(docs, "d", "e", "doc_id")


@query("SELECT d.status::INTEGER AS status, coalesce(n, 0) AS n FROM range(4) d(status) LEFT JOIN (SELECT CASE WHEN n_chars < 100 THEN 2 WHEN n_chars > 10000 THEN 3 ELSE 0 END AS status, count(*) AS n FROM documents GROUP BY 1) USING (status)")
def status_histogram(spark, sf):
    status = F.when(F.col("n_chars") < 100, F.lit(raster.EMPTY)).when(F.col("n_chars") > 10000, F.lit(raster.OUT_OF_BAND)).otherwise(F.lit(raster.OK))
    every = spark.range(4).select(F.col("id").cast("int").alias("status"))
    return dedup.histogram(_read(spark, sf, "documents").select(status.alias("status")), "status", every)


_PIECES = ", ".join(f"sum(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT)::VARCHAR AS p{k}" for k in range(8))


@query(f"""WITH r AS (SELECT sha256('{{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}}') AS h FROM nation),
  s AS (SELECT count(*) AS rows, {_PIECES} FROM r) SELECT rows, sha256(concat_ws(':', rows, {", ".join(f"p{k}" for k in range(8))})) AS fingerprint FROM s""")
def table_fingerprint(spark, sf):
    return dedup.table_fingerprint(_read(spark, sf, "nation"), "n_nationkey", "n_name", "n_regionkey")


# --- datasets


@query("SELECT d.role AS split, coalesce(n, 0) AS count, coalesce(lo, 0) AS min_length, coalesce(hi, 0) AS max_length FROM (VALUES ('user'), ('assistant'), ('nobody')) d(role) LEFT JOIN (SELECT role, count(*) AS n, min(length(text)) AS lo, max(length(text)) AS hi FROM conversations GROUP BY role) USING (role)")
def split_profile(spark, sf):
    turns = _read(spark, sf, "conversations").select(F.col("role").alias("split"), F.length("text").cast("long").alias("length"))
    return dataset.split_profile(turns, spark.createDataFrame([("user",), ("assistant",), ("nobody",)], "split string"))


@query("SELECT conv_id, array_to_string(list(DISTINCT role ORDER BY role), ',') AS role FROM conversations GROUP BY conv_id")
def distinct_values(spark, sf):
    return dataset.distinct_values(_read(spark, sf, "conversations"), "conv_id", "role").select("conv_id", F.array_join("role", ",").alias("role"))


@query("SELECT label, vec_id, draw FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY sha256('17:' || label || ':' || vec_id), vec_id) AS draw FROM embeddings) WHERE draw <= 20")
def stratified_sample(spark, sf):
    rows = _read(spark, sf, "embeddings").select("vec_id", "label")
    return dataset.stratified_sample(rows, ["label"], "vec_id", 20, 17).select("label", "vec_id", "draw")


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY sha256('5:' || quality || ':' || doc_id), doc_id) <= least(100, count(*) OVER (PARTITION BY quality) - 2))::INTEGER AS split FROM labels")
def holdout_split(spark, sf):
    return dataset.holdout(_read(spark, sf, "labels").select("doc_id", "quality"), "quality", "doc_id", 100, 5)


@query("SELECT vec_id, CASE label WHEN 2 THEN 0 WHEN 5 THEN 1 ELSE 2 END AS label FROM embeddings WHERE label IN (2, 5, 7)")
def class_remap(spark, sf):
    mapping = spark.createDataFrame([(2, 0), (5, 1), (7, 2)], "old int, new int")
    return dataset.remap_classes(_read(spark, sf, "embeddings").select("vec_id", "label"), mapping)


@query("SELECT role AS split, count(*) AS count, 300::INTEGER AS expected FROM conversations GROUP BY role HAVING count(*) <> 300")
def wrong_splits(spark, sf):
    counts = _read(spark, sf, "conversations").groupBy(F.col("role").alias("split")).agg(F.count("*").alias("count"))
    roles = {"user": 300, "assistant": 300, "system": 300}
    return dataset.wrong_splits(counts, roles)


@query("SELECT p_brand, count(*) AS available FROM part GROUP BY p_brand HAVING count(*) < 80")
def short_strata(spark, sf):
    return dataset.short_strata(_read(spark, sf, "part"), ["p_brand"], 80)


@query("WITH n AS (SELECT count(*) AS n FROM part) SELECT p_partkey, (((p_partkey + 1) * 7 - 1) // n)::INTEGER AS part FROM part, n")
def contiguous_parts(spark, sf):
    part = _read(spark, sf, "part")
    total = part.agg(F.count("*").alias("n"))
    return part.join(F.broadcast(total)).select("p_partkey", dataset.contiguous_part(F.col("p_partkey"), F.col("n"), 7).alias("part"))


@query("SELECT n_name AS name, sha256(n_name || ':' || n_regionkey) AS fingerprint FROM nation WHERE n_regionkey % 2 = 1")
def stale_artifacts(spark, sf):
    nation = _read(spark, sf, "nation")
    now = nation.select(F.col("n_name").alias("name"), F.sha2(F.concat_ws(":", "n_name", "n_regionkey"), 256).alias("fingerprint"))
    cached = nation.select(F.col("n_name").alias("name"), F.sha2(F.concat_ws(":", "n_name", F.col("n_regionkey") + F.col("n_regionkey") % 2), 256).alias("fingerprint"))
    return dataset.stale(now, cached)


# --- strokes


def _strokes(spark, sf) -> DataFrame:
    return _read(spark, sf, "events").select(F.col("user_id").alias("drawing_id"), F.col("event_id").alias("seq"), F.col("value").alias("dx"), (F.col("event_id") % 10).cast("double").alias("dy"), (F.col("event_type") == "purchase").cast("int").alias("pen"))


_STROKES = """s AS (SELECT user_id AS drawing_id, event_id AS seq, value AS dx, (event_id % 10)::DOUBLE AS dy, (event_type = 'purchase')::INTEGER AS pen FROM events),
  p AS (SELECT drawing_id, seq, sum(dx) OVER w AS x, sum(dy) OVER w AS y, coalesce(sum(pen) OVER (PARTITION BY drawing_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS polyline
    FROM s WINDOW w AS (PARTITION BY drawing_id ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


@query(f"WITH {_STROKES} SELECT drawing_id, seq, round(x, 4) AS x, round(y, 4) AS y, polyline FROM p")
def stroke_prefix_sum(spark, sf):
    return strokes.decode_stroke3(_strokes(spark, sf)).withColumn("x", F.round("x", 4)).withColumn("y", F.round("y", 4))


@query(f"WITH {_STROKES} SELECT drawing_id, seq, round(x, 4) AS x, round(y, 4) AS y, polyline FROM p")
def stroke_prefix_sum_blocks(spark, sf):
    """The same points, from blocks of 500 numbers: no task needs a whole drawing."""
    out = strokes.decode_long_stroke3(_strokes(spark, sf), block=500)
    return out.select("drawing_id", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "polyline")


@query(f"WITH {_STROKES} SELECT drawing_id, round(min(x), 4) AS left, round(min(y), 4) AS top, round(max(x), 4) AS right, round(max(y), 4) AS bottom FROM p GROUP BY drawing_id")
def bbox(spark, sf):
    box = strokes.bounding_box(strokes.decode_stroke3(_strokes(spark, sf)), "drawing_id")
    return box.select("drawing_id", *[F.round(c, 4).alias(c) for c in ("left", "top", "right", "bottom")])


@query(f"""WITH {_STROKES}, b AS (SELECT *, min(x) OVER w AS lx, min(y) OVER w AS ly, max(x) OVER w - min(x) OVER w AS wide, max(y) OVER w - min(y) OVER w AS high FROM p WINDOW w AS (PARTITION BY drawing_id)),
  s2 AS (SELECT *, coalesce(least(CASE WHEN wide > 0 THEN 53.5::DOUBLE / wide END, CASE WHEN high > 0 THEN 53.5::DOUBLE / high END), 1.0) AS scale FROM b)
  SELECT drawing_id, seq, round((x - lx) * scale + (64 - wide * scale) / 2, 4) AS nx, round((y - ly) * scale + (64 - high * scale) / 2, 4) AS ny FROM s2""")
def normalize_square(spark, sf):
    out = strokes.normalize_square(strokes.decode_stroke3(_strokes(spark, sf)), "drawing_id")
    return out.select("drawing_id", "seq", F.round("nx", 4).alias("nx"), F.round("ny", 4).alias("ny"))


@query("""SELECT user_id AS drawing_id, CASE WHEN max(abs(value)) > 32767 THEN 'not a 16-bit number' WHEN arg_max(event_type, event_id) <> 'purchase' THEN 'no final lift' END AS problem FROM events GROUP BY user_id""")
def stroke_validate(spark, sf):
    rows = _strokes(spark, sf).groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("seq", "dx", "dy", "pen"))).alias("s"))
    return rows.select("drawing_id", strokes.stroke3_problem(F.col("s")).alias("problem"))


_HEX = "('0x' || substr(h, 1 + 2 * i, 2))::INTEGER"


@query(f"""WITH b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN repeat('0', 64) ELSE sha256(text) END AS h FROM documents), s AS (SELECT doc_id, list_sum(list_transform(range(32), lambda i: {_HEX}))::DOUBLE / 32 / 255 AS share FROM b)
  SELECT doc_id, round(share, 9) AS share, CASE WHEN share = 0 THEN 2 WHEN share BETWEEN 0.01 AND 0.6 THEN 0 ELSE 3 END AS status FROM s""")
def ink_band(spark, sf):
    """Bitmaps of 32 pixels: a text's digest, or none of it."""
    bitmap = F.unhex(F.when(F.col("doc_id") % 5 == 0, F.lit("0" * 64)).otherwise(F.sha2("text", 256)))
    rows = _read(spark, sf, "documents").select("doc_id", raster.ink_share(bitmap).alias("share"))
    return rows.select("doc_id", F.round("share", 9).alias("share"), raster.band_status(F.col("share")).alias("status"))


@query(f"""SELECT doc_id, array_to_string(list_transform(range(32), lambda i: ({_HEX} + 128) % 256 - 128), ',') AS codes FROM (SELECT doc_id, sha256(text) AS h FROM documents)""")
def base64_codes(spark, sf):
    blob = F.unbase64(F.base64(F.unhex(F.sha2("text", 256))))
    return _read(spark, sf, "documents").select("doc_id", F.array_join(F.transform(files.int8_codes(blob), lambda c: c.cast("string")), ",").alias("codes"))


def _drawn(spark, sf) -> DataFrame:
    """A line through all points of each drawing."""
    points = strokes.decode_stroke3(_strokes(spark, sf)).groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("p"))
    return points.select("drawing_id", F.transform("p", lambda s: F.struct(s["x"].cast("double").alias("x"), s["y"].cast("double").alias("y"))).alias("p"))


@query(f"""WITH {_STROKES}, f AS (SELECT drawing_id, list_reduce(list([x, y] ORDER BY seq), lambda a, p: CASE WHEN sqrt((p[1] - a[-2])**2 + (p[2] - a[-1])**2) >= 60 THEN a || p ELSE a END) AS a FROM p GROUP BY drawing_id)
  SELECT drawing_id, (len(a) // 2)::INTEGER AS points, round(list_sum(a), 4) AS total FROM f""")
def thin_points(spark, sf):
    kept = _drawn(spark, sf).select("drawing_id", strokes.thin_points(F.col("p"), 60.0).alias("k"))
    total = F.aggregate("k", F.lit(0.0), lambda s, p: s + p["x"] + p["y"])
    return kept.select("drawing_id", F.size("k").alias("points"), F.round(total, 4).alias("total"))


@query("""SELECT drawing_id, count(*) FILTER (b IS NULL OR b <> a)::INTEGER AS points FROM (SELECT user_id AS drawing_id, (floor(value / 40), event_id % 2) AS a, lag((floor(value / 40), event_id % 2)) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) GROUP BY drawing_id""")
def without_repeats(spark, sf):
    at = F.struct(F.col("event_id").alias("seq"), F.floor(F.col("value") / 40).alias("x"), (F.col("event_id") % 2).alias("y"))
    rows = _read(spark, sf, "events").groupBy(F.col("user_id").alias("drawing_id")).agg(F.array_sort(F.collect_list(at)).alias("p"))
    points = rows.select("drawing_id", F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("p"))
    return points.select("drawing_id", F.size(strokes.without_repeats(F.col("p"))).alias("points"))


@query("""WITH e AS (SELECT user_id AS drawing_id, event_type, event_id, value, (bool_and(event_id % 97 <> 0) OVER (PARTITION BY user_id)) AS whole FROM events)
  SELECT drawing_id, event_type AS stroke, CASE WHEN whole THEN count(*) END AS points, CASE WHEN whole THEN round(sum(value + event_id % 10), 4) END AS total FROM e GROUP BY drawing_id, event_type, whole""")
def quickdraw_strokes(spark, sf):
    """A stroke for each type of event; a drawing whose coordinates don't all pair up is refused as a whole."""
    y = F.when(F.col("event_id") % 97 != 0, (F.col("event_id") % 10).cast("double"))  # collect_list leaves nulls out
    rows = _read(spark, sf, "events").groupBy(F.col("user_id").alias("drawing_id"), F.col("event_type").alias("stroke"))
    rows = rows.agg(F.struct(F.collect_list("value").alias("x"), F.collect_list(y).alias("y")).alias("s"))
    whole = rows.groupBy("drawing_id").agg(F.array_sort(F.collect_list(F.struct("stroke", "s"))).alias("all"))
    lines = whole.select("drawing_id", "all", strokes.quickdraw_polylines(F.transform("all", lambda a: a["s"])).alias("lines"))
    each = lines.select("drawing_id", F.posexplode("all").alias("i", "a"), "lines").select("drawing_id", "a.stroke", F.get("lines", F.col("i")).alias("line"))
    total = F.aggregate("line", F.lit(0.0), lambda s, p: s + p["x"] + p["y"])
    return each.select("drawing_id", "stroke", F.when(F.col("line").isNotNull(), F.size("line").cast("long")).alias("points"), F.round(total, 4).alias("total"))


def _number(x: str) -> str:
    return f"regexp_replace(printf('%.4f', {x}), '\\.?0+$', '')"


@query(f"""WITH l AS (SELECT user_id AS drawing_id, event_type AS stroke, list(event_id % 500 ORDER BY event_id) AS x, list((event_id * 7) % 300 ORDER BY event_id) AS y FROM events GROUP BY ALL),
  e AS (SELECT drawing_id, stroke, CASE WHEN len(x) = 1 THEN '<circle cx="' || x[1] || '" cy="' || y[1] || '" r="1.25" fill="#1&amp;2"/>' ELSE '<path d="M ' || x[1] || ' ' || y[1] || ' '
    || array_to_string(list_transform(range(1, len(x)), lambda i: 'Q ' || x[i] || ' ' || y[i] || ' ' || {_number("(x[i] + x[i + 1]) / 2.0::DOUBLE")} || ' ' || {_number("(y[i] + y[i + 1]) / 2.0::DOUBLE")}), ' ')
    || ' L ' || x[-1] || ' ' || y[-1] || '" fill="none" stroke="#1&amp;2" stroke-width="2.5" stroke-linecap="round" stroke-linejoin="round"/>' END AS element FROM l)
  SELECT drawing_id, '<svg xmlns="http://www.w3.org/2000/svg" width="500" height="300" viewBox="0 0 500 300">' || string_agg(element, '' ORDER BY stroke) || '</svg>' AS svg FROM e GROUP BY drawing_id""")
def svg_export(spark, sf):
    """A drawing of each user as one SVG document, a smoothed stroke for each type of event."""
    at = F.struct(F.col("event_id").alias("seq"), (F.col("event_id") % 500).cast("double").alias("x"), (F.col("event_id") * 7 % 300).cast("double").alias("y"))
    rows = _read(spark, sf, "events").groupBy(F.col("user_id").alias("drawing_id"), F.col("event_type").alias("seq")).agg(F.array_sort(F.collect_list(at)).alias("p"))
    points = F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y")))
    return files.svg_document(rows.select("drawing_id", "seq", strokes.stroke_element(points, F.lit("#1&2"), F.lit(2.5)).alias("element")), "drawing_id", 500, 300)


@query()
def stroke_rasters(spark, sf):
    lines = strokes.polylines(strokes.decode_stroke3(_strokes(spark, sf)))
    return lines.select("drawing_id", F.sha2(raster.rasterize_polylines(F.col("polylines")), 256).alias("digest"))


def _svgs(spark, sf) -> DataFrame:
    """A document for each part, of six kinds, with its number and size in the geometry."""
    n, w = F.col("p_partkey"), (F.col("p_size") + 20).cast("string")
    said = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    rest = lambda k: (n % k).cast("string")
    kinds = [
        said('<polygon points="0,0 ', w, ",3 ", rest(90), ",", w, '"/>'),
        said('<path d="M', rest(30), " 2v", w, 'l-3.5 4h9z"/>'),
        said('<g transform="matrix(0 1 -1 0 ', w, ' 0)"><polyline points="1 2 5 ', rest(13), ' 6 6" transform="translate(2,1)"/></g>'),
        said('<path d="M0 0C0 ', w, " ", w, " ", w, " ", w, " 0S", (2 * (F.col("p_size") + 20)).cast("string"), " -", w, " ", (2 * (F.col("p_size") + 20)).cast("string"), ' 0"/>'),
        said('<g opacity="0"><rect height="3" width="', w, '"/></g>'),
        said('<path d="M1 1Q', w, '"/>'),
    ]
    body = F.element_at(F.array(*kinds), (n % 6 + 1).cast("int"))
    return _read(spark, sf, "part").select(n.alias("id"), F.concat(F.lit("<svg>"), body, F.lit("</svg>")).alias("svg"))


#: Both cubics of the wave (kind 3), halved until they are flat; the second one's first inner point mirrors the one before.
_WAVE = """wave(id, w, part, place, depth, x0, y0, x1, y1, x2, y2, x3, y3) AS (
    SELECT p_partkey, p_size + 20.0::DOUBLE, part, 0::BIGINT, 0, part * (p_size + 20.0::DOUBLE), 0.0::DOUBLE, part * (p_size + 20.0::DOUBLE), sign * (p_size + 20.0::DOUBLE), (part + 1) * (p_size + 20.0::DOUBLE), sign * (p_size + 20.0::DOUBLE), (part + 1) * (p_size + 20.0::DOUBLE), 0.0::DOUBLE
    FROM part, (VALUES (0, 1), (1, -1)) v(part, sign) WHERE p_partkey % 6 = 3
    UNION ALL
    SELECT id, w, part, 2 * place + side, depth + 1, CASE side WHEN 0 THEN x0 ELSE mx END, CASE side WHEN 0 THEN y0 ELSE my END, CASE side WHEN 0 THEN ax ELSE ex END, CASE side WHEN 0 THEN ay ELSE ey END,
      CASE side WHEN 0 THEN dx ELSE cx END, CASE side WHEN 0 THEN dy ELSE cy END, CASE side WHEN 0 THEN mx ELSE x3 END, CASE side WHEN 0 THEN my ELSE y3 END
    FROM (SELECT *, (dx + ex) / 2 AS mx, (dy + ey) / 2 AS my FROM (SELECT *, (ax + bx) / 2 AS dx, (ay + by_) / 2 AS dy, (bx + cx) / 2 AS ex, (by_ + cy) / 2 AS ey FROM (
      SELECT *, (x0 + x1) / 2 AS ax, (y0 + y1) / 2 AS ay, (x1 + x2) / 2 AS bx, (y1 + y2) / 2 AS by_, (x2 + x3) / 2 AS cx, (y2 + y3) / 2 AS cy FROM wave
      WHERE depth < 16 AND pow(abs((x1 - x3) * (y3 - y0) - (y1 - y3) * (x3 - x0)) + abs((x2 - x3) * (y3 - y0) - (y2 - y3) * (x3 - x0)), 2) > pow(w * sqrt(8.0::DOUBLE) / 256, 2) * (pow(x3 - x0, 2) + pow(y3 - y0, 2))))), (VALUES (0), (1)) s(side)),
  chords AS (SELECT id, list([x3, y3] ORDER BY part, (place::DOUBLE) / pow(2, depth)) AS line FROM wave a WHERE NOT EXISTS (SELECT 1 FROM wave b WHERE b.id = a.id AND b.part = a.part AND b.depth = a.depth + 1 AND b.place = 2 * a.place) GROUP BY id)"""


@query(f"""WITH RECURSIVE {_WAVE}, p AS (SELECT p_partkey AS id, p_partkey % 6 AS kind, p_size + 20 AS w, p_partkey AS n FROM part), l AS (SELECT p.id, CASE kind
    WHEN 0 THEN [[0, 0], [w, 3], [n % 90, w], [0, 0]]::DOUBLE[][] WHEN 1 THEN [[n % 30, 2], [n % 30, 2 + w], [n % 30 - 3.5, 6 + w], [n % 30 + 5.5, 6 + w], [n % 30, 2]]::DOUBLE[][]
    WHEN 2 THEN [[w - 3, 3], [w - n % 13 - 1, 7], [w - 7, 8]]::DOUBLE[][] WHEN 3 THEN [[0, 0]::DOUBLE[]] || chords.line END AS line FROM p LEFT JOIN chords USING (id))
  SELECT id, true AS readable, 0 AS line, (n - 1)::INTEGER AS point, round(line[n][1], 4) + 0.0 AS x, round(line[n][2], 4) + 0.0 AS y FROM (SELECT id, line, unnest(range(1, len(line) + 1)) AS n FROM l WHERE line IS NOT NULL)
  UNION ALL SELECT p_partkey, p_partkey % 6 = 4, NULL, NULL, NULL, NULL FROM part WHERE p_partkey % 6 IN (4, 5)""")
def svg_polylines(spark, sf):
    """The points of every document, and a row without one where nothing is drawn or the document can't be read."""
    rows = _svgs(spark, sf).select("id", raster.polylines_of_svg(F.col("svg")).alias("p"))
    lines = rows.select("id", F.col("p").isNotNull().alias("readable"), F.posexplode_outer("p").alias("line", "l"))
    points = lines.select("id", "readable", "line", F.posexplode_outer("l").alias("point", "at"))
    return points.select("id", "readable", "line", "point", *[(F.round(f"at.{c}", 4) + 0.0).alias(c) for c in "xy"])


@query()
def svg_rasters(spark, sf):
    rows = _svgs(spark, sf).select("id", raster.rasterize_svg(F.col("svg")).alias("r"))
    return rows.select("id", F.col("r.status").cast("int").alias("status"), F.sha2("r.bitmap", 256).alias("digest"))


@query(f"""WITH {_STROKES} SELECT drawing_id, seq, round(x * 640.0::DOUBLE / 1000, 4) AS x, round(y * 450.0::DOUBLE / 800, 4) AS y, round(2.5::DOUBLE * sqrt(0.64::DOUBLE * 0.5625::DOUBLE), 6) AS width FROM p""")
def scaled_scene(spark, sf):
    """Every stroke's points after the stage went from 1000 x 800 to 640 x 450."""
    across, down = (strokes.stage_scale(F.lit(a), F.lit(b)) for a, b in ((1000, 640), (800, 450)))
    points = strokes.decode_stroke3(_strokes(spark, sf))
    stroke = strokes.scaled_stroke(F.array(F.struct("x", "y")), F.lit(2.5), across, down)
    rows = points.select("drawing_id", "seq", stroke.alias("s"))
    return rows.select("drawing_id", "seq", F.round(F.col("s.points")[0]["x"], 4).alias("x"), F.round(F.col("s.points")[0]["y"], 4).alias("y"), F.round("s.width", 6).alias("width"))


@query("""SELECT user_id, event_type, arg_max(round(value, 4), (event_id % 3, event_id)) AS value FROM (SELECT * FROM events WHERE event_id % 3 = 0 UNION ALL SELECT * FROM events WHERE event_id % 3 > 0) GROUP BY user_id, event_type""")
def merged_maps(spark, sf):
    """Three maps for each user, of the last value of each type among a third of the events; of equal keys the later map counts."""
    last = _read(spark, sf, "events").groupBy("user_id", (F.col("event_id") % 3).alias("third"), "event_type").agg(F.max_by("value", "event_id").alias("value"))
    maps = last.groupBy("user_id").pivot("third", [0, 1, 2]).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "value"))))
    none = F.create_map().cast("map<string,double>")
    first, second, third = (F.coalesce(F.col(str(i)), none) for i in range(3))
    return maps.select("user_id", F.explode(text.merged(text.merged(first, second), third)).alias("event_type", "value")).withColumn("value", F.round("value", 4))


@query("""SELECT c_custkey, CASE c_custkey % 10 WHEN 1 THEN 'kind' WHEN 2 THEN 'classes' WHEN 3 THEN 'rasterizer' WHEN 4 THEN 'format' WHEN 5 THEN 'dimension' WHEN 6 THEN 'input' WHEN 7 THEN 'embedding' WHEN 8 THEN 'logits' WHEN 9 THEN 'classes' END AS problem FROM customer""")
def metadata_problems(spark, sf):
    """The metadata of a model for each customer, with one kind of damage in each of nine residues."""
    k, dim = F.col("c_custkey") % 10, F.when(F.col("c_custkey") % 10 == 5, F.lit("7")).otherwise((F.col("c_custkey") % 50 + 8).cast("string"))
    pick = lambda bad, broken, good: F.when(k == bad, F.lit(broken)).otherwise(F.lit(good))
    size = pick(3, "6", "64")
    json = F.concat(
        F.lit('{"schemaVersion":1,"kind":"'), pick(1, "classifier", "sketch-embedder"), F.lit('","classes":["'), F.col("c_name"), F.lit('","'), F.when(k == 2, F.col("c_name")).when(k == 9, F.lit("")).otherwise(F.lit("other")),
        F.lit('"],"rasterizer":{"size":'), size, F.lit(',"padding":4,"strokeWidth":2.5,"supersample":4},"model":{"format":"'), pick(4, "TFLite", "ONNX"), F.lit('","embeddingDim":'), dim,
        F.lit(',"input":{"name":"image","dtype":"float32","normalization":"'), pick(6, "none", "uint8 / 255"), F.lit('","shape":["batch",1,'), size, F.lit(","), size,
        F.lit(']},"outputs":{"embedding":{"name":"embedding","dtype":"float32","normalization":"'), pick(7, "L1", "L2"), F.lit('","shape":["batch",'), dim, F.lit(']},"logits":{"name":"logits","dtype":"float32","shape":["batch",'), pick(8, "3", "2"), F.lit("]}}}}"),
    )
    rows = _read(spark, sf, "customer").select("c_custkey", F.from_json(json, encoder.METADATA).alias("m"))
    return rows.select("c_custkey", encoder.metadata_problem(F.col("m")).alias("problem"))


def block_encoder(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stand-in encoder: the mean ink of 8 x 8 blocks at length 1, the first ten of them for logits."""
    v = images.reshape(-1, 8, 8, 8, 8).mean(axis=(2, 4)).reshape(len(images), 64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12), v[:, :10]


@query()
def encoder_hook(spark, sf):
    bitmaps = strokes.polylines(strokes.decode_stroke3(_strokes(spark, sf))).select(F.col("drawing_id").alias("id"), raster.rasterize_polylines(F.col("polylines")).alias("bitmap"))
    return encoder.encode(bitmaps, block_encoder).select("id", F.round(vectors.norm(F.col("embedding")), 3).alias("norm"))


@query()
def drawing_predictions(spark, sf):
    """Drawings to embeddings and ranked classes by a stand-in encoder; blank ones have neither."""
    lines = strokes.polylines(strokes.decode_stroke3(_strokes(spark, sf)))
    drawings = lines.select(F.col("drawing_id").alias("id"), F.when(F.col("drawing_id") % 9 != 0, F.col("polylines")).alias("polylines"))
    out = encoder.embed_drawings(drawings, block_encoder)
    return out.select("id", F.col("embedding").isNotNull().alias("embedded"), F.transform("predictions", lambda p: p["class_index"]).alias("classes"))


# --- curation and suggestions


def _manifest(spark, sf) -> DataFrame:
    return _read(spark, sf, "documents").select(F.col("source").alias("class"), F.col("doc_id").alias("candidate_id"), "lang")


def _decisions(spark, sf) -> DataFrame:
    verdict = F.when(F.col("toxic") == 1, F.lit(curation.REJECTED)).when(F.col("quality") == 1, F.lit(curation.ACCEPTED))
    marks = _read(spark, sf, "labels").select(F.col("doc_id").alias("candidate_id"), verdict.alias("decision")).where("decision is not null")
    return marks.join(_manifest(spark, sf).select("class", "candidate_id"), "candidate_id")


def _reviewed(spark, sf) -> DataFrame:
    return _manifest(spark, sf).select("class").distinct().where(F.col("class").endswith("1"))


_DECIDED = """decided AS (SELECT d.source AS class, l.doc_id AS candidate_id, CASE WHEN toxic = 1 THEN 'rejected' WHEN quality = 1 THEN 'accepted' END AS decision FROM labels l JOIN documents d USING (doc_id) WHERE toxic = 1 OR quality = 1)"""


@query(f"WITH {_DECIDED} SELECT (SELECT count(DISTINCT source) FROM documents) AS class_count, (SELECT count(DISTINCT source) FROM documents WHERE source LIKE '%1') AS reviewed_count, count_if(decision = 'accepted') AS accepted_count, count_if(decision = 'rejected') AS rejected_count FROM decided")
def curation_stats(spark, sf):
    return curation.stats(_manifest(spark, sf), _decisions(spark, sf), _reviewed(spark, sf))


@query(f"WITH {_DECIDED} SELECT m.class, m.candidates, coalesce(d.decided, 0) AS decided, floor(coalesce(d.decided, 0) * 100 / m.candidates + 0.5)::BIGINT AS percent FROM (SELECT source AS class, count(*) AS candidates FROM documents GROUP BY source) m LEFT JOIN (SELECT class, count(*) AS decided FROM decided GROUP BY class) d USING (class)")
def curation_progress(spark, sf):
    return curation.progress(_manifest(spark, sf), _decisions(spark, sf))


@query(f"WITH {_DECIDED}, a AS (SELECT class, candidate_id FROM decided WHERE decision = 'accepted') SELECT * FROM a UNION ALL SELECT DISTINCT source, NULL FROM documents WHERE source LIKE '%1' AND source NOT IN (SELECT class FROM a)")
def curated_export(spark, sf):
    return curation.curated_export(_manifest(spark, sf), _decisions(spark, sf), _reviewed(spark, sf))


@query("SELECT doc_id AS candidate_id, 'src0' AS class FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src0')")
def curation_orphans(spark, sf):
    marks = _read(spark, sf, "labels").select(F.lit("src0").alias("class"), F.col("doc_id").alias("candidate_id"))
    return curation.orphans(marks, _manifest(spark, sf)).select("candidate_id", "class")


@query("SELECT user_id::VARCHAR AS class, (event_id % 7) AS candidate_id, arg_max(event_type, event_id) AS decision FROM events GROUP BY 1, 2 HAVING arg_max(event_type, event_id) <> 'error'")
def lww_fold(spark, sf):
    kind = F.nullif("event_type", F.lit("error"))
    log = _read(spark, sf, "events").select(F.col("user_id").cast("string").alias("class"), (F.col("event_id") % 7).alias("candidate_id"), kind.alias("decision"), F.col("event_id").alias("seq"))
    return curation.fold_decisions(log)


@query("""WITH c AS (SELECT c_mktsegment AS label, c_custkey AS id, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer),
  p(qid, pos, label) AS (VALUES (1, 0, 'BUILDING'), (1, 1, 'MACHINERY'), (1, 2, 'BUILDING'), (2, 0, 'HOUSEHOLD')),
  f AS (SELECT qid, label, min(pos) AS pos FROM p GROUP BY ALL)
  SELECT qid, id, label, place FROM (SELECT f.qid, c.id, f.label, row_number() OVER (PARTITION BY f.qid ORDER BY c.rank, f.pos, c.id) AS place FROM f JOIN c USING (label)) WHERE place <= 25""")
def interleave(spark, sf):
    order = W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey")
    rows = _read(spark, sf, "customer").select(F.col("c_mktsegment").alias("label"), F.col("c_custkey").alias("id"), F.row_number().over(order).alias("rank"))
    guesses = spark.createDataFrame([(1, 0, "BUILDING"), (1, 1, "MACHINERY"), (1, 2, "BUILDING"), (2, 0, "HOUSEHOLD")], "qid int, pos int, label string")
    return curation.interleave(guesses, rows, limit=25)


@query("SELECT class FROM (SELECT source AS class, list(DISTINCT lang) AS a FROM documents GROUP BY source) WHERE class NOT LIKE '%1' AND (contains(lower(class), 'c1') OR len(list_filter(a, lambda x: contains(lower(x), 'c1'))) > 0)")
def class_filter(spark, sf):
    classes = _manifest(spark, sf).groupBy("class").agg(F.collect_set("lang").alias("aliases"))
    return curation.class_filter(classes, classes, _reviewed(spark, sf), "mvp", "pending", "C1").select("class")


@query("SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def neighbours(spark, sf):
    return curation.neighbours(_read(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_orderkey", "o_orderkey", "o_custkey")


@query(r"SELECT path, count(*) AS urls FROM (SELECT DISTINCT regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, url FROM pages) GROUP BY path HAVING count(*) > 1")
def url_conflicts(spark, sf):
    rows = _read(spark, sf, "pages").select(F.regexp_extract("url", r"://[^/?#]*([^?#]*)", 1).alias("path"), "url")
    return curation.conflicting_urls(rows)


@query("SELECT DISTINCT label, problem FROM (SELECT c_mktsegment AS label, 'unknown label' AS problem FROM customer WHERE c_mktsegment NOT IN ('BUILDING') UNION ALL SELECT c_mktsegment, 'probability' FROM customer WHERE c_acctbal / 10000 NOT BETWEEN 0 AND 1)")
def unknown_labels(spark, sf):
    rows = _read(spark, sf, "customer").select(F.col("c_mktsegment").alias("label"), (F.col("c_acctbal") / 10000).alias("probability"))
    return curation.unknown_labels(rows, spark.createDataFrame([("BUILDING", 0, 1)], "label string, rank int, id int")).distinct()


@query("SELECT DISTINCT * FROM (SELECT l_orderkey::VARCHAR AS class, 'repeated id' AS problem FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1 UNION ALL SELECT o_orderkey::VARCHAR, 'no candidates' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT l_orderkey::VARCHAR, 'unknown class' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders))")
def ref_integrity(spark, sf):
    rows = _read(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("class"), F.col("l_linenumber").alias("id"))
    return curation.manifest_problems(rows, _read(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("class")))


@query("""WITH n AS (SELECT o_custkey, o_orderkey, (o_orderkey % 3 = 0) AS gone FROM orders)
  SELECT o_orderkey, coalesce((SELECT min(m.o_orderkey) FROM n m WHERE m.o_custkey = n.o_custkey AND NOT m.gone AND m.o_orderkey > n.o_orderkey),
    (SELECT max(m.o_orderkey) FROM n m WHERE m.o_custkey = n.o_custkey AND NOT m.gone AND m.o_orderkey < n.o_orderkey)) AS successor FROM n WHERE gone""")
def successor(spark, sf):
    orders = _read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return curation.successor(orders, orders.where("o_orderkey % 3 = 0"), "o_orderkey", "o_orderkey", "o_custkey")


@query(f"""WITH m AS (SELECT source AS class, doc_id::VARCHAR AS candidate_id FROM documents),
  d AS (SELECT CASE WHEN doc_id % 17 = 0 THEN 'nowhere' ELSE source END AS class, CASE WHEN doc_id % 5 = 0 THEN '0' || doc_id WHEN doc_id % 7 = 0 THEN (-doc_id - 1)::VARCHAR ELSE doc_id::VARCHAR END AS candidate_id,
    CASE WHEN doc_id % 3 = 0 THEN 'maybe' ELSE 'accepted' END AS decision FROM documents),
  i AS (SELECT * FROM d WHERE class IN (SELECT class FROM m)),
  p AS (SELECT *, CASE WHEN NOT regexp_full_match(candidate_id, '-?(0|[1-9][0-9]*)') THEN 'id' WHEN decision = 'maybe' THEN 'decision' END AS problem FROM i)
  SELECT NULL AS class, NULL AS candidate_id, 'version' AS problem UNION ALL SELECT NULL, NULL, 'fingerprint' UNION ALL SELECT class, candidate_id, 'class' FROM d WHERE class NOT IN (SELECT class FROM m)
  UNION ALL SELECT class, candidate_id, problem FROM p WHERE problem IS NOT NULL
  UNION ALL SELECT class, candidate_id, 'candidate' FROM p WHERE problem IS DISTINCT FROM 'id' AND (class, candidate_id) NOT IN (SELECT class, candidate_id FROM m)
  UNION ALL SELECT 'elsewhere', NULL, 'reviewed class'""")
def state_problems(spark, sf):
    """A state with a wrong version and fingerprint, and damage of each kind in its decisions."""
    n = F.col("candidate_id")
    manifest = _manifest(spark, sf).select("class", "candidate_id")
    written = F.when(n % 5 == 0, F.concat(F.lit("0"), n.cast("string"))).when(n % 7 == 0, (-n - 1).cast("string")).otherwise(n.cast("string"))
    decisions = manifest.select(F.when(n % 17 == 0, F.lit("nowhere")).otherwise(F.col("class")).alias("class"), written.alias("candidate_id"), F.when(n % 3 == 0, F.lit("maybe")).otherwise(F.lit(curation.ACCEPTED)).alias("decision"))
    head = spark.createDataFrame([(curation.PROGRESS_KIND, 2, COMMIT, "old")], "kind string, version int, commit string, fingerprint string")
    want = spark.createDataFrame([(COMMIT, "new")], "commit string, fingerprint string")
    reviewed = _reviewed(spark, sf).union(spark.createDataFrame([("elsewhere",)], "class string"))
    return curation.state_problems(head, decisions, reviewed, want, manifest, manifest.select("class"))


@query("""SELECT l.label AS class_index, 'class ' || l.label AS class_name, p.p_partkey AS icon_id, p.p_name AS path, sha256(d.text) AS digest
  FROM (SELECT DISTINCT label FROM embeddings) l JOIN part p ON p.p_partkey % 10 = l.label JOIN documents d ON d.doc_id = p.p_partkey WHERE d.doc_id % 3 <> 0""")
def planned_icons(spark, sf):
    classes = _vectors(spark, sf).select(F.col("label").alias("class_index"), F.concat(F.lit("class "), F.col("label")).alias("class_name")).distinct()
    candidates = _read(spark, sf, "part").select(F.concat(F.lit("class "), F.col("p_partkey") % 10).alias("class_name"), F.col("p_partkey").alias("icon_id"), F.col("p_name").alias("path"))
    digests = _read(spark, sf, "documents").select(F.col("doc_id").alias("icon_id"), F.when(F.col("doc_id") % 3 != 0, F.sha2("text", 256)).alias("digest"))
    return dataset.planned_icons(classes, candidates, digests)


@query("""WITH c AS (SELECT DISTINCT source AS class FROM documents), r AS (SELECT CASE WHEN n_nationkey % 6 = 0 THEN 'nowhere' ELSE 'src' || (n_nationkey % 5) END AS class, CASE WHEN n_nationkey % 7 = 0 THEN '' ELSE 'Brand#' || n_nationkey END AS value, CASE WHEN n_nationkey % 2 = 0 THEN 'preferred' ELSE 'alias' END AS kind FROM nation)
  SELECT DISTINCT class AS subject, 'unknown class' AS problem FROM r WHERE class NOT IN (SELECT class FROM c) UNION SELECT class, 'empty value' FROM r WHERE value = ''
  UNION SELECT value, 'unknown category' FROM r WHERE kind = 'preferred' AND value <> '' AND value NOT IN (SELECT p_brand FROM part) UNION SELECT 'Brand#x' || r_regionkey, 'unknown category' FROM region UNION SELECT 'Brand#x' || r_regionkey, 'penalty' FROM region WHERE r_regionkey < 3""")
def rule_problems(spark, sf):
    n, r = F.col("n_nationkey"), F.col("r_regionkey")
    named = F.when(n % 6 == 0, F.lit("nowhere")).otherwise(F.concat(F.lit("src"), n % 5))
    rules = _read(spark, sf, "nation").select(F.when(n % 2 == 0, F.lit("preferred")).otherwise(F.lit("alias")).alias("kind"), named.alias("class"), F.when(n % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("Brand#"), n)).alias("value"))
    points = F.when(r == 0, F.lit(float("nan"))).when(r == 1, F.lit(float("-inf"))).when(r > 2, F.lit(-15.0))
    penalties = _read(spark, sf, "region").select(F.concat(F.lit("Brand#x"), r).alias("category"), points.alias("points"))
    return curation.rule_problems(rules, penalties, _manifest(spark, sf).select("class"), _read(spark, sf, "part").select(F.col("p_brand").alias("category")))


@query(f"WITH {_DECIDED} SELECT class, candidate_id::VARCHAR AS candidate_id, decision, class LIKE '%1' AS reviewed FROM decided")
def progress_round_trip(spark, sf):
    """The decisions that come back out of the progress document, written as JSON."""
    head = spark.createDataFrame([(COMMIT, "print")], "commit string, fingerprint string")
    document = curation.progress_document(head, _decisions(spark, sf), _reviewed(spark, sf)).select(F.to_json(F.struct("*")).alias("j"))
    _, rows, reviewed = curation.progress_tables(document.select(F.from_json("j", curation.PROGRESS_DOCUMENT).alias("d")).select("d.*"))
    return rows.join(reviewed.withColumn("r", F.lit(True)), "class", "left").select("class", "candidate_id", "decision", F.coalesce("r", F.lit(False)).alias("reviewed"))


@query("SELECT count(DISTINCT c) AS commits, count(DISTINCT c) = 1 AS agree FROM (SELECT n_regionkey AS c FROM nation UNION ALL SELECT r_regionkey FROM region)")
def same_commit(spark, sf):
    commits = [_read(spark, sf, t).select(F.col(c).cast("string").alias("commit")) for t, c in (("nation", "n_regionkey"), ("region", "r_regionkey"))]
    return dataset.same_commit(*commits)


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_regionkey >= 3")
def untrusted_archives(spark, sf):
    nation = _read(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return dataset.untrusted(nation, nation.where("n_regionkey < 3"))


@query("SELECT count(DISTINCT source) AS classes, count(DISTINCT CASE WHEN lang = 'de' THEN source END) AS covered FROM documents")
def class_coverage(spark, sf):
    manifest = _manifest(spark, sf)
    return dataset.class_coverage(manifest, manifest.where("lang = 'de'"))


_TURNED = " || ".join(f"substr(h, {15 - 2 * i}, 2)" for i in range(8))


@query(f"SELECT vec_id, ('0x' || {_TURNED})::UBIGINT::DECIMAL(20, 0) AS seed FROM (SELECT vec_id, sha256('20260815:' || label || ':train') AS h FROM embeddings)")
def sample_seed(spark, sf):
    return _vectors(spark, sf).select(F.col("icon_id").alias("vec_id"), dataset.sample_seed(20260815, F.col("label"), F.lit("train")).alias("seed"))


@query(f"""WITH {_STROKES}, b AS (SELECT drawing_id, min(x) AS low, max(x) AS high FROM p GROUP BY drawing_id), z AS (SELECT *, least(800.0::DOUBLE, greatest(high - low + 24, 96.0::DOUBLE)) AS size FROM b)
  SELECT drawing_id, round(greatest(0.0::DOUBLE, least(800 - size, (low + high) / 2 - size / 2)), 4) AS start, round(size, 4) AS size FROM z""")
def fitted_axis(spark, sf):
    box = strokes.bounding_box(strokes.decode_stroke3(_strokes(spark, sf)), "drawing_id")
    fit = strokes.fitted_axis(F.col("left"), F.col("right"), F.lit(800.0))
    return box.select("drawing_id", fit.alias("f")).select("drawing_id", F.round("f.start", 4).alias("start"), F.round("f.size", 4).alias("size"))


@query(r"SELECT page_id, regexp_replace(url, '[^/]*$', '') || 'shard-' || (page_id % 256) || '.bin' AS codes, regexp_replace(url, '[^/]*$', '') || 'shard-' || (page_id % 256) || '.meta.json.gz' AS meta FROM pages")
def shard_urls(spark, sf):
    urls = text.shard_urls(F.col("url"), F.col("page_id") % 256)
    return _read(spark, sf, "pages").select("page_id", urls.alias("u")).select("page_id", "u.codes", "u.meta")


# --- extensions


@query("""SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (
    SELECT *, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 10 MINUTE)::INT AS fresh FROM events)) GROUP BY user_id, g""")
def debounce_sessions(spark, sf):
    return folds.debounced(_read(spark, sf, "events"), "user_id", "ts", "10 minutes")


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def newest_result(spark, sf):
    return folds.newest(_read(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")
