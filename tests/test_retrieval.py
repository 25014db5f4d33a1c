import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions import vectors
from inkfold.operators import clustering, retrieval
from inkfold.sources import files

DIM = 8
CLASSES = [(0, "kettle"), (1, "teapot"), (2, "canoe")]
ICONS = [
    (0, 41, "Home & Kitchen/brass/7-kettle.svg", 2, 0, [1.0]),
    (0, 57, "Home & Kitchen/brass/8-teapot.svg", 1, 1, [0.8, 0.6]),
    (1, 63, "Sports/boats/12-canoe.svg", 4, 2, [0.0, 1.0]),
]


def padded(v):
    return v + [0.0] * (DIM - len(v))


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame([(s, i, p, d, a, padded(v)) for s, i, p, d, a, v in ICONS], "shard int, icon_id long, path string, duplicates int, aux_class int, v array<float>")
    rows = rows.withColumn("q", vectors.quantize(F.col("v"))).select("shard", "icon_id", "path", "duplicates", "aux_class", "q.codes", "q.scale")
    centers = spark.createDataFrame([(0, padded([1.0]), 2), (1, padded([0.0, 1.0]), 1)], "shard int, c array<float>, count long")
    return rows, centers.withColumn("q", vectors.quantize(F.col("c"))).select("shard", "q.codes", "q.scale", "count")


def query(spark, v, predictions=None):
    if predictions is None:
        return spark.createDataFrame([(1, padded(v))], "qid int, embedding array<float>")
    return spark.createDataFrame([(1, padded(v), predictions)], "qid int, embedding array<float>, predictions array<struct<class_index:int,label:string,probability:double>>")


def ids(df):
    return [r.icon_id for r in df.orderBy("rank").collect()]


def test_probed_and_warm(spark, index):
    q = query(spark, [1.0])
    assert ids(retrieval.retrieve(q, *index, probes=1, lexical_weight=0)) == [41, 57]
    assert ids(retrieval.retrieve(q, index[0], probes=None, lexical_weight=0)) == [41, 57, 63]
    cold = retrieval.coverage(index[1], retrieval.probe(q, index[1], 1).where("false")).first()
    assert tuple(cold) == (2, 0, 3, 0)
    assert tuple(retrieval.coverage(index[1], retrieval.probe(q, index[1], 2)).first()) == (2, 2, 3, 3)


def test_lexical_lift(spark, index):
    q = query(spark, [0.8, 0.6], [(1, "teapot", 1.0)])
    top = retrieval.retrieve(q, *index, lexical_weight=0.9).orderBy("rank").first()
    assert (top.icon_id, top.prior, top.probability) == (57, 1.0, 1.0)


def test_empty_label_matches_every_icon_and_last_duplicate_wins(spark, index):
    rows = retrieval.retrieve(query(spark, [1.0], [(7, "", 0.5)]), index[0], probes=None).collect()
    assert {r.prior for r in rows} == {0.5}
    rows = retrieval.retrieve(query(spark, [1.0], [(0, "zzz", 0.9), (0, "zzz", 0.2)]), index[0], probes=None).collect()
    assert {r.icon_id: r.prior for r in rows} == {41: 0.2, 57: 0.0, 63: 0.0}


def test_described(spark, index):
    classes = spark.createDataFrame(CLASSES, "idx int, label string")
    hits = retrieval.retrieve(query(spark, [1.0]), *index, probes=1, lexical_weight=0)
    rows = retrieval.described(hits, classes, "owner/repo", "a" * 40).orderBy("rank").collect()
    assert [(r.category, r.pack, r.name, r.label, r.aux_label) for r in rows][0] == ("Home & Kitchen", "brass", "7-kettle", "kettle", "kettle")
    assert rows[0].url == f"https://cdn.jsdelivr.net/gh/owner/repo@{'a' * 40}/Home%20%26%20Kitchen/brass/7-kettle.svg"
    with pytest.raises(Exception, match="malformed icon"):
        retrieval.described(hits.withColumn("path", F.lit("Sports/../up.svg")), classes).collect()


@pytest.mark.parametrize("weight", [0.0, 0.25, 1.0])
def test_bounded_is_the_head_of_the_full_ranking(spark, weight):
    rng = np.random.Generator(np.random.PCG64(31))
    draw = lambda: [float(x) for x in rng.normal(size=DIM)]
    rows = [(i % 5, 3 * i, f"tools/set/{('kettle', 'ladle', 'oar')[i % 3]}-{i}.svg", 1 + i % 2, i % 4, draw()) for i in range(250)]
    items = spark.createDataFrame(rows, "shard int, icon_id long, path string, duplicates int, aux_class int, v array<float>")
    items = items.withColumn("q", vectors.quantize(F.col("v"))).select("shard", "icon_id", "path", "duplicates", "aux_class", "q.codes", "q.scale")
    q = query(spark, draw(), [(2, "ladle", 0.6), (3, "oar", 0.35)])
    full = [(r.icon_id, r.score) for r in retrieval.retrieve(q, items, probes=None, limit=None, lexical_weight=weight).orderBy("rank").collect()]
    head = [(r.icon_id, r.score) for r in retrieval.retrieve(q, items.repartition(7), probes=None, limit=12, lexical_weight=weight).orderBy("rank").collect()]
    assert head == full[:12] and len(full) == 250


def test_bad_arguments(spark, index):
    for bad in ({"limit": 0}, {"probes": 0}, {"lexical_weight": 1.5}):
        with pytest.raises(ValueError):
            retrieval.retrieve(query(spark, [1.0]), *index, **bad)


def test_index_problems(spark, index):
    bad = index[0].withColumn("path", F.when(F.col("icon_id") == 63, F.lit("x.svg")).otherwise(F.col("path"))).withColumn("aux_class", F.when(F.col("icon_id") == 41, F.lit(9)).otherwise(F.col("aux_class")))
    assert {(r.problem, r.rows) for r in retrieval.validate_index(bad, DIM, 3).collect()} == {("path", 1), ("class", 1)}


def test_index_round_trip_prunes_shards(spark, tmp_path):
    items = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("icon_id"), F.lit("a/b.svg").alias("path"), F.lit(1).alias("duplicates"), F.col("label").alias("aux_class"), "embedding")
    stored, centers = clustering.build_index(items, k=8, iterations=5)
    clustering.write_index(stored, centers, str(tmp_path))
    read, c = files.read_index(spark, str(tmp_path))
    q = items.where("icon_id % 50 = 0").select(F.col("icon_id").alias("qid"), "embedding")
    every = retrieval.retrieve(q, read, c, probes=8, lexical_weight=0)
    warm = retrieval.retrieve(q, read, probes=None, lexical_weight=0)
    key = lambda df: sorted((r.qid, r.rank, r.icon_id) for r in df.collect())
    assert key(every) == key(warm)
    best = {r.qid: r.icon_id for r in retrieval.retrieve(q, read, c, probes=1, lexical_weight=0).where("rank = 1").collect()}
    assert all(k == v for k, v in best.items())
    plan = retrieval.retrieve(q, read, c, probes=1, lexical_weight=0)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan.lower()


def test_kmeans_invariants(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    centers = clustering.fit(items, k=5, iterations=25)
    again = clustering.fit(items.repartition(3), k=5, iterations=25)
    rows = {r.cluster: r.c for r in centers.collect()}
    assert all(abs(sum(x * x for x in c) - 1) < 1e-9 for c in rows.values()) and len(rows) == 5
    assert all(max(abs(a - b) for a, b in zip(r.c, rows[r.cluster])) < 1e-6 for r in again.collect())
    assigned = clustering.assign(items, centers).collect()
    assert len(assigned) == items.count()
    for r in assigned:
        assert r.similarity >= max(sum(a * b for a, b in zip(r.v, c)) for c in rows.values()) - 1e-9
    lone = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "cluster int, c array<double>")
    one = clustering.assign(spark.createDataFrame([(1, [2.0, 0.1])], "id int, v array<float>"), lone)
    kept = {r.cluster: r.c for r in clustering.lloyd_step(one, lone).collect()}
    assert kept[1] == [0.0, 1.0] and abs(kept[0][0] - 0.9987523) < 1e-6
    assert clustering.fit(items.where("false")).count() == 0


def test_pairs_in_blocks(spark, index):
    stated = spark.range(50).select(F.col("id").alias("qid"))
    for most in (7, 1000):
        pairs = retrieval.paired(index[0].select("icon_id"), stated, "qid", most)
        assert pairs.distinct().count() == pairs.count() == 150 and "CartesianProduct" not in pairs._jdf.queryExecution().toString()


def test_shard_files_are_verified(spark, tmp_path):
    import hashlib

    blob = files.pack_shard(np.arange(6, dtype=np.int8).reshape(2, 3), np.array([0.5, 2.0], np.float32))
    (tmp_path / "shard-4.bin").write_bytes(blob)
    listed = lambda size, digest: spark.createDataFrame([(4, 2, size, digest)], "shard int, count int, bytes long, sha256 string")
    good = hashlib.sha256(blob).hexdigest()
    got = files.verified_shards(spark, str(tmp_path), listed(len(blob), good), 3).orderBy("row").collect()
    assert [(r.row, list(r.codes), r.scale) for r in got] == [(0, [0, 1, 2], 0.5), (1, [3, 4, 5], 2.0)]
    for bad, message in ((listed(len(blob), "0" * 64), "another digest"), (listed(9, good), "unexpected size"), (listed(len(blob), good).withColumn("shard", F.lit(5)), "missing")):
        with pytest.raises(Exception, match=message):
            files.verified_shards(spark, str(tmp_path), bad, 3).collect()


def test_a_class_without_candidates_stops_the_plan(spark):
    from inkfold.operators import dataset

    classes = spark.createDataFrame([(0, "kettle"), (1, "canoe")], "class_index int, class_name string")
    candidates = spark.createDataFrame([("kettle", 41, "a/b.svg"), ("kettle", 57, "a/c.svg")], "class_name string, icon_id long, path string")
    digests = spark.createDataFrame([(41, "d"), (57, None)], "icon_id long, digest string")
    assert [tuple(r) for r in dataset.planned_icons(classes.where("class_index = 0"), candidates, digests).collect()] == [(0, "kettle", 41, "a/b.svg", "d")]
    with pytest.raises(Exception, match="no candidates for class canoe"):
        dataset.planned_icons(classes, candidates, digests).collect()
