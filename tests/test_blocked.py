"""Blocked top-k, exact retrieval through an index, and seeding, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions import vectors
from inkfold.operators import blocked, clustering, metrics, retrieval


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def plain_top(queries, items, k):
    """(qid, id, score) by (score descending, id), products summed axis by axis."""
    out = []
    for qid, q in queries:
        scored = []
        for i, v in items:
            total = 0.0
            for a, b in zip(v, q):
                total += float(np.float32(a)) * float(np.float32(b))
            scored.append((-total, i))
        out += [(qid, i, -s) for s, i in sorted(scored)[:k]]
    return sorted(out)


def test_ties_blocks_and_groups_of_queries(spark, monkeypatch):
    """Over several blocks of vectors, with many equal ones, and queries in several groups of broadcast blocks."""
    monkeypatch.setattr(blocked, "BLOCK_QUERIES", 16)
    monkeypatch.setattr(blocked, "MOST_BYTES", 3 * 16 * 6 * 4)
    rng = np.random.Generator(np.random.PCG64(1))
    items = [(i, [float(x) for x in rng.integers(-3, 4, 6)]) for i in rng.permutation(5000).tolist()]
    items += [(i, [2.0] * 6) for i in range(5000, 7000)]
    queries = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(90)] + [(90, [1.0] * 6)]
    df = table(spark, items, "icon_id long, embedding array<float>").repartition(3)
    asked = table(spark, [(q, [float(np.float32(x)) for x in v]) for q, v in queries], "qid int, embedding array<float>")
    hits = retrieval.exhaustive(asked, df, 7)
    assert "NestedLoop" not in hits._jdf.queryExecution().toString() and "Cartesian" not in hits._jdf.queryExecution().toString()
    rows = hits.collect()
    assert sorted((r.qid, r.icon_id, r.score) for r in rows) == plain_top(queries, items, 7)
    assert [r.rank for r in sorted(rows, key=lambda r: (r.qid, r.rank))] == list(range(1, 8)) * 91


def test_null_empty_and_uneven_vectors(spark):
    items = table(spark, [(1, [1.0, 0.0]), (2, None), (3, [0.0, 1.0]), (None, [1.0, 0.0])], "icon_id long, embedding array<float>")
    asked = table(spark, [(1, [1.0, 0.5]), (2, None)], "qid int, embedding array<float>")
    rows = retrieval.exhaustive(asked, items, 5).orderBy("rank").collect()
    assert [(r.qid, r.icon_id) for r in rows] == [(1, None), (1, 1), (1, 3)]
    assert retrieval.exhaustive(asked.where("qid = 9"), items, 5).collect() == []
    assert retrieval.exhaustive(asked, items.where("icon_id = 9"), 5).collect() == []
    with pytest.raises(Exception, match="different lengths"):
        retrieval.exhaustive(asked, items.unionByName(table(spark, [(4, [1.0])], "icon_id long, embedding array<float>")).coalesce(1), 5).collect()


def icons(spark, vecs, names=("kettle", "ladle", "oar")):
    rows = [(i, f"tools/set/{names[i % len(names)]}-{i}.svg", 1, i % 5, [float(x) for x in v]) for i, v in enumerate(vecs)]
    return table(spark, rows, "icon_id long, path string, duplicates int, aux_class int, embedding array<float>")


def clustered(n, centers, spread, seed, dim=16):
    rng = np.random.Generator(np.random.PCG64(seed))
    c = rng.normal(size=(centers, dim))
    v = c[rng.integers(0, centers, n)] + spread * rng.normal(size=(n, dim))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("weight", [0.0, 0.25, 1.0])
def test_hybrid_over_blocks_is_the_head_of_all_pairs(spark, weight):
    items = icons(spark, clustered(5000, 9, 0.5, 2, 8)).withColumn("q", vectors.quantize(F.col("embedding"))).select("icon_id", "path", "duplicates", "aux_class", "q.codes", "q.scale", (F.col("icon_id") % 7).cast("int").alias("shard"))
    kind = "qid int, embedding array<float>, predictions array<struct<class_index:int,label:string,probability:double>>"
    likes = [[(2, "ladle", 0.6), (3, "oar", 0.35), (2, "set ladle", 0.1)], [], [(1, None, 0.2)], None]
    asked = table(spark, [(i, [float(x) for x in v], likes[i % 4]) for i, v in enumerate(clustered(8, 9, 0.5, 3, 8))], kind)
    head = {tuple(r) for r in retrieval.retrieve(asked, items.repartition(3), probes=None, limit=9, lexical_weight=weight).select("qid", "rank", "icon_id", "score", "cosine", "prior", "probability", "path").collect()}
    full = retrieval.retrieve(asked, items, probes=None, limit=None, lexical_weight=weight).where("rank <= 9").select("qid", "rank", "icon_id", "score", "cosine", "prior", "probability", "path")
    whole = {tuple(r) for r in full.collect() if r.qid % 4 != 3}
    assert {r for r in head if r[0] % 4 != 3} == whole and len(head) == 72


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    """An index of 6,000 vectors in 60 clumps, as stored, and 40 queries near them."""
    from inkfold.sources import files

    items = icons(spark, clustered(6000, 60, 0.08, 5))
    stored, centers = clustering.build_index(items, k=48, iterations=12)
    path = str(tmp_path_factory.mktemp("index"))
    clustering.write_index(stored, centers, path)
    asked = items.where("icon_id % 150 = 0").select(F.col("icon_id").alias("qid"), "embedding")
    return (*files.read_index(spark, path), asked)


def key(df):
    return sorted((r.qid, r.rank, r.icon_id, r.score) for r in df.collect())


def test_exact_through_the_index_reads_few_shards(spark, index):
    stored, centers, asked = index
    hits, read = retrieval.retrieve_exact(asked, stored, centers, 12)
    assert key(hits) == key(retrieval.retrieve(asked, stored, probes=None, lexical_weight=0))
    share = read.count() / (asked.count() * centers.where("count > 0").count())
    assert read.distinct().count() == read.count() and share < 0.3
    # so many hits that the first shards cannot hold them: all shards are read
    hits, read = retrieval.retrieve_exact(asked.limit(2), stored, centers, 5990)
    assert hits.count() == 2 * 5990 and read.count() == 2 * centers.where("count > 0").count()


def test_few_probes_find_nine_of_ten(spark, index):
    stored, centers, asked = index
    few = {(r.qid, r.icon_id) for r in retrieval.retrieve(asked, stored, centers, probes=12, lexical_weight=0).collect()}
    true = {(r.qid, r.icon_id) for r in retrieval.retrieve(asked, stored, probes=None, lexical_weight=0).collect()}
    assert len(few & true) >= 0.9 * len(true)


def test_exact_hybrid_through_the_index(spark, index):
    stored, centers, asked = index
    likes = F.array(F.struct((F.col("qid") % 5).cast("int").alias("class_index"), F.lit("oar").alias("label"), F.lit(0.7).alias("probability")))
    asked = asked.withColumn("predictions", likes)
    hits, _ = retrieval.retrieve_exact(asked, stored, centers, 12, lexical_weight=0.3)
    assert key(hits) == key(retrieval.retrieve(asked, stored, probes=None, lexical_weight=0.3))


def test_bounds_hold_for_every_vector(spark, index):
    stored, centers, _ = index
    rows = {r.shard: r for r in centers.collect()}
    for r in stored.collect():
        c, v = rows[r.shard], np.array(r.codes, float) * r.scale
        d = np.array(c.codes, float) * c.scale
        angle = np.arccos(np.clip(v @ d / np.linalg.norm(v) / np.linalg.norm(d), -1, 1))
        assert angle <= c.radius + 1e-9 and c.shortest - 1e-12 <= np.linalg.norm(v) <= c.longest + 1e-12


def likeness(v, centers):
    return float((v @ centers.T).max(axis=1).sum())


def plus_plus(v, k, rng):
    at = [int(rng.integers(len(v)))]
    far = np.maximum(1 - v @ v[at[0]], 0)
    while len(at) < k:
        at.append(int(rng.choice(len(v), p=far / far.sum())))
        far = np.minimum(far, np.maximum(1 - v @ v[at[-1]], 0))
    return v[at]


def lloyd(v, centers, steps):
    for _ in range(steps):
        near, sums = (v @ centers.T).argmax(axis=1), np.zeros_like(centers)
        np.add.at(sums, near, v)
        size = np.linalg.norm(sums, axis=1)
        centers = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centers)
    return centers


def test_seeds_are_as_good_as_those_of_one_machine(spark):
    v = np.array([[float(np.float32(x)) for x in row] for row in clustered(4000, 25, 0.25, 9)])
    df = table(spark, [(i, [float(x) for x in row]) for i, row in enumerate(v)], "id long, v array<float>").repartition(5)
    ours = clustering.seeds(df, 25, seed=4)
    again = clustering.seeds(df.repartition(2), 25, seed=4)
    assert ours.shape == (25, 16) and np.allclose(ours, again)
    loss = lambda c: len(v) - likeness(v, c)
    plain = np.median([loss(lloyd(v, plus_plus(v, 25, np.random.Generator(np.random.PCG64(s))), 8)) for s in range(5)])
    assert loss(lloyd(v, ours, 8)) <= 1.05 * plain
    assert clustering.seeds(df.where("id < 3"), 25).shape[0] == 3
    same = table(spark, [(i, [1.0, 0.0]) for i in range(9)], "id long, v array<float>")
    assert clustering.seeds(same, 4).shape == (1, 2)


def test_own_row_is_left_out(spark):
    rows = [(i, i % 3, [float(x) for x in v]) for i, v in enumerate(clustered(50, 4, 0.3, 1))]
    items = table(spark, rows, "item_id long, label int, v array<float>")
    asked = items.select(F.col("item_id").alias("qid"), "label", "v").where("qid < 20")
    got = metrics.nearest_first(asked, items, 4, own=False).collect()
    plain = plain_top([(i, v) for i, _, v in rows[:20]], [(i, v) for i, _, v in rows], 50)
    expected = {}
    for qid, i, s in sorted(plain, key=lambda x: (x[0], -x[2], x[1])):
        if i != qid and len(expected.setdefault(qid, [])) < 4:
            expected[qid].append(i)
    assert {q: [r.item_id for r in sorted((x for x in got if x.qid == q), key=lambda r: r.rank)] for q in range(20)} == expected
    assert all(r.label_match == (r.qid % 3 == r.item_id % 3) for r in got)
