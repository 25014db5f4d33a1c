"""Numbers, sums, posting lists and rankings that are put together from parts, against the plain way."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions import strokes, vectors
from inkfold.operators import lexical, numbering, retrieval
from inkfold.streaming import folds


def test_numbers_in_an_order(spark):
    r = random.Random(1)
    rows = [(r.choice([None, "b", "a", "é", ""]), r.randint(0, 5), i) for i in range(400)]
    df = spark.createDataFrame(rows, "s string, n int, id int").repartition(6)
    out = numbering.numbered(df, [F.col("n").desc(), "s", "id"], "at")
    assert [c.lower() for c in out.columns] == ["s", "n", "id", "at"] and "No Partition" not in out._jdf.queryExecution().toString()
    got = [r.id for r in sorted(out.collect(), key=lambda r: r["at"])]
    assert got == [i for _, _, i in sorted(rows, key=lambda x: (-x[1], x[0] is not None, (x[0] or "").encode(), x[2]))]
    assert sorted(r["at"] for r in out.collect()) == list(range(400))
    assert numbering.numbered(df.where("false"), ["id"]).count() == 0
    plan = lexical.dictionary(df.where("s is not null"), "s", "id")._jdf.queryExecution().toString()
    assert "Window" not in plan


@pytest.mark.parametrize("block", [1, 7, 64, 10_000])
def test_sums_of_long_drawings(spark, block):
    rng = np.random.Generator(np.random.PCG64(3))
    rows = [(d, int(s), int(x), int(y), int(p)) for d, n in ((0, 300), (1, 1), (2, 65)) for s, (x, y, p) in zip(np.sort(rng.choice(900, n, replace=False)), zip(rng.integers(-9, 9, n), rng.integers(-9, 9, n), rng.integers(0, 2, n)))]
    df = spark.createDataFrame(rows, "drawing_id int, seq int, dx int, dy int, pen int").repartition(3)
    key = lambda out: sorted((r.drawing_id, r.seq, r.x, r.y, r.polyline) for r in out.collect())
    assert key(strokes.decode_long_stroke3(df, block=block)) == key(strokes.decode_stroke3(df))


def test_bitmaps_of_posting_lists(spark):
    """A token that all icons have, rare ones, ids at the edges of buckets, and phrases that match nothing."""
    r = random.Random(4)
    size = lexical.BITMAP_IDS
    ids = [0, 1, size - 1, size, 2 * size - 1, 2 * size, 10**10, *r.sample(range(3 * size), 400)]
    tokens = {i: ["all", *r.sample(["red", "ring", "owl", "fig"], r.randint(0, 3)), *(["rare"] if i == size else [])] for i in ids}
    icons = spark.createDataFrame(list(tokens.items()), "icon_id long, tokens array<string>")
    phrases = [("a", 0, ["all"]), ("a", 1, ["all", "red", "ring"]), ("b", 0, ["rare", "all"]), ("b", 1, ["rare", "none"]), ("c", 0, []), ("c", 1, ["owl", "owl"]), ("c", 2, ["none"])]
    asked = spark.createDataFrame(phrases, "class string, phrase_index int, tokens array<string>")
    got = sorted(map(tuple, lexical.match_bitmaps(asked, lexical.posting_bitmaps(icons)).collect()))
    assert got == sorted((c, n, i) for c, n, wanted in phrases for i, own in tokens.items() if wanted and set(wanted) <= set(own))
    assert got == sorted(map(tuple, lexical.match_phrases(asked, lexical.postings(icons)).collect()))
    # the hot token is three rows for 400 icons and more, of 4 KB each
    hot = lexical.posting_bitmaps(icons).where("token = 'all'").collect()
    assert len(hot) == 4 and all(len(b.bits) == 4096 for b in hot)


def test_ranking_grows_with_the_resident_shards(spark, tmp_path):
    rng = np.random.Generator(np.random.PCG64(6))
    rows = [(i % 4, i, f"tools/set/{i}.svg", 1, i % 3, [float(x) for x in rng.normal(size=8)]) for i in range(200)]
    items = spark.createDataFrame(rows, "shard int, icon_id long, path string, duplicates int, aux_class int, v array<float>").withColumn("q", vectors.quantize(F.col("v")))
    items = items.select("shard", "icon_id", "path", "duplicates", "aux_class", "q.codes", "q.scale")
    asked = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=8)], [(1, "set", 0.4)]) for i in range(3)], "qid int, embedding array<float>, predictions array<struct<class_index:int,label:string,probability:double>>")
    state, source = str(tmp_path / "state"), str(tmp_path / "in")
    key = lambda df: sorted((r.qid, r.rank, r.icon_id, r.score) for r in df.collect())
    so_far = set()
    for number, shards in enumerate([[2], [0, 2], [], [3, 1, 0]]):
        spark.createDataFrame([(s,) for s in shards], "shard int").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("shard int").parquet(source)
        folds.warming_top_k(stream, asked, items, state, str(tmp_path / "check"), limit=7).trigger(availableNow=True).start().awaitTermination()
        so_far |= set(shards)
        version = max(int(p.name.split("=")[1]) for p in (tmp_path / "state" / "hits").iterdir() if p.is_dir())
        hits = spark.read.parquet(f"{state}/hits/version={version}")
        whole = retrieval.retrieve(asked, items.where(F.col("shard").isin(list(so_far))), probes=None, limit=7)
        assert key(hits) == key(whole) and len(key(hits)) == 21
        assert {r.shard for r in spark.read.parquet(f"{state}/shards/version={version}").collect()} == so_far
