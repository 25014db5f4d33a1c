"""Archives of drawings, and the published form of an index."""

import gzip
import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.operators import clustering, retrieval
from inkfold.sources import icon_index, npz


class Stranger:
    def __reduce__(self):
        return print, ("never called",)


def drawings(lengths, seed):
    rng = np.random.Generator(np.random.PCG64(seed))
    out = np.empty(len(lengths), object)
    for i, n in enumerate(lengths):
        out[i] = rng.integers(-300, 300, (n, 3)).astype(np.int16)
    return out


def saved(folder, name, **arrays):
    np.savez_compressed(folder / name, **arrays)
    content = (folder / name).read_bytes()
    return {"bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}


@pytest.fixture
def archives(tmp_path):
    arrays = {"owl.npz": {"train": drawings([3, 1, 7, 2, 5], 1), "valid": drawings([4], 2), "test": drawings([2, 2], 3)}, "fig.npz": {"train": drawings([6, 2], 4), "valid": drawings([], 5), "test": drawings([1], 6)}}
    return tmp_path, arrays, {name: saved(tmp_path, name, **a) for name, a in arrays.items()}


def test_archives_are_read_in_ranges(spark, archives):
    folder, arrays, trusted = archives
    df = npz.read_npz(spark, str(folder), trusted, drawings=2)
    assert df.rdd.getNumPartitions() == 7  # 3 + 1 + 1 ranges of one archive, 1 + 0 + 1 of the other
    got = {(r.archive, r.split, r.drawing): [tuple(s) for s in r.strokes] for r in df.collect()}
    assert got == {(name, split, i): [tuple(s) for s in d.tolist()] for name, a in arrays.items() for split, ds in a.items() for i, d in enumerate(ds)}
    assert npz.read_npz(spark, "file:" + str(folder), trusted, splits=("valid",)).count() == 1
    assert npz.read_npz(spark, str(folder), {}).count() == 0


def test_untrusted_archives_are_refused(spark, archives):
    folder, _, trusted = archives
    for change, message in (({"sha256": "0" * 64}, "trusted"), ({"bytes": 3}, "trusted")):
        with pytest.raises(Exception, match=message):
            npz.read_npz(spark, str(folder), {"owl.npz": trusted["owl.npz"] | change}).collect()
    with pytest.raises(Exception, match="leaves the folder"):
        npz.read_npz(spark, str(folder / "deeper"), {"../owl.npz": trusted["owl.npz"]}).collect()
    one = lambda *items: np.array([*items, None], object)[:-1]
    cases = {"foreign": (one(Stranger()), "may not hold"), "wide": (one(np.ones((2, 4), np.int16)), "three 16-bit"), "long": (one(np.ones((2, 3), np.int64)), "three 16-bit"), "flat": (np.ones(3, np.int16), "array of drawings")}
    for name, (train, message) in cases.items():
        known = {f"{name}.npz": saved(folder, f"{name}.npz", train=train)}
        with pytest.raises(Exception, match=message):
            npz.read_npz(spark, str(folder), known, splits=("train",)).collect()


@pytest.fixture(scope="module")
def built(spark):
    items = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("icon_id"), F.concat(F.lit("tools/set é/"), F.col("vec_id"), F.lit(".svg")).alias("path"), F.lit(2).alias("duplicates"), F.col("label").alias("aux_class"), "embedding")
    return items, *clustering.build_index(items, k=8, iterations=4)


def published(spark, built, folder):
    _, stored, centers = built
    # a shard that no vector is in
    hole = centers.limit(1).select(F.lit(8).alias("shard"), "codes", "scale", F.lit(0).cast("long").alias("count"), "radius", "shortest", "longest")
    icon_index.publish(stored, centers.unionByName(hole), str(folder), "owner/icons", "b" * 40, [f"class {i}" for i in range(10)])


def test_index_round_trip_and_equal_bytes(spark, built, tmp_path):
    items, stored, centers = built
    published(spark, built, tmp_path / "one")
    icon_index.publish(stored.repartition(7), centers.unionByName(centers.limit(1).withColumn("shard", F.lit(8)).withColumn("count", F.lit(0).cast("long"))), str(tmp_path / "two"), "owner/icons", "b" * 40, [f"class {i}" for i in range(10)])
    names = sorted(p.name for p in (tmp_path / "one").iterdir())
    assert names == sorted(["index.json", *(f"shard-{i}.{end}" for i in range(9) for end in ("bin", "meta.json.gz"))])
    shard_files = [n for n in names if n != "index.json"]
    assert all((tmp_path / "one" / n).read_bytes() == (tmp_path / "two" / n).read_bytes() for n in shard_files)
    before = {n: (tmp_path / "one" / n).read_bytes() for n in names}
    published(spark, built, tmp_path / "one")  # again, over the old one
    assert before == {n: (tmp_path / "one" / n).read_bytes() for n in names} and sorted(p.name for p in tmp_path.iterdir()) == ["one", "two"]
    document = json.loads(before["index.json"])
    assert document["counts"]["vectors"] == items.count() == sum(s["count"] for s in document["shards"]) and document["shards"][8]["count"] == 0
    for s in document["shards"]:
        assert hashlib.sha256(before[f"shard-{s['id']}.bin"]).hexdigest() == s["sha256"] and len(before[f"shard-{s['id']}.meta.json.gz"]) == s["metaBytes"]
    meta = json.loads(gzip.decompress(before["shard-3.meta.json.gz"]))
    assert [i[0] for i in meta["icons"]] == sorted(i[0] for i in meta["icons"]) and meta["icons"][0][1].startswith("tools/set é/")
    vectors, coded = icon_index.read_published(spark, str(tmp_path / "one"))
    key = lambda df: sorted((r.shard, r.icon_id, r.path, r.duplicates, r.aux_class, tuple(r.codes), r.scale) for r in df.collect())
    assert key(vectors) == key(stored)
    assert sorted((r.shard, tuple(r.codes), r.scale, r["count"]) for r in coded.where("shard < 8").collect()) == sorted((r.shard, tuple(r.codes), r.scale, r["count"]) for r in centers.collect())
    asked = items.where("icon_id % 50 = 0").select(F.col("icon_id").alias("qid"), "embedding")
    hits = lambda v, c: sorted((r.qid, r.rank, r.icon_id, r.score) for r in retrieval.retrieve(asked, v, c, probes=2, lexical_weight=0).collect())
    assert hits(vectors, coded.where("shard < 8")) == hits(stored, centers)


def test_a_changed_file_or_document_is_refused(spark, built, tmp_path):
    folder = tmp_path / "index"
    published(spark, built, folder)
    read = lambda: icon_index.read_published(spark, str(folder))[0].collect()
    whole = (folder / "shard-2.bin").read_bytes()
    (folder / "shard-2.bin").write_bytes(whole[:-1] + bytes([whole[-1] ^ 1]))
    with pytest.raises(Exception, match="another digest"):
        read()
    (folder / "shard-2.bin").write_bytes(whole)
    meta = (folder / "shard-5.meta.json.gz").read_bytes()
    (folder / "shard-5.meta.json.gz").write_bytes(gzip.compress(gzip.decompress(meta), 1, mtime=7))
    with pytest.raises(Exception, match="other metadata"):
        read()
    (folder / "shard-5.meta.json.gz").write_bytes(meta)
    document = json.loads((folder / "index.json").read_text())
    changes = {"version": {"schemaVersion": 2}, "kind": {"kind": "else"}, "classes": {"classes": ["a", "a"]}, "clustering": {"shards": document["shards"][:-1]}, "vectors": {"embedding": document["embedding"] | {"metric": "cosine"}}}
    for what, change in changes.items():
        (folder / "index.json").write_text(json.dumps(document | change))
        with pytest.raises(Exception, match=f"unsound: {what}"):
            icon_index.read_document(spark, str(folder)).collect()


def test_a_failed_run_leaves_the_old_index(spark, built, tmp_path):
    folder = tmp_path / "index"
    published(spark, built, folder)
    before = {p.name: p.read_bytes() for p in folder.iterdir()}
    _, stored, centers = built
    bad = stored.withColumn("path", F.when(F.col("icon_id") == 7, F.lit("../away.svg")).otherwise(F.col("path")))
    with pytest.raises(Exception, match="malformed icon"):
        icon_index.publish(bad, centers, str(folder), "owner/icons", "b" * 40, ["x"])
    assert before == {p.name: p.read_bytes() for p in folder.iterdir()} and [p.name for p in tmp_path.iterdir()] == ["index"]
