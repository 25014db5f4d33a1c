"""Every query against its SQL at the smallest scale, and shape checks of those without."""

import pytest

from inkfold.plans import catalog

from .oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, SF, catalog.QUERIES[name], catalog.SQL[name])


def test_index_build_covers_every_vector(spark):
    rows = catalog.QUERIES["index_build"](spark, SF).collect()
    assert sum(r["count"] for r in rows) == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert {r.dim for r in rows} == {64} and len(rows) == 16


def test_svg_queries(spark):
    rows = {r.id: r for r in catalog.QUERIES["svg_rasters"](spark, SF).collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count()
    for i, r in rows.items():
        assert r.status == {4: 2, 5: 1}.get(i % 6, r.status) and r.status in (0, 1, 2, 3) and (r.digest is not None) == (r.status == 0)


def test_probes_find_nine_of_ten_neighbours(spark):
    sf = "/root/testdata/sf0.01"
    found = {(r.qid, r.icon_id) for r in catalog.QUERIES["ivf_retrieve"](spark, sf).collect()}
    true = {(r.qid, r.icon_id) for r in catalog.QUERIES["vector_topk_exhaustive"](spark, sf).collect()}
    assert len(found & true) >= 0.9 * len(true)


def test_a_quarter_of_the_shards_finds_nine_of_ten(spark):
    sf = "/root/testdata/sf0.01"
    found = {(r.qid, r.icon_id) for r in catalog.QUERIES["index_probed_letters"](spark, sf).collect()}
    true = {(r.qid, r.icon_id) for r in catalog.QUERIES["index_exact_letters"](spark, sf).collect()}
    assert len(found & true) >= 0.9 * len(true)
    read = catalog.QUERIES["index_shards_read"](spark, sf).collect()
    assert len(read) * 12 == len(true) and sum(r.read for r in read) < 0.5 * sum(r.shards for r in read)


def test_fingerprint_ignores_row_order(spark):
    from inkfold.operators.dedup import table_fingerprint

    nation = spark.read.parquet(f"{SF}/nation.parquet")
    a = table_fingerprint(nation, "n_nationkey", "n_name").first()
    assert a == table_fingerprint(nation.orderBy("n_name", ascending=False).repartition(3), "n_nationkey", "n_name").first()
    assert a != table_fingerprint(nation.where("n_nationkey > 0"), "n_nationkey", "n_name").first()


def test_drawings_to_ranked_classes(spark):
    import numpy as np

    from inkfold.functions import raster, strokes

    lines = strokes.polylines(strokes.decode_stroke3(catalog._strokes(spark, SF))).collect()
    got = {r.id: r for r in catalog.QUERIES["drawing_predictions"](spark, SF).collect()}
    assert len(got) == len(lines)
    for r in lines:
        if r.drawing_id % 9 == 0:
            assert not got[r.drawing_id].embedded and got[r.drawing_id].classes == []
            continue
        bitmap = raster.rasterize([[(p.x, p.y) for p in line] for line in r.polylines])
        logits = catalog.block_encoder(np.frombuffer(bitmap, np.uint8).reshape(1, 64, 64) / 255.0)[1][0].astype(np.float32)
        assert got[r.drawing_id].embedded and got[r.drawing_id].classes == sorted(range(10), key=lambda i: (-logits[i], i))[:5]
