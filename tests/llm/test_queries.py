"""The queries against their SQL, and those without SQL against plain versions, on the smallest tables."""

import collections
import hashlib
import math
import re
import statistics
import zlib

import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from inkfold.llm import queries

from ..oracle import compare
from . import brute
from .test_cases import EXTRA, ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    compare(spark, SF, queries.QUERIES[name], queries.SQL[name])


def documents(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_near_dup_equals_all_pairs(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op1_near_dup(spark, SF).collect()}
    assert got == brute.near_dup([(d["doc_id"], d["text"]) for d in documents(spark)])[0]


def test_substring_dedup_equals_brute(spark):
    got = sorted(tuple(r) for r in queries.op9_substring_dedup(spark, SF).collect())
    assert got == sorted(brute.substring_dedup([(d["doc_id"], d["text"]) for d in documents(spark)]))


def test_sharding(spark):
    rows = queries.op6_sharding(spark, SF).collect()
    texts = {d["doc_id"]: d["text"] for d in documents(spark)}
    slots = collections.defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        key = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:16], 16)
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (brute.jump(key, 8), brute.jump(key, 9)) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mixing_comes_near_its_targets(spark):
    rows = queries.op2_mixing(spark, SF).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.target, r.source_size].append(r)
    for (target, _), docs in by.items():
        assert abs(sum(r.taken for r in docs) - target) <= max(r.size for r in docs) / 2 + 1
    assert all(r.taken <= 2 * r.size for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, queries.op2_mixing(spark, SF).collect()))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_toxicity(spark, sf).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    pairs = [(a > b) + (a == b) / 2 for a, x in held for b, y in held if x == 1 and y == 0]
    assert statistics.mean(pairs) > 0.8


def test_decontamination_equals_brute(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {r.doc_id: r for r in queries.op4_decontamination(spark, SF).collect()}
    docs = [(d["doc_id"], d["text"]) for d in documents(spark)]
    expected = brute.contaminated(docs, items)
    for (i, _), found in zip(docs, expected):
        assert (rows[i].contaminated, rows[i].n_items, rows[i].item_ids or []) == (bool(found), len(found), [x for x, _ in found])
        assert math.isclose(rows[i].coverage, max((c for _, c in found), default=0.0))
    assert 0 < sum(map(bool, expected)) < 0.2 * len(docs)


def test_kneser_ney_tells_junk(spark):
    sf = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in queries.op5_kneser_ney(spark, sf).collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = [kept[i] for i, q in quality.items() if q == 1], [kept[i] for i, q in quality.items() if q == 0]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.4


def test_surrogates_equal_brute(spark):
    texts = {d["doc_id"]: d["text"] for d in documents(spark)}
    rows = queries.op3_pii_surrogates(spark, SF).collect()
    expected = brute.surrogates([texts[r.doc_id] for r in rows], "a key of the deployment's own")
    assert [(r.text, r.n_entities) for r in rows] == expected and sum(n > 0 for _, n in expected) > 5


def test_url_rules_and_models(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    rows = queries.op10_url_filter(spark, sf).collect()
    ruled = []
    for r in rows:
        host, path = brute.host_path(urls[r.page_id])
        rule, verdict = brute.rule(host, path, queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if rule:
            assert r.verdict == verdict
        ruled.append((urls[r.page_id] or "", verdict))
    expected = brute.url_model(ruled)
    for r in rows:
        if r.rule is None:
            score, threshold = expected[urls[r.page_id] or ""]
            assert math.isclose(r.score, score, abs_tol=2e-6) and math.isclose(r.threshold, threshold, abs_tol=2e-6)
            assert r.verdict == ("block" if r.score < r.threshold else "allow")


def test_pipeline_equals_its_stages(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = documents(spark)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    good = [d for d in docs if not brute.base_failed(d["text"])]
    components = brute.near_dup([(d["doc_id"], d["text"]) for d in good])[0]
    one = [d for d in good if components[d["doc_id"]][1] == d["doc_id"]]
    clean = {d["doc_id"]: d for d in one if not any(i in d["text"] for i in items)}
    assert {r.doc_id for r in rows} <= set(clean)
    copies = collections.Counter(r.doc_id for r in rows)
    expected = brute.mix([(d["doc_id"], d["source"], d["text"]) for d in clean.values()])
    assert copies == collections.Counter({i: n for i, n in expected.items() if n})
    assert all(r.text == clean[r.doc_id]["text"] for r in rows)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]


def test_pipeline_cases(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns through all stages; then no rows at all."""
    rare = [(20, "x" * 200_000 + " and a word", "en", "a", 1), (21, None, "en", None, None), (2**62, " ".join(f"w{i}" for i in range(40)), None, None, None)]
    docs = spark.createDataFrame(ROWS + rare, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA})
    items = spark.createDataFrame([(1, "no document has these eight words of a benchmark question"), (2, None), (None, "")], "item_id long, text string")
    docs.write.parquet(str(tmp_path / "some" / "documents.parquet"))
    items.write.parquet(str(tmp_path / "some" / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path / "some"))
    assert {"doc_id", "text", "lang", "source", "n_chars", "shard", "slot"} <= {c.lower() for c in out.columns}
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.select("doc_id", "text", "source", "pii ents", "slot", "shard").collect()
    texts = collections.defaultdict(set)
    for i, t, *_ in ROWS + rare:
        texts[i].add(t)
    assert all(r.text in texts[r.doc_id] and r["pii ents"] == "clash" and 0 <= r.shard < 8 for r in rows)
    # rejected: short texts, one of repeated words; near copies and repeated rows are one
    good = [(i, t) for i, t, *_ in ROWS + rare if not brute.base_failed(t)]
    assert {r.doc_id for r in rows} <= {i for i, _ in good} and not {1, 8, 20, 21} & {r.doc_id for r in rows}
    copies = collections.Counter(r.doc_id for r in rows)
    assert 0 < max(n for i, n in copies.items() if i is not None) <= 2
    # columns of any name come out as they went in, but for those that sharding adds
    new = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    for c in [c for c in EXTRA if c.lower() not in new]:
        assert {r[0] for r in out.select(F.col(f"`{c}`")).distinct().collect()} == {"clash"}, c
    for name in ("documents", "benchmark"):
        spark.read.parquet(str(tmp_path / "some" / f"{name}.parquet")).where("false").write.parquet(str(tmp_path / "none" / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_keeps_columns_of_any_name(spark, tmp_path):
    odd = ["meta.url", "kept", "taken", "n_words", "a`b", "TEXT_", "in 0", "shard"]
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.concat(F.lit(c), F.coalesce("source", F.lit("-"))) for c in odd})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "no document has these eight words of a benchmark question")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for step, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = spark.read.parquet(str(tmp_path / (f"{step - 1}" if step else "documents.parquet")))
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns or name == "sharding"
        out.write.parquet(str(tmp_path / f"{step}"))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert [c for c in rows.columns if c in odd] == odd and rows.count() > 2
    for r in rows.collect():
        assert all(r[c] == c + (r.source or "-") for c in odd[:-1]) and isinstance(r.shard, int)
