"""Datasets, metrics, curation, sources, the encoder hook and streams."""

import io
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions import vectors
from inkfold.operators import curation, dataset, dedup, encoder, metrics
from inkfold.sources import files
from inkfold.streaming import folds


def test_logit_ranking(spark):
    df = spark.createDataFrame([(0, [1.0, 3.0, 0.0]), (1, [1000.0, -1001.0, -1000.0])], "id int, logits array<double>")
    out = {r.id: [(p.class_index, p.probability) for p in r.p] for r in df.select("id", vectors.top_predictions(F.col("logits")).alias("p")).collect()}
    assert [c for c, _ in out[0]][:2] == [1, 0] and math.isclose(out[0][0][1], 0.8437947345, abs_tol=1e-9)
    assert out[1] == [(0, 1.0), (2, 0.0), (1, 0.0)]


def test_quantize(spark):
    df = spark.createDataFrame([(0, [0.5, -1.0, 0.25]), (1, [0.0, 0.0, 0.0]), (2, [127.0, 0.5, 2.5])], "id int, v array<float>")
    out = {r.id: (list(r.q.codes), r.q.scale) for r in df.select("id", vectors.quantize(F.col("v")).alias("q")).collect()}
    assert out[0][0] == [64, -127, 32] and out[1] == ([0, 0, 0], 1.0) and out[2][0] == [127, 0, 2]
    zero = df.where("id = 1").select(vectors.normalize(F.col("v")).alias("n"), vectors.is_unit(F.col("v")).alias("u")).first()
    assert zero.n == [0.0, 0.0, 0.0] and zero.u is False


def test_gate_names_the_weak_class(spark):
    per = spark.createDataFrame([("strong", 1.0), ("weak", 0.69)], "label string, accuracy double")
    assert tuple(metrics.gate(per, 0.7, 0.7).first())[1:] == (False, ["weak"])
    assert metrics.gate(per.where("label = 'strong'"), 0.7, 0.7).first().passed


def test_metrics_on_nothing(spark):
    rows = spark.createDataFrame([], "label int, logits array<double>")
    assert tuple(metrics.accuracy_report(rows).first()) == (0, 0.0, 0.0, 0.0)
    assert [tuple(r) for r in metrics.per_class_accuracy(rows, spark.createDataFrame([(3,)], "label int")).collect()] == [(3, 0, 0.0)]
    a, b = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double"), spark.createDataFrame([(1, 1.5)], "k int, v double")
    assert tuple(metrics.parity(a, b, "k", "v").first()) == (0.5, 2)


def test_split_profile_and_samples(spark):
    drawings = spark.createDataFrame([("train", 2), ("train", 3), ("valid", 2)], "split string, length int")
    splits = spark.createDataFrame([("train",), ("valid",), ("test",)], "split string")
    assert {tuple(r) for r in dataset.split_profile(drawings, splits).collect()} == {("train", 2, 2, 3), ("valid", 1, 2, 2), ("test", 0, 0, 0)}
    rows = spark.createDataFrame([(c, s, i) for c in (0, 1) for s, n in (("train", 3), ("valid", 2)) for i in range(n)], "c int, s string, i int")
    one = sorted(map(tuple, dataset.stratified_sample(rows, ["c", "s"], "i", 2, 17).collect()))
    assert one == sorted(map(tuple, dataset.stratified_sample(rows.repartition(5), ["c", "s"], "i", 2, 17).collect())) and len(one) == 8
    held = spark.createDataFrame([("a", i) for i in range(5)] + [("b", 0), ("b", 1), ("c", 0), ("c", 1), ("c", 2)], "k string, i int")
    count = {r.k: r.n for r in dataset.holdout(held, "k", "i", 2, 1).groupBy("k").agg(F.sum("split").alias("n")).collect()}
    assert count == {"a": 2, "b": 0, "c": 1}
    parts = spark.range(10).select(dataset.contiguous_part(F.col("id"), F.lit(10), 3).alias("p")).collect()
    assert [r.p for r in parts] == [next(j for j in range(3) if 10 * j // 3 <= i < 10 * (j + 1) // 3) for i in range(10)]
    assert [r.split for r in dataset.wrong_splits(spark.createDataFrame([("train", 70000), ("test", 3)], "split string, count int")).collect()] == ["test"]


#: Classes with the ids of their candidates.
OFFERED = {"anchor": [401, 57, 12], "The bell": [77], "comb": [3, 909], "dune": [5]}


def test_curation(spark):
    """A log in which people change their minds, against the same fold over dictionaries."""
    manifest = spark.createDataFrame([(c, i) for c, ids in OFFERED.items() for i in ids], "class string, candidate_id long")
    steps = [("comb", 3, "accepted"), ("anchor", 57, "rejected"), ("comb", 909, "rejected"), ("anchor", 57, "accepted"), ("comb", 3, None), ("The bell", 77, "accepted"), ("anchor", 12, "accepted"), ("anchor", 12, "rejected"), ("The bell", 77, "accepted")]
    log = spark.createDataFrame([(*step, seq) for seq, step in enumerate(steps)], "class string, candidate_id long, decision string, seq long").repartition(3)
    last = {(c, i): d for c, i, d in steps}
    kept = {k: d for k, d in last.items() if d}
    decisions, seen = curation.fold_decisions(log), ["The bell", "dune"]
    reviewed = spark.createDataFrame([(c,) for c in seen], "class string")
    assert {(r["class"], r.candidate_id): r.decision for r in decisions.collect()} == kept
    count = lambda word: sum(d == word for d in kept.values())
    assert tuple(curation.stats(manifest, decisions, reviewed).first()) == (len(OFFERED), len(seen), count("accepted"), count("rejected"))
    # accepted ones of any class, and reviewed classes that have none
    chosen = {(c, i) for (c, i), d in kept.items() if d == "accepted"}
    expected = chosen | {(c, None) for c in seen if c not in {x for x, _ in chosen}}
    assert {tuple(r) for r in curation.curated_export(manifest, decisions, reviewed).collect()} == expected == {("anchor", 57), ("The bell", 77), ("dune", None)}
    stray = spark.createDataFrame([("dune", 6, "accepted"), ("ewer", 5, "rejected"), ("dune", 5, "rejected")], "class string, candidate_id long, decision string")
    assert {(r["class"], r.candidate_id) for r in curation.orphans(stray, manifest).collect()} == {("dune", 6), ("ewer", 5)}
    forms = {"12": None, "012": "id", "-3": None, "-0": None, "": "id", None: "id", "1e3": "id", " 4": "id"}
    bad = spark.createDataFrame([(i, "rejected") for i in forms] + [("8", "perhaps"), ("8", None)], "i string, d string").select("i", "d", curation.decision_problem(F.col("i"), F.col("d")).alias("p")).collect()
    assert {r.i: r.p for r in bad if r.d == "rejected"} == forms and {r.p for r in bad if r.d != "rejected"} == {"decision"}
    percent = {r["class"]: r.percent for r in curation.progress(manifest, decisions).collect()}
    assert percent["The bell"] == 100 and percent["dune"] == 0 and 0 < percent["anchor"] < 100
    names = spark.createDataFrame([(["The zebra", "moth", "yak", "Ape"],)], "n array<string>")
    assert names.select(curation.locale_sorted(F.col("n")).alias("n")).first().n == ["Ape", "moth", "The zebra", "yak"]


def in_turns(guesses, ranked, limit=None, per_class=None):
    """One from each guessed class in the order of the guesses, then the next of each, no id twice."""
    lists = {label: ids[:per_class] for label, ids in ranked.items()}
    out = [lists[g][turn] for turn in range(max(map(len, lists.values()))) for g in dict.fromkeys(guesses) if turn < len(lists[g])]
    return list(dict.fromkeys(out))[:limit]


@pytest.mark.parametrize(("limit", "per_class"), [(None, None), (5, None), (None, 2), (4, 3)])
def test_interleave(spark, limit, per_class):
    ranked = {"oak": [700, 31, 8, 650], "fern": [44], "moss": [90, 12, 71]}
    candidates = spark.createDataFrame([(label, rank, i) for label, ids in ranked.items() for rank, i in enumerate(ids, 1)], "label string, rank int, id int")
    guesses = [("moss", 0.52), ("oak", 0.31), ("fern", 0.09), ("oak", 0.02)]
    asked = spark.createDataFrame([(1, pos, *g) for pos, g in enumerate(guesses)], "qid int, pos int, label string, probability double")
    bounds = {k: v for k, v in (("limit", limit), ("per_class", per_class)) if v}
    assert [r.id for r in curation.interleave(asked, candidates, **bounds).orderBy("place").collect()] == in_turns([g for g, _ in guesses], ranked, limit, per_class)


def test_interleave_leaves_out_what_it_cannot_rank(spark):
    candidates = spark.createDataFrame([("oak", 0, 700), ("oak", 1, 90), ("moss", 0, 90)], "label string, rank int, id int")
    asked = spark.createDataFrame([(1, 0, "moss", 0.5), (1, 1, "oak", 0.4)], "qid int, pos int, label string, probability double")
    assert [r.id for r in curation.interleave(asked, candidates).orderBy("place").collect()] == [90, 700]  # 90 comes once
    odd = spark.createDataFrame([(2, 0, "lichen", 0.3), (2, 1, "oak", float("nan")), (2, 2, "moss", 0.1)], "qid int, pos int, label string, probability double")
    assert {tuple(r) for r in curation.unknown_labels(odd, candidates).collect()} == {("lichen", "unknown label"), ("oak", "probability")}


def test_dedup_chain(spark):
    rows = spark.createDataFrame([(4, "x", "p"), (2, "x", "p"), (7, "y", "p"), (1, "z", "q"), (9, "w", None)], "id long, d string, b string")
    assert {tuple(r) for r in dedup.two_level(rows, "d", "b", "id").collect()} == {("p", 2, 3), ("q", 1, 1)}


def test_documents_lines_blobs_and_journal(spark, tmp_path):
    doc = {"schemaVersion": 1, "tokenizer": "t", "source": {"iconCount": 2}, "categories": ["A"], "packs": [["0", "p"]], "icons": [["0", "a.svg"], ["0", "b.svg"]], "tokens": {"a": [0], "b": [1]}}
    import gzip

    with gzip.open(tmp_path / "index.json.gz", "wt") as f:
        json.dump(doc, f)
    tables = files.token_tables(files.read_document(spark, str(tmp_path / "index.json.gz"), files.TOKEN_INDEX))
    assert [tuple(r) for r in tables["icon"].orderBy("icon_id").collect()] == [(0, 0, "a.svg"), (1, 0, "b.svg")] and tables["posting"].count() == 2
    (tmp_path / "old.json").write_text(json.dumps(doc | {"schemaVersion": 2}))
    with pytest.raises(Exception, match="schemaVersion"):
        files.read_document(spark, str(tmp_path / "old.json"), files.TOKEN_INDEX).collect()
    (tmp_path / "lines.txt").write_text(" cat \r\n\ndog\ncat\n  \n")
    assert [r.line for r in files.read_lines(spark, str(tmp_path / "lines.txt")).orderBy("position").collect()] == ["cat", "dog"]
    (tmp_path / "svg").mkdir()
    for name, text in (("a.svg", "<svg/>"), ("b.svg", "<svg/>"), ("c.svg", ""), ("d.png", "x")):
        (tmp_path / "svg" / name).write_text(text)
    blobs = files.read_blobs(spark, str(tmp_path / "svg"))
    assert blobs.count() == 2 and blobs.where("accepted").count() == 2 and files.distinct_blobs(blobs).count() == 1
    (tmp_path / "journal.tsv").write_text("1\tabc\n2\tdef\n1\t-\n2\txyz\n")
    assert {tuple(r) for r in files.read_journal(spark, str(tmp_path / "journal.tsv")).collect()} == {(1, None), (2, "xyz")}
    status = spark.createDataFrame([(200,), (404,), (429,), (503,), (400,)], "s int").select(files.fetch_status(F.col("s")).alias("r")).collect()
    assert [r.r for r in status] == ["ok", "missing", "retry", "retry", "failed"]


def test_arrays(spark, tmp_path):
    images = np.arange(2 * 64 * 64, dtype=np.uint64).reshape(2, 64, 64).astype(np.uint8)
    np.save(tmp_path / "images.npy", images)
    assert [bytes(r.bitmap) for r in files.read_npy_bitmaps(spark, str(tmp_path / "images.npy")).orderBy("row").collect()] == [x.tobytes() for x in images]
    codes, scales = np.array([[1, -2], [3, 127]], np.int8), np.array([0.5, 2.0], np.float32)
    blob = files.pack_shard(codes, scales)
    back = files.unpack_shard(blob, 2, 2)
    assert (back[0] == codes).all() and (back[1] == scales).all()
    with pytest.raises(ValueError):
        files.unpack_shard(blob, 3, 2)
    assert list(spark.createDataFrame([(bytearray(b"\x01\xff"),)], "b binary").select(files.int8_codes("b").alias("c")).first().c) == [1, -1]


def test_encoder_contract(spark):
    rows = spark.createDataFrame([(1, bytearray(encoder.BLANK)), (2, bytearray(b"\xff" * 4096)), (3, None)], "id int, bitmap binary")
    unit = lambda images: (np.eye(64)[: len(images)], np.zeros((len(images), 3)))
    assert [r.id for r in encoder.encode(rows, unit).collect()] == [2]
    with pytest.raises(Exception, match="length 1"):
        encoder.encode(rows, lambda images: (np.ones((len(images), 64)), np.zeros((len(images), 3)))).collect()


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("cat", 1, "accepted", 1), ("cat", 1, None, 3), ("dog", 2, "accepted", 2)], "class string, candidate_id long, decision string, seq long")
    log.where("seq < 3").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    run = lambda: folds.fold_stream(stream(), str(tmp_path / "state"), str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    run()
    log.where("seq = 3").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "state").iterdir() if p.is_dir())
    state = {(r["class"], r.candidate_id): r.decision for r in spark.read.parquet(str(tmp_path / "state" / f"version={last}")).collect()}
    assert state == {("cat", 1): None, ("dog", 2): "accepted"}
    events = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:05:00"), (1, "2024-01-01 00:16:00")], "u int, t string").withColumn("t", F.to_timestamp("t"))
    assert sorted(r.events for r in folds.debounced(events, "u", "t", "10 minutes").collect()) == [1, 2]


def test_progress_document_round_trip(spark, tmp_path):
    manifest = spark.createDataFrame([("a", 1), ("a", 2), ("The b", 1)], "class string, candidate_id long")
    head = spark.createDataFrame([("c" * 40, "print")], "commit string, fingerprint string")
    decided = spark.createDataFrame([("a", 2, "accepted"), ("The b", 1, "rejected"), ("a", 1, "rejected")], "class string, candidate_id long, decision string")
    reviewed = spark.createDataFrame([("The b",), ("a",)], "class string")
    path = str(tmp_path / "progress")
    curation.progress_document(head, decided, reviewed).coalesce(1).write.json(path)
    document = spark.read.schema(curation.PROGRESS_DOCUMENT).json(path)
    assert document.first().reviewedClasses == ["a", "The b"]  # as people sort
    back = curation.progress_tables(document)
    assert sorted(map(tuple, back[1].collect())) == [("The b", "1", "rejected"), ("a", "1", "rejected"), ("a", "2", "accepted")]
    classes = manifest.select("class")
    assert curation.state_problems(*back, head, manifest, classes).count() == 0
    other = head.withColumn("commit", F.lit("d" * 40))
    assert [r.problem for r in curation.state_problems(*back, other, manifest, classes).collect()] == ["commit"]
    none = curation.progress_document(head, decided.limit(0), reviewed.limit(0))
    assert [t.count() for t in curation.progress_tables(none)] == [1, 0, 0] and none.first().decisions == {}


def test_rule_problems(spark):
    rules = spark.createDataFrame([("alias", "a", "x"), ("preferred", "a", "Food"), ("preferred", "zz", "Fod"), ("excluded", "a", None)], "kind string, class string, value string")
    penalties = spark.createDataFrame([("Food", 1.0), ("Fud", float("inf")), ("UI", None)], "category string, points double")
    out = curation.rule_problems(rules, penalties, spark.createDataFrame([("a",)], "class string"), spark.createDataFrame([("Food",), ("UI",)], "category string"))
    assert sorted(map(tuple, out.collect())) == [("Fod", "unknown category"), ("Fud", "penalty"), ("Fud", "unknown category"), ("UI", "penalty"), ("a", "empty value"), ("zz", "unknown class")]


def test_only_blobs_that_are_there(spark):
    icons = spark.createDataFrame([(1, "p"), (2, "p"), (3, "p"), (4, "q"), (5, "p")], "icon_id long, pack string")
    digests = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b"), (9, "c")], "icon_id long, digest string")
    out = dedup.available(icons, digests, "pack").select("icon_id", "digest", "place")
    assert sorted(map(tuple, out.collect())) == [(1, "b", 1), (3, "a", 0), (4, "b", 0)]
