"""Importance resampling against a plain version, for runs of one word and of up to three."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import queries, resampling

from .test_cases import EXTRA, LONG, ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


def features(text, n):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n=1, buckets=10_000, least=20, percent=10):
    """(doc_id, text) pairs -> (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in docs for f in features(t, n)[1])
    t = Counter(bucket(f) for text in target for f in features(text, n)[1])
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, text in docs:
        words, f = features(text, n)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        noise = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((noise + 0.5) / 4294967296))), None, words])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0], r[1], r[2]))
    for place, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = place + 1
    return [tuple(r[:5]) for r in rows]


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_query_equals_brute(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = queries.op13_resampling(spark, SF).collect()
    assert ordered(got) == ordered(plain(docs, target)) and sum(r.rank is not None for r in got) > 5


@pytest.mark.parametrize(("n", "pack"), [(1, 500), (2, 500), (3, 1 << 20)])
def test_runs_packs_and_cases(spark, n, pack):
    """Nulls, empty and long texts, repeated rows, other scripts, clashing columns; packs of one text and of many."""
    odd = [(20, "ß ẞ Straße,straße STRASSE 1st\x001ST\x7fx ¿qué? 漢字 漢字", "de", "a", 1), (20, "another text under this id " * 6, "en", "a", 1)]
    docs = spark.createDataFrame(ROWS + odd, SCHEMA).withColumns({c: F.lit("clash") for c in [*EXTRA, "side", "ids", "tuple", "bucket"]})
    target = ["a changed word of another text", None, "", "same same 漢字"]
    aim = spark.createDataFrame([(t, "clash") for t in target], "text string, doc_id string")
    rows = resampling.drawn(resampling.weighed(docs, aim, n, buckets=50, pack=pack), percent=40, least=5)
    expected = plain([(i, t) for i, t, *_ in ROWS + odd], target, n, buckets=50, least=5, percent=40)
    assert ordered(rows.select("doc_id", "n_features", "weight", "score", "rank").collect()) == ordered(expected)
    assert any(t == LONG for _, t, *_ in ROWS)


def test_no_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    assert resampling.drawn(resampling.weighed(docs.where("false"), docs)).collect() == []
    rows = resampling.drawn(resampling.weighed(docs, docs.where("false"))).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert ordered(rows) == ordered(plain([(i, t) for i, t, *_ in ROWS], []))


def test_words_are_cut_as_bytes():
    texts = ["A b-c  d", "", "é\x1fÉ 9z", "\n"]
    counts, words, numbers = resampling.cut([t.encode() for t in texts])
    flat = [w.encode() for t in texts for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))]
    assert list(counts) == [4, 0, 3, 0] and [words[int(i)].as_py() for i in numbers] == flat and len(words) == len(set(flat))
    assert len(resampling.cut([b""])[2]) == 0 and np.array_equal(resampling.cut([b"x" * 1000])[0], [1])
