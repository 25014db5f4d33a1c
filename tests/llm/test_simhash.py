"""SimHash against all pairs, and the guarantee of its covering masks."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from inkfold.llm import queries, simhash

from .test_cases import EXTRA, LONG, ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    votes, runs = [0] * 64, [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    for run in runs:
        x = xxhash.xxh64(run.encode(), seed=42).intdigest()
        for bit in range(64):
            votes[bit] += x >> bit & 1
    return sum(1 << bit for bit in range(64) if 2 * votes[bit] > len(runs))


def plain_components(prints, radius=4):
    """(doc_id, fingerprint) pairs -> doc_id: component."""
    root = {i: i for i, _ in prints if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    rows = [(i, f) for i, f in prints if i is not None]
    for n, (i, f) in enumerate(rows):
        for j, g in rows[:n]:
            if i != j and (f ^ g).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in root}


def test_query_equals_all_pairs(spark):
    rows = queries.op12_simhash(spark, SF).collect()
    prints = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    roots = plain_components(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == sorted((i, f"{f:016x}", roots[i]) for i, f in prints)


@pytest.mark.parametrize("radius", [1, 2, 4])
def test_masks_cover_every_difference(radius):
    """For every set of up to ``radius`` differing bits some mask drops them all; checked on all of them or many."""
    kept = np.array([m % 2**64 for m in simhash.masks(radius)], np.uint64)
    r = random.Random(radius)
    pairs = [sum(1 << b for b in r.sample(range(64), radius)) for _ in range(20_000)]
    if radius <= 2:
        pairs = [(1 << i) | (1 << (j if radius == 2 else i)) for i in range(64) for j in range(64)]
    assert ((kept & np.array(pairs, np.uint64)[:, None]) == 0).any(axis=1).all()
    if radius == 4:
        assert {int(m).bit_count() for m in kept} <= {32, 33, 34}
        other = np.array([m % 2**64 for m in simhash.masks(radius, 1)], np.uint64)
        assert max(64 - (int(a) | int(b)).bit_count() for a in kept for b in other) <= 21


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_components_of_crowds(spark, hot):
    """Balls of many near fingerprints, chains of exact steps and strangers; with hot keys cut by second masks as well."""
    r = random.Random(3)
    flip = lambda f, n: f ^ sum(1 << b for b in r.sample(range(64), n))
    center, prints = r.getrandbits(64), []
    prints += [flip(center, r.randint(0, 6)) for _ in range(300)]
    at = r.getrandbits(64)
    for _ in range(40):
        at = flip(at, 4)
        prints.append(at)
    at = r.getrandbits(64)
    for _ in range(40):
        at = flip(at, 5)
        prints.append(at)
    prints += [r.getrandbits(64) for _ in range(100)] + [0, 1, 2**63, 2**64 - 1]
    rows = list(enumerate(prints))
    roots = plain_components(rows)
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in set(prints)]
    classes = spark.createDataFrame(signed, "f long")
    links = [(x.a % 2**64, x.b % 2**64) for x in simhash.links(classes, hot=hot).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    first = {}
    for i, f in rows:
        first.setdefault(f, i)
    parent = {f: f for f in first}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[a] = b
    assert {(roots[first[f]], roots[first[g]]) for f in first for g in first if find(f) == find(g)} == {(x, x) for x in roots.values()}


def test_streamed_keys_meet_whole(spark):
    """A key that goes over many Arrow batches is one group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(100).select(F.expr("shiftleft(1L, cast(id % 50 AS int))").alias("f"), F.floor(F.col("id") / 50).alias("key"))
        links = simhash.links_of(rows, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len({x for r in links for x in (r.a, r.b)}) == 50


def test_simhash_cases(spark):
    same = [(30, "a b c d e", "en", "a", 1), (30, "quite another text of seven words", "en", "a", 1), (31, "QUITE another\ttext of  seven words", "en", "a", 1)]
    docs = spark.createDataFrame(ROWS + same, SCHEMA).withColumns({c: F.lit("clash") for c in [*EXTRA, "f", "key", "node"]})
    rows = simhash.near_duplicates(docs).collect()
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in ROWS + same]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.f % 2**64) for r in rows) == sorted((i is None, i or 0, f) for i, f in prints)
    got = {r.doc_id: r.component_id for r in rows}
    assert got[None] is None and got[2] == got[3] == got[4] == 2 and got[30] == got[31] == 30
    roots = plain_components(prints)
    assert all(got[i] == roots[i] for i in (0, 1, 5, 6, 7, 8, 9, 10))
    assert simhash.fingerprint(LONG.encode()) == plain_fingerprint(LONG)
    assert simhash.near_duplicates(docs.where("false")).collect() == []
