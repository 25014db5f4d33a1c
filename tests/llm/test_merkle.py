"""The manifest against a plain version that builds whole trees in memory."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from inkfold.llm import merkle

from .test_cases import EXTRA, LONG, ROWS, SCHEMA

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def plain_proofs(leaves):
    """(group, key, leaf, other) -> rows of the operator, with everything in memory."""
    groups = defaultdict(list)
    for group, key, leaf, other in leaves:
        groups[group].append((key is not None, key or 0, leaf, key, other))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    own = {g: levels([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in names}
    upper = levels([own[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, (_, _, leaf, key, other) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            steps = [(level, i // 8**k) for k, level in enumerate(own[g][:-1])] + [(level, j // 8**k) for k, level in enumerate(upper[:-1])]
            siblings, folded = "", other or leaf
            for level, place in steps:
                run = level[place - place % 8 :][:8]
                siblings += "".join(run[: place % 8] + run[place % 8 + 1 :])
                folded = h("".join([*run[: place % 8], folded, *run[place % 8 + 1 :]]))
            out.append((key, leaf, own[g][-1][0], upper[-1][0], h(siblings), folded))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) if x is None or isinstance(x, int) else (True, x) for x in r))


@pytest.mark.parametrize("height", [1, 2, 4])
def test_trees_of_all_heights(spark, height):
    """Groups of one, of full and of broken runs, over several stages, with equal rows, null keys and a null group."""
    r = random.Random(5)
    sizes = {"a": 1, "b": 8, "c": 9, "dé": 64, "d": 65, None: 7, "": 3, "e": 600}
    leaves = [(g, r.choice([None, *range(n)]) if n > 3 else i, h(f"{g}{i // 2}"), h(f"x{i}") if i % 3 == 0 else None) for g, n in sizes.items() for i in range(n)]
    leaves += [leaves[20]] * 3
    df = spark.createDataFrame(leaves, "group string, key long, leaf string, other string").repartition(5)
    got = ordered(merkle.proofs(df, height).collect())
    # rows that are equal in key and leaf may take each other's place, and with it its siblings
    plain = ordered(plain_proofs(leaves))
    strip = lambda rows: ordered((r[0], r[1], r[2], r[3], r[4]) for r in rows)
    assert strip(got) == strip(plain)
    once = {x[:3] for x in leaves if sum(y[:3] == x[:3] for y in leaves) == 1}
    pick = lambda rows: [r for r in rows if (r[0], r[1]) in {(k, leaf) for _, k, leaf in once}]
    assert pick(got) == pick(plain) and len(pick(got)) > 100


def test_many_groups(spark):
    """A tree over 70 groups, climbed in several stages as well."""
    leaves = [(f"g{i % 70:03}", i, h(str(i)), h("other") if i % 2 else None) for i in range(300)]
    df = spark.createDataFrame(leaves, "group string, key long, leaf string, other string")
    assert ordered(merkle.proofs(df, 1).collect()) == ordered(plain_proofs(leaves))


@pytest.mark.parametrize(("tree", "level", "place", "wrong"), [(0, 1, 1, set(range(9, 16))), (0, 2, 0, set(range(8, 20))), (1, merkle.TOP + merkle.HEIGHT + 1, 1, set(range(20, 30)))])
def test_untampered_leaves_are_folded(spark, monkeypatch, tree, level, place, wrong):
    """With the first slot of a stored preimage damaged, no leaf below the other slots folds to the root, though none is tampered with."""
    whole = merkle.lowered

    def damaged(stages, above, height):
        hit = (F.col("tree") == tree) & (F.col("level") == level) & (F.col("place") == place)
        return whole(stages, above, height).withColumn("preimage", F.when(hit, F.overlay("preimage", F.lit(h("damage")), F.lit(1))).otherwise(F.col("preimage")))

    leaves = [("a" if i < 20 else "b", i, h(str(i)), None) for i in range(30)]
    df = spark.createDataFrame(leaves, "group string, key long, leaf string, other string")
    assert all(r.folded_root == r.root for r in merkle.proofs(df).collect())
    monkeypatch.setattr(merkle, "lowered", damaged)
    rows = merkle.proofs(df).collect()
    assert {r.key for r in rows if r.folded_root != r.root} == wrong
    assert {r.root for r in rows} == {x[3] for x in plain_proofs(leaves)}


def test_merkle_cases(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("clash") for c in EXTRA + ["group", "key", "leaf", "tree", "place", "hash", "number at"]})
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = merkle.proofs(merkle.row_leaves(docs, FIELDS, "lang", "doc_id", {"text": lowered}, tampered)).collect()
    leaves = []
    for i, text, lang, source, n in ROWS:
        changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0
        leaves.append((lang, i, plain_leaf((i, source, lang, n, text)), plain_leaf((i, source, lang, n, None if text is None else text.lower())) if changed else None))
    assert ordered(rows) == ordered(plain_proofs(leaves)) and any(LONG == t for _, t, *_ in ROWS)
    none = merkle.proofs(merkle.row_leaves(docs.where("false"), FIELDS, "lang", "doc_id"))
    assert none.collect() == []
    one = merkle.proofs(merkle.row_leaves(docs.where("doc_id = 9"), FIELDS, "lang", "doc_id")).collect()
    assert [(r.leaf, r.proof_sha256) for r in one] == [(one[0].root, h(""))]
