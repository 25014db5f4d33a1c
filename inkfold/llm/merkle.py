"""A Merkle manifest of a dataset, with parent-preimage paths.

Each row is a leaf. In each group the leaves are ordered by their key, and while there are several nodes every run of
eight consecutive ones becomes their hash; the groups' last nodes, in the order of the groups, become the root alike.

For every parent its preimage is stored: the hashes of its children as hex text, one behind the other. A leaf joins
the preimages of its ancestors, from its parent to the root. In each it knows its own slot of 64 characters: what is
left without the slot are the siblings, and with another hash in the slot the parent folds to another one.

Scale. Places come from a range sort (a hot group is cut like any other), so no task sees a whole group. ``HEIGHT``
levels are climbed at once in blocks of 8 ** HEIGHT neighbours, so a table of n rows takes log8(n) / HEIGHT jobs, each
4,096 times smaller than the one before. On the way back each block meets the preimages of its own levels and one row
per level above; only leaves, their hashes and these preimages (73 bytes a leaf) are shuffled, never a text.

Cases: null fields are "-" (an empty text is "0:"); a null group is a group of its own, the first; a null key comes
first in its group; rows that repeat a key are ordered by their leaf, and equal rows get a place each; very long texts
are hashed where they are read; an empty table has no leaf, no root and an empty result; columns that are not named
are not read, so their names can't clash.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import name, stored, with_key

#: Children of a parent, and hex characters of a hash.
FAN, SLOT = 8, 64
#: Levels that one job climbs.
HEIGHT = 4

PREIMAGES = "tree long, block long, level int, place long, preimage string"
#: Levels of the tree over the groups come behind those of a group's own.
TOP = 1000


def leaf(fields: list[Column]) -> Column:
    """The hash of a row: each field as its UTF-8 bytes' number, a colon and its value, or "-" for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Leaves (group, key, leaf, other) as (tree, size, place, key, leaf, other); and the trees: (tree, size)."""
    # a text that sorts like the group, null first
    group = F.coalesce(F.concat(F.lit("+"), F.col("group").cast("string")), F.lit(""))
    rows = stored(leaves.select(group.alias("group"), F.col("key").cast("long").alias("key"), "leaf", "other", F.monotonically_increasing_id().alias("tie")))
    rows = stored(numbered(rows, ["group", "key", "leaf", "tie"], "at", stored))
    groups = stored(rows.groupBy("group").agg(F.min("at").alias("first"), F.count("*").alias("size")))
    trees = stored(numbered(groups, ["group"], "tree", stored))
    out = with_key(rows, trees, ["group"])
    return stored(out.select("tree", "size", (F.col("at") - F.col("first")).alias("place"), "key", "leaf", "other")), trees.select("tree", "size")


def _climbed(key: tuple, table: pa.Table, height: int) -> pa.Table:
    """The preimages of up to ``height`` levels above a block of neighbours (place, size of the tree's level, hash)."""
    tree, block = (int(k.as_py()) for k in key)
    order = np.argsort(table.column("place").to_numpy())
    nodes = table.column("hash").take(pa.array(order)).to_pylist()
    left, first = table.column("size")[0].as_py(), block * FAN**height
    levels, places, preimages = [], [], []
    for level in range(1, height + 1):
        if left == 1:
            break
        runs = ["".join(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)]
        left, first = -(-left // FAN), first // FAN
        levels += [level] * len(runs)
        places += range(first, first + len(runs))
        preimages += runs
        nodes = [sha256(r.encode()).hexdigest() for r in runs]
    n = len(levels)
    return pa.table([pa.array([tree] * n, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(preimages, pa.string())], names=["tree", "block", "level", "place", "preimage"])


def _block(place: Column, height: int) -> Column:
    return F.floor(place / F.lit(FAN**height)).cast("long")


def climbed(nodes: DataFrame, largest: int, height: int) -> tuple[list[DataFrame], DataFrame]:
    """The stored preimages above ``nodes`` (tree, size, place, hash), a table for each ``height`` levels; and (tree, hash) of the last nodes."""
    stages, lasts = [], [nodes.where("size = 1")]
    while True:
        up = nodes.where("size > 1").select("tree", "size", "place", "hash", _block(F.col("place"), height).alias("block"))
        stages.append(stored(up.groupBy("tree", "block").applyInArrow(lambda key, rows: _climbed(key, rows, height), PREIMAGES)))
        # a tree's levels end at a single node, which has the highest level of its tree
        nodes = stages[-1].where(F.col("level") == height).select("tree", "place", F.sha2(F.col("preimage").cast("binary"), 256).alias("hash"))
        heights = stages[-1].where("block = 0").groupBy("tree").agg(F.max("level").alias("height"), F.max(F.struct("level", "preimage"))["preimage"].alias("preimage"))
        one = stages[-1].groupBy("tree").agg(F.max("block").alias("blocks")).where("blocks = 0").join(heights, "tree")
        lasts.append(one.select("tree", F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("place"), F.sha2(F.col("preimage").cast("binary"), 256).alias("hash")))
        largest = -(-largest // FAN**height)
        if largest <= 1:
            break
        many = stages[-1].groupBy("tree").agg(F.max("block").alias("blocks")).where("blocks > 0").select("tree", (F.col("blocks") + 1).alias("size"))
        nodes = with_key(stored(nodes), stored(many), ["tree"]).where("size is not null").select("tree", "size", "place", "hash")
    last = lasts[0].select("tree", "hash")
    for other in lasts[1:]:
        last = last.unionByName(other.select("tree", "hash"))
    return stages, stored(last)


def _chains(table: pa.Table, height: int) -> tuple[dict[int, dict[int, str]], list[tuple[int, int, str]]]:
    """The preimages inside a block by level and place, and (level, slot, preimage) of those above it, upwards."""
    inside: dict[int, dict[int, str]] = {}
    above = []
    for level, place, preimage in zip(*(table.column(c).to_pylist() for c in ("level", "place", "preimage"))):
        if level <= height:
            inside.setdefault(level, {})[place] = preimage
        else:
            above.append((level, place, preimage))
    return inside, sorted(above)


def _path(place: int, inside: dict, above: list) -> list[tuple[int, int, str]]:
    """(level, slot, preimage) of a node's ancestors, upwards."""
    path = []
    for level in sorted(inside):
        place, slot = divmod(place, FAN)
        path.append((level, slot, inside[level][place]))
    return path + above


def _lowered(key: tuple, table: pa.Table, height: int) -> pa.Table:
    """The ancestors of every node at a block's foot, as rows for the block that this node tops."""
    tree, block = (int(k.as_py()) for k in key)
    inside, above = _chains(table, height)
    first, n = block * FAN**height, sum(len(p) // SLOT for p in inside.get(1, {"": ""}).values())
    rows = [(tree, place, level + height if level < TOP else level, slot, preimage) for place in range(first, first + n) for level, slot, preimage in _path(place, inside, above)]
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["tree", "block", "level", "place", "preimage"])


def lowered(stages: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The rows that a foot's block meets: its own preimages, and those above it (level > ``height``, with its slot as place).

    ``above`` are the ancestors of each tree's last node, for the block 0 of the stage that ends there.
    """
    for i in range(len(stages) - 1, 0, -1):
        ends = stages[i].select("tree").distinct()
        rows = stages[i].unionByName(above.join(ends, "tree", "left_semi"))
        above = stored(rows.groupBy("tree", "block").applyInArrow(lambda key, rows: _lowered(key, rows, height), PREIMAGES).unionByName(above.join(ends, "tree", "left_anti")))
    return stages[0].unionByName(above)


def _sibling_text(path: list[tuple[int, int, str]]) -> str:
    return "".join(p[: SLOT * s] + p[SLOT * (s + 1) :] for _, s, p in path)


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def _folded(node: str, path: list[tuple[int, int, str]]) -> str:
    """The hash that a node folds to: put into its slot of each preimage, upwards."""
    for _, s, p in path:
        node = _hash(p[: SLOT * s] + node + p[SLOT * (s + 1) :])
    return node


def _proved(leaves: pa.Table, preimages: pa.Table, height: int, root: str) -> pa.Table:
    """A block's leaves with subroot, root, the hash of their siblings, and the root that ``other``, or else the leaf, folds to."""
    inside, above = _chains(preimages, height)
    above_text, out = _sibling_text(above), [[], [], [], []]
    top = [p for p in above if p[0] >= TOP]
    for place, own, other in zip(*(leaves.column(c).to_pylist() for c in ("place", "leaf", "other"))):
        path = _path(place, inside, [])
        folded = _folded(own if other is None else other, path + above)
        subroot = top[0][2][SLOT * top[0][1] : SLOT * (top[0][1] + 1)] if top else root
        for column, value in zip(out, (subroot, root, _hash(_sibling_text(path) + above_text), folded)):
            column.append(value)
    return pa.table([leaves.column("key"), leaves.column("leaf"), *(pa.array(c, pa.string()) for c in out)], names=["key", "leaf", "subroot", "root", "proof_sha256", "folded_root"])


def proofs(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root) of each of the leaves (group, key, leaf, other).

    ``other`` is a hash to put in the leaf's place, or null for the leaf itself: ``folded_root`` is the root that it
    folds to with the siblings as they are, recomputed for every row. ``root`` is the one that the climb ends at, not
    one of a leaf's own path. The key is a column of numbers.
    """
    rows, trees = placed(leaves)
    largest, groups = trees.agg(F.coalesce(F.max("size"), F.lit(0)), F.count("*")).first()
    stages, subroots = climbed(rows.select("tree", "size", "place", F.col("leaf").alias("hash")), largest, height)
    over, roots = climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.lit(groups).cast("long").alias("size"), F.col("tree").alias("place"), "hash"), groups, height)
    root = roots.agg(F.first("hash")).first()[0]
    # the blocks of the upper tree are met with no rows below: each of their feet is the last node of a tree
    none = over[0].limit(0)
    feet = lowered(over, none, height).groupBy("tree", "block").applyInArrow(lambda key, rows: _lowered(key, rows, height), PREIMAGES)
    tops = stored(feet.select(F.col("block").alias("tree"), F.lit(0).cast("long").alias("block"), (F.col("level") + TOP).alias("level"), "place", "preimage"))
    paths = lowered(stages, tops, height)
    feet = rows.withColumn("block", _block(F.col("place"), height))
    out = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    return feet.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(lambda leaves, preimages: _proved(leaves, preimages, height, root), out)


def row_leaves(docs: DataFrame, fields: list[str], group: str, key: str, other: dict[str, Column] | None = None, where: Column | None = None) -> DataFrame:
    """(group, key, leaf, other) of a table's rows; ``other`` is the leaf with some fields replaced, where ``where`` holds."""
    own = leaf([name(f) for f in fields])
    changed = F.when(where, leaf([other.get(f, name(f)) for f in fields])) if other else F.lit(None).cast("string")
    return docs.select(name(group).alias("group"), name(key).alias("key"), own.alias("leaf"), changed.alias("other"))
