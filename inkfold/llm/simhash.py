"""Near-duplicates by SimHash, with covering locality-sensitive hashing: no pair within the radius is missed.

Fingerprints. Words are lower-cased (A-Z) and cut at white space; every run of four, repeats included, votes with its
XXH64 (seed 42) for the 64 bits, and a bit is set if more than half of the runs set it.

Tables. Each of the 64 bits is given a non-zero vector of radius + 1 bits, evenly. Table v, for each of the
2 ** (radius + 1) - 1 non-zero vectors v, keeps the bits whose vector has an odd product with v: about half of them.
The vectors of ``radius`` differing bits cannot span all radius + 1 dimensions, so some v is orthogonal to every one
of them; its mask drops just these bits, and both fingerprints have the same key there. That holds for every pair, not
on average. For a radius of 4 there are 31 tables with keys of 32 to 34 bits.

Only distinct fingerprints are banded, so copies of any number are one row. A key's rows come to one task in a sorted
stream and leave it as a spanning forest of their exact links, never as all pairs. A key that a 64th of the fingerprints
(drawn by hash) shows to be hot is cut by a second family of masks: the pair meets there as well, and as two masks leave
at most 21 bits open, no group has more than 2 ** 21 fingerprints, however many there are in all.

Components come from rounds that contract the links, each stored in the shared folder.

Cases: null texts, empty texts and texts without words have fingerprint zero, which is linked like any other; fewer than
four words are one run; a null doc_id is no node: its component is null; rows that repeat a doc_id are one node, whatever
their texts; very long texts are hashed in pieces; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import name, sliced, small, stored, with_key
from .near_dup import components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: A key with more fingerprints than this is cut by a second mask.
HOT = 500_000
#: One in so many fingerprints is counted to find hot keys.
DRAWN = 64
#: Groups up to this size are compared at once, larger ones each by itself.
SIDE_BY_SIDE = 16
_PIECE = 1 << 16
_GAPS = re.compile(rb"[\x20\x09-\x0D]+")
_DIGEST = xxhash.xxh64_intdigest


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64 bits of a UTF-8 text, unsigned."""
    line = _GAPS.sub(b" ", text.lower().strip()) if text else b""
    if not line:
        return 0
    gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
    n = max(1, len(gaps) + 2 - shingle)
    starts, ends = np.concatenate(([0], gaps + 1))[:n], np.concatenate((gaps, [len(line)]))[-n:]
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, _PIECE):
        edges = zip(starts[lo : lo + _PIECE].tolist(), ends[lo : lo + _PIECE].tolist())
        hashes = np.array([_DIGEST(line[i:j], SEED) for i, j in edges], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = 2 * votes > n
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def fingerprinted(docs: DataFrame) -> DataFrame:
    """(doc_id, f): the fingerprint of each document, as a signed long."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            f = np.fromiter(map(fingerprint, (t.as_py() for t in batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(f.view(np.int64))], names=["doc_id", "f"])

    return docs.select(name("doc_id").cast("long").alias("doc_id"), name("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, f long")


def masks(radius: int = RADIUS, turn: int = 0) -> list[int]:
    """The masks of the covering tables as signed longs; another ``turn`` deals the vectors to the bits in another order."""
    n = 2 ** (radius + 1) - 1
    order = np.random.Generator(np.random.PCG64(turn)).permutation(64) if turn else np.arange(64)
    vector = {int(bit): 1 + i % n for i, bit in enumerate(order)}
    out = [sum(1 << bit for bit, u in vector.items() if (u & v).bit_count() % 2) for v in range(1, n + 1)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in out]


def keyed(rows: DataFrame, radius: int = RADIUS, turn: int = 0) -> DataFrame:
    """``rows`` with a fingerprint f, once for each table, with the table's key behind what a column key already holds."""
    before = [F.col("key")] if "key" in rows.columns else []
    keys = [F.xxhash64(F.lit(i), F.col("f").bitwiseAND(F.lit(m)), *before) for i, m in enumerate(masks(radius, turn))]
    return rows.select("f", F.explode(F.array(*keys)).alias("key"))


def forest(f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the same components as all pairs of the distinct fingerprints within the radius."""
    left, front, a, b = f[1:], [f[0]], [], []
    while len(left):
        if not front:
            front, left = [left[0]], left[1:]
            continue
        x = front.pop()
        near = np.bitwise_count(left ^ x) <= radius
        if near.any():
            found = left[near]
            a.append(np.full(len(found), x)), b.append(found)
            front.extend(found)
            left = left[~near]
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _linked(keys: np.ndarray, f: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole groups of equal, sorted keys."""
    start = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((start, [len(keys)])))
    a, b = [], []
    few = np.repeat(size <= SIDE_BY_SIDE, size)
    k, g = keys[few], f[few]
    for step in range(1, min(SIDE_BY_SIDE, len(k))):
        near = (k[step:] == k[:-step]) & (np.bitwise_count(g[step:] ^ g[:-step]) <= radius)
        a.append(g[:-step][near]), b.append(g[step:][near])
    for lo, n in zip(start[size > SIDE_BY_SIDE], size[size > SIDE_BY_SIDE]):
        x, y = forest(np.unique(f[lo : lo + n]), radius)
        a.append(x), b.append(y)
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def links_of(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links between the fingerprints of each key; (key, f) come sorted, so a task holds a batch and one key."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list[np.ndarray], f: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _linked(np.concatenate(keys), np.concatenate(f), radius)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        open_keys, open_f = [], []  # the rows of the last key, which may go on
        for batch in batches:
            keys, f = batch.column("key").to_numpy(), batch.column("f").to_numpy().view(np.uint64)
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))
            if open_keys and (last or keys[0] != open_keys[0][0]):
                yield out([*open_keys, keys[:last]], [*open_f, f[:last]])
                open_keys, open_f = [], []
            elif last:
                yield out([keys[:last]], [f[:last]])
            open_keys.append(keys[last:]), open_f.append(f[last:])
        if open_keys:
            yield out(open_keys, open_f)

    return rows.repartition("key").sortWithinPartitions("key").select("key", "f").mapInArrow(met, "a long, b long")


def links(classes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(a, b): links that span the components of the stored, distinct fingerprints (f) within the radius."""
    drawn = classes.where(F.pmod(F.xxhash64(F.lit("drawn"), F.col("f")), F.lit(DRAWN)) == 0) if hot >= DRAWN else classes
    most = hot // DRAWN if hot >= DRAWN else hot
    crowded = small(stored(keyed(drawn, radius).groupBy("key").count().where(F.col("count") > most).select("key")))
    rows = keyed(classes.select("f"), radius)
    if crowded.isEmpty():
        return links_of(rows, radius)
    again = keyed(rows.join(crowded, "key", "left_semi"), radius, turn=1)
    return links_of(rows.join(crowded, "key", "left_anti").unionByName(again.select("f", "key")), radius)


def near_duplicates(docs: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """(doc_id, f, component_id) of each row of ``docs``; the component is the smallest doc_id that links reach."""
    marked = stored(fingerprinted(docs))
    nodes = marked.where(F.col("doc_id").isNotNull())
    classes = stored(nodes.groupBy("f").agg(F.min("doc_id").alias("first")))
    # the fingerprints of one doc_id hang together
    own = nodes.groupBy("doc_id").agg(F.min("f").alias("a"), F.max("f").alias("z")).where("a < z").select("doc_id", "a")
    shared = nodes.join(own, "doc_id").select("a", F.col("f").alias("b")).where("a < b").distinct()
    labels = components(links(classes, radius, hot).unionByName(shared))
    linked = classes.join(labels.select(F.col("node").alias("f"), "label"), "f", "left").select("f", "first", F.coalesce("label", "f").alias("label"))
    linked = stored(linked)
    lowest = stored(linked.groupBy("label").agg(F.min("first").alias("component_id")))
    by_class = stored(with_key(linked, lowest, ["label"]).select("f", "component_id"))
    out = with_key(marked, by_class, ["f"])
    return out.select("doc_id", "f", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
