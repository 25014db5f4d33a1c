"""Top-k of a stated query set over all vectors as blocked matrix products.

Vectors are packed into blocks inside their partitions and never shuffled. Queries are packed into blocks of about
``BLOCK_QUERIES``, which are broadcast; beyond ``MOST_BYTES`` of them the vectors are read once more for each further group.
Every pair of blocks is one matrix product of 32-bit floats. It only says which pairs can still enter a query's best
``k``: their products are taken again, axis by axis in 64 bits, so scores and ties are those of a plain sum. A task keeps
the best ``k`` of each query and sends them once; the last merge is a window by query.

Equal vectors tie in any number: of those in a block only the ``k`` with the smallest ids can count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

BLOCK_ITEMS, BLOCK_QUERIES, MOST_BYTES = 4096, 2048, 32 << 20
#: Queries of a block that are scored at once.
SLICE = 256
_KINDS = {T.FloatType(): np.float32, T.DoubleType(): np.float64, T.ByteType(): np.int8}
_FIRST = np.iinfo(np.int64).min


def _ids(column: pa.Array) -> np.ndarray:
    """Ids as numbers, null before all others."""
    return pc.fill_null(column.cast(pa.int64()), _FIRST).to_numpy(zero_copy_only=False)


def packed_items(items: DataFrame, item: str, k: int, plain: bool) -> DataFrame:
    """Blocks of vectors: shard, vectors, scales, size, payload. ``items`` has embedding, or codes and scale; all else is payload.

    A null vector is no candidate; vectors of different lengths raise. Where scores depend on vectors alone (``plain``)
    a block keeps ``k`` of each group of equal ones.
    """
    vector = "codes" if "codes" in items.columns else "embedding"
    kind = _KINDS[items.schema[vector].dataType.elementType]
    rest = [c for c in items.columns if c not in ("embedding", "codes", "scale")]
    scale = F.col("scale").cast("float") if vector == "codes" else F.lit(1.0).cast("float")
    shard = F.col("shard").cast("int") if "shard" in items.columns else F.lit(0)
    rows = items.where(F.col(vector).isNotNull()).select(shard.alias("shard"), F.col(vector).alias("v"), scale.alias("scale"), F.struct(*rest).alias("payload"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = pc.fill_null(batch.column("shard"), -1).to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(batch.column("v")).to_numpy(zero_copy_only=False)
            if lengths.min() != lengths.max():
                raise ValueError("vectors of different lengths")
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(batch.num_rows, -1)
            scales = batch.column("scale").to_numpy(zero_copy_only=False)
            order = np.argsort(shards, kind="stable")
            edges = np.flatnonzero(np.concatenate(([True], np.diff(shards[order]) != 0, [True])))
            for lo, hi in ((a, min(a + BLOCK_ITEMS, end)) for start, end in zip(edges[:-1], edges[1:]) for a in range(start, end, BLOCK_ITEMS)):
                at = order[lo:hi]
                if plain:
                    at = at[_smallest(values[at], scales[at], _ids(batch.column("payload").field(item))[at], k)]
                payload = batch.column("payload").take(pa.array(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shards[at[0]]], pa.int32()), pa.array([np.ascontiguousarray(values[at]).tobytes()]), pa.array([scales[at].tobytes()]), pa.array([len(at)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), payload)],
                    names=["shard", "vectors", "scales", "size", "payload"],
                )

    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("vectors", T.BinaryType()), T.StructField("scales", T.BinaryType()), T.StructField("size", T.IntegerType()), T.StructField("payload", T.ArrayType(rows.schema["payload"].dataType))])
    return rows.mapInArrow(pack, schema)


def _smallest(values: np.ndarray, scales: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without those of a group of equal vectors that have ``k`` smaller ids there."""
    whole = np.concatenate((values.view(np.uint8).reshape(len(values), -1), scales.view(np.uint8).reshape(len(values), -1)), axis=1)
    _, group = np.unique(np.ascontiguousarray(whole).view(f"V{whole.shape[1]}").ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    g = group[order]
    start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    rank = np.arange(len(g)) - np.repeat(start, np.diff(np.concatenate((start, [len(g)]))))
    return np.sort(order[rank < k])


def packed_queries(queries: DataFrame, count: int) -> DataFrame:
    """(block, queries): the queries of each block in the order of their ids, with the tokens of their predictions' labels."""
    held = [F.col("qid"), F.col("embedding")]
    if "predictions" in queries.columns:
        label = lambda x: text.tokenize(F.coalesce(x["label"], F.lit("")))
        held.append(F.coalesce(F.transform("predictions", lambda x: F.struct(x["class_index"].alias("class_index"), x["probability"].alias("probability"), label(x).alias("tokens"))), F.array()).alias("predictions"))
    block = F.pmod(F.xxhash64("qid"), F.lit(max(1, -(-count // BLOCK_QUERIES)))).cast("int")
    return queries.where(F.col("embedding").isNotNull()).groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(*held))).alias("queries"))


class _Predictions:
    """The predictions of a block's queries as arrays of (query, place), padded with a probability of zero and class -1."""

    def __init__(self, rows: list[list[dict]]):
        most = max(map(len, rows), default=0)
        self.classes, self.chance = np.full((len(rows), most), -1, np.int64), np.zeros((len(rows), most))
        self.label, self.labels, known = np.zeros((len(rows), most), np.int64), [], {}
        for i, row in enumerate(rows):
            for j, p in enumerate(row):
                tokens = tuple(sorted(p["tokens"]))
                if tokens not in known:
                    known[tokens] = len(self.labels)
                    self.labels.append(tokens)
                self.classes[i, j], self.chance[i, j], self.label[i, j] = -1 if p["class_index"] is None else p["class_index"], p["probability"] or 0.0, known[tokens]
        self.highest = self.chance.max(axis=1, initial=0.0)

    def matches(self, names: pa.Array) -> np.ndarray:
        """Whether all tokens of each label are among an item's tokens, by label and item."""
        flat = names.flatten()
        parent = np.repeat(np.arange(len(names)), pc.fill_null(pc.list_value_length(names), 0).to_numpy(zero_copy_only=False))
        found: dict[str, np.ndarray] = {}
        for token in {t for label in self.labels for t in label}:
            found[token] = np.zeros(len(names), bool)
            found[token][parent[pc.equal(flat, token).to_numpy(zero_copy_only=False).astype(bool)]] = True
        return np.array([reduce(np.logical_and, [found[t] for t in label], np.ones(len(names), bool)) for label in self.labels]).reshape(-1, len(names))

    def prior(self, q: np.ndarray, item: np.ndarray, aux: np.ndarray, match: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The prior of pairs, and the probability of the item's own class (of several entries the last)."""
        own = np.zeros(len(q))
        for j in range(self.classes.shape[1]):
            own = np.where((self.classes[q, j] == aux[item]) & (self.classes[q, j] >= 0), self.chance[q, j], own)
        prior = own
        for j in range(self.classes.shape[1]):
            prior = np.where(match[self.label[q, j], item] & (self.chance[q, j] > prior), self.chance[q, j], prior)
        return prior, own


def _best(slot: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the best ``k`` of each slot, by (score descending, id)."""
    order = np.lexsort((ids, -score, slot))
    s = slot[order]
    start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.empty(0, int)
    rank = np.arange(len(s)) - np.repeat(start, np.diff(np.concatenate((start, [len(s)]))))
    return order[rank < k]


class _Block:
    """The queries of a block, and the best ``k`` so far of each."""

    def __init__(self, rows: list[dict], k: int, weight: float, item: str):
        self.k, self.weight, self.item = k, weight, item
        self.qids = [r["qid"] for r in rows]
        self.wide = np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1)
        self.narrow, self.norms = self.wide.astype(np.float32), np.linalg.norm(self.wide, axis=1)
        self.predictions = _Predictions([r["predictions"] for r in rows]) if weight > 0 else None
        self.least = np.full(len(rows), -np.inf)
        self.numbers = np.empty((5, 0))  # slot, score, cosine, prior, probability
        self.ids, self.payload = np.empty(0, np.int64), None

    def meet(self, vectors: np.ndarray, scales: np.ndarray, payload: pa.StructArray, slots: np.ndarray | None) -> None:
        if not len(self.qids) or not len(vectors):
            return
        if vectors.shape[1] != self.wide.shape[1]:
            raise ValueError("vectors of different lengths")
        narrow = vectors.astype(np.float32) * scales[:, None]
        wide, ids = vectors.T.astype(np.float64), _ids(payload.field(self.item))
        longest = float(np.sqrt((narrow.astype(np.float64) ** 2).sum(axis=1).max()))
        if self.predictions:
            aux = pc.fill_null(payload.field("aux_class").cast(pa.int64()), -2).to_numpy(zero_copy_only=False)
            match = self.predictions.matches(payload.field("name_tokens"))
        slots, share = np.arange(len(self.qids)) if slots is None else slots, 1 - self.weight
        numbers, items = [], []
        for lo in range(0, len(slots), SLICE):
            here = slots[lo : lo + SLICE]
            # what a product of 32-bit floats may be off by
            slack = (vectors.shape[1] + 8) * 2.5e-7 * longest * self.norms[here]
            score = share * (self.narrow[here] @ narrow.T)
            least = self.least[here]
            if np.isinf(least).any() and len(vectors) > self.k:
                least = np.maximum(least, np.partition(score, len(vectors) - self.k, axis=1)[:, len(vectors) - self.k] - slack)
            if self.predictions:
                score = score + self.weight * self.predictions.highest[here][:, None]
            q, at = np.nonzero(score >= (least - slack)[:, None])
            if not len(q):
                continue
            q = here[q]
            cosine = np.zeros(len(q))
            for axis in range(len(wide)):
                cosine += wide[axis][at] * self.wide[q, axis]
            cosine *= scales.astype(np.float64)[at]
            prior, own = self.predictions.prior(q, at, aux, match) if self.predictions else (np.zeros(len(q)), np.zeros(len(q)))
            exact = share * cosine + self.weight * prior
            keep = _best(q, exact, ids[at], self.k)
            numbers.append(np.array([q, exact, cosine, prior, own])[:, keep])
            items.append(at[keep])
        if items:
            self._merge(np.concatenate(numbers, axis=1), np.concatenate(items), ids, payload)

    def _merge(self, numbers: np.ndarray, at: np.ndarray, ids: np.ndarray, payload: pa.StructArray) -> None:
        found = payload.take(pa.array(at))
        numbers, ids = np.concatenate((self.numbers, numbers), axis=1), np.concatenate((self.ids, ids[at]))
        keep = _best(numbers[0], numbers[1], ids, self.k)
        self.numbers, self.ids = numbers[:, keep], ids[keep]
        self.payload = (found if self.payload is None else pa.concat_arrays([self.payload, found])).take(pa.array(keep))
        slot = self.numbers[0].astype(np.int64)
        full = np.bincount(slot, minlength=len(self.qids)) == self.k
        last = np.full(len(self.qids), np.inf)
        np.minimum.at(last, slot, self.numbers[1])
        self.least[full] = last[full]


def top_k(queries: DataFrame, items: DataFrame, k: int, weight: float = 0.0, item: str = "icon_id", chosen: DataFrame | None = None) -> DataFrame:
    """(qid, the items' columns but for the vectors, cosine, prior, probability, score): each query's best ``k`` of each task.

    ``queries``: qid, embedding and, for a weight above 0, predictions; ``items`` then has aux_class and name_tokens.
    ``chosen`` (qid, shard) restricts a query to some shards. The best of all tasks remain to be merged.
    """
    count, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    packed = packed_queries(queries if weight > 0 else queries.select("qid", "embedding"), count)
    blocks = packed_items(items, item, k, weight == 0)
    number, each = max(1, -(-count // BLOCK_QUERIES)), max(1, MOST_BYTES // (4 * max(dim, 1) * BLOCK_QUERIES))
    parts = []
    for lo in range(0, number, each):
        part = F.broadcast(packed.where(F.col("block").between(lo, lo + each - 1)))  # their vectors have MOST_BYTES, give or take
        if chosen is None:
            pairs = blocks.withColumn("block", F.explode(F.sequence(F.lit(lo), F.lit(min(lo + each, number) - 1)))).withColumn("slots", F.lit(None).cast("array<int>"))
        else:
            pairs = blocks.join(_wanted(packed, chosen, lo, lo + each - 1), "shard")
        parts.append(_scored(pairs.join(part, "block"), items, queries, k, weight, item))
    return reduce(DataFrame.unionByName, parts)


def _wanted(packed: DataFrame, chosen: DataFrame, first: int, last: int) -> DataFrame:
    """(shard, block, slots): the places in its block of each query that wants a shard."""
    places = packed.where(F.col("block").between(first, last)).select("block", F.posexplode("queries.qid").alias("slot", "qid"))
    return chosen.select("qid", "shard").distinct().join(places, "qid").groupBy("shard", "block").agg(F.collect_list("slot").alias("slots"))


def _scored(pairs: DataFrame, items: DataFrame, queries: DataFrame, k: int, weight: float, item: str) -> DataFrame:
    vector = "codes" if "codes" in items.columns else "embedding"
    kind = _KINDS[items.schema[vector].dataType.elementType]
    payload = [f for f in items.schema.fields if f.name not in ("embedding", "codes", "scale")]
    numbers = ["score", "cosine", "prior", "probability"]
    schema = T.StructType([queries.schema["qid"], *payload, *[T.StructField(c, T.DoubleType()) for c in numbers]])

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, _Block] = {}
        qid = None
        for batch in batches:
            qid = batch.schema.field("queries").type.value_type.field("qid").type
            for i in range(batch.num_rows):
                block = batch.column("block")[i].as_py()
                if block not in known:
                    known[block] = _Block(batch.column("queries")[i].as_py(), k, weight, item)
                size, slots = batch.column("size")[i].as_py(), batch.column("slots")[i].as_py()
                vectors = np.frombuffer(batch.column("vectors")[i].as_buffer(), kind).reshape(size, -1)
                known[block].meet(vectors, np.frombuffer(batch.column("scales")[i].as_buffer(), np.float32), batch.column("payload")[i].values, None if slots is None else np.array(sorted(slots)))
        for found in known.values():
            if found.payload is not None:
                ids = pa.array([found.qids[int(s)] for s in found.numbers[0]], qid)
                columns = [ids, *[found.payload.field(f.name) for f in payload], *[pa.array(x) for x in found.numbers[1:]]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return pairs.select("block", "slots", "vectors", "scales", "size", "payload", "queries").mapInArrow(kept, schema)
