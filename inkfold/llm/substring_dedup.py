"""Removal of long exact repeats by fixed-block anchors.

A repeat of ``window`` words holds at least one of the ``window // 2`` word blocks that start at a multiple of
their length, wherever it lies in the document that has it first. So:

1. Documents are dealt into packs of about 8 MB by a hash of the row, compressed by pack, equal rows of a batch only
   once; this one exchange of texts is used by all three passes (Spark reuses it). Each pack hashes all its rolling windows of one block, marks those that are
   aligned blocks (the index), and sends each distinct hash once, as 30 bits and two flags, to its bucket.
2. A bucket answers a pack with those of its hashes that hit: aligned in some document, and found in two.
3. Packs extend the hits: every full window around a hit goes as a fingerprint of 96 bits with the smallest doc_id
   that has it in the pack to another bucket, which answers with the smallest doc_id of all. A window whose smallest doc_id lies before its own document is a repeat; overlapping repeats join into
   maximal spans, which are cut out.

Nothing is emitted per pair of occurrences: a passage found in a third of all documents is one hash per pack.
A bucket holds about four million hashes, and the number of buckets follows the input.

Cases: null texts and texts of fewer than ``window`` words lose nothing; a null doc_id counts as larger than all
others but the largest number there is, so that such a document loses what any document with another id has and takes nothing from others; rows that
share a doc_id take nothing from each other; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_time, packed, partitions, unpacked
from .kernels import Words, blocks, covered, gram_mask, grams, mix, sums

WINDOW = 50
PACK_BYTES = 8 << 20
BUCKET_WORDS = 4_000_000
NO_ID = 2**63 - 1
RESULT = "doc_id long, n_words long, n_removed long, removed array<struct<start: int, end: int>>, kept_text string, times long"
_KINDS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
_PRINTS = [("prints", np.uint64), ("more", np.uint32), ("owners", np.int64)]


class _Part:
    """A few MB of a pack: ids, words and which rolling windows of either length lie in one long enough text."""

    def __init__(self, ids: np.ndarray, raw: list[bytes], window: int):
        self.ids, self.words = ids, Words(raw)
        w = self.words
        self.block = window // 2
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int64), w.counts)
        self.long = (w.counts >= window)[self.doc]

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of rolling blocks, their hashes, and which are aligned."""
        w = self.words
        g = grams(w.hashes, self.block)
        at = np.flatnonzero(gram_mask(w.first, self.block, len(g)) & self.long[: len(g)])
        return at, g[at], (at - w.first[self.doc[at]]) % self.block == 0

    def windows(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions of full windows and two independent hashes of them."""
        w = self.words
        g = grams(w.hashes, window)
        at = np.flatnonzero(gram_mask(w.first, window, len(g)))
        return at, g[at], grams(mix(w.hashes ^ np.uint64(0x5851F42D4C957F2D)), window)[at]


def _parts(table: pa.Table, window: int):
    ids = table.column("doc_id").fill_null(NO_ID).to_numpy()
    texts = table.column("text").to_pylist()
    for at, raw in blocks(texts):
        yield _Part(ids[at : at + len(raw)], raw, window)


def _least(prints: np.ndarray, more: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest owner of each row's window (both hashes), and the first row of each window that has it."""
    order = np.lexsort((owners, more, prints))
    p, m = prints[order], more[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (p[1:] != p[:-1]) | (m[1:] != m[:-1])
    least = np.empty(len(order), dtype=np.int64)
    least[order] = owners[order[new]][np.cumsum(new) - 1] if len(order) else least
    return least, order[new]


def _sent(key: str, keys: list, columns: list[list[np.ndarray]], bucket: str = "", buckets: list = ()) -> pa.Table:
    """A row of blobs for each key."""
    out = {key: pa.array(keys, pa.int32())} | ({bucket: pa.array(buckets, pa.int32())} if bucket else {})
    for i, (name, _) in enumerate(_PRINTS):
        out[name] = pa.array([c[i].tobytes() for c in columns], pa.binary())
    return pa.table(out)


def _dealt(bucket: np.ndarray, buckets: int, *columns: np.ndarray):
    """(bucket, its slices of the columns), in the order of the rows."""
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    columns = [c[order] for c in columns]
    for i in np.flatnonzero(np.diff(at)):
        yield int(i), [c[at[i] : at[i + 1]] for c in columns]


def _joined(table: pa.Table, name: str, kind) -> tuple[np.ndarray, np.ndarray]:
    """The blobs of a column as one array, and the row of each item."""
    got = [np.frombuffer(x, kind) for x in table.column(name).to_pylist()]
    if not got:
        return np.empty(0, kind), np.empty(0, np.int64)
    return np.concatenate(got), np.repeat(np.arange(len(got)), [len(x) for x in got])


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    return np.flatnonzero(np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1]))) if len(sorted_keys) else np.empty(0, np.int64)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, the removed spans of words and the kept text."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    packs, buckets = max(2 * n, size // PACK_BYTES), max(2 * n, size // (5 * BUCKET_WORDS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    dealt = packed(texts.withColumn("pack", F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs)).cast("int")), n)
    block = window // 2

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        hashes, flags = [np.empty(0, np.uint64)], [np.empty(0, np.uint8)]
        text = [np.empty(0, np.int64)]
        for k, part in enumerate(_parts(unpacked(table, _KINDS), window)):
            at, h, aligned = part.anchors()
            hashes.append(h), flags.append(aligned.astype(np.uint8) * 2), text.append(part.doc[at] + (k << 32))
        h, f, t = map(np.concatenate, (hashes, flags, text))
        order = np.argsort(h, kind="stable")
        h, f, t = h[order], f[order], t[order]
        first = _groups(h)
        if not len(first):
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.binary())], names=["bucket", "pack", "items"])
        flag = np.bitwise_or.reduceat(f, first) | (np.maximum.reduceat(t, first) != np.minimum.reduceat(t, first))
        h = h[first]
        item = (h >> np.uint64(34)).astype(np.uint32) << np.uint32(2) | flag.astype(np.uint32)
        rows = [(i, c[0].tobytes()) for i, c in _dealt((h % np.uint64(buckets)).astype(np.int64), buckets, item)]
        return pa.table([pa.array([i for i, _ in rows], pa.int32()), pa.array([key[0].as_py()] * len(rows), pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["bucket", "pack", "items"])

    def hit(key: tuple, table: pa.Table) -> pa.Table:
        item, row = _joined(table, "items", np.uint32)
        h = item >> np.uint32(2)
        order = np.argsort(h, kind="stable")
        first = _groups(h[order])
        flags = (item & np.uint32(3))[order]
        many = np.diff(np.concatenate((first, [len(h)]))) > 1
        found = np.bitwise_or.reduceat(flags, first) if len(first) else np.empty(0, np.uint32)
        good = np.zeros(len(h), dtype=bool)
        good[order] = np.repeat((found >= 2) & (many | (found & 1 == 1)), np.diff(np.concatenate((first, [len(h)]))))
        packs_of = table.column("pack").to_pylist()
        got = [(packs_of[i], c[0].tobytes()) for i, c in _dealt(row[good], len(packs_of), h[good])]
        return pa.table([pa.array([p for p, _ in got], pa.int32()), pa.array([key[0].as_py()] * len(got), pa.int32()), pa.array([x for _, x in got], pa.binary())], names=["pack", "bucket", "hits"])

    def extend(key: tuple, table: pa.Table, hits: pa.Table) -> pa.Table:
        known, row = _joined(hits, "hits", np.uint32)
        bucket_of = hits.column("bucket").to_numpy().astype(np.uint64) if hits.num_rows else np.empty(0, np.uint64)
        known = np.sort(bucket_of[row] << np.uint64(30) | known.astype(np.uint64))
        prints, deals, owners = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for part in _parts(unpacked(table, _KINDS), window) if len(known) else ():
            at, h, _ = part.anchors()
            mine = (h % np.uint64(buckets)) << np.uint64(30) | (h >> np.uint64(34))
            at = at[known[np.minimum(np.searchsorted(known, mine), len(known) - 1)] == mine]
            near = np.zeros(len(part.words.hashes) + 1, dtype=np.int32)  # windows that hold a hit
            np.add.at(near, np.maximum(at - (window - block), 0), 1)
            np.add.at(near, at + 1, -1)
            full, fp, deal = part.windows(window)
            take = np.cumsum(near)[full] > 0
            prints.append(fp[take]), deals.append(deal[take]), owners.append(part.ids[part.doc[full[take]]])
        fp, deal, own = map(np.concatenate, (prints, deals, owners))
        more = (deal >> np.uint64(32)).astype(np.uint32)
        keep = np.sort(_least(fp, more, own)[1])  # in the order of the texts again, where owners come in runs
        rows = list(_dealt((deal[keep] % np.uint64(buckets)).astype(np.int64), buckets, fp[keep], more[keep], own[keep]))
        return _sent("bucket", [i for i, _ in rows], [c for _, c in rows], "pack", [key[0].as_py()] * len(rows))

    def judge(key: tuple, table: pa.Table) -> pa.Table:
        row = _joined(table, "prints", np.uint64)[1]
        fp, more, own = (_joined(table, name, kind)[0] for name, kind in _PRINTS)
        least, _ = _least(fp, more, own)
        late = least < own
        packs_of = table.column("pack").to_pylist()
        rows = list(_dealt(row[late], len(packs_of), fp[late], more[late], least[late]))
        return _sent("pack", [packs_of[i] for i, _ in rows], [c for _, c in rows])

    def cut(key: tuple, table: pa.Table, known: pa.Table) -> pa.Table:
        table = unpacked(table, _KINDS)
        prints, more, owners = ([_joined(known, name, kind)[0]] for name, kind in _PRINTS)
        parts, places = list(_parts(table, window)), []
        for part in parts:
            at, fp, deal = part.windows(window)
            places.append(at), prints.append(fp), more.append((deal >> np.uint64(32)).astype(np.uint32)), owners.append(part.ids[part.doc[at]])
        least, _ = _least(*map(np.concatenate, (prints, more, owners)))
        ends = np.cumsum([len(p) for p in prints])
        out: list[list] = [[], [], [], []]
        for k, (part, at) in enumerate(zip(parts, places)):
            w = part.words
            marks = np.zeros(len(w.hashes), dtype=bool)
            marks[at[least[ends[k] : ends[k + 1]] < part.ids[part.doc[at]]]] = True
            gone = covered(marks, window, len(w.hashes))
            lost = sums(gone, w.first)
            for i in range(len(part.ids)):
                lo, hi = w.first[i], w.first[i + 1]
                raw = w.buffer[w.text_starts[i] : w.text_starts[i + 1] - 1]
                spans = []
                if lost[i]:
                    turn = np.flatnonzero(np.diff(np.concatenate(([0], gone[lo:hi].astype(np.int8), [0]))))
                    spans = [{"start": int(a), "end": int(b)} for a, b in zip(turn[0::2], turn[1::2])]
                    edges = [0, *(x for s in spans for x in (s["start"], s["end"])), int(hi - lo)]
                    raw = b" ".join(w.buffer[w.starts[lo + a] : w.ends[lo + b - 1]] for a, b in zip(edges[0::2], edges[1::2]) if b > a)
                for column, value in zip(out, (int(hi - lo), int(lost[i]), spans, b" ".join(raw.split()).decode("utf-8", "replace"))):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]
        return pa.table([table.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds)), table.column("times")], names=["doc_id", "n_words", "n_removed", "removed", "kept_text", "times"])

    hits = dealt.groupBy("pack").applyInArrow(probe, "bucket int, pack int, items binary").groupBy("bucket").applyInArrow(hit, "pack int, bucket int, hits binary")
    spread = dealt.groupBy("pack").cogroup(hits.repartition(n, "pack").groupBy("pack")).applyInArrow(extend, "bucket int, pack int, prints binary, more binary, owners binary")
    late = spread.groupBy("bucket").applyInArrow(judge, "pack int, prints binary, more binary, owners binary")
    return each_time(dealt.groupBy("pack").cogroup(late.repartition(n, "pack").groupBy("pack")).applyInArrow(cut, RESULT))
