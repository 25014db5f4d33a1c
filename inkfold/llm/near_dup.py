"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

Signatures. A document is its set of distinct 5-word shingles (A-Z lower-cased; a shorter text is one shingle of
all its words). ``COLLECTIONS`` small collections of ``WIDTH`` minhashes each are computed, and each *pair* of
collections is the key of one table: 16 collections give 120 tables from 32 minhashes, where plain banding would
need 480. Two documents meet if two collections agree; at a similarity of 0.75 that fails once in 25,000.

Candidates. Equal sets (by two fingerprints of 64 bits) are one class, and only one row per class is banded. Each Arrow batch sorts its own keys
first. A key with more than ``LEADERS`` rows there proposes its rows only to the most central ones (those that
agree best with the consensus of the rows' minhashes), and passes only these on, so a group of copies of any size
reaches the shuffle as a few rows per batch. After the shuffle the same happens once more for each key; rows of a
key that a batch has cut say so (``CUT``), and its pairs count as a crowd's however few of its rows arrive.

Confirmation. Each class is first compared with its best candidate, then only those pairs whose ends are still in
different components: a component needs a spanning tree, not all its links. Every link is confirmed on full sets.

The rest. If every row of a crowded key ends in one component with its leader, the pairs not proposed there could
add nothing. The others (``rest_nodes``) are compared once more, crowd by crowd in pairs of blocks (``rest_links``).
Leaders save work but lose no pair; only a crowd of many documents that are nearly but not quite alike costs the
square of its size, in comparisons that never leave a task.

Components. Links are contracted to the smallest label around until none is left; each round writes a table to the
shared folder.

Cases: null texts, empty texts and texts without words have an empty set, no link, and are components of their
own; a null doc_id is no node: its component is null and it is kept; rows that repeat a doc_id with the same text
are one node, with another text they share the component of every text under that id; an empty table gives an
empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sealed, partitions, settled, sliced, small, stored, text_key, with_key
from .kernels import Words, blocks, grams, mix

SHINGLE = 5
COLLECTIONS, WIDTH = 16, 2
LEADERS = 3
BLOCK_ITEMS = 400_000
#: Keys (of 13 bytes) that meet in one bucket, some 300 MB with what a task needs to pair them; the number of buckets
#: follows the classes.
BUCKET_KEYS = 4_000_000
#: A pair goes on to confirmation if so many of the 32 minhashes agree; at 0.75, 24 do on average.
LEAST_AGREEING = 12
#: The bit of a score, of 32 at most, that says that a batch kept rows of the key back.
CUT = np.uint8(0x80)

_rng = np.random.Generator(np.random.PCG64(11))
_A = _rng.integers(0, 2**63, COLLECTIONS * WIDTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COLLECTIONS * WIDTH, dtype=np.uint64)
_I, _J = np.triu_indices(COLLECTIONS, 1)
_TABLE = _rng.integers(0, 2**63, len(_I), dtype=np.uint64)


SIGNED = "doc_id long, th long, n_shingles long, f1 long, f2 long, sig binary"
PAIRS = "a long, b long"


def shingle_sets(texts: list) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    for _, raw in blocks(texts):
        w = Words(raw, lower=True)
        g = grams(w.hashes, SHINGLE)
        for lo, hi in zip(w.first[:-1], w.first[1:]):
            if hi - lo >= SHINGLE:
                yield np.unique(g[lo : hi - SHINGLE + 1])
            elif hi > lo:
                yield grams(w.hashes[lo:hi], int(hi - lo))
            else:
                yield np.empty(0, np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """COLLECTIONS x WIDTH minhashes of a set, as uint32."""
    out = np.full(len(_A), 2**64 - 1, dtype=np.uint64)
    for lo in range(0, len(s), 4096):
        np.minimum(out, (s[lo : lo + 4096, None] * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def signed(docs: DataFrame) -> DataFrame:
    """Size, fingerprint and minhashes of each document's set; nulls where the set is empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n, f1, f2, sig = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                n.append(len(s))
                if len(s):
                    f1.append(int(mix(s ^ np.uint64(0xA5A5)).sum().astype(np.int64)))
                    f2.append(int(mix(s ^ np.uint64(0x5A5A)).sum().astype(np.int64)))
                    sig.append(signature(s).tobytes())
                else:
                    f1.append(None), f2.append(None), sig.append(None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "th", "n_shingles", "f1", "f2", "sig"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text").mapInArrow(rows, SIGNED)


def _led(keys: np.ndarray, nodes: np.ndarray, score: np.ndarray, most: int, cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that share a key -> pairs of rows (left, right), which of them come from crowded keys, and which rows to pass on.

    Keys with up to ``most`` + 1 rows give all their pairs; others pair each row with the ``most`` first ones by
    (score, node) and pass only these on. A key with a row marked in ``cut`` is crowded whatever its size here. Rows
    are positions in the arrays.
    """
    order = np.lexsort((nodes, -score.astype(np.int16), keys))
    k = keys[order]
    new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
    start = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    rank = np.arange(len(k)) - start[group] if len(k) else np.empty(0, int)
    size = np.diff(np.concatenate((start, [len(k)])))
    crowded = size > most + 1
    if cut is not None and len(k):
        crowded |= np.logical_or.reduceat(cut[order], start)
    left, right, crowd = [], [], []
    for step in range(most):  # each row with the step-th of its key
        at = np.flatnonzero(rank > step)
        left.append(order[at])
        right.append(order[start[group[at]] + step])
        crowd.append(crowded[group[at]])
    keep = np.zeros(len(k), dtype=bool)
    keep[order[(rank < most) | (size[group] <= most + 1)]] = True
    return np.concatenate(left), np.concatenate(right), np.concatenate(crowd), keep


def _distinct(a: np.ndarray, b: np.ndarray, crowd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order, and whether any of their equals comes from a crowded key."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((~crowd, hi, lo))
    lo, hi, crowd = lo[order], hi[order], crowd[order]
    first = np.ones(len(lo), dtype=bool)
    first[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    first &= lo != hi
    return lo[first], hi[first], crowd[first]


def _agreement(sigs: np.ndarray, keys: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """For rows of crowded keys, how many minhashes agree with the consensus of the key's rows (0 elsewhere)."""
    score = np.zeros(len(keys), dtype=np.uint8)
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, int)
    size = np.diff(np.concatenate((start, [len(k)])))
    for lo, n in zip(start[size > most + 1], size[size > most + 1]):
        at = order[lo : lo + n]
        s = np.sort(sigs[row[at]], axis=0)
        # the most frequent value of each sorted column: the longest step that still finds equal ends
        best = s[n // 2]
        run = np.zeros(s.shape[1], int)
        for c in range(s.shape[1]):
            edges = np.flatnonzero(np.concatenate(([True], s[1:, c] != s[:-1, c], [True])))
            j = int(np.argmax(np.diff(edges)))
            best[c], run[c] = s[edges[j], c], edges[j + 1] - edges[j]
        score[at] = (sigs[row[at]] == best).sum(axis=1)
    return score


def table_keys(sigs: np.ndarray) -> np.ndarray:
    """The key of each of the 120 tables, for rows of minhashes."""
    halves = sigs.astype(np.uint64).reshape(len(sigs), COLLECTIONS, WIDTH)
    whole = np.zeros(halves.shape[:2], dtype=np.uint64)
    for c in range(WIDTH):
        whole = mix(whole * np.uint64(31) + halves[:, :, c] + np.uint64(1))
    return mix(whole[:, _I] * np.uint64(3) + whole[:, _J] + _TABLE)


def candidates(classes: DataFrame, buckets: int, most: int = LEADERS) -> DataFrame:
    """(a, b, crowd): pairs of classes (by f1) that share the key of a table; crowded keys pair their rows with leaders."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4000):
                batch = whole.slice(lo, 4000)
                nodes = batch.column("f1").to_numpy(zero_copy_only=False)
                sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint32).reshape(len(nodes), -1)
                keys = table_keys(sigs).ravel()
                row = np.repeat(np.arange(len(nodes), dtype=np.int32), len(_I))
                score = _agreement(sigs, keys, row, most)
                left, right, crowd, keep = _led(keys, nodes[row], score, most)
                score[np.concatenate((left[crowd], right[crowd]))] |= CUT
                # the pairs of other keys meet again after the shuffle
                a, b, _ = _distinct(row[left[crowd]], row[right[crowd]], crowd[crowd])
                bucket = (keys[keep] >> np.uint64(40)) % np.uint64(buckets)
                order = np.argsort(bucket, kind="stable")
                at = np.searchsorted(bucket[order], np.arange(buckets + 1))
                k32, n64, sc = keys[keep][order].astype(np.uint32), nodes[row[keep]][order], score[keep][order]
                out = [[], [], [], [], [], []]
                for i in range(buckets):
                    if at[i + 1] > at[i]:
                        s = slice(at[i], at[i + 1])
                        for column, value in zip(out, (i, k32[s].tobytes(), n64[s].tobytes(), sc[s].tobytes(), b"", b"")):
                            column.append(value)
                if len(a):
                    for column, value in zip(out, (int(nodes[a[0]]) % buckets, b"", b"", b"", nodes[a].tobytes(), nodes[b].tobytes())):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(c, pa.binary()) for c in out[1:])], names=["bucket", "keys", "nodes", "scores", "a", "b"])

    def meet(table: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=kind)
        keys, nodes, score = read("keys", np.uint32), read("nodes", np.int64), read("scores", np.uint8)
        left, right, crowd, _ = _led(keys, nodes, score & ~CUT, most, score >= CUT)
        a, b = read("a", np.int64), read("b", np.int64)
        a, b, crowd = _distinct(np.concatenate((nodes[left], a)), np.concatenate((nodes[right], b)), np.concatenate((crowd, np.ones(len(a), bool))))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(crowd, pa.bool_())], names=["a", "b", "crowd"])

    rows = classes.select("f1", "sig").mapInArrow(spread, "bucket int, keys binary, nodes binary, scores binary, a binary, b binary")
    return rows.groupBy("bucket").applyInArrow(meet, "a long, b long, crowd boolean")


def _agreeing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs with the number of minhashes that agree, or -1 if their sizes rule the similarity out."""
    a = classes.select(F.col("f1").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sig").alias("sig_a"))
    b = classes.select(F.col("f1").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sig").alias("sig_b"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_sigs(batch, "sig_a") == _sigs(batch, "sig_b")).sum(axis=1)
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            agree[100 * np.minimum(n_a, n_b) < 75 * np.maximum(n_a, n_b)] = -1
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("crowd"), pa.array(agree, pa.int32())], names=["a", "b", "crowd", "agree"])

    once = pairs.groupBy("a", "b").agg(F.max("crowd").alias("crowd"))
    return once.join(a, "a").join(b, "b").mapInArrow(counted, "a long, b long, crowd boolean, agree int")


def _sigs(batch, name: str = "sig") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, len(_A))


def _with_labels(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("l_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("l_b"))
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(F.coalesce("l_a", "a") != F.coalesce("l_b", "b")).drop("l_a", "l_b")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(f1, whole set) of the wanted classes, from the text of one document each."""
    want = wanted.select(F.col("rep.doc_id").alias("w_id"), F.col("rep.th").alias("w_th"), "f1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("th"), "text")
    found = texts.join(want.hint("shuffle_hash"), (texts["doc_id"] == want["w_id"]) & (texts["th"] == want["w_th"])).select("f1", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = [s.tobytes() for s in shingle_sets(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("f1"), pa.array(got, pa.binary())], names=["f1", "items"])

    # a repeated row would come twice
    return found.mapInArrow(sets, "f1 long, items binary").dropDuplicates(["f1"])


def _similar(u: np.ndarray, v: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= 75 * union."""
    at = np.searchsorted(u, v)
    at[at == len(u)] = 0
    both = int((u[at] == v).sum())
    return 100 * both >= 75 * (len(u) + len(v) - both)


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with 100 * intersection >= 75 * union, on full sets."""

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keep = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                keep.append(_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = sets.select(F.col("f1").alias("a"), F.col("items").alias("x")), sets.select(F.col("f1").alias("b"), F.col("items").alias("y"))
    return pairs.select("a", "b").join(x, "a").join(y, "b").mapInArrow(alike, PAIRS)


def rest_nodes(proposed: DataFrame, labels: DataFrame) -> DataFrame:
    """(f1, label, crowd) of the classes that crowded keys may have kept from a partner in another component.

    The rows of a crowded key hang together by its pairs with leaders; what hangs together by such pairs is a crowd.
    Two rows of a key lie in different components only if a pair between them is broken, and then both components
    have a broken pair; crowds without one need no second look.
    """
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("l_a")), labels.select(F.col("node").alias("b"), F.col("label").alias("l_b"))
    named = stored(proposed.where("crowd").join(la, "a", "left").join(lb, "b", "left").select("a", "b", F.coalesce("l_a", "a").alias("l_a"), F.coalesce("l_b", "b").alias("l_b")))
    broken = named.where("l_a <> l_b")
    open_labels = stored(broken.select(F.col("l_a").alias("label")).union(broken.select("l_b")).distinct())
    a, b = open_labels.select(F.col("label").alias("l_a")), open_labels.select(F.col("label").alias("l_b"))
    inside = stored(named.join(a, "l_a", "left_semi").join(b, "l_b", "left_semi").select("a", "b", "l_a", "l_b"))
    if inside.isEmpty():
        return inside.select(F.col("a").alias("f1"), F.col("l_a").alias("label"), F.col("b").alias("crowd"))
    crowds = components(inside.select("a", "b")).withColumnRenamed("label", "crowd").withColumnRenamed("node", "f1")
    ends = inside.select(F.col("a").alias("f1"), F.col("l_a").alias("label")).union(inside.select("b", "l_b")).distinct()
    return ends.join(crowds, "f1").select("f1", "label", "crowd")


def rest_links(rest: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Every link between different components of a crowd, on full sets.

    A crowd is cut into blocks of about BLOCK_ITEMS shingles and each pair of blocks is compared in one task: first
    sizes and minhashes, then the sets. Only links leave the task.
    """

    def compared(table: pa.Table) -> pa.Table:
        read = lambda c: table.column(c).to_numpy()
        nodes, n, label, block = read("f1"), read("n_shingles"), read("label"), read("block")
        sigs, items = _sigs(table), table.column("items").to_pylist()
        first = np.flatnonzero(block == block.min())
        second = np.flatnonzero(block == block.max())
        a, b = [], []
        for lo in range(0, len(first), 256):
            i = first[lo : lo + 256]
            agree = np.zeros((len(i), len(second)), dtype=np.uint8)
            for c in range(sigs.shape[1]):
                agree += sigs[i, c][:, None] == sigs[None, second, c]
            apart = label[i][:, None] != label[second][None, :]
            fit = 100 * np.minimum(n[i][:, None], n[second][None, :]) >= 75 * np.maximum(n[i][:, None], n[second][None, :])
            ordered = nodes[i][:, None] < nodes[second][None, :] if len(first) == len(table) else True
            for x, y in zip(*np.nonzero(apart & fit & ordered & (agree >= LEAST_AGREEING))):
                x, y = i[x], second[y]
                if _similar(np.frombuffer(items[x], np.uint64), np.frombuffer(items[y], np.uint64)):
                    a.append(min(nodes[x], nodes[y])), b.append(max(nodes[x], nodes[y]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    rows = rest.join(classes.select("f1", "n_shingles", "sig"), "f1")
    # a crowd within one component, or of a single class, has nothing to add
    cut = rows.groupBy("crowd").agg(F.ceil(F.sum("n_shingles") / BLOCK_ITEMS).cast("int").alias("blocks"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").drop("lo", "hi")
    rows = rows.join(cut, "crowd").withColumn("block", F.pmod(F.xxhash64("f1"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("crowd", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "f1", "label", "n_shingles", "sig").join(sets, "f1")
    return rows.groupBy("crowd", "i", "j").applyInArrow(compared, PAIRS)


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node with a link; the label is the smallest node of its component.

    Each round every node takes the smallest node around it, and that one's, as its label, and links move to the
    labels of their ends. Links within a label vanish, so each round has fewer; none are left when the labels are
    the components. The rounds' steps are then joined from the last to the first, so that only the last join has all
    nodes; labels that many nodes share go by broadcast.
    """
    edges = stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    hops = []
    while not hops or not edges.isEmpty():
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("near"))
        far = near.select(F.col("a").alias("near"), F.col("near").alias("far"))
        hops.append(stored(near.join(far, "near").select(F.col("a").alias("node"), F.col("far").alias("label"))))
        at, to = hops[-1].select(F.col("node").alias("a"), F.col("label").alias("x")), hops[-1].select(F.col("node").alias("b"), F.col("label").alias("y"))
        edges = stored(edges.join(at, "a").join(to, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    labels = hops.pop()
    for hop in reversed(hops):
        on = labels.select(F.col("node").alias("label"), F.col("label").alias("last"))
        labels = stored(with_key(hop, on, ["label"]).select("node", F.coalesce("last", "label").alias("label")))
    return labels


def told_apart(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``marked``, with f1 a number of the set alone, and its classes, a row for each different set.

    Sets are the same if both fingerprints agree, 128 bits. Where sets with another f2 share their f1, all but the one
    with the smallest f2 take another f1.
    """

    def classes() -> DataFrame:
        nodes = marked.where(F.col("doc_id").isNotNull() & F.col("f1").isNotNull())
        return stored(nodes.groupBy("f1").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"), F.min("f2").alias("f2"), F.max("f2").alias("last_f2")))

    found = classes()
    shared = small(stored(found.where("f2 <> last_f2").select(F.col("f1").alias("s_f1"), F.col("f2").alias("s_f2"))))
    if not shared.isEmpty():
        other = F.when(F.col("f2") != F.col("s_f2"), F.xxhash64("f1", "f2")).otherwise(F.col("f1"))
        marked = stored(marked.join(shared, F.col("f1") == F.col("s_f1"), "left").withColumn("f1", other).drop("s_f1", "s_f2"))
        found = classes()
    return marked, found.drop("f2", "last_f2")


def near_duplicates(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, th (hash of the text), n_shingles, component_id, kept."""
    marked, classes = told_apart(stored(signed(docs)))
    buckets = buckets or max(32, 2 * partitions(docs.sparkSession), -(-classes.count() * len(_I) // BUCKET_KEYS))
    nodes = marked.where(F.col("doc_id").isNotNull() & F.col("f1").isNotNull())
    proposed = stored(_agreeing(candidates(classes, buckets), classes))
    alike = proposed.where(F.col("agree") >= LEAST_AGREEING)
    ends = alike.select(F.col("a").alias("f1")).union(alike.select("b")).distinct()
    sets = stored(full_sets(docs, classes.join(ends, "f1").select("f1", "rep")))

    # first, each class with the candidate that agrees best
    either = alike.select(F.col("a").alias("node"), "agree", "a", "b").union(alike.select(F.col("b"), "agree", "a", "b"))
    best = either.groupBy("node").agg(F.max(F.struct("agree", "a", "b")).alias("m")).select("m.a", "m.b").distinct()
    links = stored(confirmed(best, sets))
    labels = components(links)
    # then all pairs whose ends are not together yet
    links = stored(confirmed(_with_labels(alike, labels), sets).unionByName(links))
    labels = components(links)
    # then what the leaders of crowded keys left out
    rest = stored(rest_nodes(proposed, labels))
    if not rest.isEmpty():
        ends = rest.select("f1").join(sets, "f1", "left_anti")
        sets = sets.unionByName(stored(full_sets(docs, classes.join(ends, "f1").select("f1", "rep"))))
        links = stored(rest_links(rest, classes, sets).unionByName(links))
    # one more kind of link: the texts of one doc_id
    own = nodes.select("doc_id", "f1").groupBy("doc_id").agg(F.min("f1").alias("a"), F.max("f1").alias("b")).where("a < b")
    shared = nodes.select("doc_id", "f1").join(own.select("doc_id", "a"), "doc_id").select("a", F.col("f1").alias("b")).where("a < b")
    labels = components(links.unionByName(shared.distinct()))

    lowest = labels.join(classes.select(F.col("f1").alias("node"), F.col("rep.doc_id").alias("rep_id")), "node").groupBy("label").agg(F.min("rep_id").alias("component_id"))
    linked = with_key(labels, lowest, ["label"]).select(F.col("node").alias("f1"), "component_id")
    by_class = classes.select("f1", F.col("rep.doc_id").alias("rep_id")).join(linked, "f1", "left").select("f1", F.coalesce("component_id", "rep_id").alias("component_id"))
    # the copies of a text share their class: a large group goes by broadcast
    out = with_key(marked.select("doc_id", "th", "n_shingles", "f1"), stored(by_class), ["f1"])
    own_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "th", "n_shingles", own_id.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without all but one row of each component; rows without doc_id stay."""
    judged = settled(lambda: near_duplicates(docs.select("doc_id", "text")), docs.sparkSession).where(F.col("doc_id").isNotNull())
    stays = judged.where("kept").groupBy(F.col("doc_id").alias("s_id")).agg(F.min("th").alias("s_th"), F.count("*").alias("n"))
    pairs = judged.select("doc_id", "th").distinct()
    gone = stored(pairs.join(stays, (F.col("doc_id") == F.col("s_id")) & F.col("th").eqNullSafe(F.col("s_th")), "left_anti").select(F.col("doc_id").alias("g_id"), F.col("th").alias("g_th")))
    sealed = Sealed(docs)
    keyed = sealed.df.withColumns({"id": sealed["doc_id"].cast("long"), "th": F.xxhash64(sealed["text"])})
    left = keyed.join(gone, (F.col("id") == F.col("g_id")) & F.col("th").eqNullSafe(F.col("g_th")), "left_anti")
    again = small(stored(stays.where("n > 1").select("s_id")))
    if again.isEmpty():
        return left.select(*sealed.back())
    # repeated rows of a document that stays: one is enough
    names = sealed.df.columns
    repeats = left.join(again, F.col("id") == F.col("s_id"), "left_semi")
    comparable = [c for c, kind in sealed.df.dtypes if "map<" not in kind and kind != "variant"]
    one = repeats.groupBy("id").agg(F.min_by(F.struct(*names), F.xxhash64(*comparable)).alias("row")).select("row.*")
    return left.join(again, F.col("id").eqNullSafe(F.col("s_id")), "left_anti").select(*names).unionByName(one).select(*sealed.back())
