"""Toxicity by a counterfactual-regularised logistic model over the presence of words.

Fit. A bounded sample of labelled documents (``PER_CLASS`` of each label, by a hash of doc_id) is reduced to hashed
word sets on the executors, and a sparse logistic model is fitted on the driver: proximal gradient steps select few
words, a second fit on those sets their weights. Counterfactuals: each labelled text that names a group is built
again ``SWAPS`` times with all its identity terms swapped for others of their kinds, and once without them, and the mean
squared change of its score is penalised, so that the model can't learn from a mention alone, nor which group is named.
Terms that the sample has rarely or never stand for a text of their own, with little weight.

Score. The weights (``2^FEATURE_BITS`` floats, a fixed size) go to the executors; every whole text is scored in one
pass without a shuffle.

Cases: null and empty texts get the score of no words; null, missing and other labels than 0 and 1 are not
learned from, and the larger label counts where a doc_id has several; without labels of both kinds every score is
0; repeated rows get equal scores; a null doc_id is scored and never learned from; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced
from .kernels import SPACE, Words, blocks, mix

FEATURE_BITS = 20
#: Besides whole words, their first bytes are features, so that forms of a word help each other.
PREFIXES = (6, 8)
PER_CLASS = 3000
THRESHOLD = 0.7
#: Swapped versions of a text; the weight of a term's own text beside the mean over the sample's.
SWAPS, RARE = 4, 1e-3

#: Identity terms by kind; those of a kind are swapped for each other.
IDENTITY = {
    "gender": "women men woman man girls boys female male trans frauen männer femmes hommes mujeres hombres".split(),
    "faith": "muslims christians jews hindus buddhists atheists muslim christian jewish hindu buddhist atheist".split(),
    "origin": "black white asian african european american mexican chinese indian arab immigrants refugees".split(),
    "orientation": "gay lesbian straight bisexual queer homosexual heterosexual".split(),
    "ability": "disabled blind deaf autistic".split(),
}

# letters of any script; ASCII other than letters separates words
_BREAK = SPACE.copy()
_BREAK[:128] = True
_BREAK[65:91] = False
_BREAK[97:123] = False


def _hashed(w: Words) -> np.ndarray:
    """A row of features for the words and one for each length of prefix."""
    shift = np.uint64(64 - FEATURE_BITS)
    return np.stack([w.hashes >> shift, *(mix(w.prefixes(n) + np.uint64(n)) >> shift for n in PREFIXES)]).astype(np.int32)


#: Hash of a term -> its kind and its place there.
_TERMS = {int(Words([t.encode()], lower=True, breaks=_BREAK).hashes[0]): (k, i) for k, v in IDENTITY.items() for i, t in enumerate(v)}
_TERM_HASHES = np.sort(np.fromiter(_TERMS, np.uint64, len(_TERMS)))
_TERM_FEATURES = {k: _hashed(Words([" ".join(v).encode()], lower=True, breaks=_BREAK)) for k, v in IDENTITY.items()}

#: What a change of a text adds to its set and takes from it.
Change = tuple[np.ndarray, np.ndarray]


def _changes(features: np.ndarray, hashes: np.ndarray, whole: np.ndarray) -> list[Change]:
    """The changes of a text's set by swaps of its identity terms, and by leaving them out; none if it has no term."""
    at = np.flatnonzero(np.isin(hashes, _TERM_HASHES))
    if not len(at):
        return []
    versions = []
    for turn in range(SWAPS):
        swapped = features.copy()
        for j in at:
            kind, i = _TERMS[int(hashes[j])]
            n = len(IDENTITY[kind])
            swapped[:, j] = _TERM_FEATURES[kind][:, (i + 1 + turn * max(1, (n - 1) // SWAPS) % (n - 1)) % n]
        versions.append(np.unique(swapped))
    versions.append(np.unique(np.delete(features, at, axis=1)))
    return [(np.setdiff1d(v, whole, True), np.setdiff1d(whole, v, True)) for v in versions]


def sets_and_changes(texts: list) -> Iterator[tuple[np.ndarray, list[Change]]]:
    """The sorted set of hashed words and prefixes of each text, and its changes."""
    for _, raw in blocks(texts):
        w = Words(raw, lower=True, breaks=_BREAK)
        f = _hashed(w)
        for lo, hi in zip(w.first[:-1], w.first[1:]):
            whole = np.unique(f[:, lo:hi])
            yield whole, _changes(f[:, lo:hi], w.hashes[lo:hi], whole)


def word_sets(texts: list) -> Iterator[np.ndarray]:
    """The sorted set of hashed words and prefixes of each text."""
    for _, raw in blocks(texts):
        w = Words(raw, lower=True, breaks=_BREAK)
        f = _hashed(w)
        for lo, hi in zip(w.first[:-1], w.first[1:]):
            yield np.unique(f[:, lo:hi])


class Model:
    """Weights of hashed words and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def logits(self, texts: list) -> np.ndarray:
        return np.array([self.weights[s].sum(dtype=np.float64) for s in word_sets(texts)], dtype=np.float64) + self.intercept

    def scores(self, texts: list) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(-self.logits(texts)))


class _Sparse:
    """Rows of columns, each with 1 or the row's ``values``."""

    def __init__(self, rows: list[np.ndarray], columns: int, values: list[np.ndarray] | None = None):
        self.index = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.value = np.concatenate([np.empty(0), *values]) if values is not None else 1.0
        self.shape = (len(rows), columns)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index] * self.value, minlength=self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.index, weights=r[self.row] * self.value, minlength=self.shape[1])


def weighted_changes(changes: list[list[Change]]) -> tuple[list[Change], np.ndarray]:
    """All changes of the texts that have any, each text with the same share of 1; and each term's own text, left out."""
    naming = [c for c in changes if c]
    flat = [c for text in naming for c in text]
    weight = [1 / len(naming) / len(text) for text in naming for _ in text]
    none = np.empty(0, np.int32)
    for features in _TERM_FEATURES.values():
        flat += [(none, np.unique(column)) for column in features.T]
        weight += [RARE] * features.shape[1]
    return flat, np.array(weight)


def fit(sets: list[np.ndarray], labels: np.ndarray, changes: list[list[Change]], l1: float = 1e-3, l2: float = 1e-4, counterfactual: float = 1.0, steps: int = 200) -> Model:
    """Fit the model to word sets, labels 0 and 1 (both must occur) and the sets' counterfactual changes."""
    seen, columns = np.unique(np.concatenate(sets), return_counts=True)
    used = np.union1d(seen[columns >= 3], np.concatenate([f.ravel() for f in _TERM_FEATURES.values()]))

    def place(s: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(used, s), len(used) - 1)
        return at[used[at] == s]

    rows = [place(s) for s in sets]
    y = labels.astype(np.float64)
    flat, rate = weighted_changes(changes)
    flat, rate = [(place(a), place(g)) for a, g in flat], rate * counterfactual
    change = _Sparse([np.concatenate(c) for c in flat], len(used), [np.repeat((1.0, -1.0), (len(a), len(g))) for a, g in flat])
    # a row's curvature is at most that of its entries together
    width = np.bincount(change.row, minlength=len(flat))
    steep = 2 * np.bincount(change.index, weights=(rate * width)[change.row], minlength=len(used))
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    def run(active: np.ndarray, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
        x = _Sparse([r[active[r]] for r in rows], len(used))
        # steps scaled by each column's curvature bound
        size = np.maximum(np.bincount(x.row, minlength=len(rows)), 1)
        bound = 0.25 * np.bincount(x.index, weights=(balance * size)[x.row], minlength=len(used)) + l2 + 1e-6
        bound += steep
        w = z = np.zeros(len(used))
        b = c = 0.0
        t = 1.0
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(x.dot(z) + c, -500, 500)))
            r = balance * (p - y)
            g = x.back(r) + l2 * z
            g += 2 * change.back(rate * change.dot(z))
            w1 = z - g / bound
            w1 = np.sign(w1) * np.maximum(np.abs(w1) - l1 / bound, 0) * active
            b1 = c - r.sum() * 4 / 2
            t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            if (r.sum() * (b1 - b)) > 0 and g @ (w1 - w) > 0:  # momentum points uphill: start it anew
                t1 = 1.0
            z, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
            w, b, t = w1, b1, t1
        return w, b

    w, _ = run(np.ones(len(used), dtype=bool), l1, l2, steps)
    w, b = run(w != 0, 0.0, l2, 2 * steps)
    whole = np.zeros(1 << FEATURE_BITS)
    whole[used] = w
    return Model(whole, b)


def learned(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model of a bounded sample: at most ``per_class`` documents of each label."""
    one = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col("l_id").cast("string").cast("binary"))
    # a bounded number of ids
    picked = [one.where(F.col("toxic") == y).orderBy(order, "l_id").limit(per_class) for y in (0, 1)]
    picked = F.broadcast(picked[0].unionByName(picked[1]))
    texts = docs.join(picked, docs["doc_id"] == F.col("l_id")).select("text", F.col("toxic").cast("int").alias("toxic"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            words, changes = [], []
            for whole, changed in sets_and_changes(batch.column("text").to_pylist()):
                words.append(whole.tobytes())
                changes.append([{"added": a.tobytes(), "gone": g.tobytes()} for a, g in changed])
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(words, pa.binary()), pa.array(changes, pa.list_(pa.struct([("added", pa.binary()), ("gone", pa.binary())])))], names=["toxic", "words", "changes"])

    rows = texts.mapInArrow(sets, "toxic int, words binary, changes array<struct<added: binary, gone: binary>>").collect()
    # the same rows in the same order whatever the partitions
    rows = sorted((r["toxic"], bytes(r["words"]), [(bytes(c["added"]), bytes(c["gone"])) for c in r["changes"]]) for r in rows)
    y = np.array([r[0] for r in rows], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << FEATURE_BITS), -np.inf)
    numbers = lambda raw: np.frombuffer(raw, np.int32)
    return fit([numbers(r[1]) for r in rows], y, [[(numbers(a), numbers(g)) for a, g in r[2]] for r in rows])


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text").to_pylist()), pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def held_out():
    """Rows whose labels are never learned from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
