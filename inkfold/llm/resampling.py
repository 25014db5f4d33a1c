"""Importance resampling towards a target distribution, with an integer word dictionary.

Features are hashed n-grams. With s of the S features of the raw texts and t of the T features of the target texts in a
bucket, the bucket's gain is the logarithm of (t + 1) / (T + buckets) over (s + 1) / (S + buckets); a document's weight
is the mean gain of its features, and the highest weights with Gumbel noise are a draw without replacement.

Dictionary. A pack of a few MB of texts is cut into words once. It stores its texts as numbers of its own words, and each
of its distinct words once with its count, so a frequent word is a row per pack and not one per occurrence, and no word
has more than one row in the thousands that a pack sends. Where a word's rows meet it gets its number in the whole corpus.
A run of words is a tuple of these numbers: a pack sends each distinct tuple once with its count. Each distinct tuple is
spelled out from the dictionary and hashed once (a tuple of one number where the word got it, so the rows of single words
are shuffled once); the gain of its bucket goes back to the packs that have it, where a text's gains are added up.

The draw numbers the candidates by a range sort; no task sees all of them, and no text is shuffled or read twice.

Cases: null texts, empty texts and texts without words have no feature and weight 0; they are no candidates, unless the
least number of words is 0; a null doc_id is hashed as the text "null" and comes last among ties; rows that repeat a
doc_id share its noise, are weighed one by one, and ties between them go by their number of features, then weight; very
long texts are a pack of their own; without target texts or without documents the formula holds as it stands; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.numbering import numbered
from .common import name, stored, with_key
from .kernels import sums

BUCKETS, SEED, LEAST_WORDS, PERCENT = 10_000, "2024", 20, 10
#: Bytes of text in a pack, if no single text is longer.
PACK = 16 << 20

#: Bytes between words, once A-Z are lower-cased: all of ASCII but letters and digits.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[:128] = True
_BETWEEN[[*range(0x30, 0x3A), *range(0x61, 0x7B)]] = False

_PACK = pa.schema([("side", pa.int32()), ("pack", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("ids", pa.binary()), ("words", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])
PACKS = "side int, pack long, doc_ids array<long>, lengths array<int>, ids binary, words array<binary>, counts array<long>"
RUNS = "side int, pack long, at int, tuple array<long>, times long"


def cut(texts: list[bytes]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words of each text, the distinct words of all, and each word's number among them."""
    data = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
    inside = ~_BETWEEN[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))))
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]).dictionary_encode()
    return counts, words.dictionary, words.indices.to_numpy(zero_copy_only=False)


def packs(docs: DataFrame, side: int, size: int = PACK) -> DataFrame:
    """Rows of (doc_id, text) as packs: their texts as numbers of the pack's own words, and these words with their counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = TaskContext.get().partitionId() << 32
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            counts, words, numbers = cut(texts)
            times = np.bincount(numbers, minlength=len(words))
            body = pa.compress(numbers.astype("<i4").tobytes(), "zstd", asbytes=True)
            values = (side, done, ids, counts.tolist(), body, words.to_pylist(), times.tolist())
            return pa.RecordBatch.from_pylist([dict(zip(_PACK.names, values))], schema=_PACK)

        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = text.as_py() or b""
                if texts and held + len(raw) > size:
                    yield packed()
                    ids, texts, held, done = [], [], 0, done + 1
                ids.append(i), texts.append(raw)
                held += len(raw)
        if texts:
            yield packed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, PACKS)


def _tuples(numbers: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of ``n`` numbers inside a text, in order; which one each run is; and the runs of each text."""
    here = np.maximum(lengths - n + 1, 0)
    first = np.cumsum(lengths) - lengths
    at = np.arange(here.sum()) + np.repeat(first - np.cumsum(here) + here, here)
    found, which = np.unique(numbers[at[:, None] + np.arange(n)], axis=0, return_inverse=True)
    return found.reshape(-1, n), which.reshape(-1), here


def _pack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array(table.column("lengths")[0].as_py(), np.int64)
    return np.frombuffer(pa.decompress(table.column("ids")[0].as_py(), int(4 * lengths.sum()), "zstd"), "<i4"), lengths


def _bucket(feature: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(feature), F.lit(buckets)).cast("int")


def numbered_words(words: DataFrame, buckets: int) -> DataFrame:
    """``words`` (side, pack, at, word, times) with the word's number in the corpus and its bucket; the word itself on one of its rows.

    The rows of a word meet once, in a sorted stream: its first row gives the number and is the only one that is hashed.
    """
    same = W.partitionBy("word")
    rows = words.withColumn("row", F.monotonically_increasing_id()).withColumn("id", F.min("row").over(same))
    first = F.col("row") == F.col("id")
    rows = rows.withColumn("bucket", F.max(F.when(first, _bucket(F.col("word"), buckets))).over(same))
    return rows.select("side", "pack", "at", "times", "id", "bucket", F.when(first, F.col("word")).alias("word"))


def longer_runs(packed: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The distinct runs of 2 to ``n`` words of each pack, as tuples of corpus numbers, numbered on behind the pack's words."""

    def runs(pack: pa.Table, found: pa.Table) -> pa.Table:
        numbers, lengths = _pack(pack)
        own = np.empty(len(found), np.int64)
        own[found.column("at").to_numpy()] = found.column("id").to_numpy()
        out, times = [], [np.empty(0, np.int64)]
        for k in range(2, n + 1):
            distinct, which, _ = _tuples(numbers, lengths, k)
            out += own[distinct].tolist()
            times.append(np.bincount(which, minlength=len(distinct)))
        size = len(out)
        key = [pa.array([pack.column(c)[0].as_py()] * size, t) for c, t in (("side", pa.int32()), ("pack", pa.int64()))]
        at = pa.array(np.arange(len(own), len(own) + size), pa.int32())
        return pa.table([*key, at, pa.array(out, pa.list_(pa.int64())), pa.array(np.concatenate(times), pa.int64())], names=["side", "pack", "at", "tuple", "times"])

    left = packed.select("side", "pack", "lengths", "ids").groupBy("side", "pack")
    return left.cogroup(ids.groupBy("side", "pack")).applyInArrow(runs, RUNS)


def spelled(tuples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(tuple, feature): the text of each distinct tuple, its words joined by a blank; words of many tuples go by broadcast."""
    parts = stored(tuples.select("tuple", F.posexplode("tuple").alias("at", "id")))
    whole = with_key(parts, dictionary, ["id"]).groupBy("tuple").agg(F.array_sort(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("parts"))
    return whole.select("tuple", F.array_join("parts.word", " ").alias("feature"))


def gains(counts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) from (bucket, s, t): the features of the raw and of the target texts in each bucket that has any."""
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    s, t = F.col("s").cast("double") + 1, F.col("t").cast("double") + 1
    ratio = t * (F.col("all_s") + buckets) / (s * (F.col("all_t") + buckets))
    return counts.join(F.broadcast(total), F.lit(True)).select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))  # one row beside


def weighed(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, pack: int = PACK) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of ``docs`` (doc_id, text), towards the texts of ``target``.

    Features are the runs of 1 to ``n`` words; the weight is their mean gain, rounded down.
    """
    raw = packs(docs.select(name("doc_id").alias("doc_id"), name("text").alias("text")), 0, pack)
    aim = packs(target.select(F.lit(None).cast("long").alias("doc_id"), name("text").alias("text")), 1, pack)
    packed = stored(raw.unionByName(aim))
    words = packed.select("side", "pack", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x")).select("side", "pack", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("times"))
    runs = stored(numbered_words(words, buckets))
    if n > 1:
        longer = stored(longer_runs(packed, runs.select("side", "pack", "at", "id"), n))
        tuples = spelled(longer.select("tuple").distinct(), runs.where("word is not null").select("id", "word"))
        hashed = tuples.select("tuple", _bucket(F.col("feature").cast("binary"), buckets).alias("bucket"))
        runs = stored(runs.select("side", "pack", "at", "times", "bucket").unionByName(longer.join(hashed, "tuple").select("side", "pack", "at", "times", "bucket")))
    of = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("times"))), F.lit(0))
    table = gains(runs.groupBy("bucket").agg(of(0).alias("s"), of(1).alias("t")), buckets)
    back = runs.where("side = 0").join(F.broadcast(table), "bucket").select("pack", "at", F.col("gain").cast("int").alias("gain"))  # a row for each bucket

    def added(texts: pa.Table, found: pa.Table) -> pa.Table:
        numbers, lengths = _pack(texts)
        gain = np.empty(len(found), np.int64)
        gain[found.column("at").to_numpy()] = found.column("gain").to_numpy()
        total = sums(gain[numbers], np.concatenate(([0], np.cumsum(lengths))))
        features, before = lengths.copy(), int(numbers.max()) + 1 if len(numbers) else 0
        for k in range(2, n + 1):
            distinct, which, here = _tuples(numbers, lengths, k)
            total += sums(gain[before + which], np.concatenate(([0], np.cumsum(here))))
            features, before = features + here, before + len(distinct)
        weight = np.where(features > 0, total // np.maximum(features, 1), 0)
        return pa.table([pa.array(texts.column("doc_ids")[0].as_py(), pa.int64()), pa.array(lengths), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    left = packed.where("side = 0").select("pack", "doc_ids", "lengths", "ids").groupBy("pack")
    return left.cogroup(back.groupBy("pack")).applyInArrow(added, "doc_id long, n_words long, n_features long, weight long")


def drawn(rows: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, seed: str = SEED) -> DataFrame:
    """``weighed`` rows with score and rank: of those with ``least`` words, so many in a hundred with the highest scores."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")
    scored = stored(rows.withColumn("score", F.col("weight") + noise).withColumn("tie", F.monotonically_increasing_id()))
    fit = F.col("n_words") >= least
    most = percent * scored.where(fit).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "n_features", "weight", "tie"]
    ranked = numbered(scored.where(fit), order, "place", stored).withColumn("rank", F.when(F.col("place") < most, F.col("place") + 1))
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return ranked.drop("place", "tie").unionByName(rest.drop("tie"))
