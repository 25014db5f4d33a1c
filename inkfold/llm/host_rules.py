"""Quality rules judged by host: base rules fail documents, and hosts whose documents fail too often fail whole.

1. One pass over the texts computes the base counts of each document (NumPy on Arrow batches).
2. Failures are counted by host. Partial sums before the shuffle make a hot host as cheap as any other.
3. The rate of a host is shrunk by a beta prior fitted to all hosts by the moments of the beta-binomial, so that a host with two bad
   documents of two is not judged like one with 900 of 1,000.
4. The table of hosts, one row each, is joined back: by broadcast up to a checked number of hosts, so that texts
   aren't shuffled by host, else by a shuffle.

Cases: a null text counts as empty and fails; an empty table gives an empty result; a null host belongs to no
host and never fails by host; repeated rows count as often as they occur and are judged alike; result columns
replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Sealed, carried, name, sliced, small, stored
from .kernels import Words, blocks, covered, gram_mask, grams, sums

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True


def _dup_lines(raw: bytes) -> int:
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def text_counts(texts: list) -> dict[str, np.ndarray]:
    """The base counts of each text."""
    out: dict[str, list] = {c: [] for c in COUNTS}
    for _, raw in blocks(texts):
        w = Words(raw)
        n = len(w.hashes)
        out["n_words"].append(w.counts)
        inside = np.zeros(len(w.data) + 1, dtype=np.int8)
        inside[w.starts] = 1
        inside[w.ends] -= 1
        # bytes 0x80 to 0xBF continue a code point
        letters = (np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((w.data & 0xC0) != 0x80)
        out["word_chars"].append(sums(letters, w.text_starts))
        out["n_symbols"].append(sums(_SYMBOL[w.data], w.text_starts))
        out["n_dup_lines"].append(np.fromiter(map(_dup_lines, raw), dtype=np.int64, count=len(raw)))
        g = grams(w.hashes, WINDOW)
        at = np.flatnonzero(gram_mask(w.first, WINDOW, len(g)))
        text = np.repeat(np.arange(len(raw), dtype=np.uint64), w.counts)[at]
        key = g[at] ^ (text * np.uint64(0xD6E8FEB86659FD93))  # equal windows of different texts must not meet
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        marks = np.zeros(n, dtype=bool)
        marks[at[order[1:][same]]] = True
        marks[at[order[:-1][same]]] = True
        out["n_repeat_words"].append(sums(covered(marks, WINDOW, n), w.first))
    return {c: np.concatenate(v) if v else np.empty(0, np.int64) for c, v in out.items()}


def with_counts(docs: DataFrame, text_out: bool = True) -> DataFrame:
    """``docs`` with the base counts of ``text``, and without the text itself where it isn't wanted back."""
    kept = docs.select(*carried(docs, COUNTS))
    text = next(f.name for f in kept.schema.fields if f.name.lower() == "text")
    back = [f for f in kept.schema.fields if text_out or f.name != text]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = text_counts(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in back), *(pa.array(got[c], pa.int64()) for c in COUNTS)], names=[*(f.name for f in back), *COUNTS])

    return kept.mapInArrow(counted, T.StructType([*back, *(T.StructField(c, T.LongType()) for c in COUNTS)])).withColumn("base_failed", base_failed())


def base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def host_rates(judged: DataFrame, host: str = "source", strength: float = 10.0) -> DataFrame:
    """One row per host: documents, failures and the rate shrunk by the prior.

    The prior is the beta distribution whose beta-binomial has the moments of the hosts: its mean is the share of
    failures of all documents, and its strength (in documents) follows from how much more the hosts' rates spread,
    weighted by documents, than chance would have them. One host, or hosts of one document each, tell nothing of that:
    there the prior counts as ``strength`` documents.
    """
    by_host = judged.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_docs"), F.sum(F.col("base_failed").cast("long")).alias("host_failed"))
    n, f = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    sums = by_host.agg(F.count("*").cast("double").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), F.sum(f).alias("f"), F.sum(f * f / n).alias("ff"))
    sums = sums.withColumns({"m": F.col("f") / F.col("n"), "room": F.col("n") - F.col("nn") / F.col("n") - (F.col("k") - 1)})
    chance = F.col("m") * (1 - F.col("m"))
    spread = (F.col("ff") - F.col("f") * F.col("f") / F.col("n")) / chance - (F.col("k") - 1)
    # the correlation of two documents of a host
    alike = F.least(F.greatest(spread / F.col("room"), F.lit(1e-6)), F.lit(0.999))
    prior = sums.select("m", F.when((F.col("room") > 1e-9) & (chance > 0), 1 / alike - 1).otherwise(F.lit(strength)).alias("s"))
    # one row of two numbers
    return by_host.join(F.broadcast(prior)).select("host", "host_docs", "host_failed", ((F.col("host_failed") + F.col("m") * F.col("s")) / (F.col("host_docs") + F.col("s"))).alias("host_rate"))


VERDICT = ["host_docs", "host_failed", "host_rate", "kept"]


def join_hosts(counted: DataFrame, rates: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The verdicts of hosts, joined back to their documents."""
    rates = small(stored(rates))
    sealed = Sealed(counted)
    hosted = sealed.df.join(rates, sealed[host] == F.col("host"), "left")
    kept = ~sealed["base_failed"] & (F.coalesce(F.col("host_rate"), F.lit(0.0)) <= max_rate)
    return hosted.select(*sealed.back(VERDICT), *VERDICT[:-1], kept.alias("kept"))


def judge_hosts(docs: DataFrame, host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """``docs`` with base counts, ``base_failed``, the host's shrunk ``host_rate`` and the verdict ``kept``.

    The texts are read twice, once for the rates and once for the result, and never shuffled.
    """
    slim = with_counts(docs.select(name(host).alias("host"), F.col("text")), text_out=False)
    return join_hosts(with_counts(docs.select(*carried(docs, [*COUNTS, "base_failed", *VERDICT]))), host_rates(slim, "host"), host, max_rate)
