"""Quality by an interpolated modified Kneser-Ney model of characters, trained on trusted text.

1. Texts are dealt into packs of about 8 MB by a hash of doc_id, compressed by pack and equal rows of a batch only
   once, together with the labels that say which are trusted. A pack sends each distinct run of ``ORDER`` characters
   once, with its count in trusted text: what is gathered follows the size of the corpus, and the copies of a hot text
   meet within their packs.
2. Runs are summed into the model's tables, one row per distinct run, and joined by their suffixes and contexts,
   sharded by hash: highest order by counts, lower orders by the number of different continuations (those of a text's
   start count like others), three discounts for each order from the counts of counts.
3. The log-likelihood of each run goes back to the packs that asked for it, which give each document its
   perplexity.
4. One in ``CALIBRATES`` trusted documents, by the CRC of doc_id, trains nothing: these show what the model makes of good
   text that it hasn't seen. A document is rejected if its perplexity lies above the ``QUANTILE`` of its language. That
   is the language's own mean (of logarithms) and, on top of it, the quantile of what its documents differ from it; this
   difference is drawn to that of all languages' documents from their own means, with the weight of ``PRIOR`` documents,
   so a few documents say where a language lies and many how far it spreads. A language without any, and a null one, has
   the quantile of all of them; where none is held out, that of the trained ones.

Characters are UTF-16 units of 16 bits, so a run of four is one number and none is lost: a character beyond the basic
plane is two units. 0 stands before a text; a NUL in a text counts as U+FFFF, which is no character.

Cases: null and empty texts have no perplexity (null) and are rejected; a null language has the threshold of all;
without trusted text nothing is rejected but empty texts; a doc_id that occurs several times is trusted in all its
rows or none, by the largest quality; a null doc_id is never trusted; repeated rows get equal results; an empty
table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import each_time, packed, partitions, small, stored, unpacked, with_key

ORDER = 4
BITS = 16
QUANTILE = 0.995
#: One in so many trusted documents is held out for the thresholds; the spread of all languages counts like so many.
CALIBRATES, PRIOR = 5, 200
PACK_BYTES = 8 << 20
_PART = 1 << 20


def _codes(text: str) -> np.ndarray:
    """The UTF-16 units of a text, none of them 0."""
    units = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype=np.uint16).astype(np.uint64)
    return np.where(units == 0, np.uint64(0xFFFF), units)


def runs(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Every character with the ORDER - 1 before it as one number, and the number of them in each text."""
    parts, sizes = [], np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        if text:
            c = np.concatenate((np.zeros(ORDER - 1, np.uint64), _codes(text)))
            sizes[i] = len(c) - ORDER + 1
            out = c[: sizes[i]].copy()
            for k in range(1, ORDER):
                out <<= np.uint64(BITS)
                out |= c[k : k + sizes[i]]
            parts.append(out.view(np.int64))
    return np.concatenate(parts) if parts else np.empty(0, np.int64), sizes


def _cut(texts: list):
    """Slices of about ``_PART`` characters."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > _PART:
            yield slice(lo, i)
            lo, size = i, 0
        size += len(text or "")
    if lo < len(texts):
        yield slice(lo, len(texts))


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order, from how many runs have the counts 1 to 4 (Chen and Goodman, 1999)."""
    n = [x or 0 for x in counts.agg(*[F.sum((F.col("n") == k).cast("long")) for k in (1, 2, 3, 4)]).first()]
    if not n[0] or not n[1]:
        return 0.5, 0.75, 0.9
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) if n[k - 1] and n[k] else 0.5 * k for k in (1, 2, 3))


def run_logs(counts: DataFrame) -> DataFrame:
    """(run, logp) for every run of ``counts`` (run, n); n is its count in trusted text and may be 0."""

    def last(run: str, k: int):
        return F.col(run) if k == ORDER else F.col(run).bitwiseAND((1 << (BITS * k)) - 1)

    seen = {ORDER: stored(counts.where("n > 0").select(F.col("run").alias("gram"), "n"))}
    for k in range(ORDER - 1, 0, -1):
        longer = seen[k + 1].select(last("gram", k).alias("gram"))
        seen[k] = stored(longer.groupBy("gram").agg(F.count("*").alias("n")))
    letters = seen[1].count()
    out = counts.select("run", F.lit(1.0 / (letters + 1)).alias("p"))
    for k in range(1, ORDER + 1):
        d = _discounts(seen[k])
        less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        grams = seen[k].select("gram", F.greatest(F.col("n") - less, F.lit(0.0)).alias("kept"))
        context = seen[k].select(F.shiftrightunsigned("gram", BITS).alias("context"), "n", less.alias("less")).groupBy("context").agg(F.sum("n").alias("total"), F.sum("less").alias("spare"))
        out = out.withColumn("gram", last("run", k)).withColumn("context", F.shiftrightunsigned(last("run", k), BITS))
        out = out.join(grams, "gram", "left").join(context, "context", "left")
        mixed = (F.coalesce("kept", F.lit(0.0)) + F.col("spare") * F.col("p")) / F.col("total")
        out = out.select("run", F.when(F.col("total").isNotNull(), mixed).otherwise(F.col("p")).alias("p"))
    return out.select("run", F.log("p").alias("logp"))


_KINDS = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("text", pa.string())])


def perplexities(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """doc_id, lang and perplexity of every row of ``docs``; ``trusted`` has the doc_ids of the text to train on."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = partitions(spark)
    packs = max(2 * n, size // PACK_BYTES)
    # texts of a doc_id must meet its label, rows without one can go anywhere
    pack = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(packs)).cast("int")
    texts = packed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").withColumn("pack", pack), n)
    marks = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("pack", F.pmod(F.xxhash64("doc_id"), F.lit(packs)).cast("int")).repartition(n, "pack")

    def count(key: tuple, table: pa.Table, labels: pa.Table) -> pa.Table:
        table = unpacked(table, _KINDS)
        good = np.isin(table.column("doc_id").fill_null(-1).to_numpy(), labels.column("doc_id").to_numpy()) & ~np.array(table.column("doc_id").is_null())
        whole, times = np.empty(0, np.int64), np.empty(0, np.int64)
        texts, copies = table.column("text").to_pylist(), table.column("times").to_numpy()
        for s in _cut(texts):
            r, sizes = runs(texts[s])
            weight = np.repeat(good[s] * copies[s], sizes)
            items, at = np.unique(np.concatenate((whole, r)), return_inverse=True)
            times = np.bincount(at, weights=np.concatenate((times, weight)), minlength=len(items)).astype(np.int64)
            whole = items
        return pa.table([pa.array(np.full(len(whole), key[0].as_py(), np.int32)), pa.array(whole, pa.int64()), pa.array(times, pa.int64())], names=["pack", "run", "n"])

    def score(key: tuple, table: pa.Table, logs: pa.Table) -> pa.Table:
        table = unpacked(table, _KINDS)
        known, at = logs.column("run").to_numpy(), logs.column("logp").to_numpy()
        order = np.argsort(known)
        known, at = known[order], at[order]
        texts, out = table.column("text").to_pylist(), []
        for s in _cut(texts):
            r, sizes = runs(texts[s])
            total = np.concatenate(([0.0], np.cumsum(at[np.searchsorted(known, r)] if len(r) else np.empty(0))))
            ends = np.cumsum(sizes)
            mean = (total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
            out += [float(np.exp(-m)) if k else None for m, k in zip(mean, sizes)]
        return pa.table([table.column("doc_id"), table.column("lang"), pa.array(out, pa.float64()), table.column("times")], names=["doc_id", "lang", "perplexity", "times"])

    asked = stored(texts.groupBy("pack").cogroup(marks.groupBy("pack")).applyInArrow(count, "pack int, run long, n long"))
    logs = stored(run_logs(asked.groupBy("run").agg(F.sum("n").alias("n"))))
    answers = asked.select("pack", "run").join(logs, "run").select("pack", "run", "logp").repartition(n, "pack")
    scored = texts.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(score, "doc_id long, lang string, perplexity double, times long")
    return each_time(scored)


def judge(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, perplexity, threshold and kept of every row; labels with quality 1 mark trusted text."""
    trusted = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1")
    trusted = stored(trusted.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % CALIBRATES == 0).alias("held")))
    scored = stored(perplexities(docs, trusted.where("not held")))
    known = stored(with_key(scored.where("perplexity is not null"), trusted, ["doc_id"]).where("held is not null").select("lang", "held", "perplexity", F.ln("perplexity").alias("log")))
    level = lambda c: F.percentile_approx(c, quantile, 10000)
    overall = known.agg(F.coalesce(level(F.when(F.col("held"), F.col("perplexity"))), level(F.when(~F.col("held"), F.col("perplexity")))).alias("overall"))
    held = known.where("held and lang is not null")
    means = held.groupBy(F.col("lang").alias("t_lang")).agg(F.avg("log").alias("mean"))
    apart = held.join(small(stored(means)), F.col("lang") == F.col("t_lang")).select("t_lang", "mean", (F.col("log") - F.col("mean")).alias("apart"))
    by_lang = apart.groupBy("t_lang").agg(F.first("mean").alias("mean"), level("apart").alias("own"), F.count("*").alias("n"))
    pooled = apart.agg(level("apart").alias("pooled"))
    out = scored.join(small(stored(by_lang)), F.col("lang") == F.col("t_lang"), "left").join(F.broadcast(overall)).join(F.broadcast(pooled))  # one row each
    spread = (F.col("n") * F.col("own") + PRIOR * F.col("pooled")) / (F.col("n") + PRIOR)
    limit = F.coalesce(F.exp(F.col("mean") + spread), F.col("overall"))
    kept = F.col("perplexity").isNotNull() & (F.col("perplexity") <= F.coalesce(limit, F.lit(float("inf"))))
    return out.select("doc_id", "lang", F.round("perplexity", 6).alias("perplexity"), F.round(limit, 6).alias("threshold"), kept.alias("kept"))
