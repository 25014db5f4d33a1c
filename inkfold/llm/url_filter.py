"""URL filter: rules by host and path, and a character language-model ratio for the rest; DataFrame functions only.

Rules. A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins (of
equally long ones the first in code point order).

Models. The URLs that rules accept and those they reject train one smoothed Markov model of variable order each, on
whole URLs (scheme, query string and fragment included): Witten-Bell interpolation from order ``ORDER`` down to equal
chances, so a context that was never seen hands over to the next shorter one. The tables have a row per distinct
character run, not per URL, and are summed before the shuffle.

Scores. Equal URLs are scored once. The distinct runs of the URLs to be judged get their gain (the difference of the
two log-likelihoods); up to ``MOST_RUNS`` of them are broadcast, so that a URL's runs are looked up and averaged where
they are cut and only its sum leaves the task. Beyond that the runs go by shuffle, hot ones by broadcast.

Verdict. The difference of the log-likelihoods by character must reach a threshold that is calibrated on a fifth of
the ruled URLs, which train nothing: the middle between the level that keeps ``keep`` of the accepted ones and the
level that stops ``keep`` of the rejected ones. Without accepted or rejected URLs to learn from, the rest is allowed.

Cases: a null URL or one without ``://`` has empty host and path, fits no rule and is judged by the models (a null one
like an empty one); repeated rows are judged alike; a null page_id is judged; an empty table gives an empty result;
very long URLs are cut into characters once; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, with_key

ORDER = 4
#: The alphabet that the lowest order spreads over.
ALPHABET = 256.0
#: Held out for the calibration, by CRC of the URL.
HELD_OUT = 5
#: Up to so many distinct runs (a few characters and a number each) are broadcast.
MOST_RUNS = 200_000
START, END = "\x02", "\x03"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: (host, path, verdict)
Rule = tuple[str, str, str]


def with_host(pages: DataFrame) -> DataFrame:
    """page_id, url (null as empty), host and path of each URL."""
    after = F.when(F.contains(F.col("url"), F.lit("://")), F.expr("substring(url, instr(url, '://') + 3)"))
    split = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), after.alias("rest"))
    host = F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    path = F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1)
    return split.select("page_id", "url", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))


def ruled(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """``urls`` with the rule that fits best (host and path in one string) and its verdict, else nulls."""
    best = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in reversed(best):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return urls.withColumn("rule", rule).withColumn("ruling", verdict)


def _each_run(urls: DataFrame, *keys: str) -> DataFrame:
    """(keys, run): each character of a URL with the ORDER before it, a row for each."""
    chars = F.concat(F.array_repeat(F.lit(START), ORDER), F.filter(F.split("url", ""), lambda c: c != ""), F.array(F.lit(END)))
    runs = F.transform(F.sequence(F.lit(0), F.size("chars") - ORDER - 1), lambda i: F.concat(*[F.get("chars", i + k) for k in range(ORDER + 1)]))
    return urls.select(*keys, chars.alias("chars")).select(*keys, F.explode(runs).alias("run"))


def run_scores(trained: DataFrame, runs: DataFrame) -> DataFrame:
    """(run, gain): by how much the accepted model finds the run's last character likelier, in logs.

    ``trained`` has (ruling, run, times), ``runs`` the distinct runs to score.
    """
    kinds = ["allow", "block"]
    whole = trained.groupBy("run").pivot("ruling", kinds).sum("times").na.fill(0, kinds)
    out = runs.select("run", *[F.lit(1 / ALPHABET).alias(k) for k in kinds])
    for order in range(ORDER + 1):
        seen = whole.groupBy(F.expr(f"right(run, {order + 1})").alias("gram")).agg(*[F.sum(k).alias(k) for k in kinds])
        context = seen.groupBy(F.expr(f"left(gram, {order})").alias("context")).agg(
            *[F.sum(k).alias(f"n_{k}") for k in kinds], *[F.sum((F.col(k) > 0).cast("long")).alias(f"t_{k}") for k in kinds]
        )
        seen = seen.select("gram", *[F.col(k).alias(f"c_{k}") for k in kinds])
        out = out.withColumn("gram", F.expr(f"right(run, {order + 1})")).withColumn("context", F.expr(f"left(right(run, {order + 1}), {order})"))
        out = out.join(seen, "gram", "left").join(context, "context", "left")
        for k in kinds:
            n, t = F.coalesce(f"n_{k}", F.lit(0)), F.coalesce(f"t_{k}", F.lit(0))
            smooth = (F.coalesce(f"c_{k}", F.lit(0)) + t * F.col(k)) / (n + t)
            out = out.withColumn(f"p_{k}", F.when(n + t > 0, smooth).otherwise(F.col(k)))
        out = out.select("run", *[F.col(f"p_{k}").alias(k) for k in kinds])
    return out.select("run", (F.log("allow") - F.log("block")).alias("gain"))


def _scored(texts: DataFrame, gains: DataFrame, most: int) -> DataFrame:
    """(u1, u2, ruling, score): the mean gain of each URL's characters."""
    rows = _each_run(texts, "u1", "u2", "ruling")
    if gains.limit(most + 1).count() <= most:
        looked_up = rows.join(F.broadcast(gains), "run")
    else:
        looked_up = with_key(stored(rows), gains, ["run"])
    return looked_up.groupBy("u1", "u2", "ruling").agg(F.round(F.avg("gain"), 6).alias("score"))


def judge(pages: DataFrame, rules: list[Rule], keep: float = 0.95, most_runs: int = MOST_RUNS) -> DataFrame:
    """page_id, host, path, rule, verdict and, for URLs without a rule, the score and the threshold."""
    # two hashes of 64 bits stand for a URL
    prints = {"u1": F.xxhash64("url"), "u2": F.xxhash64(F.lit(7), "url")}
    urls = stored(ruled(with_host(pages), rules).withColumns(prints))
    held = (F.crc32(F.col("url").cast("binary")) % HELD_OUT == 0) & F.col("ruling").isNotNull()
    texts = stored(urls.groupBy("u1", "u2").agg(F.first("url").alias("url"), F.first("ruling").alias("ruling")).withColumn("held", held))
    trained = _each_run(texts.where(F.col("ruling").isNotNull() & ~F.col("held")), "ruling")
    trained = stored(trained.groupBy("ruling", "run").agg(F.count("*").alias("times")))
    kinds = {r[0] for r in trained.select("ruling").distinct().collect()}  # two at most
    if kinds >= {"allow", "block"}:
        judged = texts.where(F.col("ruling").isNull() | F.col("held"))
        gains = stored(run_scores(trained, _each_run(judged).distinct()))
        by_url = stored(_scored(judged, gains, most_runs))
        low = F.percentile_approx(F.when(F.col("ruling") == "allow", F.col("score")), 1 - keep, 10000)
        high = F.percentile_approx(F.when(F.col("ruling") == "block", F.col("score")), keep, 10000)
        level = by_url.agg(F.coalesce((low + high) / 2, low, high, F.lit(0.0)).alias("threshold"))
        scores = by_url.where(F.col("ruling").isNull()).select("u1", "u2", "score").join(F.broadcast(level))  # one row
    else:
        scores = texts.limit(0).select("u1", "u2", F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("threshold"))
    # ruled URLs ask for no score
    asked = urls.withColumns({u: F.when(F.col("ruling").isNull(), F.col(u)) for u in prints})
    out = with_key(stored(asked.drop("url")), scores, list(prints))
    model = F.when(F.col("score") < F.col("threshold"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruling", model).alias("verdict"), "score", "threshold")
