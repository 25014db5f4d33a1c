"""The thin queries of the operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, host_rules, kneser_ney, merkle, mixing, near_dup, pii_surrogates, resampling, sharding, simhash, substring_dedup, toxicity, url_filter
from .common import read, settled, stored
from .sql import SQL  # noqa: F401


def op1_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(lambda: near_dup.near_duplicates(read(spark, sf_dir, "documents")), spark)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii_surrogates.replace_entities(docs, key="a key of the deployment's own")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return settled(lambda: decontamination.contaminated(docs.select("doc_id", "text"), benchmark), spark)


def op5_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return settled(lambda: kneser_ney.judge(docs, read(spark, sf_dir, "labels")), spark)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.assign_shards(docs, 8).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    counted = stored(host_rules.with_counts(docs, text_out=False))
    judged = host_rules.join_hosts(counted, host_rules.host_rates(counted))
    return judged.select("doc_id", *host_rules.COUNTS, "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    model = toxicity.learned(docs, labels.where(~toxicity.held_out()))
    return toxicity.scored(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.without_repeats(read(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


#: (host, path, verdict)
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(lambda: url_filter.judge(read(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES), spark)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = merkle.row_leaves(docs, ["doc_id", "source", "lang", "n_chars", "text"], "lang", "doc_id", {"text": lowered}, tampered)
    found = settled(lambda: merkle.proofs(leaves), spark)
    return found.withColumnRenamed("key", "doc_id").withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = settled(lambda: simhash.near_duplicates(read(spark, sf_dir, "documents")), spark)
    return found.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    found = settled(lambda: resampling.drawn(resampling.weighed(docs, benchmark)), spark)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dup": op1_near_dup,
    "op2_mixing": op2_mixing,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_decontamination": op4_decontamination,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_sharding": op6_sharding,
    "op7_host_rules": op7_host_rules,
    "op8_toxicity": op8_toxicity,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_merkle": op11_merkle,
    "op12_simhash": op12_simhash,
    "op13_resampling": op13_resampling,
}
