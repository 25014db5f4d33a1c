"""Lexical index and rule-scored candidates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from .numbering import numbered

#: The scoring rules.
BASE_NAME, BASE_ALIAS, PER_TOKEN, ALIAS_START, ALIAS_STEP, EXACT, PREFERRED, PER_CLASS = 100, 50, 10, 40, 10, 20, 30, 12


def postings(icons: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(token, icon_id), one row each; the form that joins use."""
    return icons.select("icon_id", F.explode(F.array_distinct(tokens)).alias("token"))


def inverted_index(icons: DataFrame) -> DataFrame:
    """(token, icon_ids ascending) from icons with tokens: the published form."""
    return postings(icons).groupBy("token").agg(F.sort_array(F.collect_list("icon_id")).alias("icon_ids"))


def corpus_counts(icons: DataFrame) -> DataFrame:
    """Icons, categories, packs and tokens, each counted by itself so that distincts stay distributed."""
    packs = icons.select("category", "pack").distinct()
    one = icons.agg(F.count("*").alias("icon_count"))
    for other in (icons.select("category").distinct().agg(F.count("*").alias("category_count")), packs.agg(F.count("*").alias("pack_count")), postings(icons).select("token").distinct().agg(F.count("*").alias("token_count"))):
        one = one.join(F.broadcast(other))  # rows of one number
    return one


def dictionary(rows: DataFrame, value: str, seq: str) -> DataFrame:
    """(value, id): ids from 0 in the order in which values first appear, by ranges, so no task has all values."""
    first = rows.groupBy(value).agg(F.min(seq).alias("first"))
    return numbered(first, ["first", value], "id").select(value, "id")


def match_phrases(phrases: DataFrame, index: DataFrame) -> DataFrame:
    """(class, phrase_index, icon_id) of the icons that have every token of a phrase.

    ``phrases``: class, phrase_index, tokens; ``index``: postings. A phrase without tokens matches nothing.
    """
    wanted = phrases.select("class", "phrase_index", F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    hits = index.join(wanted, "token")
    return hits.groupBy("class", "phrase_index", "icon_id", "n").agg(F.count("*").alias("found")).where(F.col("found") == F.col("n")).select("class", "phrase_index", "icon_id")


#: Ids that one bitmap of a posting list covers: Spark's bitmaps have 4 KB.
BITMAP_IDS = 32_768


def posting_bitmaps(icons: DataFrame) -> DataFrame:
    """(token, bucket, bits): posting lists as bitmaps, one for each token and run of BITMAP_IDS ids (from 0 on).

    A task folds its icons into one bitmap per token and bucket before the shuffle, so a token that most icons have
    costs 4 KB a bucket instead of a row per icon.
    """
    rows = postings(icons)
    return rows.groupBy("token", F.floor(F.col("icon_id") / BITMAP_IDS).alias("bucket")).agg(F.bitmap_construct_agg(F.pmod(F.col("icon_id"), F.lit(BITMAP_IDS))).alias("bits"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _set_bits(bitmaps: pa.Array) -> pa.Array:
    found = [np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")) if b is not None else [] for b in bitmaps.to_pylist()]
    return pa.array(found, pa.list_(pa.int32()))


def match_bitmaps(phrases: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(class, phrase_index, icon_id), as match_phrases gives them, by the AND of the tokens' bitmaps in each bucket.

    Only icons that have every token become rows again; the phrases are a stated set and meet the bitmaps by token.
    """
    wanted = phrases.select("class", "phrase_index", F.size(F.array_distinct("tokens")).alias("n"), F.explode(F.array_distinct("tokens")).alias("token"))
    met = bitmaps.join(wanted, "token").groupBy("class", "phrase_index", "bucket", "n").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("found"))
    whole = met.where((F.col("found") == F.col("n")) & (F.bitmap_count("bits") > 0))
    return whole.select("class", "phrase_index", "bucket", F.explode(_set_bits("bits")).alias("bit")).select("class", "phrase_index", (F.col("bucket") * BITMAP_IDS + F.col("bit")).alias("icon_id"))


def score_candidates(phrases: DataFrame, icons: DataFrame, preferred: DataFrame, penalties: DataFrame, excluded: DataFrame, limit: int = PER_CLASS) -> DataFrame:
    """(class, rank, icon_id, score): the best candidates of each class by (score descending, id).

    ``phrases``: class, phrase_index (0 is the name), tokens. ``icons``: icon_id, category, tokens. ``preferred``:
    class, category. ``penalties``: category, points. ``excluded``: class, token.
    """
    matched = match_phrases(phrases, postings(icons))
    rows = matched.join(phrases.withColumnRenamed("tokens", "wanted"), ["class", "phrase_index"]).join(icons, "icon_id")
    named = F.col("phrase_index") == 0
    base = F.when(named, F.lit(BASE_NAME)).otherwise(BASE_ALIAS) + PER_TOKEN * F.size(F.array_distinct("wanted"))
    early = F.when(named, F.lit(0)).otherwise(F.greatest(F.lit(0), ALIAS_START - ALIAS_STEP * F.col("phrase_index")))
    exact = F.when(F.array_join("tokens", " ") == F.array_join("wanted", " "), F.lit(EXACT)).otherwise(0)
    best = rows.groupBy("class", "icon_id").agg(F.max(base + early + exact).alias("relevance"))
    best = best.join(icons, "icon_id").join(preferred.withColumn("liked", F.lit(PREFERRED)), ["class", "category"], "left").join(penalties, "category", "left")
    banned = excluded.groupBy("class").agg(F.collect_set("token").alias("banned"))
    best = best.join(banned, "class", "left").where(~F.coalesce(F.arrays_overlap("tokens", "banned"), F.lit(False)))
    scored = best.withColumn("score", F.col("relevance") + F.coalesce("liked", F.lit(0)) + F.coalesce("points", F.lit(0)))
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy("class").orderBy(F.desc("score"), "icon_id")))
    return ranked.where(F.col("rank") <= limit).select("class", "rank", "icon_id", "score")


def phrases_of(classes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(class, phrase_index, tokens): the name first, then the aliases in their order from 1."""
    names = classes.select("class", F.lit(0).alias("phrase_index"), text.tokenize(F.col("class")).alias("tokens"))
    return names.unionByName(aliases.select("class", "phrase_index", text.tokenize(F.col("phrase")).alias("tokens")))


def icon_paths(icons: DataFrame, packs: DataFrame, categories: DataFrame) -> DataFrame:
    """(icon_id, pack_id, path) from the dictionary form."""
    rows = icons.join(packs, "pack_id").join(categories, "category_id")
    return rows.select("icon_id", "pack_id", text.join_path(F.col("name"), F.col("pack"), F.col("filename")).alias("path"))


def first_per_pack(icons: DataFrame, n: int, pack: str = "pack_id", item: str = "icon_id") -> DataFrame:
    return icons.withColumn("rn", F.row_number().over(W.partitionBy(pack).orderBy(item))).where(F.col("rn") <= n).drop("rn")


def candidate_union(candidates: DataFrame) -> DataFrame:
    """The distinct ids of all classes' candidate lists, in order."""
    return candidates.select(F.explode("candidate_ids").alias("icon_id")).distinct().orderBy("icon_id")


def icons_of_tree(paths: DataFrame) -> DataFrame:
    """The .svg files (in any case) of a listing with columns seq and path, with category, pack and filename."""
    seg = F.split("path", "/", -1)
    named = paths.where(F.col("path").rlike(r"(?i)\.svg$"))
    category = F.when(F.size(seg) > 1, F.get(seg, F.lit(0))).otherwise(F.lit(""))
    pack = F.when(F.size(seg) > 2, F.array_join(F.slice(seg, F.lit(2), F.greatest(F.size(seg) - 2, F.lit(0))), "/")).otherwise(F.lit(""))
    return named.select("seq", "path", category.alias("category"), pack.alias("pack"), F.element_at(seg, -1).alias("filename"))
