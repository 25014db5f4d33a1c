"""Sources and sinks over files. All of them are Spark readers and writers, so any store that Spark reads will do."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.curation import fold_decisions

#: The shape of a candidate manifest.
CANDIDATE_MANIFEST = """
schemaVersion int, fingerprint string,
source struct<repository: string, ref: string, commit: string>,
classes array<struct<name: string, aliases: array<string>,
  candidates: array<struct<id: long, category: string, name: string, pack: string, path: string, score: int, url: string>>>>
"""
#: The shape of a token index.
TOKEN_INDEX = """
schemaVersion int, tokenizer string,
source struct<repository: string, ref: string, commit: string, iconCount: long, categoryCount: long, packCount: long, tokenCount: long>,
categories array<string>, packs array<array<string>>, icons array<array<string>>, tokens map<string, array<long>>
"""


def read_document(spark: SparkSession, path: str, schema: str, version: int = 1) -> DataFrame:
    """One JSON document (plain or .gz) per file, against a schema; another schemaVersion raises."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)
    wrong = F.raise_error(F.concat(F.lit("unsupported schemaVersion "), F.coalesce(F.col("schemaVersion").cast("string"), F.lit("null"))))
    return df.withColumn("schemaVersion", F.when(F.col("schemaVersion").eqNullSafe(F.lit(version)), F.col("schemaVersion")).otherwise(wrong))


def write_document(df: DataFrame, path: str) -> None:
    """JSON rows; the commit protocol shows a finished table or none."""
    df.write.mode("overwrite").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(position, line): trimmed lines that aren't empty, each at its first place."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("position", "line"))
    return rows.select("position", F.trim("line").alias("line")).where(F.col("line") != "").groupBy("line").agg(F.min("position").alias("position")).select("position", "line")


def token_tables(document: DataFrame) -> dict[str, DataFrame]:
    """A token index as tables: category, pack, icon and posting."""
    packs = document.select(F.posexplode("packs").alias("pack_id", "p"))
    icons = document.select(F.posexplode("icons").alias("icon_id", "i"))
    return {
        "category": document.select(F.posexplode("categories").alias("category_id", "name")),
        "pack": packs.select("pack_id", F.get("p", F.lit(0)).cast("int").alias("category_id"), F.get("p", F.lit(1)).alias("pack")),
        "icon": icons.select(F.col("icon_id").cast("long").alias("icon_id"), F.get("i", F.lit(0)).cast("int").alias("pack_id"), F.get("i", F.lit(1)).alias("filename")),
        "posting": document.select(F.explode("tokens").alias("token", "icon_ids")),
    }


def candidate_rows(document: DataFrame) -> DataFrame:
    """A candidate manifest as rows: class, rank and the candidate's fields."""
    rows = document.select(F.explode("classes").alias("c")).select(F.col("c.name").alias("class"), F.posexplode("c.candidates").alias("rank", "k"))
    return rows.select("class", "rank", "k.*")


def read_blobs(spark: SparkSession, path: str, pattern: str = "*.svg", most: int = 512 * 1024) -> DataFrame:
    """(path, digest, content, accepted) of files below a folder; empty files have no row, oversized ones are not accepted."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    return df.select("path", F.sha2("content", 256).alias("digest"), F.when(F.col("length").between(1, most), F.col("content")).alias("content"), F.col("length").between(1, most).alias("accepted"))


def distinct_blobs(blobs: DataFrame) -> DataFrame:
    """One row of content per digest: the content-addressed form, named aa/<digest>.svg."""
    rows = blobs.where("accepted").dropDuplicates(["digest"])
    return rows.select(F.concat_ws("/", F.substring("digest", 1, 2), F.concat("digest", F.lit(".svg"))).alias("name"), "digest", "content")


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """(icon_id, digest): the last record of each icon in an append-only journal; a dash says that it is gone (null)."""
    rows = spark.read.schema("icon_id long, digest string").csv(path, sep="\t")
    numbered = rows.select(F.lit("").alias("class"), F.col("icon_id").alias("candidate_id"), F.col("digest").alias("decision"), F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("seq"))
    return fold_decisions(numbered).select(F.col("candidate_id").alias("icon_id"), F.nullif("decision", F.lit("-")).alias("digest"))


def fetch_status(status: Column) -> Column:
    """What an HTTP status means for a fetch: ok, missing, retry or failed."""
    return F.when(status.between(200, 299), F.lit("ok")).when(status.isin(404, 410), F.lit("missing")).when(status.isin(403, 408, 425, 429) | (status >= 500), F.lit("retry")).otherwise(F.lit("failed"))


def retry_delay(attempt: Column, jitter: Column) -> Column:
    """Milliseconds before the next attempt: doubling from a second up to thirty, and up to 250 by chance."""
    return F.least(F.lit(1000.0) * F.pow(F.lit(2.0), attempt), F.lit(30000.0)) + jitter * 250


def trusted_response(host: Column, content_type: Column, size: Column, most: int, cdn: str = "cdn.jsdelivr.net") -> Column:
    kind = F.lower(F.trim(F.element_at(F.split(F.coalesce(content_type, F.lit("")), ";"), 1)))
    return F.coalesce((host == cdn) & kind.isin("image/svg+xml", "text/plain", "application/xml", "text/xml") & (size.isNull() | (size <= most)), F.lit(False))


def read_npy_bitmaps(spark: SparkSession, path: str, size: int = 64) -> DataFrame:
    """(path, row, bitmap) of NPY arrays of uint8 images."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                images = np.load(io.BytesIO(content), allow_pickle=False)
                if images.dtype != np.uint8 or images.shape[1:] != (size, size):
                    raise ValueError(f"{name} must hold {size} x {size} bytes per image")
                for lo in range(0, len(images), 1000):
                    yield pd.DataFrame({"path": name, "row": range(lo, min(lo + 1000, len(images))), "bitmap": [x.tobytes() for x in images[lo : lo + 1000]]})

    return files.mapInPandas(rows, "path string, row long, bitmap binary")


@F.pandas_udf(T.ArrayType(T.ByteType()))
def int8_codes(blob: pd.Series) -> pd.Series:
    """Bytes (decoded from base64 if need be) as signed numbers."""
    return blob.map(lambda b: np.frombuffer(b, np.int8).tolist() if b is not None else None)


def unpack_shard(blob: bytes, count: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scales) of a shard file: all codes row by row, then all scales."""
    if len(blob) != count * (dim + 4):
        raise ValueError("a shard must have dim + 4 bytes per vector")
    return np.frombuffer(blob, np.int8, count * dim).reshape(count, dim), np.frombuffer(blob, "<f4", count, count * dim)


def pack_shard(codes: np.ndarray, scales: np.ndarray) -> bytes:
    return np.ascontiguousarray(codes, np.int8).tobytes() + np.ascontiguousarray(scales, "<f4").tobytes()


def verified_shards(spark: SparkSession, folder: str, shards: DataFrame, dim: int) -> DataFrame:
    """(shard, row, codes, scale) of the shard files beside an index document; a wrong size or digest raises.

    ``shards``: shard, count, bytes, sha256.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(folder)
    files = files.select(F.regexp_extract("path", r"shard-([0-9]+)\.bin$", 1).cast("int").alias("shard"), "length", "content")
    rows = shards.select("shard", "count", "bytes", "sha256").join(files, "shard", "left")
    # Spark lists no empty files
    empty = F.when(F.col("bytes") == 0, F.lit(b""))
    rows = rows.withColumn("content", F.coalesce("content", empty)).withColumn("length", F.coalesce("length", F.octet_length("content").cast("long")))
    wrong = F.when(F.col("content").isNull(), F.lit(" is missing")).when((F.col("length") != F.col("bytes")) | (F.col("bytes") != F.col("count") * (dim + 4)), F.lit(" has an unexpected size")).when(F.sha2("content", 256) != F.col("sha256"), F.lit(" has another digest"))
    checked = F.when(wrong.isNull(), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("shard "), F.col("shard").cast("string"), wrong)))

    def unpack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for shard, count, content in zip(part["shard"], part["count"], part["content"]):
                codes, scales = unpack_shard(content, count, dim)
                for lo in range(0, count, 1000):
                    yield pd.DataFrame({"shard": shard, "row": range(lo, min(lo + 1000, count)), "codes": [c.tolist() for c in codes[lo : lo + 1000]], "scale": scales[lo : lo + 1000]})

    return rows.select("shard", "count", checked.alias("content")).mapInPandas(unpack, "shard int, row long, codes array<tinyint>, scale float")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, centroids) as clustering.write_index wrote them."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/centroids")


def svg_document(strokes: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """(key, svg): the elements of a drawing in order, in one document; ``strokes`` has key, seq and element."""
    body = strokes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "element"))).alias("s"))
    head = F.lit(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}">')
    return body.select(key, F.concat(head, F.array_join(F.transform("s", lambda x: x["element"]), ""), F.lit("</svg>")).alias("svg"))


