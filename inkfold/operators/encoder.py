"""The hook for neural encoders: bitmaps in, embeddings and logits out, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import raster, vectors

BATCH = 512
BLANK = b"\x00" * 4096
#: Takes n x 64 x 64 numbers from 0 to 1, returns n embeddings and n rows of logits.
Encoder = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


#: The shape of a model's metadata; shapes mix words and numbers and are read as text.
METADATA = """
schemaVersion int, kind string, classes array<string>, rasterizer struct<size: int, padding: double, strokeWidth: double, supersample: int>,
model struct<format: string, embeddingDim: int, input: struct<name: string, dtype: string, normalization: string, shape: array<string>>,
  outputs: struct<embedding: struct<name: string, dtype: string, normalization: string, shape: array<string>>, logits: struct<name: string, dtype: string, shape: array<string>>>>
"""


def metadata_problem(m: Column) -> Column:
    """The first rule that a model's metadata (a struct of METADATA) breaks, or null: what encode() relies on."""
    raster, model = m["rasterizer"], m["model"]
    into, embedding, logits = model["input"], model["outputs"]["embedding"], model["outputs"]["logits"]
    size, text = raster["size"], lambda c: c.cast("string")
    tensor = lambda t, *shape: t["name"].isNotNull() & (t["dtype"] == "float32") & (t["shape"] == F.array(F.lit("batch"), *shape))
    room = (size > 0) & (raster["supersample"] > 0) & (raster["padding"] >= 0) & (raster["strokeWidth"] > 0) & (size - 2 * (raster["padding"] + raster["strokeWidth"] / 2) > 0)
    rules = {
        "kind": (m["schemaVersion"] == 1) & (m["kind"] == "sketch-embedder"),
        "classes": (F.size(m["classes"]) >= 2) & (F.size(F.array_distinct(m["classes"])) == F.size(m["classes"])) & ~F.exists(m["classes"], lambda c: c.isNull() | (c == "")),
        "rasterizer": room,
        "format": model["format"] == "ONNX",
        "dimension": model["embeddingDim"] >= 8,
        "input": tensor(into, F.lit("1"), text(size), text(size)) & (into["normalization"] == "uint8 / 255"),
        "embedding": tensor(embedding, text(model["embeddingDim"])) & (embedding["normalization"] == "L2"),
        "logits": tensor(logits, text(F.size(m["classes"]))),
    }
    problem = F.lit(None).cast("string")
    for what, holds in reversed(rules.items()):
        problem = F.when(~F.coalesce(holds, F.lit(False)), F.lit(what)).otherwise(problem)
    return problem


def onnx_encoder(model: bytes) -> Encoder:
    """An encoder from an ONNX model with outputs embedding and logits; the session opens once per worker."""
    state: dict = {}

    def encode(images: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if "session" not in state:
            import onnxruntime

            state["session"] = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        session = state["session"]
        embedding, logits = session.run(["embedding", "logits"], {session.get_inputs()[0].name: images[:, None].astype(np.float32)})
        return embedding, logits

    return encode


def encode(bitmaps: DataFrame, encoder: Encoder, key: str = "id", dim: int = 64) -> DataFrame:
    """(key, embedding, logits) of the bitmaps that aren't blank; wrong shapes, values or lengths raise."""
    drawn = bitmaps.where(F.col("bitmap").isNotNull() & (F.col("bitmap") != F.lit(BLANK))).select(key, "bitmap")

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for lo in range(0, len(part), BATCH):
                piece = part.iloc[lo : lo + BATCH]
                images = np.stack([np.frombuffer(b, np.uint8) for b in piece["bitmap"]]).reshape(-1, 64, 64) / 255.0
                embedding, logits = encoder(images)
                if embedding.shape != (len(piece), dim) or not np.isfinite(embedding).all() or not np.isfinite(logits).all():
                    raise ValueError("the encoder broke its contract")
                if (np.abs(np.linalg.norm(embedding, axis=1) - 1) > 1e-3).any():
                    raise ValueError("embeddings must have length 1")
                yield pd.DataFrame({key: piece[key].to_numpy(), "embedding": list(embedding.astype(np.float32)), "logits": list(logits.astype(np.float32))})

    return drawn.mapInPandas(rows, f"{key} {bitmaps.schema[key].dataType.simpleString()}, embedding array<float>, logits array<float>")


def embed_drawings(drawings: DataFrame, encoder: Encoder, key: str = "id", limit: int = 5) -> DataFrame:
    """(key, embedding, predictions) of drawings (key, polylines; a key has one), the best ``limit`` classes first.

    A drawing that can't be drawn or leaves no ink never reaches the encoder: its embedding is null, its predictions are empty.
    """
    bitmaps = drawings.select(key, raster.rasterize_polylines(F.col("polylines")).alias("bitmap"))
    found = encode(bitmaps, encoder, key).select(key, "embedding", vectors.top_predictions(F.col("logits"), limit).alias("predictions"))
    return drawings.select(key).join(found, key, "left").withColumn("predictions", F.coalesce("predictions", F.array().cast(found.schema["predictions"].dataType)))
