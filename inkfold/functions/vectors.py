"""Vector expressions over array columns; arithmetic is double, stored vectors are float."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def is_unit(v: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(v) - 1) <= tolerance


def once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once and not for every element that ``use`` compares it with."""
    return F.transform(F.array(value), use)[0]


def normalize(v: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    return once(norm(v), lambda n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))


def quantize(v: Column) -> Column:
    """struct(codes array<tinyint>, scale float): the largest magnitude becomes 127, in 32-bit steps, halves to even."""
    peak = F.array_max(F.transform(v, lambda x: F.abs(x)))
    step = F.when(peak > 0, (peak / F.lit(127.0)).cast("float")).otherwise(F.lit(1.0).cast("float"))
    code = lambda x, scale: F.greatest(F.least(F.rint((x / scale).cast("float").cast("double")), F.lit(127.0)), F.lit(-127.0)).cast("tinyint")
    return once(step, lambda scale: F.struct(F.transform(v, lambda x: code(x, scale)).alias("codes"), scale.alias("scale")))


def scaled_dot(codes: Column, scale: Column, q: Column) -> Column:
    """The product of a quantized vector with a plain one."""
    return dot(codes, q) * scale.cast("double")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def log_softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x.cast("double") - top)))
    return F.transform(logits, lambda x: x.cast("double") - top - total)


def top_predictions(logits: Column, limit: int = 5) -> Column:
    """array<struct<class_index, probability>> by logit, ties by the smaller class; zeros of an underflown softmax keep the order of logits."""
    rows = F.transform(F.arrays_zip(logits.alias("logit"), softmax(logits).alias("p")), lambda x, i: F.struct((-x["logit"].cast("double")).alias("k"), i.alias("class_index"), x["p"].alias("probability")))
    best = F.slice(F.array_sort(rows), 1, limit)
    return F.transform(best, lambda x: F.struct(x["class_index"].alias("class_index"), x["probability"].alias("probability")))
