"""Stroke encodings as native columns: stroke-3 rows, QuickDraw strokes, boxes, point filters and SVG output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .text import short_number, xml_escape


def decode_stroke3(rows: DataFrame, key: str = "drawing_id", seq: str = "seq") -> DataFrame:
    """(dx, dy, pen) rows to points: running sums, and a new polyline after each pen lift."""
    so_far = W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(key).orderBy(seq)
    lifted = F.coalesce(F.lag("pen").over(before), F.lit(0))
    rows = rows.withColumn("lifted", lifted)
    return rows.select(key, seq, F.sum("dx").over(so_far).alias("x"), F.sum("dy").over(so_far).alias("y"), F.sum("lifted").over(so_far).cast("int").alias("polyline"))


#: Rows of a drawing that one task sums up by itself.
BLOCK = 65_536


def decode_long_stroke3(rows: DataFrame, key: str = "drawing_id", seq: str = "seq", block: int = BLOCK) -> DataFrame:
    """decode_stroke3() of drawings of any length: blocks of ``block`` numbers of ``seq`` are summed up apart.

    Sums run within a block, and the totals of the blocks before are added: a drawing sends one row per block to the
    task that orders its blocks. ``seq`` is a whole number, so a block has at most ``block`` rows of a drawing.
    """
    cut = rows.withColumn("block", F.floor(F.col(seq) / block))
    here = W.partitionBy(key, "block").orderBy(seq)
    so_far = here.rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumn("lifted", F.coalesce(F.lag("pen").over(here), F.lit(0)))
    local = local.select(key, seq, "block", *[F.sum(c).over(so_far).alias(c) for c in ("dx", "dy", "lifted")])
    totals = cut.groupBy(key, "block").agg(F.sum("dx").alias("t_x"), F.sum("dy").alias("t_y"), F.sum("pen").alias("t_pen"))
    before = W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"before_{c}")
    starts = totals.select(F.col(key).alias("s_key"), F.col("block").alias("s_block"), *[zero(c) for c in ("t_x", "t_y", "t_pen")])
    whole = local.join(starts, (F.col(key) == F.col("s_key")) & (F.col("block") == F.col("s_block")))
    return whole.select(key, seq, (F.col("dx") + F.col("before_t_x")).alias("x"), (F.col("dy") + F.col("before_t_y")).alias("y"), (F.col("lifted") + F.col("before_t_pen")).cast("int").alias("polyline"))


def polylines(points: DataFrame, key: str = "drawing_id", seq: str = "seq") -> DataFrame:
    """Points of polylines to one array per drawing."""
    line = points.groupBy(key, "polyline").agg(F.array_sort(F.collect_list(F.struct(seq, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))).alias("p"))
    line = line.select(key, "polyline", F.transform("p", lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))).alias("line"))
    whole = line.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("polyline", "line"))).alias("l"))
    return whole.select(key, F.transform("l", lambda s: s["line"]).alias("polylines"))


def stroke3_polylines(strokes: Column) -> Column:
    """array<struct<dx, dy, pen>> to polylines, within one row."""
    point = lambda s: F.struct((s["x"]).alias("x"), (s["y"]).alias("y"))
    empty = F.array().cast("array<struct<x:double,y:double>>")
    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), empty.alias("line"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("done"))

    def step(s: Column, d: Column) -> Column:
        x, y = s["x"] + d["dx"].cast("double"), s["y"] + d["dy"].cast("double")
        line = F.array_append(s["line"], point({"x": x, "y": y}))
        up = d["pen"] == 1
        return F.struct(x.alias("x"), y.alias("y"), F.when(up, empty).otherwise(line).alias("line"), F.when(up, F.array_append(s["done"], line)).otherwise(s["done"]).alias("done"))

    return F.aggregate(strokes, start, step)["done"]


def quickdraw_polylines(strokes: Column) -> Column:
    """array<struct<x array, y array, ...>> to polylines; null where the coordinates of a stroke don't pair up."""
    paired = F.forall(strokes, lambda s: (F.size(s["x"]) == F.size(s["y"])) & (F.size(s["x"]) > 0)) & (F.size(strokes) > 0)
    lines = F.transform(strokes, lambda s: F.zip_with(s["x"], s["y"], lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))))
    return F.when(paired, lines)


def stroke3_problem(strokes: Column) -> Column:
    """The first rule that an array<struct<dx, dy, pen>> breaks, or null."""
    return (
        F.when(strokes.isNull() | (F.size(strokes) < 1), F.lit("empty"))
        .when(F.exists(strokes, lambda s: s["dx"].isNull() | s["dy"].isNull() | s["pen"].isNull()), F.lit("missing value"))
        .when(F.exists(strokes, lambda s: F.isnan(s["dx"].cast("double")) | F.isnan(s["dy"].cast("double")) | (F.abs(s["dx"].cast("double")) > 32767) | (F.abs(s["dy"].cast("double")) > 32767)), F.lit("not a 16-bit number"))
        .when(F.exists(strokes, lambda s: ~s["pen"].isin(0, 1)), F.lit("pen state"))
        .when(F.element_at(strokes, -1)["pen"] != 1, F.lit("no final lift"))
    )


def bounding_box(points: DataFrame, key: str) -> DataFrame:
    return points.groupBy(key).agg(F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))


def normalize_square(points: DataFrame, key: str, size: int = 64, padding: float = 4.0, stroke: float = 2.5) -> DataFrame:
    """Points scaled alike in both directions and centred in the padded square: one shuffle, no join."""
    whole = W.partitionBy(key)
    room = size - 2 * (padding + stroke / 2)
    wide, high = F.max("x").over(whole) - F.min("x").over(whole), F.max("y").over(whole) - F.min("y").over(whole)
    scale = F.coalesce(F.least(F.when(wide > 0, F.lit(room) / wide), F.when(high > 0, F.lit(room) / high)), F.lit(1.0))
    sized = points.withColumn("scale", scale).withColumn("low_x", F.min("x").over(whole)).withColumn("low_y", F.min("y").over(whole)).withColumn("wide", wide).withColumn("high", high)
    fit = lambda v, low, extent: (F.col(v) - F.col(low)) * F.col("scale") + (size - F.col(extent) * F.col("scale")) / 2
    return sized.withColumn("nx", fit("x", "low_x", "wide")).withColumn("ny", fit("y", "low_y", "high")).drop("scale", "low_x", "low_y", "wide", "high")


def thin_points(points: Column, least: float = 0.45) -> Column:
    """Points at least so far from the last one kept; the first always stays."""
    def step(kept: Column, p: Column) -> Column:
        last = F.element_at(kept, -1)
        far = F.hypot(p["x"] - last["x"], p["y"] - last["y"]) >= least
        return F.when((F.size(kept) == 0) | far, F.array_append(kept, p)).otherwise(kept)

    return F.aggregate(points, F.array().cast("array<struct<x:double,y:double>>"), step)


def without_repeats(points: Column) -> Column:
    """Points that differ from the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def segment_distance2(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The squared distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.nullif(length, F.lit(0.0))))).otherwise(F.lit(0.0))
    return F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2)


def stroke_element(points: Column, color: Column, width: Column) -> Column:
    """A stroke as an SVG element: a dot, or a path smoothed through the middles of its segments."""
    n = short_number
    at = lambda i: F.get(points, i)
    first, last = at(F.lit(0)), F.element_at(points, -1)
    dot = F.concat(F.lit('<circle cx="'), n(first["x"]), F.lit('" cy="'), n(first["y"]), F.lit('" r="'), n(width / 2), F.lit('" fill="'), xml_escape(color), F.lit('"/>'))

    def curve(i: Column) -> Column:
        a, b = at(i - 1), at(i)
        return F.concat_ws(" ", F.lit("Q"), n(a["x"]), n(a["y"]), n((a["x"] + b["x"]) / 2), n((a["y"] + b["y"]) / 2))

    curves = F.transform(F.sequence(F.lit(1), F.greatest(F.size(points) - 1, F.lit(1))), curve)
    data = F.concat(F.lit("M "), n(first["x"]), F.lit(" "), n(first["y"]), F.lit(" "), F.array_join(curves, " "), F.lit(" L "), n(last["x"]), F.lit(" "), n(last["y"]))
    path = F.concat(F.lit('<path d="'), data, F.lit('" fill="none" stroke="'), xml_escape(color), F.lit('" stroke-width="'), n(width), F.lit('" stroke-linecap="round" stroke-linejoin="round"/>'))
    return F.when(F.size(points) == 1, dot).when(F.size(points) > 1, path)


#: The margin around a drawing on the stage, and the smallest box.
BOX_MARGIN, LEAST_BOX = 12.0, 96.0


def fitted_axis(low: Column, high: Column, stage: Column, margin: float = BOX_MARGIN, least: float = LEAST_BOX) -> Column:
    """struct(start, size) of a drawing's box along one side of the stage: centred on it, but never over the edge."""
    size = F.least(stage, F.greatest(high - low + 2 * margin, F.lit(least)))
    start = F.greatest(F.lit(0.0), F.least(stage - size, (low + high) / 2 - size / 2))
    return F.struct(start.alias("start"), size.alias("size"))


def scaled_stroke(points: Column, width: Column, across: Column, down: Column) -> Column:
    """struct(points, width) of a stroke on a stage scaled by ``across`` and ``down``; its line grows with the root of the area."""
    moved = F.transform(points, lambda p: F.struct((p["x"] * across).alias("x"), (p["y"] * down).alias("y")))
    return F.struct(moved.alias("points"), (width * F.sqrt(across * down)).alias("width"))


def scaled_box(x: Column, y: Column, width: Column, height: Column, across: Column, down: Column) -> Column:
    """struct(x, y, width, height) of a placed icon on a scaled stage."""
    return F.struct((x * across).alias("x"), (y * down).alias("y"), (width * across).alias("width"), (height * down).alias("height"))


def stage_scale(before: Column, after: Column) -> Column:
    """How much a side of the stage grows; a side that isn't a positive finite number raises."""
    sound = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (c > 0) & (c.cast("double") < float("inf"))
    return F.when(sound(before) & sound(after), after.cast("double") / before).otherwise(F.raise_error(F.lit("the sides of a stage must be positive and finite")).cast("double"))
