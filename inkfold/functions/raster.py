"""Polylines to bitmaps: strokes as round-ended capsules on a supersampled grid, one byte per pixel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .svg import Limits, SvgError, outlines

#: The default canvas.
SIZE, PADDING, STROKE_WIDTH, SUPERSAMPLE = 64, 4.0, 2.5, 4
#: The share of ink that an icon may have.
MIN_INK, MAX_INK = 0.01, 0.6
#: The status of an icon.
OK, UNREADABLE, EMPTY, OUT_OF_BAND = 0, 1, 2, 3

POLYLINES = T.ArrayType(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
RASTER = T.StructType([T.StructField("status", T.ByteType()), T.StructField("bitmap", T.BinaryType())])


def check_canvas(size: int, padding: float, stroke: float, supersample: int) -> None:
    whole = isinstance(size, int) and isinstance(supersample, int) and size > 0 and supersample > 0
    if not whole or not all(map(math.isfinite, (padding, stroke))) or padding < 0 or stroke <= 0 or size - 2 * (padding + stroke / 2) <= 0:
        raise ValueError("the canvas leaves no room to draw")


#: Drawings whose grids are filled together, and pairs of a segment and a row that are worked on at once.
DRAWINGS, PAIRS = 32, 1 << 20
#: Cells whose centers are this close to the outline of a stroke are tested one by one.
NEAR = 1e-6


def _normalized(xy: np.ndarray, starts: np.ndarray, size: int, padding: float, stroke: float) -> np.ndarray:
    """The points of drawings that begin at ``starts``, each scaled alike in both directions and centred in the padded square."""
    low, high = np.minimum.reduceat(xy, starts), np.maximum.reduceat(xy, starts)
    extent = high - low
    room = size - 2 * (padding + stroke / 2)
    with np.errstate(divide="ignore"):
        scale = np.where(extent > 0, room / extent, np.inf).min(axis=1, keepdims=True)
    scale[np.isinf(scale)] = 1.0
    of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(xy)]))))
    return (xy - low[of]) * scale[of] + ((size - extent * scale) / 2)[of]


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For so many each: whose it is, and the how manieth."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _reach(a: np.ndarray, b: np.ndarray, y: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines at heights ``y`` enter and leave the capsules around the segments a-b; inf, -inf where they pass by."""
    lo, hi = np.full(len(y), np.inf), np.full(len(y), -np.inf)
    for end in (a, b):
        rest = radius * radius - (y - end[:, 1]) ** 2
        half = np.sqrt(np.maximum(rest, 0))
        inside = rest >= 0
        lo, hi = np.where(inside, np.minimum(lo, end[:, 0] - half), lo), np.where(inside, np.maximum(hi, end[:, 0] + half), hi)
    d = b - a
    length = np.hypot(d[:, 0], d[:, 1])
    with np.errstate(all="ignore"):
        u = d / length[:, None]
        # along the segment s, off it w: y - a_y = s * u_y + w * u_x, with w within the radius
        rise = y - a[:, 1]
        one, other = (rise - radius * u[:, 0]) / u[:, 1], (rise + radius * u[:, 0]) / u[:, 1]
        level = np.abs(u[:, 1]) < 1e-12
        s0, s1 = np.where(level, 0, np.maximum(np.minimum(one, other), 0)), np.where(level, length, np.minimum(np.maximum(one, other), length))
        hit = (length > 0) & np.where(level, np.abs(rise) <= radius, s0 <= s1)
        upright = np.abs(u[:, 0]) < 1e-12
        x0, x1 = (a[:, 0] + s / u[:, 0] - u[:, 1] * rise / u[:, 0] for s in (s0, s1))
        x0, x1 = np.where(upright, a[:, 0] - radius, x0), np.where(upright, a[:, 0] + radius, x1)
        # on a level line w is fixed and s runs over the whole segment
        x0, x1 = np.where(level, a[:, 0], x0), np.where(level, b[:, 0], x1)
    left, right = np.minimum(x0, x1), np.maximum(x0, x1)
    return np.where(hit, np.minimum(lo, left), lo), np.where(hit, np.maximum(hi, right), hi)


def _inside(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, radius: float) -> np.ndarray:
    """Whether points are within the radius of their segments."""
    px, py = x - a[:, 0], y - a[:, 1]
    dx, dy = (b - a).T
    length = dx * dx + dy * dy
    along = np.where(length > 0, np.clip((px * dx + py * dy) / np.where(length > 0, length, 1), 0, 1), 0.0)
    return (px - along * dx) ** 2 + (py - along * dy) ** 2 <= radius * radius


def _filled(a: np.ndarray, b: np.ndarray, drawing: np.ndarray, drawings: int, fine: int, supersample: int, radius: float) -> np.ndarray:
    """The inked cells of the drawings' grids.

    A capsule is convex, so its cells in a row are one run; runs are added as +1 and -1 at their ends and summed up.
    """
    edges = np.zeros(drawings * fine * (fine + 1), np.int32)
    first = np.clip(np.floor((np.minimum(a[:, 1], b[:, 1]) - radius) * supersample).astype(int) - 1, 0, fine)
    last = np.clip(np.ceil((np.maximum(a[:, 1], b[:, 1]) + radius) * supersample).astype(int) + 1, 0, fine)
    rows = last - first
    ends = np.cumsum(rows)
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        of, row = _spread(rows[lo:hi])
        of, row = of + lo, row + first[lo:hi][of]
        y = (row + 0.5) / supersample
        cell = lambda x: np.clip(np.ceil(x * supersample - 0.5), 0, fine).astype(int)  # noqa: E731 - the first center at or behind x
        left, right = _reach(a[of], b[of], y, radius + NEAR)
        met = left <= right
        of, row, y = of[met], row[met], y[met]
        maybe0, maybe1 = cell(left[met]), cell(right[met])
        left, right = _reach(a[of], b[of], y, max(radius - NEAR, 0.0))
        sure0 = np.clip(cell(left), maybe0, maybe1)
        sure1 = np.clip(cell(right), sure0, maybe1)
        base = (drawing[of] * fine + row) * (fine + 1)
        np.add.at(edges, base + sure0, 1)
        np.add.at(edges, base + sure1, -1)
        for start, stop in ((maybe0, sure0), (sure1, maybe1)):
            who, step = _spread(stop - start)
            if len(who):
                at = start[who] + step
                good = _inside(a[of[who]], b[of[who]], (at + 0.5) / supersample, y[who], radius)
                np.add.at(edges, base[who[good]] + at[good], 1)
                np.add.at(edges, base[who[good]] + at[good] + 1, -1)
        lo = hi
    grid = edges.reshape(drawings, fine, fine + 1)
    np.cumsum(grid, axis=2, dtype=np.int32, out=grid)
    return grid[:, :, :-1] > 0


def rasterize_batch(xy: np.ndarray, lines: np.ndarray, drawings: np.ndarray, size: int = SIZE, padding: float = PADDING, stroke: float = STROKE_WIDTH, supersample: int = SUPERSAMPLE) -> list[bytes | None]:
    """The bitmap of each drawing, size x size bytes row by row; None for an empty one or one without finite points.

    ``xy`` are all points; polylines are the runs between ``lines``, drawings the runs of polylines between ``drawings``.
    """
    check_canvas(size, padding, stroke, supersample)
    per_line, per_drawing = np.diff(lines), np.diff(drawings)
    of_line = np.repeat(np.arange(len(per_drawing)), per_drawing)
    bad = per_drawing == 0
    bad[of_line[per_line == 0]] = True
    of_point = np.repeat(of_line, per_line)
    with np.errstate(invalid="ignore"):
        bad[of_point[~(np.isfinite(xy) & (np.abs(xy) < 1e150)).all(axis=1)]] = True
    out: list[bytes | None] = [None] * len(per_drawing)
    good = np.flatnonzero(~bad)
    fine = size * supersample
    for lo in range(0, len(good), DRAWINGS):
        some = good[lo : lo + DRAWINGS]
        rank = np.full(len(per_drawing), -1)
        rank[some] = np.arange(len(some))
        points, mine = rank[of_point] >= 0, rank[of_line] >= 0
        counts = per_line[mine]
        starts = np.searchsorted(rank[of_point[points]], np.arange(len(some)))
        p = _normalized(xy[points], starts, size, padding, stroke)
        # a line's points but the last begin a segment; a single point is one by itself
        first = np.cumsum(counts) - counts
        of, step = _spread(np.maximum(counts - 1, 1))
        a = first[of] + step
        b = np.where(counts[of] > 1, a + 1, a)
        ink = _filled(p[a], p[b], rank[of_line[mine]][of], len(some), fine, supersample, stroke / 2)
        down = ink.reshape(len(some), size, supersample, fine).view(np.uint8).sum(axis=2, dtype=np.uint16)
        shares = down.reshape(len(some), size, size, supersample).sum(axis=3, dtype=np.int64)
        pixels = np.floor(shares * 255 / supersample**2 + 0.5).astype(np.uint8)
        for i, grid in zip(some, pixels):
            out[i] = grid.tobytes()
    return out


def _edges(counts) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(np.fromiter(counts, np.int64))))


def rasterize(lines, size: int = SIZE, padding: float = PADDING, stroke: float = STROKE_WIDTH, supersample: int = SUPERSAMPLE) -> bytes:
    """The bitmap of one drawing; ValueError for empty or non-finite polylines."""
    arrays = [np.asarray(line, dtype=np.float64).reshape(-1, 2) for line in lines]
    xy = np.concatenate([np.empty((0, 2)), *arrays])
    (bitmap,) = rasterize_batch(xy, _edges(map(len, arrays)), np.array([0, len(arrays)]), size, padding, stroke, supersample)
    if bitmap is None:
        raise ValueError("polylines must hold finite points")
    return bitmap


def ink_coverage(bitmap: bytes) -> float:
    return float(np.frombuffer(bitmap, np.uint8).mean() / 255)


def raster_icons(texts: list, min_ink: float = MIN_INK, max_ink: float = MAX_INK, limits: Limits | None = None) -> list[tuple[int, bytes | None]]:
    """(status, bitmap) of each document, the bitmap only where the status is OK; a bad one never touches its neighbours."""
    drawn = outlines(texts, limits)
    fit = [i for i, lines in enumerate(drawn) if not isinstance(lines, SvgError) and lines]
    every = [line for i in fit for line in drawn[i]]
    bitmaps = rasterize_batch(np.concatenate([np.empty((0, 2)), *every]), _edges(map(len, every)), _edges(len(drawn[i]) for i in fit))
    out: list[tuple[int, bytes | None]] = [(UNREADABLE, None) if isinstance(lines, SvgError) else (EMPTY, None) for lines in drawn]
    for i, bitmap in zip(fit, bitmaps):
        band = bitmap is not None and min_ink <= ink_coverage(bitmap) <= max_ink
        out[i] = (UNREADABLE, None) if bitmap is None else (OK, bitmap) if band else (OUT_OF_BAND, None)
    return out


def raster_icon(text: str | None, min_ink: float = MIN_INK, max_ink: float = MAX_INK, limits: Limits | None = None) -> tuple[int, bytes | None]:
    return raster_icons([text], min_ink, max_ink, limits)[0]


@F.arrow_udf(T.DoubleType())
def ink_share(bitmaps: pa.Array) -> pa.Array:
    """ink_coverage() of each bitmap; null for null or without a pixel."""
    return pa.array([ink_coverage(b) if b else None for b in bitmaps.to_pylist()], pa.float64())


def band_status(share: Column, min_ink: float = MIN_INK, max_ink: float = MAX_INK) -> Column:
    """The status of an icon by the share of its ink."""
    return F.when(share.isNull(), F.lit(UNREADABLE)).when(share == 0, F.lit(EMPTY)).when(share.between(min_ink, max_ink), F.lit(OK)).otherwise(F.lit(OUT_OF_BAND))


@F.pandas_udf(RASTER)
def rasterize_svg(text: pd.Series) -> pd.DataFrame:
    """struct(status, bitmap) of each document; a bad one never touches its neighbours."""
    return pd.DataFrame(raster_icons(text.tolist()), columns=["status", "bitmap"]).astype({"status": "int8"})


@F.pandas_udf(POLYLINES)
def polylines_of_svg(text: pd.Series) -> pd.Series:
    """The polylines of each document; null where it can't be read."""
    drawn = outlines(text.tolist())
    return pd.Series([None if isinstance(lines, SvgError) else [[{"x": x, "y": y} for x, y in line.tolist()] for line in lines] for lines in drawn], index=text.index)


@F.arrow_udf(T.BinaryType())
def rasterize_polylines(lines: pa.Array) -> pa.Array:
    """The bitmap of each drawing; null for an empty or invalid one. Points stay in Arrow's buffers."""
    drawings, inner = _offsets(lines), lines.flatten()
    points = inner.flatten()
    xy = np.stack([pc.fill_null(points.field(c).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in "xy"], axis=1)
    return pa.array(rasterize_batch(xy, _offsets(inner), drawings), pa.binary())


def _offsets(lists: pa.Array) -> np.ndarray:
    """Where the lists of an array begin and end once they are flattened; a null has no element."""
    return _edges(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
