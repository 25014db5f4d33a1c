"""The flattening of curves and the rasteriser against slow, plain versions of their definitions."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions import raster, strokes, svg
from inkfold.plans import catalog

SF = "/root/testdata/sf0.001"


def halved(p, width, depth=0):
    """The chords' ends of one cubic, by recursion."""
    (x0, y0), (x1, y1), (x2, y2), (x3, y3) = p
    cx, cy = x3 - x0, y3 - y0
    away = abs((x1 - x3) * cy - (y1 - y3) * cx) + abs((x2 - x3) * cy - (y2 - y3) * cx)
    if depth == 16 or away**2 <= width**2 * (cx**2 + cy**2):
        return [p[3]]
    mid = lambda a, b: ((a[0] + b[0]) / 2, (a[1] + b[1]) / 2)
    a, b, c = mid(p[0], p[1]), mid(p[1], p[2]), mid(p[2], p[3])
    d, e = mid(a, b), mid(b, c)
    return halved((p[0], a, d, mid(d, e)), width, depth + 1) + halved((mid(d, e), e, c, p[3]), width, depth + 1)


def plain_bitmap(lines, size=64, padding=4.0, stroke=2.5, supersample=4):
    """Every fine cell against every segment."""
    points = [p for line in lines for p in line]
    low = [min(p[k] for p in points) for k in (0, 1)]
    extent = [max(p[k] for p in points) - low[k] for k in (0, 1)]
    room = size - 2 * (padding + stroke / 2)
    scale = min([room / e for e in extent if e > 0], default=1.0)
    place = lambda p: [(p[k] - low[k]) * scale + (size - extent[k] * scale) / 2 for k in (0, 1)]
    at = (np.arange(size * supersample) + 0.5) / supersample
    ink = np.zeros((len(at), len(at)), bool)
    for line in lines:
        for a, b in zip(line, line[1:]) if len(line) > 1 else [(line[0], line[0])]:
            (ax, ay), (bx, by) = place(a), place(b)
            px, py, dx, dy = at[None, :] - ax, at[:, None] - ay, bx - ax, by - ay
            length = dx * dx + dy * dy
            along = np.clip((px * dx + py * dy) / length, 0, 1) if length > 0 else 0.0
            ink |= (px - along * dx) ** 2 + (py - along * dy) ** 2 <= (stroke / 2) ** 2
    share = ink.reshape(size, supersample, size, supersample).sum(axis=(1, 3))
    return np.floor(share * 255 / supersample**2 + 0.5).astype(np.uint8).tobytes()


def test_all_cubics_of_a_batch_are_halved_like_one():
    r = random.Random(8)
    some = [tuple((r.choice([0, 1, 7.5, r.uniform(-50, 50)]), r.uniform(-50, 50)) for _ in range(4)) for _ in range(150)]
    some += [((1, 1), (1, 1), (1, 1), (1, 1)), ((0, 0), (9, 0), (-3, 0), (5, 0)), ((2, 2), (8, 9), (8, 9), (2, 2))]
    width = np.array([r.choice([0.01, 0.3, 4.0]) for _ in some])
    index, ends, lost = svg.cut_cubics(np.array(some, float), width, np.arange(len(some)), 10**6)
    assert not lost
    for i, p in enumerate(some):
        assert [tuple(e) for e in ends[index == i]] == halved(p, width[i])


def test_outlines_of_a_batch_follow_the_definition():
    r = random.Random(2)
    number = lambda: f"{r.uniform(-30, 90):.3f}"
    pair = lambda: f"{number()} {number()}"
    texts = []
    for _ in range(20):
        d = f"M{pair()}" + "".join(r.choice([f"C{pair()} {pair()} {pair()}", f"L{pair()}", f"S{pair()} {pair()}", f"Q{pair()} {pair()}"]) for _ in range(6)) + r.choice(["", "Z"])
        texts.append(f'<svg><path d="{d}"/></svg>')
    texts[3:3] = ["<svg><path d='M1'/></svg>", None, "<svg/>"]
    got = svg.outlines(texts)
    assert isinstance(got[3], svg.SvgError) and isinstance(got[4], svg.SvgError) and got[5] == []
    for text, lines in zip(texts, got):
        if isinstance(lines, svg.SvgError) or not lines:
            continue
        (c,) = svg.contours(text, svg.Limits())
        every = [c.start, *(p for s in c.segments for p in s)]
        span = math.hypot(max(p.real for p in every) - min(p.real for p in every), max(p.imag for p in every) - min(p.imag for p in every))
        line = [(c.start.real, c.start.imag)]
        for s in c.segments:
            whole = [line[-1], *((p.real, p.imag) for p in s)]
            line += halved(tuple(whole), span / 256) if len(s) == 3 else whole[1:]
        line += line[:1] if c.closed else []
        assert [tuple(p) for p in lines[0]] == [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
        assert svg.svg_to_polylines(text) == [[tuple(p) for p in lines[0]]]


def test_a_drawing_with_too_many_vertices_is_refused_alone():
    wild = '<svg><path d="M0 0 C9000 5 -9000 9 3 1"/></svg>'
    fine = '<svg><path d="M2 3 L9 4"/></svg>'
    got = svg.outlines([fine, wild, fine], svg.Limits(vertices=12, resolution=100_000))
    assert isinstance(got[1], svg.SvgError) and [tuple(p) for p in got[0][0]] == [tuple(p) for p in got[2][0]] == [(2, 3), (9, 4)]


@pytest.mark.parametrize("canvas", [(64, 4.0, 2.5, 4), (24, 3.0, 2.0, 4), (17, 1.0, 1.3, 3), (8, 0.0, 5.0, 2), (30, 2.0, 0.2, 1)])
def test_batch_equals_every_cell_against_every_segment(canvas):
    """Random walks, whole numbers that put edges on cell centers, upright and level lines, points, and drawings that are none."""
    r = random.Random(canvas[0])
    walk = lambda step: [(0, 0)] + [(x, y) for x, y in np.cumsum([[step(), step()] for _ in range(r.randint(1, 12))], axis=0).tolist()]
    drawings = [[walk(lambda: r.uniform(-9, 9)) for _ in range(r.randint(1, 4))] for _ in range(20)]
    drawings += [[walk(lambda: r.randint(-4, 4)) for _ in range(2)] for _ in range(40)]
    drawings += [[[(0, 0), (8, 0)]], [[(3, 0), (3, 5)]], [[(5, 5)]], [[(1, 1), (1, 1)]], [[(0, 0), (4, 4)], [(4, 0), (0, 4)]], [[(0, 0), (1e-9, 40)]], [[(0, 0), (1e6, 1e-7)]]]
    broken = {3: [], 9: [[]], 11: [[(math.nan, 0.0)]], 50: [[(1.0, 2.0)], [(math.inf, 0)]]}
    for at, drawing in broken.items():
        drawings[at] = drawing
    lines = [line for d in drawings for line in d]
    xy = np.array([p for line in lines for p in line], float)
    got = raster.rasterize_batch(xy, np.cumsum([0, *map(len, lines)]), np.cumsum([0, *map(len, drawings)]), *canvas)
    for i, drawing in enumerate(drawings):
        assert got[i] == (None if i in broken else plain_bitmap(drawing, *canvas)), i


def test_stroke_rasters_equal_the_plain_version(spark):
    lines = strokes.polylines(strokes.decode_stroke3(catalog._strokes(spark, SF))).collect()
    got = {r.drawing_id: r.digest for r in catalog.QUERIES["stroke_rasters"](spark, SF).collect()}
    for r in lines[:12]:
        assert got[r.drawing_id] == hashlib.sha256(plain_bitmap([[(p.x, p.y) for p in line] for line in r.polylines])).hexdigest()


def test_svg_rasters_equal_the_plain_version(spark):
    got = {r.id: r for r in catalog.QUERIES["svg_rasters"](spark, SF).collect()}
    seen = 0
    for r in catalog._svgs(spark, SF).where("id <= 24").collect():
        try:
            lines = svg.svg_to_polylines(r.svg)
        except svg.SvgError:
            assert (got[r.id].status, got[r.id].digest) == (raster.UNREADABLE, None)
            continue
        if not lines:
            assert (got[r.id].status, got[r.id].digest) == (raster.EMPTY, None)
            continue
        bitmap = plain_bitmap(lines)
        share = sum(bitmap) / 255 / len(bitmap)
        assert got[r.id].status == (raster.OK if 0.01 <= share <= 0.6 else raster.OUT_OF_BAND)
        assert got[r.id].digest == (hashlib.sha256(bitmap).hexdigest() if got[r.id].status == raster.OK else None)
        seen += 1
    assert seen >= 8


def test_null_points_and_drawings(spark):
    rows = spark.createDataFrame([(0, [[(0.0, 0.0), (3.0, None)]]), (1, None), (2, []), (3, [None, [(0.0, 1.0)]]), (4, [[(0.0, 0.0), (3.0, 1.0)]])], "id int, lines array<array<struct<x:double,y:double>>>")
    out = {r.id: r.b for r in rows.coalesce(1).select("id", raster.rasterize_polylines(F.col("lines")).alias("b")).collect()}
    assert [i for i, b in out.items() if b is not None] == [4] and bytes(out[4]) == plain_bitmap([[(0, 0), (3, 1)]])
