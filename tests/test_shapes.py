import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.functions import raster, strokes
from inkfold.functions.svg import MAX_CHARACTERS, Limits, SvgError, svg_to_polylines

CURVE = '<path d="M4 9C11 61 77 70 90 5"/>'


def wrap(body):
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 100 100">{body}</svg>'


def lines(body):
    return [[list(p) for p in line] for line in svg_to_polylines(wrap(body))]


def box(drawn):
    p = np.array([p for line in drawn for p in line])
    return [*p.min(axis=0), *p.max(axis=0)]


#: Own drawings; what they must give follows from the SVG specification.
@pytest.mark.parametrize("body, expected", [
    ('<path d="M3 4 h6 v-2 H1 V9 z"/>', [[[3, 4], [9, 4], [9, 2], [1, 2], [1, 9], [3, 4]]]),
    ('<path d="m8 1 2 3 -1 4"/>', [[[8, 1], [10, 4], [9, 8]]]),
    ('<path d="M7 7 14 21 m1 1 2 2"/>', [[[7, 7], [14, 21]], [[15, 22], [17, 24]]]),
    ('<path d="M6 6 a0 3 0 0 0 5 8"/>', [[[6, 6], [11, 14]]]),
    ('<rect x="-4" y="2" width="7" height="5"/>', [[[-4, 2], [3, 2], [3, 7], [-4, 7], [-4, 2]]]),
    ('<polygon points="2 3 8 3 5 9"/>', [[[2, 3], [8, 3], [5, 9], [2, 3]]]),
    ('<polyline points="4,4 6,1, 9,5"/>', [[[4, 4], [6, 1], [9, 5]]]),
    ('<line x1="-2" y1="6" x2="5" y2="-1"/>', [[[-2, 6], [5, -1]]]),
    ('<g transform="scale(3) translate(1 2)"><line x2="4" y2="1" transform="translate(2)"/></g>', [[[9, 6], [21, 9]]]),
    ('<line x2="6" y2="2" transform="matrix(2 0 0 -1 7 8)"/>', [[[7, 8], [19, 6]]]),
    ('<circle r="9" fill="none"/><line x2="6" y2="7"/>', [[[0, 0], [6, 7]]]),
    ('<path d="M2 2 L9 4" stroke="#a1b2c3" style="fill:none"/>', [[[2, 2], [9, 4]]]),
    ('<line id="x > y" x2="3" y2="8"/>', [[[0, 0], [3, 8]]]),
    ('<line aria-label="salt &amp; pepper" x2="8" y2="3"/>', [[[0, 0], [8, 3]]]),
    ('<style>line { stroke: <!-- none --> }</style><!-- <rect width="5" height="5"/> --><line x2="4" y2="9"/>', [[[0, 0], [4, 9]]]),
])
def test_geometry(body, expected):
    assert lines(body) == expected


@pytest.mark.parametrize("body", [
    "<g></g>", '<rect width="6"/>', '<ellipse rx="0" ry="4"/>', '<polygon points="3 3"/>', '<circle r="4" fill="none"/>', '<rect width="5" height="6" stroke="none" fill="none"/>', '<g display="none"><line x2="7" y2="7"/></g>',
    '<g opacity="0"><circle r="8"/></g>', '<line x2="4" y2="4" visibility="hidden"/>', '<defs><g><circle r="5"/></g></defs>', "<text>words</text>", '<g style="fill:none"><circle r="7"/></g>', '<use href="#star"/>', '<image href="star.png"/>',
])
def test_nothing_drawn(body):
    assert lines(body) == []


@pytest.mark.parametrize("source, limits, message", [
    ('<!DOCTYPE svg [ <!ENTITY star "*"> ]><svg/>', {}, "internal subsets"), ('<svg/><!ENTITY moon "o">', {}, "entity declarations"), ("<!DOCTYPE svg", {}, "unterminated"), (" " * (MAX_CHARACTERS + 7), {}, "maximum supported size"), (3, {}, "must be a string"),
    (wrap('<line x2="2" y2="5"/>' * 9), {"elements": 5}, "element budget"), (wrap('<path d="M1 1 l1 2 2 1 1 1 3 2"/>'), {"segments": 3}, "segment budget"), (wrap(CURVE), {"vertices": 3, "resolution": 2048}, "vertex budget"),
    (wrap('<path d="V6"/>'), {}, "without a move"), (wrap('<path d="4 4 8 8"/>'), {}, "start with a command"), (wrap('<path d="M5 5 H wide"/>'), {}, "number|command"), (wrap('<path d="M1 1 a4 4 0 0 7 6 6"/>'), {}, "flag must be 0 or 1"),
    (wrap('<path d="M2 2 B6 6"/>'), {}, "unsupported"), (wrap('<line x2="4" y2="4" transform="translate(far)"/>'), {}, "non-finite"),
])
def test_refused(source, limits, message):
    with pytest.raises(SvgError, match=message):
        svg_to_polylines(source, Limits(**limits))


def test_curves():
    flat = lines(CURVE)[0]
    assert len(flat) > 4 and flat[0] == [4, 9] and flat[-1] == [90, 5] and 50 < box([flat])[3] < 61
    smooth, plain = lines('<path d="M2 7c3 9 14 8 15 0s6 -11 12 1"/>'), lines('<path d="M2 7C5 16 16 15 17 7C18 -1 23 -4 29 8"/>')
    assert smooth == plain
    # a parabola with its apex at 3/4 of the control point's height, and its cubic twin
    quad, cubic = lines('<path d="M0 0Q30 48 60 0"/>')[0], lines('<path d="M0 0C20 32 40 32 60 0"/>')[0]
    assert np.allclose(quad, cubic, atol=1e-9) and np.isclose(box([quad])[3], 24)
    assert np.allclose(box(lines('<circle cx="31" cy="44" r="17"/>')), [14, 27, 48, 61], atol=0.05)
    assert np.allclose(box(lines('<ellipse cx="20" cy="70" rx="16" ry="6"/>')), [4, 64, 36, 76], atol=0.05)
    assert np.allclose(box(lines('<rect x="3" y="5" width="30" height="18" rx="7" ry="4"/>')), [3, 5, 33, 23], atol=1e-6)
    arc = lines('<path d="M6 40a34 34 0 0 1 34 -34"/>')
    assert np.allclose([arc[0][0], arc[0][-1]], [[6, 40], [40, 6]]) and np.allclose(box(arc), [6, 6, 40, 40], atol=1e-6)
    assert all(abs(math.hypot(x - 40, y - 40) - 34) < 0.05 for x, y in arc[0])
    assert np.allclose(lines('<line x1="3" y1="8" x2="3" y2="20" transform="rotate(-90 3 8)"/>')[0], [[3, 8], [15, 8]])
    assert len(svg_to_polylines(wrap(CURVE), Limits(resolution=1024))[0]) > len(svg_to_polylines(wrap(CURVE), Limits(resolution=8))[0])
    for bad in ({"elements": 0}, {"resolution": 4}):
        with pytest.raises(SvgError):
            Limits(**bad)


def test_namespaces_and_declarations():
    assert svg_to_polylines('<v:svg xmlns:v="http://www.w3.org/2000/svg"><v:line x1="2" x2="7" y2="4"/></v:svg>') == [[(2, 0), (7, 4)]]
    head = '<?xml version="1.0"?><!DOCTYPE svg PUBLIC "-//W3C//DTD SVG 1.1//EN" "http://www.w3.org/Graphics/SVG/1.1/DTD/svg11.dtd">'
    assert svg_to_polylines(head + wrap('<line y1="6" x2="8"/>')) == [[(0, 6), (8, 0)]]


#: The strokes of a test drawing, (dx, dy, pen).
CAT = [
    (-12, 1, 0), (-6, 5, 0), (-29, 26, 0), (-21, 27, 0), (-6, 14, 0), (0, 25, 0), (4, 10, 0), (35, 31, 0), (28, 8, 0), (24, 0, 0),
    (19, -4, 0), (13, -7, 0), (15, -18, 0), (7, -13, 0), (4, -31, 0), (-2, -40, 0), (-49, -36, 0), (-26, -1, 1), (-32, 18, 0), (-3, -37, 0),
    (17, 3, 0), (13, 8, 0), (2, 5, 1), (20, 5, 0), (23, -27, 0), (11, -7, 0), (3, 10, 0), (-13, 41, 0), (0, 9, 1), (-59, 21, 0),
    (0, 5, 0), (3, -7, 0), (-3, 11, 0), (5, 0, 0), (-1, -9, 1), (38, -1, 0), (2, 11, 0), (6, 5, 0), (5, -6, 0), (3, -13, 0),
    (-7, -8, 0), (-1, 8, 0), (3, 5, 0), (3, -3, 1), (-26, 40, 0), (-2, 23, 0), (-23, 13, 0), (-8, 0, 0), (-6, -4, 0), (-4, -6, 0),
    (0, -9, 1), (40, -5, 0), (21, 19, 0), (17, 3, 0), (7, -1, 0), (3, -6, 0), (2, -22, 1), (-46, -1, 0), (111, -22, 1), (-102, 23, 0),
    (91, 0, 1), (-92, 6, 0), (108, 18, 1), (-112, -24, 0), (-93, 0, 1), (89, -2, 0), (-53, 7, 0), (-26, 8, 0), (-6, 7, 1),
]


def test_golden_bitmap(spark):
    rows = spark.createDataFrame([(1, i, *r) for i, r in enumerate(CAT)], "drawing_id int, seq int, dx int, dy int, pen int")
    points = strokes.decode_stroke3(rows)
    assert points.count() == 69 and points.select("polyline").distinct().count() == 12
    out = strokes.polylines(points).select(F.sha2(raster.rasterize_polylines("polylines"), 256).alias("d")).first()
    assert out.d == "dde7369a95c67297a7db18207a82221aeee4895499b9cb9f5751f78fd7072529"


def test_encodings_agree_and_scale_does_not_matter(spark):
    """The same two strokes, a hook and a dash, as steps and as columns."""
    steps = spark.createDataFrame([([(3, -2, 0), (6, 1, 0), (0, 7, 1), (-8, 4, 0), (5, 0, 1)], [([3, 9, 9], [-2, -1, 6]), ([1, 6], [10, 10])])], "s3 array<struct<dx:int,dy:int,pen:int>>, qd array<struct<x:array<int>,y:array<int>>>")
    out = steps.select(strokes.stroke3_polylines(F.col("s3")).alias("a"), strokes.quickdraw_polylines(F.col("qd")).alias("b"), strokes.stroke3_problem(F.col("s3")).alias("p")).first()
    plain = [[(3, -2), (9, -1), (9, 6)], [(1, 10), (6, 10)]]
    assert out.a == out.b and [[(p.x, p.y) for p in line] for line in out.a] == plain and out.p is None
    moved = [[(4 * x + 11, 4 * y - 6) for x, y in line] for line in plain]
    assert raster.rasterize(plain) == raster.rasterize(moved)
    # an upright stroke of width 3 on 32 pixels with a margin of 2: 3.5 pixels to its middle at both ends, centred in x
    ink = np.frombuffer(raster.rasterize([[(0, 0), (0, 6)]], 32, 2, 3, 2), np.uint8).reshape(32, 32)
    ys, xs = np.nonzero(ink)
    assert (xs.min(), ys.min(), xs.max(), ys.max()) == (14, 2, 17, 29)
    assert np.frombuffer(raster.rasterize([[(5, 5)]]), np.uint8).max() == 255


@pytest.mark.parametrize("drawing", [[], [[]], [[(math.nan, 0)]], [[(1e308, 0), (-1e308, 0)]]])
def test_bad_drawings(drawing):
    with pytest.raises(ValueError):
        raster.rasterize(drawing)
    with pytest.raises(ValueError):
        raster.rasterize([[(0, 0)]], size=8, padding=4)


@pytest.mark.parametrize("rows, problem", [([], "empty"), ([(1, 1, 0)], "no final lift"), ([(1, 1, 2)], "pen state"), ([(None, 1, 1)], "missing value"), ([(40000, 1, 1)], "not a 16-bit number"), ([(1, 1, 1)], None)])
def test_stroke_problems(spark, rows, problem):
    df = spark.createDataFrame([(rows,)], "s array<struct<dx:int,dy:int,pen:int>>")
    assert df.select(strokes.stroke3_problem(F.col("s")).alias("p")).first().p == problem


def test_raster_status(spark):
    house, ring = '<polygon points="12 3 40 30 22 61 5 33"/>', '<ellipse cx="9" cy="5" rx="8" ry="4" fill="none" stroke="teal"/>'
    rows = spark.createDataFrame([(0, wrap(house)), (1, wrap('<path d="M3 3 W5"/>')), (2, wrap('<g display="none"><line x2="9" y2="4"/></g>')), (3, wrap(ring)), (4, None)], "id int, svg string")
    out = {r.id: (r.r.status, r.r.bitmap) for r in rows.select("id", raster.rasterize_svg("svg").alias("r")).collect()}
    assert [out[i][0] for i in range(5)] == [0, 1, 2, 0, 1] and len(out[0][1]) == len(out[3][1]) == 4096 and out[1][1] is None
    assert raster.raster_icon(wrap(house), min_ink=0.9)[0] == raster.raster_icon(wrap(house), max_ink=0.001)[0] == raster.OUT_OF_BAND


def test_point_filters_and_svg_output(spark):
    row = spark.createDataFrame([([(0.0, 0.0), (0.1, 0.0), (0.5, 0.0), (0.5, 0.0), (2.0, 1.0)],)], "p array<struct<x:double,y:double>>")
    out = row.select(strokes.thin_points(F.col("p")).alias("t"), strokes.without_repeats(F.col("p")).alias("u"), strokes.stroke_element(F.slice("p", 3, 3), F.lit("#111"), F.lit(2.5)).alias("e"), strokes.stroke_element(F.slice("p", 1, 1), F.lit('"'), F.lit(3.0)).alias("d")).first()
    assert [tuple(p) for p in out.t] == [(0, 0), (0.5, 0), (2, 1)] and len(out.u) == 4
    assert out.e == '<path d="M 0.5 0 Q 0.5 0 0.5 0 Q 0.5 0 1.25 0.5 L 2 1" fill="none" stroke="#111" stroke-width="2.5" stroke-linecap="round" stroke-linejoin="round"/>'
    assert out.d == '<circle cx="0" cy="0" r="1.5" fill="&quot;"/>'
    d2 = spark.range(1).select(strokes.segment_distance2(*map(F.lit, (5.0, 3.0, 0.0, 0.0, 10.0, 0.0))).alias("d")).first().d
    assert d2 == 9.0


def test_a_scaled_stage(spark):
    row = spark.createDataFrame([([(2.0, 3.0), (4.0, 0.0)], 3.0)], "p array<struct<x:double,y:double>>, w double")
    across, down = strokes.stage_scale(F.lit(10), F.lit(40)), strokes.stage_scale(F.lit(8.0), F.lit(8.0))
    out = row.select(strokes.scaled_stroke(F.col("p"), F.col("w"), across, down).alias("s"), strokes.scaled_box(*map(F.lit, (1.0, 2.0, 5.0, 6.0)), across, down).alias("b")).first()
    assert [tuple(p) for p in out.s.points] == [(8, 3), (16, 0)] and out.s.width == 6 and tuple(out.b) == (4, 2, 20, 6)
    for bad in (0, -1, float("nan"), float("inf"), None):
        with pytest.raises(Exception, match="positive and finite"):
            row.select(strokes.stage_scale(F.lit(10), F.lit(bad))).collect()
