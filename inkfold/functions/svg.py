"""SVG documents to polylines: one scan over the markup, matrices as 2x3 arrays, curves halved until they are flat."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np

#: The limits for one document.
MAX_CHARACTERS = 512 * 1024
MAX_ELEMENTS = MAX_SEGMENTS = MAX_VERTICES = 20_000
FLATTEN_RESOLUTION = 256
#: How often a cubic is halved at most, and the least tolerance.
DEPTH, EPSILON = 16, 2.0**-52

#: Elements that draw, and elements whose content is never drawn.
SHAPES = {"circle", "ellipse", "line", "path", "polygon", "polyline", "rect"}
UNDRAWN = {"clippath", "defs", "desc", "filter", "foreignobject", "image", "lineargradient", "marker", "mask", "metadata", "pattern", "radialgradient", "script", "style", "symbol", "text", "title", "use"}

_MARKUP = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<\?(?:.*?\?>|.*)"
    r"|(?P<doctype><!doctype(?:\"[^\"]*\"|'[^']*'|[^>\"'\[])*(?P<stop>.?))|(?P<entity><!entity)"
    r"|<(?P<close>/?)\s*(?P<name>[^\s/>]+)(?P<attributes>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_REFERENCE = re.compile(r"&(?:#x([0-9a-f]{1,6})|#([0-9]{1,7})|(amp|apos|gt|lt|quot));", re.I)
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?", re.I)
_CALL = re.compile(r"([a-z]+)\s*\(([^)]*)\)", re.I)
#: How many numbers a path command takes.
ARITY = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


class SvgError(ValueError):
    """The document can't be read."""


@dataclass
class Limits:
    characters: int = MAX_CHARACTERS
    elements: int = MAX_ELEMENTS
    segments: int = MAX_SEGMENTS
    vertices: int = MAX_VERTICES
    resolution: int = FLATTEN_RESOLUTION

    def __post_init__(self):
        if any(not isinstance(x, int) or x < 1 for x in (self.characters, self.elements, self.segments, self.vertices)):
            raise SvgError("limits must be positive integers")
        if not isinstance(self.resolution, int) or self.resolution < 8:
            raise SvgError("the flatten resolution must be an integer of at least 8")


@dataclass
class Contour:
    """Bezier segments as complex control points: one (line) or three (cubic) after the point before."""

    start: complex
    segments: list[tuple[complex, ...]] = field(default_factory=list)
    closed: bool = False


@dataclass
class _State:
    matrix: tuple = (1 + 0j, 1j, 0j)  # images of the unit vectors, and the offset
    fill: str | None = None
    stroke: str | None = None
    visible: bool = True


class Pen:
    """Collects contours and counts segments."""

    def __init__(self, budget: list[int]):
        self.contours: list[Contour] = []
        self.at: complex | None = None
        self.budget = budget
        self.open = False

    def move(self, to: complex) -> None:
        self.at, self.open = to, False
        self.contours.append(Contour(to))

    def draw(self, *points: complex) -> None:
        if self.at is None:
            raise SvgError("geometry started without a move command")
        self.budget[0] -= 1
        if self.budget[0] < 0:
            raise SvgError("geometry exceeds the segment budget")
        if self.contours[-1].closed:  # after a close the next segment starts where that contour did
            self.contours.append(Contour(self.at))
        self.contours[-1].segments.append(points)
        self.at = points[-1]

    def close(self) -> None:
        if self.at is not None and self.contours[-1].segments:
            self.contours[-1].closed = True
            self.at = self.contours[-1].start

    def arc(self, rx: float, ry: float, turn: float, large: bool, sweep: bool, to: complex) -> None:
        """An elliptical arc as cubics of at most a quarter each."""
        start = self.at
        if start == to:
            return
        if not rx or not ry:
            return self.draw(to)
        rx, ry = abs(rx), abs(ry)
        spin = complex(math.cos(math.radians(turn)), math.sin(math.radians(turn)))
        circle = lambda z: complex((z * spin.conjugate()).real / rx, (z * spin.conjugate()).imag / ry)
        ellipse = lambda w: complex(w.real * rx, w.imag * ry) * spin
        a, b = circle(start), circle(to)
        half = abs(b - a) / 2
        if half > 1:  # the radii are too small: the smallest ellipse that reaches
            rx, ry = rx * half, ry * half
            a, b, half = circle(start), circle(to), 1.0
        center = (a + b) / 2
        if half < 1:
            normal = (b - a) * 1j / abs(b - a) * math.sqrt(1 - half * half)
            center += normal if large != sweep else -normal
        first = math.atan2((a - center).imag, (a - center).real)
        angle = (math.atan2((b - center).imag, (b - center).real) - first) % (2 * math.pi)
        if not sweep and angle:
            angle -= 2 * math.pi
        n = max(1, math.ceil(abs(angle) / (math.pi / 2) - 1e-9))
        reach = 4 / 3 * math.tan(angle / n / 4)
        for k in range(n):
            u, v = (complex(math.cos(t), math.sin(t)) for t in (first + angle * k / n, first + angle * (k + 1) / n))
            end = to if k == n - 1 else ellipse(center + v)
            self.draw(ellipse(center + u + 1j * u * reach), ellipse(center + v - 1j * v * reach), end)


def _decoded(value: str) -> str:
    def one(m: re.Match) -> str:
        if m[3]:
            return {"amp": "&", "apos": "'", "gt": ">", "lt": "<", "quot": '"'}[m[3].lower()]
        code = int(m[1], 16) if m[1] else int(m[2])
        return chr(code) if 0 < code <= 0x10FFFF else m[0]

    return _REFERENCE.sub(one, value)


def _attributes(body: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single in _ATTRIBUTE.findall(body):
        out.setdefault(name.lower(), _decoded(double or single))
    for part in out.get("style", "").split(";"):
        name, colon, value = part.partition(":")
        if colon:
            out[name.strip().lower()] = re.sub(r"\s*!important$", "", value.strip())
    return out


def _length(text: str | None, default: float = 0.0) -> float | None:
    """A length in user units; None for percentages and other units that need a viewport."""
    if text is None or not text.strip():
        return default
    m = re.fullmatch(rf"\s*({_NUMBER.pattern})\s*(px)?\s*", text, re.I)
    return float(m[1]) if m else None


def _applied(matrix: tuple, z: complex) -> complex:
    return matrix[0] * z.real + matrix[1] * z.imag + matrix[2]


def _transformed(matrix: tuple, text: str) -> tuple:
    for name, inside in _CALL.findall(text):
        try:
            n = [float(x) for x in re.split(r"[\s,]+", inside.strip()) if x]
        except ValueError:
            raise SvgError("a transform contains a non-finite number") from None
        if not all(map(math.isfinite, n)):
            raise SvgError("a transform contains a non-finite number")
        name, count = name.lower(), len(n)
        step = None
        if name == "matrix" and count == 6:
            step = (complex(n[0], n[1]), complex(n[2], n[3]), complex(n[4], n[5]))
        elif name == "translate" and count:
            step = (1 + 0j, 1j, complex(n[0], n[1] if count > 1 else 0))
        elif name == "scale" and count:
            step = (complex(n[0]), 1j * (n[1] if count > 1 else n[0]), 0j)
        elif name == "skewx" and count == 1:
            step = (1 + 0j, complex(math.tan(math.radians(n[0])), 1), 0j)
        elif name == "skewy" and count == 1:
            step = (complex(1, math.tan(math.radians(n[0]))), 1j, 0j)
        elif name == "rotate" and count in (1, 3):
            r = complex(math.cos(math.radians(n[0])), math.sin(math.radians(n[0])))
            about = complex(n[1], n[2]) if count == 3 else 0j
            step = (r, r * 1j, about - r * about)
        if step:
            x, y, offset = step
            linear = (matrix[0], matrix[1], 0j)
            matrix = (_applied(linear, x), _applied(linear, y), _applied(matrix, offset))
    return matrix


def _path(pen: Pen, text: str) -> None:
    at, command, size = 0, None, len(text)
    control: complex | None = None  # the last control point, for smooth commands
    last = ""

    def skip() -> None:
        nonlocal at
        while at < size and (text[at].isspace() or text[at] == ","):
            at += 1

    def number() -> float:
        nonlocal at
        skip()
        m = _NUMBER.match(text, at)
        if not m:
            raise SvgError("path data contains an invalid number")
        at = m.end()
        value = float(m[0])
        if not math.isfinite(value):
            raise SvgError("path data contains an invalid number")
        return value

    def flag() -> bool:
        nonlocal at
        skip()
        if text[at : at + 1] not in ("0", "1"):
            raise SvgError("an arc flag must be 0 or 1")
        at += 1
        return text[at - 1] == "1"

    while True:
        skip()
        if at >= size:
            return
        fresh = text[at].isalpha()
        if fresh:
            command = text[at]
            at += 1
            if command.upper() not in ARITY:
                raise SvgError(f"unsupported path command: {command}")
        elif command is None:
            raise SvgError("path data must start with a command")
        elif command in "zZ":
            raise SvgError("path data contains an invalid number")
        kind = command.upper()
        if kind == "Z":
            pen.close()
            control, last = None, kind
            continue
        here = pen.at if pen.at is not None else 0j
        base = here if command.islower() else 0j
        point = lambda: complex(number(), number()) + base
        if kind == "M":
            pen.move(point())
            command = "l" if command == "m" else "L"  # further pairs are lines
        elif kind == "A":
            rx, ry, turn, large, sweep = number(), number(), number(), flag(), flag()
            to = point()
            if pen.at is None:
                raise SvgError("geometry started without a move command")
            pen.arc(rx, ry, turn, large, sweep, to)
        elif kind in "LHV":
            if kind == "L":
                to = point()
            elif kind == "H":
                to = complex(number() + base.real, here.imag)
            else:
                to = complex(here.real, number() + base.imag)
            pen.draw(to)
        elif kind in "CS":
            first = point() if kind == "C" else (2 * here - control if last in ("C", "S") else here)
            second, to = point(), point()
            pen.draw(first, second, to)
            control = second
        else:
            mid = point() if kind == "Q" else (2 * here - control if last in ("Q", "T") else here)
            to = point()
            pen.draw(here + (mid - here) * 2 / 3, to + (mid - to) * 2 / 3, to)
            control = mid
        last = kind


def _shape(pen: Pen, name: str, a: dict[str, str]) -> None:
    if name == "path":
        return _path(pen, a.get("d", ""))
    if name in ("polyline", "polygon"):
        n = [float(x) for x in _NUMBER.findall(a.get("points", ""))]
        points = [complex(x, y) for x, y in zip(n[0::2], n[1::2])]
        if len(points) > 1:
            pen.move(points[0])
            for p in points[1:]:
                pen.draw(p)
            if name == "polygon":
                pen.close()
        return
    read = lambda *names: [_length(a.get(k)) for k in names]
    if name == "line":
        n = read("x1", "y1", "x2", "y2")
        if None not in n:
            pen.move(complex(n[0], n[1]))
            pen.draw(complex(n[2], n[3]))
        return
    if name == "rect":
        x, y, w, h = read("x", "y", "width", "height")
        if None in (x, y, w, h) or w <= 0 or h <= 0:
            return
        rx, ry = (_length(a.get(k), -1) for k in ("rx", "ry"))
        rx, ry = (None if r is None or r < 0 else r for r in (rx, ry))
        rx, ry = (ry if rx is None else rx) or 0.0, (rx if ry is None else ry) or 0.0
        rx, ry = min(rx, w / 2), min(ry, h / 2)
        corners = [complex(x, y), complex(x + w, y), complex(x + w, y + h), complex(x, y + h)]
        if not rx or not ry:
            pen.move(corners[0])
            for c in corners[1:]:
                pen.draw(c)
        else:
            pen.move(complex(x + rx, y))
            sides = [1 + 0j, 1j, -1 + 0j, -1j]
            for k, c in enumerate(corners[1:] + corners[:1]):
                inward, onward = sides[k], sides[(k + 1) % 4]
                pen.draw(c - complex(inward.real * rx, inward.imag * ry))
                pen.arc(rx, ry, 0, False, True, c + complex(onward.real * rx, onward.imag * ry))
        return pen.close()
    cx, cy = read("cx", "cy")
    rx, ry = read("r", "r") if name == "circle" else read("rx", "ry")
    if None in (cx, cy, rx, ry) or rx <= 0 or ry <= 0:
        return
    pen.move(complex(cx + rx, cy))
    pen.arc(rx, ry, 0, False, True, complex(cx - rx, cy))
    pen.arc(rx, ry, 0, False, True, complex(cx + rx, cy))
    pen.close()


def _none(value: str | None) -> bool:
    return value is not None and value.strip().lower() in ("none", "transparent")


def contours(text: str, limits: Limits) -> list[Contour]:
    """The drawn outlines of a document in its own coordinates."""
    stack, out = [_State()], []
    budget, elements, hidden, end = [limits.segments], 0, 0, 0
    for m in _MARKUP.finditer(text):
        if m.start() < end:
            continue
        end = m.end()
        if m["entity"]:
            raise SvgError("entity declarations are not supported")
        if m["doctype"]:
            if m["stop"] == "[":
                raise SvgError("document type internal subsets are not supported")
            if m["stop"] != ">":
                raise SvgError("the document type declaration is unterminated")
            continue
        if m["name"] is None:
            continue
        if m["close"]:
            hidden = max(0, hidden - 1)
            if len(stack) > 1:
                stack.pop()
            continue
        elements += 1
        if elements > limits.elements:
            raise SvgError("the document exceeds the element budget")
        body = m["attributes"]
        single = body.rstrip().endswith("/") or m["name"].endswith("/")
        name = m["name"].lower().rpartition(":")[2]
        parent = stack[-1]
        if hidden:
            if not single:
                hidden += 1
                stack.append(parent)
            continue
        a = _attributes(body)
        fill, stroke = a.get("fill", parent.fill), a.get("stroke", parent.stroke)
        opacity = _length(a.get("opacity"), 1.0)
        gone = name in UNDRAWN or a.get("display", "").strip() == "none" or a.get("visibility", "").strip() in ("hidden", "collapse") or opacity == 0
        if name in SHAPES and _none(fill) and (stroke is None or _none(stroke)):
            gone = True
        if gone:
            if not single:
                hidden = 1
                stack.append(parent)
            continue
        matrix = _transformed(parent.matrix, a.get("transform", ""))
        if name in SHAPES:
            pen = Pen(budget)
            _shape(pen, name, a)
            for c in pen.contours:
                out.append(Contour(_applied(matrix, c.start), [tuple(_applied(matrix, p) for p in s) for s in c.segments], c.closed))
        if not single:
            stack.append(_State(matrix, fill, stroke))
    return out


def cut_cubics(p: np.ndarray, tolerance: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, set[int]]:
    """Chords of cubics (n, 4, 2) that stay within their tolerances: the cubic and the end of each chord, in order.

    All cubics are halved together, level by level, until both inner points are close to the chord or DEPTH is reached.
    An owner whose cubics need more than ``most`` chords is given up and returned.
    """
    index, place = np.arange(len(p)), np.zeros(len(p), np.int64)
    done, lost = [], set()
    for depth in range(DEPTH + 1):
        chord = p[:, 3] - p[:, 0]
        from_end = p[:, 1:3] - p[:, 3:]
        away = np.abs(from_end[:, :, 0] * chord[:, None, 1] - from_end[:, :, 1] * chord[:, None, 0]).sum(axis=1)
        flat = away**2 <= tolerance[index] ** 2 * (chord**2).sum(axis=1)
        if depth == DEPTH:
            flat[:] = True
        done.append((index[flat], place[flat] << (DEPTH - depth), p[flat, 3]))
        if flat.all():
            break
        p, index, place = p[~flat], index[~flat], place[~flat]
        # each open cubic gives two chords at least
        chords = np.bincount(owner[np.concatenate([index, index, *(d[0] for d in done)])])
        over = np.flatnonzero(chords > most)
        if len(over):
            lost.update(over.tolist())
            stays = ~np.isin(owner[index], over)
            p, index, place = p[stays], index[stays], place[stays]
        outer = (p[:, :-1] + p[:, 1:]) / 2
        inner = (outer[:, :-1] + outer[:, 1:]) / 2
        middle = (inner[:, :1] + inner[:, 1:]) / 2
        first = np.concatenate((p[:, :1], outer[:, :1], inner[:, :1], middle), axis=1)
        second = np.concatenate((middle, inner[:, 1:], outer[:, 2:], p[:, 3:]), axis=1)
        p, index, place = np.concatenate((first, second)), np.concatenate((index, index)), np.concatenate((2 * place, 2 * place + 1))
    index, place, ends = (np.concatenate([d[i] for d in done]) for i in range(3))
    order = np.lexsort((place, index))
    return index[order], ends[order], lost


def _tolerance(drawn: list[Contour], resolution: int) -> float:
    """The diagonal of all points, control points too, over the resolution; negative where there is no point."""
    p = np.array([p for c in drawn for p in (c.start, *(p for s in c.segments for p in s))], complex)
    p = p[np.isfinite(p.real) & np.isfinite(p.imag)]
    return max(math.hypot(np.ptp(p.real), np.ptp(p.imag)) / resolution, EPSILON) if len(p) else -1.0


def flattened(documents: list[list[Contour]], limits: Limits) -> list[list[np.ndarray] | SvgError]:
    """The polylines, arrays (n, 2), of each document's outlines; an error for one that needs too many vertices."""
    cubics, width, owner, contours_of = [], [], [], []
    for number, drawn in enumerate(documents):
        tolerance = _tolerance(drawn, limits.resolution)
        for c in drawn if tolerance > 0 else ():
            at = c.start
            for s in c.segments:
                if len(s) == 3:
                    cubics.append((at, *s))
                    width.append(tolerance)
                    owner.append(len(contours_of))
                at = s[-1]
            contours_of.append((number, c))
    p = np.array(cubics, complex).reshape(-1, 4)
    with np.errstate(all="ignore"):
        index, ends, lost = cut_cubics(np.stack((p.real, p.imag), axis=2), np.array(width), np.array(owner, np.int64), limits.vertices)
    edge = np.searchsorted(index, np.arange(len(p) + 1))
    out: list[list[np.ndarray] | SvgError] = [[] for _ in documents]
    cubic = 0
    for k, (number, c) in enumerate(contours_of):
        parts = [np.array([[c.start.real, c.start.imag]])]
        for s in c.segments:
            if len(s) == 3:
                parts.append(ends[edge[cubic] : edge[cubic + 1]])
                cubic += 1
            else:
                parts.append(np.array([[s[0].real, s[0].imag]]))
        line = np.concatenate(parts)
        if k in lost or len(line) > limits.vertices:
            out[number] = SvgError("geometry exceeds the vertex budget")
        if isinstance(out[number], SvgError):
            continue
        if c.closed:
            line = np.concatenate((line, parts[0]))
        line = line[np.concatenate(([True], (line[1:] != line[:-1]).any(axis=1)))]
        if len(line) > 1 and np.isfinite(line).all():
            out[number].append(line)
    return out


def outlines(texts: list, limits: Limits | None = None) -> list[list[np.ndarray] | SvgError]:
    """The polylines of each document of a batch, or its error: a document that can't be read never touches its neighbours."""
    limits = limits or Limits()
    read: list[list[Contour]] = []
    errors: dict[int, SvgError] = {}
    for i, text in enumerate(texts):
        read.append([])
        try:
            if not isinstance(text, str):
                raise SvgError("the source must be a string")
            if len(text) > limits.characters:
                raise SvgError("the source exceeds the maximum supported size")
            read[i] = contours(text, limits)
        except SvgError as error:
            errors[i] = error
    return [errors.get(i, lines) for i, lines in enumerate(flattened(read, limits))]


def svg_to_polylines(text: str, limits: Limits | None = None) -> list[list[tuple[float, float]]]:
    """The polylines of a document; SvgError where it is malformed, refused or too large."""
    (lines,) = outlines([text], limits)
    if isinstance(lines, SvgError):
        raise lines
    return [[tuple(p) for p in line.tolist()] for line in lines]
