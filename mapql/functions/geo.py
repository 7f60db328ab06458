"""Geometry as column expressions: keys of places, distances, and tests of points, lines and rings."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6378137.0
E7 = 1e7
ORDER = 20


def _grid(e7: Column, low: int, size: int) -> Column:
    """Cell of a coordinate on a grid of 2**20."""
    n = 1 << ORDER
    return F.least(F.greatest(F.floor((e7.cast("double") / E7 - low) * n / size), F.lit(0)), F.lit(n - 1)).cast("long")


def quadkey(lat_e7: Column, lon_e7: Column) -> Column:
    """40-bit code of a place in a quadtree whose digits are 0 NW, 1 NE, 2 SW, 3 SE."""
    n = (1 << ORDER) - 1
    x, y = _grid(lon_e7, -180, 360), F.lit(n) - _grid(lat_e7, -90, 180)
    bits = [F.shiftleft(F.shiftright(x, i).bitwiseAND(F.lit(1).cast("long")) + 2 * F.shiftright(y, i).bitwiseAND(F.lit(1).cast("long")), 2 * i) for i in range(ORDER)]
    return reduce(lambda a, b: a + b, bits)


def cell_at(code: Column, depth: int) -> Column:
    """The first ``depth`` digits of a quadtree code."""
    return F.lpad(F.conv(F.shiftright(code, 2 * (ORDER - depth)).cast("string"), 10, 4), depth, "0") if depth else F.lit("root")


def hilbert(lat_e7: Column, lon_e7: Column) -> Column:
    """Place on a Hilbert curve of order 20, as a fold over its 20 levels."""
    x, y = _grid(lon_e7, -180, 360), _grid(lat_e7, -90, 180)
    one = F.lit(1).cast("long")

    def step(acc: Column, level: Column) -> Column:
        s = F.call_function("shiftleft", one, level)
        rx, ry = (F.when(acc[c].bitwiseAND(s) > 0, 1).otherwise(0) for c in ("x", "y"))
        d = acc["d"] + s * s * ((3 * rx).bitwiseXOR(ry))
        flip = (ry == 0) & (rx == 1)
        n = F.lit(1 << ORDER).cast("long")
        x1 = F.when(flip, n - 1 - acc["x"]).otherwise(acc["x"])
        y1 = F.when(flip, n - 1 - acc["y"]).otherwise(acc["y"])
        return F.struct(F.when(ry == 0, y1).otherwise(x1).cast("long").alias("x"), F.when(ry == 0, x1).otherwise(y1).cast("long").alias("y"), d.cast("long").alias("d"))

    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d"))
    levels = F.array(*[F.lit(i) for i in range(ORDER - 1, -1, -1)])
    return F.aggregate(levels, start, step, lambda acc: acc["d"])


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    s, w, n, e = (round(v * E7) for v in box)
    return lat.between(s, n) & lon.between(w, e)


def boxes_meet(box: tuple[float, float, float, float]) -> Column:
    s, w, n, e = (round(v * E7) for v in box)
    return (F.col("xmin_e7") <= e) & (F.col("xmax_e7") >= w) & (F.col("ymin_e7") <= n) & (F.col("ymax_e7") >= s)


def segments(line: Column) -> Column:
    """Pairs of neighbours of a line."""
    return F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda i: F.struct(F.element_at(line, i.cast("int")).alias("a"), F.element_at(line, (i + 1).cast("int")).alias("b")))


def line_meets_box(line: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a line touches a box: a segment does if its bounds do and the box's corners aren't all on one side."""
    s, w, n, e = (round(v * E7) for v in box)

    def touches(seg: Column) -> Column:
        ax, ay, bx, by = (seg[p][c].cast("double") for p, c in (("a", "lon_e7"), ("a", "lat_e7"), ("b", "lon_e7"), ("b", "lat_e7")))
        near = (F.least(ax, bx) <= e) & (F.greatest(ax, bx) >= w) & (F.least(ay, by) <= n) & (F.greatest(ay, by) >= s)
        side = [(bx - ax) * (F.lit(float(y)) - ay) - (by - ay) * (F.lit(float(x)) - ax) for x in (w, e) for y in (s, n)]
        return near & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)

    return F.coalesce(F.when(F.size(line) >= 2, F.exists(segments(line), touches)), F.lit(False))


def crosses(lat: Column, lon: Column, ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Whether a ray to the east of a point crosses a segment; an odd number of crossings is inside."""
    y, x = lat.cast("double"), lon.cast("double")
    ay, ax, by, bx = (v.cast("double") for v in (ay, ax, by, bx))
    return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)


def in_ring(lat: Column, lon: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point is inside a fixed ring of (lat, lon), closed if it isn't."""
    pts = [(float(round(a * E7)), float(round(b * E7))) for a, b in ring]
    pts = pts if pts[0] == pts[-1] else [*pts, pts[0]]
    hits = [F.when(crosses(lat, lon, *(F.lit(v) for v in (*p, *q))), 1).otherwise(0) for p, q in zip(pts, pts[1:], strict=False) if p[0] != q[0]]
    return (reduce(lambda a, b: a + b, hits, F.lit(0)) % 2) == 1


def plane(lat_e7: Column, lon_e7: Column, mid: Column | float) -> tuple[Column, Column]:
    """Metres in a plane that is true to scale at the latitude ``mid`` (degrees)."""
    mid = F.lit(mid) if isinstance(mid, float) else mid
    scale = F.cos(F.radians(F.least(F.greatest(mid, F.lit(-89.0)), F.lit(89.0))))
    return F.radians(lon_e7 / E7) * RADIUS * scale, F.radians(lat_e7 / E7) * RADIUS


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between places given in units of 1e-7 degrees."""
    a1, o1, a2, o2 = (F.radians(v / E7) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * RADIUS * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def length(line: Column) -> Column:
    total = F.aggregate(segments(line), F.lit(0.0), lambda acc, s: acc + haversine(s["a"]["lat_e7"], s["a"]["lon_e7"], s["b"]["lat_e7"], s["b"]["lon_e7"]))
    return F.coalesce(F.when(F.size(line) >= 2, total), F.lit(0.0))


def clipped(line: Column, box: tuple[float, float, float, float]) -> Column:
    """Vertices that are in a box or next to one that is; others null."""
    inside = F.transform(line, lambda p: in_box(p["lat_e7"], p["lon_e7"], box))
    near = lambda i: F.coalesce(F.try_element_at(inside, i), F.lit(False))
    return F.transform(line, lambda p, i: F.when(F.element_at(inside, i + 1) | near(i + 2) | F.when(i > 0, near(F.greatest(i, F.lit(1)))).otherwise(F.lit(False)), p))


def expand(box: tuple[float, float, float, float], metres: float) -> tuple[float, float, float, float]:
    s, w, n, e = box
    lat = metres / 111320
    lon = metres / (111320 * max(0.01, math.cos(math.radians(min(89.0, max(abs(s), abs(n)))))))
    return (s - lat, w - lon, n + lat, e + lon)
