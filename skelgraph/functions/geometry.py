"""Geometry as array expressions: struct<kind, parts: array<array<struct<x, y>>>>."""
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

GEOM = "struct<kind: string, parts: array<array<struct<x: double, y: double>>>>"


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def geometry(kind: str, *parts) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.array(*[F.array(*p) for p in parts]).alias("parts"))


def _sum(values):
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def segments(ring: Column) -> Column:
    """Successive coordinate pairs (a, b) of a line or closed ring."""
    n = F.size(ring)
    return F.zip_with(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), F.slice(ring, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _length_of(s):
    return F.hypot(s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"])


def length(ring: Column) -> Column:
    return _sum(F.transform(segments(ring), _length_of))


def chord(ring: Column) -> Column:
    a, b = F.element_at(ring, 1), F.element_at(ring, -1)
    return F.hypot(b["x"] - a["x"], b["y"] - a["y"])


def ring_area(ring: Column) -> Column:
    return F.abs(_sum(F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]))) / 2


def polygon_area(geom: Column) -> Column:
    parts = geom["parts"]
    return 2 * ring_area(parts[0]) - _sum(F.transform(parts, ring_area))


def perimeter(geom: Column) -> Column:
    return _sum(F.transform(geom["parts"], length))


def line_straightness(geom: Column) -> Column:
    """Chord over length; a line without length is straight."""
    ring = geom["parts"][0]
    return F.when(length(ring) <= 0, 1.0).otherwise(chord(ring) / F.greatest(length(ring), F.lit(1e-9)))


def line_curvature(geom: Column) -> Column:
    ring = geom["parts"][0]
    return 1 - chord(ring) / F.greatest(length(ring), F.lit(1e-9))


def polygon_circularity(geom: Column) -> Column:
    p = F.greatest(perimeter(geom), F.lit(1e-9))
    return 4 * math.pi * F.greatest(polygon_area(geom), F.lit(1e-9)) / (p * p)


def along(ring: Column, share: float) -> Column:
    """The point at a share of the length of a line."""
    goal = length(ring) * share
    start = F.struct(F.lit(0.0).alias("done"), ring[0]["x"].alias("x"), ring[0]["y"].alias("y"))

    def step(acc, s):
        size = _length_of(s)
        t = F.when(size > 0, F.greatest(F.least((goal - acc["done"]) / size, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
        on = (goal >= acc["done"]) & (size > 0)
        return F.struct((acc["done"] + size).alias("done"),
                        F.when(on, s["a"]["x"] + t * (s["b"]["x"] - s["a"]["x"])).otherwise(acc["x"]).alias("x"),
                        F.when(on, s["a"]["y"] + t * (s["b"]["y"] - s["a"]["y"])).otherwise(acc["y"]).alias("y"))

    return F.aggregate(segments(ring), start, step, lambda acc: F.struct(acc["x"].alias("x"), acc["y"].alias("y")))


def line_direction(geom: Column) -> Column:
    """Angle from the point at 25% to the one at 75% of the length; null unless a line. A line of two points is not walked along."""
    ring = geom["parts"][0]
    a, b = F.get(ring, F.lit(0)), F.get(ring, F.lit(1))
    turn = let(along(ring, 0.25), lambda a: let(along(ring, 0.75), lambda b: F.atan2(b["y"] - a["y"], b["x"] - a["x"])))
    plain = F.atan2(b["y"] - a["y"], b["x"] - a["x"])
    return F.when(geom["kind"] == "LineString", F.when(F.size(ring) == 2, plain).otherwise(turn))


def segment_distance(px: Column, py: Column, s: Column) -> Column:
    dx, dy = s["b"]["x"] - s["a"]["x"], s["b"]["y"] - s["a"]["y"]
    sq = dx * dx + dy * dy
    t = F.when(sq > 0, F.greatest(F.least(((px - s["a"]["x"]) * dx + (py - s["a"]["y"]) * dy) / sq, F.lit(1.0)), F.lit(0.0))).otherwise(0.0)
    return F.hypot(px - s["a"]["x"] - t * dx, py - s["a"]["y"] - t * dy)


def boundary_distance(px: Column, py: Column, geom: Column) -> Column:
    return F.array_min(F.flatten(F.transform(geom["parts"], lambda r: F.transform(segments(r), lambda s: segment_distance(px, py, s)))))


point_line_distance = boundary_distance


def inside(px: Column, py: Column, geom: Column) -> Column:
    """Even-odd rule over all rings."""
    return inside_of(px, py, F.flatten(F.transform(geom["parts"], segments)))


def inside_of(px: Column, py: Column, every: Column) -> Column:
    """`inside` of the segments of all rings."""
    def crosses(s):
        up = (s["a"]["y"] > py) != (s["b"]["y"] > py)
        return F.when(up, (px < s["a"]["x"] + (py - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"])).cast("int")).otherwise(0)

    return F.aggregate(every, F.lit(0), lambda n, s: n + crosses(s)) % 2 == 1


def point_polygon_distance(px: Column, py: Column, geom: Column) -> Column:
    return F.when(inside(px, py, geom), 0.0).otherwise(boundary_distance(px, py, geom))


def endpoint_distance(px: Column, py: Column, geom: Column, which: str) -> Column:
    p = F.element_at(geom["parts"][0], 1 if which == "start" else -1)
    return F.hypot(px - p["x"], py - p["y"])


def centroid(geom: Column) -> Column:
    """Of many parts: points by number, lines by length, polygons by area (holes turn the other way); corners by number if all are without size."""
    points = F.flatten(geom["parts"])
    every = F.flatten(F.transform(geom["parts"], segments))
    area = geom["kind"].contains("Polygon")

    def weight(s):
        return F.when(area, (s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"]) / 2).otherwise(_length_of(s))

    def mean(c, total):
        share = F.when(area, F.lit(3.0)).otherwise(2.0)
        got = _sum(F.transform(every, lambda s: weight(s) * (s["a"][c] + s["b"][c]) / share)) / total
        plain = _sum(F.transform(points, lambda p: p[c])) / F.size(points)
        return F.when(geom["kind"].contains("Point") | (F.abs(total) <= 1e-12), plain).otherwise(got)

    total = _sum(F.transform(every, weight))
    return F.when(F.size(points) > 0, let(total, lambda t: F.struct(mean("x", t).alias("x"), mean("y", t).alias("y"))))


def let(value: Column, f) -> Column:
    """f(value), with the value computed once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _scan_height(ring):
    """Half way between the vertex heights nearest the middle of the box."""
    def between(ys, mid):
        low = F.array_max(F.filter(ys, lambda y: y <= mid))
        return let(low, lambda low: (low + F.coalesce(F.array_min(F.filter(ys, lambda y: y > mid)), low)) / 2)

    return let(F.transform(ring, lambda p: p["y"]), lambda ys: let((F.array_min(ys) + F.array_max(ys)) / 2, lambda mid: between(ys, mid)))


def _inner_point(geom):
    """Middle of the widest inner span of the scanline; null if it cuts nothing."""
    every = F.flatten(F.transform(geom["parts"], segments))

    def cuts(scan):
        return F.array_sort(F.transform(F.filter(every, lambda s: (s["a"]["y"] > scan) != (s["b"]["y"] > scan)),
                                        lambda s: s["a"]["x"] + (scan - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) * (s["b"]["x"] - s["a"]["x"])))

    def widest(cut):
        starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(cut) - 2, F.lit(0))), lambda i: i % 2 == 0)
        return F.array_max(F.transform(starts, lambda i: F.struct((F.get(cut, i + 1) - F.get(cut, i)).alias("w"), ((F.get(cut, i + 1) + F.get(cut, i)) / 2).alias("x"))))

    return let(_scan_height(geom["parts"][0]), lambda scan: let(let(cuts(scan), widest), lambda w: F.when(w["x"].isNotNull(), F.struct(w["x"].alias("x"), scan.alias("y")))))


def representative_point(geom: Column) -> Column:
    """Point: itself; line: at half length; polygon: middle of the widest inner span
    of the scanline half way between the vertex heights nearest the box's centre; else
    the centroid, null for empty geometry."""
    ring = geom["parts"][0]
    a, b = F.get(ring, F.lit(0)), F.get(ring, F.lit(1))
    middle = F.struct((a["x"] + 0.5 * (b["x"] - a["x"])).alias("x"), (a["y"] + 0.5 * (b["y"] - a["y"])).alias("y"))
    return (F.when(geom["kind"] == "Point", F.struct(a["x"].alias("x"), a["y"].alias("y")))
            .when((geom["kind"] == "LineString") & (F.size(ring) == 2), middle)
            .when(geom["kind"] == "LineString", along(ring, 0.5))
            .otherwise(F.coalesce(F.when(geom["kind"] == "Polygon", _inner_point(geom)), centroid(geom))))


def rescale(geom: Column, cx: Column, cy: Column, scale: Column) -> Column:
    return F.struct(geom["kind"].alias("kind"), F.transform(geom["parts"], lambda r: F.transform(
        r, lambda p: F.struct(((p["x"] - cx) / scale).alias("x"), ((p["y"] - cy) / scale).alias("y")))).alias("parts"))
