"""Polygons as tables of rings: projection, orientation, overlap with grids, dissolving and simplifying.

A ring is a row: polygon (an id, of any number of rings), and vertices, an array of struct(x, y) in order; the
last vertex may repeat the first. Clipping, areas, centroids and projections are column expressions over
that array; only the walk along borders and the choice of vertices to keep are Python, a feature at a time.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VERTICES = "array<struct<x: double, y: double>>"


# ---------------------------------------------------------------- projection


@dataclass(frozen=True)
class Lambert:
    """A Lambert conformal conic with two standard parallels; angles in degrees, lengths in the unit of ``axis``."""

    parallel_1: float
    parallel_2: float
    latitude: float
    longitude: float
    easting: float = 0.0
    northing: float = 0.0
    axis: float = 6378137.0
    flattening: float = 1 / 298.257223563

    def _constants(self) -> tuple[float, float, float, float]:
        e = math.sqrt(self.flattening * (2 - self.flattening))
        m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
        t = lambda p: math.exp(-math.atanh(math.sin(p)) + e * math.atanh(e * math.sin(p)))
        a, b, o = (math.radians(v) for v in (self.parallel_1, self.parallel_2, self.latitude))
        n = math.sin(a) if a == b else (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b)))
        scale = self.axis * m(a) / (n * t(a) ** n)
        return e, n, scale, scale * t(o) ** n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        e, n, scale, origin = self._constants()
        s = F.sin(F.radians(lat))
        r = scale * F.exp(n * (e * F.atanh(e * s) - F.atanh(s)))
        angle = n * F.radians(lon - self.longitude)
        return self.easting + r * F.sin(angle), self.northing + origin - r * F.cos(angle)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """(longitude, latitude) in degrees; latitudes converge to 1e-10 degrees in six steps."""
        e, n, scale, origin = self._constants()
        u, v = x - self.easting, origin - (y - self.northing)
        sign = math.copysign(1.0, n)
        r = F.sqrt(u * u + v * v)
        log_t = F.log(r / abs(scale)) / n  # the logarithm of t
        lat = F.lit(math.pi / 2) - 2 * F.atan(F.exp(log_t))
        for _ in range(6):
            lat = F.lit(math.pi / 2) - 2 * F.atan(F.exp(log_t - e * F.atanh(e * F.sin(lat))))
        lon = F.degrees(F.atan2(sign * u, sign * v) / n) + self.longitude
        pole = F.lit(sign * 90.0)
        return lon, F.when(r > 0, F.degrees(lat)).otherwise(pole)


def projected(rings: DataFrame, to: Lambert, back: bool = False) -> DataFrame:
    """``rings`` with vertices in the projection, or, ``back``, from it to degrees."""
    f = to.inverse if back else to.forward
    point = lambda p: F.struct(*[c.alias(n) for c, n in zip(f(p["x"], p["y"]), ("x", "y"))])
    return rings.withColumn("vertices", F.transform("vertices", point))


# ---------------------------------------------------------------- rings


def opened(v: Column) -> Column:
    """Vertices without a last one that repeats the first."""
    return F.when((F.size(v) > 1) & (F.element_at(v, 1) == F.element_at(v, -1)), F.slice(v, 1, F.size(v) - 1)).otherwise(v)


def _next(v: Column) -> Column:
    """The vertices that follow, the first after the last."""
    return F.concat(F.slice(v, 2, F.size(v)), F.slice(v, 1, 1))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def signed_area(v: Column) -> Column:
    """Area of an open ring by the shoelace, positive if it runs counterclockwise; taken about its first vertex, so that far coordinates lose no digits."""
    x0, y0 = v[0]["x"], v[0]["y"]
    return F.coalesce(_sum(F.zip_with(v, _next(v), lambda p, q: (p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0))) / 2, F.lit(0.0))


def with_holes(rings: DataFrame) -> DataFrame:
    """``rings`` with open vertices, signed area, and ``hole``: whether a ring runs the other way than the largest of its polygon.

    Rings with fewer than three vertices go.
    """
    x = rings.withColumn("vertices", opened(F.col("vertices"))).where(F.size("vertices") >= 3).withColumn("area", signed_area(F.col("vertices")))
    largest = F.max_by("area", F.struct(F.abs("area"), "area")).over(Window.partitionBy("polygon"))
    return x.withColumn("hole", F.signum("area") * F.signum(largest) < 0)


# ---------------------------------------------------------------- overlap with a grid


@dataclass(frozen=True)
class Grid:
    """Cells of ``step``, by row and column; (x, y) is the middle of cell (0, 0)."""

    x: float
    y: float
    step: float
    rows: int
    columns: int


def _side(axis: str, inside):
    """What the step from a vertex to the next leaves on one side of a line, whose place is the column __at."""

    def step(p: Column, q: Column) -> Column:
        a = F.col("__at")
        share = (a - p[axis]) / (q[axis] - p[axis])
        met = F.array(F.struct(*[(a if n == axis else p[n] + (q[n] - p[n]) * share).cast("double").alias(n) for n in ("x", "y")]))
        here, there = inside(p[axis], a), inside(q[axis], a)
        return F.when(here & there, F.array(p)).when(here, F.concat(F.array(p), met)).when(there, met).otherwise(F.array().cast(VERTICES))

    return step


def _cut(rings: DataFrame, axis: str, lo: Column, hi: Column) -> DataFrame:
    """``rings`` with what lies between lo and hi along an axis; pieces that are joined by a border of no width stay one ring, whose area is right."""
    for at, inside in ((lo, lambda v, a: v >= a), (hi, lambda v, a: v <= a)):
        rings = rings.withColumn("__at", at).withColumn("__next", _next(F.col("vertices")))
        rings = rings.withColumn("vertices", F.flatten(F.zip_with("vertices", "__next", _side(axis, inside)))).where(F.size("vertices") >= 3)
    return rings.drop("__at", "__next")


def areal_weights(rings: DataFrame, grid: Grid) -> DataFrame:
    """Rows (polygon, row, column, overlap, weight): the cells that a polygon overlaps, and their shares of all its overlap.

    rings: polygon and vertices; rings that run the other way than the polygon's largest are holes. Rings
    are cut into the grid's columns and those into cells, so that a vertex is copied once a column and not once a cell. A polygon that
    overlaps no cell goes to the one nearest to its centroid, held within the grid, with weight 1 and overlap 0; one without a ring of three vertices has no row.
    """
    known = with_holes(rings.select("polygon", "vertices"))
    along = lambda f, n: f(F.transform("vertices", lambda p: p[n]))
    edge = lambda k, start: start + (k - F.lit(0.5)) * grid.step

    def dealt(df: DataFrame, axis: str, start: float, n: int, name: str) -> DataFrame:
        first = F.floor((along(F.array_min, axis) - start) / grid.step + 0.5)
        last = F.floor((along(F.array_max, axis) - start) / grid.step + 0.5)
        lo, hi = F.greatest(first, F.lit(0)), F.least(last, F.lit(n - 1))
        each = df.select("*", F.explode(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))).alias(name))
        return _cut(each, axis, edge(F.col(name), start), edge(F.col(name) + 1, start))

    base = known.select("polygon", "hole", "vertices")
    cells = dealt(dealt(base, "x", grid.x, grid.columns, "column"), "y", grid.y, grid.rows, "row")
    piece = F.abs(signed_area(F.col("vertices")))
    overlap = cells.groupBy("polygon", "row", "column").agg(F.sum(F.when(F.col("hole"), -piece).otherwise(piece)).alias("overlap")).where("overlap > 0")
    v = F.col("vertices")
    x0, y0 = v[0]["x"], v[0]["y"]
    moment = lambda n, o: _sum(F.zip_with(v, _next(v), lambda p, q: (p[n] + q[n] - 2 * o) * ((p["x"] - x0) * (q["y"] - y0) - (q["x"] - x0) * (p["y"] - y0)))) / 6 + o * F.col("area")
    all_of = known.select("polygon", "area", moment("x", x0).alias("mx"), moment("y", y0).alias("my"), along(_sum, "x").alias("sx"), along(_sum, "y").alias("sy"), F.size("vertices").alias("n"))
    c = all_of.groupBy("polygon").agg(*[F.sum(k).alias(k) for k in ("area", "mx", "my", "sx", "sy", "n")])
    centre = lambda m, s: F.coalesce(F.try_divide(F.col(m), F.when(F.abs("area") > 1e-300, F.col("area"))), F.try_divide(F.col(s), F.col("n")))
    held = lambda z, start, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint((z - start) / grid.step))).cast("long")
    snapped = c.join(overlap.select("polygon").distinct(), "polygon", "left_anti")
    snapped = snapped.select("polygon", held(centre("my", "sy"), grid.y, grid.rows).alias("row"), held(centre("mx", "sx"), grid.x, grid.columns).alias("column"), F.lit(0.0).alias("overlap"), F.lit(1.0).alias("weight"))
    total = F.sum("overlap").over(Window.partitionBy("polygon"))
    return overlap.select("polygon", "row", "column", "overlap", (F.col("overlap") / total).alias("weight")).union(snapped)


# ---------------------------------------------------------------- dissolving


def borders(rings: DataFrame, key: str = "polygon") -> DataFrame:
    """Rows (key, x1, y1, x2, y2): the sides that are left when polygons of one key become one.

    Shells run clockwise and holes the other way, so that a side between two polygons of a key is met once in each direction and goes.
    Neighbours must share their vertices, as the parts of one map do. key: a column of ``rings``; polygon tells holes from shells.
    """
    known = with_holes(rings)
    turned = F.when((F.col("area") > 0) != F.col("hole"), F.reverse("vertices")).otherwise(F.col("vertices"))
    sides = known.where("area <> 0").withColumn("vertices", turned).withColumn("__next", _next(F.col("vertices")))
    sides = sides.select(F.col(key), F.explode(F.zip_with("vertices", "__next", lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))).alias("s")).select(key, "s.*").where("x1 <> x2 or y1 <> y2")
    ahead = (F.col("x1") < F.col("x2")) | ((F.col("x1") == F.col("x2")) & (F.col("y1") < F.col("y2")))
    ends = [F.when(ahead, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("x1", "x2", "ax"), ("y1", "y2", "ay"), ("x2", "x1", "bx"), ("y2", "y1", "by"))]
    net = sides.select(key, *ends, F.when(ahead, 1).otherwise(-1).alias("way")).groupBy(key, "ax", "ay", "bx", "by").agg(F.sum("way").alias("way")).where("way <> 0")
    forth = F.col("way") > 0
    return net.select(key, *[F.when(forth, F.col(a)).otherwise(F.col(b)).alias(n) for a, b, n in (("ax", "bx", "x1"), ("ay", "by", "y1"), ("bx", "ax", "x2"), ("by", "ay", "y2"))])


def stitched(sides: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed rings of directed sides (x1, y1, x2, y2); where several leave a vertex, the one that turns most to the right is taken, so that rings only touch."""
    out: dict[tuple, list] = {}
    for x1, y1, x2, y2 in sorted(map(tuple, sides.tolist()), reverse=True):
        out.setdefault((x1, y1), []).append((x2, y2))
    rings = []
    while out:
        start = min(out)
        ring, at, way = [start], start, None
        while True:
            ways = out[at]
            if len(ways) == 1 or way is None:
                to = ways.pop()
            else:
                back = math.atan2(-way[1], -way[0])
                to = min(ways, key=lambda q: (math.atan2(q[1] - at[1], q[0] - at[0]) - back) % (2 * math.pi))
                ways.remove(to)
            if not out[at]:
                del out[at]
            way, at = (to[0] - at[0], to[1] - at[1]), to
            if at == start:
                break
            ring.append(at)
            if at not in out:  # sides that don't close
                break
        rings.append(ring)
    return rings


def kept_vertices(ring: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker on a closed ring, given open: the vertices to keep. The first vertex and the one furthest from it stay, and a third, so that a ring stays a ring."""
    n = len(ring)
    if n <= 3:
        return ring
    far = int(np.argmax(((ring - ring[0]) ** 2).sum(axis=1)))
    closed = np.concatenate([ring, ring[:1]])
    keep = np.zeros(n + 1, bool)
    keep[[0, far, n]] = True
    apart, third = -1.0, 0
    work = [(0, far), (far, n)]
    while work:
        a, b = work.pop()
        if b - a < 2:
            continue
        p, q = closed[a], closed[b]
        d, rest = q - p, closed[a + 1 : b] - p
        length = float(np.hypot(*d))
        t = np.clip(rest @ d / length**2, 0, 1)[:, None] if length else np.zeros((len(rest), 1))
        away = np.hypot(*(rest - t * d).T)
        i = int(np.argmax(away))
        if away[i] > apart:
            apart, third = float(away[i]), a + 1 + i
        if away[i] > tolerance:
            keep[a + 1 + i] = True
            work += [(a, a + 1 + i), (a + 1 + i, b)]
    if keep[:n].sum() < 3:
        keep[third] = True
    return ring[keep[:n]]


def _inside(x: float, y: float, ring: np.ndarray) -> bool:
    a, b = ring, np.roll(ring, -1, axis=0)
    over = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (b[:, 0] - a[:, 0]) * (y - a[:, 1]) / (b[:, 1] - a[:, 1]) + a[:, 0]
    return bool(np.count_nonzero(over & (x < at)) % 2)


def _area(ring: np.ndarray) -> float:
    z = ring - ring[0]
    n = np.roll(z, -1, axis=0)
    return float((z[:, 0] * n[:, 1] - n[:, 0] * z[:, 1]).sum() / 2)


def features(rings: DataFrame, key: str, tolerance: float | None = None) -> DataFrame:
    """Rows (key, area, rings, coordinates): one feature for each key, dissolved, then simplified.

    coordinates are those of a GeoJSON MultiPolygon: shells counterclockwise, each with its holes, closed. area is that before simplifying, rings
    the number of rings. A key whose rings have no area has no row.
    """
    kind = rings.schema[key].dataType.simpleString()
    sides = borders(rings, key)

    def build(table: pd.DataFrame) -> pd.DataFrame:
        name = table[key].iloc[0]
        found = [np.array(r) for r in stitched(table[["x1", "y1", "x2", "y2"]].to_numpy(float)) if len(r) >= 3]
        areas = [_area(r) for r in found]
        shells = sorted((i for i, a in enumerate(areas) if a < 0), key=lambda i: areas[i])  # clockwise, the largest first
        holes: dict[int, list[int]] = {i: [] for i in shells}
        for h in (i for i, a in enumerate(areas) if a > 0):
            middle = (found[h][0] + found[h][1]) / 2
            home = [s for s in shells if abs(areas[s]) > areas[h] and _inside(*middle, found[s])]
            if home:
                holes[home[-1]].append(h)
        shown = lambda i: (lambda r: [[float(x), float(y)] for x, y in [*r, r[0]]])((kept_vertices(found[i], tolerance) if tolerance is not None else found[i])[::-1])
        return pd.DataFrame({key: [name], "area": [-sum(areas)], "rings": [len(found)], "coordinates": [[[shown(s), *map(shown, holes[s])] for s in shells]]})

    return sides.groupBy(key).applyInPandas(build, f"`{key}` {kind}, area double, rings int, coordinates array<array<array<array<double>>>>")


def geojson(shapes: DataFrame, key: str, properties: list[str] | None = None) -> DataFrame:
    """One GeoJSON Feature a row, as ``value``: written as text it is a sequence of features, one a line, which tasks write apart."""
    about = F.struct(F.col(key).alias("id"), *[F.col(c) for c in properties or []])
    one = F.struct(F.lit("Feature").alias("type"), about.alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates")).alias("geometry"))
    return shapes.select(F.to_json(one).alias("value"))


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """``rings`` with the vertices that Douglas-Peucker keeps, each ring for itself."""

    @F.arrow_udf(VERTICES)
    def keep(v: pa.Array) -> pa.Array:
        return pa.array([None if r is None else [{"x": x, "y": y} for x, y in kept_vertices(np.array([(p["x"], p["y"]) for p in r], float).reshape(-1, 2), tolerance).tolist()] for r in v.to_pylist()], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))

    return rings.withColumn("vertices", keep(opened(F.col("vertices"))))


def ring_of(*points: tuple[Column | float, Column | float]) -> Column:
    """An array of vertices from expressions."""
    one = lambda z: z if isinstance(z, Column) else F.lit(float(z))
    return F.array(*[F.struct(one(x).cast("double").alias("x"), one(y).cast("double").alias("y")) for x, y in points])

