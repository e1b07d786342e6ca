"""Polygons: weights on a grid, dissolved features, projected rings."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators import geometry as G
from agrolith.plans.climate import r4
from agrolith.plans.domain import r6
from agrolith.plans.registry import query
from agrolith.sources import adapters as A

GRID = G.Grid(3.0, 2.0, 6.0, 16, 17)
LEG = 20



def _below(a: str, b: str) -> str:
    """The part of a right triangle with legs LEG at the origin that lies left of a and below b."""
    cut = lambda z: f"least(greatest({z}, 0), {LEG})"
    rest = f"greatest({LEG} - {cut(a)} - {cut(b)}, 0)"
    return f"({LEG * LEG}.0e0 - ({LEG} - {cut(a)}) ** 2 - ({LEG} - {cut(b)}) ** 2 + {rest} ** 2) / 2"


def _cells(g: G.Grid) -> str:
    x0, y0 = (f"({v - g.step / 2}e0 + {g.step}e0 * {c} - {o})" for v, c, o in ((g.x, "c", "x"), (g.y, "r", "y")))
    x1, y1 = (f"({z} + {g.step}e0)" for z in (x0, y0))
    return f"SELECT polygon, r AS row, c AS \"column\", {_below(x1, y1)} - ({_below(x0, y1)}) - ({_below(x1, y0)}) + {_below(x0, y0)} AS overlap FROM sq, range({g.rows}) a(r), range({g.columns}) b(c)"


@query("j16_polygon_weights", f"WITH sq AS (SELECT n_nationkey AS polygon, n_nationkey * 7 % 90 * 1.0e0 AS x, n_nationkey * 11 % 80 * 1.0e0 AS y FROM nation), o AS ({_cells(GRID)}) SELECT polygon, row, \"column\", round(overlap, 4) AS overlap, round(overlap / sum(overlap) OVER (PARTITION BY polygon), 6) AS weight FROM o WHERE overlap > 1e-9")
def j16_polygons(spark, d):
    """Right triangles on a grid of cells; their overlaps have a closed form."""
    k = F.col("n_nationkey")
    x, y = (k * 7 % 90).cast("double"), (k * 11 % 80).cast("double")
    rings = A.table(spark, d, "nation").select(k.alias("polygon"), G.ring_of((x, y), (x, y + LEG), (x + LEG, y)).alias("vertices"))
    return G.areal_weights(rings, GRID).where("overlap > 1e-9").select("polygon", "row", "column", r4(F.col("overlap"), "overlap"), r6(F.col("weight"), "weight"))


_PLOTS = "SELECT p_partkey % 50 AS x, p_partkey // 50 AS y, (p_partkey % 50) // 7 * 1000 + (p_partkey // 50) // 9 AS id FROM part WHERE p_size % 10 <> 0"


@query("k07_dissolved_features", f"WITH p AS ({_PLOTS}), j AS (SELECT a.id, count(*) AS n FROM p a JOIN p b ON a.id = b.id AND ((a.x + 1 = b.x AND a.y = b.y) OR (a.x = b.x AND a.y + 1 = b.y)) GROUP BY 1) SELECT id, CAST(count(*) AS DOUBLE) AS area, CAST(4 * count(*) - 2 * coalesce(any_value(n), 0) AS DOUBLE) AS border, 1 AS features FROM p LEFT JOIN j USING (id) GROUP BY id")
def k07(spark, d):
    """Unit plots, some missing, dissolved to one feature a district: its area, the length of its border, and how many features it is."""
    k = F.col("p_partkey")
    x, y = (k % 50).cast("long"), F.floor(k / 50)
    plots = A.table(spark, d, "part").where("p_size % 10 <> 0").select(k.alias("polygon"), (F.floor(x / 7) * 1000 + F.floor(y / 9)).alias("id"), G.ring_of((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1)).alias("vertices"))
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    borders = G.borders(plots, "id").groupBy("id").agg(F.sum(length).alias("border"))
    shapes = G.features(plots, "id", 0.01)
    lines = G.geojson(shapes, "id", ["area"]).select(F.get_json_object("value", "$.properties.id").cast("long").alias("id"), F.get_json_object("value", "$.properties.area").cast("double").alias("area"))
    return lines.groupBy("id").agg(F.sum("area").alias("area"), F.count(F.lit(1)).cast("int").alias("features")).join(borders, "id").select("id", "area", "border", "features")


CONIC = G.Lambert(12.472955, 35.17280444444444, 24.0, 80.0, 4_000_000.0, 4_000_000.0)


@query("s16_rings_from_a_conic", "SELECT n_nationkey AS polygon, CAST(i AS INT) AS ring, CAST(i AS BOOLEAN) AS hole, round(68 + n_nationkey * 11 % 29 + i * 0.25e0, 6) AS lon, round(8 + n_nationkey * 7 % 25 + i * 0.25e0, 6) AS lat, CASE WHEN i = 1 THEN 0.25e0 ELSE 1.0e0 END AS area FROM nation, range(2) t(i)")
def s16(spark, d):
    """Rings given in a conic projection, read back in degrees, with holes told from shells."""
    k = F.col("n_nationkey")
    lon, lat = (68 + k * 11 % 29).cast("double"), (8 + k * 7 % 25).cast("double")
    shell = G.ring_of((lon, lat), (lon, lat + 1), (lon + 1, lat + 1), (lon + 1, lat), (lon, lat))
    inner = G.ring_of(*[(lon + 0.25 + a, lat + 0.25 + b) for a, b in ((0, 0), (0.5, 0), (0.5, 0.5), (0, 0.5), (0, 0))])
    n = A.table(spark, d, "nation")
    rings = n.select(k.alias("polygon"), F.posexplode(F.array(shell, inner)).alias("ring", "vertices"))
    back = G.with_holes(G.projected(G.projected(rings, CONIC), CONIC, back=True))
    first = F.col("vertices")[0]
    return back.select("polygon", "ring", "hole", r6(first["x"], "lon"), r6(first["y"], "lat"), r6(F.abs("area"), "area"))
