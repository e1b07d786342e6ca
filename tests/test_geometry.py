"""Projection, overlaps with grids, dissolving and simplifying, against known values, closed forms and sampling."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.operators import geometry as G
from agrolith.operators import joins

SCHEMA = f"polygon int, vertices {G.VERTICES}"


def rings(spark, table):
    return spark.createDataFrame([(i, [tuple(map(float, p)) for p in v]) for i, v in table], SCHEMA)


def square(x, y, a=1.0, clockwise=False):
    v = [(x, y), (x + a, y), (x + a, y + a), (x, y + a)]
    return v[::-1] if clockwise else v


# the worked example of the public guidance on coordinate conversions: NAD27 / Texas South Central, in US survey feet
FOOT = 0.3048006096012192
TEXAS = G.Lambert(28 + 23 / 60, 30 + 17 / 60, 27 + 50 / 60, -99.0, 2_000_000.0, 0.0, 6378206.4 / FOOT, 1 / 294.97870)


def test_lambert_conic_of_a_published_example_and_round_trips(spark):
    df = spark.createDataFrame([(-96.0, 28.5)], "lon double, lat double")
    x, y = df.select(*TEXAS.forward(F.col("lon"), F.col("lat"))).first()
    assert x == pytest.approx(2963503.91, abs=0.05) and y == pytest.approx(254759.80, abs=0.05)
    india = G.Lambert(12.472955, 35.17280444444444, 24.0, 80.0, 4_000_000.0, 4_000_000.0)
    for to in (TEXAS, india, G.Lambert(-20.0, -40.0, -30.0, 135.0), G.Lambert(25.0, 25.0, 25.0, 0.0)):
        away = to.longitude
        table = rings(spark, [(1, [(away + dx, to.latitude + dy) for dx in (-40, -3.3, 0, 17, 39) for dy in (-18, 0, 0.1, 21)])])
        back = G.projected(G.projected(table, to), to, back=True).first().vertices
        assert np.allclose(np.array(back), np.array(table.first().vertices), atol=1e-9)


def test_holes_run_the_other_way_than_the_largest_ring(spark):
    table = [(1, square(0, 0, 9)), (1, square(1, 1, 2, True)), (1, square(20, 0, 3)), (2, square(0, 0, 9, True) + [(0, 9)]), (2, square(1, 1, 2)), (3, [(0, 0), (1, 1)])]
    got = sorted((r.polygon, abs(r.area), r.hole) for r in G.with_holes(rings(spark, table)).collect())
    assert got == [(1, 4.0, True), (1, 9.0, False), (1, 81.0, False), (2, 4.0, True), (2, 81.0, False)]


def test_weights_of_boxes_agree_with_overlaps_of_boxes(spark):
    rng = np.random.default_rng(2)
    boxes = [(i, *sorted(rng.uniform(0, 8, 2)), *sorted(rng.uniform(0, 6, 2))) for i in range(30)]
    grid = G.Grid(0.5, 0.5, 1.0, 6, 8)
    a = spark.createDataFrame([(i, *map(float, b)) for i, *b in boxes], "id int, x0 double, x1 double, y0 double, y1 double")
    cells = spark.createDataFrame([(r * 8 + c, float(c), c + 1.0, float(r), r + 1.0) for r in range(6) for c in range(8)], a.schema)
    want = {(r.a_id, r.b_id): (r.overlap, r.weight) for r in joins.box_overlap(a, cells, 1.0).collect()}
    table = rings(spark, [(i, [(x0, y0), (x1, y0), (x1, y1), (x0, y1)][:: 1 if i % 2 else -1]) for i, x0, x1, y0, y1 in boxes])
    got = {(r.polygon, r.row * 8 + r.column): (r.overlap, r.weight) for r in G.areal_weights(table, grid).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_weights_of_concave_polygons_with_holes_by_sampling(spark):
    star = [(5 + (4.3 if k % 2 else 1.5) * math.cos(k * math.pi / 7), 5 + (4.3 if k % 2 else 1.5) * math.sin(k * math.pi / 7)) for k in range(14)]
    table = [(1, star), (1, square(4.5, 4.6, 0.8, True)), (2, [(0, 0), (6, 0), (6, 2), (2, 2), (2, 6), (6, 6), (6, 8), (0, 8)])]
    grid = G.Grid(0.0, 0.0, 1.5, 8, 8)
    rows = G.areal_weights(rings(spark, table), grid).collect()
    for polygon in (1, 2):
        own = [np.array(v, float) for i, v in table if i == polygon]
        got = {(r.row, r.column): r.overlap for r in rows if r.polygon == polygon}
        assert sum(r.weight for r in rows if r.polygon == polygon) == pytest.approx(1.0)
        assert sum(got.values()) == pytest.approx(abs(G._area(own[0])) - sum(abs(G._area(v)) for v in own[1:]))
        n = 40
        for r in range(8):
            for c in range(8):
                at = [(1.5 * (c - 0.5 + (i + 0.5) / n), 1.5 * (r - 0.5 + (j + 0.5) / n)) for i in range(n) for j in range(n)]
                share = np.mean([sum(G._inside(x, y, v) for v in own) % 2 for x, y in at]) * 1.5**2
                assert got.get((r, c), 0.0) == pytest.approx(share, abs=0.05)


def test_polygons_without_overlap_go_to_the_nearest_cell_of_the_grid(spark):
    table = [(1, square(100, 50)), (2, square(-9, 2.2, 0.5)), (3, [(3, 3), (3, 3), (3, 3)]), (4, [(1.2, 4), (1.2, 4.4), (1.2, 4.8)]), (5, square(2, 2))]
    got = {r.polygon: (r.row, r.column, r.overlap, r.weight) for r in G.areal_weights(rings(spark, table), G.Grid(0.5, 0.5, 1.0, 5, 6)).collect()}
    assert got == {1: (4, 5, 0.0, 1.0), 2: (2, 0, 0.0, 1.0), 4: (4, 1, 0.0, 1.0), 5: (2, 2, 1.0, 1.0)}
    assert G.areal_weights(rings(spark, []), G.Grid(0, 0, 1, 2, 2)).count() == 0


def test_dissolved_features_have_the_area_of_their_parts(spark):
    parts = [(1, x, y) for x in range(3) for y in range(3) if (x, y) != (1, 1)]  # a square with a hole
    parts += [(2, 0, 0), (2, 1, 1), (3, 5, 5), (3, 6, 5), (3, 9, 9)]  # two that touch in a corner; two joined and one apart
    df = spark.createDataFrame([(n, i, [tuple(map(float, p)) for p in square(x, y, 1.0, n % 2 == 0)]) for n, (i, x, y) in enumerate(parts)], f"polygon int, id int, vertices {G.VERTICES}")
    got = {r.id: r for r in G.features(df, "id", 0.01).collect()}
    assert {i: (r.area, r.rings) for i, r in got.items()} == {1: (8.0, 2), 2: (2.0, 2), 3: (3.0, 2)}
    assert [len(p) for p in got[1].coordinates] == [2] and [len(p) for p in got[3].coordinates] == [1, 1]
    assert len(got[1].coordinates[0][0]) == 5 and len(got[1].coordinates[0][1]) == 5  # straight sides lose their middle vertices
    for r in got.values():
        for shell, *holes in r.coordinates:
            assert shell[0] == shell[-1] and G._area(np.array(shell[:-1])) > 0 and all(G._area(np.array(h[:-1])) < 0 for h in holes)
        assert sum(G._area(np.array(ring[:-1])) for p in r.coordinates for ring in p) == pytest.approx(r.area)
    lines = [json.loads(r.value) for r in G.geojson(G.features(df, "id"), "id", ["area"]).collect()]
    assert sorted(f["properties"]["id"] for f in lines) == [1, 2, 3] and {f["geometry"]["type"] for f in lines} == {"MultiPolygon"}


def test_simplifying_keeps_what_stands_out(spark):
    angle = np.linspace(0, 2 * math.pi, 400, endpoint=False)
    circle = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    kept = G.kept_vertices(circle, 0.01)
    assert 10 < len(kept) < 60 and G._area(kept) == pytest.approx(math.pi, rel=0.03)
    for p in circle:  # no vertex is further from the kept ring than the tolerance
        a, b = kept, np.roll(kept, -1, axis=0)
        t = np.clip(((p - a) * (b - a)).sum(axis=1) / ((b - a) ** 2).sum(axis=1), 0, 1)[:, None]
        assert np.hypot(*(p - a - t * (b - a)).T).min() <= 0.01 + 1e-12
    assert len(G.kept_vertices(circle, 100.0)) == 3
    table = rings(spark, [(1, [*map(tuple, circle.tolist()), tuple(circle[0].tolist())]), (2, square(0, 0)), (3, [])])
    assert {r.polygon: len(r.vertices) for r in G.simplified(table, 0.01).collect()} == {1: len(kept), 2: 4, 3: 0}
