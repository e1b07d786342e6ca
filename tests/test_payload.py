"""Payload blocks, refilled features, grids and matrices on small tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from agrolith.operators import grids as G
from agrolith.operators import panel as P
from agrolith.operators import payload as Y

MONTH = dt.date(2024, 1, 1)


def test_blocks_hold_neither_null_nor_nan(spark, tmp_path):
    layers = spark.createDataFrame([("a", 1, MONTH, 1.256), ("a", 1, dt.date(2024, 2, 1), None), ("b", 1, dt.date(2023, 12, 1), float("nan")), ("b", 2, MONTH, 7.0)], "layer string, district_id int, month date, v double")
    registry = spark.createDataFrame([(1, 'A "quoted"', "S", 1.0), (2, "B", "S", 3.0), (3, "C", "T", 0.0)], "district_id int, district string, state string, area double")
    blocks = Y.context(layers, registry)
    got = {int(r.key): json.loads(r.json) for r in blocks.collect()}
    assert got == {1: {"id": 1, "d": 'A "quoted"', "s": "S", "layers": {"a": {"as_of": "2024-01-01", "v": 1.26}}}, 2: {"id": 2, "d": "B", "s": "S", "layers": {"b": {"as_of": "2024-01-01", "v": 7.0}}}, 3: {"id": 3, "d": "C", "s": "T"}}
    odd = blocks.withColumn("key", F.concat("key", F.lit('"\\')))
    Y.write(odd, str(tmp_path / "p"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "p/block=context")).collect()]
    assert sorted(x["key"] for x in lines) == ['1"\\', '2"\\', '3"\\'] and all(x["value"]["id"] for x in lines)


def test_kpis_of_the_newest_month(spark):
    rows = [(1, MONTH, 10.0, 100.0), (2, MONTH, 100.0, 100.0), (3, MONTH, 300.0, 100.0), (4, MONTH, 5.0, 0.0), (1, dt.date(2024, 2, 1), None, 100.0)]
    registry = spark.createDataFrame([(i, 1.0) for i in range(1, 5)], "district_id int, area double")
    r = Y.kpis(spark.createDataFrame(rows, "district_id int, month date, actual double, normal double"), registry).first()
    assert r.key == "2024-01-01" and json.loads(r.json) == {"departure": 38.33, "districts": 3, "categories": {"Large deficit": 1, "Deficit": 0, "Normal": 1, "Excess": 0, "Large excess": 1}}


def test_ocean_status_tells_a_phase_that_forms_and_its_age(spark):
    values = [0.1, 0.6, 0.7, None, 0.8, 0.9]
    state = spark.createDataFrame([(2023, m + 1, v, "Neutral") for m, v in enumerate(values)], "year int, month int, idx double, phase string")
    r = json.loads(Y.ocean_status(state, F.lit("2023-09-15").cast("date")).first().json)
    assert (r["month"], r["status"], r["age_months"], r["run_months"]) == (6, "Warm, developing", 3, 2)
    assert Y.ocean_status(state, F.lit("2022-01-01").cast("date")).count() == 0


def test_refilled_rows_never_keep_whole_month_figures(spark):
    f = spark.createDataFrame([(1, MONTH, 50.0, 5.0, "x"), (2, MONTH, 60.0, 6.0, "y"), (1, dt.date(2023, 12, 1), 70.0, 7.0, "z")], "district_id int, month date, rain double, heat double, name string")
    now = spark.createDataFrame([(1, MONTH, 20.0, None, 9.0)], "district_id int, month date, rain double, heat double, other double")
    got = sorted((r.district_id, str(r.month), r.rain, r.heat, r.name, r.is_month_to_date) for r in P.refilled(f, now).collect())
    assert got == [(1, "2023-12-01", 70.0, 7.0, "z", 0), (1, "2024-01-01", 20.0, None, "x", 1), (2, "2024-01-01", 60.0, 6.0, "y", 0)]
    kept = {r.name: r.rain for r in P.masked(f, {"rain": [F.col("heat") > 5, F.when(F.col("name") != "z", True)]}).collect()}
    assert kept == {"x": None, "y": 60.0, "z": None}


def test_running_month_ends_with_the_observations(spark):
    days = [(1, dt.date(y, m, d), 1.0 + d, 30.0, 20.0) for y in range(2000, 2006) for m in (5, 6) for d in range(1, 31)]
    part = [r for r in days if r[1] <= dt.date(2005, 6, 10)]
    schema = "district_id int, date date, rain_mm double, tmax_c double, tmin_c double"
    now = P.running_month(spark.createDataFrame(part, schema), (2000, 2003), F.lit(20.0), [1, 2], least=5, complete=10).collect()
    assert len(now) == 1 and now[0].rain_mm == pytest.approx(65.0) and now[0].rain_dep == pytest.approx(0.0) and now[0].month == dt.date(2005, 6, 1)
    whole = P.running_month(spark.createDataFrame([r for r in days if r[1].month == 6], schema), (2000, 2003), F.lit(20.0), [1])
    assert whole.count() == 0 and "spei_1" in whole.columns


def test_bilinear_means_leave_masked_cells_out(spark):
    cells = spark.createDataFrame([(0, 0, 0.0), (0, 1, 10.0), (1, 0, None), (1, 1, 30.0)], "row int, column int, v double")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.5, 0.0), (3, 0.25, 0.5), (4, 9.0, 9.0), (5, 0.0, 1.0), (6, 1.5, 1.0)], "id int, x double, y double")
    got = {r.id: r.v for r in G.bilinear(points, cells, 0.0, 0.0, 1.0).collect()}
    assert got == {1: 0.0, 2: 5.0, 3: pytest.approx((0.125 * 10 + 0.125 * 30) / 0.625), 6: 30.0}


def test_wide_matrices_come_back_as_rows(spark):
    wide = spark.createDataFrame([("d1", 1.0, None, 2.0), ("d2", float("nan"), 3.0, 4.0)], "date string, `7` double, `8` double, note double")
    assert sorted(tuple(r) for r in G.from_wide(wide, "date", "unit", "v").collect()) == [("d1", 7, 1.0), ("d2", 8, 3.0)]
