"""Scores by slice, deciles, selectors and audits on small tables, against plain arithmetic."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.operators import definitions as D
from agrolith.operators import verification as V


def test_slices_equal_plain_scores(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abcd"), rng.choice([None, float("nan"), rng.uniform(-300, 2000), rng.gauss(0, 50)]), rng.choice([None, rng.gauss(0, 60), rng.gauss(0, 60)]), rng.choice([None, rng.gauss(0, 60)]), i % 12) for i in range(400)]
    df = spark.createDataFrame(rows, "state string, p double, y double, b double, m int")
    got = {r["slice"]: r for r in V.by_slice(df, F.col("p"), F.col("y"), F.col("b"), {"wet": F.col("m") > 7, "none": F.lit(False), "missing": F.lit(None).cast("boolean")}, {"state": (F.col("state"), 2)}, least=20).collect()}
    known = [r for r in rows if r[2] is not None]
    count = {s: sum(r[0] == s for r in known) for s in "abcd"}
    top = sorted("abcd", key=lambda s: (-count[s], s))[:2]
    groups = {"all": known, "wet": [r for r in known if r[4] > 7]} | {f"state {s}": [r for r in known if r[0] == s] for s in top}
    assert set(got) == set(groups)
    held = lambda v: 0.0 if v is None or math.isnan(v) else min(1000.0, max(-100.0, v))
    for name, part in groups.items():
        p, y, b = (np.array(z) for z in ([held(r[1]) for r in part], [r[2] for r in part], [held(r[3]) for r in part]))
        category = lambda v: np.digitize(v, V.EDGES)
        r = got[name]
        want = (len(part), np.sqrt(np.mean((p - y) ** 2)), 1 - np.mean((p - y) ** 2) / np.mean(y**2), 1 - np.mean((p - y) ** 2) / np.mean((b - y) ** 2), np.corrcoef(p, y)[0, 1], np.mean(np.abs(p - y)), np.mean(category(p) == category(y)))
        assert (r.n, r.rmse, r.skill, r.skill_vs_persistence, r.r, r.mae, r.accuracy) == pytest.approx(want)


def test_deciles_put_edges_above(spark):
    p = [float(i // 3) for i in range(60)] + [5.0] * 40
    df = spark.createDataFrame([(v, v * 2) for v in p] + [(None, 1.0), (1.0, None)], "p double, y double")
    got = {r.bin: (r.n, r.mean_forecast) for r in V.deciles(df, F.col("p"), F.col("y"), least=1).collect()}
    at = np.digitize(p, np.quantile(p, np.linspace(0, 1, 11))[1:-1]) + 1
    assert got == {int(k): (int((at == k).sum()), pytest.approx(np.mean(np.array(p)[at == k]))) for k in np.unique(at)}


def test_served_forecasts_are_withheld_without_inputs(spark):
    df = spark.createDataFrame([(10.0, 1.0, 5.0, True), (10.0, 1.0, 0.0, True), (10.0, 1.0, 5.0, False), (None, 1.0, 5.0, True), (900.0, 9.0, 5.0, True)], "a double, s double, n double, ok boolean")
    shown = df.select(V.served_blend({"x": ("raw", F.col("a")), "y": ("huber", F.col("a") * 2)}, F.col("n"), F.col("s"), F.col("ok")).alias("v"))
    assert [r.v for r in shown.collect()] == [15.0, None, None, None, 1000.0]
    with pytest.raises(ValueError):
        V.departure_of("poisson", F.col("a"), F.col("n"))


def test_selectors_fall_back(spark):
    f = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "b", 3.0), (3, "a", None), (3, "b", 4.0), (4, "c", 5.0)], "unit int, model string, value double")
    c = spark.createDataFrame([("a", 0.1, False), ("b", 0.2, True), ("c", 0.3, False)], "model string, skill double, is_default boolean")
    pick = lambda m: sorted(tuple(r) for r in V.selected(f, c, ["unit"], m).collect())
    assert pick("a") == [(1, "a", 1.0, 0.1, False), (2, "b", 3.0, 0.2, True), (3, "b", 4.0, 0.2, True)]
    assert pick("b") == [(1, "b", 2.0, 0.2, False), (2, "b", 3.0, 0.2, False), (3, "b", 4.0, 0.2, False)]
    m = spark.createDataFrame([(1, 1, 1.0), (1, 3, 3.0), (1, 7, 7.0), (2, 9, 9.0), (2, 8, 8.0), (3, 5, None)], "unit int, lead int, value double")
    assert sorted(tuple(r) for r in V.at_lead(m, ["unit"], 5).collect()) == [(1, 3, 3.0), (2, 8, 8.0)]


def test_live_reports_and_pace(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    df = spark.createDataFrame([("a", day(0), 1.0), ("a", day(60), 2.0), ("b", day(15), 3.0), ("c", day(14), 4.0)], "unit string, week date, v double")
    assert sorted((r.unit, r.v, r.days_behind) for r in V.live(df, ["unit"], "week").collect()) == [("a", 2.0, 0), ("b", 3.0, 45)]
    rows = [("a", y, w, float(v)) for y, vs in ((2020, [1, 2, 4, 10]), (2021, [2, 2, 4.5, 0]), (2022, [5])) for w, v in enumerate(vs)]
    got = {(r.year, r.week): (r.yoy_pct, r.coverage_pct, r.pace_pp, r.label) for r in V.pace(spark.createDataFrame(rows, "unit string, year int, week int, v double"), "unit", "year", "week", "v").collect()}
    assert got[2021, 0] == (100.0, 20.0, 10.0, "Ahead") and got[2021, 1][3] == "On pace" and got[2021, 3][2:] == (-100.0, "Behind") and got[2020, 0] == (None, None, None, "no prior season")
    assert got[2022, 0][0] == 150.0 and got[2022, 0][1] == pytest.approx(500 / 4.5)


def test_audits_tell_what_is_wrong(spark):
    day = lambda n: dt.date(2024, 1, n)
    rows = [("f", u, day(d), float(d)) for u in (1, 2) for d in (1, 2, 4)] + [("f", 1, day(1), None)] + [("g", u, day(d), 0.0) for u in (1, 2) for d in (1, 2)]
    got = {r.file: (r.rows, r.expected, r.repeated, r.gaps, r.blank, r.zero, r.complete) for r in D.product_files(spark.createDataFrame(rows, "file string, u int, d date, v double"), F.col("file"), ["u"], "d", "v", 2).collect()}
    assert got == {"f": (7, 6, 1, 1, 1, 0, False), "g": (4, 4, 0, 0, 0, 4, True)}
    failing = D.bounded(spark.createDataFrame([(1.0, None), (2.0, None)], "a double, b double"), {"a": (0.0, 1.5), "b": (0.0, None)}).collect()
    assert {r.test: r.passed for r in failing} == {"a: lowest": True, "a: highest": False, "b: lowest": False}
    layers = spark.createDataFrame([("x", day(1), 1.0), ("x", day(3), 1.0), ("y", day(2), 1.0), ("z", day(1), None), ("w", day(1), 1.0), ("w", day(2), 1.0), ("w", day(3), 2.0)], "layer string, month date, v double")
    months = spark.createDataFrame([(day(n),) for n in (1, 2, 3)], "month date")
    assert {r.layer: (r.months, r.holes, r.late, r.verdict) for r in D.month_slots(layers, months).collect()} == {"x": (2, 1, 0, "HOLE"), "y": (1, 0, 1, "starts late"), "z": (0, 0, 0, "EMPTY"), "w": (3, 0, 0, "ok")}
