"""Image statistics on small tables, against plain arithmetic."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from agrolith.operators import grids as G


def test_adaptive_domain_is_that_of_sorted_values(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, 0.0, 3.0, rng.uniform(0, 2500)])) for g in ("a", "b", "c") for _ in range(70)] + [("few", float(i)) for i in range(7)] + [("same", 24.0)] * 30 + [("none", None)]
    got = {r.g: r.top for r in G.adaptive_domain(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v")).collect()}
    want = {}
    for g in {g for g, v in rows if v is not None}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        p = v[math.floor(0.95 * (len(v) - 1))]
        want[g] = 100 if len(v) < 8 else next((n for n in G.NICE if n >= p), 1000)
    assert got == want and got["same"] == 25


def test_units_and_masks(spark):
    df = spark.createDataFrame([("z", 273.15, True, 1.0, "a"), ("z", 20.0, False, 2.0, "b"), ("z", None, None, 3.0, "a"), ("y", 5.0, False, 4.0, None)], "zone string, t double, good boolean, area double, kind string")
    assert [r[0] for r in df.select(G.celsius(F.col("t"))).collect()] == [0.0, 20.0, None, 5.0]
    assert [r[0] for r in df.select(G.evaporation_mm(-F.col("t"))).collect()] == [273150.0, 20000.0, None, 5000.0]
    assert {r.zone: (r.mean, r.clear) for r in G.quality_masked_mean(df, "zone", "t", F.col("good"), 10.0).collect()} == {"z": (pytest.approx(27.315), pytest.approx(1 / 3)), "y": (None, 0.0)}
    got = {r.zone: (r.a, r.b, r.share) for r in G.class_areas(df, "zone", "area", {"a": F.col("kind") == "a", "b": F.col("kind") == "b"}, {"share": ("a", "b")}).collect()}
    assert got == {"z": (4.0, 2.0, 200.0), "y": (None, None, None)}


def test_part_days_are_withheld(spark):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    df = spark.createDataFrame([("k", at(1, h), 1.0 * h, 3.0, 4.0) for h in (0, 6, 12, 18)] + [("k", at(2, 0), 9.0, 3.0, 4.0)], "key string, ts timestamp, rate double, u double, v double")
    got = G.subdaily_to_daily(df, ["key"], "ts", "rate", "u", "v", least=4).collect()
    assert [(r.day.day, r.total, r.hi, r.lo, r.speed, r.n_records) for r in got] == [(1, 9.0 * 86_400, 18.0, 0.0, 5.0, 4)]


def test_newest_ensemble_and_forecast_sums(spark):
    m = spark.createDataFrame([(run, lead, float(v + 100 * (run == "r2"))) for run in ("r1", "r2") for lead in (1, 2) for v in range(5)], "run string, lead int, v double")
    assert [(r.lead, r.mean, r.q) for r in G.ensemble_leads(m, "run", "lead", "v", [1, 9], (0.0, 0.25, 1.0)).collect()] == [(1, 102.0, [100.0, 101.0, 104.0])]
    f = spark.createDataFrame([("s", d, 1.0 * d, 4 if d != 2 else 3) for d in range(1, 5)], "s string, d int, v double, n int")
    assert [r.total for r in G.forecast_layer(f, ["s"], "d", "v", F.col("n"), 4, 2, 2).orderBy("d").collect()] == [None, None, None, 7.0]
