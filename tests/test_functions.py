import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from agrolith.functions.nulls import categories, clip, percent_departure, ratio_of_sums, sum_at_least, weighted_mean
from agrolith.operators import indices
from agrolith.operators import windows as W


def values(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_clip_and_categories_keep_missing_values(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-5.0,), (0.5,), (9.0,)], "x double")
    assert values(df, clip(F.col("x"), 0, 1)) == [None, None, 0.0, 0.5, 1.0]
    assert values(df, categories(F.col("x"), [0.5, 9.0]))[2:] == [0, 1, 2] and values(df, categories(F.col("x"), [0.5, 9.0], right=True))[2:] == [0, 0, 1]


def test_departure_has_a_floor(spark):
    df = spark.createDataFrame([(10.0, 4.99), (10.0, 5.0), (None, 5.0), (1.0, None)], "a double, n double")
    assert values(df, percent_departure(F.col("a"), F.col("n"))) == [None, 100.0, None, None]


def test_ratio_of_sums_is_no_mean_of_percentages(spark):
    df = spark.createDataFrame([(50.0, 100.0, 1.0), (300.0, 100.0, 9.0), (None, 100.0, 5.0)], "a double, n double, w double")
    assert df.agg(ratio_of_sums(F.col("a"), F.col("n"), F.col("w"))).first()[0] == pytest.approx(175.0)
    assert df.agg(ratio_of_sums(F.col("a"), F.col("n"), F.col("w"), paired=False)).first()[0] == pytest.approx(100 * (2750 / 1500 - 1))
    assert df.agg(weighted_mean(F.col("a"), F.col("w"))).first()[0] == 275.0
    assert tuple(df.agg(sum_at_least(F.col("a"), 3), sum_at_least(F.col("a"), 2), sum_at_least(F.when(F.col("a") > 999, 1.0), 0)).first()) == (None, 350.0, 0.0)


def test_inverse_normal(spark):
    p = [1e-6, 0.001, 0.02, 0.07499, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-6]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    assert values(df, F.expr(indices.inverse_normal_sql("p"))) == pytest.approx([NormalDist().inv_cdf(x) for x in p], abs=1e-12)


def test_spei_of_short_groups_is_null(spark):
    df = spark.createDataFrame([("a", i, float(i * i % 37)) for i in range(40)] + [("b", i, float(i)) for i in range(10)] + [("a", 99, None)], "g string, t int, x double")
    got = {(r.g, r.t): r.spei for r in indices.spei(df, "x", ["g"], "t").collect()}
    assert all(got["b", i] is None for i in range(10)) and got["a", 99] is None
    z = [got["a", i] for i in range(40)]
    assert abs(sum(z) / 40) < 0.15 and all(math.isfinite(v) for v in z)


def test_dry_spells_restart_after_a_gap(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([5.0, 0.0, 0.0, None, 0.0, 3.0, 0.0])], "k int, t int, v double")
    assert [r.dry_days for r in sorted(W.dry_spell(df, "v", ["k"], "t").collect(), key=lambda r: r.t)] == [0, 1, 2, None, 1, 0, 1]


def test_segments_by_reset_and_silence(spark):
    rows = [("2020-06-01", 44158.0), ("2020-06-08", 618.0), ("2020-06-15", 900.0), ("2020-07-13", 950.0), ("2020-07-20", 1000.0)]
    df = spark.createDataFrame([("c", d, v) for d, v in rows], "c string, d string, v double").withColumn("d", F.col("d").cast("date"))
    assert [r.segment for r in sorted(W.segments(df, ["c"], "d", "v").collect(), key=lambda r: r.d)] == [0, 1, 1, 2, 2]


def test_bounded_fill(spark):
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 2.0, None, None, None, None])], "k int, t int, v double")
    got = df.select("t", W.bounded_fill(F.col("v"), W.series("k", "t"), 3).alias("f")).collect()
    assert [r.f for r in sorted(got, key=lambda r: r.t)] == [None, 2.0, 2.0, 2.0, 2.0, None]


def test_a_lookup_needs_exactly_one_row(spark):
    import pytest

    from agrolith.operators.checks import exactly_one

    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert exactly_one(df, F.col("k") == 1).first().v == "a"
    for k in (2, 3):
        with pytest.raises(ValueError):
            exactly_one(df, F.col("k") == k)


def test_exact_quantiles_of_ties_nulls_and_single_rows(spark):
    import numpy as np

    from agrolith.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=501).round(1).tolist(), "b": [3.0], "c": [1.0] * 40, "d": rng.integers(0, 9, 200).astype(float).tolist()}
    rows = [(k, v) for k, vs in values.items() for v in vs] + [("a", None), ("e", None)]
    wanted = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.k: r.q for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", wanted, 8).collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        assert np.allclose(got[k], np.quantile(vs, wanted))


def test_nearest_cells_by_brute_force(spark):
    import numpy as np

    from agrolith.operators.joins import nearest_cell

    rng = np.random.default_rng(2)
    points, cells = rng.uniform(-50, 150, (200, 2)), rng.uniform(0, 40, (30, 2))
    frame = lambda x, k: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], f"{k} long, x double, y double")
    got = {r.id: r.cell for r in nearest_cell(frame(points, "id"), frame(cells, "cell"), 5.0).collect()}
    far = ((points[:, None, :] - cells[None, :, :]) ** 2).sum(-1)
    assert got == {i: int(far[i].argmin()) for i in range(200)}
    assert nearest_cell(frame(points, "id"), frame(cells[:0], "cell"), 5.0).count() == 0


def test_fuzzy_names_without_letters_and_names_of_one_key(spark):
    from agrolith.operators.joins import fuzzy_names

    left = spark.createDataFrame([(1, "s", "12 34"), (2, "t", "Far Town"), (3, "s", "north hill"), (4, "u", "common")], "id long, state string, name string")
    right = spark.createDataFrame([(10, "s", "99"), (11, "v", "far-town"), (12, "s", "North"), (13, "v", "common"), (14, "w", "Common")], "key long, state string, name string")
    assert sorted((r.id, r.key) for r in fuzzy_names(left, right).collect()) == [(2, 11), (3, 12)]


def test_as_of_over_buckets_by_brute_force(spark):
    import datetime as dt

    import numpy as np

    from agrolith.operators.joins import as_of

    rng = np.random.default_rng(3)
    day = lambda n: dt.date(1999, 1, 1) + dt.timedelta(days=int(n))
    left = [(i, int(rng.integers(0, 3)), day(rng.integers(0, 2000))) for i in range(150)] + [(900, None, day(5)), (901, 1, None)]
    right = [(int(rng.integers(0, 3)), day(rng.integers(0, 2000)), int(v)) for v in range(25)]
    got = {r.id: (r.as_of, r.v) for r in as_of(spark.createDataFrame(left, "id long, k long, t date"), spark.createDataFrame(right, "k long, t date, v long"), ["k"], "t", ["v"]).collect()}
    for i, k, t in left:
        found = [(u, v) for c, u, v in right if k is not None and t is not None and c == k and u <= t]
        assert got[i] == (max(found) if found else (None, None))
