"""Boosted trees against a plain version in numpy, losses against climatology, stacking against a search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.operators import boosting
from agrolith.operators.boosting import Booster, Formulation


def plain(x, y, loss, param, edges, trees, depth, rate, l2, least):
    """One row at a time: the same trees grown by recursion."""
    bins = [[0 if math.isnan(v) else 1 + sum(e < v for e in edges[f]) for f, v in enumerate(row)] for row in x]
    median = sorted(y)[max(0, math.ceil((param if loss == "quantile" else 0.5) * len(y)) - 1)]
    base = math.log(np.mean(y)) if loss == "tweedie" else median if loss in ("quantile", "huber") else float(np.mean(y))
    f = [base] * len(y)

    def slope(i):
        d = f[i] - y[i]
        if loss == "squared":
            return d, 1.0
        if loss == "huber":
            return max(-param, min(param, d)), 1.0
        if loss == "quantile":
            return (-param if y[i] > f[i] else 1 - param), 1.0
        a, b = math.exp((1 - param) * f[i]), math.exp((2 - param) * f[i])
        return b - y[i] * a, (2 - param) * b - (1 - param) * y[i] * a

    for _ in range(trees):
        g = [slope(i) for i in range(len(y))]
        total = lambda rows: (sum(g[i][0] for i in rows), sum(g[i][1] for i in rows))
        score = lambda rows: total(rows)[0] ** 2 / (total(rows)[1] + l2 + 1e-12)
        step = [0.0] * len(y)

        def grow(rows, level):
            best = (0.0, None)
            if level < depth:
                for k in range(len(edges)):
                    for b in range(1, max(map(len, edges)) + 2):
                        for missing in (True, False):
                            left = [i for i in rows if (missing if bins[i][k] == 0 else bins[i][k] <= b)]
                            if least <= len(left) <= len(rows) - least:
                                right = [i for i in rows if i not in set(left)]
                                gain = round((score(left) + score(right) - score(rows)) / max(score(rows), 1e-12), 9)
                                if gain > best[0]:
                                    best = (gain, (left, right))
            if best[1]:
                grow(best[1][0], level + 1)
                grow(best[1][1], level + 1)
            else:
                s = total(rows)
                for i in rows:
                    step[i] = -rate * s[0] / (s[1] + l2 + 1e-12)

        grow(list(range(len(y))), 0)
        f = [a + b for a, b in zip(f, step)]
    return np.exp(f) if loss == "tweedie" else np.array(f)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(500, 3)), 3)
    x[rng.random((500, 3)) < 0.1] = np.nan
    y = np.round(np.abs(np.nan_to_num(x[:, 0], nan=2.0) * 3 + np.where(x[:, 1] > 0.3, 4, 0) + rng.normal(size=500)), 4)
    rows = [(i, *[None if math.isnan(v) and i % 2 else float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(rows, "id int, a double, b double, c double, y double")


LOSSES = {"mean": ("squared", 0.0), "robust": ("huber", 1.5), "amount": ("tweedie", 1.5), "count": ("tweedie", 1.0), "upper": ("quantile", 0.9)}


def test_all_losses_equal_a_plain_version(table, monkeypatch):
    x, y, df = table
    monkeypatch.setattr(boosting, "FOLDED", 2)  # the sums are written in between
    settings = dict(trees=3, depth=2, rate=0.3, l2=1.0, least=15)
    got = boosting.fit(df.repartition(3), ["a", "b", "c"], {n: Formulation(F.col("y"), *k) for n, k in LOSSES.items()}, bins=6, **settings)
    told = {r.id: r for r in boosting.predict(df, {n: Booster.from_json(b.to_json()) for n, b in got.items()}).collect()}
    for name, (loss, param) in LOSSES.items():
        want = plain(x, y, loss, param, got[name].edges, **settings)
        assert np.allclose([told[i][name] for i in range(500)], want, rtol=1e-9, atol=1e-9), name


def test_nothing_stays_cached_and_odd_tables_do_not_fail(spark, table):
    x, y, df = table
    none = boosting.fit(df.limit(0), ["a", "b"], {"m": Formulation(F.col("y"))}, trees=2, depth=2)
    assert [r.m for r in boosting.predict(df.limit(2), none).collect()] == [0.0, 0.0]
    same = boosting.fit(df.withColumn("a", F.lit(None).cast("double")), ["a"], {"m": Formulation(F.lit(3.0)), "none": Formulation(F.col("y"), rows=F.lit(False))}, trees=2, depth=1)
    assert {(r.m, r.none) for r in boosting.predict(df.limit(9), same).collect()} == {(3.0, 0.0)}
    assert not spark.sparkContext._jsc.getPersistentRDDs()
    with pytest.raises(ValueError):
        boosting.fit(df, ["a"], {"m": Formulation(F.col("y"), "absolute")})


def test_stacking_weights_and_folds(spark, table):
    x, y, df = table
    rng = np.random.default_rng(1)
    p = np.stack([y + rng.normal(size=500), y * 0.5 + rng.normal(size=500), -y + rng.normal(size=500), rng.normal(size=500)], axis=1)
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(p, y)] + [(None, 1.0, 1.0, 1.0, 1.0), (float("nan"), 1.0, 1.0, 1.0, 1.0)], "p double, q double, r double, s double, y double")
    got = np.array(list(boosting.stack_weights(rows, ["p", "q", "r", "s"], "y").values()))
    w = np.full(4, 0.1)
    for _ in range(60_000):  # projected descent
        w = np.maximum(0, w - 1e-5 * (p.T @ (p @ w - y)))
    assert np.allclose(got, w, atol=1e-6) and (got >= 0).all() and got[2] == 0
    folds = boosting.out_of_fold(df, ["a", "b"], {"m": Formulation(F.col("y"))}, F.col("id") % 3, 3, trees=2, depth=2, bins=8).collect()
    for k in range(3):
        alone = boosting.fit(df, ["a", "b"], {"m": Formulation(F.col("y"), rows=F.col("id") % 3 != k)}, trees=2, depth=2, bins=8)
        want = {r.id: r.m for r in boosting.predict(df.where(F.col("id") % 3 == k), alone).collect()}
        assert {r.id: r.m for r in folds if r.id % 3 == k} == pytest.approx(want)
