"""Learners beat climatology on held-out months; built tables follow their inputs; a store of models survives broken runs."""

import os
import time

import pytest
from pyspark.sql import functions as F

from agrolith.operators import boosting
from agrolith.operators.boosting import Formulation
from agrolith.operators.model_store import ModelStore
from agrolith.plans import learning, registry
from agrolith.sources import files

SF = "/root/testdata/sf0.01"


def test_boosted_trees_beat_climatology_on_held_out_months(spark):
    got = {r.model: r.skill for r in registry.QUERIES["d17_boosted"](spark, SF).collect()}
    assert got.pop("climatology") == 0 and set(got) == {"raw", "huber", "tweedie", "logratio", "median"}
    assert all(v > 0 for v in got.values())


def test_plain_learners_are_about_as_good_as_the_mean_or_better(spark):
    rows = registry.QUERIES["d17_learners"](spark, SF).collect()
    m = learning.monthly(spark, SF).where("rain_mm > 0")
    last = m.agg(F.max("month")).first()[0]
    train, test = (m.where(F.col("month") < F.add_months(F.lit(last), -18)), m.where(F.col("month") >= F.add_months(F.lit(last), -18)))
    mean = train.agg(F.avg("rain_mm")).first()[0]
    base = test.agg(F.sqrt(F.avg(F.pow(F.col("rain_mm") - mean, 2.0)))).first()[0]
    assert {r.model for r in rows} == {"gbt", "forest", "huber", "tweedie"} and {r.n for r in rows} == {test.count()}
    assert all(r.rmse < 1.1 * base for r in rows)
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_stack_beats_climatology_and_learns_from_other_folds_alone(spark):
    rows = registry.QUERIES["d17_stack"](spark, SF).collect()
    assert all(r.weight >= 0 for r in rows) and rows[0].blend_rmse < rows[0].climatology_rmse


def test_no_feature_lies_ahead(spark):
    s = learning.sample_table(spark, "/root/testdata/sf0.001")
    features = learning.S.features_of(s)
    assert "ant_rain_3" in features and "mjo_amp" in features and not [c for c in features if c.startswith(("fwd", "dep"))]


def test_built_table_follows_its_inputs(spark, tmp_path):
    a, b, folder = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "kept")
    spark.range(3).write.parquet(a)
    builds = []

    def build():
        builds.append(1)
        return spark.read.parquet(a).withColumn("n", F.lit(len(builds)))

    read = lambda *more: {r.n for r in files.cached(spark, folder, [a, b], build, *more).collect()}
    assert read() == {1} and read() == {1}
    spark.range(2).write.parquet(b)  # an input that was absent
    assert read() == {2} and read() == {2}
    part = next(f for f in os.listdir(b) if f.startswith("part"))
    os.utime(f"{b}/{part}", (time.time() + 99, time.time() + 99))
    assert read() == {3} and read() == {3}
    assert read("other parameters") == {4}
    assert len(files.children(spark, folder)) == 1  # stale ones went

    def broken():
        raise RuntimeError

    with pytest.raises(RuntimeError):
        files.cached(spark, folder, [a], broken)
    assert read("other parameters") == {4}


def test_store_goes_on_after_a_broken_run(spark, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df = spark.createDataFrame([(float(i), float(2 * i)) for i in range(60)], "x double, y double")
    store = ModelStore(spark, str(tmp_path / "models"))
    trained = []

    def tree():
        trained.append("tree")
        return boosting.fit(df, ["x"], {"m": Formulation(F.col("y"))}, trees=2, depth=1)["m"], {"rmse": 1.5}

    def linear():
        trained.append("linear")
        return PipelineModel([VectorAssembler(inputCols=["x"], outputCol="v"), LinearRegression(featuresCol="v", labelCol="y").fit(VectorAssembler(inputCols=["x"], outputCol="v").transform(df))]), {}

    def killed():
        raise KeyboardInterrupt

    assert store.catalogue() == {}
    with pytest.raises(KeyboardInterrupt):
        store.train([("tree/raw", tree), ("linear", killed)], "f1")
    again = ModelStore(spark, store.root)
    assert set(again.catalogue()) == {"tree/raw"} and again.catalogue()["tree/raw"]["rmse"] == 1.5
    assert again.train([("tree/raw", tree), ("linear", linear)], "f1") == {"tree/raw": "kept", "linear": "trained"} and trained == ["tree", "linear"]
    told = boosting.predict(df, {"m": again.load("tree/raw")}).agg(F.avg("m")).first()[0]
    assert told == pytest.approx(59.0, abs=0.1) and again.load("linear").transform(df).where("abs(prediction - y) > 1e-6").count() == 0
    before = again.catalogue()["tree/raw"]["path"]
    assert again.train([("tree/raw", tree)], "f2") == {"tree/raw": "trained"}
    assert files.exists(spark, before)  # who read the older catalogue finds its model
    again.sweep()
    assert not files.exists(spark, before) and set(again.catalogue()) == {"tree/raw", "linear"} and again.load("tree/raw").features == ["x"]
