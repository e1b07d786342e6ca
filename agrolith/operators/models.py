"""Choosing among models, and even samples to train them on."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import categories, clip


def best(predictions: DataFrame, model: str, predicted: str, observed: str, k: int) -> DataFrame:
    """The ``k`` models with the least mean squared error, ties by name: (model, mse, rank). There are few models."""
    error = F.round(F.avg(F.pow(F.col(predicted) - F.col(observed), 2)), 9)
    scores = predictions.groupBy(model).agg(error.alias("mse"))
    return scores.orderBy("mse", model).limit(k).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("mse", model)))


def even_sample(rows: DataFrame, key: str, most: int, seed: int) -> DataFrame:
    """``most`` rows at most, by the hash of seed and key: the same ones in each run, however the table is partitioned."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary")), key).limit(most)


def served(prediction: Column, slope: Column, observed_days: Column, normal: Column, floor: float = 0.0) -> Column:
    """A forecast as shown: shrunk by half the district's calibration slope, within [-100, 1000] percent; missing where the last
    30 days have no observation or the normal isn't above ``floor``."""
    value = clip(prediction * clip(F.lit(0.5) + F.lit(0.5) * slope, 0.3, 2), -100, 1000)
    return F.when((observed_days > 0) & (normal > floor), value)


def fingerprint(columns: list[str]) -> str:
    """Of a model's feature list: another list, or another order, is another model."""
    return hashlib.md5("\n".join(columns).encode()).hexdigest()


def to_train(wanted: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Those of ``wanted`` (learner, target, fingerprint) that the catalogue has no model of: a run that broke off goes on there."""
    return wanted.join(catalogue.select("learner", "target", "fingerprint").distinct(), ["learner", "target", "fingerprint"], "left_anti")


def scores(rows: DataFrame, by: str, predicted: Column, observed: Column, edges: list[float]) -> DataFrame:
    """Per model: rmse, skill against zero, correlation, mean absolute error, and how often both fall into the same category.
    Predictions are bounded to [-100, 1000] percent first; a constant has no correlation."""
    x = rows.select(by, clip(predicted, -100, 1000).alias("__f"), observed.alias("__y"))
    f, y = F.col("__f"), F.col("__y")
    mse = F.avg((f - y) * (f - y))
    same = (categories(f, edges) == categories(y, edges)).cast("int")
    return x.groupBy(by).agg(F.sqrt(mse).alias("rmse"), (1 - F.try_divide(mse, F.avg(y * y))).alias("skill"), F.try_divide(F.covar_samp(f, y), F.stddev_samp(f) * F.stddev_samp(y)).alias("r"), F.avg(F.abs(f - y)).alias("mae"), F.avg(same).alias("accuracy"))


def calibration_slope(observed: Column, predicted: Column, least: int = 20, spread: float = 0.0) -> Column:
    """Slope of the observations on the predictions within [-2, 4]; 1 for a group of ``least`` rows or fewer, or of no spread."""
    enough = (F.count(F.lit(1)) > least) & (F.stddev_samp(predicted) > spread)
    return F.when(enough, clip(F.regr_slope(observed, predicted), -2, 4)).otherwise(1.0)


def inflated(predicted: str, keys: list[str], factor: float) -> Column:
    """Predictions spread about their group's mean by ``factor``."""
    mean = F.avg(predicted).over(Window.partitionBy(*keys))
    return mean + factor * (F.col(predicted) - mean)


def quantile_mapped(rows: DataFrame, keys: list[str], predicted: str, observed: str, tie: str, name: str) -> DataFrame:
    """Adds ``name``: for the prediction of a rank within its group, the observation of that rank."""
    g = Window.partitionBy(*keys)
    ranked = rows.withColumn("__i", F.row_number().over(g.orderBy(predicted, tie)))
    to = rows.select(*keys, F.row_number().over(g.orderBy(observed, tie)).alias("__i"), F.col(observed).alias(name))
    return ranked.join(to, [*keys, "__i"]).drop("__i")


def log_ratio(amount: Column, normal: Column) -> Column:
    return F.ln((amount + 1.0) / (normal + 1.0))


def amount_of_log_ratio(ratio: Column, normal: Column) -> Column:
    return F.exp(ratio) * (normal + 1.0) - 1.0


def departure_of_amount(amount: Column, normal: Column) -> Column:
    return F.try_divide(F.lit(100.0) * (amount - normal), normal)
