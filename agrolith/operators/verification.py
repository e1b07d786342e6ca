"""Forecasts against what was observed: by slices, against persistence and climatology, by deciles; and which forecast is shown."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import categories, clip
from agrolith.operators.models import amount_of_log_ratio
from agrolith.operators.quantiles import exact_quantiles

BOUNDS = (-100.0, 1000.0)
EDGES = [-60.0, -20.0, 20.0, 60.0]


def by_slice(rows: DataFrame, predicted: Column, observed: Column, persistence: Column, slices: Mapping[str, Column], top: Mapping[str, tuple[Column, int]] | None = None, least: int = 500, edges: list[float] | None = None) -> DataFrame:
    """One row a slice of at least ``least`` rows: slice, n, rmse, skill against climatology (always 0), against persistence, correlation, mean error, share in the
    same category.

    slices: conditions by name; a row may be in several. top: by prefix, a column and how many of its most frequent values are slices of their own, ties
    by value. Missing predictions and persistence count as 0, both are held within [-100, 1000]; rows without an observation don't count.
    Each row meets its slices before one aggregate, so that a slice's size doesn't matter.
    """
    held = lambda c: clip(F.coalesce(F.when(~F.isnan(c.cast("double")), c.cast("double")), F.lit(0.0)), *BOUNDS)
    x = rows.select(held(predicted).alias("__p"), observed.cast("double").alias("__y"), held(persistence).alias("__b"), F.array_compact(F.array(F.lit("all"), *[F.when(c, F.lit(n)) for n, c in slices.items()])).alias("__in"), *[c.cast("string").alias(f"__top{i}") for i, (c, _) in enumerate((top or {}).values())])
    x = x.where(F.col("__y").isNotNull() & ~F.isnan("__y"))
    for i, (prefix, (_, k)) in enumerate((top or {}).items()):
        counts = x.where(F.col(f"__top{i}").isNotNull()).groupBy(f"__top{i}").agg(F.count(F.lit(1)).alias("__n"))
        kept = counts.orderBy(F.desc("__n"), f"__top{i}").limit(k).select(F.col(f"__top{i}").alias("__value"))
        x = x.join(F.broadcast(kept), F.col(f"__top{i}") == F.col("__value"), "left").withColumn("__in", F.when(F.col("__value").isNotNull(), F.concat("__in", F.array(F.concat(F.lit(f"{prefix} "), "__value")))).otherwise(F.col("__in"))).drop("__value")
    p, y, b = (F.col(c) for c in ("__p", "__y", "__b"))
    mse = lambda f: F.avg((f - y) * (f - y))
    same = (categories(p, edges or EDGES) == categories(y, edges or EDGES)).cast("int")
    out = x.withColumn("slice", F.explode("__in")).groupBy("slice").agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(mse(p)).alias("rmse"), (1 - F.try_divide(mse(p), F.avg(y * y))).alias("skill"), (1 - F.try_divide(mse(p), mse(b))).alias("skill_vs_persistence"),
        F.try_divide(F.covar_samp(p, y), F.stddev_samp(p) * F.stddev_samp(y)).alias("r"), F.avg(F.abs(p - y)).alias("mae"), F.avg(same).alias("accuracy"),
    )
    return out.where(F.col("n") >= least)


def deciles(rows: DataFrame, predicted: Column, observed: Column, bins: int = 10, least: int = 100) -> DataFrame:
    """Reliability: rows dealt to bins by quantiles of the forecast, and per bin of ``least`` rows or more bin, n, mean forecast and mean observation.

    A forecast on an edge belongs to the bin above it. Rows without both values don't count.
    """
    x = rows.select(predicted.cast("double").alias("__p"), observed.cast("double").alias("__y")).where("__p is not null and __y is not null")
    edges = exact_quantiles(x, [], "__p", [i / bins for i in range(1, bins)])
    at = F.size(F.filter("q", lambda e: e <= F.col("__p"))) + 1
    dealt = x.crossJoin(F.broadcast(edges)).withColumn("bin", at)
    return dealt.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("__p").alias("mean_forecast"), F.avg("__y").alias("mean_observed")).where(F.col("n") >= least)


def departure_of(kind: str, raw: Column, normal: Column, floor: float = 5.0) -> Column:
    """A member's raw prediction as a departure in percent, by the name of the target that it learned."""
    base = F.greatest(normal, F.lit(floor))
    if kind in ("raw", "huber"):
        return raw
    if kind == "tweedie":
        return F.try_divide(F.lit(100.0) * (clip(raw, 0) - normal), base)
    if kind == "logratio":
        return F.try_divide(F.lit(100.0) * (amount_of_log_ratio(raw, normal) - normal), base)
    raise ValueError(f"no target {kind!r}")


def served_blend(members: Mapping[str, tuple[str, Column]], normal: Column, slope: Column, valid: Column, floor: float = 5.0) -> Column:
    """The forecast of one formulation or of a blend as it is shown.

    members: (target, raw prediction) by name; their departures are averaged, a missing one makes the blend missing. It is shrunk by half the district's
    calibration slope (1 where there is none), held within [-100, 1000], and withheld where no gauge observation is ``valid`` or there is no normal to divide by.
    """
    parts = [departure_of(kind, raw, normal, floor) for kind, raw in members.values()]
    mean = sum(parts[1:], parts[0]) / len(parts)
    half = clip(F.lit(0.5) + 0.5 * F.coalesce(slope, F.lit(1.0)), 0.3, 2.0)
    return F.when(valid & (normal > 0), clip(mean * half, *BOUNDS))


def selected(forecasts: DataFrame, catalogue: DataFrame, unit: list[str], wanted: str) -> DataFrame:
    """What a reader who picks a model sees: unit, model, value, skill, fallback.

    forecasts: unit, model, value; catalogue: model, skill, is_default, few rows. Units for which the ``wanted`` model has no value show the default
    model's, marked as fallback; units that neither has a value for show nothing.
    """
    rank = F.when(F.col("model") == wanted, 0).when(F.col("is_default"), 1)
    rows = forecasts.where(F.col("value").isNotNull()).join(F.broadcast(catalogue), "model").withColumn("__rank", rank).where("__rank is not null")
    best = rows.groupBy(*unit).agg(F.min_by(F.struct("model", "value", "skill", (F.col("__rank") == 1).alias("fallback")), F.struct("__rank", "model")).alias("s"))
    return best.select(*unit, "s.model", "s.value", "s.skill", (F.col("s.fallback") & (F.col("s.model") != wanted)).alias("fallback"))


def at_lead(members: DataFrame, unit: list[str], wanted: int) -> DataFrame:
    """Of an ensemble's leads (unit, lead, value), the one to show for a wanted lead: the longest that isn't longer, else the shortest there is: unit, lead, value."""
    known = members.where(F.col("value").isNotNull())
    near = F.when(F.col("lead") <= wanted, F.struct(F.lit(0).alias("a"), (-F.col("lead")).alias("b"))).otherwise(F.struct(F.lit(1).alias("a"), F.col("lead").alias("b")))
    return known.groupBy(*unit).agg(F.min_by(F.struct("lead", "value"), near).alias("s")).select(*unit, "s.*")


def pace(rows: DataFrame, unit: str, year: str, week: str, value: str, least: int = 4) -> DataFrame:
    """A season's cumulative area against the one before, by week: change on the same week of last year, share of last year's final, their difference in points, a label.

    Last year's final counts only if it had ``least`` reports.
    """
    last = rows.select(unit, (F.col(year) + 1).alias(year), week, F.col(value).alias("__ly"))
    final = rows.groupBy(unit, (F.col(year) + 1).alias(year)).agg(F.when(F.count(F.lit(1)) >= least, F.max(value)).alias("__final"))
    j = rows.join(last, [unit, year, week], "left").join(final, [unit, year], "left")
    v, ly, prev = F.col(value), F.col("__ly"), F.col("__final")
    points = F.try_divide(100 * (v - ly), prev)
    label = F.when(points >= 3, "Ahead").when(points <= -3, "Behind").when(points.isNull(), "no prior season").otherwise("On pace")
    return j.select(unit, year, week, F.try_divide(100 * (v - ly), ly).alias("yoy_pct"), F.try_divide(100 * v, prev).alias("coverage_pct"), points.alias("pace_pp"), label.alias("label"))


def live(rows: DataFrame, unit: list[str], date: str, days: int = 45) -> DataFrame:
    """The last report of each unit that is at most ``days`` days before the newest of all; what stopped earlier is a closed season, not news."""
    latest = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*unit).orderBy(F.desc(date)))).where("__n = 1").drop("__n")
    newest = rows.agg(F.max(date).alias("__newest"))
    return latest.crossJoin(F.broadcast(newest)).where(F.datediff("__newest", date) <= days).withColumn("days_behind", F.datediff("__newest", date)).drop("__newest")
