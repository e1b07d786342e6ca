"""Checks of layers against their definitions and against published figures, as rows: test, got, expected, tolerance, passed."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import sum_at_least, weighted_mean

COLUMNS = ["test", "got", "expected", "tolerance", "passed"]


def row(test: Column | str, got: Column, expected: Column | float, tolerance: Column | float, passed: Column | None = None) -> Column:
    """A missing figure doesn't pass."""
    one = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    ok = passed if passed is not None else F.abs(one(got) - one(expected)) <= one(tolerance)
    name = test if isinstance(test, Column) else F.lit(test)
    return F.struct(name.alias("test"), one(got).alias("got"), one(expected).alias("expected"), one(tolerance).alias("tolerance"), F.coalesce(ok, F.lit(False)).alias("passed"))


def _rows(df: DataFrame, *rows: Column) -> DataFrame:
    return df.select(F.explode(F.array(*rows)).alias("r")).select(*[f"r.{c}" for c in COLUMNS])


def area_mean(units: DataFrame, keys: list[str], value: str, area: str = "area") -> DataFrame:
    """National figures as area-weighted means of units: keys, v."""
    return units.groupBy(*keys).agg(weighted_mean(F.col(value), F.col(area)).alias("v"))


def season_totals(daily: DataFrame, registry: DataFrame, months: list[int], least: int) -> DataFrame:
    """year, v: area-weighted national totals of a season; a unit's total needs ``least`` days."""
    units = daily.where(F.month("date").isin(*months)).groupBy("district_id", F.year("date").alias("year")).agg(sum_at_least(F.col("rain_mm"), least).alias("t"))
    return area_mean(units.join(registry.select("district_id", "area"), "district_id"), ["year"], "t")


def against_published(ours: DataFrame, published: DataFrame, years: tuple[int, int], name: str, mean: float, mean_tolerance: float, tolerance: float = 6.0, spread: float = 5.0, agreement: float = 0.15) -> DataFrame:
    """A national series (year, v) against published percentages of the mean (year, percent): the mean itself, each year, the mean absolute
    difference, and the correlation."""
    base = ours.where(F.col("year").between(*years)).agg(F.avg("v").alias("base"))
    both = published.join(ours, "year").crossJoin(F.broadcast(base)).withColumn("own", 100 * F.try_divide(F.col("v"), F.col("base"))).where("own is not null")
    each = both.select(row(F.concat(F.lit(f"{name} "), F.col("year").cast("string")), F.col("own"), F.col("percent"), tolerance).alias("r")).select(*[f"r.{c}" for c in COLUMNS])
    d = F.abs(F.col("own") - F.col("percent"))
    r = F.try_divide(F.covar_samp("own", "percent"), F.stddev_samp("own") * F.stddev_samp("percent"))
    whole = both.agg(F.avg(d).alias("mad"), r.alias("r"))
    return _rows(base, row(f"{name}: mean", F.col("base"), mean, mean_tolerance)).union(each).union(_rows(whole, row(f"{name}: mean difference", F.col("mad"), 0.0, spread), row(f"{name}: correlation", F.col("r"), 1.0, agreement)))


def monthly_normals(daily: DataFrame, registry: DataFrame, published: DataFrame, years: tuple[int, int], name: str = "monthly mean", floor: float = 3.0, share: float = 0.08) -> DataFrame:
    """National normals by calendar month against published ones (month, mm), within the greater of ``floor`` and ``share``."""
    units = daily.groupBy("district_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(sum_at_least(F.col("rain_mm"), 1).alias("t"))
    national = area_mean(units.join(registry.select("district_id", "area"), "district_id"), ["year", "month"], "t")
    ours = national.where(F.col("year").between(*years)).groupBy("month").agg(F.avg("v").alias("own"))
    both = published.join(ours, "month", "left")
    return both.select(row(F.concat(F.lit(f"{name} "), F.lpad(F.col("month").cast("string"), 2, "0")), F.col("own"), F.col("mm"), F.greatest(F.lit(floor), share * F.col("mm"))).alias("r")).select(*[f"r.{c}" for c in COLUMNS])


def part_month(daily: DataFrame, panel: DataFrame, registry: DataFrame, years: tuple[int, int], tolerance: float = 1.0) -> DataFrame:
    """The panel's departure of the newest month with rain, against one computed from the days: actual over the mean of the same days of each of ``years``.

    panel: district_id, month, rain_mm, rain_normal. A panel that compares a part of a month with a whole month's normal fails here.
    """
    seen = daily.where(F.col("rain_mm").isNotNull())
    last = seen.agg(F.max("date").alias("last"))
    part = seen.crossJoin(F.broadcast(last)).where((F.month("date") == F.month("last")) & (F.dayofmonth("date") <= F.dayofmonth("last")))
    days = part.groupBy("district_id", F.month("date").alias("m"), F.dayofmonth("date").alias("day")).agg(F.avg(F.when(F.year("date").between(*years), F.col("rain_mm"))).alias("n"))
    now = part.where(F.year("date") == F.year("last")).withColumns({"m": F.month("date"), "day": F.dayofmonth("date")}).join(days, ["district_id", "m", "day"], "left")
    units = now.groupBy("district_id").agg(F.sum("rain_mm").alias("a"), F.sum("n").alias("n")).join(registry.select("district_id", "area"), "district_id")
    whole = lambda a, n: 100 * F.try_divide(F.sum(F.when(F.col(a).isNotNull() & F.col(n).isNotNull(), (F.col(a) - F.col(n)) * F.col("area"))), F.sum(F.when(F.col(a).isNotNull() & F.col(n).isNotNull(), F.col(n) * F.col("area"))))
    direct = units.agg(whole("a", "n").alias("direct"))
    shown = panel.join(F.broadcast(last.select(F.trunc("last", "MM").alias("month"))), "month").select("district_id", "rain_mm", "rain_normal").join(registry.select("district_id", "area"), "district_id").agg(whole("rain_mm", "rain_normal").alias("shown"))
    return _rows(direct.crossJoin(F.broadcast(shown)), row("part of a month against the same days", F.col("shown"), F.col("direct"), tolerance))


def baseline_shift(monthly: DataFrame, columns: list[str], months: list[int], one: tuple[int, int], other: tuple[int, int], tolerance: float = 0.6) -> DataFrame:
    """How far unit normals by calendar month move between two baselines, at most: one row a column."""
    x = monthly.where(F.month("month").isin(*months))
    mean = lambda c, y: F.avg(F.when(F.year("month").between(*y), F.col(c)))
    per = x.groupBy("district_id", F.month("month").alias("m")).agg(*[(mean(c, one) - mean(c, other)).alias(c) for c in columns])
    most = per.agg(*[F.max(F.abs(c)).alias(c) for c in columns])
    return _rows(most, *[row(f"{c}: shift of the baseline", F.col(c), 0.0, tolerance) for c in columns])


def standardised(features: DataFrame, columns: list[str], tolerance: float = 0.20) -> DataFrame:
    """A standardised index has mean 0 and deviation 1."""
    one = features.agg(*[F.avg(c).alias(f"{c}_m") for c in columns], *[F.stddev_samp(c).alias(f"{c}_s") for c in columns])
    return _rows(one, *[r for c in columns for r in (row(f"{c}: mean", F.col(f"{c}_m"), 0.0, tolerance), row(f"{c}: deviation", F.col(f"{c}_s"), 1.0, tolerance))])


def bounded(features: DataFrame, bounds: Mapping[str, tuple[float | None, float | None]], slack: float = 0.001) -> DataFrame:
    """Lowest and highest values of columns that a clip or their nature bounds; a missing bound isn't checked."""
    one = features.agg(*[f(c).alias(f"{c}_{n}") for c in bounds for n, f in (("lo", F.min), ("hi", F.max))])
    rows = []
    for c, (lo, hi) in bounds.items():
        if lo is not None:
            rows.append(row(f"{c}: lowest", F.col(f"{c}_lo"), lo, slack, F.col(f"{c}_lo") >= lo - slack))
        if hi is not None:
            rows.append(row(f"{c}: highest", F.col(f"{c}_hi"), hi, slack, F.col(f"{c}_hi") <= hi + slack))
    return _rows(one, *rows)


def seasonal(features: DataFrame, column: str, high: list[int], low: list[int]) -> DataFrame:
    """The mean of one season's months is above that of another's."""
    m = F.month("month")
    one = features.agg(F.avg(F.when(m.isin(*high), F.col(column))).alias("a"), F.avg(F.when(m.isin(*low), F.col(column))).alias("b"))
    return _rows(one, row(f"{column}: high season above low", F.col("a"), F.col("b"), 0.0, F.col("a") > F.col("b")))


def peak(features: DataFrame, column: str, months: list[int]) -> DataFrame:
    """The calendar month of the greatest mean, ties by the earlier, is one of ``months``."""
    means = features.groupBy(F.month("month").alias("m")).agg(F.round(F.avg(column), 9).alias("v")).where("v is not null")
    one = means.agg(F.max_by("m", F.struct("v", -F.col("m"))).alias("m"))
    return _rows(one, row(f"{column}: month of its peak", F.col("m"), float(sorted(months)[len(months) // 2]), float(len(months) // 2), F.col("m").isin(*months)))


def centred(features: DataFrame, columns: list[str], years: tuple[int, int], tolerance: float = 0.05) -> DataFrame:
    """An anomaly has mean zero over its own baseline."""
    base = features.where(F.year("month").between(*years)).agg(*[F.avg(c).alias(c) for c in columns])
    return _rows(base, *[row(f"{c}: mean over its baseline", F.col(c), 0.0, tolerance) for c in columns])


def recomputed(features: DataFrame, actual: str, normal: str, departure: str, floor: float = 5.0, tolerance: float = 1e-3) -> DataFrame:
    """A departure is what its own inputs give."""
    d = F.abs(100 * (F.col(actual) - F.col(normal)) / F.col(normal) - F.col(departure))
    worst = features.where(F.col(normal) >= floor).agg(F.max(d).alias("worst"))
    return _rows(worst, row(f"{departure}: recomputed", F.col("worst"), 0.0, tolerance))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


# ---------------------------------------------------------------- products


def product_files(days: DataFrame, file: Column, keys: list[str], date: str, value: str, units: int) -> DataFrame:
    """One row a file of a product with a row for each day and unit: rows and how many there should be, repeated keys, days missing between its first
    and last, blank and zero values, and whether it is complete."""
    x = days.select(file.alias("file"), *keys, F.col(date).alias("__d"), F.col(value).alias("__v"))
    one = x.groupBy("file", *keys, "__d").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("__v").isNull()).alias("blank"), F.count_if(F.col("__v") == 0).alias("zero"))
    g = one.groupBy("file").agg(F.sum("n").alias("rows"), (F.countDistinct("__d") * units).alias("expected"), F.sum(F.col("n") - 1).alias("repeated"), (F.datediff(F.max("__d"), F.min("__d")) + 1 - F.countDistinct("__d")).alias("gaps"), F.sum("blank").alias("blank"), F.sum("zero").alias("zero"))
    return g.withColumn("complete", (F.col("rows") == F.col("expected")) & (F.col("repeated") == 0) & (F.col("gaps") == 0))


def blanks_by_month(days: DataFrame, date: str, value: str, departure: str) -> DataFrame:
    """By calendar month: rows, the share without a departure (its normal is below the floor), and that of exact zeros, in percent."""
    x = days.groupBy(F.month(date).alias("month"))
    share = lambda c: 100 * F.count_if(c) / F.count(F.lit(1))
    return x.agg(F.count(F.lit(1)).alias("rows"), share(F.col(departure).isNull()).alias("blank_percent"), share(F.coalesce(F.col(value) == 0, F.lit(False))).alias("zero_percent"))


def dead_and_thin(days: DataFrame, registry: DataFrame, unit: str, value: str, coverage: str, thin: float = 0.5) -> DataFrame:
    """Units that never have a value (dead), and those whose values come from less than ``thin`` of their area on average: unit, kind, coverage."""
    g = registry.select(unit).join(days.groupBy(unit).agg(F.count(value).alias("__n"), F.avg(coverage).alias("coverage")), unit, "left")
    kind = F.when(F.coalesce("__n", F.lit(0)) == 0, "dead").when((F.col("coverage") > 0) & (F.col("coverage") < thin), "thin")
    return g.select(unit, kind.alias("kind"), "coverage").where("kind is not null")


def column_stage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of the columns that a display needs: the share of rows that have a value, and a verdict: missing, empty, partial or full."""
    have = [c for c in columns if c in df.columns]
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"__{i}") for i, c in enumerate(have)])
    rows = [F.struct(F.lit(c).alias("column"), F.try_divide(F.col(f"__{have.index(c)}").cast("double"), F.col("__n")).alias("share") if c in have else F.lit(None).cast("double").alias("share"), F.lit(c in have).alias("there")) for c in columns]
    verdict = F.when(~F.col("there"), "missing").when(F.coalesce("share", F.lit(0.0)) == 0, "empty").when(F.col("share") < 1, "partial").otherwise("full")
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*").select("column", "share", verdict.alias("verdict"))


def month_slots(layers: DataFrame, months: DataFrame) -> DataFrame:
    """Of each layer on a slider of ``months``: how many slots it fills, holes between its first and last, and slots before it starts. A layer without a value is EMPTY."""
    slots = months.select("month").distinct().withColumn("slot", F.row_number().over(Window.orderBy("month")))  # the slider's months
    held = layers.where("v is not null").select("layer", "month").distinct().join(F.broadcast(slots), "month")
    g = held.groupBy("layer").agg(F.count(F.lit(1)).alias("months"), F.min("slot").alias("__a"), F.max("slot").alias("__b"))
    all_of = layers.select("layer").distinct().join(g, "layer", "left")
    holes = F.col("__b") - F.col("__a") + 1 - F.col("months")
    verdict = F.when(F.col("months").isNull(), "EMPTY").when(holes > 0, "HOLE").when(F.col("__a") > 1, "starts late").otherwise("ok")
    return all_of.select("layer", F.coalesce("months", F.lit(0)).alias("months"), F.coalesce(holes, F.lit(0)).cast("long").alias("holes"), F.coalesce(F.col("__a") - 1, F.lit(0)).cast("long").alias("late"), verdict.alias("verdict"))
