"""Monthly panels and climatological normals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def monthly_panel(daily: DataFrame) -> DataFrame:
    """Extensive variables are summed, intensive ones averaged; a month without values is NULL."""
    return daily.groupBy("district_id", F.trunc("date", "MM").alias("month")).agg(F.sum("rain_mm").alias("rain_mm"), F.avg("tmax_c").alias("tmax_c"), F.avg("tmin_c").alias("tmin_c"), F.count("rain_mm").alias("days"))


def with_normal(panel: DataFrame, columns: list[str], years: tuple[int, int]) -> DataFrame:
    """Adds ``<column>_normal``: the mean by district and calendar month over ``years``."""
    m = F.month("month")
    base = panel.where(F.year("month").between(*years)).groupBy("district_id", m.alias("__m")).agg(*[F.avg(c).alias(f"{c}_normal") for c in columns])
    return panel.withColumn("__m", m).join(base, ["district_id", "__m"], "left").drop("__m")


def day_matched(daily: DataFrame, x: str, years: tuple[int, int]) -> DataFrame:
    """Monthly sums with the normal of just the days observed: district_id, year, month, x, normal."""
    by_day = daily.where(F.year("date").between(*years)).groupBy("district_id", F.month("date").alias("month"), F.dayofmonth("date").alias("day")).agg(F.avg(x).alias("n"))
    keyed = daily.select("district_id", F.year("date").alias("year"), F.month("date").alias("month"), F.dayofmonth("date").alias("day"), x)
    return keyed.join(by_day, ["district_id", "month", "day"], "left").groupBy("district_id", "year", "month").agg(F.sum(x).alias(x), F.sum(F.when(F.col(x).isNotNull(), F.col("n"))).alias("normal"))


def doy_normal(daily: DataFrame, x: str, years: tuple[int, int], half: int) -> DataFrame:
    """Day-of-year means, then the mean of the 2 half + 1 means around each day; 366 goes on with 1."""
    means = daily.where(F.year("date").between(*years)).groupBy("district_id", F.dayofyear("date").alias("doy")).agg(F.avg(x).alias("n"))
    around = means.select("district_id", F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda k: F.pmod(F.col("doy") - 1 + k, F.lit(366)) + 1)).alias("doy"), "n")
    return around.groupBy("district_id", "doy").agg(F.avg("n").alias("normal")).join(means.select("district_id", "doy"), ["district_id", "doy"], "left_semi")


def collapse_duplicates(df: DataFrame, keys: list[str], x: str, groups: list[str | Column], name: str) -> DataFrame:
    """Mean of rows that share their keys, then the sum by ``groups``."""
    one = df.groupBy(*keys).agg(F.avg(x).alias("__x"))
    return one.groupBy(*groups).agg(F.round(F.sum("__x"), 4).alias(name))
