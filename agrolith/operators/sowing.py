"""Sown area beyond a single counter: allocation to districts, and the national comparison with last year."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocated(totals: DataFrame, registry: DataFrame, value: str) -> DataFrame:
    """A state's total in equal parts to its districts: (district_id, ..., value)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("state"))
    parts = registry.select("district_id", "state", n.alias("__n"))
    return totals.join(parts, "state").withColumn(value, F.col(value) / F.col("__n")).drop("__n")


def national_year_on_year(rows: DataFrame, unit: str, year: str, value: str, thin: float = 50.0, most: float = 200.0) -> DataFrame:
    """Per year: this year's and last year's totals of just the units reported in both, the basis (their share of all of last
    year's, in percent), and the change in percent, which is withheld on a basis under ``thin`` or beyond ``most``."""
    last = rows.select(unit, (F.col(year) + 1).alias(year), F.col(value).alias("__ly"))
    both = rows.join(last, [unit, year], "full")
    paired = F.col(value).isNotNull() & F.col("__ly").isNotNull()
    sums = both.groupBy(year).agg(F.sum(F.when(paired, F.col(value))).alias("now"), F.sum(F.when(paired, F.col("__ly"))).alias("before"), F.sum("__ly").alias("__all"), F.count(value).alias("units"))
    basis, change = F.try_divide(100 * F.col("before"), F.col("__all")), F.try_divide(100 * (F.col("now") - F.col("before")), F.col("before"))
    return sums.where("units > 0").select(year, "now", "before", basis.alias("basis"), F.when((basis >= thin) & (F.abs(change) <= most), change).alias("change"))


#: Labels of rows that sum up others in a national report.
AGGREGATES = ("total", "grand total", "all crops", "cereals", "coarse cereals", "pulses", "oilseeds", "foodgrains", "kharif total", "rabi total")


def national_report(rows: DataFrame, label: str, year: str, value: str, now: int, normal: tuple[int, int], aggregates: tuple[str, ...] = AGGREGATES) -> DataFrame:
    """Per label: change on the year before and percent of the normal, recomputed from the yearly sums, and whether the row
    sums up others, so that it isn't added to them."""
    s = lambda c: F.sum(F.when(c, F.col(value)))
    y = F.col(year)
    change = F.try_divide(s(y == now), s(y == now - 1)) * 100 - 100
    share = F.try_divide(F.lit(100.0) * s(y == now), s(y.between(*normal)) / (normal[1] - normal[0] + 1))
    return rows.groupBy(label).agg(change.alias("pct_change"), share.alias("pct_of_normal")).withColumn("is_aggregate", F.lower(F.trim(label)).isin(*aggregates).cast("int"))
