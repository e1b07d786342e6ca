"""The monthly master panel of districts, its features, and the month to date."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip, percent_departure, sum_at_least
from agrolith.operators import indices
from agrolith.operators import normals as N

KEYS = ["district_id", "month"]


def align(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows whose keys all frames have; the frames' other columns stand side by side."""
    return reduce(lambda a, b: a.join(b, keys), frames)


def reindex(df: DataFrame, axes: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` on the keys of another product: rows that it lacks are NULL, rows beyond these go."""
    return axes.select(*keys).distinct().join(df, keys, "left")


def refreshed(panel: DataFrame, features: DataFrame, keys: list[str]) -> DataFrame:
    """``panel`` with the columns of ``features``, which replace those of the same names: running it again changes nothing."""
    new = [c for c in features.columns if c not in keys]
    return panel.drop(*new).join(features, keys, "left")


def ending_with(df: DataFrame, *suffixes: str) -> list[str]:
    return [c for c in df.columns if c.endswith(suffixes)]


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """All floating-point columns rounded, others as they are."""
    return df.select(*[F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def monthly_evaporation(latitude: Column, month: Column, tmax: Column, tmin: Column) -> Column:
    """Hargreaves by the month's means and its middle day, times its days."""
    radiation = indices.extraterrestrial_radiation(latitude, F.dayofyear(F.date_add(month, 14)))
    return indices.hargreaves(radiation, tmax, tmin) * F.dayofmonth(F.last_day(month))


def moisture_adequacy(actual: Column, potential: Column) -> Column:
    return clip(F.try_divide(actual, F.when(potential > 0, potential)), 0, 1.5)


def master(daily: DataFrame, registry: DataFrame, index: DataFrame, years: tuple[int, int], latitude: Column) -> DataFrame:
    """One row a district and month: registry, rain with its day-matched normal and departure, temperatures with
    normals and anomalies, evaporation, moisture adequacy, and the ocean state of the month.

    daily: district_id, date, rain_mm, tmax_c, tmin_c on a dense calendar. index: year, month,
    idx, phase. A day's normal is the mean of that calendar day over ``years``; a month's is the sum over
    the days observed, so that a part of a month is compared with the same part. One pass over the days and one join with their normals.
    """
    day = [F.month("date").alias("__m"), F.dayofmonth("date").alias("__d")]
    normal = daily.where(F.year("date").between(*years)).groupBy("district_id", *day).agg(F.avg("rain_mm").alias("__n"))
    keyed = daily.select("*", *day).join(normal, ["district_id", "__m", "__d"], "left")
    rain = F.col("rain_mm")
    months = keyed.groupBy("district_id", F.trunc("date", "MM").alias("month")).agg(
        F.sum(rain).alias("rain_mm"), F.count(rain).alias("days"), F.sum(F.when(rain.isNotNull(), F.col("__n"))).alias("rain_normal"), F.avg("tmax_c").alias("tmax_c"), F.avg("tmin_c").alias("tmin_c")
    )
    temperatures = N.with_normal(months, ["tmax_c", "tmin_c"], years)
    pet = monthly_evaporation(latitude, F.col("month"), F.col("tmax_c"), F.col("tmin_c"))
    full = temperatures.join(registry, "district_id").withColumn("pet_mm", pet).withColumn("aet_mm", F.when(F.col("pet_mm").isNotNull() & rain.isNotNull(), F.least("pet_mm", rain * 0.8)))
    state = index.select(F.make_date("year", "month", F.lit(1)).alias("month"), "idx", "phase")
    return full.join(state, "month", "left").select(
        "district_id", "district", "state", "area", "month", "days", "rain_mm", "rain_normal", percent_departure(rain, F.col("rain_normal")).alias("rain_dep"),
        "tmax_c", "tmin_c", ((F.col("tmax_c") + F.col("tmin_c")) / 2).alias("tmean_c"), (F.col("tmax_c") - F.col("tmax_c_normal")).alias("tmax_anom"), (F.col("tmin_c") - F.col("tmin_c_normal")).alias("tmin_anom"),
        "pet_mm", "aet_mm", moisture_adequacy(F.col("aet_mm"), F.col("pet_mm")).alias("mai"), "idx", "phase",
    )


def features(panel: DataFrame, scales: list[int], least: int = 20, complete: int = 15, digits: int | None = None) -> DataFrame:
    """Adds the water balance and, for each scale, its sum over that many months standardised by district and calendar month.

    Months with fewer than ``complete`` days of rain have no balance, and a sum needs all its
    months. digits: sums are rounded to that many places, so that ties don't depend on the order of adding.
    """
    w = Window.partitionBy("district_id").orderBy("month")
    out = panel.withColumn("wb_mm", F.when(F.col("days") >= complete, F.col("rain_mm") - F.col("pet_mm"))).withColumn("__mm", F.month("month"))
    for s in scales:
        frame = w.rowsBetween(1 - s, 0)
        out = out.withColumn("__acc", F.when(F.count("wb_mm").over(frame) == s, F.sum("wb_mm").over(frame)))
        if digits is not None:
            out = out.withColumn("__acc", F.round("__acc", digits))
        out = indices.spei(out, "__acc", ["district_id", "__mm"], "month", f"spei_{s}", least).drop("__acc", f"spei_{s}_p")
    return out.drop("__mm")


def first_days(daily: DataFrame, x: Column, month: int, days: int, least: int = 1) -> DataFrame:
    """Sums over the first ``days`` of a month, by district and year."""
    part = daily.where((F.month("date") == month) & (F.dayofmonth("date") <= days))
    return part.groupBy("district_id", F.year("date").alias("year")).agg(sum_at_least(x, least).alias("v"))


def partial_spei(balance: DataFrame, month: int, days: int, scale: int, least: int = 20, complete: int = 15) -> DataFrame:
    """Month-to-date drought index: district_id, year, acc, spei.

    balance: district_id, date, wb. acc is the balance of the month's first ``days`` and of the scale - 1
    whole months before it, each year's standardised by the same window in all years. A
    missing part makes the sum NULL.
    """
    acc = first_days(balance, F.col("wb"), month, days)
    for k in range(1, scale):
        back, mm = divmod(month - k - 1, 12)
        whole = balance.where(F.month("date") == mm + 1).groupBy("district_id", (F.year("date") - back).alias("year")).agg(sum_at_least(F.col("wb"), complete).alias("more"))
        acc = acc.join(whole, ["district_id", "year"], "left").select("district_id", "year", (F.col("v") + F.col("more")).alias("v"))
    return indices.spei(acc.withColumnRenamed("v", "acc"), "acc", ["district_id"], "year", "spei", least).drop("spei_p")


def month_to_date(daily: DataFrame, month: int, days: int, years: tuple[int, int]) -> DataFrame:
    """Of a month's first days, by year: rain and its departure, mean maximum and its anomaly, degree-days above 10
    and 34 with their normals, all against the same days of ``years``."""
    part = daily.where((F.month("date") == month) & (F.dayofmonth("date") <= days))
    tx, tn = F.col("tmax_c"), F.col("tmin_c")
    now = part.groupBy("district_id", F.year("date").alias("year")).agg(
        F.sum("rain_mm").alias("rain"), F.avg(tx).alias("tmax"), F.sum(indices.degree_days(tx, tn, 10)).alias("gdd"), F.sum(clip(tx - 34, 0)).alias("sdd"), F.max(F.dayofmonth(F.last_day("date"))).alias("length")
    )
    normal = now.where(F.col("year").between(*years)).groupBy("district_id").agg(*[F.avg(c).alias(f"{c}_normal") for c in ("rain", "tmax", "gdd", "sdd")])
    both = now.join(normal, "district_id", "left")
    return both.select("district_id", "year", "rain", percent_departure(F.col("rain"), F.col("rain_normal")).alias("departure"), (F.col("tmax") - F.col("tmax_normal")).alias("tmax_anom"), "gdd", "gdd_normal", "sdd", "sdd_normal", (F.lit(days) < F.col("length")).cast("int").alias("is_month_to_date"))


def incomplete_tail(panel: DataFrame, days: Column, month: str = "month") -> DataFrame:
    """The months at the end of the table that lack days in all districts, up to the first whole one going back: month, days."""
    seen = panel.groupBy(month).agg(F.max(days).alias("days"))
    whole = seen.where(F.col("days") >= F.dayofmonth(F.last_day(month))).agg(F.max(month).alias("__whole"))
    return seen.join(whole, F.col("__whole").isNull() | (F.col(month) > F.col("__whole"))).drop("__whole")


#: Months of the two growing seasons, and the temperatures above which degree-days count in each; stress days count above the third.
KHARIF, RABI = (6, 7, 8, 9, 10), (11, 12, 1, 2, 3)
KHARIF_BASE, RABI_BASE, STRESS_BASE = 10.0, 5.0, 34.0


def thermal(daily: DataFrame, years: tuple[int, int], complete: int = 15) -> DataFrame:
    """district_id, month, temp_days, degree-days of the two seasons (missing outside their months), stress degree-days, and each one's normal and anomaly.

    Sums need ``complete`` days of temperature. A normal is the mean of the calendar month over ``years``.
    """
    tx, tn = F.col("tmax_c"), F.col("tmin_c")
    both = tx.isNotNull() & tn.isNotNull()
    m = F.month("month")
    sums = daily.groupBy("district_id", F.trunc("date", "MM").alias("month")).agg(
        F.count_if(both).alias("temp_days"), F.sum(indices.degree_days(tx, tn, KHARIF_BASE)).alias("__k"), F.sum(indices.degree_days(tx, tn, RABI_BASE)).alias("__r"), F.sum(F.when(both, clip(tx - STRESS_BASE, 0))).alias("sdd")
    )
    whole = F.col("temp_days") >= complete
    x = sums.select("district_id", "month", "temp_days", F.when(whole & m.isin(*KHARIF), F.col("__k")).alias("gdd_kharif"), F.when(whole & m.isin(*RABI), F.col("__r")).alias("gdd_rabi"), F.when(whole, F.col("sdd")).alias("sdd"))
    columns = ["gdd_kharif", "gdd_rabi", "sdd"]
    x = N.with_normal(x, columns, years)
    return x.withColumns({f"{c}_anom": F.col(c) - F.col(f"{c}_normal") for c in columns})


def masked(features: DataFrame, needs: dict[str, list[Column]]) -> DataFrame:
    """``features`` with each column of ``needs`` missing where one of its conditions (say, enough days of an input) doesn't hold; a missing condition doesn't."""
    ok = lambda cs: reduce(lambda a, b: a & b, [F.coalesce(c, F.lit(False)) for c in cs], F.lit(True))
    return features.withColumns({c: F.when(ok(cs), F.col(c)) for c, cs in needs.items()})


def refilled(features: DataFrame, to_date: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``features`` with the values of ``to_date`` in rows that it has: a running month's whole-month figures give way to those of its first days.

    to_date: keys and any of the columns; a value that it lacks for a row that it has becomes missing, never the whole month's. is_month_to_date tells the rows.
    """
    new = [c for c in to_date.columns if c not in keys and c in features.columns]
    beside = to_date.select(*keys, F.lit(1).alias("__to_date"), *[F.col(c).alias(f"__{c}") for c in new])
    j = features.join(beside, keys, "left")
    here = F.col("__to_date").isNotNull()
    out = [F.when(here, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in features.columns]
    return j.select(*out, here.cast("int").alias("is_month_to_date"))


def running_month(daily: DataFrame, years: tuple[int, int], latitude: Column, scales: list[int], least: int = 20, complete: int = 15) -> DataFrame:
    """Of the newest month with rain, if it isn't whole: district_id, month, days, rain and departure, maximum's anomaly, degree-days and their anomalies, and the drought index
    of ``scales``, all over its first days against the same days of other years.

    The month and its number of days are one row of the driver, as the windows are made for them.
    """
    last = daily.where("rain_mm is not null").agg(F.max("date").alias("d"), F.last_day(F.max("date")).alias("e")).first()
    if last.d is None or last.d == last.e:
        empty = daily.limit(0).select("district_id", F.trunc("date", "MM").alias("month"))
        return empty.withColumns({c: F.lit(None).cast("double") for c in ("rain_mm", "rain_dep", "tmax_anom", "sdd", "sdd_anom", *[f"spei_{s}" for s in scales])})
    month, days, year = last.d.month, last.d.day, last.d.year
    now = month_to_date(daily, month, days, years).where(F.col("year") == year)
    out = now.select("district_id", F.make_date(F.lit(year), F.lit(month), F.lit(1)).alias("month"), F.col("rain").alias("rain_mm"), F.col("departure").alias("rain_dep"), "tmax_anom", "sdd", (F.col("sdd") - F.col("sdd_normal")).alias("sdd_anom"))
    radiation = indices.extraterrestrial_radiation(latitude, F.dayofyear("date"))
    balance = daily.select("district_id", "date", (F.col("rain_mm") - indices.hargreaves(radiation, F.col("tmax_c"), F.col("tmin_c"))).alias("wb"))
    for s in scales:
        z = partial_spei(balance, month, days, s, least, complete).where(F.col("year") == year).select("district_id", F.col("spei").alias(f"spei_{s}"))
        out = out.join(z, "district_id", "left")
    return out
