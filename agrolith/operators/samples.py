"""Training samples of a district and issue date, from dense daily series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.functions.nulls import percent_departure
from agrolith.operators import windows as W
from agrolith.operators.quantiles import exact_quantiles

BACK, AHEAD = (3, 7, 15, 30), (7, 14)
WET = 1.0


def octants(index: DataFrame, first: str = "romi1", second: str = "romi2") -> DataFrame:
    """A daily index of two components, one day late as it was published: date, both, and amplitude, sine and cosine of its angle."""
    a, b = F.col(first), F.col(second)
    size = F.sqrt(a * a + b * b)
    return index.select(F.date_add("date", 1).alias("date"), first, second, size.alias("mjo_amp"), F.try_divide(b, size).alias("mjo_sin"), F.try_divide(a, size).alias("mjo_cos"))


def samples(daily: DataFrame, monthly: DataFrame, columns: list[str], index: DataFrame | None, years: tuple[int, int], *, stride: int = 5, since: int = 1990, back: tuple[int, ...] = BACK, ahead: tuple[int, ...] = AHEAD, half: int = 0, floor: float = 5.0, need: float = 1.0) -> DataFrame:
    """One row a district and issue date, of each ``stride``-th day of the year from ``since`` on.

    daily: district_id, date, rain_mm on a dense calendar. Of the days up to the issue date: sums of rain and their departures
    from the normal (day of the year over ``years``, smoothed by ``half`` days each way), wet days and days above the district's own 95th percentile
    of wet days in the last 30, the dry spell (missing where rain is). monthly: district_id, month and
    ``columns``, taken from the month before, the last that is whole. index: made by ``octants``, of the issue date itself.
    Targets: sums of the next days, their normals and departures. Sums need the share ``need`` of their days observed, and
    normals are summed over just the days observed.
    """
    from agrolith.operators import normals as N

    w, r = W.series(), F.col("rain_mm")
    normal = N.doy_normal(daily.where(F.year("date").between(*years)), "rain_mm", years, half) if half else None
    x = daily.select("district_id", "date", "rain_mm", F.dayofyear("date").alias("doy"))
    if normal is None:
        normal = x.where(F.year("date").between(*years)).groupBy("district_id", "doy").agg(F.avg("rain_mm").alias("normal"))
    high = exact_quantiles(daily.where(r > WET).select("district_id", "rain_mm"), ["district_id"], "rain_mm", [0.95])
    x = x.join(normal.toDF("district_id", "doy", "normal"), ["district_id", "doy"], "left").join(high.select("district_id", F.element_at("q", 1).alias("high")), "district_id", "left")
    x = W.dry_spell(x, "rain_mm", ["district_id"], "date", WET, "dsw")
    n = F.when(r.isNotNull(), F.col("normal"))
    least = lambda h: max(1, math.ceil(need * h))

    def over(v: Column, h: int, to: int) -> Column:
        frame = w.rowsBetween(to - h + 1, to)
        return F.when(F.count(v).over(frame) >= least(h), F.sum(v).over(frame))

    wet, extreme = F.when(r.isNotNull(), (r > WET).cast("long")), F.when(r.isNotNull(), F.coalesce(r > F.col("high"), F.lit(False)).cast("long"))
    sums = {f"ant_rain_{h}": over(r, h, 0) for h in back} | {f"ant_norm_{h}": over(n, h, 0) for h in back}
    sums |= {f"fwdrain_{h}": over(r, h, h) for h in ahead} | {f"fwdnorm_{h}": over(n, h, h) for h in ahead}
    sums |= {"wet30": over(wet, 30, 0), "extreme30": over(extreme, 30, 0)}
    s = x.select("district_id", "date", "doy", "dsw", *[c.alias(k) for k, c in sums.items()])
    s = s.where((F.col("doy") % stride == 0) & (F.year("date") >= since))
    departure = lambda a, b: percent_departure(F.col(a), F.col(b), floor)
    s = s.withColumns({f"ant_dep_{h}": departure(f"ant_rain_{h}", f"ant_norm_{h}") for h in back} | {f"dep_{h}": departure(f"fwdrain_{h}", f"fwdnorm_{h}") for h in ahead})
    angle: Column = 2 * F.pi() * F.col("doy") / 365.25
    s = s.withColumns({"doy_sin": F.sin(angle), "doy_cos": F.cos(angle)}).drop(*[f"ant_norm_{h}" for h in back])
    s = s.withColumn("month", F.add_months(F.trunc("date", "MM"), -1)).join(monthly.select("district_id", "month", *columns), ["district_id", "month"], "left").drop("month")
    return s.join(index, "date", "left") if index is not None else s


def features_of(table: DataFrame) -> list[str]:
    """The columns of a sample table that a model may learn from: all but keys and what lies ahead."""
    return [c for c in table.columns if c not in ("date", "doy") and not c.startswith(("fwd", "dep_"))]
