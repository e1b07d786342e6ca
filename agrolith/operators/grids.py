"""Grids and images over districts: resampling, zonal and masked means, class areas, units, ensembles, wide matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip
from agrolith.operators.quantiles import exact_quantiles


def bilinear(points: DataFrame, cells: DataFrame, x0: float, y0: float, step: float, keys: list[str] | None = None) -> DataFrame:
    """Values of a grid at points: (id, keys, v), each the mean of the four cells around it by their nearness.

    points: id, x, y; cells: row, column, keys and v, whose middles are at (x0 + column * step, y0 + row * step). Masked cells (null v, or absent) are left
    out and the rest weigh more; a point that has none of its four has no row. A point meets its cells by an equality join.
    """
    keys = keys or []
    u, w = (F.col("x") - x0) / step, (F.col("y") - y0) / step
    corners = F.array(*[F.struct((F.floor(w) + i).alias("row"), (F.floor(u) + j).alias("column"), ((w - F.floor(w) if i else 1 - w + F.floor(w)) * (u - F.floor(u) if j else 1 - u + F.floor(u))).alias("weight")) for i in (0, 1) for j in (0, 1)])
    near = points.select("id", F.explode(corners).alias("c")).select("id", "c.*").where("weight > 0")
    met = near.join(cells.where("v is not null").select(F.col("row").cast("long").alias("row"), F.col("column").cast("long").alias("column"), *keys, "v"), ["row", "column"])
    return met.groupBy("id", *keys).agg((F.sum(F.col("weight") * F.col("v")) / F.sum("weight")).alias("v"))


def zonal_mean(pixels: DataFrame, zone: str, keys: list[str], value: str = "v") -> DataFrame:
    """Mean of the pixels of each zone that have a value, and the share that do: zone, keys, mean, valid_share."""
    return pixels.groupBy(zone, *keys).agg(F.avg(value).alias("mean"), (F.count(value) / F.count(F.lit(1))).alias("valid_share"))


def from_wide(matrix: DataFrame, index: str, key: str, value: str, kind: str = "int") -> DataFrame:
    """A matrix with a column a unit as rows (index, key, value): names become keys of type ``kind``, those that can't are left out, as missing values are."""
    names = [c for c in matrix.columns if c != index]
    pairs = F.array(*[F.struct(F.lit(c).try_cast(kind).alias(key), F.col(f"`{c}`").cast("double").alias(value)) for c in names])
    long = matrix.select(index, F.explode(pairs).alias("p")).select(index, "p.*")
    return long.where(F.col(key).isNotNull() & F.col(value).isNotNull() & ~F.isnan(value))


def to_wide(rows: DataFrame, index: str, key: str, value: str, units: list) -> DataFrame:
    """The other way: one column a unit of the list ``units``, a registry's ids."""
    out = rows.groupBy(index).pivot(key, units).agg(F.first(value))
    return out


def pixel_of(x: Column, start: float, step: float) -> Column:
    """The number of the cell that a coordinate lies in; cells begin at ``start``."""
    return F.floor((x - start) / step).cast("long")


def subdaily_to_daily(records: DataFrame, keys: list[str], ts: str, rate: str, u: str, v: str, seconds: int = 86_400, least: int = 1) -> DataFrame:
    """Records of a day and key as one row: keys, day, the mean rate as the day's sum, its highest and lowest, the speed of the mean wind (u, v), and how many
    records there are; days of fewer than ``least`` are withheld."""
    g = records.groupBy(*keys, F.to_date(ts).alias("day"))
    speed = F.sqrt(F.pow(F.avg(u), 2.0) + F.pow(F.avg(v), 2.0))
    out = g.agg((F.avg(rate) * seconds).alias("total"), F.max(rate).alias("hi"), F.min(rate).alias("lo"), speed.alias("speed"), F.count(F.lit(1)).alias("n_records"))
    return out.where(F.col("n_records") >= least)


def class_areas(pixels: DataFrame, zone: str, area: str, classes: dict[str, Column], shares: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Per zone, the area of the pixels of each class (conditions, which may overlap), and shares in percent of one class by another, which are missing where that has no area."""
    of = {n: F.sum(F.when(c, F.col(area))) for n, c in classes.items()}
    percent = [F.try_divide(F.lit(100.0) * of[a], of[b]).alias(n) for n, (a, b) in (shares or {}).items()]
    return pixels.groupBy(zone).agg(*[c.alias(n) for n, c in of.items()], *percent)


def quality_masked_mean(pixels: DataFrame, zone: str, value: str, good: Column, scale: float = 1.0) -> DataFrame:
    """Per zone, the mean of the pixels that pass the quality test, scaled, and the share that pass: zone, mean, clear."""
    return pixels.groupBy(zone).agg(F.avg(F.when(good, F.col(value) / scale)).alias("mean"), F.avg(F.coalesce(good, F.lit(False)).cast("int")).alias("clear"))


def celsius(x: Column) -> Column:
    """A temperature that is in Kelvin if it is above 100; each record tells for itself, before any mean."""
    return F.when(x > 100, x - 273.15).otherwise(x)


def evaporation_mm(metres: Column) -> Column:
    """Evaporation is given downward, in metres of water: negative where water is lost; dew doesn't count."""
    return clip(metres * -1000, 0)


#: Ends of a colour ramp.
NICE = (5, 10, 20, 25, 50, 100, 200, 250, 500, 1000)


def adaptive_domain(rows: DataFrame, by: list[str], size: Column, least: int = 8, default: int = 100) -> DataFrame:
    """Per group, the first of NICE that isn't below the 95th percentile of a size (that at the lower rank), the last if all are below it, or ``default`` with fewer than
    ``least`` values. Equal sizes are counted first; ranks come from the counts."""
    x = rows.select(*by, size.cast("double").alias("__s")).where("__s is not null").groupBy(*by, "__s").agg(F.count(F.lit(1)).alias("__k"))
    group = Window.partitionBy(*by)
    upto = x.withColumn("__upto", F.sum("__k").over(group.orderBy("__s"))).withColumn("__n", F.sum("__k").over(group))
    at = F.floor(0.95 * (F.col("__n") - 1))
    p95 = upto.where(F.col("__upto") > at).groupBy(*by, "__n").agg(F.min("__s").alias("__p"))
    first = F.coalesce(F.array_min(F.filter(F.array(*[F.lit(n) for n in NICE]), lambda n: n >= F.col("__p"))), F.lit(NICE[-1]))
    return p95.select(*by, F.when(F.col("__n") < least, default).otherwise(first).alias("top"))


def ensemble_leads(members: DataFrame, run: str, lead: str, value: str, leads: list[int], quantiles: tuple[float, ...] = (0.1, 0.9)) -> DataFrame:
    """Of the newest run: mean and quantiles of the members at each of the wanted leads: lead, mean, q (an array)."""
    newest = members.agg(F.max(run).alias("__run"))
    now = members.crossJoin(F.broadcast(newest)).where((F.col(run) == F.col("__run")) & F.col(lead).isin(*leads)).select(lead, F.col(value).cast("double").alias("__v"))
    return now.groupBy(lead).agg(F.avg("__v").alias("mean")).join(exact_quantiles(now, [lead], "__v", list(quantiles)), lead)


def forecast_layer(forecast: DataFrame, series: list[str], date: str, value: str, records: Column, whole: int, days: int, least: int) -> DataFrame:
    """Sums of the last ``days`` days of a forecast, of which at least ``least`` are known; days of fewer than ``whole`` records are withheld: series, date, total."""
    x = forecast.select(*series, date, F.when(records >= whole, F.col(value)).alias("__v"))
    w = Window.partitionBy(*series).orderBy(date).rowsBetween(1 - days, 0)
    return x.select(*series, date, F.when(F.count("__v").over(w) >= least, F.sum("__v").over(w)).alias("total"))
