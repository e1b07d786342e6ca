"""Standardised drought and heat indices as column expressions over windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip

# fixed values: coefficients of Wichura's algorithm AS 241 (PPND16) for the inverse normal
CENTRE = ([3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727], [1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610])
NEAR = ([1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640], [1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9])
FAR = ([6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15])


def _number(x: float, mark: str) -> str:
    return repr(x) if "e" in repr(x) else f"{x!r}{mark}"


def _ratio(x: str, c: tuple[list[float], list[float]], mark: str) -> str:
    def poly(p: list[float]) -> str:
        out = _number(p[-1], mark)
        for k in reversed(p[:-1]):
            out = f"({out} * {x} + {_number(k, mark)})"
        return out

    return f"({poly(c[0])} / {poly(c[1])})"


def inverse_normal_sql(p: str, mark: str = "D") -> str:
    """The quantile of the standard normal distribution at ``p``, strictly between 0 and 1.

    ``mark`` ends a double literal: D in Spark SQL, e0 elsewhere.
    """
    n = lambda x: _number(x, mark)
    q = f"({p} - {n(0.5)})"
    tail = f"sqrt(-ln(least({p}, {n(1.0)} - {p})))"
    middle = f"({n(0.180625)} - {q} * {q})"
    far = f"CASE WHEN {tail} <= {n(5.0)} THEN {_ratio(f'({tail} - {n(1.6)})', NEAR, mark)} ELSE {_ratio(f'({tail} - {n(5.0)})', FAR, mark)} END"
    return f"CASE WHEN abs({q}) <= {n(0.425)} THEN {q} * {_ratio(middle, CENTRE, mark)} ELSE sign({q}) * {far} END"


def spei(df: DataFrame, x: str, groups: list[str], order: str, out: str = "spei", least: int = 20) -> DataFrame:
    """Adds ``out`` and its probability ``<out>_p``: standardised ``x`` within each group by a log-logistic fit of unbiased probability-weighted moments.

    Groups of fewer than ``least`` values are NULL. Where the fit has no positive scale, the
    plotting position (rank - 0.44) / (n + 0.12) stands in. One shuffle by the group: moments,
    ranks and counts are windows over it.
    """
    v = F.col(x)
    g = Window.partitionBy(*groups, v.isNull())
    j = F.row_number().over(g.orderBy(x, order))
    n = F.count(v).over(g)
    steps = df.withColumn("__n", n.cast("double")).withColumn("__j", j.cast("double")).withColumn("__rank", F.rank().over(g.orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*groups, x)) - 1) / 2.0)
    nn, jj = F.col("__n"), F.col("__j")
    steps = (
        steps.withColumn("__w0", F.avg(v).over(g))
        .withColumn("__w1", F.sum((nn - jj) * v).over(g) / F.nullif(nn * (nn - 1), F.lit(0.0)))
        .withColumn("__w2", F.sum((nn - jj) * (nn - jj - 1) * v).over(g) / F.nullif(nn * (nn - 1) * (nn - 2), F.lit(0.0)))
    )
    w0, w1, w2 = F.col("__w0"), F.col("__w1"), F.col("__w2")
    steps = steps.withColumn("__b", F.try_divide(2 * w1 - w0, 6 * w1 - w0 - 6 * w2))
    b = F.col("__b")
    steps = steps.withColumn("__a", F.try_divide((w0 - 2 * w1) * b, F.try_divide(F.lit(math.pi) / b, F.sin(F.lit(math.pi) / b)))).withColumn("__g", w0 - (w0 - 2 * w1) * b)
    a, c = F.col("__a"), F.col("__g")
    fitted = F.when(v == c, F.lit(0.0)).when(v > c, 1 / (1 + F.pow(a / (v - c), b)))
    p = F.when(v.isNotNull() & (nn >= least), F.when(a > 0, fitted).otherwise((F.col("__rank") - 0.44) / (nn + 0.12)))
    steps = steps.withColumn("__p", clip(p, 1e-6, 1 - 1e-6))
    return steps.withColumn(out, F.expr(inverse_normal_sql("__p"))).withColumnRenamed("__p", f"{out}_p").drop("__n", "__j", "__rank", "__w0", "__w1", "__w2", "__b", "__a", "__g")


def extraterrestrial_radiation(latitude: Column, doy: Column) -> Column:
    """Daily radiation above the atmosphere as evaporation (mm/day), by latitude in degrees and day of year."""
    phi = F.radians(latitude)
    angle = F.lit(2 * math.pi) * doy / 365.0
    distance = 1 + 0.033 * F.cos(angle)
    tilt = 0.409 * F.sin(angle - 1.39)
    cosine = -F.tan(phi) * F.tan(tilt)
    sunset = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    return F.lit(24 * 60 / math.pi * 0.0820 * 0.408) * distance * (sunset * F.sin(phi) * F.sin(tilt) + F.cos(phi) * F.cos(tilt) * F.sin(sunset))


def hargreaves(radiation: Column, tmax: Column, tmin: Column) -> Column:
    """Potential evapotranspiration a day; NULL where the range isn't positive."""
    return F.when(tmax > tmin, clip(0.0023 * radiation * F.sqrt(tmax - tmin) * ((tmax + tmin) / 2 + 17.8), 0))


def degree_days(tmax: Column, tmin: Column, base: float) -> Column:
    return clip((tmax + tmin) / 2 - base, 0)


def octant(x: Column, y: Column) -> Column:
    """Compass octant 1 to 8 of the point (x, y); NULL at the origin."""
    return F.when((x != 0) | (y != 0), F.floor(F.pmod(F.degrees(F.atan2(y, x)) + 180, F.lit(360.0)) / 45).cast("int") + 1)


def stress_degrees(tmax: Column, above: float) -> Column:
    """Degrees of the maximum above a threshold."""
    return clip(tmax - above, 0)


def weighted_moments(df: DataFrame, x: str, groups: list[str], order: str) -> DataFrame:
    """Unbiased probability-weighted moments of each group: groups, n, w0, w1, w2. Ranks come from one sort a group."""
    v = df.where(F.col(x).isNotNull())
    g = Window.partitionBy(*groups)
    ranked = v.select(*groups, F.col(x).alias("__x"), F.row_number().over(g.orderBy(x, order)).cast("double").alias("__j"), F.count(F.lit(1)).over(g).cast("double").alias("__n"))
    n, j, y = F.col("__n"), F.col("__j"), F.col("__x")
    w1, w2 = F.try_divide(F.sum((n - j) * y), F.max(n * (n - 1))), F.try_divide(F.sum((n - j) * (n - j - 1) * y), F.max(n * (n - 1) * (n - 2)))
    return ranked.groupBy(*groups).agg(F.max("__n").cast("long").alias("n"), F.avg(y).alias("w0"), w1.alias("w1"), w2.alias("w2"))
