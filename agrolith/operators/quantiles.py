"""Exact quantiles whose memory doesn't grow with the group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: list[str], x: str, quantiles: list[float], ranges: int = 64) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values by ``keys``: keys and an array ``q`` in the order given.

    Equal values are counted first, so that a value which a third of the rows share is one row. Approximate quantiles cut
    the distinct values of each group into ``ranges`` ranges of like size, whose exact counts tell which of
    them hold the wanted ranks; only these are sorted, each range for itself. No task holds all
    values of a group, and the tables that are joined have a row a range.
    """
    by = keys or ["__one"]
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("__x"))
    rows = rows if keys else rows.withColumn("__one", F.lit(0))
    values = rows.groupBy(*by, "__x").agg(F.count(F.lit(1)).alias("__k"))
    cuts = values.groupBy(*by).agg(F.percentile_approx("__x", [i / ranges for i in range(1, ranges)], 50 * ranges).alias("__cuts"))
    dealt = values.join(cuts, by).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col("__x")))).drop("__cuts")
    counts = dealt.groupBy(*by, "__range").agg(F.sum("__k").alias("__n"))
    group = Window.partitionBy(*by)
    placed = counts.withColumn("__before", F.coalesce(F.sum("__n").over(group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__all", F.sum("__n").over(group))
    rank = [F.lit(q) * (F.col("__all") - 1) for q in quantiles]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(r).cast("long"), F.ceil(r).cast("long")) for r in rank])))
    wanted = placed.withColumn("__ranks", F.filter(ranks, lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__n")))).where(F.size("__ranks") > 0)
    inside = dealt.join(wanted.select(*by, "__range", "__before", "__all", "__ranks"), [*by, "__range"])
    upto = F.sum("__k").over(Window.partitionBy(*by, "__range").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("__before")
    at = inside.withColumn("__upto", upto).select(*by, "__x", "__all", F.explode(F.filter("__ranks", lambda r: (r < F.col("__upto")) & (r >= F.col("__upto") - F.col("__k")))).alias("__at"))
    found = at.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__at", "__x"))).alias("__v"), F.first("__all").alias("__all"))  # two ranks a quantile
    low = lambda r: F.try_element_at("__v", F.floor(r).cast("long"))
    high = lambda r: F.try_element_at("__v", F.ceil(r).cast("long"))
    return found.select(*keys, F.array(*[low(r) + (high(r) - low(r)) * (r - F.floor(r)) for r in rank]).alias("q"))
