"""How far a district's series can be trusted, and how much of its land is irrigated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import categories, clip
from agrolith.operators import windows as W
from agrolith.operators.quantiles import exact_quantiles

GRADES = ("Low", "Moderate", "Good", "High")


def relative_spread(a: Column, b: Column, least: int = 5) -> Column:
    """Mean of the difference over the mean of two products, in percent; NULL with fewer than ``least`` pairs."""
    ok = (a + b) != 0
    return F.when(F.count_if(ok) >= least, F.avg(F.when(ok, F.abs(a - b) / ((a + b) / 2))) * 100)


def reliability(weights: DataFrame, spread: DataFrame) -> DataFrame:
    """district_id, effective_cells, spread, score, grade.

    weights: district_id, w, the overlap of each cell. spread: district_id, spread; a missing one is taken as the median. Half of the
    score comes from the cells that count (4 are enough), half from how well two products agree.
    """
    eff = weights.groupBy("district_id").agg((F.pow(F.sum("w"), 2.0) / F.sum(F.col("w") * F.col("w"))).alias("effective_cells"))
    found = exact_quantiles(spread, [], "spread", [0.5]).first()
    x = eff.join(spread, "district_id", "left").withColumn("spread", F.coalesce("spread", F.lit(found.q[0] if found else None).cast("double")))
    score = 0.5 * clip(F.col("effective_cells") / 4, 0, 1) + 0.5 * clip(1 - F.col("spread") / 60, 0, 1)
    grade = F.element_at(F.array(*[F.lit(g) for g in GRADES]), categories(score, [0.35, 0.55, 0.75], right=True) + 1)
    return x.select("district_id", "effective_cells", "spread", score.alias("score"), grade.alias("grade"))


def limited(weights: DataFrame, least: float = 1.5) -> DataFrame:
    """district_id, effective_cells, resolution_limited: whether fewer than ``least`` cells of a coarse grid count, so that the district only repeats one cell."""
    eff = weights.groupBy("district_id").agg((F.pow(F.sum("w"), 2.0) / F.sum(F.col("w") * F.col("w"))).alias("effective_cells"))
    return eff.withColumn("resolution_limited", F.coalesce(F.col("effective_cells") < least, F.lit(True)))


def irrigation(yearly: DataFrame, registry: DataFrame, maps: int = 5) -> DataFrame:
    """district_id, share, idx: mean irrigated hectares of the last ``maps`` years over the district's, or the state's median
    share, and its rank in percent. yearly: district_id, year, high (ha); registry: district_id, state, area (km2)."""
    last = yearly.select("year").distinct().orderBy(F.desc("year")).limit(maps)
    high = yearly.join(last, "year", "left_semi").groupBy("district_id").agg(F.avg("high").alias("high"))
    f = registry.join(high, "district_id", "left").withColumn("own", clip(F.col("high") / (F.col("area") * 100), 0, 1))
    median = F.percentile("own", 0.5).over(Window.partitionBy("state"))  # a state's districts
    return f.withColumn("share", F.coalesce("own", median)).withColumn("all", F.lit(0)).select("district_id", "share", W.percent_rank_average("share", ["all"]).alias("idx"))
