"""Windows over long tables on a dense calendar, each one shuffle by the group keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(keys: list[str] | str = "district_id", order: str = "date") -> WindowSpec:
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def rolling_sum(x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """Sum of the last ``n`` rows, NULL with fewer than ``least`` values (all of them by default)."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) >= (n if least is None else least), F.sum(x).over(frame))


def forward_sum(x: Column, w: WindowSpec, n: int) -> Column:
    """Sum of the next ``n`` rows without this one, NULL if one is missing."""
    frame = w.rowsBetween(1, n)
    return F.when(F.count(x).over(frame) == n, F.sum(x).over(frame))


def run_flag(condition: Column, w: WindowSpec, n: int) -> Column:
    """1 where the condition held on this and the n - 1 rows before."""
    frame = w.rowsBetween(1 - n, 0)
    return ((F.sum(condition.cast("int")).over(frame) == n) & (F.count(condition).over(frame) == n)).cast("int")


def bounded_fill(x: Column, w: WindowSpec, limit: int) -> Column:
    """The last value at most ``limit`` rows back."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def dry_spell(df: DataFrame, x: str, keys: list[str], order: str, wet: float = 1.0, out: str = "dry_days") -> DataFrame:
    """Days since the last wet day: 0 on it, NULL where missing, from 1 anew after a gap."""
    w = series(keys, order)
    v = F.col(x)
    grouped = df.withColumn("__run", F.sum((v.isNull() | (v > wet)).cast("int")).over(w))
    inner = Window.partitionBy(*keys, "__run").orderBy(order)
    return grouped.withColumn(out, F.when(v.isNotNull(), F.sum((v <= wet).cast("int")).over(inner))).drop("__run")


def trailing_run(df: DataFrame, condition: Column, keys: list[str], order: str) -> DataFrame:
    """Per group, how many rows at its end fulfil the condition without a break: (keys, run)."""
    marked = df.withColumn("__c", F.coalesce(condition, F.lit(False)))
    broken = marked.groupBy(*keys).agg(F.max(F.when(~F.col("__c"), F.col(order))).alias("__break"))
    return marked.join(broken, keys).groupBy(*keys).agg(F.sum((F.col("__break").isNull() | (F.col(order) > F.col("__break"))).cast("int")).cast("long").alias("run"))


def percent_rank_average(x: str, keys: list[str]) -> Column:
    """Rank over group size, ties sharing the mean of their ranks; NULLs unranked."""
    by = Window.partitionBy(*keys, F.col(x).isNull()).orderBy(x)
    same = Window.partitionBy(*keys, x)
    n = F.count(x).over(Window.partitionBy(*keys))
    return F.when(F.col(x).isNotNull(), (F.rank().over(by) + (F.count(F.lit(1)).over(same) - 1) / 2.0) / n)


def segments(df: DataFrame, keys: list[str], order: str, value: str, gap_days: int = 21, drop: float = 0.60) -> DataFrame:
    """Cut cumulative counters into seasons: a row starts one after a silence of more than
    ``gap_days``, or when it falls below ``drop`` times the greatest value since the start.

    The second rule's running maximum restarts with each segment, which no window can express: a
    fold over a group's sorted rows carries it. A group is one counter (district and crop), a
    few hundred weekly reports.
    """
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    zero = F.struct(F.lit(0).alias("seg"), F.lit(None).cast("double").alias("top"), F.lit(None).cast("date").alias("prev"), F.array().cast("array<struct<o:date,v:double,seg:int>>").alias("out"))

    def step(s: Column, r: Column) -> Column:
        new = F.coalesce((F.datediff(r["o"], s["prev"]) > gap_days) | (r["v"] < s["top"] * drop), F.lit(False))
        seg = s["seg"] + new.cast("int")
        top = F.when(new | s["top"].isNull(), r["v"]).otherwise(F.greatest(s["top"], r["v"]))
        return F.struct(seg.alias("seg"), top.alias("top"), r["o"].alias("prev"), F.concat(s["out"], F.array(F.struct(r["o"].alias("o"), r["v"].alias("v"), seg.alias("seg")))).alias("out"))

    folded = df.groupBy(*keys).agg(rows.alias("rows")).select(*keys, F.explode(F.aggregate("rows", zero, step, lambda s: s["out"])).alias("r"))
    return folded.select(*keys, F.col("r.o").alias(order), F.col("r.v").alias(value), F.col("r.seg").alias("segment"))
