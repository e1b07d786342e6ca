"""Live edges, holes and plans of what to fetch; official figures against our own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import correlation


def edges_and_holes(days: DataFrame, calendar: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: first and last day with a value, days missing in between (holes), and days of the calendar, which is dense, after
    the last one, which are the edge and no holes."""
    ends = days.groupBy(*keys).agg(F.min("date").alias("first"), F.max("date").alias("edge"), F.countDistinct("date").alias("seen"))
    last = calendar.agg(F.max("date").alias("__last"))
    holes = F.datediff("edge", "first") + 1 - F.col("seen")
    return ends.crossJoin(F.broadcast(last)).select(*keys, "first", "edge", "seen", holes.cast("long").alias("holes"), F.greatest(F.datediff("__last", "edge"), F.lit(0)).cast("long").alias("after_edge"))


def to_fetch(known: DataFrame, calendar: DataFrame, refetch: int = 10, misses: int = 7) -> DataFrame:
    """Days of the calendar to ask a source for: those not known, and the last ``refetch`` days before the edge, whose
    values are still revised; beyond the edge no more than ``misses`` days, and all if none is known. known and calendar: one column date; both are short."""
    edge = known.agg(F.max("date").alias("edge"))
    marked = calendar.join(known.select("date", F.lit(1).alias("has")).distinct(), "date", "left").join(edge, F.lit(True))
    late = F.datediff("edge", "date") < refetch
    why = F.when(F.col("edge").isNull() | (F.col("has").isNull() & (F.col("date") > F.col("edge"))), "edge").when(F.col("has").isNull(), "hole").when(late, "revision")
    return marked.withColumn("why", why).where(F.col("why").isNotNull() & (F.col("edge").isNull() | (F.datediff("date", "edge") <= misses))).select("date", "why")


def year_tasks(mode: str, present: DataFrame, first: int, last: int, only: int | None = None) -> DataFrame:
    """Years to build again: UPDATE the last, YEAR one of them, BACKFILL those of ``first`` to ``last`` that ``present`` (column year) lacks."""
    years = present.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    if mode == "UPDATE":
        return years.where(F.col("year") == last)
    if mode == "YEAR":
        return years.where(F.col("year") == only)
    if mode == "BACKFILL":
        return years.join(present.select("year").distinct(), "year", "left_anti")
    raise ValueError(f"no mode {mode!r}: UPDATE, YEAR or BACKFILL")


def legacy_registry(rows: DataFrame, order: list[str], disputed: Column, offset: int = 9001) -> DataFrame:
    """Ids 0, 1, ... in sorted order, and ``offset`` on for the disputed; a registry is one short table."""
    w = Window.partitionBy("__d").orderBy(*order)
    return rows.withColumn("__d", disputed.cast("int")).withColumn("id", F.row_number().over(w) - 1 + F.when(F.col("__d") == 1, offset).otherwise(0)).drop("__d")


def against_official(ours: DataFrame, official: DataFrame, keys: list[str], value: str, close: float = 10.0, matches: float = 2.0) -> DataFrame:
    """Our figures beside official ones: difference, difference in percent, and a verdict; keys of just one side stay."""
    both = ours.select(*keys, F.col(value).alias("ours")).join(official.select(*keys, F.col(value).alias("official")), keys, "full")
    d = F.col("ours") - F.col("official")
    pct = F.try_divide(100 * d, F.col("official"))
    verdict = F.when(F.col("ours").isNull(), "ours missing").when(F.col("official").isNull(), "official missing").when(F.abs(pct) <= matches, "matches").when(F.abs(pct) <= close, "close").otherwise("DIVERGES")
    return both.select(*keys, "ours", "official", d.alias("difference"), pct.alias("percent"), verdict.alias("verdict"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (name, violations), in one pass over the table; a rule that is NULL isn't broken."""
    one = df.agg(*[F.struct(F.lit(n).alias("name"), F.count_if(c).alias("violations")).alias(f"c{i}") for i, (n, c) in enumerate(rules.items())])
    return one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(rules))])).alias("s")).select("s.*")


def audit(df: DataFrame, keys: list[str], columns: list[str], train: Column, ranges: dict[str, tuple[float, float]], target: str) -> DataFrame:
    """Rows (section, name, value) on a training table, in one pass and one for the keys: rows, repeated keys, the share of missing
    values, distinct values up to rounding (1 is a constant column), values out of range, the shift of the mean from
    training to test rows in standard deviations, and the correlation with the target."""
    x = lambda c: F.col(c)
    found = [("rows", "all", F.count(F.lit(1)).cast("double")), ("rows", "train", F.count_if(train).cast("double"))]
    for c in columns:
        shift = F.try_divide(F.avg(F.when(~train, x(c))) - F.avg(F.when(train, x(c))), F.stddev_samp(x(c)))
        found += [("missing", c, F.avg(x(c).isNull().cast("double"))), ("spread", c, F.max(x(c)) - F.min(x(c))), ("shift", c, shift), ("correlation", c, F.corr(c, target))]
    found += [("range", c, F.count_if((x(c) < lo) | (x(c) > hi)).cast("double")) for c, (lo, hi) in ranges.items()]
    one = df.agg(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value")).alias(f"c{i}") for i, (s, n, v) in enumerate(found)])
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).agg(F.sum(F.col("__n") - 1).cast("double").alias("value"))
    rows = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(found))])).alias("s")).select("s.*")
    return rows.union(repeated.select(F.lit("keys"), F.lit("repeated"), F.coalesce("value", F.lit(0.0))))


def product_checks(days: DataFrame, keys: list[str], date: str, value: str, bounds: tuple[float, float]) -> DataFrame:
    """Per key: rows, distinct days, blank values, days missing between the first and the last, and values out of bounds."""
    x, distinct = F.col(value), F.countDistinct(date)
    return days.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), distinct.alias("distinct_days"), (F.count(F.lit(1)) - F.count(x)).alias("blanks"), (F.datediff(F.max(date), F.min(date)) + 1 - distinct).alias("gaps"), F.count_if((x < bounds[0]) | (x > bounds[1])).alias("out_of_range"))


def compare_feeds(old: DataFrame, new: DataFrame, keys: list[str], value: str, tolerance: float = 1e-6) -> DataFrame:
    """Of two deliveries of a feed: keys shared, added and lost, and shared values that were revised; one row. A new delivery that lost keys is to be refused."""
    a = old.select(*keys, F.col(value).alias("__v"), F.lit(1).alias("__old"))
    b = new.select(*keys, F.col(value).alias("__w"), F.lit(1).alias("__new"))
    j, has = a.join(b, keys, "full"), lambda c: F.col(c).isNotNull()
    return j.agg(F.count_if(has("__old") & has("__new")).alias("shared"), F.count_if(~has("__old")).alias("added"), F.count_if(~has("__new")).alias("lost"), F.count_if(F.abs(F.col("__v") - F.col("__w")) > tolerance).alias("revised"))


def leakage(rows: DataFrame, keys: list[str], time: str, target: str, x: str, strong: float = 0.30, times: float = 1.5) -> DataFrame:
    """Per key: correlation of the target with the feature's row before and after. A feature that tells the past better
    than the future leaks: forward beyond ``strong`` and ``times`` the backward one; a constant's NaN is beyond all numbers, as in SQL."""
    w = Window.partitionBy(*keys).orderBy(time)
    moved = rows.select(*keys, target, F.lag(x).over(w).alias("__b"), F.lead(x).over(w).alias("__f"))
    b, f = correlation(F.col(target), F.col("__b")), correlation(F.col(target), F.col("__f"))
    return moved.groupBy(*keys).agg(b.alias("back"), f.alias("forward"), F.coalesce((F.abs(f) > strong) & (F.abs(f) > times * F.abs(b)), F.lit(False)).cast("int").alias("leaks"))


def freshness(edge: Column, today: Column, lag_days: int) -> Column:
    """CURRENT up to the source's usual lag, DUE up to twice that and three days, STALE beyond."""
    age = F.datediff(today, edge)
    return F.when(age <= lag_days, "CURRENT").when(age <= 2 * lag_days + 3, "DUE").when(age.isNotNull(), "STALE")


def exactly_one(df: DataFrame, condition: Column) -> DataFrame:
    """The row that fulfils a condition; an error if there is none or more than one."""
    found = df.where(condition).limit(2)
    if (n := found.count()) != 1:
        raise ValueError(f"{'no row' if n == 0 else 'more than one row'} fulfils {condition}")
    return found
