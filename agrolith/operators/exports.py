"""Exported files and what goes into them: overlaps, coverage and matches by file, and the years that a workbook holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unit_key(*names: Column) -> Column:
    """Names as they are compared: letters and digits in lower case, joined by a bar; a missing name is empty."""
    return F.concat_ws("|", *[F.coalesce(F.regexp_replace(F.lower(n), "[^a-z0-9]", ""), F.lit("")) for n in names])


def verify_files(rows: DataFrame, registry: DataFrame, file: Column, date: str, unit: list[str], least_match: float = 98.0) -> DataFrame:
    """One row a file: first and last month, rows, units, absent units, the share of rows that match the registry, the months
    that an earlier file has too, by how many files, and a verdict.

    Rows of a month in two files are counted twice by whoever sums files, so that ``overlap`` is fatal; absent units and a match
    below ``least_match`` percent are warnings. Files are compared by the table of their months, in one pass over each month's
    files in order of name. unit: columns of both tables. Undated rows count as rows and match, but have no month.
    """
    known = registry.select(unit_key(*[F.col(u) for u in unit]).alias("__unit")).distinct()
    x = rows.select(file.alias("file"), F.trunc(date, "MM").alias("month"), unit_key(*[F.col(u) for u in unit]).alias("__unit"))
    units = x.groupBy("file", "month", "__unit").agg(F.count(F.lit(1)).alias("n"))  # everything else is about these
    marked = units.join(known.withColumn("__known", F.lit(1)), "__unit", "left")
    about = marked.groupBy("file").agg(
        F.min("month").alias("first"), F.max("month").alias("last"), F.sum("n").alias("rows"), F.countDistinct("__unit").alias("units"),
        F.countDistinct(F.when(F.col("__known") == 1, F.col("__unit"))).alias("__here"), (100 * F.sum(F.when(F.col("__known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("match_percent"),
    )
    earlier = Window.partitionBy("month").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    held = units.where("month is not null").select("file", "month").distinct().withColumn("__before", F.count(F.lit(1)).over(earlier)).withColumn("__other", F.last("file").over(earlier))
    clashes = held.where("__before > 0").groupBy("file").agg(F.count(F.lit(1)).alias("overlaps"), F.countDistinct("__other").alias("with_files"))
    total = known.agg(F.count(F.lit(1)).alias("__all"))
    out = about.join(clashes, "file", "left").crossJoin(F.broadcast(total)).na.fill(0, ["overlaps", "with_files"])
    verdict = F.when(F.col("overlaps") > 0, "overlap").when((F.col("match_percent") < least_match) | (F.col("__here") < F.col("__all")), "warning").otherwise("ok")
    return out.select("file", "first", "last", "rows", "units", (F.col("__all") - F.col("__here")).alias("absent"), "match_percent", "overlaps", "with_files", verdict.alias("verdict"))


def months_between(months: DataFrame, month: str = "month") -> DataFrame:
    """Months without a row between the first and the last that have one."""
    ends = months.agg(F.trunc(F.min(month), "MM").alias("a"), F.trunc(F.max(month), "MM").alias("b")).where("a is not null")
    span = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias(month))
    return span.join(months.select(F.trunc(month, "MM").alias("__m")).distinct(), F.col(month) == F.col("__m"), "left_anti")


def recent_years(rows: DataFrame, year: str, years: int, most_rows: int, most_cells: int, order: list[str]) -> DataFrame:
    """The rows of the last years that a workbook can hold: ``years`` of them, or half as many, and so on, until there are
    at most ``most_rows`` rows and ``most_cells`` cells. If not even the last year fits, its last rows by ``order`` that do.

    Rows by year are counted once and summed from the last year back; nothing but a few counts is compared.
    """
    width = max(1, len(rows.columns))
    most = min(most_rows, most_cells // width)
    spans = []
    while years >= 1:
        spans.append(years)
        years //= 2
    n = rows.where(F.col(year).isNotNull()).groupBy(F.col(year).alias("__y")).agg(F.count(F.lit(1)).alias("__n"))
    upto = n.withColumn("__n", F.sum("__n").over(Window.orderBy(F.desc("__y")))).withColumn("__last", F.max("__y").over(Window.partitionBy(F.lit(0))))  # a row a year
    tried = upto.select("*", F.explode(F.array(*[F.lit(s) for s in spans])).alias("__span")).where("__y > __last - __span")
    sizes = tried.groupBy("__span", "__last").agg(F.max("__n").alias("__size"))
    chosen = sizes.groupBy("__last").agg(F.max(F.when(F.col("__size") <= most, F.col("__span"))).alias("__span"))
    beside = rows.crossJoin(F.broadcast(chosen))
    whole = beside.where(F.col(year) > F.col("__last") - F.col("__span"))
    part = beside.where(F.col("__span").isNull() & (F.col(year) == F.col("__last"))).orderBy(*[F.desc(c) for c in order]).limit(most)
    return whole.select(*rows.columns).union(part.select(*rows.columns))
