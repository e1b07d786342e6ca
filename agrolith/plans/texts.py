"""Text and CSV sources and sinks, each through a round trip of a table of the test data."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators.panel import KEYS
from agrolith.plans.climate import monthly, r4, txt
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, MONTHLY, day, with_
from agrolith.sources import adapters as A
from agrolith.sources import sinks, text
from agrolith.streaming.runtime import shared_path

MONTH_COUNTS = "SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, CAST(count(*) AS DOUBLE) AS value FROM lineitem GROUP BY 1, 2"


def counts(spark, d: str):
    return A.table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))


def lines(df, *columns, sep: str = " "):
    """Columns as lines of text, written and read again."""
    path = shared_path(df.sparkSession, "lines")
    df.select(F.concat_ws(sep, *[c if not isinstance(c, str) else F.col(c).cast("string") for c in columns]).alias("value")).write.text(path)
    return df.sparkSession.read.text(path)


@query("s01_k01_csv_columns", "SELECT s_suppkey, s_acctbal FROM supplier")
def s01(spark, d):
    path = shared_path(spark, "csv")
    A.table(spark, d, "supplier").write.option("header", True).csv(path)
    schema = A.table(spark, d, "supplier").schema.simpleString()[7:-1].replace(":", " ")
    return text.csv(spark, path, schema, ["s_suppkey", "s_acctbal"])


@query("s02_s03_overlapping_files", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN s_acctbal * 2 ELSE s_acctbal END AS v FROM supplier")
def s02(spark, d):
    base, s = shared_path(spark, "runs"), A.table(spark, d, "supplier")
    s.select("s_suppkey", F.col("s_acctbal").alias("v")).write.option("header", True).csv(f"{base}/run_2023010100")
    s.where("s_acctbal > 0").select("s_suppkey", (F.col("s_acctbal") * 2).alias("v")).write.option("header", True).csv(f"{base}/run_2024010100")
    return text.csv_without_overlap(spark, f"{base}/run_*", "s_suppkey long, v double", ["s_suppkey"])


@query("s03_s04_newest_of_first_folder", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def s03(spark, d):
    base, r = shared_path(spark, "folders"), A.table(spark, d, "region").select("r_regionkey", "r_name")
    r.write.option("header", True).csv(f"{base}/second/run_2023")
    r.where("r_regionkey > 1").write.option("header", True).csv(f"{base}/second/run_2024")
    pattern = text.first_present(spark, [f"{base}/first/run_*", f"{base}/second/run_*"])
    return text.csv(spark, text.newest(spark, pattern), "r_regionkey long, r_name string")


@query("s05_fixed_table", "SELECT CAST(n_nationkey AS DOUBLE) AS a, CAST(n_regionkey AS DOUBLE) AS b FROM nation")
def s05(spark, d):
    n = A.table(spark, d, "nation")
    return text.fixed_table(lines(n, "n_nationkey", "n_regionkey", sep="   ").union(lines(n, "n_name", "n_regionkey")), ["a", "b"])


@query("s06_k09_dated_values", f"{with_(DAILY)} SELECT {day()} AS date, round(CAST(sum(rain_mm) AS DOUBLE), 3) AS value FROM daily GROUP BY date")
def s06(spark, d):
    path = shared_path(spark, "series")
    one = A.daily(spark, d).groupBy("date").agg(F.round(F.sum("rain_mm"), 3).alias("v"))
    sinks.text_series(one, path, "date", "v")
    return text.dated_values(spark.read.text(path)).select(txt(), "value")


@query("s07_season_values", "SELECT year, month, CAST(n AS DOUBLE) AS total, CAST(n - 100 AS DOUBLE) AS anomaly FROM (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, count(*) AS n FROM lineitem GROUP BY 1, 2)")
def s07(spark, d):
    c = counts(spark, d).withColumn("season", F.element_at(F.array(*[F.lit(s) for s in text.SEASONS]), F.col("month"))).withColumn("anomaly", F.col("n") - 100)
    return text.season_values(lines(c, "season", "year", "n", "anomaly"))


@query("s08_column_by_position", MONTH_COUNTS)
def s08(spark, d):
    return text.column_of(lines(counts(spark, d), "year", "month", F.lit("x"), "n"), 1, 2, 4)


@query("s09_year_grid", f"SELECT y.year, CAST(m.m AS INT) AS month, c.value FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS year FROM lineitem) y CROSS JOIN range(1, 13) m(m) LEFT JOIN ({MONTH_COUNTS}) c ON c.year = y.year AND c.month = m.m")
def s09(spark, d):
    wide = counts(spark, d).groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("n"))
    return text.year_grid(lines(wide, "year", *[F.coalesce(F.col(str(m)), F.lit(-999)).cast("string") for m in range(1, 13)]))


@query("s21_optional_layer", "SELECT n_nationkey, CAST(NULL AS DOUBLE) AS extra, n_regionkey AS present FROM nation")
def s21(spark, d):
    base, n = shared_path(spark, "layers"), A.table(spark, d, "nation")
    n.select("n_nationkey", F.col("n_regionkey").alias("present")).write.option("header", True).csv(f"{base}/present")
    out = n.select("n_nationkey")
    for name in ("extra", "present"):
        kind = "double" if name == "extra" else n.schema["n_regionkey"].dataType.simpleString()
        layer = text.optional(spark, f"{base}/{name}", f"n_nationkey {n.schema['n_nationkey'].dataType.simpleString()}, {name} {kind}")
        out = out.withColumn(name, F.lit(None).cast(kind)) if layer is None else out.join(layer, "n_nationkey", "left")
    return out


@query("f15_repaired_units", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN c_acctbal / 1000 ELSE c_acctbal END AS area FROM customer")
def f15(spark, d):
    k, v = F.col("c_custkey") % 3, F.col("c_acctbal").cast("string")
    raw = A.table(spark, d, "customer").select("c_custkey", F.when(k == 0, "1000").otherwise(v).alias("value"), F.when(k == 0, v).when(k == 1, "Ha").otherwise("Th Ha").alias("unit"))
    return raw.select("c_custkey", text.repaired_area(F.col("value"), F.col("unit")).alias("area"))


@query("k02_k12_years_overwritten", f"{with_(DAILY)} SELECT district_id, {day()} AS date, CASE WHEN year(date) = 1999 THEN 0 ELSE rain_mm END AS rain_mm FROM daily WHERE rain_mm IS NOT NULL")
def k02(spark, d):
    path, x = shared_path(spark, "years"), A.daily(spark, d).where("rain_mm is not null").select("district_id", "date", "rain_mm")
    sinks.by_year(x, path, ["date", "district_id"])
    sinks.by_year(x.where("year(date) = 1999").withColumn("rain_mm", F.lit(0.0)), path, ["date", "district_id"])  # one year again
    return spark.read.parquet(path).select("district_id", txt(), "rain_mm")


@query("k04_masters", f"{with_(DAILY, MONTHLY)} SELECT 'rain' AS master, district_id, {day('month')} AS month, round(rain_mm, 4) AS v FROM monthly UNION ALL SELECT 'tmax', district_id, {day('month')}, round(tmax_c, 4) FROM monthly")
def k04(spark, d):
    path = shared_path(spark, "masters")
    sinks.masters(monthly(spark, d), path, KEYS, {"rain": ["rain_mm"], "tmax": ["tmax_c", "none_such"]})
    read = lambda name, c: spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("master"), "district_id", txt("month"), r4(F.col(c), "v"))
    return read("rain", "rain_mm").union(read("tmax", "tmax_c"))


@query("s24_edge_of_newest_file", f"{with_(DAILY)} SELECT {day('max(date)')} AS edge FROM daily WHERE tmax_c IS NOT NULL")
def s24(spark, d):
    base = shared_path(spark, "years")
    x = A.daily(spark, d).where("tmax_c is not null").select("date", "tmax_c", F.year("date").alias("year"))
    x.write.option("header", True).partitionBy("year").csv(base)
    return text.edge(spark, f"{base}/year=*", "date date, tmax_c double").select(txt("edge"))
