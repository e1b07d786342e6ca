"""Queries on the daily and monthly panel: aggregates, normals, windows, ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import categories, clip, correlation, percent_departure, ratio_of_sums, sum_at_least, weighted_mean
from agrolith.operators import normals as N
from agrolith.operators import windows as W
from agrolith.operators.quantiles import exact_quantiles
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, INDEX, MONTHLY, REGISTRY, day, with_
from agrolith.sources import adapters as A

BASE = (1995, 1998)


def txt(c: str = "date"):
    return F.col(c).cast("string").alias(c)


def r4(x, name: str):
    return F.round(x, 4).alias(name)


def monthly(spark, d: str) -> DataFrame:
    return N.monthly_panel(A.daily(spark, d))


@query("a03_monthly_resample", f"{with_(DAILY, MONTHLY)} SELECT district_id, {day('month')} AS month, round(rain_mm, 4) AS rain_mm, round(tmax_c, 4) AS tmax_c, round(tmin_c, 4) AS tmin_c, days FROM monthly")
def a03(spark, d):
    return monthly(spark, d).select("district_id", txt("month"), r4(F.col("rain_mm"), "rain_mm"), r4(F.col("tmax_c"), "tmax_c"), r4(F.col("tmin_c"), "tmin_c"), "days")


@query("a01_named_aggregates", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 6) AS mean, max(c_acctbal) AS hi, min(c_acctbal) AS lo, CAST(count(DISTINCT c_nationkey) AS BIGINT) AS nations FROM customer GROUP BY 1")
def a01(spark, d):
    c = A.table(spark, d, "customer")
    return c.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(F.avg("c_acctbal"), 6).alias("mean"), F.max("c_acctbal").alias("hi"), F.min("c_acctbal").alias("lo"), F.countDistinct("c_nationkey").alias("nations"))


@query("a02_sum_min_count", f"{with_(DAILY)} SELECT district_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, CASE WHEN count(rain_mm) >= 3 THEN round(sum(rain_mm), 4) END AS at_least_3, CASE WHEN count(rain_mm) >= 15 THEN round(sum(rain_mm), 4) END AS at_least_15, round(coalesce(sum(rain_mm), 0), 4) AS any_count FROM daily GROUP BY ALL")
def a02(spark, d):
    x = F.col("rain_mm")
    return A.daily(spark, d).groupBy("district_id", F.year("date").alias("year"), F.month("date").alias("month")).agg(r4(sum_at_least(x, 3), "at_least_3"), r4(sum_at_least(x, 15), "at_least_15"), r4(sum_at_least(x, 0), "any_count"))


@query("a04_duplicate_collapse", "WITH a AS (SELECT CAST(l_shipdate AS DATE) AS date, l_suppkey, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, CAST(year(date) AS INT) AS year, round(sum(q), 4) AS total FROM a GROUP BY ALL")
def a04(spark, d):
    items = A.table(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), "l_suppkey", "l_quantity")
    return N.collapse_duplicates(items, ["date", "l_suppkey"], "l_quantity", ["l_suppkey", F.year("date").alias("year")], "total")


@query("a05_month_completeness", f"{with_(DAILY)} SELECT {day("CAST(date_trunc('month', date) AS DATE)")} AS month, CAST(count(DISTINCT CASE WHEN rain_mm IS NOT NULL THEN date END) AS BIGINT) AS days_observed, CAST(day(last_day(min(date))) AS INT) AS days_in_month, CAST(count(DISTINCT CASE WHEN rain_mm IS NOT NULL THEN date END) = day(last_day(min(date))) AS INT) AS complete FROM daily GROUP BY date_trunc('month', date)")
def a05(spark, d):
    m = F.trunc("date", "MM")
    seen = A.daily(spark, d).groupBy(m.alias("month")).agg(F.countDistinct(F.when(F.col("rain_mm").isNotNull(), F.col("date"))).alias("days_observed"))
    length = F.dayofmonth(F.last_day("month"))
    return seen.select(txt("month"), "days_observed", length.alias("days_in_month"), (F.col("days_observed") == length).cast("int").alias("complete"))


@query("a07_weighted_mean", f"{with_(DAILY, MONTHLY, REGISTRY)} SELECT state, {day('month')} AS month, round(sum(CASE WHEN tmax_c IS NOT NULL AND area > 0 THEN tmax_c * area END) / nullif(sum(CASE WHEN tmax_c IS NOT NULL AND area > 0 THEN area END), 0), 4) AS tmax_c FROM monthly JOIN registry USING (district_id) GROUP BY 1, month")
def a07(spark, d):
    m = monthly(spark, d).join(A.registry(spark, d), "district_id")
    return m.groupBy("state", "month").agg(r4(weighted_mean(F.col("tmax_c"), F.col("area")), "tmax_c")).select("state", txt("month"), "tmax_c")


NORMAL = "normal AS (SELECT district_id, CAST(month(month) AS INT) AS m, avg(rain_mm) AS normal_mm FROM monthly WHERE year(month) BETWEEN 1995 AND 1998 GROUP BY 1, 2)"


@query("a08_ratio_of_sums", f"{with_(DAILY, MONTHLY, REGISTRY, NORMAL)} SELECT coalesce(state, '(all)') AS scope, {day('month')} AS month, round(100.0 * (sum(CASE WHEN rain_mm IS NOT NULL AND normal_mm IS NOT NULL THEN rain_mm * area END) - sum(CASE WHEN rain_mm IS NOT NULL AND normal_mm IS NOT NULL THEN normal_mm * area END)) / nullif(sum(CASE WHEN rain_mm IS NOT NULL AND normal_mm IS NOT NULL THEN normal_mm * area END), 0), 4) AS departure FROM monthly JOIN registry USING (district_id) LEFT JOIN normal ON normal.district_id = monthly.district_id AND m = month(month) GROUP BY GROUPING SETS ((state, month), (month))")
def a08(spark, d):
    m = N.with_normal(monthly(spark, d), ["rain_mm"], BASE).join(A.registry(spark, d), "district_id")
    cube = m.groupingSets([[F.col("state"), F.col("month")], [F.col("month")]], "state", "month").agg(r4(ratio_of_sums(F.col("rain_mm"), F.col("rain_mm_normal"), F.col("area")), "departure"))
    return cube.select(F.coalesce("state", F.lit("(all)")).alias("scope"), txt("month"), "departure")


@query("a09_layer_cube", f"{with_(DAILY, MONTHLY, REGISTRY)}, l AS (UNPIVOT (SELECT district_id, month, rain_mm, tmax_c, tmin_c FROM monthly) ON rain_mm, tmax_c, tmin_c INTO NAME layer VALUE v) SELECT layer, {day('month')} AS month, coalesce(state, '(all)') AS scope, round(sum(v * area) / nullif(sum(CASE WHEN v IS NOT NULL THEN area END), 0), 4) AS value FROM l JOIN registry USING (district_id) GROUP BY GROUPING SETS ((layer, month), (layer, month, state))")
def a09(spark, d):
    long = monthly(spark, d).unpivot(["district_id", "month"], ["rain_mm", "tmax_c", "tmin_c"], "layer", "v").where("v is not null").join(A.registry(spark, d), "district_id")
    cube = long.groupingSets([[F.col("layer"), F.col("month")], [F.col("layer"), F.col("month"), F.col("state")]], "layer", "month", "state").agg(r4(weighted_mean(F.col("v"), F.col("area")), "value"))
    return cube.select("layer", txt("month"), F.coalesce("state", F.lit("(all)")).alias("scope"), "value")


@query("a10_normal_departure", f"{with_(DAILY, MONTHLY, NORMAL)} SELECT monthly.district_id, {day('month')} AS month, round(normal_mm, 4) AS normal_mm, round(CASE WHEN normal_mm >= 5 THEN (rain_mm - normal_mm) / normal_mm * 100 END, 4) AS pct_departure FROM monthly LEFT JOIN normal ON normal.district_id = monthly.district_id AND m = month(month)")
def a10(spark, d):
    m = N.with_normal(monthly(spark, d), ["rain_mm"], BASE)
    return m.select("district_id", txt("month"), r4(F.col("rain_mm_normal"), "normal_mm"), r4(percent_departure(F.col("rain_mm"), F.col("rain_mm_normal")), "pct_departure"))


@query("a11_day_matched_normal", f"{with_(DAILY)}, c AS (SELECT district_id, month(date) AS m, day(date) AS dd, avg(rain_mm) AS n FROM daily WHERE year(date) BETWEEN 1995 AND 1998 GROUP BY ALL) SELECT d.district_id, CAST(year(date) AS INT) AS year, CAST(m AS INT) AS month, round(sum(rain_mm), 4) AS rain_mm, round(sum(CASE WHEN rain_mm IS NOT NULL THEN n END), 4) AS normal_mm FROM daily d LEFT JOIN c ON c.district_id = d.district_id AND m = month(date) AND dd = day(date) GROUP BY ALL HAVING m IS NOT NULL")
def a11(spark, d):
    return N.day_matched(A.daily(spark, d), "rain_mm", BASE).select("district_id", "year", "month", r4(F.col("rain_mm"), "rain_mm"), r4(F.col("normal"), "normal_mm"))


def _smooth_sql(half: int) -> str:
    return f"""{with_(DAILY)}, c AS (SELECT district_id, CAST(dayofyear(date) AS INT) AS doy, avg(tmax_c) AS n FROM daily WHERE year(date) BETWEEN 1995 AND 1998 GROUP BY ALL)
SELECT b.district_id, b.doy, round(avg(o.n), 4) AS normal FROM c b JOIN (SELECT c.district_id, ((doy - 1 + k + 366) % 366) + 1 AS doy, n FROM c, generate_series(-{half}, {half}) g(k)) o ON o.district_id = b.district_id AND o.doy = b.doy GROUP BY ALL"""


@query("a12_doy_smooth_5", _smooth_sql(2))
def a12(spark, d):
    return N.doy_normal(A.daily(spark, d), "tmax_c", BASE, 2).select("district_id", "doy", r4(F.col("normal"), "normal"))


@query("a13_doy_smooth_15", _smooth_sql(7))
def a13(spark, d):
    return N.doy_normal(A.daily(spark, d), "tmax_c", BASE, 7).select("district_id", "doy", r4(F.col("normal"), "normal"))


@query("a14_effective_count", "SELECT l_suppkey, round(1.0 / sum(power(l_quantity / t, 2)), 6) AS effective FROM (SELECT *, sum(l_quantity) OVER (PARTITION BY l_suppkey) AS t FROM lineitem) GROUP BY 1")
def a14(spark, d):
    x = F.col("l_quantity")
    return A.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(F.try_divide(F.pow(F.sum(x), 2), F.sum(x * x)), 6).alias("effective"))


@query("a15_reference_moments", f"{with_(DAILY, MONTHLY)} SELECT district_id, CAST(month(month) AS INT) AS m, round(avg(rain_mm), 4) AS mean, round(stddev_samp(rain_mm), 4) AS sd FROM monthly WHERE year(month) BETWEEN 1995 AND 1998 GROUP BY ALL")
def a15(spark, d):
    m = monthly(spark, d).where(F.year("month").between(*BASE))
    return m.groupBy("district_id", F.month("month").alias("m")).agg(r4(F.avg("rain_mm"), "mean"), r4(F.stddev_samp("rain_mm"), "sd"))


@query("a16_product", "SELECT l_orderkey, round(product(1 - l_discount), 6) AS kept FROM lineitem GROUP BY 1")
def a16(spark, d):
    return A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.product(1 - F.col("l_discount")), 6).alias("kept"))


@query("a17_a18_text_extremes_and_counts", "SELECT n_name, min(c_mktsegment) AS first_segment, max(c_mktsegment) AS last_segment, CAST(count(*) FILTER (c_acctbal < 0) AS BIGINT) AS overdrawn FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def a17(spark, d):
    c = A.table(spark, d, "customer").join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.groupBy("n_name").agg(F.min("c_mktsegment").alias("first_segment"), F.max("c_mktsegment").alias("last_segment"), F.count_if(F.col("c_acctbal") < 0).alias("overdrawn"))


@query("a19_matched_basis", f"{with_(DAILY, MONTHLY, REGISTRY)}, y AS (SELECT a.district_id, a.month, a.rain_mm AS now, b.rain_mm AS ly, area, state FROM monthly a JOIN registry USING (district_id) LEFT JOIN monthly b ON b.district_id = a.district_id AND b.month = a.month - INTERVAL 1 YEAR) SELECT state, {day('month')} AS month, round(100.0 * sum(CASE WHEN ly > 0 AND now IS NOT NULL THEN area END) / sum(area), 4) AS basis_pct, CASE WHEN sum(CASE WHEN ly > 0 AND now IS NOT NULL THEN area END) >= 0.5 * sum(area) THEN round(100.0 * (sum(CASE WHEN ly > 0 AND now IS NOT NULL THEN now END) / sum(CASE WHEN ly > 0 AND now IS NOT NULL THEN ly END) - 1), 4) END AS yoy_pct FROM y GROUP BY state, month")
def a19(spark, d):
    m = monthly(spark, d)
    ly = m.select("district_id", F.add_months("month", 12).alias("month"), F.col("rain_mm").alias("ly"))
    y = m.join(ly, ["district_id", "month"], "left").join(A.registry(spark, d), "district_id")
    ok = (F.col("ly") > 0) & F.col("rain_mm").isNotNull()
    s = lambda c: F.sum(F.when(ok, F.col(c)))
    g = y.groupBy("state", "month").agg(r4(F.lit(100.0) * s("area") / F.sum("area"), "basis_pct"), F.when(s("area") >= F.lit(0.5) * F.sum("area"), F.round(F.lit(100.0) * (s("rain_mm") / s("ly") - 1), 4)).alias("yoy_pct"))
    return g.select("state", txt("month"), "basis_pct", "yoy_pct")


@query("a20_weighted_pace", "SELECT l_returnflag, round(sum((l_tax - l_discount) * (l_quantity + 1)) / sum(l_quantity + 1), 6) AS pace FROM lineitem GROUP BY 1")
def a20(spark, d):
    w = F.col("l_quantity") + 1
    return A.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(weighted_mean(F.col("l_tax") - F.col("l_discount"), w), 6).alias("pace"))


@query("a21_fit_statistics", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS r, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(avg(abs(l_discount - l_tax)), 6) AS mae, round(avg(l_discount - l_tax), 6) AS bias, round(sqrt(avg(power(l_discount - l_tax, 2))), 6) AS rmse FROM lineitem GROUP BY 1")
def a21(spark, d):
    e = F.col("l_discount") - F.col("l_tax")
    return A.table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"), r4(F.regr_slope("l_extendedprice", "l_quantity"), "slope"), F.round(F.avg(F.abs(e)), 6).alias("mae"), F.round(F.avg(e), 6).alias("bias"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("a22_relative_spread", f"{with_(DAILY, MONTHLY)} SELECT district_id, CASE WHEN count(*) FILTER (tmax_c + tmin_c <> 0) >= 5 THEN round(avg(CASE WHEN tmax_c + tmin_c <> 0 THEN abs(tmax_c - tmin_c) / ((tmax_c + tmin_c) / 2) END) * 100, 4) END AS spread_pct, CASE WHEN count(*) FILTER (tmax_c IS NOT NULL AND tmin_c IS NOT NULL) > 2 THEN round(corr(tmax_c, tmin_c), 4) END AS r FROM monthly GROUP BY 1")
def a22(spark, d):
    a, b = F.col("tmax_c"), F.col("tmin_c")
    ok = (a + b) != 0
    return monthly(spark, d).groupBy("district_id").agg(F.when(F.count_if(ok) >= 5, F.round(F.avg(F.when(ok, F.abs(a - b) / ((a + b) / 2))) * 100, 4)).alias("spread_pct"), F.when(F.count_if(a.isNotNull() & b.isNotNull()) > 2, F.round(correlation(a, b), 4)).alias("r"))


@query("a23_quantiles", f"SELECT l_shipdate_year, {', '.join(f'round(quantile_cont(CAST(l_extendedprice AS DOUBLE), {q}), 4) AS p{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99))} FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS l_shipdate_year FROM lineitem) GROUP BY 1")
def a23(spark, d):
    items = A.table(spark, d, "lineitem").withColumn("l_shipdate_year", F.year("l_shipdate"))
    wanted = [0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99]
    return exact_quantiles(items, ["l_shipdate_year"], "l_extendedprice", wanted).select("l_shipdate_year", *[r4(F.col("q")[i], f"p{int(q * 100)}") for i, q in enumerate(wanted)])


@query("a24_median_fill", f"{with_(DAILY, MONTHLY, REGISTRY)} SELECT district_id, {day('month')} AS month, round(coalesce(rain_mm, quantile_cont(rain_mm, 0.5) OVER (PARTITION BY state, month)), 4) AS filled FROM monthly JOIN registry USING (district_id)")
def a24(spark, d):
    m = monthly(spark, d).join(A.registry(spark, d), "district_id")
    medians = m.groupBy("state", "month").agg(F.percentile("rain_mm", 0.5).alias("median"))
    return m.join(medians, ["state", "month"]).select("district_id", txt("month"), r4(F.coalesce("rain_mm", "median"), "filled"))


@query("a25_value_share", "SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0e0 / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def a25(spark, d):
    n = A.table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.select("event_type", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


@query("a26_first_per_key", "SELECT o_custkey, o_orderkey AS first_order, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def a26(spark, d):
    o = A.table(spark, d, "orders")
    first = o.groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey", "o_orderpriority")).alias("f"))
    return first.select("o_custkey", F.col("f.o_orderkey").alias("first_order"), "f.o_orderpriority")


@query("a27_null_rates", f"{with_(DAILY)}, p AS (SELECT CASE WHEN year(date) <= 1998 THEN 'train' ELSE 'test' END AS part, avg(CAST(rain_mm IS NULL AS INT)) AS rain_mm, avg(CAST(tmax_c IS NULL AS INT)) AS tmax_c FROM daily GROUP BY 1) SELECT column_name, round(max(CASE WHEN part = 'train' THEN v END), 6) AS train, round(max(CASE WHEN part = 'test' THEN v END), 6) AS test FROM (UNPIVOT p ON rain_mm, tmax_c INTO NAME column_name VALUE v) GROUP BY 1")
def a27(spark, d):
    part = F.when(F.year("date") <= 1998, "train").otherwise("test")
    p = A.daily(spark, d).groupBy(part.alias("part")).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in ("rain_mm", "tmax_c")])
    long = p.unpivot(["part"], ["rain_mm", "tmax_c"], "column_name", "v")
    return long.groupBy("column_name").agg(*[F.round(F.max(F.when(F.col("part") == k, F.col("v"))), 6).alias(k) for k in ("train", "test")])


@query("a28_degenerate_columns", "SELECT 'l_linestatus' AS name, CAST(count(l_linestatus) AS BIGINT) AS n, CAST(count(DISTINCT l_linestatus) AS BIGINT) AS kinds FROM lineitem UNION ALL SELECT 'l_tax', count(l_tax), count(DISTINCT l_tax) FROM lineitem")
def a28(spark, d):
    one = A.table(spark, d, "lineitem").agg(*[f(c).alias(f"{c}.{k}") for c in ("l_linestatus", "l_tax") for k, f in (("n", F.count), ("kinds", F.countDistinct))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"`{c}.n`").alias("n"), F.col(f"`{c}.kinds`").alias("kinds")) for c in ("l_linestatus", "l_tax")])).alias("s")).select("s.*")


@query("a29_argmax_month", f"{with_(DAILY, MONTHLY)} SELECT district_id, CAST(year(month) AS INT) AS year, CAST(month(arg_max(month, (rain_mm, -month(month)))) AS INT) AS wettest FROM monthly WHERE rain_mm IS NOT NULL GROUP BY ALL")
def a29(spark, d):
    m = monthly(spark, d).where("rain_mm is not null")
    return m.groupBy("district_id", F.year("month").alias("year")).agg(F.month(F.max_by("month", F.struct("rain_mm", -F.month("month")))).alias("wettest"))


@query("a34_ensemble_statistics", "WITH m AS (SELECT l_suppkey, l_linenumber AS member, sum(l_extendedprice * l_quantity) / sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, round(avg(v), 4) AS mean, round(quantile_cont(CAST(v AS DOUBLE), 0.1), 4) AS p10, round(quantile_cont(CAST(v AS DOUBLE), 0.9), 4) AS p90, round(stddev_samp(v), 4) AS sd, CAST(count(*) AS BIGINT) AS members FROM m GROUP BY 1")
def a34(spark, d):
    m = A.table(spark, d, "lineitem").groupBy("l_suppkey", F.col("l_linenumber").alias("member")).agg(weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")).alias("v"))
    return m.groupBy("l_suppkey").agg(r4(F.avg("v"), "mean"), r4(F.percentile("v", 0.1), "p10"), r4(F.percentile("v", 0.9), "p90"), r4(F.stddev_samp("v"), "sd"), F.count(F.lit(1)).alias("members"))


def _w(body: str, extra: str = "") -> str:
    return f"{with_(DAILY)} SELECT district_id, {day()} AS date, {body} FROM daily {extra}"


O = "OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query("w01_rolling_sum_strict", _w(", ".join(f"CASE WHEN count(rain_mm) {O.format(h - 1)} = {h} THEN round(sum(rain_mm) {O.format(h - 1)}, 4) END AS rain_{h}" for h in (7, 14, 30))))
def w01(spark, d):
    w = W.series()
    return A.daily(spark, d).select("district_id", txt(), *[r4(W.rolling_sum(F.col("rain_mm"), w, h), f"rain_{h}") for h in (7, 14, 30)])


@query("w02_rolling_sum_half", _w(", ".join(f"CASE WHEN count(rain_mm) {O.format(h - 1)} >= {max(3, h // 2)} THEN round(sum(rain_mm) {O.format(h - 1)}, 4) END AS rain_{h}" for h in (7, 30))))
def w02(spark, d):
    w = W.series()
    return A.daily(spark, d).select("district_id", txt(), *[r4(W.rolling_sum(F.col("rain_mm"), w, h, max(3, h // 2)), f"rain_{h}") for h in (7, 30)])


FWD = "OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)"


@query("w03_forward_sum", _w(f"CASE WHEN count(rain_mm) {FWD} = 7 THEN round(sum(rain_mm) {FWD}, 4) END AS next_7"))
def w03(spark, d):
    return A.daily(spark, d).select("district_id", txt(), r4(W.forward_sum(F.col("rain_mm"), W.series(), 7), "next_7"))


@query("w04_rolling_months", f"{with_(DAILY, MONTHLY)} SELECT district_id, {day('month')} AS month, " + ", ".join(f"CASE WHEN count(rain_mm) OVER w{s} = {s} THEN round(sum(rain_mm) OVER w{s}, 4) END AS sum_{s}" for s in (1, 4, 12)) + " FROM monthly WINDOW " + ", ".join(f"w{s} AS (PARTITION BY district_id ORDER BY month ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)" for s in (1, 4, 12)))
def w04(spark, d):
    w = W.series("district_id", "month")
    return monthly(spark, d).select("district_id", txt("month"), *[r4(W.rolling_sum(F.col("rain_mm"), w, s), f"sum_{s}") for s in (1, 4, 12)])


@query("w05_season_to_date", _w("CASE WHEN month(date) BETWEEN 6 AND 12 THEN round(coalesce(sum(rain_mm) OVER (PARTITION BY district_id, year(date) - CAST(month(date) < 6 AS INT) ORDER BY date), 0), 4) END AS season"))
def w05(spark, d):
    season = F.year("date") - (F.month("date") < 6).cast("int")
    w = Window.partitionBy("district_id", season).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return A.daily(spark, d).select("district_id", txt(), F.when(F.month("date").between(6, 12), F.round(F.coalesce(F.sum("rain_mm").over(w), F.lit(0.0)), 4)).alias("season"))


@query("w06_w07_running_peak_and_increment", f"{with_(DAILY, MONTHLY)} SELECT district_id, {day('month')} AS month, round(max(rain_mm) OVER w, 4) AS peak, round(greatest(0, coalesce(rain_mm - lag(rain_mm) OVER w, rain_mm)), 4) AS step FROM monthly WHERE rain_mm IS NOT NULL WINDOW w AS (PARTITION BY district_id ORDER BY month)")
def w06(spark, d):
    w = W.series("district_id", "month")
    m = monthly(spark, d).where("rain_mm is not null")
    return m.select("district_id", txt("month"), r4(F.max("rain_mm").over(w), "peak"), r4(clip(F.coalesce(F.col("rain_mm") - F.lag("rain_mm").over(w), "rain_mm"), 0), "step"))


@query("w08_lag_difference", f"{with_(INDEX)} SELECT year, month, round(idx - lag(idx, 3) OVER w, 6) AS tend_3, round(idx - lag(idx, 6) OVER w, 6) AS tend_6 FROM idx WINDOW w AS (ORDER BY year, month)")
def w08(spark, d):
    w = Window.partitionBy(F.lit(0)).orderBy("year", "month")  # one row a month
    return A.national_index(spark, d).select("year", "month", *[F.round(F.col("idx") - F.lag("idx", k).over(w), 6).alias(f"tend_{k}") for k in (3, 6)])


@query("w09_run_flags", f"{with_(INDEX)} SELECT year, month, CAST(sum(CAST(idx >= 0.5 AS INT)) OVER w = 2 AND count(idx) OVER w = 2 AS INT) AS warm, CAST(sum(CAST(idx <= -0.5 AS INT)) OVER w = 2 AND count(idx) OVER w = 2 AS INT) AS cold FROM idx WINDOW w AS (ORDER BY year, month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)")
def w09(spark, d):
    w = Window.partitionBy(F.lit(0)).orderBy("year", "month")
    return A.national_index(spark, d).select("year", "month", W.run_flag(F.col("idx") >= 0.5, w, 2).alias("warm"), W.run_flag(F.col("idx") <= -0.5, w, 2).alias("cold"))


@query("w10_trailing_run", f"{with_(DAILY)}, b AS (SELECT district_id, max(CASE WHEN NOT coalesce(rain_mm > 20, false) THEN date END) AS last FROM daily GROUP BY 1) SELECT d.district_id, CAST(sum(CAST(last IS NULL OR date > last AS INT)) AS BIGINT) AS run FROM daily d JOIN b USING (district_id) GROUP BY 1")
def w10(spark, d):
    return W.trailing_run(A.daily(spark, d), F.col("rain_mm") > 20, ["district_id"], "date")


@query("w11_dry_spell", f"{with_(DAILY)}, g AS (SELECT *, sum(CAST(rain_mm IS NULL OR rain_mm > 10 AS INT)) OVER (PARTITION BY district_id ORDER BY date) AS grp FROM daily) SELECT district_id, {day()} AS date, CASE WHEN rain_mm IS NOT NULL THEN CAST(sum(CAST(rain_mm <= 10 AS INT)) OVER (PARTITION BY district_id, grp ORDER BY date) AS BIGINT) END AS dry_days FROM g")
def w11(spark, d):
    return W.dry_spell(A.daily(spark, d), "rain_mm", ["district_id"], "date", 10.0).select("district_id", txt(), "dry_days")


@query("w12_since_last_wet", f"{with_(DAILY)}, n AS (SELECT *, row_number() OVER (PARTITION BY district_id ORDER BY date) AS i FROM daily) SELECT district_id, {day()} AS date, CAST(i - last_value(CASE WHEN rain_mm > 20 THEN i END IGNORE NULLS) OVER (PARTITION BY district_id ORDER BY date) AS BIGINT) AS since FROM n")
def w12(spark, d):
    w = W.series()
    n = A.daily(spark, d).withColumn("i", F.row_number().over(w))
    return n.select("district_id", txt(), (F.col("i") - F.last(F.when(F.col("rain_mm") > 20, F.col("i")), ignorenulls=True).over(w)).cast("long").alias("since"))


@query("w15_latest_per_group", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1")
def w15(spark, d):
    last = A.table(spark, d, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e"))
    return last.select("user_id", "e.*")


@query("w17_percent_rank", "SELECT s_suppkey, round((rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY s_nationkey, s_acctbal) - 1) / 2.0e0) / count(*) OVER (PARTITION BY s_nationkey), 6) AS pct FROM supplier")
def w17(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", F.round(W.percent_rank_average("s_acctbal", ["s_nationkey"]), 6).alias("pct"))


@query("w18_w20_group_mean_and_share", f"{with_(DAILY, MONTHLY, REGISTRY)} SELECT district_id, {day('month')} AS month, round(rain_mm / avg(rain_mm) OVER (PARTITION BY state, month), 6) AS over_state, round(rain_mm / sum(rain_mm) OVER (PARTITION BY month), 6) AS share FROM monthly JOIN registry USING (district_id)")
def w18(spark, d):
    m = monthly(spark, d).join(A.registry(spark, d), "district_id")
    x = F.col("rain_mm")
    return m.select("district_id", txt("month"), F.round(x / F.avg(x).over(Window.partitionBy("state", "month")), 6).alias("over_state"), F.round(x / F.sum(x).over(Window.partitionBy("month")), 6).alias("share"))


@query("w22_decile_bins", "WITH e AS (SELECT quantile_cont(CAST(l_extendedprice AS DOUBLE), [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM lineitem) SELECT CAST(len([x for x in q if l_extendedprice >= x]) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(l_quantity), 4) AS mean FROM lineitem, e GROUP BY 1 HAVING count(*) >= 100")
def w22(spark, d):
    items = A.table(spark, d, "lineitem")
    edges = exact_quantiles(items, [], "l_extendedprice", [i / 10 for i in range(1, 10)]).first()  # nine numbers
    q = F.array(*[F.lit(e) for e in (edges.q if edges else [])])
    at = items.select(F.size(F.filter(q, lambda x: F.col("l_extendedprice") >= x)).alias("bin"), "l_quantity")
    return at.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), r4(F.avg("l_quantity"), "mean")).where("n >= 100")


@query("w24_wet_and_extreme_days", f"{with_(DAILY)}, p AS (SELECT district_id, quantile_cont(rain_mm, 0.95) AS p95 FROM daily WHERE rain_mm > 1 GROUP BY 1) SELECT d.district_id, {day()} AS date, CAST(sum(CAST(coalesce(rain_mm > 1, false) AS INT)) OVER w AS BIGINT) AS wet30, CAST(sum(CAST(coalesce(rain_mm > p95, false) AS INT)) OVER w AS BIGINT) AS extreme30 FROM daily d LEFT JOIN p USING (district_id) WINDOW w AS (PARTITION BY d.district_id ORDER BY date ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)")
def w24(spark, d):
    x = A.daily(spark, d)
    p95 = exact_quantiles(x.where("rain_mm > 1"), ["district_id"], "rain_mm", [0.95]).select("district_id", F.col("q")[0].alias("p95"))
    w = W.series().rowsBetween(-29, 0)
    count = lambda c, n: F.sum(F.coalesce(c, F.lit(False)).cast("int")).over(w).alias(n)
    return x.join(p95, "district_id", "left").select("district_id", txt(), count(F.col("rain_mm") > 1, "wet30"), count(F.col("rain_mm") > F.col("p95"), "extreme30"))


@query("w25_interior_holes", "WITH o AS (SELECT DISTINCT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders), b AS (SELECT o_custkey, min(m) AS a, max(m) AS z FROM o GROUP BY 1) SELECT b.o_custkey, CAST(datediff('month', a, z) + 1 - count(*) AS BIGINT) AS holes FROM b JOIN o USING (o_custkey) GROUP BY b.o_custkey, a, z")
def w25(spark, d):
    o = A.table(spark, d, "orders").select("o_custkey", F.trunc("o_orderdate", "MM").alias("m")).distinct()
    b = o.groupBy("o_custkey").agg(F.min("m").alias("a"), F.max("m").alias("z"), F.count(F.lit(1)).alias("n"))
    return b.select("o_custkey", (F.round(F.months_between("z", "a")) + 1 - F.col("n")).cast("long").alias("holes"))


@query("p02_p03_guarded_values", "SELECT p_partkey, CASE WHEN p_size >= 5 THEN round((p_retailprice - p_size) / p_size * 100, 4) END AS pct, least(greatest(p_size, 10), 40) AS clipped FROM part")
def p02(spark, d):
    return A.table(spark, d, "part").select("p_partkey", r4(percent_departure(F.col("p_retailprice"), F.col("p_size")), "pct"), clip(F.col("p_size").cast("double"), 10, 40).cast("int").alias("clipped"))


@query("p06_issue_dates", f"{with_(DAILY)} SELECT district_id, {day()} AS date FROM daily WHERE dayofyear(date) % 5 = 0 AND year(date) >= 1997")
def p06(spark, d):
    return A.daily(spark, d).where((F.dayofyear("date") % 5 == 0) & (F.year("date") >= 1997)).select("district_id", txt())


@query("p10_bounded_fill", f"{with_(DAILY)} SELECT district_id, {day()} AS date, round(last_value(rain_mm IGNORE NULLS) OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS rain_mm, CAST(rain_mm IS NULL AND last_value(rain_mm IGNORE NULLS) OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) IS NOT NULL AS INT) AS persisted FROM daily")
def p10(spark, d):
    filled = W.bounded_fill(F.col("rain_mm"), W.series(), 3)
    return A.daily(spark, d).select("district_id", txt(), r4(filled, "rain_mm"), (F.col("rain_mm").isNull() & filled.isNotNull()).cast("int").alias("persisted"))


@query("f09_f10_categories", f"{with_(DAILY, MONTHLY, NORMAL)}, x AS (SELECT monthly.district_id, month, CASE WHEN normal_mm >= 5 THEN (rain_mm - normal_mm) / normal_mm * 100 END AS v FROM monthly LEFT JOIN normal ON normal.district_id = monthly.district_id AND m = month(month)) SELECT district_id, {day('month')} AS month, CASE WHEN v IS NOT NULL THEN CAST(v >= -60 AS INT) + CAST(v >= -20 AS INT) + CAST(v >= 20 AS INT) + CAST(v >= 60 AS INT) END AS category FROM x")
def f09(spark, d):
    m = N.with_normal(monthly(spark, d), ["rain_mm"], BASE)
    return m.select("district_id", txt("month"), categories(percent_departure(F.col("rain_mm"), F.col("rain_mm_normal")), [-60, -20, 20, 60]).alias("category"))
