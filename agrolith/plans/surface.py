"""Text, date and status functions, month-to-date, allocation, payloads and the dashboard's queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip, percent_departure
from agrolith.operators import normals as N
from agrolith.operators import ocean
from agrolith.operators.joins import normalised
from agrolith.plans.climate import BASE, NORMAL, monthly, txt
from agrolith.plans.domain import COUNTERS, STATE, counters
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, INDEX, MONTHLY, day, with_
from agrolith.sources import adapters as A
from agrolith.sources import sinks

LETTERS = "trim(regexp_replace(regexp_replace(upper({}), '[^A-Z]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("f01_text_functions", f"SELECT p_partkey, {LETTERS.format('p_type')} AS norm, replace(lower(trim(p_type)), ' ', '-') AS slug, CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS digits, CAST(regexp_matches(p_type, '(?i)^(std|eco)') AS INT) AS prefixed, len(list_distinct(string_split(lower(p_type || ' ' || p_name), ' '))) AS words FROM part")
def f01(spark, d):
    words = F.size(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "p_type", "p_name")), " "))).cast("long")
    return A.table(spark, d, "part").select("p_partkey", normalised(F.col("p_type")).alias("norm"), F.regexp_replace(F.lower(F.trim("p_type")), " ", "-").alias("slug"), F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("digits"), F.col("p_type").rlike("(?i)^(std|eco)").cast("int").alias("prefixed"), words.alias("words"))


@query("f02_date_functions", "SELECT o_orderkey, strftime(date_trunc('month', o_orderdate), '%Y-%m') AS ym, CAST(dayofyear(o_orderdate) AS INT) AS doy, CAST(day(last_day(o_orderdate)) AS INT) AS dim, strftime(CAST(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH AS DATE), '%Y-%m-%d') AS prev, CASE WHEN month(o_orderdate) BETWEEN 6 AND 9 THEN 'Kharif' WHEN month(o_orderdate) >= 10 OR month(o_orderdate) = 1 THEN 'Rabi' ELSE 'Summer' END AS season, CAST(year(o_orderdate) - CAST(month(o_orderdate) <= 4 AS INT) AS INT) AS rabi_year, CAST(year(o_orderdate) + CAST(month(o_orderdate) = 12 AS INT) AS INT) AS djf_year FROM orders")
def f02(spark, d):
    t = F.col("o_orderdate").cast("date")
    m = F.month(t)
    return A.table(spark, d, "orders").select(
        "o_orderkey", F.date_format(t, "yyyy-MM").alias("ym"), F.dayofyear(t).alias("doy"), F.dayofmonth(F.last_day(t)).alias("dim"), F.add_months(F.trunc(t, "MM"), -1).cast("string").alias("prev"),
        F.when(m.between(6, 9), "Kharif").when((m >= 10) | (m == 1), "Rabi").otherwise("Summer").alias("season"), (F.year(t) - (m <= 4).cast("int")).alias("rabi_year"), (F.year(t) + (m == 12).cast("int")).alias("djf_year"),
    )


@query("f12_f14_verdicts", f"{with_(INDEX, STATE)} SELECT year, month, CASE WHEN abs(idx) * 4 <= 2 THEN 'matches' WHEN abs(idx) * 4 <= 6 THEN 'close' ELSE 'DIVERGES' END AS verdict, CASE WHEN phase <> 'Neutral' THEN phase WHEN idx >= 0.5 THEN 'Warm, developing' WHEN idx <= -0.5 THEN 'Cold, developing' ELSE 'Neutral' END AS status FROM state")
def f12(spark, d):
    s = ocean.state(A.national_index(spark, d), run=2)
    x = F.col("idx")
    verdict = F.when(F.abs(x) * 4 <= 2, "matches").when(F.abs(x) * 4 <= 6, "close").otherwise("DIVERGES")
    return s.select("year", "month", verdict.alias("verdict"), F.when(F.col("phase") != "Neutral", F.col("phase")).when(x >= 0.5, "Warm, developing").when(x <= -0.5, "Cold, developing").otherwise("Neutral").alias("status"))


BOUNDS = [("l_quantity", 1.0, 45.0), ("l_discount", 0.0, 0.1), ("l_tax", 0.0, 0.07)]


@query("p17_range_checks", "SELECT name, CAST(sum(CAST(v < lo - 1e-6 OR v > hi + 1e-6 AS INT)) AS BIGINT) AS outside, min(v) AS lowest, max(v) AS highest FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, {c} AS v, {lo} AS lo, {hi} AS hi FROM lineitem" for c, lo, hi in BOUNDS) + ") GROUP BY 1")
def p17(spark, d):
    one = A.table(spark, d, "lineitem").agg(*[F.struct(F.lit(c).alias("name"), F.count_if((F.col(c) < lo - 1e-6) | (F.col(c) > hi + 1e-6)).alias("outside"), F.min(c).alias("lowest"), F.max(c).alias("highest")).alias(c) for c, lo, hi in BOUNDS])
    return one.select(F.explode(F.array(*[F.col(c) for c, _, _ in BOUNDS])).alias("s")).select("s.*")


@query("p12_completeness_mask", f"{with_(DAILY, MONTHLY)} SELECT district_id, {day('month')} AS month, CASE WHEN days >= 5 THEN round(rain_mm, 4) END AS rain_mm, CASE WHEN days >= 5 AND tmax_c > 45 THEN round(tmax_c, 4) END AS tmax_c FROM monthly")
def p12(spark, d):
    m = monthly(spark, d)
    flags = {"rain": F.col("days") >= 5, "heat": F.col("tmax_c") > 45}
    needs = {"rain_mm": ["rain"], "tmax_c": ["rain", "heat"]}
    out = ["district_id", txt("month")]
    for c, names in needs.items():
        ok = F.lit(True)
        for n in names:
            ok = ok & flags[n]
        out.append(F.when(ok, F.round(c, 4)).alias(c))
    return m.select(*out)


@query("s22_registry_from_records", "SELECT CAST(row_number() OVER (ORDER BY state, district) - 1 AS INT) AS district_id, state, district, area, is_flagged FROM (SELECT trim(regexp_replace(r_name, '\\s+', ' ', 'g')) AS state, trim(regexp_replace(n_name, '\\s+', ' ', 'g')) AS district, CAST(sum(c_custkey) AS BIGINT) AS area, CAST(max(CAST(regexp_matches(n_name, '(?i)^(i|j)') AS INT)) AS INT) AS is_flagged FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)")
def s22(spark, d):
    clean = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    n = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = A.table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    g = x.groupBy(clean("r_name").alias("state"), clean("n_name").alias("district")).agg(F.sum("c_custkey").alias("area"), F.max(F.col("n_name").rlike("(?i)^(i|j)").cast("int")).alias("is_flagged"))
    return g.select((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("state", "district")) - 1).alias("district_id"), "state", "district", "area", "is_flagged")


@query("d11_monthly_sown_area", f"WITH {COUNTERS}, m AS (SELECT brand, year(week) AS y, month(week) AS m, max(area) AS top FROM counter WHERE quarter(week) <= 2 GROUP BY ALL), c AS (SELECT *, max(top) OVER (PARTITION BY brand, y ORDER BY m) AS peak FROM m) SELECT brand, CAST(y AS INT) AS year, CAST(m AS INT) AS month, peak, greatest(0, coalesce(peak - lag(peak) OVER (PARTITION BY brand, y ORDER BY m), peak)) AS sown FROM c")
def d11(spark, d):
    m = counters(spark, d).where(F.quarter("week") <= 2).groupBy("brand", F.year("week").alias("year"), F.month("week").alias("month")).agg(F.max("area").alias("top"))
    w = Window.partitionBy("brand", "year").orderBy("month")
    c = m.withColumn("peak", F.max("top").over(w))
    return c.select("brand", "year", "month", "peak", clip(F.coalesce(F.col("peak") - F.lag("peak").over(w), "peak"), 0).alias("sown"))


@query("d23_definition_checks", f"{with_(DAILY, MONTHLY, NORMAL)}, x AS (SELECT monthly.*, normal_mm, CASE WHEN normal_mm >= 5 THEN (rain_mm - normal_mm) / normal_mm * 100 END AS dep FROM monthly LEFT JOIN normal ON normal.district_id = monthly.district_id AND m = month(month)) SELECT 'departure_null_below_floor' AS name, CAST(count(*) FILTER (normal_mm < 5 AND dep IS NOT NULL) AS BIGINT) AS violations FROM x UNION ALL SELECT 'departure_at_least_minus_100', count(*) FILTER (dep < -100) FROM x UNION ALL SELECT 'tmax_not_below_tmin', count(*) FILTER (tmax_c < tmin_c) FROM x UNION ALL SELECT 'wet_months', count(*) FILTER (rain_mm > 300) FROM x")
def d23(spark, d):
    x = N.with_normal(monthly(spark, d), ["rain_mm"], BASE).withColumn("dep", percent_departure(F.col("rain_mm"), F.col("rain_mm_normal")))
    checks = {"departure_null_below_floor": (F.col("rain_mm_normal") < 5) & F.col("dep").isNotNull(), "departure_at_least_minus_100": F.col("dep") < -100, "tmax_not_below_tmin": F.col("tmax_c") < F.col("tmin_c"), "wet_months": F.col("rain_mm") > 300}
    one = x.agg(*[F.struct(F.lit(n).alias("name"), F.count_if(c).alias("violations")).alias(n) for n, c in checks.items()])
    return one.select(F.explode(F.array(*[F.col(n) for n in checks])).alias("s")).select("s.*")


@query("x09_served_forecast", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(least(greatest((s_acctbal / 50 - 20) * least(greatest(0.5e0 + 0.5e0 * (s_nationkey / 10.0e0), 0.3e0), 2), -100), 1000), 7) END AS forecast FROM supplier")
def x09(spark, d):
    b = clip(0.5 + 0.5 * (F.col("s_nationkey") / 10.0), 0.3, 2)
    return A.table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_acctbal") > 0, F.round(clip((F.col("s_acctbal") / 50 - 20) * b, -100, 1000), 7)).alias("forecast"))


@query("q06_district_briefing", f"{with_(DAILY, MONTHLY)}, l AS (UNPIVOT (SELECT district_id, month, rain_mm, tmax_c, tmin_c FROM monthly) ON rain_mm, tmax_c, tmin_c INTO NAME layer VALUE v) SELECT district_id, layer, strftime(max(month), '%Y-%m-%d') AS as_of, round(arg_max(v, month), 4) AS v FROM l GROUP BY 1, 2")
def q06(spark, d):
    long = monthly(spark, d).unpivot(["district_id", "month"], ["rain_mm", "tmax_c", "tmin_c"], "layer", "v").where("v is not null")
    return long.groupBy("district_id", "layer").agg(F.max("month").cast("string").alias("as_of"), F.round(F.max_by("v", "month"), 4).alias("v"))


@query("q08_q11_selectors", "SELECT model, rank, rmse FROM (SELECT *, CAST(row_number() OVER (ORDER BY rmse, model) AS INT) AS rank FROM (SELECT o_orderpriority AS model, round(sqrt(avg(power(o_totalprice - 100000, 2))), 3) AS rmse FROM orders GROUP BY 1)) WHERE rank <= 3")
def q08(spark, d):
    e = F.col("o_totalprice") - 100000
    m = A.table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.round(F.sqrt(F.avg(e * e)), 3).alias("rmse"))
    return m.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rmse", "model"))).where("rank <= 3").select("model", "rank", "rmse")


@query("k05_layer_payload", f"{with_(DAILY, MONTHLY)}, l AS (UNPIVOT (SELECT district_id, month, rain_mm, tmax_c, tmin_c FROM monthly WHERE month > (SELECT max(month) FROM monthly) - INTERVAL 24 MONTH) ON rain_mm, tmax_c, tmin_c INTO NAME layer VALUE v), i AS (SELECT layer, month, string_agg('\"' || district_id || '\":' || CAST(round(v, 1) AS VARCHAR), ',' ORDER BY CAST(district_id AS VARCHAR)) AS m FROM l GROUP BY 1, 2) SELECT layer, '{{' || string_agg('\"' || {day('month')} || '\":{{' || m || '}}', ',' ORDER BY month) || '}}' AS json FROM i GROUP BY 1")
def k05(spark, d):
    """One JSON object a layer, {month: {district: value}}; its form is tested with the sinks."""
    recent = A.with_last(monthly(spark, d), "month").where("month > add_months(last, -24)")
    return sinks.layer_maps(recent.unpivot(["district_id", "month"], ["rain_mm", "tmax_c", "tmin_c"], "layer", "v"), "layer", "month", "district_id", "v")


@query("k06_positional_payload", f"{with_(DAILY)} SELECT {day()} AS date, CAST(list(round(rain_mm, 4) ORDER BY district_id) AS VARCHAR) AS v FROM daily WHERE date > (SELECT max(date) FROM daily) - INTERVAL 120 DAY GROUP BY 1")
def k06(spark, d):
    x = A.with_last(A.daily(spark, d), "date").where("date > last - 120").select("date", "district_id", F.round("rain_mm", 4).alias("v"))
    values = F.transform("values", lambda v: F.coalesce(v.cast("string"), F.lit("NULL")))
    return sinks.positional(x, "date", "district_id", "v").select(txt(), F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]")).alias("v"))


@query("w13_w14_season_starts", f"WITH {COUNTERS} SELECT brand, strftime(min(week), '%Y-%m-%d') AS start, CAST(year(min(week)) - CAST(month(min(week)) <= 3 AND quarter(min(week)) > 2 AS INT) AS INT) AS season_year, CAST(count(*) AS BIGINT) AS reports FROM counter GROUP BY brand, year(week), quarter(week) > 2")
def w13(spark, d):
    g = counters(spark, d).groupBy("brand", F.year("week").alias("y"), (F.quarter("week") > 2).alias("h")).agg(F.min("week").alias("s"), F.count(F.lit(1)).alias("reports"))
    return g.select("brand", F.col("s").cast("string").alias("start"), (F.year("s") - ((F.month("s") <= 3) & (F.quarter("s") > 2)).cast("int")).alias("season_year"), "reports")
