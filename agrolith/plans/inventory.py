"""Projections, filters, joins, rankings and reshaping, one query for each, on the daily and monthly tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip, correlation, percent_departure
from agrolith.operators import grids, indices, joins
from agrolith.operators import panel as P
from agrolith.operators import windows as W
from agrolith.plans.climate import monthly, r4, txt
from agrolith.plans.domain import COUNTERS, STATE, counters, r6
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, INDEX, MONTHLY, REGISTRY, day, with_
from agrolith.sources import adapters as A

M = with_(DAILY, MONTHLY)
PREV = "CAST({} - INTERVAL 1 MONTH AS DATE)"


@query("p01_derived_columns", f"{M} SELECT district_id, {day('month')} AS month, round(tmax_c - tmin_c, 8) AS spread, round(rain_mm - 2 * tmax_c, 6) AS balance FROM monthly")
def p01(spark, d):
    return monthly(spark, d).select("district_id", txt("month"), F.round(F.col("tmax_c") - F.col("tmin_c"), 8).alias("spread"), r6(F.col("rain_mm") - 2 * F.col("tmax_c"), "balance"))


@query("p04_month_and_year_filter", f"{M} SELECT district_id, {day('month')} AS month, round(rain_mm, 4) AS rain_mm FROM monthly WHERE month(month) IN (6, 7, 8, 9) AND year(month) BETWEEN 1996 AND 1999")
def p04(spark, d):
    m = F.month("month").isin(6, 7, 8, 9) & F.year("month").between(1996, 1999)
    return monthly(spark, d).where(m).select("district_id", txt("month"), r4(F.col("rain_mm"), "rain_mm"))


@query("p05_calendar_keys", f"{with_(DAILY)} SELECT district_id, {day()} AS date, rain_mm FROM daily WHERE (month(date), day(date)) IN (SELECT (month(o_orderdate), day(o_orderdate)) FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 31 DAY) AND rain_mm IS NOT NULL")
def p05(spark, d):
    keys = A.with_last(A.table(spark, d, "orders"), "o_orderdate").where("o_orderdate >= last - interval 31 days").select(F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("dd")).distinct()
    x = A.daily(spark, d).where("rain_mm is not null").select("district_id", "date", "rain_mm", F.month("date").alias("m"), F.dayofmonth("date").alias("dd"))
    return x.join(keys, ["m", "dd"], "left_semi").select("district_id", txt(), "rain_mm")


@query("p07_rows_without_missing", f"{with_(DAILY)} SELECT how, CAST(count(*) AS BIGINT) AS n FROM (SELECT 'any' AS how FROM daily WHERE rain_mm IS NOT NULL AND tmax_c IS NOT NULL AND tmin_c IS NOT NULL UNION ALL SELECT 'all' FROM daily WHERE rain_mm IS NOT NULL OR tmax_c IS NOT NULL OR tmin_c IS NOT NULL UNION ALL SELECT 'subset' FROM daily WHERE rain_mm IS NOT NULL) GROUP BY 1")
def p07(spark, d):
    x, c = A.daily(spark, d), ["rain_mm", "tmax_c", "tmin_c"]
    kept = {"any": x.dropna("any", subset=c), "all": x.dropna("all", subset=c), "subset": x.dropna(subset=["rain_mm"])}
    out = None
    for how, rows in kept.items():
        one = rows.select(F.lit(how).alias("how"))
        out = one if out is None else out.union(one)
    return out.groupBy("how").agg(F.count(F.lit(1)).alias("n"))


@query("p08_conditional_columns", f"{M} SELECT district_id, {day('month')} AS month, CASE WHEN rain_mm >= 200 THEN 'wet' WHEN rain_mm >= 50 THEN CASE WHEN tmax_c >= 40 THEN 'warm' ELSE 'mild' END WHEN rain_mm IS NOT NULL THEN 'dry' END AS kind FROM monthly")
def p08(spark, d):
    r = F.col("rain_mm")
    return monthly(spark, d).select("district_id", txt("month"), F.when(r >= 200, "wet").when(r >= 50, F.when(F.col("tmax_c") >= 40, "warm").otherwise("mild")).when(r.isNotNull(), "dry").alias("kind"))


@query("p09_filled_values", f"{M} SELECT district_id, {day('month')} AS month, round(coalesce(rain_mm, avg(rain_mm) OVER (PARTITION BY district_id), 0), 6) AS rain_mm, round(coalesce(tmax_c, tmin_c, -1), 6) AS t FROM monthly")
def p09(spark, d):
    mean = F.avg("rain_mm").over(Window.partitionBy("district_id"))
    return monthly(spark, d).select("district_id", txt("month"), r6(F.coalesce("rain_mm", mean, F.lit(0.0)), "rain_mm"), r6(F.coalesce("tmax_c", "tmin_c", F.lit(-1.0)), "t"))


@query("p11_last_wet_day", f"{with_(DAILY)} SELECT district_id, {day()} AS date, {day("max(CASE WHEN rain_mm > 1 THEN date END) OVER (PARTITION BY district_id ORDER BY date)")} AS last_wet FROM daily")
def p11(spark, d):
    last = F.last(F.when(F.col("rain_mm") > 1, F.col("date")), True).over(W.series())
    return A.daily(spark, d).select("district_id", txt(), last.cast("string").alias("last_wet"))


@query("p13_columns_by_suffix", f"{M} SELECT district_id, {day('month')} AS month, round(tmax_c, 8) AS tmax_c, round(tmin_c, 8) AS tmin_c FROM monthly")
def p13(spark, d):
    m = monthly(spark, d)
    return m.select("district_id", txt("month"), *[F.round(c, 8).alias(c) for c in P.ending_with(m, "_c")])


@query("p14_p15_renamed_and_constant", "SELECT r_name AS state, r_regionkey AS id, 'v1' AS version, (SELECT count(*) FROM nation) AS districts FROM region")
def p14(spark, d):
    n = A.table(spark, d, "nation").agg(F.count(F.lit(1)).alias("districts"))
    r = A.table(spark, d, "region").withColumnsRenamed({"r_name": "state", "r_regionkey": "id"}).withColumn("version", F.lit("v1"))
    return r.join(n, F.lit(True)).select("state", "id", "version", "districts")


@query("p16_search", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE contains(lower(n_name || ' ' || r_name), 'an')")
def p16(spark, d):
    n = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.where(F.contains(F.lower(F.concat_ws(" ", "n_name", "r_name")), F.lit("an"))).select("n_nationkey", "n_name", "r_name")


@query("p18_rounded_numbers", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, round(o_totalprice / 7, 3) AS share FROM orders")
def p18(spark, d):
    x = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), (F.col("o_totalprice") / 7).alias("share"))
    return P.rounded(x, 3)


@query("p19_downcast", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS TINYINT) AS quantity, round(CAST(CAST(l_discount AS FLOAT) AS DOUBLE), 6) AS discount FROM lineitem")
def p19(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("tinyint").alias("quantity"), r6(F.col("l_discount").cast("float").cast("double"), "discount"))


@query("j01_left_composite", f"{M}, t AS (SELECT district_id, month, tmax_c FROM monthly WHERE tmax_c > 40) SELECT m.district_id, {day('m.month')} AS month, round(m.rain_mm, 4) AS rain_mm, round(t.tmax_c, 6) AS tmax_c FROM monthly m LEFT JOIN t ON t.district_id = m.district_id AND t.month = m.month")
def j01(spark, d):
    m = monthly(spark, d)
    return m.select("district_id", "month", "rain_mm").join(m.where("tmax_c > 40").select("district_id", "month", "tmax_c"), ["district_id", "month"], "left").select("district_id", txt("month"), r4(F.col("rain_mm"), "rain_mm"), r6(F.col("tmax_c"), "tmax_c"))


@query("j02_inner_mask", f"{with_(DAILY, MONTHLY, REGISTRY)} SELECT m.district_id, {day('m.month')} AS month, round(rain_mm, 4) AS rain_mm FROM monthly m WHERE district_id IN (SELECT district_id FROM registry WHERE area >= 5)")
def j02(spark, d):
    mask = A.registry(spark, d).where("area >= 5").select("district_id")
    return monthly(spark, d).join(mask, "district_id", "left_semi").select("district_id", txt("month"), r4(F.col("rain_mm"), "rain_mm"))


@query("j03_full_outer", "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS t, count(*) AS orders FROM orders WHERE month(o_orderdate) <= 6 GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS t, count(*) AS items FROM lineitem WHERE month(l_shipdate) >= 6 GROUP BY 1) SELECT strftime(coalesce(a.t, b.t), '%Y-%m-%d') AS date, CAST(orders AS BIGINT) AS orders, CAST(items AS BIGINT) AS items FROM a FULL JOIN b ON a.t = b.t")
def j03(spark, d):
    a = A.table(spark, d, "orders").where(F.month("o_orderdate") <= 6).groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("orders"))
    b = A.table(spark, d, "lineitem").where(F.month("l_shipdate") >= 6).groupBy(F.col("l_shipdate").cast("date").alias("date")).agg(F.count(F.lit(1)).alias("items"))
    return a.join(b, "date", "full").select(txt(), "orders", "items")


@query("j04_dictionary_lookup", "SELECT n_nationkey, CASE r_name WHEN 'ASIA' THEN 'east' WHEN 'EUROPE' THEN 'west' ELSE r_name END AS zone FROM nation JOIN region ON n_regionkey = r_regionkey")
def j04(spark, d):
    names = F.create_map(*[F.lit(x) for x in ("ASIA", "east", "EUROPE", "west")])
    n = A.table(spark, d, "nation").join(A.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", F.coalesce(F.try_element_at(names, F.col("r_name")), "r_name").alias("zone"))


@query("j05_last_year_same_week", f"WITH {COUNTERS}, k AS (SELECT brand, CAST(isoyear(week) AS INT) AS y, CAST(weekofyear(week) AS INT) AS w, area FROM counter) SELECT a.brand, a.y AS year, a.w AS week, a.area, b.area AS before FROM k a LEFT JOIN k b ON b.brand = a.brand AND b.w = a.w AND b.y = a.y - 1")
def j05(spark, d):
    k = counters(spark, d).select("brand", F.extract(F.lit("YEAROFWEEK"), F.col("week")).cast("int").alias("year"), F.weekofyear("week").alias("week"), "area")
    return joins.year_before(k, ["brand", "week"], "year", "area", "before")


@query("j06_prior_season_final", f"WITH {COUNTERS}, s AS (SELECT brand, CAST(year(week) AS INT) AS year, max(area) AS final, count(*) AS n FROM counter WHERE quarter(week) <= 2 GROUP BY 1, 2) SELECT a.brand, a.year, a.final, CASE WHEN b.n >= 4 THEN b.final END AS before FROM s a LEFT JOIN s b ON b.brand = a.brand AND b.year = a.year - 1")
def j06(spark, d):
    s = counters(spark, d).where(F.quarter("week") <= 2).groupBy("brand", F.year("week").alias("year")).agg(F.max("area").alias("final"), F.count(F.lit(1)).alias("n"))
    last = joins.year_before(s.withColumn("good", F.when(F.col("n") >= 4, F.col("final"))), ["brand"], "year", "good", "before")
    return last.select("brand", "year", "final", "before")


@query("j07_previous_month", f"{M} SELECT {day('o_orderdate')} AS issued, o_orderkey, round(tmax_c, 6) AS tmax_c FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN monthly ON district_id = c_nationkey AND month = {PREV.format("date_trunc('month', o_orderdate)")}")
def j07(spark, d):
    o = A.table(spark, d, "orders").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.col("o_orderdate").cast("date").alias("issued"), F.col("c_nationkey").alias("district_id"))
    x = joins.previous_month(o, monthly(spark, d).select("district_id", "month", "tmax_c"), "issued", "month", ["district_id"])
    return x.select(txt("issued"), "o_orderkey", r6(F.col("tmax_c"), "tmax_c"))


@query("j09_state_at_issue", f"{with_(INDEX, STATE)}, o AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS t FROM orders), s AS (SELECT make_date(year, month, 1) AS sm, phase FROM state WHERE idx > 0) SELECT {day('t')} AS issued, arg_max(phase, sm) AS phase, CAST(date_diff('month', max(sm), t) AS INT) AS age FROM o LEFT JOIN s ON sm <= t GROUP BY t")
def j09(spark, d):
    from agrolith.operators import ocean

    issued = A.table(spark, d, "orders").select(F.trunc("o_orderdate", "MM").alias("month")).distinct()
    s = ocean.state(A.national_index(spark, d), run=2).where("idx > 0").select(F.make_date("year", "month", F.lit(1)).alias("month"), "phase")
    x = joins.as_of(issued.withColumn("one", F.lit(1)), s.withColumn("one", F.lit(1)), ["one"], "month", ["phase"])
    return x.select(F.col("month").cast("string").alias("issued"), "phase", F.months_between("month", "as_of").cast("int").alias("age"))


@query("j11_exact_lag", f"{with_(DAILY)} SELECT a.district_id, {day('a.date')} AS issued, b.rain_mm AS known FROM daily a LEFT JOIN daily b ON b.district_id = a.district_id AND b.date = a.date - 2 WHERE a.rain_mm IS NOT NULL")
def j11(spark, d):
    x = A.daily(spark, d)
    known = x.select("district_id", F.date_add("date", 2).alias("date"), F.col("rain_mm").alias("known"))
    return x.where("rain_mm is not null").select("district_id", "date").join(known, ["district_id", "date"], "left").select("district_id", F.col("date").cast("string").alias("issued"), "known")


@query("j13_constants_for_all", f"{with_(REGISTRY)} SELECT district_id, crop, share FROM registry CROSS JOIN (VALUES ('jute', 0.1e0), ('tea', 0.2e0)) c(crop, share)")
def j13(spark, d):
    crops = F.array(*[F.struct(F.lit(c).alias("crop"), F.lit(s).alias("share")) for c, s in (("jute", 0.1), ("tea", 0.2))])
    return A.registry(spark, d).select("district_id", F.explode(crops).alias("c")).select("district_id", "c.*")


@query("j22_aligned", f"{with_(DAILY)} SELECT r.district_id, {day('r.date')} AS date, r.rain_mm, t.tmax_c FROM (SELECT * FROM daily WHERE rain_mm IS NOT NULL) r JOIN (SELECT * FROM daily WHERE tmax_c IS NOT NULL) t ON t.district_id = r.district_id AND t.date = r.date")
def j22(spark, d):
    return P.align([A.observed_rain(spark, d), A.observed_temperature(spark, d).select("district_id", "date", "tmax_c")], ["district_id", "date"]).select("district_id", txt(), "rain_mm", "tmax_c")


@query("j23_reindexed", f"{with_(DAILY)}, t AS (SELECT district_id, date FROM daily WHERE tmax_c IS NOT NULL) SELECT t.district_id, {day('t.date')} AS date, rain_mm FROM t LEFT JOIN daily USING (district_id, date)")
def j23(spark, d):
    axes = A.daily(spark, d).where("tmax_c is not null")
    return P.reindex(A.observed_rain(spark, d), axes, ["district_id", "date"]).select("district_id", txt(), "rain_mm")


@query("w16_latest_by_maximum", f"{M} SELECT district_id, {day('month')} AS month, round(rain_mm, 4) AS rain_mm FROM (SELECT *, max(month) OVER (PARTITION BY district_id) AS last FROM (SELECT * FROM monthly WHERE rain_mm IS NOT NULL)) WHERE month = last")
def w16(spark, d):
    m = monthly(spark, d).where("rain_mm is not null").withColumn("last", F.max("month").over(Window.partitionBy("district_id")))
    return m.where("month = last").select("district_id", txt("month"), r4(F.col("rain_mm"), "rain_mm"))


@query("w23_centred_mean", f"{with_(DAILY)} SELECT district_id, {day()} AS date, round(avg(tmax_c) OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 8) AS tmax_c FROM daily")
def w23(spark, d):
    return A.daily(spark, d).select("district_id", txt(), F.round(F.avg("tmax_c").over(W.series().rowsBetween(-3, 3)), 8).alias("tmax_c"))


@query("t01_t02_extremes", "SELECT which, i, o_orderkey FROM (SELECT 'largest' AS which, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS i, o_orderkey FROM orders UNION ALL SELECT 'smallest', CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS INT), o_orderkey FROM orders) WHERE i <= 8")
def t02(spark, d):
    o, out = A.table(spark, d, "orders"), None
    for which, order in (("largest", F.desc("o_totalprice")), ("smallest", F.asc("o_totalprice"))):
        top = o.orderBy(order, "o_orderkey").limit(8)
        one = top.select(F.lit(which).alias("which"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(order, "o_orderkey")).alias("i"), "o_orderkey")
        out = one if out is None else out.union(one)
    return out


@query("t06_best_and_blend", "WITH f AS (SELECT l_returnflag AS model, l_discount * 100 AS p, l_tax * 100 AS y FROM lineitem), s AS (SELECT model, round(avg(power(p - y, 2)), 9) AS mse FROM f GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY mse, model) AS i FROM s) SELECT (SELECT model FROM k WHERE i = 1) AS best, (SELECT string_agg(model, ', ' ORDER BY i) FROM k WHERE i <= 3) AS blended, round(avg(p), 6) AS blend FROM f JOIN k USING (model) WHERE i <= 3")
def t06(spark, d):
    from agrolith.operators import models

    f = A.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("model"), (F.col("l_discount") * 100).alias("p"), (F.col("l_tax") * 100).alias("y"))
    top = models.best(f, "model", "p", "y", 3)
    names = top.agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "model"))), lambda r: r["model"]).alias("names"))
    blend = f.join(top, "model").agg(r6(F.avg("p"), "blend"))
    return names.join(blend, F.lit(True)).select(F.element_at("names", 1).alias("best"), F.array_join("names", ", ").alias("blended"), "blend")


@query("t08_even_sample", "SELECT o_orderkey FROM orders ORDER BY md5('0:' || o_orderkey), o_orderkey LIMIT 500")
def t08(spark, d):
    from agrolith.operators import models

    return models.even_sample(A.table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 500, 0)


@query("u01_melted", f"{M} SELECT district_id, {day('month')} AS month, name, round(value, 6) AS value FROM (UNPIVOT (SELECT district_id, month, rain_mm, tmax_c FROM monthly) ON rain_mm, tmax_c INTO NAME name VALUE value)")
def u01(spark, d):
    x = monthly(spark, d).unpivot(["district_id", "month"], ["rain_mm", "tmax_c"], "name", "value")
    return x.where("value is not null").select("district_id", txt("month"), "name", r6(F.col("value"), "value"))


@query("u04_union_of_frames", "SELECT 'orders' AS frame, o_orderkey AS id, NULL AS name FROM orders UNION ALL SELECT 'part', p_partkey, p_name FROM part")
def u04(spark, d):
    o = A.table(spark, d, "orders").select(F.lit("orders").alias("frame"), F.col("o_orderkey").alias("id"))
    return o.unionByName(A.table(spark, d, "part").select(F.lit("part").alias("frame"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), allowMissingColumns=True)


@query("u09_refreshed_features", f"{M} SELECT district_id, {day('month')} AS month, days, round(tmax_c * 2, 6) AS tmax_c, round(rain_mm, 4) AS rain_mm FROM monthly")
def u09(spark, d):
    m = monthly(spark, d)
    new = m.select("district_id", "month", (F.col("tmax_c") * 2).alias("tmax_c"))
    twice = P.refreshed(P.refreshed(m.drop("tmin_c"), new, P.KEYS), new, P.KEYS)
    return twice.select("district_id", txt("month"), "days", r6(F.col("tmax_c"), "tmax_c"), r4(F.col("rain_mm"), "rain_mm"))


@query("f04_f05_monthly_evaporation", f"{M}, r AS (SELECT *, radians(10 + district_id) AS phi, 0.409e0 * sin(2 * pi() * dayofyear(month + 14) / 365.0e0 - 1.39e0) AS tilt, 1 + 0.033e0 * cos(2 * pi() * dayofyear(month + 14) / 365.0e0) AS dr FROM monthly), s AS (SELECT *, acos(least(greatest(-tan(phi) * tan(tilt), -1), 1)) AS ws FROM r) SELECT district_id, {day('month')} AS month, round(CASE WHEN tmax_c > tmin_c THEN greatest(0.0023e0 * (24 * 60 / pi() * 0.0820e0 * 0.408e0 * dr * (ws * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(ws))) * sqrt(tmax_c - tmin_c) * ((tmax_c + tmin_c) / 2 + 17.8e0), 0) END * day(last_day(month)), 5) AS pet_mm FROM s")
def f04(spark, d):
    pet = P.monthly_evaporation((F.col("district_id") + 10).cast("double"), F.col("month"), F.col("tmax_c"), F.col("tmin_c"))
    return monthly(spark, d).select("district_id", txt("month"), F.round(pet, 5).alias("pet_mm"))


@query("f07_moisture_adequacy", f"{M} SELECT district_id, {day('month')} AS month, round(CASE WHEN tmax_c > 0 AND rain_mm IS NOT NULL THEN least(greatest(rain_mm / (tmax_c * 4), 0), 1.5e0) END, 6) AS mai FROM monthly")
def f07(spark, d):
    return monthly(spark, d).select("district_id", txt("month"), r6(P.moisture_adequacy(F.col("rain_mm"), F.col("tmax_c") * 4), "mai"))


@query("f11_f20_pace", f"WITH {COUNTERS}, k AS (SELECT brand, CAST(isoyear(week) AS INT) AS y, CAST(weekofyear(week) AS INT) AS w, area FROM counter), j AS (SELECT a.*, 100 * (a.area - b.area) / nullif(b.area, 0) AS change FROM k a LEFT JOIN k b ON b.brand = a.brand AND b.w = a.w AND b.y = a.y - 1) SELECT brand, y AS year, w AS week, round(change, 6) AS change, CASE WHEN change >= 3 THEN 'Ahead' WHEN change <= -3 THEN 'Behind' WHEN change IS NOT NULL THEN 'On pace' END AS pace FROM j")
def f11(spark, d):
    k = counters(spark, d).select("brand", F.extract(F.lit("YEAROFWEEK"), F.col("week")).cast("int").alias("year"), F.weekofyear("week").alias("week"), "area")
    x = joins.year_before(k, ["brand", "week"], "year", "area", "before").withColumn("change", F.try_divide(100 * (F.col("area") - F.col("before")), F.col("before")))
    pace = F.when(F.col("change") >= 3, "Ahead").when(F.col("change") <= -3, "Behind").when(F.col("change").isNotNull(), "On pace")
    return x.select("brand", "year", "week", r6(F.col("change"), "change"), pace.alias("pace"))


@query("f17_scaled_units", "SELECT s_suppkey, round(greatest(s_acctbal * -1000, 0), 4) AS evaporation_mm, round(s_acctbal * 0.01e0, 6) AS sst FROM supplier")
def f17(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", r4(grids.evaporation_mm(F.col("s_acctbal")), "evaporation_mm"), r6(F.col("s_acctbal") * 0.01, "sst"))


@query("f19_finite_values", "SELECT s_suppkey, round(CASE WHEN s_nationkey > 0 THEN s_acctbal / s_nationkey END, 6) AS v FROM supplier")
def f19(spark, d):
    from agrolith.functions.nulls import finite

    v = F.when(F.col("s_nationkey") > 0, F.col("s_acctbal") / F.col("s_nationkey")).otherwise(F.lit(float("inf")))
    return A.table(spark, d, "supplier").select("s_suppkey", r6(finite(v), "v"))


@query("x03_spread_and_correlation", f"{M} SELECT district_id, round(avg(abs(tmax_c - tmin_c) / ((tmax_c + tmin_c) / 2)) * 100, 6) AS spread, round(corr(tmax_c, tmin_c), 6) AS r FROM monthly WHERE tmax_c + tmin_c > 0 GROUP BY 1")
def x03(spark, d):
    a, b = F.col("tmax_c"), F.col("tmin_c")
    return monthly(spark, d).where(a + b > 0).groupBy("district_id").agg(r6(F.avg(F.abs(a - b) / ((a + b) / 2)) * 100, "spread"), r6(correlation(a, b), "r"))


@query("x10_member_average", "SELECT l_linenumber AS lead, round(sum(l_quantity * (l_tax + 1)) / sum(l_tax + 1), 6) AS mean, CAST(count(*) AS BIGINT) AS members FROM lineitem GROUP BY 1")
def x10(spark, d):
    from agrolith.functions.nulls import weighted_mean

    return A.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("lead")).agg(r6(weighted_mean(F.col("l_quantity"), F.col("l_tax") + 1), "mean"), F.count(F.lit(1)).alias("members"))


@query("x06_phase_of_month", f"{with_(INDEX, STATE)} SELECT year, month, phase FROM state WHERE month BETWEEN 6 AND 9")
def x06(spark, d):
    from agrolith.operators import ocean

    return ocean.state(A.national_index(spark, d), run=2).where("month between 6 and 9").select("year", "month", "phase")


@query("x01_standardised_anomaly", f"{M} SELECT district_id, {day('month')} AS month, round(percent_rank() OVER (PARTITION BY district_id, month(month), tmax_c IS NULL ORDER BY tmax_c), 6) AS position, round(greatest(tmax_c - 34, 0), 6) AS heat FROM monthly WHERE tmax_c IS NOT NULL")
def x01(spark, d):
    m = monthly(spark, d).where("tmax_c is not null")
    rank = F.percent_rank().over(Window.partitionBy("district_id", F.month("month")).orderBy("tmax_c"))
    return m.select("district_id", txt("month"), r6(rank, "position"), r6(indices.stress_degrees(F.col("tmax_c"), 34), "heat"))


@query("j10_own_last_month", f"{M}, l AS (UNPIVOT (SELECT district_id, month, rain_mm, tmax_c FROM monthly) ON rain_mm, tmax_c INTO NAME layer VALUE v), e AS (SELECT layer, max(month) AS t FROM l GROUP BY 1) SELECT layer, district_id, {day('t')} AS as_of, round(v, 6) AS v FROM l JOIN e USING (layer) WHERE month = t")
def j10(spark, d):
    from agrolith.operators import layers

    x = monthly(spark, d).unpivot(["district_id", "month"], ["rain_mm", "tmax_c"], "layer", "v").where("v is not null")
    return layers.clamped(x, "month", F.lit("9999-12-31").cast("date"), ["district_id"]).select("layer", "district_id", txt("as_of"), r6(F.col("v"), "v"))


@query("d02_departure_by_phase", f"{with_(DAILY, MONTHLY, INDEX, STATE)}, n AS (SELECT district_id, month(month) AS m, avg(rain_mm) AS nm FROM monthly WHERE year(month) BETWEEN 1995 AND 1998 GROUP BY ALL) SELECT phase, round(avg(CASE WHEN nm >= 5 THEN (rain_mm - nm) / nm * 100 END), 5) AS departure, CAST(count(*) AS BIGINT) AS months FROM monthly mo JOIN n ON n.district_id = mo.district_id AND n.m = month(mo.month) JOIN state s ON s.year = year(mo.month) AND s.month = month(mo.month) GROUP BY 1")
def d02b(spark, d):
    from agrolith.operators import normals, ocean

    m = normals.with_normal(monthly(spark, d), ["rain_mm"], (1995, 1998)).withColumn("dep", percent_departure(F.col("rain_mm"), F.col("rain_mm_normal")))
    s = ocean.state(A.national_index(spark, d), run=2).select(F.make_date("year", "month", F.lit(1)).alias("month"), "phase")
    return m.join(s, "month").groupBy("phase").agg(F.round(F.avg("dep"), 5).alias("departure"), F.count(F.lit(1)).alias("months"))
