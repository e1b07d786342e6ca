"""Further domain queries: gridded means, reliability, national sowing, statuses, learners' inputs and audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip, weighted_mean
from agrolith.operators import checks, grids, joins, models, reliability, sowing
from agrolith.operators import windows as W
from agrolith.operators.joins import nearest
from agrolith.operators.verification import pace
from agrolith.plans.climate import monthly, r4, txt
from agrolith.plans.domain import COUNTERS, counters, r6
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, MONTHLY, REGISTRY, day, with_
from agrolith.sources import adapters as A
from agrolith.streaming.runtime import shared_path

CELLS = "cells AS (SELECT s_nationkey AS district_id, p_size AS cell, CAST(count(*) AS DOUBLE) AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2), grid AS (SELECT p_size AS cell, CAST(year(l_shipdate) AS INT) AS year, CASE WHEN sum(l_quantity) > 300 THEN sum(l_quantity) END AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


def grid(spark, d: str) -> tuple[DataFrame, DataFrame]:
    items = A.table(spark, d, "lineitem").join(A.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    weights = items.join(A.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_nationkey").alias("district_id"), F.col("p_size").alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    values = items.groupBy(F.col("p_size").alias("cell"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("v"))
    return weights, values.withColumn("v", F.when(F.col("v") > 300, F.col("v")))


@query("a06_masked_spatial_mean", f"WITH {CELLS} SELECT district_id, year, round(sum(w * v) / sum(CASE WHEN v IS NOT NULL THEN w END), 4) AS mean, round(coalesce(sum(CASE WHEN v IS NOT NULL THEN w END), 0) / sum(w), 6) AS coverage FROM cells JOIN grid USING (cell) GROUP BY 1, 2")
def a06(spark, d):
    weights, values = grid(spark, d)
    g = values.join(weights, "cell").groupBy("district_id", "year")
    valid = F.when(F.col("v").isNotNull(), F.col("w"))
    return g.agg(r4(weighted_mean(F.col("v"), F.col("w")), "mean"), r6(F.coalesce(F.sum(valid), F.lit(0.0)) / F.sum("w"), "coverage"))


@query("a31_subdaily_to_daily", "SELECT event_type, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, round(avg(value) * 86400, 2) AS rate, max(value) AS hi, min(value) AS lo, round(sqrt(power(avg(value), 2) + power(avg(user_id), 2)), 4) AS speed, CAST(count(*) AS BIGINT) AS n_records FROM events GROUP BY 1, 2")
def a31(spark, d):
    x = grids.subdaily_to_daily(A.table(spark, d, "events"), ["event_type"], "ts", "value", "value", "user_id")
    return x.select("event_type", F.col("day").cast("string").alias("day"), F.round("total", 2).alias("rate"), "hi", "lo", r4(F.col("speed"), "speed"), "n_records")


@query("a32_class_area_shares", "SELECT p_brand, CAST(sum(CASE WHEN p_size <= 10 THEN p_size END) AS BIGINT) AS irrigated, CAST(sum(CASE WHEN p_size <= 25 THEN p_size END) AS BIGINT) AS cropped, round(100.0e0 * sum(CASE WHEN p_size <= 10 THEN p_size END) / nullif(sum(CASE WHEN p_size <= 25 THEN p_size END), 0), 4) AS pct FROM part GROUP BY 1")
def a32(spark, d):
    size = F.col("p_size")
    x = grids.class_areas(A.table(spark, d, "part"), "p_brand", "p_size", {"irrigated": size <= 10, "cropped": size <= 25}, {"pct": ("irrigated", "cropped")})
    return x.select("p_brand", "irrigated", "cropped", r4(F.col("pct"), "pct"))


@query("a33_quality_masked_mean", "SELECT l_suppkey, round(avg(CASE WHEN l_linenumber <= 2 THEN l_quantity / 10000.0e0 END), 8) AS mean, round(avg(CAST(l_linenumber <= 2 AS INT)), 6) AS clear FROM lineitem GROUP BY 1")
def a33(spark, d):
    x = grids.quality_masked_mean(A.table(spark, d, "lineitem"), "l_suppkey", "l_quantity", F.col("l_linenumber") <= 2, 10_000)
    return x.select("l_suppkey", F.round("mean", 8).alias("mean"), r6(F.col("clear"), "clear"))


RELIABILITY = f"""e AS (SELECT district_id, power(sum(w), 2) / sum(w * w) AS eff FROM cells GROUP BY 1),
sp AS (SELECT district_id, CASE WHEN count(*) FILTER (tmax_c + tmin_c <> 0) >= 5 THEN avg(CASE WHEN tmax_c + tmin_c <> 0 THEN abs(tmax_c - tmin_c) / ((tmax_c + tmin_c) / 2) END) * 100 END AS spread FROM monthly WHERE month(month) BETWEEN 6 AND 9 GROUP BY 1),
rel AS (SELECT district_id, eff, coalesce(spread, (SELECT quantile_cont(spread, 0.5) FROM sp)) AS spread FROM e LEFT JOIN sp USING (district_id)),
sc AS (SELECT *, 0.5e0 * least(greatest(eff / 4, 0), 1) + 0.5e0 * least(greatest(1 - spread / 60, 0), 1) AS score FROM rel)"""


@query("d09_reliability", f"{with_(DAILY, MONTHLY, CELLS, RELIABILITY)} SELECT district_id, round(eff, 4) AS effective_cells, round(spread, 4) AS spread_pct, round(score, 6) AS score, CASE WHEN score <= 0.35 THEN 'Low' WHEN score <= 0.55 THEN 'Moderate' WHEN score <= 0.75 THEN 'Good' ELSE 'High' END AS grade FROM sc")
def d09(spark, d):
    weights, _ = grid(spark, d)
    spread = monthly(spark, d).where(F.month("month").between(6, 9)).groupBy("district_id").agg(reliability.relative_spread(F.col("tmax_c"), F.col("tmin_c")).alias("spread"))
    x = reliability.reliability(weights, spread)
    return x.select("district_id", r4(F.col("effective_cells"), "effective_cells"), r4(F.col("spread"), "spread_pct"), r6(F.col("score"), "score"), "grade")


@query("d10_irrigation_index", f"{with_(REGISTRY)}, y AS (SELECT c_nationkey AS district_id, year(o_orderdate) AS y, count(*) AS high FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2), l AS (SELECT district_id, avg(high) AS high FROM (SELECT *, dense_rank() OVER (ORDER BY y DESC) AS r FROM y) WHERE r <= 5 GROUP BY 1), f AS (SELECT district_id, state, least(greatest(high / (area * 100), 0), 1) AS share FROM registry LEFT JOIN l USING (district_id)), g AS (SELECT *, coalesce(share, quantile_cont(share, 0.5) OVER (PARTITION BY state)) AS s FROM f) SELECT district_id, round(s, 8) AS share, round((rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0e0) / count(*) OVER (), 6) AS idx FROM g")
def d10(spark, d):
    o = A.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    yearly = o.groupBy(F.col("c_nationkey").alias("district_id"), F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("high"))
    return reliability.irrigation(yearly, A.registry(spark, d)).select("district_id", F.round("share", 8).alias("share"), r6(F.col("idx"), "idx"))


@query("d26_national_sowing", "SELECT p_brand, CAST(lower(p_brand) IN ('brand#11', 'brand#22') AS INT) AS is_aggregate, round(sum(l_extendedprice) FILTER (year(l_shipdate) = 2000) / nullif(sum(l_extendedprice) FILTER (year(l_shipdate) = 1999), 0) * 100 - 100, 4) AS pct_change, round(100.0e0 * sum(l_extendedprice) FILTER (year(l_shipdate) = 2000) / nullif(sum(l_extendedprice) FILTER (year(l_shipdate) BETWEEN 1995 AND 1998) / 4, 0), 4) AS pct_of_normal FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def d26(spark, d):
    x = A.table(spark, d, "lineitem").join(A.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    r = sowing.national_report(x.withColumn("year", F.year("l_shipdate")), "p_brand", "year", "l_extendedprice", 2000, (1995, 1998), ("brand#11", "brand#22"))
    return r.select("p_brand", r4(F.col("pct_change"), "pct_change"), r4(F.col("pct_of_normal"), "pct_of_normal"), "is_aggregate")


@query("d12_year_on_year_and_pace", f"WITH {COUNTERS}, k AS (SELECT brand, CAST(year(week) AS INT) AS sy, CAST(weekofyear(week) AS INT) AS wk, max(area) AS area FROM counter GROUP BY ALL), p AS (SELECT brand, sy + 1 AS sy, max(area) AS prev, count(*) AS weeks FROM k GROUP BY brand, sy), j AS (SELECT k.*, l.area AS ly, CASE WHEN p.weeks >= 4 THEN p.prev END AS prev FROM k LEFT JOIN k l ON l.brand = k.brand AND l.sy = k.sy - 1 AND l.wk = k.wk LEFT JOIN p ON p.brand = k.brand AND p.sy = k.sy), q AS (SELECT *, 100 * (area - ly) / nullif(prev, 0) AS pace FROM j) SELECT brand, sy, wk, round(100 * (area - ly) / nullif(ly, 0), 4) AS yoy_pct, round(100 * area / nullif(prev, 0), 4) AS coverage_pct, round(pace, 4) AS pace_pp, CASE WHEN pace >= 3 THEN 'Ahead' WHEN pace <= -3 THEN 'Behind' WHEN pace IS NULL THEN 'no prior season' ELSE 'On pace' END AS label FROM q")
def d12b(spark, d):
    k = counters(spark, d).groupBy("brand", F.year("week").alias("sy"), F.weekofyear("week").alias("wk")).agg(F.max("area").alias("area"))
    return pace(k, "brand", "sy", "wk", "area").select("brand", "sy", "wk", *[r4(F.col(c), c) for c in ("yoy_pct", "coverage_pct", "pace_pp")], "label")


@query("w19_neighbour_mean", "WITH p AS (SELECT n_nationkey AS id, 8.0e0 + n_nationkey * 7 % 25 AS lat, 68.0e0 + n_nationkey * 11 % 29 AS lon FROM nation), k AS (SELECT a.id, b.id AS neighbour, 6371.0e0 * acos(least(greatest(sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon)), -1), 1)) AS km FROM p a JOIN p b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, neighbour) AS rank FROM k), w AS (SELECT *, 1 / greatest(km, 25) / sum(1 / greatest(km, 25)) OVER (PARTITION BY id) AS weight FROM r WHERE rank <= 8), v AS (SELECT s_nationkey AS neighbour, avg(s_acctbal) AS v FROM supplier GROUP BY 1) SELECT id, CASE WHEN sum(CASE WHEN v IS NOT NULL THEN weight END) >= 0.2 THEN round(sum(weight * v) / sum(CASE WHEN v IS NOT NULL THEN weight END), 3) END AS mean FROM w LEFT JOIN v USING (neighbour) GROUP BY 1")
def w19(spark, d):
    k = F.col("n_nationkey")
    p = A.table(spark, d, "nation").select(k.alias("id"), (F.lit(8.0) + k * 7 % 25).alias("lat"), (F.lit(68.0) + k * 11 % 29).alias("lon"))
    v = A.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("neighbour")).agg(F.avg("s_acctbal").alias("v"))
    g = nearest(p).join(v, "neighbour", "left").groupBy("id")
    held = F.sum(F.when(F.col("v").isNotNull(), F.col("weight")))
    return g.agg(F.when(held >= 0.2, F.round(weighted_mean(F.col("v"), F.col("weight")), 3)).alias("mean"))


@query("j17_nearest_cell", "SELECT id, cell FROM (SELECT a.s_suppkey AS id, b.n_nationkey AS cell, row_number() OVER (PARTITION BY a.s_suppkey ORDER BY power(a.s_suppkey * 7 % 100 - b.n_nationkey * 4, 2) + power(a.s_suppkey * 13 % 90 - b.n_nationkey * 3, 2), b.n_nationkey) AS r FROM supplier a, nation b) WHERE r = 1")
def j17(spark, d):
    a = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 7 % 100).alias("x"), (F.col("s_suppkey") * 13 % 90).alias("y"))
    b = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("cell"), (F.col("n_nationkey") * 4).alias("x"), (F.col("n_nationkey") * 3).alias("y"))
    return joins.nearest_cell(a, b, 10.0).select("id", "cell")


@query("f13_freshness", "SELECT event_type, strftime(max(ts), '%Y-%m-%d') AS edge, CASE WHEN datediff('day', CAST(max(ts) AS DATE), DATE '2024-02-05') <= 5 THEN 'CURRENT' WHEN datediff('day', CAST(max(ts) AS DATE), DATE '2024-02-05') <= 13 THEN 'DUE' ELSE 'STALE' END AS status FROM events GROUP BY 1")
def f13(spark, d):
    status = checks.freshness(F.max("ts").cast("date"), F.lit("2024-02-05").cast("date"), 5)
    return A.table(spark, d, "events").groupBy("event_type").agg(F.max("ts").cast("date").cast("string").alias("edge"), status.alias("status"))


@query("f16_kelvin_before_mean", "SELECT l_suppkey, round(avg(CASE WHEN v > 100 THEN v - 273.15e0 ELSE v END), 4) AS c FROM (SELECT l_suppkey, l_quantity + CASE WHEN l_linenumber % 2 = 0 THEN 273.15e0 ELSE 0 END AS v FROM lineitem) GROUP BY 1")
def f16(spark, d):
    x = A.table(spark, d, "lineitem").withColumn("v", F.col("l_quantity") + F.when(F.col("l_linenumber") % 2 == 0, 273.15).otherwise(0.0))
    return x.groupBy("l_suppkey").agg(r4(F.avg(grids.celsius(F.col("v"))), "c"))


@query("f18_adaptive_domain", f"{with_(DAILY, MONTHLY)}, a AS (SELECT month, list_sort(list(abs(rain_mm - 100))) AS v FROM monthly WHERE rain_mm IS NOT NULL GROUP BY 1) SELECT {day('month')} AS month, CAST(CASE WHEN len(v) < 8 THEN 100 ELSE coalesce(list_min([n for n in [5, 10, 20, 25, 50, 100, 200, 250, 500, 1000] if n >= v[CAST(floor(0.95 * (len(v) - 1)) AS INT) + 1]]), 1000) END AS INT) AS top FROM a")
def f18(spark, d):
    x = grids.adaptive_domain(monthly(spark, d).where("rain_mm is not null"), ["month"], F.abs(F.col("rain_mm") - 100))
    return x.select(txt("month"), "top")


@query("w26_trailing_incomplete_months", f"{with_(DAILY, MONTHLY)}, m AS (SELECT month, CAST(min(days) >= 1 AS INT) AS complete FROM monthly GROUP BY 1) SELECT {day('month')} AS month FROM m WHERE month > coalesce((SELECT max(month) FROM m WHERE complete = 1), DATE '1900-01-01')")
def w26(spark, d):
    m = monthly(spark, d).groupBy("month").agg((F.min("days") >= 1).alias("complete"))
    last = m.agg(F.coalesce(F.max(F.when(F.col("complete"), F.col("month"))), F.lit("1900-01-01").cast("date")).alias("last"))
    return m.join(F.broadcast(last), F.col("month") > F.col("last")).select(txt("month"))


@query("t05_top_states_per_crop", "SELECT p_brand, r_name, round(v, 4) AS v, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY v DESC, r_name) AS r FROM (SELECT p_brand, r_name, avg(l_extendedprice) AS v FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2)) WHERE r <= 3")
def t05(spark, d):
    x = A.table(spark, d, "lineitem").join(A.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(A.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(A.registry(spark, d), F.col("s_nationkey") == F.col("district_id"))
    g = x.groupBy("p_brand", F.col("state").alias("r_name")).agg(F.avg("l_extendedprice").alias("v"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("v"), "r_name"))).where("rank <= 3").select("p_brand", "r_name", r4(F.col("v"), "v"), "rank")


@query("d19_leakage_audit", f"{with_(DAILY, MONTHLY)}, x AS (SELECT district_id, rain_mm, lag(tmax_c) OVER w AS b, lead(tmax_c) OVER w AS f FROM monthly WINDOW w AS (PARTITION BY district_id ORDER BY month)) SELECT district_id, round(corr(rain_mm, b), 6) AS back, round(corr(rain_mm, f), 6) AS forward, CAST(coalesce(abs(corr(rain_mm, f)) > 0.3 AND abs(corr(rain_mm, f)) > 1.5 * abs(corr(rain_mm, b)), false) AS INT) AS leaks FROM x GROUP BY 1")
def d19(spark, d):
    x = checks.leakage(monthly(spark, d), ["district_id"], "month", "rain_mm", "tmax_c")
    return x.select("district_id", r6(F.col("back"), "back"), r6(F.col("forward"), "forward"), "leaks")


@query("d07_model_layers", f"{with_(DAILY)}, g AS (SELECT district_id, date, rain_mm, 1 + (district_id + day(date)) % 4 AS n_records FROM daily), k AS (SELECT *, CASE WHEN n_records >= 4 THEN rain_mm END AS v FROM g) SELECT district_id, {day()} AS date, CASE WHEN count(v) OVER w >= 2 THEN round(sum(v) OVER w, 4) END AS rain_14 FROM k WINDOW w AS (PARTITION BY district_id ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)")
def d07(spark, d):
    x = grids.forecast_layer(A.daily(spark, d), ["district_id"], "date", "rain_mm", 1 + (F.col("district_id") + F.dayofmonth("date")) % 4, 4, 14, 2)
    return x.select("district_id", txt(), r4(F.col("total"), "rain_14"))


@query("d08_ensemble_lead_layers", "WITH m AS (SELECT o_orderpriority AS run, l_linenumber AS lead, l_suppkey, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), n AS (SELECT * FROM m WHERE run = (SELECT max(run) FROM m)) SELECT lead, round(avg(v), 4) AS mean, round(quantile_cont(CAST(v AS DOUBLE), 0.1), 4) AS p10, round(quantile_cont(CAST(v AS DOUBLE), 0.9), 4) AS p90 FROM n WHERE lead IN (1, 3, 5, 7) GROUP BY 1")
def d08(spark, d):
    m = A.table(spark, d, "lineitem").join(A.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("run"), F.col("l_linenumber").alias("lead"), "l_suppkey").agg(F.sum("l_quantity").alias("v"))
    x = grids.ensemble_leads(m, "run", "lead", "v", [1, 3, 5, 7])
    return x.select("lead", r4(F.col("mean"), "mean"), r4(F.col("q")[0], "p10"), r4(F.col("q")[1], "p90"))


@query("d16_target_transforms", "SELECT p_partkey, round(ln((p_retailprice + 1.0e0) / (p_size + 1.0e0)), 8) AS logratio, round((exp(ln((p_retailprice + 1.0e0) / (p_size + 1.0e0))) * (p_size + 1.0e0) - 1.0e0), 4) AS amount, round(100.0e0 * (p_retailprice - p_size) / p_size, 4) AS departure FROM part WHERE p_size >= 5")
def d16(spark, d):
    a, n = F.col("p_retailprice"), F.col("p_size")
    ratio = models.log_ratio(a, n)
    return A.table(spark, d, "part").where(n >= 5).select("p_partkey", F.round(ratio, 8).alias("logratio"), r4(models.amount_of_log_ratio(ratio, n), "amount"), r4(models.departure_of_amount(a, n), "departure"))


@query("d17_learners")
def d17(spark, d):
    """Held-out error of four Spark ML learners on the sample table; missing features are zero with a flag beside."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor

    features = ["rain_prev", "tmax_prev", "tmin_prev", "moy_sin", "moy_cos"]
    w = W.series("district_id", "month")
    angle = 2 * F.pi() * F.month("month") / 12
    s = monthly(spark, d).select(
        "month", F.col("rain_mm").alias("y"), *[F.lag(c).over(w).alias(n) for c, n in (("rain_mm", "rain_prev"), ("tmax_c", "tmax_prev"), ("tmin_c", "tmin_prev"))], F.sin(angle).alias("moy_sin"), F.cos(angle).alias("moy_cos")
    ).where("y > 0")
    s = s.select("month", "y", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in features], *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in features])
    x = VectorAssembler(inputCols=[*features, *[f"{c}_missing" for c in features]], outputCol="x").transform(s).select("month", "y", "x")
    path = shared_path(spark, "learners")
    A.with_last(x, "month").write.parquet(path)  # each learner reads it many times
    x = spark.read.parquet(path)
    train, test = x.where("month < add_months(last, -18)"), x.where("month >= add_months(last, -18)")
    learners = {
        "gbt": GBTRegressor(featuresCol="x", labelCol="y", maxIter=10, maxDepth=4, seed=0),
        "forest": RandomForestRegressor(featuresCol="x", labelCol="y", numTrees=20, maxDepth=5, seed=0),
        "huber": LinearRegression(featuresCol="x", labelCol="y", loss="huber", maxIter=50),
        "tweedie": GeneralizedLinearRegression(featuresCol="x", labelCol="y", family="tweedie", variancePower=1.5, linkPower=0.0, maxIter=25, regParam=0.1),
    }
    out = None
    for name, learner in learners.items():
        p = learner.fit(train).transform(test).select(F.lit(name).alias("model"), "y", clip(F.col("prediction"), 0, 1000).alias("f"))
        out = p if out is None else out.union(p)
    return out.groupBy("model").agg(F.sqrt(F.avg(F.pow(F.col("f") - F.col("y"), 2.0))).alias("rmse"), F.count(F.lit(1)).alias("n"))
