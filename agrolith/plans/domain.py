"""Domain queries: ocean state, drought index, layers, sowing, crop stress, samples, scores, joins, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip, percent_departure
from agrolith.operators import checks, crops, indices, joins, models, ocean
from agrolith.operators import windows as W
from agrolith.plans.climate import BASE, NORMAL, monthly, r4, txt
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, INDEX, MONTHLY, REGISTRY, day, with_
from agrolith.sources import adapters as A


def r6(x, name: str):
    return F.round(x, 6).alias(name)


STATE = """s0 AS (SELECT year, month, idx FROM idx),
s1 AS (SELECT *, CAST(count(*) FILTER (idx >= 0.5) OVER w = 2 AND count(idx) OVER w = 2 AS INT) AS warm, CAST(count(*) FILTER (idx <= -0.5) OVER w = 2 AND count(idx) OVER w = 2 AS INT) AS cold, idx - lag(idx, 3) OVER (ORDER BY year, month) AS tend_3, idx - lag(idx, 6) OVER (ORDER BY year, month) AS tend_6 FROM s0 WINDOW w AS (ORDER BY year, month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
djf AS (SELECT year + CAST(month = 12 AS INT) AS wy, avg(idx) AS djf_prev FROM s1 WHERE month IN (12, 1, 2) GROUP BY 1), mam AS (SELECT year AS sy, avg(idx) AS mam FROM s1 WHERE month IN (3, 4, 5) GROUP BY 1),
state AS (SELECT year, month, idx, CASE WHEN warm = 1 THEN 'Warm' WHEN cold = 1 THEN 'Cold' ELSE 'Neutral' END AS phase, tend_3, tend_6, djf_prev, CASE WHEN month >= 6 THEN mam END AS mam, CAST(coalesce(tend_3 > 0.1 AND idx >= 0, false) AS INT) AS developing, CAST(coalesce(djf_prev >= 0.5 AND tend_3 < -0.1, false) AS INT) AS decaying, CAST(CASE WHEN abs(idx) < 0.5 THEN 0 WHEN abs(idx) < 1 THEN 1 WHEN abs(idx) < 1.5 THEN 2 WHEN abs(idx) < 2 THEN 3 WHEN idx IS NOT NULL THEN 4 END AS INT) AS intensity
  FROM s1 LEFT JOIN djf ON wy = year - CAST(month < 3 AS INT) LEFT JOIN mam ON sy = year)"""


@query("d02_ocean_state", f"{with_(INDEX, STATE)} SELECT year, month, phase, round(tend_3, 4) AS tend_3, round(tend_6, 4) AS tend_6, round(djf_prev, 4) AS djf_prev, round(mam, 4) AS mam, developing, decaying, intensity FROM state")
def d02(spark, d):
    s = ocean.state(A.national_index(spark, d), run=2)
    return s.select("year", "month", "phase", *[r4(F.col(c), c) for c in ("tend_3", "tend_6", "djf_prev", "mam")], "developing", "decaying", "intensity")


@query("d03_phase_composites", f"{with_(DAILY, MONTHLY, INDEX, STATE)}, j AS (SELECT district_id, phase, rain_mm FROM monthly JOIN state ON state.year = year(monthly.month) AND state.month = month(monthly.month) WHERE month(monthly.month) BETWEEN 6 AND 9 AND year(monthly.month) <= 1999), p AS (SELECT district_id, avg(rain_mm) FILTER (phase = 'Warm') AS w, avg(rain_mm) FILTER (phase = 'Neutral') AS n, avg(rain_mm) FILTER (phase = 'Cold') AS c FROM j GROUP BY 1) SELECT district_id, round(w, 4) AS warm, round(n, 4) AS neutral, round(c, 4) AS cold, round(w / n, 6) AS warm_ratio, round(c / n, 6) AS cold_ratio FROM p")
def d03(spark, d):
    c = ocean.composites(monthly(spark, d), ocean.state(A.national_index(spark, d), run=2), "rain_mm", 1999)
    return c.select("district_id", r4(F.col("Warm"), "warm"), r4(F.col("Neutral"), "neutral"), r4(F.col("Cold"), "cold"), r6(F.col("Warm") / F.col("Neutral"), "warm_ratio"), r6(F.col("Cold") / F.col("Neutral"), "cold_ratio"))


SPEI = f"""b AS (SELECT district_id, month, rain_mm - 4.0e0 * tmax_c AS x FROM monthly),
m AS (SELECT *, CAST(count(x) OVER g AS DOUBLE) AS n, CAST(row_number() OVER (g ORDER BY x, month) AS DOUBLE) AS j, rank() OVER (g ORDER BY x) + (count(*) OVER (PARTITION BY district_id, x) - 1) / 2.0e0 AS rk FROM b WINDOW g AS (PARTITION BY district_id, x IS NULL)),
w AS (SELECT *, avg(x) OVER g AS w0, sum((n - j) * x) OVER g / nullif(n * (n - 1), 0) AS w1, sum((n - j) * (n - j - 1) * x) OVER g / nullif(n * (n - 1) * (n - 2), 0) AS w2 FROM m WINDOW g AS (PARTITION BY district_id, x IS NULL)),
f AS (SELECT *, (2 * w1 - w0) / nullif(6 * w1 - w0 - 6 * w2, 0) AS b FROM w),
h AS (SELECT *, (w0 - 2 * w1) * b / ((pi() / b) / sin(pi() / b)) AS a, w0 - (w0 - 2 * w1) * b AS g FROM f),
p AS (SELECT district_id, month, CASE WHEN x IS NOT NULL AND n >= 20 THEN least(greatest(CASE WHEN a > 0 THEN CASE WHEN x = g THEN 0 WHEN x > g THEN 1 / (1 + power(a / (x - g), b)) END ELSE (rk - 0.44e0) / (n + 0.12e0) END, 1e-6), 1 - 1e-6) END AS p FROM h)"""


@query("d04_spei", f"{with_(DAILY, MONTHLY, SPEI)} SELECT district_id, {day('month')} AS month, round(p, 6) AS p, round({indices.inverse_normal_sql('p', 'e0')}, 5) + 0.0e0 AS spei FROM p")
def d04(spark, d):
    x = monthly(spark, d).select("district_id", "month", (F.col("rain_mm") - F.lit(4.0) * F.col("tmax_c")).alias("x"))
    return indices.spei(x, "x", ["district_id"], "month").select("district_id", txt("month"), r6(F.col("spei_p"), "p"), F.round("spei", 5).alias("spei"))


@query("f03_f06_radiation_and_evaporation", f"""{with_(DAILY)}, r AS (SELECT *, radians(10 + district_id) AS phi, 0.409e0 * sin(2 * pi() * dayofyear(date) / 365.0e0 - 1.39e0) AS tilt, 1 + 0.033e0 * cos(2 * pi() * dayofyear(date) / 365.0e0) AS dr FROM daily WHERE tmax_c IS NOT NULL),
s AS (SELECT *, acos(least(greatest(-tan(phi) * tan(tilt), -1), 1)) AS ws FROM r), t AS (SELECT *, 24 * 60 / pi() * 0.0820e0 * 0.408e0 * dr * (ws * sin(phi) * sin(tilt) + cos(phi) * cos(tilt) * sin(ws)) AS ra FROM s)
SELECT district_id, {day()} AS date, round(ra, 4) AS ra, round(CASE WHEN tmax_c > tmin_c THEN greatest(0.0023e0 * ra * sqrt(tmax_c - tmin_c) * ((tmax_c + tmin_c) / 2 + 17.8e0), 0) END, 4) AS pet, greatest((tmax_c + tmin_c) / 2 - 10, 0) AS gdd, greatest(tmax_c - 34, 0) AS sdd FROM t""")
def f05(spark, d):
    x = A.daily(spark, d).where("tmax_c is not null").withColumn("ra", indices.extraterrestrial_radiation((F.col("district_id") + 10).cast("double"), F.dayofyear("date")))
    return x.select("district_id", txt(), r4(F.col("ra"), "ra"), r4(indices.hargreaves(F.col("ra"), F.col("tmax_c"), F.col("tmin_c")), "pet"), indices.degree_days(F.col("tmax_c"), F.col("tmin_c"), 10).alias("gdd"), clip(F.col("tmax_c") - 34, 0).alias("sdd"))


@query("f03_octant", "SELECT s_suppkey, CAST(floor(((degrees(atan2(s_acctbal, s_suppkey - 50.0e0)) + 180) % 360) / 45) AS INT) + 1 AS octant FROM supplier")
def f03(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", indices.octant(F.col("s_suppkey") - 50.0, F.col("s_acctbal")).alias("octant"))


def _sum_sql(x: str, n: int, least: int) -> str:
    o = f"OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {o} >= {least} THEN sum({x}) {o} END"


DOY = """doy AS (SELECT district_id, CAST(dayofyear(date) AS INT) AS dd, avg(rain_mm) AS n, avg(tmax_c) AS t FROM daily WHERE year(date) BETWEEN 1995 AND 1998 GROUP BY ALL),
norm AS (SELECT d.district_id, date, rain_mm, tmax_c, tmin_c, n, t FROM daily d LEFT JOIN doy ON doy.district_id = d.district_id AND dd = dayofyear(date))"""


@query("d06_daily_layers", f"{with_(DAILY, DOY)}, r AS (SELECT district_id, date, rain_mm, {_sum_sql('rain_mm', 7, 3)} AS a7, {_sum_sql('n', 7, 3)} AS n7, {_sum_sql('rain_mm', 30, 15)} AS a30, {_sum_sql('n', 30, 15)} AS n30, tmax_c - t AS anom, {_sum_sql('CASE WHEN tmax_c > 34 THEN tmax_c - 34 WHEN tmax_c IS NOT NULL THEN 0 END', 7, 3)} AS s7 FROM norm) SELECT district_id, {day()} AS date, round(rain_mm, 4) AS rain_mm, round(CASE WHEN n7 >= 5 THEN (a7 - n7) / n7 * 100 END, 3) AS dep_7d, round(CASE WHEN n30 >= 5 THEN (a30 - n30) / n30 * 100 END, 3) AS dep_30d, round(anom, 4) AS tmax_anom, s7 AS sdd_7d FROM r")
def d06(spark, d):
    x = A.daily(spark, d).withColumn("doy", F.dayofyear("date"))
    n = x.where(F.year("date").between(*BASE)).groupBy("district_id", "doy").agg(F.avg("rain_mm").alias("n"), F.avg("tmax_c").alias("t"))
    x = x.join(n, ["district_id", "doy"], "left")
    w = W.series()
    roll = lambda c, k: W.rolling_sum(c, w, k, max(3, k // 2))
    dep = lambda k: F.round(percent_departure(roll(F.col("rain_mm"), k), roll(F.col("n"), k)), 3)
    return x.select("district_id", txt(), r4(F.col("rain_mm"), "rain_mm"), dep(7).alias("dep_7d"), dep(30).alias("dep_30d"), r4(F.col("tmax_c") - F.col("t"), "tmax_anom"), roll(clip(F.col("tmax_c") - 34, 0), 7).alias("sdd_7d"))


def counters(spark, d: str) -> DataFrame:
    """A cumulative counter by brand that restarts each half year: brand, week, area."""
    items = A.table(spark, d, "lineitem").join(A.table(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    week = items.groupBy(F.col("p_brand").alias("brand"), F.to_date(F.date_trunc("week", "l_shipdate")).alias("week")).agg(F.sum("l_quantity").alias("q"))
    half = Window.partitionBy("brand", F.year("week"), F.quarter("week") > 2).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    return week.select("brand", "week", F.sum("q").over(half).alias("area"))


COUNTERS = """week AS (SELECT p_brand AS brand, CAST(date_trunc('week', l_shipdate) AS DATE) AS week, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
counter AS (SELECT brand, week, sum(q) OVER (PARTITION BY brand, year(week), quarter(week) > 2 ORDER BY week) AS area FROM week),
o AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY week) AS i FROM counter)"""


@query("d12_sowing_seasons", f"WITH RECURSIVE {COUNTERS}, seg AS (SELECT brand, week, area, i, 0 AS segment, area AS top FROM o WHERE i = 1 UNION ALL SELECT o.brand, o.week, o.area, o.i, s.segment + CAST(o.week - s.week > 21 OR o.area < s.top * 0.6e0 AS INT), CASE WHEN o.week - s.week > 21 OR o.area < s.top * 0.6e0 THEN o.area ELSE greatest(s.top, o.area) END FROM seg s JOIN o ON o.brand = s.brand AND o.i = s.i + 1) SELECT brand, strftime(week, '%Y-%m-%d') AS week, area, segment, strftime(min(week) OVER (PARTITION BY brand, segment), '%Y-%m-%d') AS start, greatest(0, coalesce(area - lag(area) OVER (PARTITION BY brand, segment ORDER BY week), area)) AS sown FROM seg")
def d12(spark, d):
    s = W.segments(counters(spark, d), ["brand"], "week", "area")
    g = Window.partitionBy("brand", "segment")
    step = clip(F.coalesce(F.col("area") - F.lag("area").over(g.orderBy("week")), "area"), 0)
    return s.select("brand", txt("week"), "area", "segment", F.min("week").over(g).cast("string").alias("start"), step.alias("sown"))


def crop_panel(spark, d: str) -> DataFrame:
    m, mm = monthly(spark, d), F.month("month")
    ref = m.where(F.year("month").between(*BASE)).groupBy("district_id", mm.alias("mm")).agg(F.avg("rain_mm").alias("rain_mm_normal"), F.avg("tmin_c").alias("soil_ref"), F.stddev_samp("tmin_c").alias("soil_sd"))
    m = m.withColumn("mm", mm).join(ref, ["district_id", "mm"], "left").join(A.registry(spark, d), "district_id")
    return m.select("district_id", "month", "tmax_c", "tmin_c", clip(F.col("rain_mm") / (F.col("tmax_c") * 8), 0, 1.5).alias("mai"), percent_departure(F.col("rain_mm"), F.col("rain_mm_normal")).alias("departure"), clip(F.col("area") / 100, 0, 1).alias("irrig"), F.col("tmin_c").alias("soil"), "soil_ref", "soil_sd")


def _clip(x: str) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, 0), 1) END)"


CROP = ", ".join(f"({', '.join(repr(v) for v in row)})" for row in crops.calendar_rows())
RAW = _clip("1 - mai / adeq")
CROPS = f"""cal(crop, season, base, adeq, stage, ky, upper, m) AS (VALUES {CROP}),
ref AS (SELECT district_id, month(month) AS mm, avg(tmin_c) AS sr, stddev_samp(tmin_c) AS sd FROM monthly WHERE year(month) BETWEEN 1995 AND 1998 GROUP BY ALL),
panel AS (SELECT mo.district_id, mo.month, CAST(day(last_day(mo.month)) AS DOUBLE) AS days, tmax_c, tmin_c, CASE WHEN rain_mm IS NOT NULL AND tmax_c IS NOT NULL THEN least(greatest(rain_mm / (tmax_c * 8), 0), 1.5e0) END AS mai, CASE WHEN normal_mm >= 5 THEN (rain_mm - normal_mm) / normal_mm * 100 END AS dep, least(greatest(area / 100, 0), 1) AS irrig, sr, sd FROM monthly mo JOIN registry USING (district_id) LEFT JOIN normal n ON n.district_id = mo.district_id AND n.m = month(mo.month) LEFT JOIN ref ON ref.district_id = mo.district_id AND ref.mm = month(mo.month)),
hw AS (SELECT panel.*, crop, season, stage, CAST(ky AS DOUBLE) AS ky, {_clip("days * (CASE WHEN tmax_c IS NOT NULL THEN greatest(tmax_c - upper, 0) END) / 90.0e0")} AS heat, CASE WHEN season = 'Rabi' THEN {_clip(f"0.65e0 * (1 - irrig) + 0.35e0 * coalesce({_clip('(sr - tmin_c) / nullif(sd, 0) / 2.0e0')}, 1 - irrig)")} ELSE {_clip(f"{_clip(f'0.75e0 * {RAW} + 0.25e0 * coalesce({_clip("-dep / 60.0e0")}, {RAW})')} * (1 - 0.55e0 * irrig)")} END AS water FROM panel JOIN cal ON cal.m = month(month)),
c AS (SELECT *, coalesce(CASE WHEN season = 'Rabi' THEN 0.45e0 * water + 0.55e0 * heat ELSE 0.65e0 * water + 0.35e0 * heat END, water, heat) AS csi, CAST(year(month) - CASE WHEN season = 'Rabi' AND month(month) <= 4 THEN 1 ELSE 0 END AS INT) AS sy FROM hw),
st AS (SELECT district_id, crop, season, sy, stage, ky, round(max(heat), 9) AS heat, round(avg(water), 9) AS water, round(avg(csi), 9) AS csi FROM c WHERE csi IS NOT NULL GROUP BY ALL),
h AS (SELECT district_id, crop, season, sy, round(1 - product(1 - {_clip("ky * csi")}), 3) AS csi, round(1 - product(1 - least(greatest(ky, 0), 1)), 3) AS csi_max, count(DISTINCT stage) AS stages FROM st GROUP BY ALL)"""


@query("d13_crop_stress", f"{with_(DAILY, MONTHLY, REGISTRY, NORMAL, CROPS)} SELECT district_id, crop, season, sy AS season_year, csi, round(csi_max, 3) AS csi_max, CAST(stages AS BIGINT) AS stages FROM (SELECT *, max(sy) OVER (PARTITION BY crop) AS latest FROM h) WHERE stages >= 4 OR sy >= latest")
def d13(spark, d):
    s = crops.season_stress(crops.stage_stress(crop_panel(spark, d), digits=9))
    return s.select("district_id", "crop", "season", "season_year", "csi", "csi_max", "stages")


FW = "OVER (PARTITION BY district_id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)"


@query("d14_samples", f"{with_(DAILY, DOY, MONTHLY, INDEX)}, s AS (SELECT district_id, date, {_sum_sql('rain_mm', 7, 7)} AS ant_7, {_sum_sql('rain_mm', 30, 30)} AS ant_30, {_sum_sql('n', 30, 30)} AS norm_30, CASE WHEN count(rain_mm) {FW} = 7 THEN sum(rain_mm) {FW} END AS y, CASE WHEN count(n) {FW} = 7 THEN sum(n) {FW} END AS yn FROM norm) SELECT s.district_id, {day('s.date')} AS date, round(ant_7, 3) AS ant_7, round(ant_30, 3) AS ant_30, round(CASE WHEN norm_30 >= 5 THEN (ant_30 - norm_30) / norm_30 * 100 END, 3) AS dep_30, round(sin(2 * pi() * dayofyear(s.date) / 365.25e0), 6) AS doy_sin, round(mo.tmax_c, 4) AS tmax_prev, idx AS idx_prev, round(y, 3) AS next_7, round(CASE WHEN yn >= 5 THEN (y - yn) / yn * 100 END, 3) AS target FROM s LEFT JOIN monthly mo ON mo.district_id = s.district_id AND mo.month = CAST(date_trunc('month', s.date) - INTERVAL 1 MONTH AS DATE) LEFT JOIN idx ON idx.year = year(date_trunc('month', s.date) - INTERVAL 1 MONTH) AND idx.month = month(date_trunc('month', s.date) - INTERVAL 1 MONTH) WHERE dayofyear(s.date) % 5 = 0 AND year(s.date) >= 1996")
def d14(spark, d):
    x = A.daily(spark, d).withColumn("doy", F.dayofyear("date"))
    n = x.where(F.year("date").between(*BASE)).groupBy("district_id", "doy").agg(F.avg("rain_mm").alias("n"))
    x, w = x.join(n, ["district_id", "doy"], "left"), W.series()
    r, m = F.col("rain_mm"), F.col("n")
    s = x.select("district_id", "date", "doy", W.rolling_sum(r, w, 7).alias("ant_7"), W.rolling_sum(r, w, 30).alias("ant_30"), W.rolling_sum(m, w, 30).alias("norm_30"), W.forward_sum(r, w, 7).alias("y"), W.forward_sum(m, w, 7).alias("yn"))
    s = s.where((F.col("doy") % 5 == 0) & (F.year("date") >= 1996))
    s = joins.previous_month(s, monthly(spark, d).select("district_id", "month", "tmax_c"), "date", "month", ["district_id"])
    index = A.national_index(spark, d).select(F.make_date("year", "month", F.lit(1)).alias("month"), "idx")
    s = joins.previous_month(s, index, "date", "month", [])
    return s.select("district_id", txt(), F.round("ant_7", 3).alias("ant_7"), F.round("ant_30", 3).alias("ant_30"), F.round(percent_departure(F.col("ant_30"), F.col("norm_30")), 3).alias("dep_30"), r6(F.sin(2 * F.pi() * F.col("doy") / 365.25), "doy_sin"), r4(F.col("tmax_c"), "tmax_prev"), F.col("idx").alias("idx_prev"), F.round("y", 3).alias("next_7"), F.round(percent_departure(F.col("y"), F.col("yn")), 3).alias("target"))


@query("d15_scores", "WITH p AS (SELECT l_returnflag AS model, least(greatest(l_tax * 1000 - 40, -100), 1000) AS f, l_discount * 1000 - 50 AS y FROM lineitem) SELECT model, round(sqrt(avg(power(f - y, 2))), 4) AS rmse, round(1 - avg(power(f - y, 2)) / avg(y * y), 6) AS skill, round(corr(f, y), 6) AS r, round(avg(abs(f - y)), 4) AS mae, round(avg(CAST(CAST(f >= -20 AS INT) + CAST(f >= 20 AS INT) = CAST(y >= -20 AS INT) + CAST(y >= 20 AS INT) AS INT)), 6) AS accuracy FROM p GROUP BY 1")
def d15(spark, d):
    s = models.scores(A.table(spark, d, "lineitem").withColumn("model", F.col("l_returnflag")), "model", F.col("l_tax") * 1000 - 40, F.col("l_discount") * 1000 - 50, [-20, 20])
    return s.select("model", *[F.round(c, k).alias(c) for c, k in (("rmse", 4), ("skill", 6), ("r", 6), ("mae", 4), ("accuracy", 6))])


@query("x04_district_calibration", "SELECT s_nationkey AS district_id, CASE WHEN count(*) > 20 AND stddev_samp(l_tax) > 0 THEN round(least(greatest(regr_slope(l_discount, l_tax), -2), 4), 5) ELSE 1 END AS slope FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def x04(spark, d):
    x = A.table(spark, d, "lineitem").join(A.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.groupBy(F.col("s_nationkey").alias("district_id")).agg(F.round(models.calibration_slope(F.col("l_discount"), F.col("l_tax")), 5).alias("slope"))


@query("d18_inflate_and_quantile_map", "WITH s AS (SELECT s_suppkey, s_nationkey, s_acctbal AS p, s_acctbal * 0.5e0 + s_suppkey AS o FROM supplier), r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS i, row_number() OVER (PARTITION BY s_nationkey ORDER BY o, s_suppkey) AS k, avg(p) OVER (PARTITION BY s_nationkey) AS mu FROM s) SELECT a.s_suppkey, round(a.mu + 1.5e0 * (a.p - a.mu), 3) AS inflated, round(b.o, 4) AS mapped FROM r a JOIN r b ON a.s_nationkey = b.s_nationkey AND a.i = b.k")
def d18(spark, d):
    s = A.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.col("s_acctbal").alias("p"), (F.col("s_acctbal") * 0.5 + F.col("s_suppkey")).alias("o"))
    r = models.quantile_mapped(s, ["s_nationkey"], "p", "o", "s_suppkey", "to")
    return r.select("s_suppkey", F.round(models.inflated("p", ["s_nationkey"], 1.5), 3).alias("inflated"), r4(F.col("to"), "mapped"))


@query("j08_as_of_join", "WITH c AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d, max((o_orderkey, o_totalprice)) AS v FROM orders GROUP BY 1, 2), q AS (SELECT o_custkey, o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 90 AS INT) AS DATE) AS d FROM orders) SELECT q.id, strftime(c.d, '%Y-%m-%d') AS as_of, v[1] AS last_order, round(v[2], 2) AS last_price FROM q ASOF LEFT JOIN c ON q.o_custkey = c.o_custkey AND q.d >= c.d")
def j08(spark, d):
    o = A.table(spark, d, "orders")
    asked = o.select("o_custkey", F.col("o_orderkey").alias("id"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 90).cast("int")).alias("day"))
    known = o.select("o_custkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("last_order"), F.col("o_totalprice").alias("last_price"))
    return joins.as_of(asked, known, ["o_custkey"], "day", ["last_order", "last_price"]).select("id", txt("as_of"), "last_order", F.round("last_price", 2).alias("last_price"))


@query("j12_u08_spine", f"{with_(DAILY)} SELECT n_nationkey AS district_id, CAST(y AS INT) AS year, CAST(m AS INT) AS month FROM nation, (SELECT DISTINCT year(date) AS y FROM daily), range(1, 13) b(m)")
def j12(spark, d):
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("district_id"))
    years = A.calendar(spark, d).select(F.year("date").alias("year")).distinct()
    return n.crossJoin(F.broadcast(years)).select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))


@query("j14_allocation", f"{with_(REGISTRY)} SELECT district_id, round(t / n, 4) AS allocated FROM registry JOIN (SELECT state, count(*) AS n FROM registry GROUP BY 1) USING (state) JOIN (SELECT r_name AS state, sum(s_acctbal) AS t FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) USING (state)")
def j14(spark, d):
    r = A.registry(spark, d)
    totals = A.table(spark, d, "supplier").join(r, F.col("s_nationkey") == F.col("district_id")).groupBy("state").agg(F.sum("s_acctbal").alias("t"))
    return r.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("state"))).join(totals, "state").select("district_id", r4(F.col("t") / F.col("n"), "allocated"))


def _boxes(spark, d: str, name: str, key: str, size: str) -> DataFrame:
    x, y = (F.col(key) * 7 % 100).cast("double"), (F.col(key) * 13 % 90).cast("double")
    return A.table(spark, d, name).select(F.col(key).alias("id"), x.alias("x0"), (x + F.expr(size)).alias("x1"), y.alias("y0"), (y + F.expr(size)).alias("y1"))


def _boxes_sql(name: str, key: str, size: str) -> str:
    return f"(SELECT {key} AS id, CAST({key} * 7 % 100 AS DOUBLE) AS x0, {key} * 7 % 100 + {size} AS x1, CAST({key} * 13 % 90 AS DOUBLE) AS y0, {key} * 13 % 90 + {size} AS y1 FROM {name})"


@query("j16_box_overlap", f"WITH p AS (SELECT a.id AS a_id, b.id AS b_id, (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS o FROM {_boxes_sql('supplier', 's_suppkey', '6.5e0')} a JOIN {_boxes_sql('nation', 'n_nationkey', '9.0e0')} b ON least(a.x1, b.x1) > greatest(a.x0, b.x0) AND least(a.y1, b.y1) > greatest(a.y0, b.y0)) SELECT a_id, b_id, round(o, 4) AS overlap, round(o / sum(o) OVER (PARTITION BY a_id), 6) AS weight FROM p")
def j16(spark, d):
    return joins.box_overlap(_boxes(spark, d, "supplier", "s_suppkey", "6.5D"), _boxes(spark, d, "nation", "n_nationkey", "9.0D"), 10.0).select("a_id", "b_id", r4(F.col("overlap"), "overlap"), r6(F.col("weight"), "weight"))


@query("j18_nearest_neighbours", "WITH p AS (SELECT n_nationkey AS id, 8.0e0 + n_nationkey * 7 % 25 AS lat, 68.0e0 + n_nationkey * 11 % 29 AS lon FROM nation), k AS (SELECT a.id, b.id AS neighbour, 6371.0e0 * acos(least(greatest(sin(radians(a.lat)) * sin(radians(b.lat)) + cos(radians(a.lat)) * cos(radians(b.lat)) * cos(radians(a.lon - b.lon)), -1), 1)) AS km FROM p a JOIN p b ON a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY km, neighbour) AS rank FROM k) SELECT id, neighbour, round(km, 3) AS km, CAST(rank AS INT) AS rank, round(1 / greatest(km, 25) / sum(1 / greatest(km, 25)) OVER (PARTITION BY id), 6) AS weight FROM r WHERE rank <= 8")
def j18(spark, d):
    k = F.col("n_nationkey")
    p = A.table(spark, d, "nation").select(k.alias("id"), (F.lit(8.0) + k * 7 % 25).alias("lat"), (F.lit(68.0) + k * 11 % 29).alias("lon"))
    return joins.nearest(p).select("id", "neighbour", F.round("km", 3).alias("km"), "rank", r6(F.col("weight"), "weight"))


NAME = "trim(regexp_replace(regexp_replace(upper({}), '[^A-Z]+', ' ', 'g'), ' +', ' ', 'g'))"


@query("j19_fuzzy_names", f"""WITH a AS (SELECT p_partkey AS id, p_brand AS state, {NAME.format("p_name || ' ' || p_type")} AS n FROM part), b AS (SELECT min(p_partkey) AS key, p_brand AS state, {NAME.format('p_type')} AS m FROM part GROUP BY p_brand, p_type),
e AS (SELECT id, min(key) AS key, 1.0e0 AS likeness FROM a JOIN b ON a.state = b.state AND n = m GROUP BY 1),
s AS (SELECT id, key, len(list_intersect(list_distinct(string_split(n, ' ')), list_distinct(string_split(m, ' ')))) * 1.0e0 / least(len(list_distinct(string_split(n, ' '))), len(list_distinct(string_split(m, ' ')))) AS likeness FROM a JOIN b ON a.state = b.state WHERE id NOT IN (SELECT id FROM e)),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY likeness DESC, key) AS r FROM s WHERE likeness >= 0.5) SELECT id, key, round(likeness, 6) AS likeness FROM e UNION ALL SELECT id, key, round(likeness, 6) FROM f WHERE r = 1 UNION ALL SELECT a.id, u.key, 1.0e0 FROM a JOIN (SELECT m, min(key) AS key FROM b GROUP BY m HAVING count(DISTINCT key) = 1) u ON n = m WHERE a.id NOT IN (SELECT id FROM e) AND a.id NOT IN (SELECT id FROM f)""")
def j19(spark, d):
    p = A.table(spark, d, "part")
    left = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("state"), F.concat_ws(" ", "p_name", "p_type").alias("name"))
    right = p.groupBy(F.col("p_brand").alias("state"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("key"))
    return joins.fuzzy_names(left, right).select("id", "key", r6(F.col("likeness"), "likeness"))


@query("j21_overlay", "SELECT coalesce(a.k, b.k) AS month_key, round(coalesce(b.v, a.v), 4) AS v, CAST(a.k IS NULL AS INT) AS added FROM (SELECT month(o_orderdate) AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' AND month(o_orderdate) <= 9 GROUP BY 1) a FULL JOIN (SELECT month(o_orderdate) AS k, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' AND month(o_orderdate) >= 6 GROUP BY 1) b ON a.k = b.k")
def j21(spark, d):
    o = A.table(spark, d, "orders").withColumn("k", F.month("o_orderdate"))
    old = o.where("o_orderstatus = 'F' and k <= 9").groupBy("k").agg(F.avg("o_totalprice").alias("v"))
    new = o.where("o_orderstatus = 'O' and k >= 6").groupBy(F.col("k").alias("k2")).agg(F.avg("o_totalprice").alias("v2"))
    return old.join(new, F.col("k") == F.col("k2"), "full").select(F.coalesce("k", "k2").cast("long").alias("month_key"), r4(F.coalesce("v2", "v"), "v"), F.col("k").isNull().cast("int").alias("added"))


@query("j20_u05_u06_set_operations", "SELECT 'both' AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'no_orders', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def j20(spark, d):
    c, s, o = (A.table(spark, d, t) for t in ("customer", "supplier", "orders"))
    both = c.select("c_nationkey").intersect(s.select("s_nationkey")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("both").alias("kind"), "n")
    return both.union(c.join(o, c.c_custkey == o.o_custkey, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("no_orders"), "n"))


@query("u02_u03_pivot", "SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS F, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS O, CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS P FROM orders GROUP BY 1")
def u02(spark, d):
    return A.table(spark, d, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


@query("u07_keep_last", "WITH x AS (SELECT event_type, user_id, value, 0 AS fresh, event_id FROM events UNION ALL SELECT event_type, user_id, value, 1, event_id FROM events WHERE value > 50) SELECT event_type, user_id, round(value, 4) AS value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY fresh DESC, event_id DESC) AS r FROM x) WHERE r = 1")
def u07(spark, d):
    e = A.table(spark, d, "events")
    x = e.withColumn("fresh", F.lit(0)).union(e.where("value > 50").withColumn("fresh", F.lit(1)))
    return x.groupBy("event_type", "user_id").agg(F.max_by("value", F.struct("fresh", "event_id")).alias("value")).select("event_type", "user_id", r4(F.col("value"), "value"))


@query("t03_q05_most_affected", f"{with_(DAILY, MONTHLY, REGISTRY)} SELECT {day('month')} AS month, CAST(rank AS INT) AS rank, district, round(rain_mm, 4) AS rain_mm FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY rain_mm, district_id) AS rank FROM monthly JOIN registry USING (district_id) WHERE rain_mm IS NOT NULL) WHERE rank <= 12")
def t03(spark, d):
    m = monthly(spark, d).where("rain_mm is not null").join(A.registry(spark, d), "district_id")
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("month").orderBy("rain_mm", "district_id"))).where("rank <= 12").select(txt("month"), "rank", "district", r4(F.col("rain_mm"), "rain_mm"))


@query("t07_last_months", f"{with_(DAILY, MONTHLY)} SELECT district_id, {day('month')} AS month, round(rain_mm, 4) AS rain_mm FROM monthly WHERE month > (SELECT max(month) - INTERVAL 24 MONTH FROM monthly)")
def t07(spark, d):
    m = monthly(spark, d)
    last = m.agg(F.add_months(F.max("month"), -24).alias("after"))
    return m.join(F.broadcast(last), F.col("month") > F.col("after")).select("district_id", txt("month"), r4(F.col("rain_mm"), "rain_mm"))


@query("q07_search_and_sort", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(n_name || ' ' || c_mktsegment), 'build') ORDER BY c_acctbal NULLS LAST, c_custkey LIMIT 400")
def q07(spark, d):
    c = A.table(spark, d, "customer").join(A.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    hit = F.lower(F.concat_ws(" ", "n_name", "c_mktsegment")).contains("build")
    return c.where(hit).orderBy(F.col("c_acctbal").asc_nulls_last(), "c_custkey").limit(400).select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@query("q01_layer_with_fallback", f"{with_(DAILY, MONTHLY)}, x AS (SELECT district_id, arg_max(month, month) FILTER (rain_mm IS NOT NULL) AS at_month, arg_max(rain_mm, month) FILTER (rain_mm IS NOT NULL) AS v FROM monthly WHERE month < (SELECT max(month) FROM monthly) GROUP BY 1) SELECT district_id, strftime(at_month, '%Y-%m-%d') AS as_of, round(v, 4) AS rain_mm FROM x")
def q01(spark, d):
    m = A.with_last(monthly(spark, d), "month").where("month < last and rain_mm is not null")
    return m.groupBy("district_id").agg(F.max(F.struct("month", "rain_mm")).alias("v")).select("district_id", F.col("v.month").cast("string").alias("as_of"), r4(F.col("v.rain_mm"), "rain_mm"))


@query("q09_wide_export", f"{with_(DAILY, MONTHLY)} SELECT district_id, " + ", ".join(f"round(max(CASE WHEN month(month) = {m} THEN rain_mm END), 4) AS m{m:02d}" for m in range(1, 13)) + " FROM monthly WHERE year(month) = (SELECT max(year(month)) - 1 FROM monthly) GROUP BY 1")
def q09(spark, d):
    m = A.with_last(monthly(spark, d), "month").where("year(month) = year(last) - 1").withColumn("k", F.date_format("month", "'m'MM"))
    names = [f"m{k:02d}" for k in range(1, 13)]
    return m.groupBy("district_id").pivot("k", names).agg(F.max("rain_mm")).select("district_id", *[r4(F.col(n), n) for n in names])


@query("d20_d22_product_checks", f"{with_(DAILY)} SELECT district_id, CAST(count(*) AS BIGINT) AS days, CAST(count(DISTINCT date) AS BIGINT) AS distinct_days, CAST(count(*) - count(rain_mm) AS BIGINT) AS blanks, CAST(datediff('day', min(date), max(date)) + 1 - count(DISTINCT date) AS BIGINT) AS gaps, CAST(count(*) FILTER (rain_mm < 0 OR rain_mm > 500) AS BIGINT) AS out_of_range FROM daily GROUP BY 1")
def d20(spark, d):
    return checks.product_checks(A.daily(spark, d), ["district_id"], "date", "rain_mm", (0, 500))


@query("d21_feed_comparison", "WITH a AS (SELECT l_orderkey AS k, l_linenumber AS l, l_quantity AS v FROM lineitem WHERE l_orderkey % 7 <> 0), b AS (SELECT l_orderkey AS k, l_linenumber AS l, l_quantity + CAST(l_orderkey % 11 = 0 AS INT) AS v FROM lineitem WHERE l_orderkey % 5 <> 0) SELECT CAST(count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS BIGINT) AS shared, CAST(count(*) FILTER (a.k IS NULL) AS BIGINT) AS added, CAST(count(*) FILTER (b.k IS NULL) AS BIGINT) AS lost, CAST(count(*) FILTER (abs(a.v - b.v) > 1e-6) AS BIGINT) AS revised FROM a FULL JOIN b ON a.k = b.k AND a.l = b.l")
def d21(spark, d):
    x = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("l"), F.col("l_quantity").alias("v"))
    new = x.where("k % 5 <> 0").withColumn("v", F.col("v") + (F.col("k") % 11 == 0).cast("int"))
    return checks.compare_feeds(x.where("k % 7 <> 0"), new, ["k", "l"], "v")


@query("s18_json_fields", "SELECT event_type, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def s18(spark, d):
    return A.table(spark, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k long")["k"]).alias("k"))
