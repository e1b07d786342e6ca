"""The feature table in full and with its running month refilled; grids resampled; matrices with a column a unit."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators import grids as G
from agrolith.operators import indices
from agrolith.operators import panel as P
from agrolith.plans.climate import BASE, r4, txt
from agrolith.plans.domain import r6
from agrolith.plans.panel import ALL, REST, master
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, day, with_
from agrolith.sources import adapters as A
from agrolith.streaming.runtime import shared_path

SCALES = (1, 4, 12)
#: A value below the lower end of the fitted distribution has no probability, and so no index.
_FIT = REST.replace("n >= 5 THEN", "n >= 5 AND NOT coalesce(a > 0 AND x < g, false) THEN")
_Z = indices.inverse_normal_sql("p", "e0")


def _scale(s: int) -> str:
    """A common table with the index of one scale; the method's own tables stay inside."""
    own = f"ac AS (SELECT *, CASE WHEN count(wb_mm) OVER f = {s} THEN sum(wb_mm) OVER f END AS acc FROM wb WINDOW f AS (PARTITION BY district_id ORDER BY month ROWS BETWEEN {s - 1} PRECEDING AND CURRENT ROW)), b AS (SELECT district_id * 100 + month(month) AS district_id, month, round(acc, 9) AS x FROM ac)"
    return f"z{s} AS (SELECT CAST(district_id // 100 AS INT) AS district_id, month, {_Z} AS z FROM (WITH {own},\n{_FIT} SELECT * FROM p))"


_THERMAL = f"""t0 AS (SELECT district_id, CAST(date_trunc('month', date) AS DATE) AS month, CAST(count(*) FILTER (tmax_c IS NOT NULL AND tmin_c IS NOT NULL) AS BIGINT) AS temp_days, sum(greatest((tmax_c + tmin_c) / 2 - 10, 0)) FILTER (tmax_c IS NOT NULL AND tmin_c IS NOT NULL) AS k, sum(greatest((tmax_c + tmin_c) / 2 - 5, 0)) FILTER (tmax_c IS NOT NULL AND tmin_c IS NOT NULL) AS r, sum(greatest(tmax_c - 34, 0)) FILTER (tmax_c IS NOT NULL AND tmin_c IS NOT NULL) AS s FROM daily GROUP BY 1, 2),
t1 AS (SELECT district_id, month, temp_days, CASE WHEN temp_days >= 3 AND month(month) IN (6, 7, 8, 9, 10) THEN k END AS gdd_kharif, CASE WHEN temp_days >= 3 AND month(month) IN (11, 12, 1, 2, 3) THEN r END AS gdd_rabi, CASE WHEN temp_days >= 3 THEN s END AS sdd FROM t0),
t2 AS (SELECT district_id, month(month) AS m, avg(gdd_kharif) AS kn, avg(gdd_rabi) AS rn, avg(sdd) AS sn FROM t1 WHERE year(month) BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY 1, 2),
th AS (SELECT t1.*, gdd_kharif - kn AS gdd_kharif_anom, gdd_rabi - rn AS gdd_rabi_anom, sdd - sn AS sdd_anom FROM t1 LEFT JOIN t2 ON t2.district_id = t1.district_id AND m = month(t1.month))"""
_SHOWN = ["gdd_kharif", "gdd_rabi", "sdd", "gdd_kharif_anom", "gdd_rabi_anom", "sdd_anom"]


def table(spark, d):
    """Panel, water balance, drought index of SCALES and thermal sums, stored once; whatever rests on too few days is masked."""
    full = P.features(master(spark, d), list(SCALES), least=5, complete=3, digits=9)
    both = full.join(P.thermal(A.daily(spark, d), BASE, 3), ["district_id", "month"], "left")
    enough = F.col("days") >= 3
    out = P.masked(both, {"rain_dep": [enough], "mai": [enough, F.col("temp_days") >= 3], "tmax_anom": [F.col("temp_days") >= 3]})
    path = shared_path(spark, "features")
    out.write.parquet(path)
    return spark.read.parquet(path)


_FULL = f"""{with_(*ALL)}, wb AS (SELECT *, CASE WHEN days >= 3 THEN rain_mm - pet_mm END AS wb_mm FROM panel), {", ".join(map(_scale, SCALES))}, {_THERMAL},
ft AS (SELECT wb.district_id, wb.month, wb.days, temp_days, rain_mm, CASE WHEN days >= 3 THEN rain_dep END AS rain_dep, CASE WHEN days >= 3 AND temp_days >= 3 THEN mai END AS mai, CASE WHEN temp_days >= 3 THEN tmax_anom END AS tmax_anom, {", ".join(f"z{s}.z AS spei_{s}" for s in SCALES)}, {", ".join(_SHOWN)} FROM wb LEFT JOIN th ON th.district_id = wb.district_id AND th.month = wb.month {" ".join(f"LEFT JOIN z{s} ON z{s}.district_id = wb.district_id AND z{s}.month = wb.month" for s in SCALES)})"""


@query("d04_features_in_full", f"{_FULL} SELECT district_id, {day('month')} AS month, temp_days, round(rain_dep, 4) AS rain_dep, round(mai, 6) AS mai, round(tmax_anom, 6) AS tmax_anom, {', '.join(f'round(spei_{s}, 3) + 0.0e0 AS spei_{s}' for s in SCALES)}, {', '.join(f'round({c}, 6) AS {c}' for c in _SHOWN)} FROM ft")
def d04_full(spark, d):
    x = table(spark, d)
    return x.select("district_id", txt("month"), "temp_days", r4(F.col("rain_dep"), "rain_dep"), r6(F.col("mai"), "mai"), r6(F.col("tmax_anom"), "tmax_anom"), *[F.round(f"spei_{s}", 3).alias(f"spei_{s}") for s in SCALES], *[r6(F.col(c), c) for c in _SHOWN])


_TO_DATE = f"""la AS (SELECT max(date) AS last FROM daily WHERE rain_mm IS NOT NULL),
pd AS (SELECT d.*, year(date) AS y FROM daily d, la WHERE month(date) = month(last) AND day(date) <= day(last)),
pu AS (SELECT district_id, y, sum(rain_mm) AS rain, avg(tmax_c) AS tmax, sum(CASE WHEN tmax_c IS NOT NULL THEN greatest(tmax_c - 34, 0) END) AS sdd FROM pd GROUP BY 1, 2),
pn AS (SELECT district_id, avg(rain) AS rn, avg(tmax) AS tn, avg(sdd) AS sn FROM pu WHERE y BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY 1),
td AS (SELECT pu.district_id, CAST(date_trunc('month', last) AS DATE) AS month, rain, CASE WHEN rn >= 5 THEN (rain - rn) / rn * 100 END AS dep, tmax - tn AS ta, pu.sdd, pu.sdd - sn AS sa FROM pu JOIN la ON y = year(last) LEFT JOIN pn USING (district_id))"""


@query("d05_refilled_features", f"{_FULL}, {_TO_DATE} SELECT ft.district_id, {day('ft.month')} AS month, round(CASE WHEN td.month IS NULL THEN rain_mm ELSE rain END, 4) AS rain_mm, round(CASE WHEN td.month IS NULL THEN rain_dep ELSE dep END, 4) AS rain_dep, round(CASE WHEN td.month IS NULL THEN tmax_anom ELSE ta END, 6) AS tmax_anom, round(CASE WHEN td.month IS NULL THEN ft.sdd ELSE td.sdd END, 6) AS sdd, round(CASE WHEN td.month IS NULL THEN sdd_anom ELSE sa END, 6) AS sdd_anom, round(ft.spei_1, 3) + 0.0e0 AS spei_1, CAST(td.month IS NOT NULL AS INT) AS is_month_to_date FROM ft LEFT JOIN td ON td.district_id = ft.district_id AND td.month = ft.month")
def d05_refilled(spark, d):
    """The running month's figures are those of its first days. Its drought index is that of the whole table here; ``x05_partial_spei`` has the one to date."""
    features = table(spark, d)
    now = P.running_month(A.daily(spark, d), BASE, (F.col("district_id") + 10).cast("double"), [])
    x = P.refilled(features, now)
    return x.select("district_id", txt("month"), r4(F.col("rain_mm"), "rain_mm"), r4(F.col("rain_dep"), "rain_dep"), *[r6(F.col(c), c) for c in ("tmax_anom", "sdd", "sdd_anom")], F.round("spei_1", 3).alias("spei_1"), "is_month_to_date")


@query("s17_wide_matrix", f"{with_(DAILY)} SELECT {day()} AS date, district_id, rain_mm FROM daily WHERE rain_mm IS NOT NULL AND district_id < 20")
def s17(spark, d):
    """Days by districts, with a column that is no district, written and read as a matrix with a column a district."""
    path = shared_path(spark, "matrix")
    rows = A.observed_rain(spark, d).where("district_id < 20")
    wide = G.to_wide(rows, "date", "district_id", "rain_mm", list(range(20))).withColumn("note", F.lit("x"))
    wide.write.parquet(path)
    read = spark.read.parquet(path).drop("note")
    return G.from_wide(read, "date", "district_id", "rain_mm").select(txt(), "district_id", "rain_mm")


@query("a30_bilinear_zonal_mean", """WITH c AS (SELECT p_size // 10 AS r, p_size % 10 AS c, CAST(p_size % 7 AS INT) AS k, avg(p_retailprice) AS v FROM part WHERE p_size <> 23 GROUP BY 1, 2, 3),
p AS (SELECT c_custkey AS id, c_nationkey AS zone, (c_custkey * 37 % 900) / 100.0e0 AS x, (c_custkey * 53 % 400) / 100.0e0 AS y FROM customer),
n AS (SELECT id, zone, floor(y) + i AS r, floor(x) + j AS c, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM p, range(2) a(i), range(2) b(j)),
v AS (SELECT id, any_value(zone) AS zone, sum(w * v) FILTER (v IS NOT NULL) / sum(w) FILTER (v IS NOT NULL) AS v FROM (SELECT n.*, u.v FROM n LEFT JOIN (SELECT r, c, avg(v) AS v FROM c GROUP BY 1, 2) u ON u.r = n.r AND u.c = n.c WHERE w > 0) GROUP BY id)
SELECT zone, round(avg(v), 4) AS mean, round(count(v) * 1.0e0 / count(*), 6) AS valid_share FROM v GROUP BY 1""")
def a30(spark, d):
    """A grid of sizes, of which one cell is masked, resampled at customers' places and averaged by nation."""
    part = A.table(spark, d, "part").where("p_size <> 23")
    cells = part.groupBy(F.floor(F.col("p_size") / 10).alias("row"), (F.col("p_size") % 10).alias("column")).agg(F.avg("p_retailprice").alias("v"))
    k = F.col("c_custkey")
    points = A.table(spark, d, "customer").select(k.alias("id"), F.col("c_nationkey").alias("zone"), (k * 37 % 900 / 100.0).alias("x"), (k * 53 % 400 / 100.0).alias("y"))
    values = G.bilinear(points.drop("zone"), cells, 0.0, 0.0, 1.0)
    zones = G.zonal_mean(points.select("id", "zone").join(values, "id", "left"), "zone", [])
    return zones.select("zone", r4(F.col("mean"), "mean"), r6(F.col("valid_share"), "valid_share"))


