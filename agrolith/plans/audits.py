"""Definition checks in full, product checks, and the display audit from files to months."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.functions.nulls import percent_departure
from agrolith.operators import definitions as D
from agrolith.operators import panel as P
from agrolith.operators.reliability import limited
from agrolith.plans.climate import BASE, monthly, r4
from agrolith.plans.domain import r6
from agrolith.plans.more import CELLS, RELIABILITY, grid
from agrolith.plans.panel import ALL, LAYERS, REST, long, master
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, MONTHLY, with_
from agrolith.sources import adapters as A
from agrolith.sources import files
from agrolith.streaming.runtime import shared_path

JJAS = [6, 7, 8, 9]
B = f"BETWEEN {BASE[0]} AND {BASE[1]}"


def _row(test: str, got: str, expected: str, tolerance: str, passed: str | None = None) -> str:
    return f"SELECT {test} AS test, CAST({got} AS DOUBLE) AS got, CAST({expected} AS DOUBLE) AS expected, CAST({tolerance} AS DOUBLE) AS tolerance, coalesce({passed or f'abs(({got}) - ({expected})) <= {tolerance}'}, false) AS passed"


_CHECKS = f"""{with_(*ALL)},
pub AS (SELECT CAST(year(o_orderdate) AS INT) AS year, 100.0e0 * avg(o_totalprice) / (SELECT avg(o_totalprice) FROM orders) AS percent FROM orders GROUP BY 1),
pm AS (SELECT CAST(month(o_orderdate) AS INT) AS month, avg(o_totalprice) / 50 AS mm FROM orders GROUP BY 1),
ut AS (SELECT district_id, CAST(year(date) AS INT) AS year, CASE WHEN count(rain_mm) >= 10 THEN sum(rain_mm) END AS t FROM daily WHERE month(date) IN (6, 7, 8, 9) GROUP BY 1, 2),
sn AS (SELECT year, sum(t * area) FILTER (area > 0) / sum(area) FILTER (area > 0 AND t IS NOT NULL) AS v FROM ut JOIN registry USING (district_id) GROUP BY 1),
bs AS (SELECT avg(v) AS base FROM sn WHERE year {B}),
bo AS (SELECT year, percent, 100 * v / base AS own FROM pub JOIN sn USING (year), bs WHERE v IS NOT NULL),
um AS (SELECT district_id, CAST(year(date) AS INT) AS year, CAST(month(date) AS INT) AS month, sum(rain_mm) AS t FROM daily GROUP BY ALL),
nm AS (SELECT year, month, sum(t * area) FILTER (area > 0) / sum(area) FILTER (area > 0 AND t IS NOT NULL) AS v FROM um JOIN registry USING (district_id) GROUP BY 1, 2),
mo2 AS (SELECT month, avg(v) AS own FROM nm WHERE year {B} GROUP BY 1),
la AS (SELECT max(date) AS last FROM daily WHERE rain_mm IS NOT NULL),
pt AS (SELECT * FROM daily, la WHERE rain_mm IS NOT NULL AND month(date) = month(last) AND day(date) <= day(last)),
dn2 AS (SELECT district_id, day(date) AS dd, avg(rain_mm) FILTER (year(date) {B}) AS n FROM pt GROUP BY 1, 2),
nu AS (SELECT pt.district_id, sum(rain_mm) AS a, sum(n) AS n FROM pt LEFT JOIN dn2 ON dn2.district_id = pt.district_id AND dd = day(date) WHERE year(date) = year(last) GROUP BY 1),
di AS (SELECT 100 * sum((a - n) * area) / sum(n * area) FILTER (a IS NOT NULL) AS direct FROM nu JOIN registry USING (district_id)),
sh AS (SELECT 100 * sum((rain_mm - rain_normal) * area) / sum(rain_normal * area) FILTER (rain_mm IS NOT NULL) AS shown FROM panel, la WHERE month = date_trunc('month', last)),
sf AS (SELECT max(abs(x)) AS x, max(abs(n)) AS n FROM (SELECT avg(tmax_c) FILTER (year(month) {B}) - avg(tmax_c) FILTER (year(month) BETWEEN 1996 AND 1997) AS x, avg(tmin_c) FILTER (year(month) {B}) - avg(tmin_c) FILTER (year(month) BETWEEN 1996 AND 1997) AS n FROM monthly WHERE month(month) IN (6, 7, 8, 9) GROUP BY district_id, month(month))),
wb AS (SELECT *, CASE WHEN days >= 3 THEN rain_mm - pet_mm END AS wb_mm FROM panel), ac AS (SELECT *, CASE WHEN count(wb_mm) OVER f = 2 THEN sum(wb_mm) OVER f END AS acc FROM wb WINDOW f AS (PARTITION BY district_id ORDER BY month ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)), b AS (SELECT district_id * 100 + month(month) AS district_id, month, round(acc, 9) AS x FROM ac),
{REST},
ma AS (SELECT min(mai) AS lo, max(mai) AS hi, avg(mai) FILTER (month(month) IN (6, 7, 8, 9)) AS wet, avg(mai) FILTER (month(month) IN (1, 2, 3)) AS dry, avg(tmax_anom) FILTER (year(month) {B}) AS xa, avg(tmin_anom) FILTER (year(month) {B}) AS na, max(abs(100 * (rain_mm - rain_normal) / rain_normal - rain_dep)) FILTER (rain_normal >= 5) AS worst FROM panel),
pk AS (SELECT m FROM (SELECT month(month) AS m, round(avg(tmax_c), 9) AS v FROM panel GROUP BY 1) WHERE v IS NOT NULL ORDER BY v DESC, m LIMIT 1)
SELECT test, round(got, 4) AS got, round(expected, 4) AS expected, round(tolerance, 4) AS tolerance, passed FROM (
{_row("'season: mean'", "base", "100", "45")} FROM bs UNION ALL {_row("'season ' || year", "own", "percent", "6")} FROM bo
UNION ALL {_row("'season: mean difference'", "avg(abs(own - percent))", "0", "5")} FROM bo UNION ALL {_row("'season: correlation'", "corr(own, percent)", "1", "0.15")} FROM bo
UNION ALL {_row("'monthly mean ' || lpad(CAST(pm.month AS VARCHAR), 2, '0')", "own", "mm", "greatest(3.0e0, 0.08e0 * mm)")} FROM pm LEFT JOIN mo2 USING (month)
UNION ALL {_row("'part of a month against the same days'", "shown", "direct", "1")} FROM sh, di
UNION ALL {_row("'tmax_c: shift of the baseline'", "x", "0", "0.6")} FROM sf UNION ALL {_row("'tmin_c: shift of the baseline'", "n", "0", "0.6")} FROM sf
UNION ALL {_row("'spei_2: mean'", "avg(z)", "0", "0.2")} FROM (SELECT ZZZ AS z FROM p WHERE p IS NOT NULL) UNION ALL {_row("'spei_2: deviation'", "stddev_samp(z)", "1", "0.2")} FROM (SELECT ZZZ AS z FROM p WHERE p IS NOT NULL)
UNION ALL {_row("'mai: lowest'", "lo", "0", "0.001", "lo >= -0.001")} FROM ma UNION ALL {_row("'mai: highest'", "hi", "1.5", "0.001", "hi <= 1.501")} FROM ma
UNION ALL {_row("'mai: high season above low'", "wet", "dry", "0", "wet > dry")} FROM ma UNION ALL {_row("'tmax_c: month of its peak'", "m", "5", "1", "m IN (4, 5, 6)")} FROM pk
UNION ALL {_row("'tmax_anom: mean over its baseline'", "xa", "0", "0.05")} FROM ma UNION ALL {_row("'tmin_anom: mean over its baseline'", "na", "0", "0.05")} FROM ma
UNION ALL {_row("'rain_dep: recomputed'", "worst", "0", "0.001")} FROM ma)"""


def _checks_sql() -> str:
    from agrolith.operators import indices

    return _CHECKS.replace("ZZZ", indices.inverse_normal_sql("p", "e0"))


@query("d23_definitions_in_full", _checks_sql())
def d23_full(spark, d):
    """All kinds of checks on the panel and its features; orders stand in for published figures."""
    path = shared_path(spark, "panel")
    master(spark, d).write.parquet(path)  # read by every check
    panel, daily, reg = spark.read.parquet(path), A.daily(spark, d), A.registry(spark, d)
    o = A.table(spark, d, "orders")
    published = o.groupBy(F.year("o_orderdate").alias("year")).agg(F.avg("o_totalprice").alias("v")).crossJoin(F.broadcast(o.agg(F.avg("o_totalprice").alias("all")))).select("year", (100 * F.col("v") / F.col("all")).alias("percent"))
    by_month = o.groupBy(F.month("o_orderdate").alias("month")).agg((F.avg("o_totalprice") / 50).alias("mm"))
    spei = P.features(panel, [2], least=5, complete=3, digits=9)
    checks = D.together(
        D.against_published(D.season_totals(daily, reg, JJAS, 10), published, BASE, "season", 100.0, 45.0),
        D.monthly_normals(daily, reg, by_month, BASE),
        D.part_month(daily, panel, reg, BASE),
        D.baseline_shift(monthly(spark, d), ["tmax_c", "tmin_c"], JJAS, BASE, (1996, 1997)),
        D.standardised(spei, ["spei_2"]),
        D.bounded(panel, {"mai": (0.0, 1.5)}),
        D.seasonal(panel, "mai", JJAS, [1, 2, 3]),
        D.peak(panel, "tmax_c", [4, 5, 6]),
        D.centred(panel, ["tmax_anom", "tmin_anom"], BASE),
        D.recomputed(panel, "rain_mm", "rain_normal", "rain_dep"),
    )
    return checks.select("test", *[r4(F.col(c), c) for c in ("got", "expected", "tolerance")], "passed")


@query("d22_product_files", f"{with_(DAILY)}, x AS (SELECT * FROM daily UNION ALL SELECT * FROM daily WHERE district_id = 3 AND date = (SELECT min(date) + 40 FROM daily)), y AS (SELECT CAST(year(date) AS INT) AS file, * FROM x WHERE NOT (month(date) = 5 AND day(date) = 5 AND year(date) % 3 = 0)) SELECT file, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT date) * 25 AS BIGINT) AS expected, CAST(count(*) - count(DISTINCT (district_id, date)) AS BIGINT) AS repeated, CAST(max(date) - min(date) + 1 - count(DISTINCT date) AS BIGINT) AS gaps, CAST(count(*) - count(rain_mm) AS BIGINT) AS blank, CAST(count(*) FILTER (rain_mm = 0) AS BIGINT) AS zero, count(*) = count(DISTINCT date) * 25 AND count(*) = count(DISTINCT (district_id, date)) AND max(date) - min(date) + 1 = count(DISTINCT date) AS complete FROM y GROUP BY 1")
def d22_files(spark, d):
    """Files of a year each; in the first a unit's day is twice there, in each third a day is absent."""
    x = A.daily(spark, d)
    first = x.agg(F.date_add(F.min("date"), 40).alias("twice"))
    again = x.crossJoin(F.broadcast(first)).where("district_id = 3 and date = twice").drop("twice")
    rows = x.union(again).where("not (month(date) = 5 and day(date) = 5 and year(date) % 3 = 0)")
    got = D.product_files(rows, F.year("date"), ["district_id"], "date", "rain_mm", A.table(spark, d, "nation").count())
    return got.withColumn("gaps", F.col("gaps").cast("long"))


@query("d22_blanks_by_month", f"{with_(DAILY)}, n AS (SELECT district_id, month(date) AS m, day(date) AS dd, avg(rain_mm) AS n FROM daily WHERE year(date) {B} GROUP BY ALL) SELECT CAST(month(date) AS INT) AS month, CAST(count(*) AS BIGINT) AS rows, round(100.0e0 * count(*) FILTER (rain_mm IS NULL OR n IS NULL OR n < 5) / count(*), 4) AS blank_percent, round(100.0e0 * count(*) FILTER (rain_mm = 0) / count(*), 4) AS zero_percent FROM daily d LEFT JOIN n ON n.district_id = d.district_id AND m = month(date) AND dd = day(date) GROUP BY 1")
def d22_months(spark, d):
    x = A.daily(spark, d).withColumns({"m": F.month("date"), "dd": F.dayofmonth("date")})
    n = x.where(F.year("date").between(*BASE)).groupBy("district_id", "m", "dd").agg(F.avg("rain_mm").alias("n"))
    rows = x.join(n, ["district_id", "m", "dd"], "left").withColumn("dep", percent_departure(F.col("rain_mm"), F.col("n")))
    return D.blanks_by_month(rows, "date", "rain_mm", "dep").select("month", "rows", r4(F.col("blank_percent"), "blank_percent"), r4(F.col("zero_percent"), "zero_percent"))


_COVER = "(CASE WHEN month(date) % 2 = 0 THEN district_id / 25.0e0 ELSE district_id / 50.0e0 END)"


@query("d22_dead_and_thin_units", f"{with_(DAILY)} SELECT district_id, CASE WHEN count(v) = 0 THEN 'dead' ELSE 'thin' END AS kind, round(avg(c), 6) AS coverage FROM (SELECT district_id, CASE WHEN district_id % 11 <> 5 THEN rain_mm END AS v, {_COVER} AS c FROM daily) GROUP BY 1 HAVING count(v) = 0 OR (avg(c) > 0 AND avg(c) < 0.5)")
def d22_units(spark, d):
    cover = F.when(F.month("date") % 2 == 0, F.col("district_id") / 25.0).otherwise(F.col("district_id") / 50.0)
    x = A.daily(spark, d).withColumn("v", F.when(F.col("district_id") % 11 != 5, F.col("rain_mm"))).withColumn("c", cover)
    return D.dead_and_thin(x, A.registry(spark, d), "district_id", "v", "c").select("district_id", "kind", r6(F.col("coverage"), "coverage"))


@query("d09_resolution_limited", f"{with_(DAILY, MONTHLY, CELLS, RELIABILITY)} SELECT district_id, round(eff, 4) AS effective_cells, eff < 1.5 AS resolution_limited FROM e")
def d09_limited(spark, d):
    weights, _ = grid(spark, d)
    return limited(weights).select("district_id", r4(F.col("effective_cells"), "effective_cells"), "resolution_limited")


@query("d27_files_and_columns", f"{with_(DAILY, MONTHLY)} SELECT 'file' AS stage, 'months' AS name, CAST(count(*) AS DOUBLE) AS found, 'ok' AS verdict FROM monthly UNION ALL SELECT 'file', 'nothing', 0, 'empty' UNION ALL SELECT 'file', 'absent', NULL, 'missing' UNION ALL SELECT 'file', 'broken', NULL, 'unreadable' UNION ALL SELECT 'column', 'district_id', 1.0, 'full' UNION ALL SELECT 'column', 'rain_mm', round(count(rain_mm) * 1.0e0 / count(*), 6), 'partial' FROM monthly UNION ALL SELECT 'column', 'void', 0.0, 'empty' UNION ALL SELECT 'column', 'spei', NULL, 'missing'")
def d27_files(spark, d):
    """The files that a display reads, then the columns of the first."""
    path = shared_path(spark, "display")
    m = monthly(spark, d).withColumn("void", F.lit(None).cast("double"))
    m.write.parquet(f"{path}/months")
    m.limit(0).write.parquet(f"{path}/nothing")
    m.limit(3).selectExpr("cast(district_id as string) as value").write.text(f"{path}/broken")
    stage = files.file_stage(spark, {n: (f"{path}/{n}", "parquet") for n in ("months", "nothing", "absent", "broken")})
    columns = D.column_stage(spark.read.parquet(f"{path}/months"), ["district_id", "rain_mm", "void", "spei"])
    one = stage.select(F.lit("file").alias("stage"), "name", F.col("rows").cast("double").alias("found"), F.col("status").alias("verdict"))
    return one.union(columns.select(F.lit("column"), F.col("column"), F.round("share", 6), "verdict"))


@query("d27_month_slots", f"{with_(DAILY, MONTHLY, LAYERS)}, x AS (SELECT * FROM l WHERE layer <> 'tmin_c' OR (month(month) <> 4 AND month >= (SELECT max(month) FROM l) - INTERVAL 20 MONTH)), s AS (SELECT month, row_number() OVER (ORDER BY month) AS slot FROM (SELECT DISTINCT month FROM l WHERE month > (SELECT max(month) FROM l) - INTERVAL 24 MONTH)), h AS (SELECT layer, count(*) AS n, min(slot) AS a, max(slot) AS b FROM (SELECT DISTINCT layer, month FROM x) JOIN s USING (month) GROUP BY 1) SELECT layer, CAST(n AS BIGINT) AS months, CAST(b - a + 1 - n AS BIGINT) AS holes, CAST(a - 1 AS BIGINT) AS late, CASE WHEN b - a + 1 > n THEN 'HOLE' WHEN a > 1 THEN 'starts late' ELSE 'ok' END AS verdict FROM h")
def d27_slots(spark, d):
    x = long(spark, d)
    with_last = A.with_last(x, "month")
    shown = with_last.where("layer <> 'tmin_c' or (month(month) <> 4 and month >= add_months(last, -20))").drop("last")
    return D.month_slots(shown, with_last.where("month > add_months(last, -24)").select("month").distinct())

