"""Blocks of the payload, written as JSON and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators import crops, ocean
from agrolith.operators import payload as Y
from agrolith.plans.climate import NORMAL, monthly
from agrolith.plans.domain import CROPS, STATE, crop_panel
from agrolith.plans.panel import LAYERS, long
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, INDEX, MONTHLY, REGISTRY, with_
from agrolith.sources import adapters as A
from agrolith.streaming.runtime import shared_path


def read_back(spark, blocks, name: str, schema: str):
    """Write the blocks, read one of them, and parse its lines: key and value."""
    path = shared_path(spark, "payload")
    Y.write(blocks, path)
    lines = spark.read.text(f"{path}/block={name}")
    return lines.select(F.from_json("value", f"key string, value struct<{schema}>").alias("r")).select("r.key", "r.value.*")


_NEWEST = """hh AS (SELECT * FROM (SELECT *, max(sy) OVER (PARTITION BY crop) AS latest FROM h) WHERE stages >= 4 OR sy >= latest),
nw AS (SELECT hh.*, state, area * 1000.0e0 * CASE WHEN crop LIKE '%e%' THEN 2 ELSE 1 END AS ha, CASE WHEN stages >= 4 THEN csi ELSE coalesce(round(CASE WHEN csi_max > 1e-9 THEN least(greatest(csi / csi_max, 0), 1) END, 3), 0) END >= 0.5 AS hit FROM hh JOIN registry USING (district_id) WHERE sy = (SELECT max(sy) FROM hh)),
ts AS (SELECT crop, state, v, row_number() OVER (PARTITION BY crop ORDER BY round(v, 9) DESC NULLS LAST, state) AS i FROM (SELECT crop, state, avg(csi) AS v FROM nw GROUP BY 1, 2)),
cy AS (SELECT crop, stage, avg(csi) AS v FROM st WHERE sy = (SELECT max(sy) FROM hh) GROUP BY 1, 2)"""


@query("d28_crops_block", f"""{with_(DAILY, MONTHLY, REGISTRY, NORMAL, CROPS)}, {_NEWEST}
SELECT crop, CAST(max(sy) AS INT) AS season_year, CAST(max(stages) AS BIGINT) AS stages_elapsed, round(avg(csi), 2) AS mean, CAST(count(DISTINCT district_id) AS BIGINT) AS districts, CAST(count(*) FILTER (hit) AS BIGINT) AS high, round(sum(ha) / 1e6, 4) AS area_mha, round(coalesce(sum(ha) FILTER (hit), 0) / 1e6, 4) AS risk_mha, round(100 * coalesce(sum(ha) FILTER (hit), 0) / sum(ha), 2) AS risk_share,
(SELECT string_agg(state, ', ' ORDER BY i) FROM ts WHERE ts.crop = nw.crop AND i <= 6) AS states, (SELECT count(*) FROM cy WHERE cy.crop = nw.crop) AS done, CAST(count(csi) AS INT) AS shown FROM nw GROUP BY crop""")
def d28_crops(spark, d):
    stages = crops.stage_stress(crop_panel(spark, d), digits=9)
    stress, reg = crops.season_stress(stages), A.registry(spark, d)
    areas = stress.select("district_id", "crop").distinct().join(reg, "district_id").select("district_id", "crop", (F.col("area") * 1000 * F.when(F.col("crop").contains("e"), 2).otherwise(1)).alias("ha"))
    blocks = Y.crops(stress, stages, reg, areas, order=crops.STAGES)
    got = read_back(spark, blocks, "crops", "season_year int, stages_elapsed long, mean double, districts long, high long, area_mha double, risk_mha double, risk_share double, top_states array<struct<s: string, csi: double>>, cycle array<struct<stage: string, done: boolean>>, v map<string, double>")
    done = F.size(F.filter("cycle", lambda s: s["done"])).cast("long")
    return got.select(F.col("key").alias("crop"), "season_year", "stages_elapsed", "mean", "districts", "high", "area_mha", "risk_mha", "risk_share", F.array_join(F.transform("top_states", lambda s: s["s"]), ", ").alias("states"), done.alias("done"), F.size("v").alias("shown"))


@query("d28_context_block", f"{with_(DAILY, MONTHLY, REGISTRY, LAYERS)} SELECT district_id, district, state, layer, strftime(max(month), '%Y-%m-%d') AS as_of, round(arg_max(v, month), 2) AS v FROM l JOIN registry USING (district_id) GROUP BY 1, 2, 3, 4")
def d28_context(spark, d):
    got = read_back(spark, Y.context(long(spark, d), A.registry(spark, d)), "context", "id int, d string, s string, layers map<string, struct<as_of: string, v: double>>")
    return got.select(F.col("id").alias("district_id"), F.col("d").alias("district"), F.col("s").alias("state"), F.explode("layers").alias("layer", "l")).select("district_id", "district", "state", "layer", "l.*")


@query("d28_ocean_block", f"{with_(INDEX, STATE)}, x AS (SELECT *, make_date(year, month, 1) AS m, CASE WHEN idx >= 0.5 THEN 1 WHEN idx <= -0.5 THEN -1 ELSE 0 END AS side FROM state WHERE idx IS NOT NULL), g AS (SELECT *, sum(CAST(coalesce(side <> lag(side) OVER (ORDER BY m) OR date_diff('month', lag(m) OVER (ORDER BY m), m) <> 1, true) AS INT)) OVER (ORDER BY m) AS run FROM (SELECT *, lag(side) OVER (ORDER BY m) AS ls, lag(m) OVER (ORDER BY m) AS lm FROM x)) SELECT year, month, round(idx, 2) AS idx, phase, CASE WHEN phase <> 'Neutral' THEN phase WHEN side = 1 THEN 'Warm, developing' WHEN side = -1 THEN 'Cold, developing' ELSE 'Neutral' END AS status, 2 AS age_months, CAST(CASE WHEN side <> 0 THEN (SELECT count(*) FROM g b WHERE b.run = g.run) ELSE 0 END AS BIGINT) AS run_months FROM g WHERE m = (SELECT max(m) FROM g)".replace("sum(CAST(coalesce(side <> lag(side) OVER (ORDER BY m) OR date_diff('month', lag(m) OVER (ORDER BY m), m) <> 1, true) AS INT))", "sum(CAST(coalesce(side <> ls OR date_diff('month', lm, m) <> 1, true) AS INT))"))
def d28_ocean(spark, d):
    """Of a day two months after the index ends."""
    s = ocean.state(A.national_index(spark, d), run=2)
    at = F.col("at")
    dated = s.crossJoin(F.broadcast(s.agg(F.add_months(F.max(F.make_date("year", "month", F.lit(1))), 2).alias("at"))))
    return read_back(spark, Y.ocean_status(dated, at), "ocean", "year int, month int, idx double, phase string, status string, age_months int, run_months long").drop("key")


@query("d28_kpi_block", f"{with_(DAILY, MONTHLY, REGISTRY, NORMAL)}, x AS (SELECT monthly.*, normal_mm AS n, CASE WHEN normal_mm > 0 THEN 100 * (rain_mm - normal_mm) / normal_mm END AS dep FROM monthly JOIN normal ON normal.district_id = monthly.district_id AND m = month(month) WHERE rain_mm IS NOT NULL AND normal_mm IS NOT NULL), y AS (SELECT x.*, area FROM x JOIN registry USING (district_id) WHERE month = (SELECT max(month) FROM x)) SELECT strftime(max(month), '%Y-%m-%d') AS month, round(100 * sum((rain_mm - n) * area) / sum(n * area), 2) AS departure, CAST(count(dep) AS BIGINT) AS districts, CAST(count(*) FILTER (dep < -60) AS BIGINT) AS large_deficit, CAST(count(*) FILTER (dep >= -60 AND dep < -20) AS BIGINT) AS deficit, CAST(count(*) FILTER (dep >= -20 AND dep < 20) AS BIGINT) AS normal, CAST(count(*) FILTER (dep >= 20 AND dep < 60) AS BIGINT) AS excess, CAST(count(*) FILTER (dep >= 60) AS BIGINT) AS large_excess FROM y")
def d28_kpis(spark, d):
    from agrolith.operators import normals as N
    from agrolith.plans.climate import BASE

    x = N.with_normal(monthly(spark, d), ["rain_mm"], BASE).select("district_id", "month", F.col("rain_mm").alias("actual"), F.col("rain_mm_normal").alias("normal"))
    got = read_back(spark, Y.kpis(x, A.registry(spark, d)), "kpis", "departure double, districts long, categories map<string, long>")
    at = lambda n: F.col("categories")[n].alias(n.lower().replace(" ", "_"))
    return got.select(F.col("key").alias("month"), "departure", "districts", *[at(n) for n in Y.CATEGORIES])


@query("d28_models_block", "WITH f AS (SELECT o_orderpriority AS model, c_nationkey AS district_id, round(avg(o_totalprice), 1) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), c AS (SELECT o_orderpriority AS model, round(1 - avg(o_totalprice) / 150000, 4) AS skill FROM orders GROUP BY 1) SELECT c.model, skill, skill > 0 AS beats_climatology, c.model = '3-MEDIUM' AS is_default, district_id, v FROM c JOIN f ON f.model = c.model")
def d28_models(spark, d):
    o = A.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "model")
    catalogue = o.groupBy("model").agg(F.round(1 - F.avg("o_totalprice") / 150_000, 4).alias("skill")).withColumn("is_default", F.col("model") == "3-MEDIUM")
    forecasts = o.join(A.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("model", F.col("c_nationkey").alias("district_id")).agg(F.avg("o_totalprice").alias("value"))
    got = read_back(spark, Y.models(catalogue, forecasts), "models", "skill double, beats_climatology boolean, is_default boolean, v map<string, double>")
    return got.select(F.col("key").alias("model"), "skill", "beats_climatology", "is_default", F.explode("v").alias("k", "v")).select("model", "skill", "beats_climatology", "is_default", F.col("k").cast("int").alias("district_id"), "v")


@query("d28_sources_block", "SELECT event_type AS source, strftime(max(ts), '%Y-%m-%d') AS edge, CAST(DATE '2024-02-05' - CAST(max(ts) AS DATE) AS INT) AS days, CASE WHEN DATE '2024-02-05' - CAST(max(ts) AS DATE) <= length(event_type) % 7 THEN 'CURRENT' WHEN DATE '2024-02-05' - CAST(max(ts) AS DATE) <= 2 * (length(event_type) % 7) + 3 THEN 'DUE' ELSE 'STALE' END AS status FROM events GROUP BY 1")
def d28_sources(spark, d):
    e = A.table(spark, d, "events").groupBy(F.col("event_type").alias("source")).agg(F.max("ts").cast("date").alias("edge")).withColumn("lag_days", F.length("source") % 7)
    return read_back(spark, Y.sources(e, F.lit("2024-02-05").cast("date")), "sources", "edge string, days int, status string").withColumnRenamed("key", "source")
