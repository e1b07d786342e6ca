"""Verification by slices and deciles, served blends, selectors, live seasons."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators import models
from agrolith.operators import verification as V
from agrolith.plans.climate import r4
from agrolith.plans.domain import COUNTERS, counters, r6
from agrolith.plans.registry import query
from agrolith.sources import adapters as A

_PAIRS = """p AS (SELECT least(greatest(l_tax * 1000 - 40, -100), 1000) AS p, l_discount * 1000 - 50 AS y, l_quantity - 25 AS b, month(l_shipdate) AS m, l_returnflag AS flag, n_name AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def pairs(spark, d):
    x = A.table(spark, d, "lineitem").join(A.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.join(A.table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")), F.col("l_tax") * 1000 - 40, F.col("l_discount") * 1000 - 50, F.col("l_quantity") - 25


@query("d15_verification_by_slice", f"""WITH {_PAIRS}, t AS (SELECT nation FROM p GROUP BY 1 ORDER BY count(*) DESC, nation LIMIT 8),
s AS (SELECT 'all' AS slice, * FROM p UNION ALL SELECT 'JJAS', * FROM p WHERE m BETWEEN 6 AND 9 UNION ALL SELECT 'non-JJAS', * FROM p WHERE m NOT BETWEEN 6 AND 9 UNION ALL SELECT 'phase ' || flag, * FROM p WHERE flag IN ('A', 'R') UNION ALL SELECT 'state ' || nation, * FROM p WHERE nation IN (SELECT nation FROM t))
SELECT slice, CAST(count(*) AS BIGINT) AS n, round(sqrt(avg((p - y) ** 2)), 4) AS rmse, round(1 - avg((p - y) ** 2) / avg(y * y), 6) AS skill, round(1 - avg((p - y) ** 2) / avg((b - y) ** 2), 6) AS skill_vs_persistence, round(corr(p, y), 6) AS r, round(avg(abs(p - y)), 4) AS mae,
round(avg(CAST(CAST(p >= -60 AS INT) + CAST(p >= -20 AS INT) + CAST(p >= 20 AS INT) + CAST(p >= 60 AS INT) = CAST(y >= -60 AS INT) + CAST(y >= -20 AS INT) + CAST(y >= 20 AS INT) + CAST(y >= 60 AS INT) AS INT)), 6) AS accuracy FROM s GROUP BY 1 HAVING count(*) >= 500""")
def d15_slices(spark, d):
    x, p, y, b = pairs(spark, d)
    summer = F.month("l_shipdate").between(6, 9)
    got = V.by_slice(x, p, y, b, {"JJAS": summer, "non-JJAS": ~summer, "phase A": F.col("l_returnflag") == "A", "phase R": F.col("l_returnflag") == "R"}, {"state": (F.col("n_name"), 8)})
    return got.select("slice", "n", r4(F.col("rmse"), "rmse"), *[r6(F.col(c), c) for c in ("skill", "skill_vs_persistence", "r", "accuracy")], r4(F.col("mae"), "mae"))


@query("d15_reliability_deciles", "WITH p AS (SELECT l_extendedprice / 100 AS p, l_quantity AS y FROM lineitem), e AS (SELECT quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM p) SELECT CAST(1 + len(list_filter(q, lambda z: z <= p)) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(p), 4) AS mean_forecast, round(avg(y), 4) AS mean_observed FROM p, e GROUP BY 1 HAVING count(*) >= 100")
def d15_deciles(spark, d):
    got = V.deciles(A.table(spark, d, "lineitem"), F.col("l_extendedprice") / 100, F.col("l_quantity"))
    return got.select("bin", "n", r4(F.col("mean_forecast"), "mean_forecast"), r4(F.col("mean_observed"), "mean_observed"))


@query("x09_served_blend", """WITH m AS (SELECT p_partkey, p_size * 1.0e0 AS n, p_retailprice / 10 - 90 AS raw, p_retailprice / 50 - 15 AS amount, ln((p_retailprice / 100 + 1) / (p_size + 1)) AS ratio, p_retailprice > 920 AS valid, CASE WHEN p_partkey % 5 <> 0 THEN (p_partkey % 7) / 2.0e0 - 1 END AS b FROM part),
d AS (SELECT *, (raw + 100 * (greatest(amount, 0) - n) / greatest(n, 5) + 100 * (exp(ratio) * (n + 1) - 1 - n) / greatest(n, 5)) / 3 AS p FROM m)
SELECT p_partkey, round(CASE WHEN valid AND n > 3 THEN least(greatest(p * least(greatest(0.5e0 + 0.5e0 * coalesce(b, 1), 0.3e0), 2), -100), 1000) END, 8) AS shown FROM d""")
def x09_blend(spark, d):
    price, size = F.col("p_retailprice"), F.col("p_size").cast("double")
    members = {"a": ("raw", price / 10 - 90), "b": ("tweedie", price / 50 - 15), "c": ("logratio", models.log_ratio(price / 100, size))}
    slope = F.when(F.col("p_partkey") % 5 != 0, (F.col("p_partkey") % 7) / 2.0 - 1)
    return A.table(spark, d, "part").select("p_partkey", F.round(V.served_blend(members, size, slope, (price > 920) & (size > 3)), 8).alias("shown"))


_CHOICE = "WITH f AS (SELECT o_custkey, o_orderpriority AS model, round(avg(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2), c AS (SELECT o_orderpriority AS model, round(1 - sqrt(avg((o_totalprice - 100000) ** 2)) / 100000, 6) AS skill FROM orders GROUP BY 1), w AS (SELECT (SELECT model FROM c ORDER BY skill DESC, model LIMIT 1) AS best)"


@query("q08_model_selector", f"{_CHOICE} SELECT o_custkey, coalesce(arg_min(f.model, 0) FILTER (f.model = '5-LOW'), any_value(f.model) FILTER (f.model = best)) AS model, coalesce(any_value(value) FILTER (f.model = '5-LOW'), any_value(value) FILTER (f.model = best)) AS value, coalesce(any_value(skill) FILTER (f.model = '5-LOW'), any_value(skill) FILTER (f.model = best)) AS skill, any_value(value) FILTER (f.model = '5-LOW') IS NULL AS fallback FROM f JOIN c ON c.model = f.model CROSS JOIN w WHERE f.model = '5-LOW' OR f.model = best GROUP BY 1")
def q08_selector(spark, d):
    """A reader picks one formulation; where it has no value, the best one's is shown."""
    o = A.table(spark, d, "orders").withColumnRenamed("o_orderpriority", "model")
    forecasts = o.groupBy("o_custkey", "model").agg(r4(F.avg("o_totalprice"), "value"))
    e = F.col("o_totalprice") - 100_000
    catalogue = o.groupBy("model").agg(r6(1 - F.sqrt(F.avg(e * e)) / 100_000, "skill"))
    best = catalogue.orderBy(F.desc("skill"), "model").limit(1).select(F.col("model").alias("best"))
    catalogue = catalogue.crossJoin(F.broadcast(best)).select("model", "skill", (F.col("model") == F.col("best")).alias("is_default"))
    return V.selected(forecasts, catalogue, ["o_custkey"], "5-LOW")


@query("q11_lead_selector", "WITH m AS (SELECT l_suppkey, l_linenumber AS lead, round(avg(l_extendedprice), 4) AS value FROM lineitem WHERE l_linenumber <> 4 AND NOT (l_suppkey % 3 = 0 AND l_linenumber < 5) GROUP BY 1, 2) SELECT l_suppkey, CAST(coalesce(max(lead) FILTER (lead <= 4), min(lead)) AS INT) AS lead, coalesce(arg_max(value, lead) FILTER (lead <= 4), arg_min(value, lead)) AS value FROM m GROUP BY 1")
def q11_selector(spark, d):
    """Lead 4 is asked for, which no unit has; some have longer ones alone."""
    x = A.table(spark, d, "lineitem").where("l_linenumber <> 4 and not (l_suppkey % 3 = 0 and l_linenumber < 5)")
    members = x.groupBy("l_suppkey", F.col("l_linenumber").alias("lead")).agg(r4(F.avg("l_extendedprice"), "value"))
    return V.at_lead(members, ["l_suppkey"], 4)


@query("d12_live_counters", f"WITH {COUNTERS}, n AS (SELECT brand, max(week) AS week FROM counter GROUP BY 1) SELECT brand, strftime(week, '%Y-%m-%d') AS week, CAST((SELECT max(week) FROM counter) - week AS INT) AS days_behind, area FROM n JOIN counter USING (brand, week) WHERE (SELECT max(week) FROM counter) - week <= 45")
def d12_live(spark, d):
    got = V.live(counters(spark, d), ["brand"], "week")
    return got.select("brand", F.col("week").cast("string").alias("week"), "days_behind", "area")
