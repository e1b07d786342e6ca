"""Samples, boosted learners, stacking and the store of models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.functions.nulls import clip
from agrolith.operators import boosting, models
from agrolith.operators import samples as S
from agrolith.operators.boosting import Formulation
from agrolith.operators.model_store import ModelStore
from agrolith.plans.climate import BASE, monthly, r4
from agrolith.plans.registry import query
from agrolith.plans.sql import DAILY, MONTHLY, day, with_
from agrolith.sources import adapters as A
from agrolith.sources import files
from agrolith.streaming.runtime import shared_path

INPUTS = ("orders", "customer", "lineitem", "supplier", "nation")
#: Share of a window's days that must be observed: the table's districts lack most days.
NEED = 0.2
#: Months at the end of the table that are held out.
HELD_OUT = 18


def daily_index(spark, d: str) -> DataFrame:
    """Two components of a daily national index, from the items shipped on the day before."""
    x = A.table(spark, d, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("date"))
    return S.octants(x.agg((F.avg("l_discount") * 100 - 5).alias("romi1"), (F.avg("l_tax") * 100 - 4).alias("romi2")))


def sample_table(spark, d: str) -> DataFrame:
    """The samples, kept beside the fingerprint of the tables they come from."""

    def build() -> DataFrame:
        return S.samples(A.daily(spark, d), monthly(spark, d), ["tmax_c", "tmin_c"], daily_index(spark, d), BASE, need=NEED)

    return files.cached(spark, shared_path(spark, "samples"), [f"{d}/{t}.parquet" for t in INPUTS], build, f"{BASE} {NEED}")


def _window(x: str, h: int, ahead: bool = False) -> str:
    frame = f"ROWS BETWEEN {'1 FOLLOWING AND ' + str(h) + ' FOLLOWING' if ahead else str(h - 1) + ' PRECEDING AND CURRENT ROW'}"
    over = f"OVER (PARTITION BY district_id ORDER BY date {frame})"
    return f"CASE WHEN count({x}) {over} >= {math.ceil(NEED * h)} THEN sum({x}) {over} END"


_SUMS = [(f"ant_rain_{h}", _window("rain_mm", h)) for h in S.BACK] + [(f"ant_norm_{h}", _window("normal", h)) for h in S.BACK] + [(f"fwdrain_{h}", _window("rain_mm", h, True)) for h in S.AHEAD] + [(f"fwdnorm_{h}", _window("normal", h, True)) for h in S.AHEAD]
_DEP = [(f"ant_dep_{h}", f"ant_rain_{h}", f"ant_norm_{h}") for h in S.BACK] + [(f"dep_{h}", f"fwdrain_{h}", f"fwdnorm_{h}") for h in S.AHEAD]
_SHOWN = ["dsw", "wet30", "extreme30", *[f"ant_rain_{h}" for h in S.BACK], *[f"fwdrain_{h}" for h in S.AHEAD], *[f"fwdnorm_{h}" for h in S.AHEAD], "doy_sin", "doy_cos", "tmax_c", "tmin_c", "romi1", "romi2", "mjo_amp", "mjo_sin", "mjo_cos"]

_SAMPLES = f"""{with_(DAILY, MONTHLY)}, nn AS (SELECT district_id, dayofyear(date) AS doy, avg(rain_mm) AS normal FROM daily WHERE year(date) BETWEEN {BASE[0]} AND {BASE[1]} GROUP BY 1, 2),
hi AS (SELECT district_id, quantile_cont(rain_mm, 0.95) AS high FROM daily WHERE rain_mm > 1 GROUP BY 1),
ru AS (SELECT *, sum(CAST(rain_mm IS NULL OR rain_mm > 1 AS INT)) OVER (PARTITION BY district_id ORDER BY date) AS run FROM daily),
x AS (SELECT ru.district_id, date, dayofyear(date) AS doy, rain_mm, CASE WHEN rain_mm IS NOT NULL THEN normal END AS normal, CASE WHEN rain_mm IS NOT NULL THEN sum(CAST(rain_mm <= 1 AS INT)) OVER (PARTITION BY ru.district_id, run ORDER BY date) END AS dsw, CASE WHEN rain_mm IS NOT NULL THEN CAST(rain_mm > 1 AS INT) END AS wet, CASE WHEN rain_mm IS NOT NULL THEN CAST(coalesce(rain_mm > high, false) AS INT) END AS extreme
  FROM ru LEFT JOIN nn ON nn.district_id = ru.district_id AND nn.doy = dayofyear(date) LEFT JOIN hi ON hi.district_id = ru.district_id),
s AS (SELECT district_id, date, doy, dsw, {_window("wet", 30)} AS wet30, {_window("extreme", 30)} AS extreme30, {", ".join(f"{e} AS {n}" for n, e in _SUMS)} FROM x),
ix AS (SELECT CAST(l_shipdate AS DATE) + 1 AS date, avg(l_discount) * 100 - 5 AS romi1, avg(l_tax) * 100 - 4 AS romi2 FROM lineitem GROUP BY 1)
SELECT s.district_id, {day("s.date")} AS date, {", ".join(f"round(CASE WHEN {n} >= 5 THEN ({a} - {n}) / {n} * 100 END, 4) AS {c}" for c, a, n in _DEP)}, {", ".join(f"round(CAST({c} AS DOUBLE), 4) AS {c}" for c in _SHOWN)}
FROM (SELECT *, sin(2 * pi() * doy / 365.25e0) AS doy_sin, cos(2 * pi() * doy / 365.25e0) AS doy_cos FROM s WHERE doy % 5 = 0 AND year(date) >= 1990) s
LEFT JOIN monthly mo ON mo.district_id = s.district_id AND mo.month = CAST(date_trunc('month', s.date) - INTERVAL 1 MONTH AS DATE)
LEFT JOIN (SELECT *, sqrt(romi1 * romi1 + romi2 * romi2) AS mjo_amp, romi2 / nullif(sqrt(romi1 * romi1 + romi2 * romi2), 0) AS mjo_sin, romi1 / nullif(sqrt(romi1 * romi1 + romi2 * romi2), 0) AS mjo_cos FROM ix) ix ON ix.date = s.date"""


@query("d14_samples_and_daily_index", _SAMPLES)
def d14_full(spark, d):
    s = sample_table(spark, d)
    return s.select("district_id", F.col("date").cast("string").alias("date"), *[r4(F.col(c), c) for c, _, _ in _DEP], *[r4(F.col(c).cast("double"), c) for c in _SHOWN])


def formulations(horizon: int, train) -> dict[str, Formulation]:
    """The target transforms that learners are entered with; ``departures`` undoes them by name."""
    amount, normal, dep = (F.col(f"{c}_{horizon}") for c in ("fwdrain", "fwdnorm", "dep"))
    known = train & dep.isNotNull()
    return {
        "raw": Formulation(dep, "squared", rows=known),
        "huber": Formulation(dep, "huber", 40.0, known),
        "tweedie": Formulation(clip(amount, 0), "tweedie", 1.5, known),
        "logratio": Formulation(models.log_ratio(clip(amount, 0), normal), "squared", rows=known),
        "median": Formulation(dep, "quantile", 0.5, known),
    }


def departures(told: DataFrame, horizon: int, names: list[str]) -> DataFrame:
    """Predictions of the formulations as departures from the normal, in percent within [-100, 1000]."""
    normal = F.greatest(F.col(f"fwdnorm_{horizon}"), F.lit(5.0))
    back = {"tweedie": lambda p: models.departure_of_amount(p, normal), "logratio": lambda p: models.departure_of_amount(models.amount_of_log_ratio(p, F.col(f"fwdnorm_{horizon}")), normal)}
    return told.withColumns({n: clip(back.get(n, lambda p: p)(F.col(n)), -100, 1000) for n in names})


def split(spark, d: str, horizon: int = 7) -> tuple[DataFrame, list[str], dict[str, Formulation]]:
    """Samples with a target and ``train``, false in the last HELD_OUT months; the features; the formulations."""
    s = sample_table(spark, d)
    s = A.with_last(s.where(F.col(f"dep_{horizon}").isNotNull()), "date").withColumn("train", F.col("date") < F.add_months("last", -HELD_OUT)).drop("last")
    return s, [c for c in S.features_of(s) if c not in ("train", "district_id")], formulations(horizon, F.col("train"))


SETTINGS = dict(trees=12, depth=3, rate=0.15, bins=32, least=20)


@query("d17_boosted")
def d17_boosted(spark, d):
    """Scores on the held-out months of boosted trees by formulation, and of climatology, which always says 0."""
    s, features, forms = split(spark, d)
    boosters = boosting.fit(s, features, forms, **SETTINGS)
    told = departures(boosting.predict(s.where("not train"), boosters), 7, list(forms)).withColumn("climatology", F.lit(0.0))
    long = told.unpivot(["district_id", "date", "dep_7"], [*forms, "climatology"], "model", "f")
    scored = models.scores(long, "model", F.col("f"), F.col("dep_7"), [-60, -20, 20, 60])
    return scored.select("model", *[r4(F.col(c), c) for c in ("rmse", "skill", "r", "mae", "accuracy")])


@query("d17_stack")
def d17_stack(spark, d):
    """Weights of the formulations by non-negative least squares on out-of-fold predictions (folds are blocks of seasons), and the blend's error on the held-out months."""
    s, features, forms = split(spark, d)
    block = F.pmod(F.floor((F.year("date") * 4 + F.quarter("date")) / 2), F.lit(3)).cast("int")
    settings = SETTINGS | {"trees": 6}
    inside = departures(boosting.out_of_fold(s.where("train"), features, forms, block, 3, **settings), 7, list(forms))
    weights = boosting.stack_weights(inside, list(forms), "dep_7")
    outside = departures(boosting.predict(s.where("not train"), boosting.fit(s, features, forms, **settings)), 7, list(forms))
    blend = sum((F.lit(w) * F.col(n) for n, w in weights.items()), F.lit(0.0))
    error = outside.agg(F.sqrt(F.avg(F.pow(clip(blend, -100, 1000) - F.col("dep_7"), 2))).alias("rmse"), F.sqrt(F.avg(F.pow("dep_7", 2))).alias("climatology"))
    rows = spark.createDataFrame([(n, round(float(w), 6)) for n, w in weights.items()], "model string, weight double")
    return rows.crossJoin(F.broadcast(error)).select("model", "weight", r4(F.col("rmse"), "blend_rmse"), r4(F.col("climatology"), "climatology_rmse"))


@query("k13_model_store")
def k13_store(spark, d):
    """A run that breaks off after its first model, and the one that goes on: what each did, by key, with the error on held-out months as the catalogue has it."""
    s, features, forms = split(spark, d)
    store = ModelStore(spark, shared_path(spark, "models"))
    mark = files.stamp(spark, [f"{d}/{t}.parquet" for t in INPUTS], models.fingerprint(features))

    def train(name: str):
        def run():
            booster = boosting.fit(s, features, {name: forms[name]}, trees=3, depth=2, bins=16)[name]
            told = departures(boosting.predict(s.where("not train"), {name: booster}), 7, [name])
            return booster, {"rmse": round(told.agg(F.sqrt(F.avg(F.pow(F.col(name) - F.col("dep_7"), 2)))).first()[0], 4), "is_default": name == "raw"}

        return run

    wanted = [(f"boosted/{n}", train(n)) for n in ("raw", "huber", "tweedie")]
    first = store.train(wanted[:1], mark)
    second = store.train(wanted, mark)
    entries = store.catalogue()
    rows = [(k, first.get(k, "not reached"), second[k], entries[k]["rmse"], entries[k]["is_default"]) for k in second]
    return spark.createDataFrame(rows, "model string, first_run string, second_run string, rmse double, is_default boolean")
