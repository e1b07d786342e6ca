"""Stage-weighted crop stress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import categories, clip

# fixed values: crop, season, base temperature, adequate water, then for each stage its months, yield response and upper temperature
STAGES = ("Sowing", "Vegetative", "Growing", "Harvesting")
CROPS = [
    ("Rice", "Kharif", 10, 0.80, [([6], 0.40, 38), ([7], 1.00, 38), ([8, 9], 1.30, 34), ([10], 0.50, 36)]),
    ("Maize", "Kharif", 10, 0.70, [([6], 0.40, 38), ([7], 0.40, 37), ([8], 1.50, 33), ([9, 10], 0.50, 36)]),
    ("Soybean", "Kharif", 10, 0.65, [([6], 0.40, 38), ([7], 0.60, 37), ([8], 1.00, 34), ([9, 10], 0.50, 36)]),
    ("Tur", "Kharif", 7, 0.60, [([6], 0.40, 38), ([7, 8], 0.60, 38), ([9, 10], 1.20, 34), ([11], 0.40, 36)]),
    ("Bajra", "Kharif", 10, 0.50, [([6], 0.30, 42), ([7], 0.50, 42), ([8], 1.10, 38), ([9], 0.40, 40)]),
    ("Groundnut", "Kharif", 10, 0.65, [([6], 0.40, 38), ([7], 0.60, 37), ([8], 0.80, 34), ([9, 10], 0.60, 36)]),
    ("Castor", "Kharif", 12, 0.45, [([6, 7], 0.30, 42), ([8], 0.50, 40), ([9, 10], 1.00, 36), ([11], 0.40, 38)]),
    ("Sugarcane", "Kharif", 12, 0.75, [([6], 0.75, 40), ([7, 8], 1.20, 40), ([9, 10], 0.90, 38), ([11], 0.50, 38)]),
    ("Cotton", "Kharif", 15, 0.60, [([6], 0.40, 40), ([7, 8], 0.60, 38), ([9, 10], 1.00, 34), ([11], 0.40, 38)]),
    ("Guar Seed", "Kharif", 10, 0.45, [([7], 0.30, 44), ([8], 0.50, 42), ([9], 1.00, 38), ([10], 0.40, 40)]),
    ("Ragi", "Kharif", 8, 0.55, [([6], 0.30, 38), ([7, 8], 0.50, 38), ([9], 1.10, 34), ([10], 0.40, 36)]),
    ("Sesame", "Kharif", 15, 0.45, [([6], 0.30, 42), ([7], 0.50, 42), ([8], 1.00, 38), ([9], 0.40, 40)]),
    ("Wheat", "Rabi", 5, 0.65, [([11], 0.20, 32), ([12, 1], 0.60, 30), ([2], 0.60, 28), ([3, 4], 0.50, 31)]),
    ("Mustard", "Rabi", 5, 0.55, [([10], 0.20, 32), ([11, 12], 0.55, 30), ([1], 1.00, 27), ([2, 3], 0.50, 30)]),
    ("Chana", "Rabi", 5, 0.55, [([10], 0.20, 32), ([11, 12], 0.50, 30), ([1, 2], 1.10, 28), ([3], 0.45, 32)]),
    ("Maize (Rabi)", "Rabi", 10, 0.65, [([11], 0.40, 34), ([12, 1], 0.40, 33), ([2], 1.50, 30), ([3], 0.50, 33)]),
    ("Barley", "Rabi", 5, 0.55, [([11], 0.20, 32), ([12, 1], 0.55, 30), ([2], 0.60, 28), ([3, 4], 0.45, 31)]),
]


def calendar_rows() -> list[tuple]:
    """(crop, season, t_base, water_adeq, stage, ky, t_upper, m): one row a month of a stage."""
    return [(crop, season, float(base), adequate, name, ky, float(upper), m) for crop, season, base, adequate, stages in CROPS for name, (months, ky, upper) in zip(STAGES, stages, strict=True) for m in months]


def calendar(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(calendar_rows(), "crop string, season string, t_base double, water_adeq double, stage string, ky double, t_upper double, m int")


def kharif_water(mai: Column, adequate: Column, departure: Column, irrigated: Column) -> Column:
    """Rain-fed deficit sharpened by the rainfall departure and buffered by irrigation."""
    raw = clip(1 - mai / adequate, 0, 1)
    return clip(clip(0.75 * raw + 0.25 * F.coalesce(clip(-departure / 60.0, 0, 1), raw), 0, 1) * (1 - 0.55 * irrigated), 0, 1)


def rabi_water(soil: Column, reference: Column, deviation: Column, irrigated: Column) -> Column:
    """Lack of irrigation and of the soil moisture that the monsoon left."""
    short = 1 - irrigated
    return clip(0.65 * short + 0.35 * F.coalesce(clip((reference - soil) / F.nullif(deviation, F.lit(0.0)) / 2.0, 0, 1), short), 0, 1)


def stage_stress(panel: DataFrame, digits: int = 3) -> DataFrame:
    """Per district, crop, season year and stage: heat (worst month), water and index (means).

    panel: district_id, month, tmax_c, tmin_c, mai, departure, irrig, soil, soil_ref, soil_sd. The
    crop calendar is a constant of some dozens of rows and is broadcast.
    """
    x = panel.withColumn("m", F.month("month")).join(F.broadcast(calendar(panel.sparkSession)), "m")
    days = F.dayofmonth(F.last_day("month"))
    rabi = F.col("season") == "Rabi"
    heat = clip(days * clip(F.col("tmax_c") - F.col("t_upper"), 0) / 90.0, 0, 1)
    water = F.when(rabi, rabi_water(F.col("soil"), F.col("soil_ref"), F.col("soil_sd"), F.col("irrig"))).otherwise(kharif_water(F.col("mai"), F.col("water_adeq"), F.col("departure"), F.col("irrig")))
    x = x.withColumn("heat", heat).withColumn("water", water)
    both = F.when(rabi, 0.45 * F.col("water") + 0.55 * F.col("heat")).otherwise(0.65 * F.col("water") + 0.35 * F.col("heat"))
    x = x.withColumn("csi", F.coalesce(both, "water", "heat")).where("csi is not null")
    year = F.year("month") - F.when(rabi & (F.col("m") <= 4), 1).otherwise(0)
    gdd = days * clip((F.col("tmax_c") + F.col("tmin_c")) / 2 - F.col("t_base"), 0)
    return x.groupBy("district_id", "crop", "season", year.alias("season_year"), "stage", "ky").agg(F.round(F.max("heat"), digits).alias("heat"), F.round(F.avg("water"), digits).alias("water"), F.round(F.avg("csi"), digits).alias("csi"), F.sum(gdd).alias("gdd"))


def season_stress(stages: DataFrame) -> DataFrame:
    """Multiplicative combination over stages; seasons that the start of the record cuts off are dropped."""
    left = lambda x: F.product(1 - clip(F.col("ky") * F.col(x), 0, 1))
    h = stages.groupBy("district_id", "crop", "season", "season_year").agg(
        F.round(1 - left("csi"), 3).alias("csi"), F.round(1 - left("heat"), 3).alias("heat_stress"), F.round(1 - left("water"), 3).alias("water_stress"), F.round(1 - F.product(1 - clip(F.col("ky"), 0, 1)), 3).alias("csi_max"), F.countDistinct("stage").alias("stages"), F.sum("gdd").alias("gdd")
    )
    latest = F.max("season_year").over(Window.partitionBy("crop"))
    h = h.withColumn("latest", latest).where(f"stages >= {len(STAGES)} or season_year >= latest").drop("latest")
    h = h.withColumn("csi_to_date", F.round(F.when(F.col("csi_max") > 1e-9, clip(F.col("csi") / F.col("csi_max"), 0, 1)), 3))
    basis = F.when(F.col("stages") >= len(STAGES), F.col("csi")).otherwise(F.coalesce("csi_to_date", F.lit(0.0)))
    return h.withColumn("class", F.element_at(F.array(*[F.lit(c) for c in ("Low", "Moderate", "High", "Severe")]), categories(basis, [0.25, 0.5, 0.75]) + 1))
