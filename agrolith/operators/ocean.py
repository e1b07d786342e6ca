"""State of the ocean from a monthly national index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.operators.windows import run_flag


def state(index: DataFrame, run: int = 5, threshold: float = 0.5, persist: int = 3) -> DataFrame:
    """year, month, idx with phase, tendencies, past winter and spring, evolution and intensity.

    A missing value is carried for ``persist`` months. Winter (DJF) is labelled by its January
    and known from March on, spring (MAM) from June on. A NULL index has a NULL intensity.
    One row a month: windows without partitions hold the whole, short series.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("year", "month")
    x = index.withColumn("raw", F.col("idx")).withColumn("idx", F.last("idx", True).over(w.rowsBetween(-persist, 0)))
    x = x.withColumn("warm", run_flag(F.col("idx") >= threshold, w, run)).withColumn("cold", run_flag(F.col("idx") <= -threshold, w, run))
    x = x.withColumn("tend_3", F.col("idx") - F.lag("idx", 3).over(w)).withColumn("tend_6", F.col("idx") - F.lag("idx", 6).over(w))
    winter = x.where("month in (12, 1, 2)").groupBy((F.col("year") + (F.col("month") == 12).cast("int")).alias("wy")).agg(F.avg("idx").alias("djf_prev"))
    spring = x.where("month in (3, 4, 5)").groupBy(F.col("year").alias("sy")).agg(F.avg("idx").alias("mam"))
    x = x.join(F.broadcast(winter), F.col("wy") == F.col("year") - (F.col("month") < 3).cast("int"), "left").join(F.broadcast(spring), F.col("sy") == F.col("year"), "left")
    size = F.abs("idx")
    return x.select(
        "year", "month", "idx", (F.col("raw").isNull() & F.col("idx").isNotNull()).cast("int").alias("persisted"),
        F.when(F.col("warm") == 1, "Warm").when(F.col("cold") == 1, "Cold").otherwise("Neutral").alias("phase"),
        "tend_3", "tend_6", "djf_prev", F.when(F.col("month") >= 6, F.col("mam")).alias("mam"),
        F.coalesce((F.col("tend_3") > 0.1) & (F.col("idx") >= 0), F.lit(False)).cast("int").alias("developing"),
        F.coalesce((F.col("djf_prev") >= threshold) & (F.col("tend_3") < -0.1), F.lit(False)).cast("int").alias("decaying"),
        F.when(size < 0.5, 0).when(size < 1, 1).when(size < 1.5, 2).when(size < 2, 3).when(size.isNotNull(), 4).alias("intensity"),
    )


def composites(panel: DataFrame, states: DataFrame, x: str, last_year: int, phases: tuple[str, ...] = ("Warm", "Neutral", "Cold")) -> DataFrame:
    """Mean of ``x`` by district and phase in the monsoon months up to ``last_year``, and each phase less Neutral."""
    keyed = panel.withColumn("year", F.year("month")).withColumn("mm", F.month("month")).where(f"mm between 6 and 9 and year <= {last_year}")
    joined = keyed.join(F.broadcast(states.select("year", F.col("month").alias("mm"), "phase")), ["year", "mm"])
    wide = joined.groupBy("district_id").pivot("phase", list(phases)).agg(F.avg(x))
    return wide.select("*", *[(F.col(p) - F.col("Neutral")).alias(f"{p}_signature") for p in phases if p != "Neutral"])
