"""Map layers and the questions that a dashboard asks of them: long tables (layer, key, time, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import percent_departure, weighted_mean
from agrolith.operators.windows import rolling_sum


def clamped(layers: DataFrame, time: str, wanted: Column, keys: list[str]) -> DataFrame:
    """Each layer's values at the ``wanted`` time, or at its own last one if it ends before: layer, keys, as_of, v."""
    edges = layers.where("v is not null").groupBy("layer").agg(F.least(F.max(time), wanted).alias("as_of"))
    return layers.join(edges, "layer").where(F.col(time) == F.col("as_of")).select("layer", *keys, "as_of", "v")


def painted_by_state(layers: DataFrame, registry: DataFrame) -> DataFrame:
    """Each district with its state's area-weighted mean of a layer: layer, district_id, month, v."""
    keyed = layers.join(registry.select("district_id", "state", "area"), "district_id")
    states = keyed.groupBy("layer", "state", "month").agg(weighted_mean(F.col("v"), F.col("area")).alias("v"))
    return states.join(registry.select("district_id", "state"), "state").select("layer", "district_id", "month", "v")


def national(layers: DataFrame, registry: DataFrame) -> DataFrame:
    """Area-weighted national mean of each layer and month, and how many districts have a value."""
    keyed = layers.join(registry.select("district_id", "area"), "district_id")
    return keyed.groupBy("layer", "month").agg(weighted_mean(F.col("v"), F.col("area")).alias("v"), F.count("v").alias("districts"))


def model_layers(records: DataFrame, whole: int, years: tuple[int, int], windows: list[int], floor: float = 5.0) -> DataFrame:
    """A forecast model's layers against its own climatology: district_id, date, v, dep_<n>.

    records: district_id, date, v, n_records on a dense calendar. Days of fewer than ``whole`` records are
    parts and count as missing; windows are strict; the normal of a day of year is the model's own mean over ``years``, not the observations'.
    """
    days = records.withColumn("v", F.when(F.col("n_records") >= whole, F.col("v"))).withColumn("doy", F.dayofyear("date"))
    normal = days.where(F.year("date").between(*years)).groupBy("district_id", "doy").agg(F.avg("v").alias("n"))
    keyed = days.join(normal, ["district_id", "doy"], "left")
    w = Window.partitionBy("district_id").orderBy("date")
    deps = [percent_departure(rolling_sum(F.col("v"), w, k), rolling_sum(F.col("n"), w, k), floor).alias(f"dep_{k}") for k in windows]
    return keyed.select("district_id", "date", "v", *deps)


def newest_run(members: DataFrame, leads: list[int], now: Column, stale_hours: int = 48) -> DataFrame:
    """The newest run's ensemble as one row a district: <stat>_<lead>, run and whether it is stale.

    members: district_id, run (timestamp), lead, v, weight, one row a member. Leads of the run that are missing are NULL.
    """
    last = members.agg(F.max("run").alias("run"))
    mine = members.join(last, "run")
    by_lead = mine.groupBy("district_id", "run").pivot("lead", leads).agg(weighted_mean(F.col("v"), F.col("weight")).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))
    names = [F.col(f"{k}_{s}").alias(f"{s}_{k}") for k in leads for s in ("mean", "low", "high")]
    return by_lead.select("district_id", *names, "run", (F.unix_timestamp(now) - F.unix_timestamp("run") > stale_hours * 3600).cast("int").alias("stale"))


def crop_view(stress: DataFrame, stages: DataFrame, registry: DataFrame, top: int = 6) -> DataFrame:
    """Of each crop's latest season: its mean index, the mean of each stage as an array in the order of stages, and the
    ``top`` states by mean index (ties by name), as arrays."""
    latest = stress.groupBy("crop").agg(F.max("season_year").alias("season_year"))
    now = stress.join(latest, ["crop", "season_year"])
    head = now.groupBy("crop", "season_year").agg(F.avg("csi").alias("csi"), F.count("csi").alias("districts"))
    cycle = stages.join(latest, ["crop", "season_year"]).groupBy("crop", "stage").agg(F.avg("csi").alias("v")).groupBy("crop").agg(F.sort_array(F.collect_list(F.struct("stage", "v"))).alias("cycle"))
    states = now.join(registry.select("district_id", "state"), "district_id").groupBy("crop", "state").agg(F.avg("csi").alias("v"))
    ranked = states.withColumn("i", F.row_number().over(Window.partitionBy("crop").orderBy(F.desc_nulls_last("v"), "state"))).where(F.col("i") <= top)
    best = ranked.groupBy("crop").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "state"))), lambda r: r["state"]).alias("states"))
    return head.join(cycle, "crop", "left").join(best, "crop", "left")


def export_payload(layers: DataFrame, months: int, digits: int = 1) -> DataFrame:
    """The last ``months`` of all layers as the dashboard reads them: one JSON object a layer and month, values by district,
    with the layer's own last month beside it. Rows (layer, month, layer_last, json); missing values are left out."""
    seen = layers.where("v is not null")
    span = seen.agg(F.add_months(F.max("month"), 1 - months).alias("__from"))
    last = seen.groupBy("layer").agg(F.max("month").alias("layer_last"))
    values = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("district_id").cast("string"), F.round("v", digits)))))
    return seen.join(span, F.col("month") >= F.col("__from")).groupBy("layer", "month").agg(F.to_json(values).alias("json")).join(last, "layer").select("layer", "month", "layer_last", "json")


def display_audit(shown: DataFrame, source: DataFrame) -> DataFrame:
    """What a display lacks of its source, by layer: holes (months between its first and last without a value), rows beyond the
    source, values that differ, and months that its last one is behind."""
    edges = lambda df, name: df.where("v is not null").groupBy("layer").agg(F.min("month").alias(f"{name}_first"), F.max("month").alias(f"{name}_last"), F.countDistinct("month").alias(f"{name}_months"))
    a, b = edges(shown, "shown"), edges(source, "source")
    span = F.months_between("shown_last", "shown_first").cast("long") + 1
    s, t = shown.where("v is not null"), source.where("v is not null").withColumnRenamed("v", "w")
    both = s.join(t, ["layer", "district_id", "month"], "full").groupBy("layer").agg(F.count_if(F.col("w").isNull()).alias("beyond"), F.count_if(F.abs(F.col("v") - F.col("w")) > 1e-6).alias("differing"), F.count_if(F.col("v").isNull()).alias("lacking"))
    behind = F.months_between("source_last", "shown_last").cast("int")
    return both.join(b, "layer", "left").join(a, "layer", "left").select("layer", "beyond", "differing", "lacking", (span - F.col("shown_months")).alias("holes"), behind.alias("behind"))
