"""The blocks of a dashboard's payload, as rows (block, key, json): one JSON object for each key, which tasks make and write apart.

Numbers are rounded and missing or non-finite ones left out, so that a reader finds null nowhere. A display joins the
lines of a block to one object; no block passes through one row, for a block has as many keys as there are districts or models.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.functions.nulls import categories, finite
from agrolith.operators.checks import freshness

CATEGORIES = ("Large deficit", "Deficit", "Normal", "Excess", "Large excess")


def clean(x: Column, digits: int = 2) -> Column:
    """A number as it is shown."""
    return F.round(finite(x.cast("double")), digits)


def _json(block: str, key: Column, value: Column) -> list[Column]:
    return [F.lit(block).alias("block"), key.cast("string").alias("key"), F.to_json(value).alias("json")]


def _values(key: str, value: Column) -> Column:
    """{key: value} of a group, without missing values."""
    pairs = F.collect_list(F.when(value.isNotNull(), F.struct(F.col(key).cast("string").alias("k"), value.alias("v"))))
    return F.map_from_entries(F.sort_array(pairs))


def context(layers: DataFrame, registry: DataFrame, digits: int = 2) -> DataFrame:
    """A record a district: id, d (name), s (state), and of each layer (layer, district_id, month, v) its own last value and month, so that a layer that ends early is shown as of then."""
    seen = layers.where(F.col("v").isNotNull() & ~F.isnan("v"))
    last = seen.groupBy("district_id", "layer").agg(F.max_by(F.struct(F.col("month").cast("string").alias("as_of"), clean(F.col("v"), digits).alias("v")), "month").alias("l"))
    each = last.groupBy("district_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", "l")))).alias("layers"))  # a row a layer
    keyed = registry.join(each, "district_id", "left")
    return keyed.select(*_json("context", F.col("district_id"), F.struct(F.col("district_id").alias("id"), F.col("district").alias("d"), F.col("state").alias("s"), "layers")))


def crops(stress: DataFrame, stages: DataFrame, registry: DataFrame, areas: DataFrame, sowing: DataFrame | None = None, order: tuple[str, ...] = (), top: int = 6) -> DataFrame:
    """A record a crop of the newest season year of all: mean index, districts, how many of them are High or Severe, the area they have and its share, the states with the highest
    means, the cycle by stage, sowing, and the index by district.

    stress and stages: as ``operators.crops`` makes them; areas: district_id, crop, ha; sowing: crop and columns to show as they are. order: the stages
    of a cycle, all of which are shown.
    """
    newest = stress.agg(F.max("season_year").alias("__y"))
    now = stress.crossJoin(F.broadcast(newest)).where("season_year = __y").join(areas, ["district_id", "crop"], "left").join(registry.select("district_id", "state"), "district_id")
    hit = F.col("class").isin("High", "Severe")
    head = now.groupBy("crop").agg(
        F.first("season").alias("season"), F.first("season_year").alias("season_year"), F.max("stages").alias("stages_elapsed"), F.avg("csi").alias("__mean"), F.countDistinct("district_id").alias("districts"), F.count_if(hit).alias("high"),
        F.sum("ha").alias("__ha"), F.sum(F.when(hit, F.col("ha"))).alias("__risk"), _values("district_id", clean(F.col("csi"))).alias("v"),
    )
    states = now.groupBy("crop", "state").agg(F.avg("csi").alias("csi"), F.sum("ha").alias("ha"))
    ranked = states.withColumn("i", F.row_number().over(Window.partitionBy("crop").orderBy(F.desc_nulls_last(F.round("csi", 9)), "state"))).where(F.col("i") <= top)
    best = ranked.groupBy("crop").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", F.col("state").alias("s"), clean(F.col("csi")).alias("csi"), clean(F.coalesce("ha", F.lit(0.0)) / 1e6, 4).alias("mha")))), lambda r: F.struct(r["s"].alias("s"), r["csi"].alias("csi"), r["mha"].alias("mha"))).alias("top_states"))
    cycle = stages.crossJoin(F.broadcast(newest)).where("season_year = __y").groupBy("crop", "stage").agg(*[F.avg(c).alias(c) for c in ("csi", "heat", "water")], F.max("ky").alias("ky"))
    shown = F.struct(*[clean(F.col(c)).alias(c) for c in ("csi", "heat", "water", "ky")])
    by_stage = cycle.groupBy("crop").agg(F.map_from_entries(F.collect_list(F.struct("stage", shown))).alias("__stages"))
    wanted = F.array(*[F.lit(s) for s in order]) if order else F.array_sort(F.map_keys("__stages"))
    steps = F.transform(wanted, lambda s: F.struct(s.alias("stage"), F.try_element_at("__stages", s).alias("values"), F.try_element_at("__stages", s).isNotNull().alias("done")))
    x = head.join(best, "crop", "left").join(by_stage, "crop", "left").withColumn("cycle", steps)
    extra = []
    if sowing is not None:
        x = x.join(sowing.select("crop", F.struct(*[c for c in sowing.columns if c != "crop"]).alias("sowing")), "crop", "left")
        extra = ["sowing"]
    mha = lambda c: clean(F.coalesce(c, F.lit(0.0)) / 1e6, 4)
    value = F.struct("season", "season_year", "stages_elapsed", clean(F.col("__mean")).alias("mean"), "districts", "high", mha("__ha").alias("area_mha"), mha("__risk").alias("risk_mha"), clean(F.try_divide(100 * F.coalesce("__risk", F.lit(0.0)), F.col("__ha"))).alias("risk_share"), "top_states", "cycle", *extra, "v")
    return x.select(*_json("crops", F.col("crop"), value))


def ocean_status(state: DataFrame, at: Column, threshold: float = 0.5) -> DataFrame:
    """The state of the last month at or before ``at`` (a date of a frame of one row, or a literal): index, phase, age in months, a status that tells a phase that is forming, and how many months
    in a row it has been beyond the threshold on its side. state: year, month, idx, phase; a short series."""
    x = state.withColumn("__m", F.make_date("year", "month", F.lit(1))).where((F.col("__m") <= at) & F.col("idx").isNotNull())
    side = F.when(F.col("idx") >= threshold, 1).when(F.col("idx") <= -threshold, -1).otherwise(0)
    whole = Window.partitionBy(F.lit(0)).orderBy("__m")
    runs = x.withColumn("__side", side).withColumn("__new", F.coalesce((F.col("__side") != F.lag("__side").over(whole)) | (F.months_between("__m", F.lag("__m").over(whole)) != 1), F.lit(True)).cast("int")).withColumn("__run", F.sum("__new").over(whole))
    last = runs.withColumn("run_months", F.when(F.col("__side") != 0, F.count(F.lit(1)).over(Window.partitionBy("__run"))).otherwise(0)).orderBy(F.desc("__m")).limit(1)
    status = F.when(F.col("phase") != "Neutral", F.col("phase")).when(F.col("__side") == 1, "Warm, developing").when(F.col("__side") == -1, "Cold, developing").otherwise("Neutral")
    age = F.months_between(F.trunc(at, "MM"), "__m").cast("int")
    return last.select(*_json("ocean", F.lit("state"), F.struct("year", "month", clean(F.col("idx")).alias("idx"), "phase", status.alias("status"), age.alias("age_months"), "run_months")))


def kpis(departures: DataFrame, registry: DataFrame, edges: tuple[float, ...] = (-60.0, -20.0, 20.0, 60.0)) -> DataFrame:
    """National figures of the newest month of (district_id, month, actual, normal): departure as a ratio of area-weighted sums, and how many districts fall into each category."""
    known = departures.where("actual is not null and normal is not null")
    newest = known.agg(F.max("month").alias("__m"))
    now = known.crossJoin(F.broadcast(newest)).where("month = __m").join(registry.select("district_id", "area"), "district_id")
    dep = F.when(F.col("normal") > 0, 100 * (F.col("actual") - F.col("normal")) / F.col("normal"))
    at = categories(dep, list(edges))
    counts = [F.count_if(at == i).alias(n) for i, n in enumerate(CATEGORIES)]
    one = now.groupBy("month").agg(clean(F.try_divide(100 * F.sum((F.col("actual") - F.col("normal")) * F.col("area")), F.sum(F.col("normal") * F.col("area")))).alias("departure"), F.count(dep).alias("districts"), *counts)
    return one.select(*_json("kpis", F.col("month"), F.struct("departure", "districts", F.struct(*[F.col(f"`{n}`") for n in CATEGORIES]).alias("categories"))))


def models(catalogue: DataFrame, forecasts: DataFrame, digits: int = 1) -> DataFrame:
    """A record a formulation for the selector: its scores, whether it beats climatology and is the default, and its forecast by district. catalogue: model, skill, is_default and other scores; forecasts: model, district_id, value."""
    values = forecasts.groupBy("model").agg(_values("district_id", clean(F.col("value"), digits)).alias("v"))
    x = catalogue.join(values, "model", "left")
    scores = [clean(F.col(c), 4).alias(c) if t in ("double", "float") else F.col(c) for c, t in catalogue.dtypes if c != "model"]
    return x.select(*_json("models", F.col("model"), F.struct(*scores, (F.col("skill") > 0).alias("beats_climatology"), "v")))


def sources(edges: DataFrame, today: Column) -> DataFrame:
    """A record a source (source, edge, lag_days): its newest day, how many days ago that is, and its status."""
    behind = F.datediff(today, "edge")
    return edges.select(*_json("sources", F.col("source"), F.struct(F.col("edge").cast("string").alias("edge"), behind.alias("days"), freshness(F.col("edge"), today, F.col("lag_days")).alias("status"))))


def write(blocks: DataFrame, path: str) -> None:
    """One folder a block, a line a key: {"key": ..., "value": ...}."""
    line = F.concat(F.lit('{"key":'), F.to_json(F.array("key")).substr(F.lit(2), F.length(F.to_json(F.array("key"))) - 2), F.lit(',"value":'), F.col("json"), F.lit("}"))
    blocks.select("block", line.alias("value")).write.mode("overwrite").partitionBy("block").text(path)
