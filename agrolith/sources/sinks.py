"""Writers: partitioned tables, payloads for a dashboard and plain text with sentinels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agrolith.sources import files


def by_year(df: DataFrame, path: str, order: list[str], date: str = "date", fmt: str = "parquet") -> None:
    """One folder a year, files sorted within and dealt by ranges of the order, so that a large year is many tasks; a rerun replaces only the years that it holds."""
    years = df.withColumn("year", F.year(date))
    years.repartitionByRange("year", *order).sortWithinPartitions("year", *order).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").format(fmt).save(path)


def _by_key(a: Column, b: Column) -> Column:
    """Order of structs by their field k: maps have no order of their own."""
    return F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0)


def layer_maps(df: DataFrame, layer: str, month: str, key: str, value: str, digits: int = 1) -> DataFrame:
    """One JSON object a layer: {month: {key: value}}; missing values are left out."""
    x = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    inner = x.groupBy(layer, month).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.round(value, digits))))).alias("m"))
    return inner.groupBy(layer).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(month).cast("string").alias("k"), "m")), _by_key))).alias("json"))


def positional(df: DataFrame, day: str, key: str, value: str) -> DataFrame:
    """A day's values as an array in the order of the keys; a key's missing day is null."""
    return df.groupBy(day).agg(F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda r: r[value]).alias("values"))


def sentinel(x: Column, value: float = -9999.0) -> Column:
    return F.coalesce(x, F.lit(value))


def text_series(df: DataFrame, path: str, date: str, value: str, backup: bool = False) -> None:
    """Lines of date and value with the sentinel for missing ones. backup: a series that is there already is kept as ``path``.bak, in place of an older one."""
    if backup and files.exists(df.sparkSession, path):
        files.remove(df.sparkSession, f"{path}.bak")
        files.publish(df.sparkSession, path, f"{path}.bak")
    df.select(F.concat_ws(",", F.col(date).cast("string"), F.format_string("%.3f", sentinel(F.col(value)))).alias("value")).write.mode("overwrite").text(path)


def masters(panel: DataFrame, path: str, keys: list[str], columns: dict[str, list[str]]) -> None:
    """One table a variable below ``path``: the keys and those of its columns that the panel has."""
    for name, wanted in columns.items():
        panel.select(*keys, *[c for c in wanted if c in panel.columns]).write.mode("overwrite").parquet(f"{path}/{name}")
