"""A table of days that a stream of late and revised values keeps up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agrolith.sources import files


def upsert_days(batch: DataFrame, number: int, path: str, keys: list[str], day: str, version: str, tail: int = 10) -> None:
    """Take a batch (keys, day, version, ...) into the table at ``path``, which has a folder for each day.

    Values of the last ``tail`` days before the table's edge are still revised; rows of older days are
    taken only if the table has nothing of that day, so that holes are filled and settled days stay. Of rows with the same keys and day, the
    greatest version of the batch wins, and the batch wins over the table. Only days that change are written, by dynamic overwrite.

    A batch may be run again: the edge as it was before is written under the batch's number first and
    read again, so that a run that broke off half way goes on by the same rule, and one that was done changes nothing.
    """
    spark = batch.sparkSession
    data, mark, staged = f"{path}/days", f"{path}/edges/batch={number}", f"{path}/staged/{uuid.uuid4().hex}"
    columns = batch.columns
    have = spark.read.schema(batch.schema).parquet(data) if files.exists(spark, data) else spark.createDataFrame([], batch.schema)
    if not files.exists(spark, f"{mark}/_SUCCESS"):
        have.agg(F.max(day).alias("edge")).write.mode("overwrite").parquet(mark)
    edge = spark.read.schema(f"edge {batch.schema[day].dataType.simpleString()}").parquet(mark)
    known = have.select(F.col(day).alias("__known")).distinct()
    best = Window.partitionBy(*keys, day).orderBy(F.desc(version))
    fresh = batch.where(F.col(day).isNotNull()).withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__n")
    judged = fresh.join(known, F.col(day) == F.col("__known"), "left").crossJoin(F.broadcast(edge))
    taken = judged.where(F.col("__known").isNull() | (F.col(day) >= F.date_sub("edge", tail))).select(*columns)
    taken.write.parquet(f"{staged}/new")
    taken = spark.read.schema(batch.schema).parquet(f"{staged}/new")
    touched = taken.select(F.col(day).alias("__touched")).distinct()
    kept = have.join(touched, F.col(day) == F.col("__touched"), "left_semi").join(taken.select(*keys, day).distinct(), [*keys, day], "left_anti").select(*columns)
    kept.unionByName(taken).write.parquet(f"{staged}/days")  # the table isn't read while it is written
    whole = spark.read.schema(batch.schema).parquet(f"{staged}/days")
    whole.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(data)
    files.remove(spark, staged)


def follow(stream: DataFrame, path: str, keys: list[str], day: str, version: str, tail: int = 10) -> DataFrame:
    """Take all input that a stream has into the table at ``path``, batch by batch, and read it."""
    take = lambda batch, number: upsert_days(batch, number, path, keys, day, version, tail)
    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(take).start().awaitTermination()
    return stream.sparkSession.read.schema(f"{stream._jdf.schema().toDDL()}").parquet(f"{path}/days").select(*stream.columns)
