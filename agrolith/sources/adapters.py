"""The domain's tables: as Spark reads them, or derived from the star schema of the test data.

Long tables throughout: a district is a row key, never a column. Dates are DATE, missing is
NULL, and days without an observation come in by a calendar spine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """district_id, district, state, area: one row a district; small, so that joins broadcast it."""
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("district_id")).agg(F.count(F.lit(1)).cast("double").alias("area"))
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_nationkey").alias("district_id"), F.col("n_name").alias("district"), F.col("r_name").alias("state"))
    return named.join(customers, "district_id", "left").select("district_id", "district", "state", F.coalesce("area", F.lit(0.0)).alias("area"))


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days from the first observation of any kind to the last; none without observations."""
    dates = [table(spark, sf_dir, t).select(F.col(c).cast("date").alias("date")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    ends = dates[0].union(dates[1]).agg(F.min("date").alias("first"), F.max("date").alias("last"))
    return ends.select(F.explode(F.sequence("first", "last")).alias("date"))


def with_last(df: DataFrame, column: str, name: str = "last") -> DataFrame:
    """``df`` with the greatest value of a column beside each row."""
    return df.crossJoin(F.broadcast(df.agg(F.max(column).alias(name))))


def observed_rain(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("date"), F.round(F.col("o_totalprice") * 0.1).cast("long").alias("units"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("district_id"))
    return orders.join(customer, orders.o_custkey == customer.c_custkey).groupBy("district_id", "date").agg((F.sum("units") / F.lit(1024.0)).alias("rain_mm"))


def observed_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("date"), "l_quantity")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("district_id"))
    return items.join(supplier, items.l_suppkey == supplier.s_suppkey).groupBy("district_id", "date").agg(F.max("l_quantity").alias("tmax_c"), F.min("l_quantity").alias("tmin_c"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """district_id, date, rain_mm, tmax_c, tmin_c on a dense calendar: all windows by rows need it."""
    districts = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district_id"))
    spine = districts.crossJoin(F.broadcast(calendar(spark, sf_dir)))
    return spine.join(observed_rain(spark, sf_dir), ["district_id", "date"], "left").join(observed_temperature(spark, sf_dir), ["district_id", "date"], "left")


def national_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """year, month, idx: a national monthly index, standardised over all months."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month")).agg(F.avg("l_discount").alias("v"))
    s = m.agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return m.crossJoin(F.broadcast(s)).select("year", "month", F.round((F.col("v") - F.col("mean")) / F.col("sd"), 6).alias("idx"))
