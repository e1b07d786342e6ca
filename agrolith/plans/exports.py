"""Exported files: overlaps, headers in prose, the years of a workbook."""

from __future__ import annotations

from pyspark.sql import functions as F

from agrolith.operators import exports as E
from agrolith.plans.climate import r4
from agrolith.plans.domain import r6
from agrolith.plans.registry import query
from agrolith.sources import adapters as A
from agrolith.sources import text
from agrolith.streaming.runtime import shared_path

_FILES = """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS date, r_name AS state, n_name AS district, year(o_orderdate) AS y, o_orderpriority AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT 'year-' || y AS file, * FROM o UNION ALL SELECT 'year-' || (y + 1), * FROM o WHERE y = 1996 AND month(date) = 12),
u AS (SELECT file, CAST(date_trunc('month', date) AS DATE) AS month, CASE WHEN file = 'year-1998' AND p = '1-URGENT' THEN 'asia|unknown' ELSE regexp_replace(lower(state), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(district), '[^a-z0-9]', '', 'g') END AS unit FROM f WHERE NOT (file = 'year-1995' AND district = 'NATION_3')),
k AS (SELECT regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') || '|' || regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS unit FROM nation JOIN region ON n_regionkey = r_regionkey)"""


@query("d20_overlapping_files", f"""{_FILES}, m AS (SELECT DISTINCT file, month FROM u), c AS (SELECT a.file, count(DISTINCT a.month) AS clashes FROM m a JOIN m b ON a.month = b.month AND b.file < a.file GROUP BY 1)
SELECT u.file, strftime(min(month), '%Y-%m-%d') AS first, strftime(max(month), '%Y-%m-%d') AS last, CAST(count(*) AS BIGINT) AS rows, CAST(count(DISTINCT unit) AS BIGINT) AS units, CAST((SELECT count(*) FROM k) - count(DISTINCT unit) FILTER (unit IN (SELECT unit FROM k)) AS BIGINT) AS absent,
round(100.0e0 * count(*) FILTER (unit IN (SELECT unit FROM k)) / count(*), 6) AS match_percent, CAST(coalesce(any_value(clashes), 0) AS BIGINT) AS overlapping,
CASE WHEN any_value(clashes) > 0 THEN 'overlap' WHEN 100.0e0 * count(*) FILTER (unit IN (SELECT unit FROM k)) / count(*) < 98 OR count(DISTINCT unit) FILTER (unit IN (SELECT unit FROM k)) < (SELECT count(*) FROM k) THEN 'warning' ELSE 'ok' END AS verdict FROM u LEFT JOIN c ON c.file = u.file GROUP BY u.file""")
def d20_files(spark, d):
    """A file a year, of which one repeats a month of the year before, one misses a unit, and one names units that nobody knows."""
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    places = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("r_name").alias("state"), F.col("n_name").alias("district"))
    o, c = A.table(spark, d, "orders"), A.table(spark, d, "customer")
    x = o.join(c, o.o_custkey == c.c_custkey).join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("o_orderdate").cast("date").alias("date"), "state", "district", "o_orderpriority")
    once = x.withColumn("name", F.concat(F.lit("year-"), F.year("date")))
    rows = once.union(x.where("year(date) = 1996 and month(date) = 12").withColumn("name", F.lit("year-1997"))).where("not (name = 'year-1995' and district = 'NATION_3')")
    odd = (F.col("name") == "year-1998") & (F.col("o_orderpriority") == "1-URGENT")
    rows = rows.withColumns({"state": F.when(odd, "Asia").otherwise(F.col("state")), "district": F.when(odd, "un known").otherwise(F.col("district"))})
    path = shared_path(spark, "exports")
    rows.select("date", "state", "district", "name").write.partitionBy("name").option("header", True).csv(path)
    read = spark.read.option("header", True).schema("date date, state string, district string").csv(f"{path}/name=*")
    file = F.regexp_extract("_metadata.file_path", "name=([^/]+)", 1)
    got = E.verify_files(read.withColumn("file", file), places, F.col("file"), "date", ["state", "district"])
    return got.select("file", *[F.col(c).cast("string").alias(c) for c in ("first", "last")], "rows", "units", "absent", r6(F.col("match_percent"), "match_percent"), F.col("overlaps").alias("overlapping"), "verdict")


_K = "CAST(substr(p_brand, 7) AS INT)"


@query("s10_header_in_prose", f"SELECT 'report-' || (2000 + {_K}) || '-0' || ({_K} % 9 + 1) || '-15.csv' AS file, (2000 + {_K}) || '-0' || ({_K} % 9 + 1) || '-15' AS as_of, p_type AS crop, CAST(count(*) AS BIGINT) AS sown, round(sum(p_retailprice), 4) AS normal FROM part WHERE p_brand <> 'Brand#5' GROUP BY p_brand, p_type")
def s10(spark, d):
    """Reports with as many lines of prose as their brand says before the header; one has none at all."""
    p = A.table(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("sown"), F.sum("p_retailprice").alias("normal"))
    line = F.concat_ws(",", F.concat(F.lit(' "'), "p_type", F.lit('" ')), F.col("normal").cast("string"), F.col("sown").cast("string"))
    k = F.substring("p_brand", 7, 9).cast("int")
    body = p.groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list(line)), "\r\n").alias("body"))  # a report is one file
    prose = F.repeat(F.lit("Ministry, department\n"), k % 8 * 2)
    header = F.when(F.col("p_brand") == "Brand#5", "Commodity,normal,sown").otherwise(" CROP ,normal,sown")
    name = F.concat(F.lit("report-"), (k + 2000).cast("string"), F.lit("-0"), (k % 9 + 1).cast("string"), F.lit("-15.csv"))
    path = shared_path(spark, "reports")
    named = body.select(F.concat(prose, header, F.lit("\r\n"), "body", F.lit("\n\n,,\n")).alias("value"), name.alias("name"))
    named.write.partitionBy("name").option("lineSep", "\n").text(path)
    rows, _ = text.tables_after_prose(spark, f"{path}/name=*", "Crop", "crop string, normal double, sown long", name=F.regexp_extract("_metadata.file_path", "name=([^/]+)", 1))
    return rows.select("file", F.col("as_of").cast("string").alias("as_of"), "crop", "sown", r4(F.col("normal"), "normal"))


@query("k03_years_of_a_workbook", """WITH n AS (SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT span, sum(n) AS size FROM n, (SELECT unnest([40, 20, 10, 5, 2, 1]) AS span) WHERE y > (SELECT max(y) FROM n) - span GROUP BY 1), c AS (SELECT max(span) AS span FROM s WHERE size <= (SELECT count(*) // 2 FROM lineitem))
SELECT CAST(y AS INT) AS year, CAST(n AS BIGINT) AS rows FROM n, c WHERE y > (SELECT max(y) FROM n) - span""")
def k03(spark, d):
    """The last years that hold at most half of all rows, by halving."""
    x = A.table(spark, d, "lineitem").withColumn("year", F.year("l_shipdate"))
    kept = E.recent_years(x, "year", 40, x.count() // 2, 1 << 40, ["l_shipdate", "l_orderkey", "l_linenumber"])
    return kept.groupBy("year").agg(F.count(F.lit(1)).alias("rows"))
