"""Streaming queries over the event table, drained to its end; the oracles restate them in batch SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agrolith.plans.registry import query
from agrolith.sources import adapters as A
from agrolith.streaming import operators as S
from agrolith.streaming import runtime as R
from agrolith.streaming.ordered import DrySpells, Seasons, ordered
from agrolith.streaming.revisions import follow


def r3(c: str):
    return F.round(c, 3).alias(c)


@query("st05_full_days", "SELECT strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2 HAVING count(*) >= 4")
def st05(spark, d):
    out = R.drain(S.full_days(R.events(spark, d), 4), "full-days", "update", ["day", "event_type"])
    return out.select(F.col("day").cast("string").alias("day"), "event_type", "n", r3("total"))


@query("st06_sliding_sums", "WITH k AS (SELECT event_type, value, CAST(CAST(ts AS DATE) - CAST(i AS INT) AS DATE) AS since FROM events, range(0, 7) r(i)) SELECT strftime(since, '%Y-%m-%d') AS since, strftime(CAST(since + 7 AS DATE), '%Y-%m-%d') AS until, event_type, round(sum(value), 3) AS total FROM k GROUP BY ALL")
def st06(spark, d):
    out = R.drain(S.sliding_sums(R.events(spark, d)), "sliding", "update", ["since", "event_type"])
    return out.select(F.col("since").cast("string").alias("since"), F.col("until").cast("string").alias("until"), "event_type", r3("total"))


@query("st07_sessions", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, CAST(count(*) AS BIGINT) AS n, round(sum(value), 3) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY")
def st07(spark, d):
    out = R.drain(S.sessions(R.events(spark, d), "6 hours", "1 day"), "sessions", "append")
    return out.select("user_id", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "n", r3("total"))


@query("st09_layer_edges", "SELECT event_type, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS edge FROM events GROUP BY 1")
def st09(spark, d):
    return R.drain(S.edges(R.events(spark, d)), "edges", "update", ["event_type"]).select("event_type", F.date_format("edge", "yyyy-MM-dd HH:mm:ss").alias("edge"))


#: Rows wait so long for earlier ones; what is left of a stream's end waits for the rows to come.
LATE_DAYS = 2
DRY = f"WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), x AS (SELECT *, coalesce(v > m, false) AS wet FROM d, (SELECT avg(v) AS m FROM d)), g AS (SELECT *, sum(CAST(wet AS INT)) OVER (PARTITION BY event_type ORDER BY day) AS k, day - CAST(row_number() OVER (PARTITION BY event_type ORDER BY day) AS INT) AS island FROM x), o AS (SELECT event_type, day, CAST(count(*) FILTER (NOT wet) OVER (PARTITION BY event_type, k, island ORDER BY day) AS BIGINT) AS dry_days FROM g) SELECT event_type, strftime(day, '%Y-%m-%d') AS day, dry_days FROM o WHERE day <= (SELECT max(day) FROM d) - {LATE_DAYS}"


def swapped(days, slices: int = 5):
    """Rows of days as a stream of some files. Of each two days the later one comes first, at times in an earlier file."""
    spark, path = days.sparkSession, R.shared_path(days.sparkSession, "slices")
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    n = F.datediff("day", "first")
    at = F.floor((n + 1 - 2 * (n % 2)) * slices / (F.datediff("last", "first") + 2))
    dealt = days.crossJoin(F.broadcast(span)).withColumn("slice", at).drop("first", "last")
    for i in range(slices):  # the stream reads files by age
        dealt.where(F.col("slice") == i).drop("slice").coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(days.schema).option("maxFilesPerTrigger", 1).parquet(path)


def daily_means(spark, d):
    path = R.shared_path(spark, "event-days")
    A.table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("value")).write.parquet(path)
    return spark.read.parquet(path)


@query("st08_dry_spell_state", DRY)
def st08(spark, d):
    days = daily_means(spark, d)
    wet = days.agg(F.avg("value")).first()[0]
    with R.disk_state(spark):
        out = R.drain(ordered(swapped(days), ["event_type"], "day", "value", DrySpells(["event_type"], wet), "dry_days long", f"{LATE_DAYS} days"), "dry-spell", "append")
    return out.select("event_type", F.col("ts").cast("date").cast("string").alias("day"), "dry_days")


COUNTERS = "c AS (SELECT event_type, day, sum(v) OVER (PARTITION BY event_type, datediff('day', DATE '2000-01-01', day) // 9 ORDER BY day) AS v FROM d WHERE NOT (event_type < 'd' AND day(day) BETWEEN 12 AND 16))"


@query("st07_season_segments", f"""WITH RECURSIVE d AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY 1, 2), {COUNTERS},
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS n FROM c),
f AS (SELECT event_type, n, day, v, 0 AS segment, v AS top, day AS since FROM r WHERE n = 1 UNION ALL
  SELECT r.event_type, r.n, r.day, r.v, f.segment + CAST(r.day - f.day > 3 OR r.v < 0.6e0 * f.top AS INT), CASE WHEN r.day - f.day > 3 OR r.v < 0.6e0 * f.top THEN r.v ELSE greatest(f.top, r.v) END, CASE WHEN r.day - f.day > 3 OR r.v < 0.6e0 * f.top THEN r.day ELSE f.since END FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)
SELECT event_type, strftime(day, '%Y-%m-%d') AS day, CAST(segment AS INT) AS segment, strftime(since, '%Y-%m-%d') AS since FROM f WHERE day <= (SELECT max(day) FROM c) - {LATE_DAYS}""")
def st07_seasons(spark, d):
    """Counters that start again each nine days, some silent for a while, cut into seasons by either rule, though days come out of order."""
    block = F.floor(F.datediff("day", F.lit("2000-01-01").cast("date")) / 9)
    running = F.sum("value").over(Window.partitionBy("event_type", block).orderBy("day"))
    kept = daily_means(spark, d).where("not (event_type < 'd' and day(day) between 12 and 16)")
    counters = kept.withColumn("value", running)
    with R.disk_state(spark):
        fold = Seasons(["event_type"], gap_days=3)
        out = R.drain(ordered(swapped(counters), ["event_type"], "day", "value", fold, "segment int, since timestamp", f"{LATE_DAYS} days"), "seasons", "append")
    return out.select("event_type", *[F.col(a).cast("date").cast("string").alias(b) for a, b in (("ts", "day"), ("since", "since"))], "segment")


@query("st01_late_revisions", """WITH x AS (SELECT event_type, user_id, CAST(ts AS DATE) AS day, value, event_id, CAST(event_id % 4 AS INT) AS b FROM events),
e AS (SELECT b.b, (SELECT max(day) FROM x WHERE x.b < b.b) AS edge FROM (SELECT DISTINCT b FROM x) b),
k AS (SELECT day, min(b) AS first FROM x GROUP BY 1),
t AS (SELECT x.* FROM x JOIN e USING (b) JOIN k USING (day) WHERE k.first = x.b OR x.day >= e.edge - 10)
SELECT event_type, user_id, strftime(day, '%Y-%m-%d') AS day, CAST(arg_max(event_id, b * 1000000000000 + event_id) AS BIGINT) AS event_id FROM t GROUP BY event_type, user_id, day""")
def st01(spark, d):
    """Four files of values, each revising the others: after the first, only the last ten days and days that were missing change."""
    e = A.table(spark, d, "events").select("event_type", "user_id", F.to_date("ts").alias("day"), "value", "event_id")
    path = R.shared_path(spark, "revised")
    for i in range(4):
        e.where(F.col("event_id") % 4 == i).coalesce(1).write.mode("append").parquet(f"{path}/input")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/input")
    table = follow(stream, f"{path}/table", ["event_type", "user_id"], "day", "event_id")
    return table.select("event_type", "user_id", F.col("day").cast("string").alias("day"), "event_id")


@query("st02_incremental_upsert", "SELECT event_type, user_id, CAST(max(event_id) AS BIGINT) AS event_id FROM events GROUP BY 1, 2")
def st02(spark, d):
    latest = S.timed(R.events(spark, d)).groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id"))
    changes = R.drain(latest, "upsert", "update")
    return changes.groupBy("event_type", "user_id").agg(F.max("event_id").alias("event_id"))


@query("st04_stream_static_persistence", "WITH i AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(max(event_id) AS BIGINT) AS v FROM events WHERE value > 90 GROUP BY 1, 2) SELECT e.event_id, CAST(arg_max(i.v, i.day) AS BIGINT) AS v FROM events e LEFT JOIN i ON i.event_type = e.event_type AND i.day BETWEEN CAST(e.ts AS DATE) - 3 AND CAST(e.ts AS DATE) - 1 GROUP BY 1")
def st04(spark, d):
    e = A.table(spark, d, "events")
    days = e.where("value > 90").groupBy("event_type", F.to_date("ts").alias("seen")).agg(F.max("event_id").alias("v"))
    index = S.persisted(days, ["event_type"], "seen", "v", 3)
    stream = R.events(spark, d).withColumn("day", F.to_date("ts"))
    return R.drain(stream.join(index, ["event_type", "day"], "left").select("event_id", "v"), "static", "append")
