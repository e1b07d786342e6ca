"""URL filters as a temporal join: list entries become validity intervals, captures meet those of their time.

A list is a table of dated entries (list, kind, key, action, dated): an entry of kind
``host`` is about one host, ``domain`` about a domain and all hosts below it, ``url`` about one
address without scheme, query and fragment. ``block`` and ``allow`` open an interval that
lasts until the next entry of the same list, kind and key; ``remove`` opens none. Of entries
of one day ``remove`` goes before ``allow`` and ``allow`` before ``block``.

Each capture looks up its address, host and parent domains as of the day it was fetched. The
most specific entry then active decides: address, then host, then the longest domain; of
equals, blocking does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.shared import sized, stored

#: Beyond the number of labels that a host can have.
HOST_RANK = 1 << 28
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
ENTRY = "list string, kind string, key string, action string, dated date"


def host_of(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Rows (list, kind, key, action, since, until): until is exclusive, null if still valid."""
    rows = entries.where("key is not null and dated is not null and action in ('block', 'allow', 'remove')")
    first = F.min(F.when(F.col("action") == "allow", "allow"))
    daily = rows.groupBy("list", "kind", F.lower("key").alias("key"), "dated").agg(F.max("action").alias("last"), first.alias("allow"))
    daily = daily.withColumn("action", F.when(F.col("last") == "remove", "remove").otherwise(F.coalesce("allow", "last")))
    after = F.lead("dated").over(Window.partitionBy("list", "kind", "key").orderBy("dated"))
    return daily.select("list", "kind", "key", "action", F.col("dated").alias("since"), after.alias("until")).where("action <> 'remove'")


def keys(url: Column, most: int) -> Column:
    """Array of struct(kind, key, rank) that a URL is looked up by, with the domains of up to ``most`` labels; empty without a host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.greatest(F.lit(1), n - most + 1), n), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, n), ".").alias("key"), (n - i + 1).alias("rank")))
    own = F.array(F.struct(F.lit("host").alias("kind"), host.alias("key"), F.lit(HOST_RANK).alias("rank")), F.struct(F.lit("url").alias("kind"), F.concat(host, F.lower(F.regexp_extract(url, PATH, 1))).alias("key"), F.lit(2 * HOST_RANK).alias("rank")))
    return F.when(host != "", F.concat(own, domains)).otherwise(F.slice(own, 1, 0))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (page_id, url, fetched, blocked, list, kind, key, since), one for each capture (page_id, url, fetched).

    The last four are those of the deciding entry, null where none was active. A null or
    unreadable url or a null date meets no entry and isn't blocked; a host may have any length. Of equal blocking entries the least (list, kind, key) is named. Repeated rows are judged
    each; other columns are ignored; either table may be empty.

    The join is on the key, so that a host with a third of all captures is split by Spark at
    run time, and the matches of a task are reduced to the best of each capture before they
    are shuffled. The intervals are broadcast only if they are few.
    """
    valid = stored(intervals(entries), "url-intervals")
    rows = stored(captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched")).withColumn("row", F.monotonically_increasing_id()), "url-captures")
    # no capture need ask for a domain of more labels than any entry has
    most = valid.where("kind = 'domain'").agg(F.coalesce(F.max(F.size(F.split("key", r"\."))), F.lit(1))).first()[0]
    asked = rows.where("fetched is not null").select("row", "fetched", F.explode(keys(F.col("url"), most)).alias("k")).select("row", "fetched", "k.*")
    active = asked.join(sized(valid, 100_000), ["kind", "key"]).where("fetched >= since and (until is null or fetched < until)")
    # the greatest of (rank, blocks), then the least name: one number orders the first two
    order = F.col("rank") * 2 + (F.col("action") == "block").cast("int")
    best = active.groupBy("row").agg(F.min(F.struct((-order).alias("o"), "list", "kind", "key", "since", "action")).alias("best"))
    return rows.join(best, "row", "left").select("page_id", "url", "fetched", F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"), "best.list", "best.kind", "best.key", "best.since")


def captures_of(pages: DataFrame) -> DataFrame:
    """The registered query's captures: pages carry no date, so that page_id deals them over 2024."""
    return pages.select("page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched"))


def feed_of(pages: DataFrame) -> DataFrame:
    """The registered query's list: dated entries by rule for the hosts and domains that occur.

    The md5 of a name says whether it is listed, when, and when the entry goes and comes back.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host <> ''").distinct()
    names = hosts.select(F.lit("host").alias("kind"), F.col("host").alias("key")).union(hosts.select(F.lit("domain"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1))).where("key <> ''").distinct()
    digit = lambda i, n=1: F.conv(F.substring(F.md5(F.concat("kind", F.lit(":"), "key").cast("binary")), i, n), 16, 10).cast("int")
    start = F.date_add(F.lit("2023-12-01").cast("date"), digit(2, 2))
    entry = lambda action, day: F.struct(F.lit("main").alias("list"), action.alias("action"), day.alias("dated"))
    dated = F.array(
        entry(F.when(digit(6) < 12, "block").otherwise("allow"), start),
        entry(F.lit("remove"), F.date_add(start, digit(4, 2) + 1)),
        entry(F.lit("block"), F.date_add(start, digit(4, 2) + 60)),
    )
    return names.where(digit(1) < 6).select("kind", "key", F.explode(dated).alias("e")).select("e.list", "kind", "key", "e.action", "e.dated")


def op1(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = judge(captures_of(pages), feed_of(pages)).drop("url")
    return rows.withColumns({c: F.col(c).cast("string") for c in ("fetched", "since")})


ORACLE = r"""
WITH cap AS (SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS DATE) AS fetched,
  regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '\.+$', '') AS host FROM pages),
hosts AS (SELECT DISTINCT host FROM cap WHERE host <> ''),
names AS (SELECT DISTINCT kind, key FROM (SELECT 'host' AS kind, host AS key FROM hosts UNION ALL SELECT 'domain', regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) FROM hosts) WHERE key <> ''),
m AS (SELECT *, md5(kind || ':' || key) AS x FROM names),
n AS (SELECT kind, key, CAST(DATE '2023-12-01' + CAST('0x' || substr(x, 2, 2) AS INT) AS DATE) AS start, CAST('0x' || substr(x, 4, 2) AS INT) AS gap, CASE WHEN CAST('0x' || substr(x, 6, 1) AS INT) < 12 THEN 'block' ELSE 'allow' END AS first FROM m WHERE CAST('0x' || substr(x, 1, 1) AS INT) < 6),
valid AS (SELECT kind, key, first AS action, start AS since, LEAST(start + gap + 1, start + gap + 60) AS until FROM n UNION ALL SELECT kind, key, 'block', start + gap + 60, NULL FROM n),
hits AS (SELECT c.page_id, v.*, row_number() OVER (PARTITION BY c.page_id ORDER BY CASE WHEN v.kind = 'host' THEN 1000 ELSE len(string_split(v.key, '.')) END DESC, v.action = 'block' DESC, v.kind, v.key) AS r
  FROM cap c JOIN valid v ON ((v.kind = 'host' AND v.key = c.host) OR (v.kind = 'domain' AND (c.host = v.key OR ends_with(c.host, '.' || v.key)))) AND c.fetched >= v.since AND (v.until IS NULL OR c.fetched < v.until))
SELECT c.page_id, strftime(c.fetched, '%Y-%m-%d') AS fetched, coalesce(h.action = 'block', false) AS blocked, CASE WHEN h.key IS NOT NULL THEN 'main' END AS list, h.kind, h.key, strftime(CAST(h.since AS DATE), '%Y-%m-%d') AS since FROM cap c LEFT JOIN hits h ON h.page_id = c.page_id AND h.r = 1"""
