"""DuckDB restatements of the adapter tables, as common table expressions for the oracles."""

REGISTRY = """registry AS (SELECT n.n_nationkey AS district_id, n.n_name AS district, r.r_name AS state, CAST(coalesce(c.k, 0) AS DOUBLE) AS area
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) c ON c.c_nationkey = n.n_nationkey)"""
DAILY = """daily AS MATERIALIZED (SELECT n.n_nationkey AS district_id, CAST(s.d AS DATE) AS date, r.rain_mm, t.tmax_c, t.tmin_c
  FROM nation n CROSS JOIN (SELECT unnest(generate_series(f, t, INTERVAL 1 DAY)) AS d FROM (SELECT min(x) AS f, max(x) AS t FROM (SELECT date_trunc('day', o_orderdate) AS x FROM orders UNION ALL SELECT date_trunc('day', l_shipdate) FROM lineitem))) s
  LEFT JOIN (SELECT c_nationkey AS k, CAST(o_orderdate AS DATE) AS d, CAST(sum(CAST(round(o_totalprice * 0.1) AS BIGINT)) AS DOUBLE) / 1024.0e0 AS rain_mm FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) r ON r.k = n.n_nationkey AND r.d = CAST(s.d AS DATE)
  LEFT JOIN (SELECT s_nationkey AS k, CAST(l_shipdate AS DATE) AS d, max(l_quantity) AS tmax_c, min(l_quantity) AS tmin_c FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2) t ON t.k = n.n_nationkey AND t.d = CAST(s.d AS DATE))"""
MONTHLY = """monthly AS (SELECT district_id, CAST(date_trunc('month', date) AS DATE) AS month, sum(rain_mm) AS rain_mm, avg(tmax_c) AS tmax_c, avg(tmin_c) AS tmin_c, CAST(count(rain_mm) AS BIGINT) AS days FROM daily GROUP BY 1, 2)"""
INDEX = """m0 AS (SELECT CAST(year(l_shipdate) AS INT) AS year, CAST(month(l_shipdate) AS INT) AS month, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2),
idx AS (SELECT year, month, round((v - (SELECT avg(v) FROM m0)) / (SELECT stddev_samp(v) FROM m0), 6) AS idx FROM m0)"""


def with_(*tables: str) -> str:
    return "WITH " + ",\n".join(tables)


def day(c: str = "date") -> str:
    return f"strftime({c}, '%Y-%m-%d')"
