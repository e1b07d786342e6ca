"""Each domain query against its DuckDB oracle on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from agrolith.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v + 0.0:.9g}"
    return str(int(v)) if isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(registry.ORACLES[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i]) for i in at) for r in cursor.fetchall())
    as_number = lambda rows: [tuple(plain(float(x)) if x.lstrip("-").replace(".", "", 1).isdigit() else x for x in r) for r in rows]
    assert sorted(as_number(got)) == sorted(as_number(want))


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """The tables, 21 years later."""
    from pyspark.sql import functions as F

    base = str(tmp_path_factory.mktemp("shifted"))
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        later = {c: F.add_months(c, 12 * 21).cast(k) for c, k in df.dtypes if k.startswith("timestamp")}
        df.withColumns(later).write.parquet(f"{base}/{t}.parquet")
    return base


@pytest.mark.parametrize("name", ["a03_monthly_resample", "a08_ratio_of_sums", "d06_daily_layers", "q01_layer_with_fallback", "q09_wide_export", "k06_positional_payload", "st03_edges_and_holes", "s24_edge_of_newest_file"])
def test_dates_come_from_the_tables(spark, shifted, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{shifted}/{t}.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, shifted).collect()
    names = [x[0] for x in con.execute(registry.ORACLES[name]).description]
    want = con.execute(registry.ORACLES[name]).fetchall()
    same = lambda rows: sorted(tuple("" if v is None else f"{v:.6g}" if isinstance(v, (int, float)) else str(v) for v in r) for r in rows)
    assert same(tuple(r[c] for c in names) for r in got) == same(want) and len(want) > 0


def test_every_observation_is_in_the_daily_table(spark, shifted):
    from pyspark.sql import functions as F

    from agrolith.sources import adapters

    for base in (SF, shifted):
        kept = adapters.daily(spark, base).agg(F.count("rain_mm"), F.count("tmax_c")).first()
        assert tuple(kept) == (adapters.observed_rain(spark, base).count(), adapters.observed_temperature(spark, base).count())


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= names and set(registry.QUERIES) <= names


def test_nothing_but_the_entry_needs_the_training_data_operators():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(os.path.join(root, "agrolith")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as h:
                        assert "agrolith.llm" not in h.read()


@pytest.fixture(scope="module")
def level(tmp_path_factory):
    """The tables with quantities that never change, change in the first month alone, or are of one month alone, by supplier."""
    base, con = str(tmp_path_factory.mktemp("level")), duckdb.connect()
    kept = {"lineitem": "l_suppkey % 4 <> 3 OR (l_shipdate >= DATE '1997-03-01' AND l_shipdate < DATE '1997-04-01')", "supplier": "true"}
    columns = {"lineitem": "CASE WHEN l_suppkey % 4 IN (0, 3) OR (l_suppkey % 4 = 1 AND l_shipdate >= DATE '1995-02-01') THEN 7 ELSE l_quantity END AS l_quantity", "supplier": "CAST(s_suppkey AS INTEGER) AS s_nationkey"}
    for t in TABLES:
        con.execute(f"COPY (SELECT *{f' REPLACE ({columns[t]})' if t in columns else ''} FROM '{SF}/{t}.parquet' WHERE {kept.get(t, 'true')}) TO '{base}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"create view {t} as select * from '{base}/{t}.parquet'")
    return base, con


@pytest.mark.parametrize("name", ["a22_relative_spread", "d19_leakage_audit", "x03_spread_and_correlation", "x09_served_departures"])
def test_constant_columns_give_what_the_sql_gives(spark, level, name):
    base, con = level
    exact = lambda v: "" if v is None else f"{v + 0.0:.9g}" if isinstance(v, int | float) else v
    df = registry.QUERIES[name](spark, base)
    cursor = con.execute(registry.ORACLES[name])
    assert [x[0] for x in cursor.description] == df.columns
    assert sorted(tuple(map(exact, r)) for r in df.collect()) == sorted(tuple(map(exact, r)) for r in cursor.fetchall())
