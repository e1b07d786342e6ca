import datetime as dt
import json

from pyspark.sql import functions as F

from agrolith.sources import sinks, text


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_text_tables(spark):
    assert rows(text.fixed_table(lines(spark, "1999 1 0.5", "a header", "2000  2  -1"), ["y", "m", "v"])) == [(1999, 1, 0.5), (2000, 2, -1)]
    assert rows(text.dated_values(lines(spark, "prose, and more", "2001-02-03, 1.5", "2001-02-04,-999"))) == [(dt.date(2001, 2, 3), 1.5), (dt.date(2001, 2, 4), None)]
    assert rows(text.season_values(lines(spark, "SEAS YR TOTAL ANOM", "DJF 1950 24.72 -1.53", "NDJ 1950 25 0.1"))) == [(1950, 1, 24.72, -1.53), (1950, 12, 25.0, 0.1)]
    grid = rows(text.year_grid(lines(spark, "1948 2024", "1950 " + " ".join(map(str, range(1, 12))) + " -99999", "missing -99.9")))
    assert len(grid) == 12 and grid[0] == (1950, 1, 1.0) and grid[-1] == (1950, 12, None)
    assert rows(text.column_of(lines(spark, "x y z", "2001 3 a 7.5"), 1, 2, 4)) == [(2001, 3, 7.5)]


def test_csv_sources(spark, tmp_path):
    for name, body in (("a_2023010100", "date,v,w\n2001-01-01,1,x\n"), ("a_2024010100", "date,v,w\n2001-01-01,2,y\n2001-01-02,3,z\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    schema = "date date, v int, w string"
    got = text.csv_without_overlap(spark, f"{tmp_path}/*.csv", schema, ["date"])
    assert sorted((r.v, r.w) for r in got.collect()) == [(2, "y"), (3, "z")]
    assert text.newest(spark, f"{tmp_path}/a_*.csv").endswith("a_2024010100.csv")
    assert text.first_present(spark, [f"{tmp_path}/none/*.csv", f"{tmp_path}/*.csv"]) == f"{tmp_path}/*.csv"
    assert text.optional(spark, f"{tmp_path}/none/*.csv", schema) is None
    assert text.csv(spark, f"{tmp_path}/a_2024010100.csv", schema, ["v"]).columns == ["v"]


def test_slipped_units(spark):
    df = spark.createDataFrame([("1000", "189.16"), ("5000", "Ha"), ("12.5", "Th Ha"), ("x", "Ha")], "v string, u string")
    assert [r[0] for r in df.select(text.repaired_area(F.col("v"), F.col("u"))).collect()] == [189.16, 5.0, 12.5, None]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, dt.date(2000, 1, 1), 1.26), (2, dt.date(2000, 1, 1), None), (1, dt.date(2001, 1, 1), 3.0)], "id int, date date, v double")
    sinks.by_year(df, str(tmp_path / "t"), ["date", "id"])
    sinks.by_year(df.where("year(date) = 2001").withColumn("v", F.lit(9.0)), str(tmp_path / "t"), ["date", "id"])
    assert sorted((r.year, r.id, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [(2000, 1, 1.26), (2000, 2, None), (2001, 1, 9.0)]
    payload = sinks.layer_maps(df.withColumn("layer", F.lit("rain")), "layer", "date", "id", "v").first()
    assert json.loads(payload.json) == {"2000-01-01": {"1": 1.3}, "2001-01-01": {"1": 3.0}}
    assert sorted((str(r.date), r["values"]) for r in sinks.positional(df, "date", "id", "v").collect()) == [("2000-01-01", [1.26, None]), ("2001-01-01", [3.0])]
    sinks.text_series(df.where("id = 2"), str(tmp_path / "s"), "date", "v")
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["2000-01-01,-9999.000"]


def test_a_series_that_is_written_again_is_kept_beside(spark, tmp_path):
    path = str(tmp_path / "series")
    for v in (1.0, 2.0, 3.0):
        sinks.text_series(spark.createDataFrame([(dt.date(2000, 1, 1), v)], "date date, v double"), path, "date", "v", backup=True)
    assert [[r.value for r in spark.read.text(p).collect()] for p in (path, path + ".bak")] == [["2000-01-01,3.000"], ["2000-01-01,2.000"]]
