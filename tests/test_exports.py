"""Overlapping files, headers in prose, the years that fit."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from agrolith.operators import exports as E
from agrolith.sources import text


def test_two_files_with_one_month_fail_and_a_weak_match_warns(spark):
    registry = spark.createDataFrame([("Bihar", "Aurangabad"), ("Maharashtra", "Aurangabad"), ("J & K", "Leh (Ladakh)")], "state string, district string")
    day = lambda m, d=1: dt.date(2020, m, d)
    whole = lambda f, m: [(f, day(m), "bihar", "AURANGABAD"), (f, day(m, 2), "Maharashtra", "Aurangabad"), (f, None, "j&k", "leh ladakh")]
    rows = [r for f, m in (("a", 1), ("b", 2), ("c", 2), ("d", 4), ("d", 2), ("e", 6)) for r in whole(f, m)] + [("e", day(6), "Bihar", "Gaya")] + [r for _ in range(49) for r in whole("f", 9)] + [("f", day(9), None, None)] * 3
    got = {r.file: r for r in E.verify_files(spark.createDataFrame(rows, "file string, date date, state string, district string"), registry, F.col("file"), "date", ["state", "district"]).collect()}
    assert {f: (r.verdict, r.overlaps, r.with_files) for f, r in got.items()} == {"a": ("ok", 0, 0), "b": ("ok", 0, 0), "c": ("overlap", 1, 1), "d": ("overlap", 1, 1), "e": ("warning", 0, 0), "f": ("ok", 0, 0)}
    assert (got["e"].match_percent, got["e"].units, got["e"].absent) == (75.0, 4, 0) and got["f"].match_percent == pytest.approx(98.0)
    gaps = E.months_between(spark.createDataFrame([(r[1],) for r in rows], "month date")).collect()
    assert sorted(r.month.month for r in gaps) == [3, 5, 7, 8]


def test_shifted_headers_are_found_and_files_without_one_reported(spark, tmp_path):
    table = 'CROP,Normal,Sown\n"Rice, wet",1.5,2\r\nMaize,x,3\n,9,9\n\nTotal,,5'
    for name, prose in (("k_2024-07-05.csv", ""), ("k_2024-07-12.csv", "a\n" * 14), ("k_2024-07-19.csv", "a\n" * 15), ("undated.csv", "Crop of the year: rice\n  crop  of\n")):
        (tmp_path / name).write_text(prose + table)
    rows, none = text.tables_after_prose(spark, str(tmp_path), "Crop", "crop string, normal double, sown long")
    got = sorted((r.file, r.line, r.as_of, r.crop, r.normal, r.sown) for r in rows.where("file <> 'undated.csv'").collect())
    assert got == [(f, n + k, dt.date(2024, 7, d), *r) for f, n, d in (("k_2024-07-05.csv", 0, 5), ("k_2024-07-12.csv", 14, 12)) for k, r in ((2, ("Rice, wet", 1.5, 2)), (3, ("Maize", None, 3)), (6, ("Total", None, 5)))]
    assert {(r.file, str(r.as_of)) for r in none.collect()} == {("k_2024-07-19.csv", "2024-07-19")}
    assert {r.as_of for r in rows.where("file = 'undated.csv'").collect()} == {None} and rows.where("file = 'undated.csv'").count() == 3


@pytest.mark.parametrize("most", [400, 57, 30, 9, 3, 1])
def test_years_that_fit_equal_brute_force(spark, most):
    table = [(2000 + i % 13, i) for i in range(200) if i % 13 < 11 or i > 180] + [(None, 999)]
    got = sorted(E.recent_years(spark.createDataFrame(table, "year int, i int"), "year", 8, 100_000, 2 * most, ["i"]).collect())
    last, span = max(y for y, _ in table if y), 8
    while span >= 1 and sum(y is not None and y > last - span for y, _ in table) > most:
        span //= 2
    want = sorted(r for r in table if r[0] is not None and r[0] > last - span) if span else sorted(sorted((r for r in table if r[0] == last), key=lambda r: -r[1])[:most])
    assert [tuple(r) for r in got] == want
