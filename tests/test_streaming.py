"""Streams against their batch forms: rows out of order, silences and resets, revisions, replays."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from agrolith.operators import windows
from agrolith.sources import files
from agrolith.streaming import runtime
from agrolith.streaming.ordered import DrySpells, Seasons, ordered
from agrolith.streaming.revisions import upsert_days

DAY = dt.datetime(2024, 1, 1)


def stream_of(spark, path, tables, schema):
    for t in tables:
        spark.createDataFrame(t, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_seasons_of_files_out_of_order_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for key in ("a", "b", None):
        total, day = 0.0, 0
        for _ in range(90):
            day += rng.choice([1, 1, 1, 2, 7, 25])
            total = rng.choice([total + rng.random() * 10] * 6 + [total * 0.5, 0.0])
            rows.append((key, DAY + dt.timedelta(days=day), round(total, 4)))
    end = max(r[1] for r in rows)
    rows.sort(key=lambda r: r[1])
    late = [rows[i : i + 12] for i in range(0, len(rows), 12)]
    for a, b in zip(late, late[1:]):  # some rows of each file come in the next one
        for r in [r for r in a if rng.random() < 0.2 and b[-1][1] - r[1] < dt.timedelta(days=60)]:
            a.remove(r)
            b.append(r)
    for part in late:
        rng.shuffle(part)
    stream = stream_of(spark, str(tmp_path / "in"), [p for p in late if p], "key string, t timestamp, v double")
    with runtime.disk_state(spark):
        out = runtime.drain(ordered(stream, ["key"], "t", "v", Seasons(["key"]), "segment int, since timestamp", "70 days"), "seasons", "append")
    got = sorted((r.key or "", r.ts.date(), r.value, r.segment) for r in out.collect())
    df = spark.createDataFrame(rows, "key string, t timestamp, v double").withColumn("t", F.to_date("t"))
    want = sorted((r.key or "", r.t, r.v, r.segment) for r in windows.segments(df, ["key"], "t", "v").collect())
    told = [w for w in want if w[1] <= (end - dt.timedelta(days=70)).date()]
    assert got == told and len(told) > 100 and max(w[3] for w in told) > 5


def test_a_late_day_is_counted_in_its_place(spark, tmp_path):
    at = lambda n, v: ("x", DAY + dt.timedelta(days=n), v)
    stream = stream_of(spark, str(tmp_path / "in"), [[at(0, 0.0), at(2, 0.0)], [at(1, 0.0), at(3, 9.0), at(4, 0.5)], [at(6, 0.0), at(5, None), at(7, 0.0)], [at(40, 0.0)], [at(1, 50.0)]], "key string, t timestamp, v double")
    with runtime.disk_state(spark):
        out = runtime.drain(ordered(stream, ["key"], "t", "v", DrySpells(["key"], 1.0), "dry_days long", "3 days"), "dry", "append")
    assert [(r.ts.day, r.dry_days) for r in out.orderBy("ts").collect()] == [(1, 1), (2, 2), (3, 3), (4, 0), (5, 1), (6, None), (7, 1), (8, 2)]


SCHEMA = "id int, day date, version int, v double"


def days(*rows):
    return [(i, dt.date(2024, 3, n), version, float(v)) for i, n, version, v in rows]


@pytest.fixture
def table(spark, tmp_path):
    path = str(tmp_path / "table")
    read = lambda: sorted(tuple(r) for r in spark.read.schema(SCHEMA).parquet(f"{path}/days").select("id", "day", "version", "v").collect())
    put = lambda number, *rows: upsert_days(spark.createDataFrame(days(*rows), SCHEMA), number, path, ["id"], "day", "version")
    return path, read, put


def test_revisions_of_the_tail_are_taken_and_older_days_stay(table):
    path, read, put = table
    put(0, (1, 1, 0, 1), (2, 1, 0, 2), (1, 20, 0, 3), (1, 20, 5, 4))
    assert read() == sorted(days((1, 1, 0, 1), (2, 1, 0, 2), (1, 20, 5, 4)))
    # day 1 is settled, day 2 was a hole, day 10 is in the tail, day 20 is revised by a batch that wins whatever its version
    put(1, (1, 1, 9, 99), (3, 1, 9, 99), (1, 2, 1, 5), (1, 10, 1, 6), (1, 20, 1, 7), (2, 20, 1, 8))
    want = sorted(days((1, 1, 0, 1), (2, 1, 0, 2), (1, 2, 1, 5), (1, 10, 1, 6), (1, 20, 1, 7), (2, 20, 1, 8)))
    assert read() == want
    put(1, (1, 1, 9, 99), (3, 1, 9, 99), (1, 2, 1, 5), (1, 10, 1, 6), (1, 20, 1, 7), (2, 20, 1, 8))
    assert read() == want  # replayed
    put(2)
    assert read() == want


def test_a_batch_that_broke_off_goes_on_by_the_edge_it_began_with(spark, table):
    path, read, put = table
    put(0, (1, 1, 0, 1), (1, 10, 0, 2))
    # the run wrote its mark and its newest day, and died: the edge has moved, but day 1 was in the tail when it began
    spark.createDataFrame([(dt.date(2024, 3, 10),)], "edge date").write.parquet(f"{path}/edges/batch=1")
    spark.createDataFrame(days((1, 30, 1, 9)), SCHEMA).write.mode("append").partitionBy("day").parquet(f"{path}/days")
    put(1, (1, 1, 1, 7), (1, 30, 1, 9))
    assert read() == sorted(days((1, 1, 1, 7), (1, 10, 0, 2), (1, 30, 1, 9)))
    assert files.children(spark, f"{path}/edges") == ["batch=0", "batch=1"]
