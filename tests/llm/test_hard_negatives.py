"""Hard negatives against brute force, with buckets of a few rows so that bounds and rounds matter."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from agrolith.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, x int, part int, norm string, windows int"


def brute(table, anchors, positives, negatives, window, scale):
    rows = []
    for n, (i, v, label) in enumerate(table):
        if label is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        rows.append((n, i, label, [math.floor(c * scale) for c in v]))
    order = lambda r: (-r[0], math.inf if r[1] is None else r[1])
    out = []
    for n, i, label, v in rows:
        if i is None or not anchors(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, own) for m, j, own, w in rows if m != n and len(w) == len(v)]
        for p, pos, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fit = [s for s in scored if s[2] != label and window[0] * p <= 100 * s[0] <= window[1] * p]
            out += [(i, pos, r + 1, s[1], p, s[0]) for r, s in enumerate(sorted(fit, key=order)[:negatives])]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def vectors(seed):
    rng = random.Random(seed)
    table = []
    for i in range(160):
        length = 3 if i % 11 else 2
        v = [rng.choice([-2, -1, 0, 1, 2, 3]) * rng.choice([1, 1, 4]) + rng.choice([0.0, 0.3]) for _ in range(length)]
        table.append((i, [1.0, 2.0, 2.0] if i % 3 == 0 else v, rng.choice([1, 1, 1, 2, 3])))  # one vector is a third of all
    table += [(200, None, 1), (201, [], 1), (202, [1.0, None, 2.0], 1), (203, [1.0, math.nan, 2.0], 1), (204, [1.0, math.inf, 2.0], 2), (205, [1.0, 1.0, 1.0], None), (210, [0.0, 0.0, 0.0], 1), (None, [3.0, 3.0, 3.0], 1), (None, [3.0, 3.0, 3.0], 2)]
    return table + [table[10], table[10], table[20], table[33]]


@pytest.mark.parametrize("seed,run,k", [(1, 7, (5, 5)), (2, 2048, (2, 3)), (3, 1, (1, 1))])
def test_search_finds_what_brute_force_finds(spark, monkeypatch, seed, run, k):
    for name, value in (("BUCKET_ROWS", 13), ("BLOCK_ROWS", 4), ("RUN", run), ("QUERIES", 3)):
        monkeypatch.setattr(hn, name, value)
    table = vectors(seed)
    df = spark.createDataFrame([(*r, 1, 2, "n", 3) for r in table], SCHEMA)
    rows = got(hn.mine(df, "vec_id % 10 = 0", positives=k[0], negatives=k[1], window=(50, 100), scale=2))
    assert rows == brute(table, lambda i: i % 10 == 0, *k, (50, 100), 2) and len(rows) > 15


def test_pairs_prune_by_norms_and_running_scores():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(3000, 8)) * np.linspace(30, 1, 3000)[:, None])
    norm = np.linalg.norm(x, axis=1) * (1 + 1e-12)
    c = {"x": x, "norm": norm, "label": np.arange(3000) % 3, "row": np.arange(3000), "vec_id": np.arange(3000)[::-1].copy()}
    some = np.arange(0, 3000, 40)
    low, high = np.repeat([[-np.inf, 0.0]], len(some), 0), np.repeat([[np.inf, 500.0]], len(some), 0)
    q = {f: c[f][some] for f in ("x", "norm", "label", "row")} | {"low": low, "high": high, "kth": np.full(low.shape, -np.inf)}
    found = hn.search_pair(q, c, 4, False)
    want = []
    for i in some:
        s = x @ x[i]
        for w, ok in enumerate([np.ones(3000, bool), (s >= 0) & (s <= 500)]):
            fit = np.flatnonzero(ok & (c["label"] != c["label"][i]))
            best = fit[np.lexsort((c["vec_id"][fit], -s[fit]))][:4]
            want += [(i, w, j, c["vec_id"][j], int(s[j])) for j in best]
    assert sorted(zip(*(z.tolist() for z in found))) == sorted(want)


def test_empty_and_useless_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert got(hn.mine(nothing)) == []
    assert got(hn.mine(spark.createDataFrame([(100, None, 1, 1, 1, "", 1), (None, [1.0], 1, 1, 1, "", 1)], SCHEMA))) == []
    assert got(hn.mine(spark.createDataFrame([(100, [1.0], 1, 1, 1, "", 1), (101, [1.0], 2, 1, 1, "", 1)], SCHEMA))) == []


def test_the_registered_query(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    table = [(r.vec_id, None if r.embedding is None else [float(c) for c in r.embedding], r.label) for r in df.select("vec_id", "embedding", "label").collect()]
    table = [(i, v, (label + 1) % 10 if label is not None and i % 7 == 0 else label) for i, v, label in table]
    assert got(hn.op11(spark, sf)) == brute(table, lambda i: i % 100 == 0, 5, 5, (80, 100), 256)
    assert df.where(F.col("vec_id") % 100 == 0).count() > 0
