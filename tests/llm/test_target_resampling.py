"""Resampling towards a target against a brute-force version, with longer runs of words and small bounds."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from agrolith.llm import target_resampling as tr

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, targets, low=1, high=1, buckets=tr.BUCKETS, percent=tr.PERCENT, min_words=tr.MIN_WORDS, seed=tr.SEED):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    def runs(t):
        w = words(t)
        return [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, d in docs for f in runs(d)), Counter(bucket(f) for d in targets for f in runs(d))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, able = [], []
    for i, d in docs:
        f = runs(d)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(x)) for x in f)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(d)) >= min_words:
            able.append(out[-1])
    able.sort(key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    for n, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = n + 1
    return sorted(out, key=str)


def got(df):
    return sorted(([r.doc_id, r.n_features, r.weight, r.score, r.rank] for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def mixed(spark):
    texts = [
        "The Cat sat; the CAT ran! 3 times, the 4th time it slept on a mat with one more cat and then ten dogs came by at noon",
        "naïve ÉCOLE Élan 東京 は cat dog \x00zero\x7fdel [x]^_`y{z}|~ " * 4,
        None,
        "",
        " ... \n",
        "one",
        "to be or not to be that is the question whether tis nobler in the mind to suffer the slings and arrows " * 300,
        "x" * 70_000 + " y",
        "A B a b A b " * 50,
    ]
    table = [(i % 7 if i % 5 else None, texts[i % len(texts)]) for i in range(45)]
    return table, spark.createDataFrame([(*r, 1, 2, 3, "k") for r in table], "doc_id long, text string, feature long, weight long, part int, bucket string"), ["the cat ran on the mat", None, "to be", "b a b"]


@pytest.mark.parametrize("low,high,head,words", [(1, 1, 100_000, 1 << 18), (1, 3, 3, 50), (2, 2, 0, 7)])
def test_resampling_of_odd_rows(spark, monkeypatch, mixed, low, high, head, words):
    table, docs, targets = mixed
    monkeypatch.setattr(tr, "HEAD", head)
    monkeypatch.setattr(tr, "AT_ONCE", words)
    goal = spark.createDataFrame([(t, 1) for t in targets], "text string, doc_id int")
    settings = dict(low=low, high=high, buckets=61, percent=40, min_words=5, seed=9)
    assert got(tr.resample(docs, goal, **settings)) == brute(table, targets, **settings)


def test_resampling_draws_whole_documents(spark, mixed):
    table, docs, targets = mixed
    goal = spark.createDataFrame([(t,) for t in targets], "text string")
    settings = dict(percent=50, min_words=5)
    drawn = tr.sample(docs, goal, **settings)
    assert drawn.columns == docs.columns
    able = [t for _, t in table if len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")) >= 5]
    assert drawn.count() == len(able) // 2
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(r[0] for r in brute(table, targets, **settings) if r[4])


def test_resampling_without_rows_or_targets(spark, mixed, nothing):
    table, docs, _ = mixed
    none = spark.createDataFrame([], "text string")
    assert got(tr.resample(nothing, none)) == []
    assert got(tr.resample(docs, none)) == brute(table, [])


def test_resampling_of_the_test_table(spark, sf, documents):
    import pyarrow.parquet as pq

    targets = pq.read_table(f"{sf}/benchmark.parquet").column("text").to_pylist()
    assert got(tr.op13(spark, sf)) == brute(list(documents.items()), targets)
