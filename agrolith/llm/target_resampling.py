"""Resampling towards a target distribution, over a dictionary of the distinct features.

Features are the runs of LOW to HIGH consecutive words of a text. Tasks count the features of
each document; those counts are written once. From them the dictionary is made: one row for
each distinct feature string, with its occurrences in the raw and in the target texts. Only
there is a feature hashed, so once for each distinct string; buckets add up their features,
and a bucket's gain is the log ratio of the two smoothed bucket models. The gains then go back
along the dictionary to the counts of each document, whose sum is its log importance weight.

Features that very many documents have would make that join hot: the HEAD most widespread
short ones are broadcast, a number of rows of bounded length, and their counts are
summed where they lie. All others meet the dictionary by a shuffle on the feature. The documents
with the largest sums of weight and seeded Gumbel noise are a sample without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agrolith.llm.kernels import LOWER, give_back, text_bytes
from agrolith.llm.quality import largest
from agrolith.llm.shared import ROW, discard, documents, sized, stored, with_rows

LOW, HIGH = 1, 1
BUCKETS = 10_000
PERCENT = 10
MIN_WORDS = 20
SEED = 2024
#: Features that are broadcast: at most so many, of so many bytes at most.
HEAD, HEAD_BYTES = 100_000, 64
#: Words that a task takes at a time.
AT_ONCE = 1 << 18
_IN_WORD = np.zeros(256, bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def features(column: pa.Array, low: int, high: int) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray]]:
    """Of all texts: (text number, feature, times), some words at a time; a pair may come more than once.

    A word is a run of ASCII letters and digits and of all that isn't ASCII, with A-Z in lower
    case. The feature null stands for any word.
    """
    raw, at = text_bytes(column)
    raw = LOWER[raw]
    word = _IN_WORD[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1] | first[1:-1]
    ends[:-1] &= ~word[1:] | first[1:-1]
    i, j = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    text = np.searchsorted(at, i, "right") - 1
    for lo in range(0, len(i), AT_ONCE):
        hi = min(len(i), lo + AT_ONCE)
        some, times = np.unique(text[lo:hi], return_counts=True)
        yield some, pa.nulls(len(some), pa.large_string()), times
        e = min(len(i), hi + high - 1)
        size = j[lo:e] - i[lo:e] + 1
        spaced = np.concatenate([[0], np.cumsum(size)])  # where words begin if each is followed by a space
        flat = np.full(int(spaced[-1]), 0x20, np.uint8)
        inside = np.ones(len(flat), bool)
        inside[spaced[1:] - 1] = False
        flat[inside] = raw[i[lo] : j[e - 1]][word[i[lo] : j[e - 1]]]
        for n in range(low, high + 1):
            k = np.arange(min(hi, len(i) - n + 1) - lo) if len(i) - n + 1 > lo else np.zeros(0, np.int64)
            k = k[text[lo + k] == text[lo + k + n - 1]]
            if not len(k):
                continue
            start, length = spaced[k], spaced[k + n] - 1 - spaced[k]
            to = np.concatenate([[0], np.cumsum(length)])
            gathered = flat[inside] if n == 1 else flat[np.arange(to[-1]) + np.repeat(start - to[:-1], length)]
            strings = pa.LargeStringArray.from_buffers(len(k), pa.py_buffer(to.astype(np.int64)), pa.py_buffer(gathered[: to[-1]].tobytes()))
            coded = strings.dictionary_encode()
            pairs, times = np.unique(text[lo + k] * len(coded.dictionary) + coded.indices.to_numpy().astype(np.int64), return_counts=True)
            yield pairs // len(coded.dictionary), coded.dictionary.take(pa.array(pairs % len(coded.dictionary))), times


def counts(docs: DataFrame, low: int = LOW, high: int = HIGH, key: str = ROW) -> DataFrame:
    """Rows (key, feature, times); a document may have several rows for one feature, whose times add up. Those of the feature null count its words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for text, feature, times in features(batch.column(1), low, high):
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text)), feature.cast(pa.string()), pa.array(times)], [key, "feature", "times"])
        give_back()

    return docs.select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, f"`{key}` long, feature string, times long")


def dictionary(raw: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """One row for each distinct feature of the two tables of counts: feature, spread (raw documents that have it), raw, target, bucket."""
    zero = F.lit(0).cast("long")
    both = raw.select("feature", F.lit(1).cast("long").alias("spread"), F.col("times").alias("raw"), zero.alias("target"))
    both = both.union(target.select("feature", zero, zero, F.col("times")))
    return both.where("feature is not null").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("spread", "raw", "target")]).withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def gains(words: DataFrame, buckets: int) -> DataFrame:
    """Rows (bucket, gain) of the buckets that occur, as many as ``buckets`` at most."""
    sums = words.groupBy("bucket").agg(F.sum("raw").cast("double").alias("s"), F.sum("target").cast("double").alias("t"))
    total = sums.agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("all_t"))
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return sums.crossJoin(F.broadcast(total)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _head(words: DataFrame) -> DataFrame:
    """Of the stored dictionary: the most widespread short features, HEAD at most, as (feature, gain)."""
    short = words.where(F.octet_length("feature") <= HEAD_BYTES).withColumn("class", F.floor(F.log2("spread")))
    least, n = 64, 0
    for r in short.where("spread > 1").groupBy("class").count().orderBy(F.desc("class")).collect():  # a row for each power of two
        n += r["count"]
        if n > HEAD:
            break
        least = r["class"]
    return short.where(F.col("class") >= least).select("feature", "gain")


def weighed(docs: DataFrame, targets: DataFrame, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS) -> DataFrame:
    """A stored table (ROW, words, weight) of the documents that have a word; docs: ROW and text, targets: text."""
    own = stored(counts(docs, low, high), "resampling-counts")
    goal = counts(targets.select(F.lit(0).cast("long").alias(ROW), "text"), low, high)
    words = stored(dictionary(own, goal, buckets), "resampling-dictionary")
    gained = stored(words.join(F.broadcast(gains(words, buckets)), "bucket").where("spread > 0").select("feature", "spread", "gain"), "resampling-gains")
    head = _head(gained).withColumnRenamed("feature", "common")
    met = own.join(F.broadcast(head), F.col("feature") == F.col("common"), "left")
    value, words_of = F.sum(F.col("times") * F.col("gain")).alias("weight"), F.sum(F.when(F.col("feature").isNull(), F.col("times"))).alias("words")
    sure = met.where("common is not null or feature is null").groupBy(ROW).agg(value, words_of)
    rest = met.where("common is null").select(ROW, "feature", "times").join(gained.select("feature", "gain"), "feature").groupBy(ROW).agg(value, F.lit(0).cast("long").alias("words"))
    out = stored(sure.union(rest).groupBy(ROW).agg(F.sum("words").alias("words"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weight")), "resampling-weights")
    discard(own, words, gained)
    return out


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise by the hash of seed and id, a whole number."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with their ``rank`` from 1 on, by ranges of the order that tasks number apart."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = stored(dealt.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base")), "resampling-bases")  # a row a task
    numbered = dealt.withColumn("own", F.row_number().over(Window.partitionBy("part").orderBy(*order)))
    return numbered.join(sized(base, 100_000), "part").withColumn("rank", (F.col("own") + F.col("base")).cast("long")).drop("part", "own", "base")


def scored(keyed: DataFrame, targets: DataFrame, *, low: int = LOW, high: int = HIGH, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED) -> DataFrame:
    """Rows (ROW, doc_id, n_features, weight, score, rank) of ``keyed``, made by ``with_rows``; see ``resample``."""
    held = sum((F.greatest(F.lit(0).cast("long"), F.col("words") - (k - 1)) for k in range(low, high + 1)), F.lit(0).cast("long"))
    weights = weighed(keyed.select(ROW, "text"), targets, low, high, buckets)
    base = keyed.select(ROW, "doc_id").join(weights, ROW, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("words", "weight")})
    base = stored(base.withColumn("n_features", held).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "resampling-scores")
    able = base.where(F.col("words") >= min_words)
    drawn = largest(able.select(ROW, "doc_id", "score"), able.count() * percent // 100, key="score")
    order = (F.desc("score"), F.col("doc_id").asc_nulls_first(), F.col(ROW).asc())
    ranks = stored(ranked(drawn, *order).select(F.col(ROW).alias("drawn_row"), "rank"), "resampling-ranks")
    discard(weights)
    return base.join(sized(ranks), F.col(ROW) == F.col("drawn_row"), "left").select(ROW, "doc_id", "n_features", "weight", "score", "rank")


def resample(docs: DataFrame, targets: DataFrame, **settings) -> DataFrame:
    """Rows (doc_id, n_features, weight, score, rank), one for each row of ``docs``; rank is null if it isn't drawn.

    docs: doc_id and text; targets: text. Settings: low and high, the runs of words; buckets;
    percent of the documents with ``min_words`` words or more that are drawn, rounded down; seed.
    Null and empty texts, and texts without words, have no feature and weight 0. A null doc_id
    takes the noise of the empty id and goes first in ties. Repeated rows count each, with the same score.
    Without targets the target model is even; an empty table gives no rows. Other columns are
    ignored, whatever their names.
    """
    return scored(with_rows(docs).select(ROW, "doc_id", "text"), targets, **settings).drop(ROW)


def sample(docs: DataFrame, targets: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, as they are."""
    keyed = with_rows(docs)
    drawn = stored(scored(keyed, targets, **settings).where("rank is not null").select(F.col(ROW).alias("__agrolith_drawn")), "resampling-drawn")
    return keyed.join(sized(drawn), F.col(ROW) == F.col("__agrolith_drawn"), "left_semi").drop(ROW)


def op13(spark, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _sql() -> str:
    table = "range(256)"
    for _ in range(8):
        table = f"list_transform({table}, lambda x: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
WITH RECURSIVE crcs AS (SELECT {table} AS crcs),
docs AS (SELECT doc_id, {words} AS words FROM documents),
raw AS (SELECT doc_id, unnest(words) AS f FROM docs),
goal AS (SELECT unnest({words}) AS f FROM benchmark),
tallied AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, 1 AS s, 0 AS t FROM raw UNION ALL SELECT f, 0, 1 FROM goal) GROUP BY f),
bytes AS (SELECT f, s, t, CAST(4294967295 AS BIGINT) AS c, hex(encode(f)) AS h, 0 AS i FROM tallied),
crc AS (SELECT * FROM bytes UNION ALL
  SELECT f, s, t, xor(c >> 8, crcs[CAST(xor(c & 255, CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)) AS BIGINT) + 1]), h, i + 1 FROM crc, crcs WHERE i < length(h) // 2),
hashed AS (SELECT f, s, t, xor(c, 4294967295) % {BUCKETS} AS bucket FROM crc WHERE i = length(h) // 2),
sums AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM hashed GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM sums) + {BUCKETS})))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM raw JOIN hashed USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scores AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5e0) / 4294967296.0e0))) AS BIGINT) AS score FROM docs d LEFT JOIN weights w ON w.doc_id = d.doc_id),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scores WHERE n_features >= {MIN_WORDS})
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= (SELECT count(*) FROM ranks) * {PERCENT} // 100 THEN r END AS rank FROM scores s LEFT JOIN ranks USING (doc_id)"""


ORACLE = _sql()
