"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Unigrams and bigrams are hashed to BUCKETS. Two bag models with add-one smoothing are
counted, of the target documents and of all. The sum over a text's n-grams of
log(target / raw) is its log importance weight. That over the temperature, plus Gumbel noise by hash of
(seed, doc_id), is its key, and the documents with the k largest keys are a sample without
replacement in proportion to the weights (at temperature 1; a higher one evens them out). The k-th key is
found by histograms that narrow down on it, and among rows that share it by those of their
ids; nothing is sorted but the rows of one narrow bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agrolith.llm.kernels import grams, text_bytes, word_hashes
from agrolith.llm.shared import documents, free_name, sized, stored

BUCKETS = 1 << 15
SHARE = 0.85
TEMPERATURE = 1.0
SEED = 11
BINS = 1024
#: Rows that may be sorted by one task.
FEW = 20_000
#: Log weight of texts without words: they come last.
NO_WORDS = -1e12


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's unigrams and bigrams, and where each text's buckets begin."""
    h, at = word_hashes(column)
    pairs = grams(h, 2)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = doc[1:] == doc[:-1]
    one = (h % np.uint64(BUCKETS)).astype(np.int64)
    two = (pairs[inside] % np.uint64(BUCKETS)).astype(np.int64)
    owner = np.concatenate([doc, doc[1:][inside]])
    order = np.argsort(owner, kind="stable")
    return np.concatenate([one, two])[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at) - 1))])


def _runs(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    _, at = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def log_ratio(rows: DataFrame) -> np.ndarray:
    """Of rows (text, is_target): log(target / raw) of each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            goal = np.asarray(batch.column("is_target").to_numpy(zero_copy_only=False), bool)
            for lo, hi in _runs(batch.column("text")):
                f, at = features(batch.column("text").slice(lo, hi - lo))
                total[0] += np.bincount(f, minlength=BUCKETS)
                total[1] += np.bincount(f[np.repeat(goal[lo:hi], np.diff(at))], minlength=BUCKETS)
        some = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], ["bucket", "raw", "target"])

    sums = rows.mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # BUCKETS rows at most
    n = np.ones((2, BUCKETS))
    for r in sums:
        n[:, r["bucket"]] += (r["raw"], r["target"])
    p = np.log(n / n.sum(axis=1, keepdims=True))
    return p[1] - p[0]


def weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """Rows (doc_id, log_weight)."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    @F.arrow_udf("double")
    def weigh(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            out = np.full(len(column), NO_WORDS)
            for lo, hi in _runs(column):
                f, at = features(column.slice(lo, hi - lo))
                some = np.flatnonzero(np.diff(at))
                if len(some):
                    out[lo + some] = np.add.reduceat(shared.value[f], at[:-1][some])
            yield pa.array(out)

    return docs.select("doc_id", weigh(F.coalesce("text", F.lit(""))).alias("log_weight"))


def largest(rows: DataFrame, k: int, key: str = "key", tie: str = "doc_id") -> DataFrame:
    """The k rows of a stored table with the largest keys, without a global sort.

    Of equal keys those with the least ``tie``, a number, come first, null ones before them.
    Rows that are equal in both are alike.
    """
    by = free_name(rows, "by")
    out, inside, rest = _narrowed(rows.withColumn(by, F.col(key)), by, k)
    if rest and not inside.limit(FEW + 1).count() <= FEW:  # all of them share one key
        above, inside, rest = _narrowed(inside.withColumn(by, F.coalesce(-F.col(tie).cast("double"), F.lit(2.0**64))), by, rest)
        out = out.unionByName(above)
    if rest:
        out = out.unionByName(inside.orderBy(F.desc(key), F.col(tie).asc_nulls_first()).limit(rest))
    return out.drop(by)


def _narrowed(rows: DataFrame, column: str, k: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows that are sure to be among the k with the largest ``column``, those that may be, and how many of these are."""
    lo, hi, above = float("-inf"), float("inf"), 0
    by = F.col(column)
    while True:
        inside = rows.where((by >= lo) & (by <= hi))
        low, high, n = inside.agg(F.min(by), F.max(by), F.count(F.lit(1))).first()
        if n <= FEW or low == high:
            return rows.where(by > hi), inside, max(0, k - above)
        width = (high - low) / BINS
        bins = inside.groupBy(F.least(F.lit(BINS - 1), F.floor((by - low) / width)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).orderBy(F.desc("bin")).collect()
        for b in bins:
            if above + b["n"] >= k:
                break
            above += b["n"]
        lo, hi = b["lo"], b["hi"]


def resample(docs: DataFrame, targets: DataFrame, share: float = SHARE, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, log_weight, key) of the sampled documents: ``share`` of all rows, rounded.

    targets: rows with the doc_id of documents to take as the target; repeated and null ids
    and ids of no document do nothing. Null and empty texts weigh least. Repeated rows count
    each; a null doc_id is hashed like any. Without targets all weights are alike up to
    noise; an empty table gives no rows. Other columns are ignored.
    """
    wanted = stored(targets.where("doc_id is not null").select(F.col("doc_id").alias("goal")).distinct(), "quality-targets")
    rows = docs.select("doc_id", "text")
    marked = rows.join(sized(wanted), F.col("doc_id") == F.col("goal"), "left").select(F.coalesce("text", F.lit("")).alias("text"), F.col("goal").isNotNull().alias("is_target"))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11) + F.lit(0.5)) / F.lit(2.0**53)
    noise = -F.log(-F.log(u))
    keyed = stored(weights(rows, log_ratio(marked)).withColumn("key", F.col("log_weight") / temperature + noise), "quality-keys")
    return largest(keyed, round(share * keyed.count()))


def op9(spark, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return resample(documents(spark, sf_dir), good).withColumn("kept", F.lit(True))
