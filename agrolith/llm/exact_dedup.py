"""Exact deduplication as a stateful stream over digests, with a check of full bytes on hits.

1. The rows' digests, lengths, ids and content locators (file and row) are staged in the shared folder.
2. A stream reads the staged rows and keeps, in RocksDB state without expiry and keyed by
   (digest, length), the largest id with its locator, the locator of the first row and a count. Rows are combined before the
   shuffle, so that a key with a third of all rows arrives as one row a task. Each
   micro-batch appends the changed keys, by batch id, to a change log; a batch that is run
   again replaces its part.
3. Keys counted more than once are hits. The texts of the new rows that hit are read, and
   through the locators in the state those of the keeper and of the first row, if earlier runs staged
   them. Where all are the same bytes, the state's id and count are the answer. Where two
   texts share a digest, now or in an earlier run, all rows of that digest are read through
   their locators and told apart.

Staged rows, the stream's checkpoint and the change log stay in ``state_dir`` when one is
given, so that a later run takes up only the rows added since, and its copies of earlier rows are found.
"""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agrolith.llm.shared import BROADCAST_ROWS, discard, documents, free_name, keep_ids, scratch, sized, stored

#: Disk-backed state; change logs instead of whole snapshots, and no disk set aside for small stores. All stores of an executor share one
#: bounded memory, however many partitions it holds.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
}
#: Staged rows are small; a micro-batch takes up to this many bytes of them.
BATCH_BYTES = 256 << 20
STAGED = "doc_id long, digest string, length long, locator string, run long"


def sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def located(docs: DataFrame, state_dir: str, name: str = "locator") -> DataFrame:
    """``docs`` with a column of that name, the file and row of each; what isn't read from Parquet files is first written beside the state."""
    path = F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias(name)
    if "_metadata" not in docs.columns and docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            found = docs.select("*", path)
            found.schema  # resolves _metadata
            return found
        except AnalysisException:  # files of another format
            pass
    content = f"{state_dir}/content/{uuid.uuid4().hex}"
    docs.write.parquet(content)
    return docs.sparkSession.read.schema(docs.schema).parquet(content).select("*", path)


def fetched(spark: SparkSession, wanted: DataFrame) -> DataFrame:
    """Rows (doc_id, text, locator) of the contents at the locators of ``wanted``, a stored table; only their files are read."""
    files = [r[0] for r in wanted.select(F.regexp_extract("locator", "^(.*)#", 1)).distinct().collect()]
    if not files:
        return spark.createDataFrame([], "doc_id long, text string, locator string")
    rows = spark.read.parquet(*files).select("doc_id", "text", F.concat_ws("#", "_metadata.file_path", "_metadata.row_index").alias("locator"))
    return rows.join(sized(wanted.select(F.col("locator").alias("at"))), F.col("locator") == F.col("at"), "left_semi")


def ledger(spark: SparkSession, staged: str, schema: str, state_dir: str) -> DataFrame:
    """Drain the rows of the folders ``staged`` (a pattern) that it hasn't seen yet through the stream; rows (digest, length, doc_id, locator, first, n) of all keys."""
    rows = spark.readStream.schema(schema).option("maxBytesPerTrigger", BATCH_BYTES).parquet(staged)
    keyed = rows.groupBy("digest", "length").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.min(F.struct("run", "locator")).alias("first"), F.count(F.lit(1)).alias("n"))

    def log(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{state_dir}/changes/batch={batch}")

    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        keyed.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{state_dir}/checkpoint").foreachBatch(log).start().awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    kept = "digest string, length long, keeper struct<doc_id: bigint, locator: string>, first struct<run: bigint, locator: string>, n long, batch int"
    changes = spark.read.schema(kept).option("basePath", f"{state_dir}/changes").parquet(f"{state_dir}/changes")
    last = changes.groupBy("digest", "length").agg(F.max("keeper").alias("keeper"), F.min("first").alias("first"), F.max("n").alias("n"))
    return last.select("digest", "length", "keeper.doc_id", "keeper.locator", "first", "n")


def classes(docs: DataFrame, state_dir: str | None = None, digest=sha256) -> DataFrame:
    """Rows (doc_id, digest, keep_id, group_size, locator, row), one for each row of ``docs``.

    Texts are equal when their bytes are, null counting as the empty text. keep_id is the
    largest doc_id of the equal texts, of this run's rows and of earlier ones with the same
    state_dir, group_size their number, locator where that row's content is, which must
    stay there as long as the state is used, and row where the row's own is. Rows that repeat a doc_id count
    each, and of these the greatest locator is the one to keep; a null doc_id is less than all others. An empty table
    gives no rows. Other columns are ignored. digest: the function of the text column that
    makes the key; it may collide, at the cost of reading the texts of what collides once
    more. A run that fails after staging counts its rows when the next one reads them.
    """
    state_dir = state_dir or scratch(docs.sparkSession, "dedup-state")
    return _classes(located(docs.select("doc_id", "text") if "locator" in docs.columns else docs, state_dir).select("doc_id", "text", "locator"), state_dir, digest)


def _classes(placed: DataFrame, state_dir: str, digest=sha256) -> DataFrame:
    spark = placed.sparkSession
    texts = placed.withColumn("digest", digest(F.col("text")))
    bytes_ = F.coalesce("text", F.lit(""))
    run = time.time_ns()
    rows = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "digest", F.octet_length(bytes_).cast("long").alias("length"), "locator", F.lit(run).alias("run"))
    rows.write.parquet(f"{state_dir}/staged/{run}")
    staged = spark.read.schema(STAGED).parquet(f"{state_dir}/staged/{run}")
    own = F.col("locator").alias("row")
    if staged.isEmpty():
        return staged.select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "locator", own)
    known = stored(ledger(spark, f"{state_dir}/staged/*", STAGED, state_dir).where("n > 1"), "dedup-known")
    hits = stored(known.join(staged.select("digest", "length").distinct(), ["digest", "length"], "left_semi"), "dedup-hits")
    discard(known)

    # the full bytes of what hits: this run's rows, and the first rows and keepers that earlier runs staged
    keys = sized(hits.select(F.col("digest").alias("hit")).distinct())
    code = F.sha2(bytes_.cast("binary"), 512).alias("code")
    mine = texts.join(keys, F.col("digest") == F.col("hit"), "left_semi")
    found = mine.groupBy("digest", bytes_.alias("text")).agg(F.count(F.lit(1)).alias("n")).select("digest", code)
    old = hits.where(F.col("first.run") < run)
    far = stored(old.select("digest", F.explode(F.array("locator", "first.locator")).alias("locator")).distinct(), "dedup-far")
    if not far.isEmpty():
        found = found.union(fetched(spark, far).join(far, "locator").select("digest", code))
    apart = found.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("digest")
    # digests of several texts stay known to later runs
    apart.write.parquet(f"{state_dir}/split/{run}")
    split = spark.read.schema("digest string").parquet(f"{state_dir}/split/*").distinct().join(hits.select("digest").distinct(), "digest", "left_semi")
    split = stored(split, "dedup-split")

    single = hits.select("digest", "length", F.col("doc_id").alias("keep_id"), F.col("n").alias("size"), F.col("locator").alias("at"))
    rows = staged.join(sized(single, BROADCAST_ROWS // 2), ["digest", "length"], "left")
    one = F.col("size").isNull()
    whole = rows.select("doc_id", "digest", F.when(one, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.when(one, F.lit(1)).otherwise(F.col("size")).cast("long").alias("group_size"), F.when(one, F.col("locator")).otherwise(F.col("at")).alias("locator"), own)
    if split.isEmpty():
        return whole
    # digests of several texts: all their rows, of all runs, by their bytes
    every = stored(spark.read.schema(STAGED).parquet(f"{state_dir}/staged/*").join(split, "digest", "left_semi"), "dedup-several")
    coded = stored(fetched(spark, every).select("locator", code).join(every, "locator").select("doc_id", "digest", "locator", "code"), "dedup-coded")
    by_code = coded.groupBy("digest", "code").agg(F.max(F.struct("doc_id", "locator")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
    apart = staged.select("locator").join(coded.dropDuplicates(["locator"]), "locator").join(by_code, ["digest", "code"])
    return whole.join(split, "digest", "left_anti").unionByName(apart.select("doc_id", "digest", F.col("keeper.doc_id").alias("keep_id"), "group_size", F.col("keeper.locator").alias("locator"), own))


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text another row with a larger doc_id has."""
    found = stored(classes(docs).where("doc_id <> keep_id").select("doc_id"), "dedup-dropped")
    return keep_ids(docs, found)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each text: that with the largest doc_id, however ids repeat or are null."""
    state_dir, at = scratch(docs.sparkSession, "dedup-state"), free_name(docs, "locator")
    placed = located(docs, state_dir, at)
    found = _classes(placed.select("doc_id", "text", F.col(at).alias("locator")), state_dir)
    dropped = stored(found.where(F.col("row") != F.col("locator")).select(F.col("row").alias(free_name(placed, "dropped"))), "dedup-dropped")
    return placed.join(sized(dropped, 100_000), placed[at] == dropped[dropped.columns[0]], "left_anti").drop(at)


def op2(spark, sf_dir: str) -> DataFrame:
    """kept is true for just one row of each class, of rows with the keeper's id the one whose content the state points to."""
    rows = classes(documents(spark, sf_dir))
    return rows.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("locator")).alias("kept"), F.col("digest").alias("text_sha256"))


ORACLE = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
