"""Helpers that several operators share: scratch tables, size-checked joins, components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The column that ``with_rows`` adds.
ROW = "__agrolith_row"
#: Rows of (key, few numbers) that may be broadcast: at most about 30 MB in an executor.
BROADCAST_ROWS = 400_000
_own_folder: dict[str, str] = {}


def small_batches(spark: SparkSession, rows: int = 500, size: int = 8 << 20) -> None:
    """Send Python at most ``rows`` rows and about ``size`` bytes at a time, as a row may hold a long text; smaller settings stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, most)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all executors share.

    That folder is ``spark.checkpoint.dir``. Where it is unset, a temporary folder of this
    machine takes its place in a local session; a cluster's executors would not share one.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folder:
            _own_folder[app] = tempfile.mkdtemp(prefix="agrolith-")
        base = _own_folder[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it again, which cuts its lineage; options are the Parquet writer's."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_scratch_path", None):
            jvm = t.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def sized(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``most`` rows, else as it is.

    ``df`` should be a stored table of keys and numbers, so that counting is cheap. Beyond
    the bound Spark joins by sorted shuffles, whose skewed keys it splits at run time.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def keep_ids(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` without the ids of ``dropped``, a stored table with the column ``key``."""
    name = free_name(docs, "gone")
    return docs.join(sized(dropped.select(F.col(key).alias(name))), docs[key] == F.col(name), "left_anti")


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ROW that numbers its rows, the same each time it is read.

    A plain read of Parquet files has the file's place and the row's place in it as number;
    anything else is written to the shared folder with its numbers once.
    """
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in docs.columns:
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("__agrolith_path"), F.col("_metadata.row_index").alias("__agrolith_index"))
            paths = sorted(r[0] for r in placed.select("__agrolith_path").distinct().collect())
        except AnalysisException:  # files of another format
            pass
        else:
            files = docs.sparkSession.createDataFrame([(i << 40, p) for i, p in enumerate(paths)], "__agrolith_file long, __agrolith_path string")
            return placed.join(F.broadcast(files), "__agrolith_path").select(*docs.columns, (F.col("__agrolith_file") + F.col("__agrolith_index")).alias(ROW))
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def one_of_each(keyed: DataFrame, groups: DataFrame, largest: bool) -> DataFrame:
    """``keyed``, made by ``with_rows``, with just one row of each group, and without ROW.

    groups: a stored table (ROW, label) of rows in groups of two or more. The row with the
    largest or smallest doc_id stays, one with a null doc_id only if no other has any; ties
    go by ROW the same way.
    """
    members = stored(keyed.select(ROW, "doc_id").join(sized(groups), ROW), "rows-grouped")
    best = F.max(F.struct("doc_id", ROW)) if largest else F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    kept = stored(members.groupBy("label").agg(best.alias("best")).select(F.col(f"best.{ROW}").alias(ROW)), "rows-kept")
    dropped = stored(members.join(sized(kept), ROW, "left_anti").select(ROW), "rows-dropped")
    return keep_ids(keyed, dropped, ROW).drop(ROW)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of undirected edges (a, b): rows (node, component).

    component is the least node that can be reached. Nodes without edges aren't listed.
    Alternates large-star and small-star steps over the edge table until each edge leads
    to the least node of its component. Each step is one partial aggregate and one join,
    so that a hot node is combined before the shuffle and split after it; the edges of a
    step are written to the shared folder and nothing but two counts reaches the driver.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    signature = _signature(now)
    while signature[0]:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("k")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("k")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m"))
        small = large.join(least, F.col("a") == F.col("k")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = stored(small, name)
        discard(now)
        now, before, signature = after, signature, _signature(after)
        if signature == before:
            break
    roots = now.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
    return stored(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots), name)


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def crc32_mod(column: str, m: int) -> Column:
    return F.crc32(F.col(column).cast("string")) % m
