"""Running a stream to the end of its present input, for backfills and tests."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextlib.contextmanager
def disk_state(spark: SparkSession) -> Iterator[None]:
    """State of streams that start inside is kept in RocksDB, which list state and timers need."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; where that is unset, a local folder, in a local session alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="agrolith-stream-"))
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def events(spark: SparkSession, sf_dir: str, files: int | None = None) -> DataFrame:
    """The event table as a stream; the glob lets the path be a file or a folder of files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(f"{sf_dir}/events.parque[t]")


def drain(stream: DataFrame, name: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Process all input there is and return what was written.

    append writes rows once; complete and update replace the part of their batch, so that a
    batch which is run again after a failure leaves one copy. keys: of rows with the same ones, which
    update writes each time they change, only the last counts.
    """
    spark = stream.sparkSession
    path = shared_path(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(write).start().awaitTermination()
    out = spark.read.option("basePath", f"{path}/out").schema(f"{stream._jdf.schema().toDDL()}, batch INT").parquet(f"{path}/out")
    if mode == "complete":
        last = out.agg({"batch": "max"}).first()[0]
        out = out.where(f"batch = {last}")
    if keys:
        rest = [c for c in out.columns if c not in (*keys, "batch")]
        return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("__last")).select(*keys, "__last.*")
    return out.drop("batch")
