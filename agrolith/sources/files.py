"""Files of any store that Spark reads: stamps of inputs, publishing by rename, tables that are built anew when an input changes."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def store_of(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = store_of(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it isn't there."""
    fs, where = store_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, where = store_of(spark, path)
    fs.delete(where, True)


def publish(spark: SparkSession, staged: str, path: str) -> bool:
    """Give a finished folder its name, by one rename; False, and the staged folder goes, if the name is taken."""
    fs, to = store_of(spark, path)
    fs.mkdirs(to.getParent())
    done = not fs.exists(to) and fs.rename(spark._jvm.org.apache.hadoop.fs.Path(staged), to)
    if not done:
        remove(spark, staged)
    return done


def stamp(spark: SparkSession, paths: list[str], *more: str) -> str:
    """A fingerprint of files (or all files below folders): their paths, lengths and times of change, and ``more``.
    A path that isn't there counts as absent. The list of files is the driver's, as it is when Spark plans to read them."""
    seen = []
    for p in paths:
        fs, where = store_of(spark, p)
        found = fs.globStatus(where)
        for top in found or []:
            each = fs.listFiles(top.getPath(), True)
            while each.hasNext():
                f = each.next()
                seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        if not found:
            seen.append(f"{p} absent")
    return hashlib.md5("\n".join([*sorted(seen), *more]).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, inputs: list[str], build: Callable[[], DataFrame], *more: str) -> DataFrame:
    """What ``build`` returns, read from ``folder`` if it was built from the inputs as they are now, else built and kept there.

    The table's name is the fingerprint of the inputs' files and of ``more`` (say, parameters); it
    appears there whole, by a rename, so that a run that breaks off leaves nothing behind that looks like a table. Tables of
    other fingerprints are removed after the new one is there.
    """
    name = f"built-{stamp(spark, inputs, *more)}"
    path = f"{folder.rstrip('/')}/{name}"
    if not exists(spark, path):
        staged = f"{folder.rstrip('/')}/_staged-{uuid.uuid4().hex}"
        build().write.parquet(staged)
        publish(spark, staged, path)
        for old in children(spark, folder):
            if old.startswith("built-") and old != name:
                remove(spark, f"{folder}/{old}")
    return spark.read.parquet(path)


def file_stage(spark: SparkSession, wanted: dict[str, tuple[str, str]]) -> DataFrame:
    """Of the tables that a display reads, name to (path, format): files, bytes, rows and a status: missing, unreadable, empty or ok.

    A table is counted by Spark; the list is that of a display's files, some dozens.
    """
    rows = []
    for name, (path, fmt) in wanted.items():
        fs, where = store_of(spark, path)
        found = fs.globStatus(where)
        if not found:
            rows.append((name, 0, 0, None, "missing"))
            continue
        size, n = 0, 0
        for top in found:
            each = fs.listFiles(top.getPath(), True)
            while each.hasNext():
                f = each.next()
                if not f.getPath().getName().startswith(("_", ".")):
                    size, n = size + f.getLen(), n + 1
        try:
            count = spark.read.format(fmt).load(path).count()
        except Exception:  # whatever the format's reader says of what it can't read
            rows.append((name, n, size, None, "unreadable"))
            continue
        rows.append((name, n, size, count, "ok" if count else "empty"))
    return spark.createDataFrame(rows, "name string, files int, bytes long, rows long, status string")
