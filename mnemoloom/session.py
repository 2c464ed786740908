"""Session helpers: where intermediate tables go, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch of whole texts, about.
TEXT_BATCH = 2 << 20
#: Folders of ``stage`` that have not been dropped.
STAGED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the master is local (tests, a laptop) and none is named is a local folder made and set; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not (spark.sparkContext.master or "").startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="mnemoloom-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, size: int | None) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for what runs inside; the session's own setting comes back after it. None leaves it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    if size:
        spark.conf.set(key, str(size))
    try:
        yield
    finally:
        if size:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stage(df: DataFrame, label: str, batch: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors. ``batch``: bytes of the Arrow batches meanwhile."""
    path = new_folder(df.sparkSession, label)
    STAGED.append(path)
    with batches_of(df.sparkSession, batch):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library has written, through Hadoop's file system of that path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rename_folder(spark: SparkSession, path: str, to: str) -> None:
    """Rename a folder through Hadoop's file system; atomic where that is (on object stores it copies)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).rename(p, jvm.org.apache.hadoop.fs.Path(to)):
        raise OSError(f"could not rename {path} to {to}")


def drop_staged(spark: SparkSession) -> None:
    """Delete what ``stage`` has written so far in this session. For when the results that rest on it have been written; nothing else calls it."""
    while STAGED:
        with suppress(Exception):  # one folder that is gone already must not keep the others
            drop_folder(spark, STAGED.pop())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, through Hadoop's file system of that path; none if there is no such folder."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, for small tables inside loops."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
