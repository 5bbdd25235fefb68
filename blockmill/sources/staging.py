"""Results written to the folder that driver and executors share, so that a lost executor costs no recomputation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.errors import Invalid

SMALL_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; one of our own only where that is unset and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise Invalid(f"spark.checkpoint.dir is unset: on {master} it must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="blockmill-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def place(spark: SparkSession, path: str) -> tuple:
    """The Hadoop file system of a path, and the path in its terms."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends, if remove() has not done so before."""
    path = f"{shared_dir(spark)}/blockmill-{tag}-{uuid.uuid4().hex}"
    system, at = place(spark, path)
    system.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, at = place(spark, path)
    system.delete(at, True)


def staged(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and reread."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what staged() wrote for these frames; nothing may read them any more."""
    for df in frames:
        remove(df.sparkSession, df.staged_at)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A staged frame of slim rows, to be broadcast if it is counted to have so many rows at most; else it is joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df has not."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
