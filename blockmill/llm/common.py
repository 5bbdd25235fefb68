"""Shared helpers of the training-data operators: tables, staged results, components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and all is one machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="blockmill-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def _place(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, deleted when the session's JVM ends, if remove() has not done so before."""
    path = f"{shared_dir(spark)}/blockmill-{tag}-{uuid.uuid4().hex}"
    system, at = _place(spark, path)
    system.deleteOnExit(at)
    return path


def remove(spark: SparkSession, path: str) -> None:
    system, at = _place(spark, path)
    system.delete(at, True)


BATCH_ROWS, BATCH_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def batches_of(spark: SparkSession, rows: int, size: int = 16 << 20) -> Iterator[None]:
    """Arrow batches of so many rows and bytes at most, which bounds what JVM and Python hold of long texts."""
    before = {k: spark.conf.get(k) for k in (BATCH_ROWS, BATCH_BYTES)}
    try:
        spark.conf.set(BATCH_ROWS, rows)
        spark.conf.set(BATCH_BYTES, size)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def staged(df: DataFrame, tag: str, batch_rows: int = 1000) -> DataFrame:
    """Writes df to the shared folder and rereads it, which cuts the lineage: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with batches_of(spark, batch_rows):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes what staged() wrote for these frames; nothing may read them any more."""
    for df in frames:
        remove(df.sparkSession, df.staged_at)


SMALL_ROWS = 1 << 20


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
    """A column's name as col() reads it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def field(struct: str, name: str) -> Column:
    """A struct column's field, whatever signs its name holds."""
    return F.col(f"{struct}.{quoted(name)}")


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, mod 5; fold 0 is held out. Null ids count as fold 1."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5, F.lit(1))


def labelled_sample(labels: DataFrame, label: str, per_class: int, seed: int) -> DataFrame:
    """A bounded sample of labelled ids outside fold 0: at most per_class ids of each class, those with the smallest seeded hashes.

    Columns: doc_id, label (0 or 1), fold. Repeated labels of an id count once, the largest wins; null ids and labels are left out.
    """
    own = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .withColumn("fold", fold(F.col("doc_id")).cast("int"))
        .where("fold <> 0")
    )
    parts = [
        own.where(F.col("label") == c).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        for c in (0, 1)
    ]
    return parts[0].unionByName(parts[1])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, which bounds what Python holds of them as objects."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file; BLOCKMILL_TOKENIZERS overrides the installed folder."""
    own = os.environ.get("BLOCKMILL_TOKENIZERS")
    if own:
        return os.path.join(own, name)
    import public_tokenizers

    return public_tokenizers.path(name)


NODES = 1 << 19  # that a task of _stars holds


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a task's edges connect, as an edge from each node to the smallest that it reaches among them; again from NODES nodes on."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    def found() -> pa.RecordBatch:
        pairs = [(x, low) for x in list(root) if (low := find(x)) != x]
        return pa.record_batch([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch["src"].to_pylist(), batch["dst"].to_pylist(), strict=True):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        if len(root) >= NODES:
            yield found()
            root.clear()
    yield found()


def components(edges: DataFrame, tag: str, max_rounds: int = 40) -> DataFrame:
    """Connected components by alternating large-star and small-star rounds, over what each task's edges connect by themselves: however many
    edges a group has, there are at most as many as a task has nodes of it.

    edges: src long, dst long (undirected). Returns (node, component) for every node with an edge to another node; component is its
    smallest reachable node. Each round is two joins and two partial aggregates, staged to the shared folder; nothing reaches the driver
    but one count. A hub's rows meet in a join that adaptive execution can split.
    """
    now = staged(
        edges.where("src <> dst").select("src", "dst").mapInArrow(_stars, "u long, v long").distinct(),
        f"{tag}-edges",
    )
    for k in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        after = staged(small, f"{tag}-star{k}")
        release(now)
        now = after
        # a star forest: every node points at one root, and no root points on
        roots = now.select(F.col("v").alias("u")).distinct()
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(roots, "u", "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
