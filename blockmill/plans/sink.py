"""Committed blocks: an epoch is written beside what readers see, counted, and published by one rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.errors import Invalid, ResourceNotFound
from blockmill.sources.staging import place, remove


def _manifest(root: str, epoch: int) -> str:
    return f"{root.rstrip('/')}/_published/epoch-{epoch:06d}.json"


def publish(blocks: DataFrame, root: str, epoch: int, options=None) -> dict:
    """Writes an epoch's blocks (batch_id, row_in_batch, tokens, and what else they have) and publishes them; returns the manifest.

    Tasks write to a folder of this attempt's own, by Spark's commit, so a task that runs twice leaves its rows once. The counts are taken
    from what was committed. The manifest names the folder and appears whole, by a rename, so readers of the epoch published before see
    nothing of this one until it is complete. An epoch that is published is not written again: Invalid. With options, a block
    that lacks rows or tokens is Invalid as well, and nothing is published.
    """
    spark = blocks.sparkSession
    if epoch in published(spark, root):
        raise Invalid(f"epoch {epoch} is published")
    folder = f"{root.rstrip('/')}/epoch-{epoch:06d}-{uuid.uuid4().hex}"
    keys = [c for c in blocks.columns if c not in ("row_in_batch", "tokens")]
    blocks.repartitionByRange(*keys).sortWithinPartitions(*keys, "row_in_batch").write.parquet(folder)
    made = spark.read.parquet(folder)
    per = made.groupBy(*keys).agg(F.count("*").alias("rows"), F.count_distinct("row_in_batch").alias("places"), F.sum(F.size("tokens")).alias("tokens"))
    counts = per.agg(F.count("*").alias("blocks"), F.sum("rows").alias("rows"), F.sum("tokens").alias("tokens"), F.sum((F.col("rows") != F.col("places")).cast("int")).alias("twice")).first()
    short = per.where((F.col("rows") != options.batch_size) | (F.col("tokens") != options.batch_size * options.seq_len)).count() if options else 0
    if counts["twice"] or short:
        remove(spark, folder)
        raise Invalid(f"epoch {epoch}: {counts['twice'] or 0} blocks hold a row twice, {short} are not whole")
    found = {"epoch": epoch, "folder": folder, "keys": keys, "blocks": counts["blocks"], "rows": counts["rows"] or 0, "tokens": counts["tokens"] or 0}
    system, draft = place(spark, _manifest(root, epoch) + "." + uuid.uuid4().hex)
    out = system.create(draft)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    if not system.rename(draft, place(spark, _manifest(root, epoch))[1]):
        system.delete(draft, False)
        remove(spark, folder)
        raise Invalid(f"epoch {epoch} is published")
    return found


def published(spark: SparkSession, root: str) -> list[int]:
    """The epochs that are published, ascending."""
    system, at = place(spark, f"{root.rstrip('/')}/_published")
    if not system.exists(at):
        return []
    names = [f.getPath().getName() for f in system.listStatus(at)]
    return sorted(int(n[6:-5]) for n in names if n.startswith("epoch-") and n.endswith(".json"))


def manifest(spark: SparkSession, root: str, epoch: int | None = None) -> dict:
    """An epoch's manifest, of the newest one by default."""
    every = published(spark, root)
    if not every or epoch not in (None, *every):
        raise ResourceNotFound(f"epoch {'of any number' if epoch is None else epoch} not found")
    path = _manifest(root, every[-1] if epoch is None else epoch)
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def read(spark: SparkSession, root: str, epoch: int | None = None) -> DataFrame:
    """The rows of a published epoch, in the order of their blocks."""
    found = manifest(spark, root, epoch)
    return spark.read.parquet(found["folder"]).orderBy(*found["keys"], "row_in_batch")


def reset(spark: SparkSession, root: str) -> None:
    """Empties the folder: all epochs, published or not."""
    remove(spark, root)
    system, at = place(spark, root)
    system.mkdirs(at)
