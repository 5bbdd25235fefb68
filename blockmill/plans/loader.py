"""The corpus loader: shards, text, tokens, dense blocks, shuffled, with counters."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.functions.training import human_size
from blockmill.operators.packing import PackOptions, blocks, plan
from blockmill.operators.shuffle import order_key, shard_order
from blockmill.operators.text import byte_length, byte_tokens, select_text, tokenize
from blockmill.sources.shards import read_shards
from blockmill.sources.staging import release, staged


@dataclass
class Epoch:
    """The blocks of one pass (batch_id, row_in_batch, tokens, by shard_pos unless packed as one) and its counters.

    Counters are sums over what tasks have committed to the shared folder (seen: a row each text; placed: a row each packed text), so a task that
    runs twice, or a plan that is sampled or run again, counts once.
    """

    blocks: DataFrame
    items_total: int
    seen: DataFrame
    placed: DataFrame
    options: PackOptions
    began: float
    kept: tuple[DataFrame, ...] = ()

    def close(self) -> None:
        """Deletes what the epoch has in the shared folder; its blocks cannot be read any more."""
        release(*self.kept)

    def stats(self) -> dict:
        seconds = max(time.time() - self.began, 1e-9)
        seen = self.seen.agg(F.count_distinct("shard_pos").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
        size = self.options.batch_size
        groups = self.placed.groupBy(*(c for c in self.placed.columns if c == "shard_pos")).agg(F.max("full_rows").alias("n"))
        rows = groups.agg(F.coalesce(F.sum(F.expr(f"n div {size} * {size}")), F.lit(0)).alias("rows")).first()["rows"]
        out = {"file_count": seen["files"], "items_total": self.items_total, "byte_count": seen["bytes"], "token_count": rows * self.options.seq_len, "seconds": seconds}
        return out | {"progress": (out["file_count"], self.items_total), "bytes_per_s": out["byte_count"] / seconds, "tokens_per_s": out["token_count"] / seconds}

    def report(self) -> str:
        s = self.stats()
        return f"{s['file_count']}/{s['items_total']} files, {human_size(s['byte_count'])}, {s['token_count']} tokens, {human_size(s['bytes_per_s'])}/s, {s['tokens_per_s']:.0f} tokens/s"


@dataclass(frozen=True)
class CorpusLoader:
    """Epochs over a list of shards. With a seed the shards and blocks are shuffled anew each epoch; without, nothing is.

    by_shard packs each shard by itself, in parallel (each loses what its last row and block lack); else all are packed in one order.
    """

    spark: SparkSession
    paths: tuple[str, ...]
    options: PackOptions = PackOptions()
    seed: int | None = None
    encoder: Callable | None = None
    text_column: str = "text"
    arrival_batch: int = 1024
    by_shard: bool = True

    @property
    def num_items(self) -> int:
        return len(self.paths)

    def slice(self, start: int, end: int) -> CorpusLoader:
        return replace(self, paths=self.paths[start:end])

    def start_epoch(self, epoch: int = 0) -> Epoch:
        began = time.time()
        paths = list(self.paths) if self.seed is None else shard_order(self.paths, self.seed, epoch)
        rows = select_text(read_shards(self.spark, paths), self.text_column, keep=("shard_pos", "row_index"))
        kept = []
        if self.encoder is None:
            tokens = rows.withColumn("tokens", byte_tokens(F.col("text"))).withColumn("length", byte_length(F.col("text")).cast("int"))
        else:  # lengths and pieces both need them
            tokens = staged(tokenize(rows, self.encoder).withColumn("length", F.size("tokens")), "tokens")
            kept.append(tokens)
        batch = F.expr(f"row_index div {self.arrival_batch}")
        if self.by_shard:
            arrival, group = F.col("row_index"), "shard_pos"
        else:
            start = F.col("shard_pos").cast("long") * (1 << 40)
            arrival, batch, group = start + F.col("row_index"), start + batch, None
        seen = staged(tokens.select("shard_pos", arrival.alias("arrival"), batch.alias("batch"), "length", byte_length(F.col("text")).alias("bytes")), "texts")
        placed = staged(plan(seen, self.options, group), "placed")
        made = blocks(tokens.select("shard_pos", arrival.alias("arrival"), batch.alias("batch"), "tokens"), self.options, group, placed)
        if self.seed is not None:
            keys = ["shard_pos", "batch_id"] if self.by_shard else ["batch_id"]
            made = made.orderBy(order_key(*keys, seed=self.seed, epoch=epoch), *keys, "row_in_batch")
        return Epoch(made, len(paths), seen, placed, self.options, began, (*kept, seen, placed))


def to_blocks(epoch: DataFrame) -> DataFrame:
    """One row per block: its key columns and rows, an array of arrays."""
    keys = [c for c in epoch.columns if c not in ("row_in_batch", "tokens")]
    return epoch.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("row_in_batch", "tokens"))), lambda r: r["tokens"]).alias("rows"))
