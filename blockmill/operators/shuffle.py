"""Reproducible orders: hashed, exact bounded-buffer, and of whole shards."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockmill.errors import Invalid
from blockmill.sources.staging import fresh, quoted, small, staged

T = TypeVar("T")


def order_key(*columns: str, seed: int = 0, epoch: int = 0) -> Column:
    """A key that depends on the row alone, so on no partitioning; sort by it, then by the columns. Nulls count as empty texts."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.lit(epoch), *(F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in columns)).cast("binary"))


def hash_shuffle(df: DataFrame, *columns: str, seed: int = 0, epoch: int = 0) -> DataFrame:
    """df in a uniform order: a range-partitioned sort, at any size."""
    return df.orderBy(order_key(*columns, seed=seed, epoch=epoch), *columns)


def _draw(seed: int, kind: str, number: Column) -> Column:
    """32 bits of a counter-based generator, which any engine with MD5 can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{kind}:"), number.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def draw(seed: int, kind: str, number: int) -> int:
    """The same of one number."""
    return int(hashlib.md5(f"{seed}:{kind}:{number}".encode()).hexdigest()[:8], 16)


def buffered(items: Iterable[T], fill_rate: int = 8, buffer_size: int = 128, seed: int = 0) -> Iterator[T]:
    """Each step takes in up to fill_rate items while there is room, gives out one at random, and refills its place; once the items are at an end,
    what is held comes out in a random order."""
    _check_buffer(fill_rate, buffer_size)
    held, source, done, step = [], iter(items), object(), 0
    while True:
        for _ in range(min(fill_rate, buffer_size - len(held))):
            if (item := next(source, done)) is done:
                break
            held.append(item)
        if not held or (item := next(source, done)) is done:
            break
        at = draw(seed, "step", step) % len(held)
        yield held[at]
        held[at] = item
        step += 1
    yield from (held[k] for k in sorted(range(len(held)), key=lambda k: (draw(seed, "rest", k), k)))


def _check_buffer(fill_rate: int, buffer_size: int) -> None:
    if not 0 < fill_rate <= buffer_size or buffer_size < 2:
        raise Invalid("0 < fill_rate <= buffer_size, and buffer_size is 2 at least")


STEPS = 1 << 20


def buffered_shuffle(df: DataFrame, order: str, fill_rate: int = 8, buffer_size: int = 128, seed: int = 0, group: str | None = None, steps: int = STEPS) -> DataFrame:
    """The buffered shuffle of the items in column order: that column and position, of each group by itself.

    It is exact, and no task holds a group. The generator is counter-based, so which slot a step empties is known without the steps before: it
    gives out what was put last into its slot, which is the item that the last earlier step of that slot took in, or the one that filled the
    slot at first. That is a lag within the slot. Slots are cut into ranges of so many steps, and the first step of a slot in a range looks
    up the last one of the ranges before in a table of one row for each slot and range.
    """
    _check_buffer(fill_rate, buffer_size)
    key = group or fresh(df, "_all")
    source = (df if group else df.withColumn(key, F.lit(0))).select(quoted(key), quoted(order))
    rows = global_index(source, order, group=key)
    sizes = staged(rows.groupBy(quoted(key)).agg(F.count("*").alias("n")), "shuffle-sizes")
    size = F.least(F.lit(buffer_size), (F.col("t") + 1) * fill_rate)
    per = sizes.select(F.col(quoted(key)).alias("_k"), "n")
    step = rows.select(F.col(quoted(key)).alias("k"), F.col("row_no").alias("t")).join(small(per), F.col("k").eqNullSafe(F.col("_k"))).drop("_k")
    # as long as an item is left to refill with, there is a step for each row, from 0 on; the other rows stand for slots that are emptied at the end
    filled = step.withColumn("held", size).withColumn("refills", F.col("held") + F.col("t") < F.col("n"))
    n_steps = staged(filled.groupBy("k").agg(F.sum(F.col("refills").cast("long")).alias("n_steps")), "shuffle-counts")
    own = small(n_steps.select(F.col("k").alias("_k"), "n_steps"))
    walk = filled.join(own, F.col("k").eqNullSafe(F.col("_k"))).drop("_k")
    slot = F.when(F.col("refills"), F.pmod(_draw(seed, "step", F.col("t")), F.col("held"))).otherwise(F.col("t") - F.col("n_steps"))
    walk = staged(walk.select("k", "t", "held", "refills", "n_steps", slot.alias("slot"), F.expr(f"t div {steps}").alias("range")), "shuffle-steps")
    latest = walk.where("refills").groupBy("k", "slot", "range").agg(F.max("t").alias("latest"))
    # what was put into the slot before a range: the steps at the end read it as well, at a range of their own
    ends = walk.where("not refills").select("k", "slot", "range").distinct()
    asked = latest.unionByName(ends.withColumn("latest", F.lit(None).cast("long"))).groupBy("k", "slot", "range").agg(F.max("latest").alias("latest"))
    before = F.last("latest", ignorenulls=True).over(Window.partitionBy("k", "slot").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    carried = asked.select(F.col("k").alias("_k"), F.col("slot").alias("_slot"), F.col("range").alias("_range"), before.alias("carried"))
    inside = F.lag("t").over(Window.partitionBy("k", "slot", "range").orderBy("t"))
    met = walk.withColumn("inside", inside).join(carried, F.col("k").eqNullSafe(F.col("_k")) & (F.col("slot") == F.col("_slot")) & (F.col("range") == F.col("_range")))
    last = F.coalesce("inside", "carried")
    item = F.when(last.isNotNull(), F.least(F.lit(buffer_size), (last + 1) * fill_rate) + last).otherwise(F.col("slot") + F.expr(f"slot div {fill_rate}"))
    drained = F.col("n_steps") + F.row_number().over(Window.partitionBy("k", "refills").orderBy(_draw(seed, "rest", F.col("slot")), "slot")) - 1
    placed = met.where("refills").select("k", item.alias("item"), F.col("t").alias("position")).unionByName(
        # at most buffer_size of each group
        met.where("not refills").select("k", item.alias("item"), drained.alias("position"))
    )
    named = rows.select(F.col(quoted(key)).alias("_k"), F.col(quoted(order)).alias("_v"), "row_no")
    out = named.join(placed, F.col("_k").eqNullSafe(F.col("k")) & (F.col("row_no") == F.col("item"))).select(F.col("_k").alias(key), F.col("_v").alias(order), "position")
    return out if group else out.drop(key)


def shard_order(paths: Sequence[T], seed: int = 0, epoch: int = 0) -> list[T]:
    """The epoch's order of the shards: by a seeded hash of their places, the same for the same seed and epoch."""
    key = lambda k: (hashlib.md5(f"{seed}:{epoch}:{k}".encode()).hexdigest(), k)
    return [paths[k] for k in sorted(range(len(paths)), key=key)]


RANGE_ROWS = 1 << 20


def global_index(df: DataFrame, *order: str, group: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with row_no long: the place of each row by the columns of order, from 0, nulls first; with a group, its place there.

    Rows are range-partitioned into as many ranges as their number asks for and numbered inside; the counts of the ranges are summed. Equal
    rows are told apart by where they were read, so they spread over ranges as well. No task sees all rows, or all of a group or value.
    """
    spark = df.sparkSession
    key = [group] if group else []
    tie, part, at = (fresh(df, c) for c in ("_tie", "_part", "_at"))
    by = [F.col(quoted(c)).asc_nulls_first() for c in [*key, *order]] + [F.col(tie).asc()]
    parts = max(1, -(-df.count() // range_rows), int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.withColumn(tie, F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by).drop(tie)
    rows = staged(ranged.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id()), "index-rows")
    n, low = fresh(rows, "_n"), fresh(rows, "_low")
    counts = rows.groupBy(part, *map(quoted, key)).agg(F.count("*").alias(n), F.min(at).alias(low))
    before = F.sum(n).over(Window.partitionBy(*map(quoted, key)).orderBy(part)) - F.col(n)
    p, g, shift = (fresh(rows, c) for c in ("_p", "_g", "_shift"))
    shifts = counts.select(F.col(part).alias(p), *(F.col(quoted(c)).alias(g) for c in key), (before - F.col(low)).alias(shift))
    same = (F.col(part) == F.col(p)) & (F.col(quoted(group)).eqNullSafe(F.col(g)) if group else F.lit(True))
    # a row a range, and with a group one more for each of its values
    offsets = small(staged(shifts, "index-offsets")) if group else F.broadcast(shifts)
    return rows.join(offsets, same).select(*map(quoted, df.columns), (F.col(at) + F.col(shift)).alias("row_no"))


def rebatch(df: DataFrame, order: str, target: int) -> DataFrame:
    """df with batch_id and row_in_batch: batches of exactly target rows in the given order, the last may be short."""
    if target < 1:
        raise Invalid("a batch has one row at least")
    return global_index(df, order).withColumn("batch_id", F.expr(f"row_no div {target}")).withColumn("row_in_batch", F.expr(f"cast(row_no % {target} as int)")).drop("row_no")
