"""Parameters in disjoint groups: assignment, duplicate check, keyed update."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.errors import DuplicateParamId, Invalid
from blockmill.functions.training import clip


def assign(spark: SparkSession, types: Sequence[Sequence[Sequence[str]]]) -> DataFrame:
    """param_id, type_tag, group_idx: types of groups of parameter ids."""
    rows = [(p, t, g) for t, groups in enumerate(types) for g, ids in enumerate(groups) for p in ids]
    return spark.createDataFrame(rows, "param_id string, type_tag int, group_idx int")


def duplicates(groups: DataFrame) -> DataFrame:
    """param_id and its first two places, for ids that are in more than one group."""
    spots = F.sort_array(F.collect_set(F.struct("type_tag", "group_idx")))
    found = groups.groupBy("param_id").agg(spots.alias("spots")).where(F.size("spots") > 1)
    return found.select("param_id", F.col("spots")[0].alias("first"), F.col("spots")[1].alias("second"))


def check_disjoint(groups: DataFrame) -> DataFrame:
    """groups, or DuplicateParamId of the smallest id that is in two."""
    bad = duplicates(groups).orderBy("param_id").first()
    if bad:
        raise DuplicateParamId(bad["param_id"], tuple(bad["first"]), tuple(bad["second"]))
    return groups


def split(every: DataFrame, chosen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chosen ids and the rest, each once; neither may be empty."""
    chosen = chosen.select("param_id").distinct()
    rest = every.select("param_id").distinct().join(chosen, "param_id", "left_anti")
    for name, part in (("chosen", chosen), ("other", rest)):
        if part.isEmpty():
            raise Invalid(f"no {name} parameters")
    return chosen, rest


def step(params: DataFrame, grads: DataFrame, groups: DataFrame, state: DataFrame, update: Callable[[Column, Column, Column], tuple[Column, Column]], clip_at: float | None = None) -> DataFrame:
    """One update: param_id, value, state, updated.

    params: param_id, value. grads: param_id, grad. state: type_tag, group_idx, param_id, state. update makes the new value and state from
    the columns value, grad and state. A parameter without a gradient or a group is passed through.
    """
    joined = (
        params.join(grads, "param_id", "left")
        .join(groups, "param_id", "left")
        .join(state, ["type_tag", "group_idx", "param_id"], "left")
    )
    grad = clip(F.col("grad"), clip_at) if clip_at is not None else F.col("grad")
    value, kept = update(F.col("value"), grad, F.col("state"))
    live = F.col("grad").isNotNull() & F.col("type_tag").isNotNull()
    return joined.select("param_id", F.when(live, value).otherwise(F.col("value")).alias("value"), F.when(live, kept).otherwise(F.col("state")).alias("state"), live.alias("updated"))


def sum_grads(parts: Sequence[DataFrame]) -> DataFrame:
    """The gradients of several devices (param_id, grad each), added by parameter and place; a parameter may lack some of them."""
    # arrays are added whole, so a gradient's elements are never rows
    every = [p.select("param_id", F.col("grad").alias(f"g{k}")) for k, p in enumerate(parts)]
    joined = reduce(lambda a, b: a.join(b, "param_id", "full"), every)
    none = F.array().cast(every[0].schema["g0"].dataType)
    grads = [F.coalesce(f"g{k}", none) for k in range(len(parts))]
    add = lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0)))
    return joined.select("param_id", reduce(add, grads).alias("grad"))


def step_multi(params: DataFrame, grads: Sequence[DataFrame], groups: DataFrame, state: DataFrame, update: Callable[[Column, Column, Column], tuple[Column, Column]], clip_at: float | None = None) -> DataFrame:
    """step() with the gradients of several devices."""
    return step(params, sum_grads(grads), groups, state, update, clip_at)


def to_record(stepped: DataFrame, groups: DataFrame) -> DataFrame:
    """The state that is to be saved after a step: type_tag, group_idx, param_id, state."""
    return groups.join(stepped.where(F.col("state").isNotNull()).select("param_id", "state"), "param_id").select("type_tag", "group_idx", "param_id", "state")


def save_record(record: DataFrame, path: str) -> None:
    record.write.mode("overwrite").parquet(path)


def load_record(spark: SparkSession, path: str, groups: DataFrame) -> DataFrame:
    """A saved state. Invalid if it names a parameter that its group has not."""
    record = spark.read.parquet(path)
    stray = record.join(groups, ["type_tag", "group_idx", "param_id"], "left_anti").first()
    if stray:
        raise Invalid(f"parameter {stray['param_id']} of the record is not in group {(stray['type_tag'], stray['group_idx'])}")
    return record
