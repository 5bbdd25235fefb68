"""Running totals over ordered parts of any associative rule, in two levels, so that no task sees more than about the root of all parts."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.sources.staging import quoted

Combine = Callable[[bytes, bytes], bytes]


def prefixes(parts: DataFrame, key: str, combine: Combine, most: int) -> DataFrame:
    """parts: the key column, part long and payload binary, one row for each part of a key, none for parts without rows; most: more than the largest part number.

    Gives key, part, prefix (the payloads of all earlier parts combined in order, null for none), total (those of all parts), and last
    (whether it is the key's last part).
    """
    if most <= 1:
        return parts.select(key_of(key), "part", F.lit(None).cast("binary").alias("prefix"), F.col("payload").alias("total"), F.lit(True).alias("last"))
    kind = parts.schema[key].dataType.simpleString()
    wide = max(2, math.isqrt(most) + 1)
    grouped = parts.withColumn("block", F.expr(f"part div {wide}"))

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        found = None
        for p in pdf["payload"]:
            found = p if found is None else combine(found, p)
        return pd.DataFrame({key: pdf[key].iloc[:1], "block": pdf["block"].iloc[:1], "payload": [found]})

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        before, found = [], None
        for p in pdf["payload"]:
            before.append(found)
            found = p if found is None else combine(found, p)
        return pd.DataFrame({key: pdf[key], "block": pdf["block"], "before": before, "total": found, "end": pdf["block"] == pdf["block"].iloc[-1]})

    def inside(pdf: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        before, found = [], block["before"].iloc[0]
        for p in pdf["payload"]:
            before.append(found)
            found = p if found is None else combine(found, p)
        last = (pdf["part"] == pdf["part"].iloc[-1]) & block["end"].iloc[0]
        return pd.DataFrame({key: pdf[key], "part": pdf["part"], "prefix": before, "total": block["total"].iloc[0], "last": last})

    own = quoted(key)
    blocks = grouped.groupBy(key_of(key), "block").applyInPandas(whole, f"{own} {kind}, block long, payload binary")
    totals = blocks.groupBy(key_of(key)).applyInPandas(across, f"{own} {kind}, block long, before binary, total binary, end boolean")
    both = grouped.groupBy(key_of(key), "block").cogroup(totals.groupBy(key_of(key), "block"))
    return both.applyInPandas(inside, f"{own} {kind}, part long, prefix binary, total binary, last boolean")


def key_of(name: str):
    return F.col(quoted(name))
