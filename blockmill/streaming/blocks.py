"""Structured Streaming forms: counters of a text stream, and packing that carries its state from batch to batch."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from blockmill.operators.packing import PackOptions
from blockmill.operators.text import byte_length


def text_stats(stream: DataFrame, column: str = "text") -> DataFrame:
    """Running count and bytes of non-null texts (complete or update mode)."""
    return stream.where(F.col(column).isNotNull()).groupBy().agg(F.count("*").alias("n_texts"), F.sum(byte_length(F.col(column))).alias("n_bytes"))


class Packer:
    """The packing rule as a state that grows by whole arrival batches; rows come out as they fill."""

    def __init__(self):
        self.waiting: list[tuple[int, int, tuple[int, ...]]] = []
        self.row: list[int] = []
        self.rows = 0

    def add(self, batch: list[tuple[int, list[int]]], options: PackOptions, last: bool = False) -> Iterator[tuple[int, list[int]]]:
        for arrival, tokens in batch:
            heapq.heappush(self.waiting, (len(tokens), arrival, tuple(tokens)))
        # a pick needs min_buffer sequences waiting, unless no more will come
        while self.waiting and (last or len(self.waiting) >= options.min_buffer):
            tokens = heapq.heappop(self.waiting)[2]
            room = options.seq_len - len(self.row) - len(options.bos)
            if room < 0:
                raise ValueError("BOS does not fit in what is left of a row")
            self.row += [*options.bos, *tokens[:room]]
            self.row += options.eos[: max(0, options.seq_len - len(self.row))]
            if len(self.row) >= options.seq_len:
                yield self.rows, self.row
                self.rows, self.row = self.rows + 1, []


def pack_stream(stream: DataFrame, group: str, options: PackOptions, last: str | None = None) -> DataFrame:
    """stream: group, arrival, tokens. Full rows (group, row, tokens) as they fill, in append mode; each micro-batch is an arrival batch.

    last: a boolean column that is true in a group's last row, or in a row without tokens that only says so. All that waits is picked then, as
    in a batch at its end, and the group's state goes; what comes later under its name begins anew.
    """
    kind = stream.schema[group].dataType.simpleString()

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        packer = pickle.loads(state.get[0]) if state.exists else Packer()
        batch, ends = [], False
        for pdf in parts:
            batch += [(int(a), list(t)) for a, t in zip(pdf["arrival"], pdf["tokens"], strict=True) if t is not None]
            ends |= bool(pdf["last"].any())
        rows = list(packer.add(sorted(batch), options, ends))
        if ends:
            state.remove()
        else:
            state.update((pickle.dumps(packer),))
        yield pd.DataFrame({group: [key[0]] * len(rows), "row": [r for r, _ in rows], "tokens": [t for _, t in rows]})

    own = F.coalesce(F.col(last), F.lit(False)) if last else F.lit(False)
    return stream.select(group, "arrival", "tokens", own.alias("last")).groupBy(group).applyInPandasWithState(
        run, f"`{group}` {kind}, row long, tokens array<int>", "packer binary", "append", GroupStateTimeout.NoTimeout
    )
