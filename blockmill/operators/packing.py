"""Packing of token sequences into dense blocks of batch_size rows of seq_len tokens.

The rule: before each pick, whole arrival batches are admitted until min_buffer sequences wait (or none are left); the shortest is picked,
of equals the earliest. A row is filled with BOS, the sequence's head and EOS, cut at the row's end; what is cut off is lost. Rows that
are not full, and blocks that lack rows, are dropped.

pick_order() and place() are the rule, literally. plan() gives the same for any number of sequences in parallel, over lengths alone:

Order. Picks take the smallest first, so whenever a batch is admitted, what waits is the min_buffer - 1 largest sequences of all before. A
sequence is thus picked in the round of the first batch, from its own on, after which min_buffer - 1 larger ones have been seen, and the
order of picks is that of (round, length, arrival). The largest of a union are found from the largest of its parts, so a running total in
two levels gives each chunk of sequences what waits at its begin, and chunks settle the rounds of what they pick by themselves.

With one_a_pick, one batch at most is admitted before a pick, so picks begin with the first batch and what waits grows by a batch less one until
it is min_buffer - 1; from there on both rules are the same. The batches up to there are a chunk of their own, gone through batch by batch. It is
short, some min_buffer sequences and one for each of its batches, but where nearly all batches of a group hold a single sequence.

Places. A chunk of picks turns the fill of a row, 0 to seq_len - 1, into another fill and a number of full rows. Such functions are tables of
seq_len entries, and are put one after another by indexing, again in two levels; then each chunk places its picks from its own begin.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from blockmill.errors import Invalid
from blockmill.operators.scan import prefixes
from blockmill.operators.shuffle import global_index
from blockmill.sources.staging import quoted, small, staged


@dataclass(frozen=True)
class PackOptions:
    batch_size: int = 32
    seq_len: int = 2048
    min_buffer: int = 512
    bos: tuple[int, ...] = ()
    eos: tuple[int, ...] = ()
    one_a_pick: bool = False

    def __post_init__(self):
        if self.batch_size < 1 or self.seq_len < 1 or self.min_buffer < 0:
            raise Invalid("batch_size and seq_len are positive, and min_buffer is not negative")


def pick_order(batches: Iterable[list[tuple[int, int]]], min_buffer: int, one_a_pick: bool = False) -> Iterator[tuple[int, int]]:
    """(length, arrival) in the order of picks. batches: of (length, arrival), none empty with one_a_pick."""
    waiting: list[tuple[int, int]] = []
    source, more = iter(batches), True
    while True:
        while more and len(waiting) < min_buffer:
            batch = next(source, None)
            if batch is None:
                more = False
            else:
                for item in batch:
                    heapq.heappush(waiting, item)
                if one_a_pick:
                    break
        if not waiting:
            return
        yield heapq.heappop(waiting)


def place(order: Iterable[tuple[int, int]], options: PackOptions, row: int = 0, fill: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(arrival, row, offset of BOS, tokens taken, EOS tokens taken) of each pick, from a row and its fill on."""
    b, e, width = len(options.bos), len(options.eos), options.seq_len
    for length, arrival in order:
        room = width - fill - b
        if room < 0 or fill < 0:
            raise Invalid("BOS does not fit in what is left of a row")
        take = min(length, room)
        tail = min(e, room - take)
        yield arrival, row, fill, take, tail
        fill += b + take + tail
        if fill >= width:
            row, fill = row + 1, 0


CHUNK = 1 << 16


def plan(lengths: DataFrame, options: PackOptions, group: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """lengths: arrival (unique in its group), batch, length (and the group column). Gives arrival, pick, row, off, take, tail, and the number of
    the group's full rows; each group is packed by itself. A task holds chunk lengths, or a few times min_buffer if that is more."""
    key = "_group"
    own = F.col(quoted(group)) if group else F.lit(0)
    source = staged(lengths.select(own.alias(key), F.col("arrival").cast("long"), F.col("batch").cast("long"), F.col("length").cast("long")), "pack-lengths")
    most = source.groupBy(quoted(key)).count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    wait = options.min_buffer - 1
    if wait < 0:  # without a buffer nothing is picked
        rounds = source.where("false").withColumn("round", F.col("batch"))
    elif wait == 0:
        rounds = source.withColumn("round", F.col("batch"))
    elif wait >= most and not options.one_a_pick:
        rounds = source.withColumn("round", F.lit(0).cast("long"))
    else:
        wait = min(wait, most)
        rounds = staged(_rounds(source, key, wait, max(chunk, 4 * wait), most, options.one_a_pick), "pack-rounds")
    picks = global_index(rounds.select(quoted(key), "arrival", "length", "round"), "round", "length", "arrival", group=key)
    chunked = picks.select(quoted(key), "arrival", "length", F.col("row_no").alias("pick"), F.expr(f"row_no div {chunk}").alias("part"))
    out = _places(chunked, key, options, most // chunk + 1)
    return out.withColumnRenamed(key, group) if group else out.drop(key)


def _pairs(payload: bytes | None) -> np.ndarray:
    """(length, arrival) pairs, ascending."""
    return np.frombuffer(payload or b"", "<i8").reshape(-1, 2)


def _largest(pairs: np.ndarray, most: int) -> np.ndarray:
    return pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))][-most:]


def _admit(pdf: pd.DataFrame, waiting: np.ndarray, wait: int, least: int, end: bool) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """What each batch sends out, least sequences and all but wait of them (at the end all), its rounds, and what waits then."""
    # a batch that is cut by chunks is admitted in pieces: what goes out early goes in the same round
    pdf = pdf.sort_values("batch", kind="stable")
    pairs, batch = pdf[["length", "arrival"]].to_numpy(np.int64), pdf["batch"].to_numpy()
    out, rounds, first = [], [], 0
    for last in np.append(np.flatnonzero(np.diff(batch)) + 1, len(batch)):
        every = np.concatenate([waiting, pairs[first:last]])
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        go = len(every) if end and last == len(batch) else max(least, len(every) - wait)
        out.append(every[:go])
        rounds.append(np.full(go, batch[first]))
        waiting, first = every[go:], last
    return out, rounds, waiting


def _rounds(source: DataFrame, key: str, wait: int, chunk: int, most: int, one_a_pick: bool) -> DataFrame:
    """The key, arrival, length and round of every sequence, where at most `wait` are left when the next batch is admitted."""
    own, kind = quoted(key), source.schema[key].dataType.simpleString()
    least = int(one_a_pick)
    placed = global_index(source, "batch", "length", "arrival", group=key)
    part = F.expr(f"row_no div {chunk}")
    if one_a_pick:  # part 0 is the batches until wait sequences are left for the first time
        before = F.sum("n").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
        sizes = source.groupBy(F.col(own).alias("_k"), F.col("batch").alias("_b")).agg((F.count("*") - 1).alias("n"))
        early = sizes.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < wait).groupBy("_k").agg(F.max("_b").alias("_b"))
        ends = small(staged(early, "pack-early"))
        placed = placed.join(ends, F.col(own).eqNullSafe(F.col("_k")))
        part = F.when(F.col("batch") <= F.col("_b"), F.lit(0).cast("long")).otherwise(part + 1)
    rows = placed.select(own, "arrival", "batch", "length", part.alias("part"))

    def top(pdf: pd.DataFrame) -> pd.DataFrame:
        if one_a_pick and pdf["part"].iloc[0] == 0:
            found = _admit(pdf, _pairs(None), wait, least, False)[2]
        else:
            found = _largest(pdf[["length", "arrival"]].to_numpy(np.int64), wait)
        return pd.DataFrame({key: pdf[key].iloc[:1], "part": pdf["part"].iloc[:1], "payload": [found.astype("<i8").tobytes()]})

    def settle(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        out, rounds, _ = _admit(pdf, _pairs(before["prefix"].iloc[0]), wait, least, before["last"].iloc[0])
        found = np.concatenate(out)
        return pd.DataFrame({key: pdf[key].iloc[0], "arrival": found[:, 1], "length": found[:, 0], "round": np.concatenate(rounds)})

    tops = rows.groupBy(own, "part").applyInPandas(top, f"{own} {kind}, part long, payload binary")
    merge = lambda a, b: _largest(np.concatenate([_pairs(a), _pairs(b)]), wait).astype("<i8").tobytes()
    before = prefixes(tops, key, merge, most // chunk + 1 + least)
    return rows.groupBy(own, "part").cogroup(before.groupBy(own, "part")).applyInPandas(settle, f"{own} {kind}, arrival long, length long, round long")


BAD = -1  # of a fill from which a BOS would not fit


def table(sizes: np.ndarray, options: PackOptions) -> tuple[np.ndarray, np.ndarray]:
    """Of every fill (0 to seq_len - 1) the fill after picks of these lengths, and the rows that they complete."""
    b, width = len(options.bos), options.seq_len
    fill, full = np.arange(width), np.zeros(width, np.int64)
    of, extra = np.arange(width), np.zeros(width, np.int64)  # fills that have met share an entry, the rows they had more are kept apart
    for k, size in enumerate((sizes + b + len(options.eos)).tolist()):
        if b > 1:
            fill = np.where(fill + b > width, BAD, fill)
        new = np.where(fill < 0, BAD, fill + size)
        over = new >= width
        full += over
        fill = np.where(over, 0, new)
        if len(fill) > 1 and (k % 8 == 7 or k < 4):
            fill, first, back = np.unique(fill, return_index=True, return_inverse=True)
            extra += (full - full[first][back])[of]
            of, full = back[of], full[first]
    return fill[of], full[of] + extra


def _packed(fill: np.ndarray, full: np.ndarray) -> bytes:
    return fill.astype("<i8").tobytes() + full.astype("<i8").tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(payload, "<i8")
    return both[: len(both) // 2], both[len(both) // 2 :]


def compose(a: bytes, b: bytes) -> bytes:
    """The table of what a and then b do."""
    (fa, ra), (fb, rb) = _unpacked(a), _unpacked(b)
    good = fa >= 0
    at = np.where(good, fa, 0)
    return _packed(np.where(good, fb[at], BAD), ra + np.where(good, rb[at], 0))


def _places(picks: DataFrame, key: str, options: PackOptions, parts: int) -> DataFrame:
    own, kind = quoted(key), picks.schema[key].dataType.simpleString()

    def make(pdf: pd.DataFrame) -> pd.DataFrame:
        found = table(pdf.sort_values("pick")["length"].to_numpy(), options)
        return pd.DataFrame({key: pdf[key].iloc[:1], "part": pdf["part"].iloc[:1], "payload": [_packed(*found)]})

    def lay(pdf: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pick")
        fill, row = 0, 0
        if before["prefix"].iloc[0] is not None:
            fills, rows = _unpacked(before["prefix"].iloc[0])
            fill, row = int(fills[0]), int(rows[0])
        order = zip(pdf["length"].tolist(), pdf["arrival"].tolist(), strict=True)
        out = pd.DataFrame(list(place(order, options, row, fill)), columns=["arrival", "row", "off", "take", "tail"])
        out[key], out["pick"] = pdf[key].iloc[0], pdf["pick"].to_numpy()
        out["full_rows"] = int(_unpacked(before["total"].iloc[0])[1][0])
        return out

    tables = picks.groupBy(own, "part").applyInPandas(make, f"{own} {kind}, part long, payload binary")
    before = prefixes(tables, key, compose, parts)
    schema = f"pick long, arrival long, row long, off int, take int, tail int, full_rows long, {own} {kind}"
    return picks.groupBy(own, "part").cogroup(before.groupBy(own, "part")).applyInPandas(lay, schema)


def blocks(sequences: DataFrame, options: PackOptions, group: str | None = None, placed: DataFrame | None = None) -> DataFrame:
    """sequences: arrival long (unique in its group), batch, tokens array<int>. One row per packed row: batch_id, row_in_batch, tokens.

    A column length, the number of tokens, spares making the tokens for their lengths; placed, what plan() gives, spares planning.
    """
    key = [group] if group else []
    lengths = sequences.select(*key, "arrival", "batch", F.col("length") if "length" in sequences.columns else F.size("tokens").alias("length"))
    placed = plan(lengths, options, group) if placed is None else placed
    ids = lambda t: F.array(*map(F.lit, t)).cast("array<int>")
    piece = F.concat(ids(options.bos), F.slice("tokens", F.lit(1), F.col("take")), F.slice(ids(options.eos), F.lit(1), F.col("tail")))
    cut = placed.join(sequences.select(*key, "arrival", "tokens"), [*key, "arrival"]).select(*key, "row", "pick", "full_rows", piece.alias("piece"))
    rows = cut.groupBy(*key, "row", "full_rows").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pick", "piece"))), lambda x: x["piece"])).alias("tokens"))
    full = rows.where(F.size("tokens") == options.seq_len)
    size = options.batch_size
    return full.where(F.expr(f"row div {size} < full_rows div {size}")).select(*key, F.expr(f"row div {size}").alias("batch_id"), F.expr(f"cast(row % {size} as int)").alias("row_in_batch"), "tokens")
