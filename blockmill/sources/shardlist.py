"""A Spark data source for lists of shards, in the order of the list, as a batch or as a stream of epochs. A shard is a partition, or several
where it is large: its files and their row groups, dealt by the footers, which are read when the scan is planned.

Register ShardList with spark.dataSource.register(), then read "blockmill_shards" with the options

  paths      a JSON list of parquet files, or folders of part files; any path that pyarrow's file systems open
  shards     which of them, as the shard argument is written (3, ..8, 5.., 0..=9); all by default
  on_error   fail, or row: a shard that cannot be opened, or lacks a column or has it in another type, becomes one row whose error
             is set, and the scan goes on with the next shard
  epochs     of the stream: how many times the list is read (1)
  per_batch  of the stream: shards in a micro-batch, at most (all that are left)
  split_bytes  of row groups in a partition, as they are uncompressed (64 MB); one that is larger by itself is not split

and a schema of the columns wanted, without which the first shard that can be opened gives it; shard_pos int (the place in the list),
row_index long and error string are added, and epoch int for a stream. The stream's offset is a count of shards, epoch after epoch, so a
restart from its checkpoint goes on at the shard after the last one committed.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from blockmill.errors import Invalid
from blockmill.sources.shards import PARALLEL, parse_shards

ADDED = [StructField("shard_pos", IntegerType()), StructField("row_index", LongType()), StructField("error", StringType())]
ROWS = 1024
SPLIT = 64 << 20


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    """The part files of a shard, by name."""
    system, at = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(f"no such shard: {path}")
    if info.type == pafs.FileType.File:
        return system, [at]
    names = [f for f in system.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
    return system, sorted(f.path for f in names)


#: a file, its row groups and the number of the shard's rows before them
Piece = list[tuple[str, list[int], int]]


class Shard(InputPartition):
    def __init__(self, pos: int, path: str, epoch: int = 0, piece: Piece | None = None):
        super().__init__(pos)
        self.pos, self.path, self.epoch, self.piece = pos, path, epoch, piece


def _wanted(schema: StructType) -> list[pa.Field]:
    return [f for f in to_arrow_schema(schema) if f.name not in ("shard_pos", "row_index", "error", "epoch")]


def _checked(system: pafs.FileSystem, file: str, wanted: list[pa.Field]) -> pq.ParquetFile:
    f = pq.ParquetFile(system.open_input_file(file))
    for w in wanted:
        at = f.schema_arrow.get_field_index(w.name)
        if at < 0 or not (f.schema_arrow.field(at).type.equals(w.type) or {str(f.schema_arrow.field(at).type), str(w.type)} <= {"string", "large_string"}):
            raise Invalid(f"column {w.name} is {'not there' if at < 0 else str(f.schema_arrow.field(at).type)}, not {w.type}")
    return f


def _dealt(path: str, wanted: list[pa.Field], most: int) -> list[Piece]:
    """A shard's row groups in order, in pieces of so many bytes."""
    system, files = _files(path)
    out, held, n = [], most, 0
    for file in files:
        with _checked(system, file, wanted) as f:
            for g in range(f.metadata.num_row_groups):
                group = f.metadata.row_group(g)
                if held + group.total_byte_size > most and held:
                    out.append([])
                    held = 0
                if out[-1] and out[-1][-1][0] == file:
                    out[-1][-1][1].append(g)
                else:
                    out[-1].append((file, [g], n))
                held, n = held + group.total_byte_size, n + group.num_rows
    return out


def _partitions(shards: list[tuple[int, str]], schema: StructType, most: int) -> dict[int, list[Piece | None]]:
    """Of each shard its pieces; one that cannot be opened is left whole to its task, which says what is wrong."""
    wanted = _wanted(schema)

    def look(shard: tuple[int, str]) -> list[Piece | None]:
        try:
            return _dealt(shard[1], wanted, most) or [None]
        except (OSError, pa.ArrowInvalid, Invalid):
            return [None]

    with ThreadPoolExecutor(PARALLEL) as pool:
        return dict(zip((k for k, _ in shards), pool.map(look, shards), strict=True))


def read_shard(shard: Shard, schema: StructType, on_error: str) -> Iterator[pa.RecordBatch]:
    """The rows of a shard, or of its piece, in batches of the schema's columns."""
    out, wanted = to_arrow_schema(schema), _wanted(schema)
    try:
        system, files = _files(shard.path)
        piece = [(f, None, None) for f in files] if shard.piece is None else shard.piece
        opened = [(_checked(system, f, wanted), groups, first) for f, groups, first in piece]
    except (OSError, pa.ArrowInvalid, Invalid) as e:
        if on_error != "row":
            raise
        row = {f.name: None for f in out} | {"shard_pos": shard.pos, "error": f"{type(e).__name__}: {e}", "epoch": shard.epoch}
        yield pa.RecordBatch.from_pylist([{f.name: row[f.name] for f in out}], out)
        return
    n = 0
    for f, groups, first in opened:
        n = n if first is None else first
        # only the wanted columns are read; rows are counted where none is
        for batch in f.iter_batches(ROWS, row_groups=groups, columns=[w.name for w in wanted]):
            size = batch.num_rows
            made = {"shard_pos": pa.array([shard.pos] * size, pa.int32()), "row_index": pa.array(range(n, n + size), pa.int64()), "error": pa.nulls(size, pa.string()), "epoch": pa.array([shard.epoch] * size, pa.int32())}
            yield pa.RecordBatch.from_arrays([made[c.name] if c.name in made else batch.column(c.name).cast(c.type) for c in out], schema=out)
            n += size


class ShardList(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blockmill_shards"

    def _shards(self) -> list[tuple[int, str]]:
        paths = json.loads(self.options.get("paths", "[]"))
        if not paths:
            raise Invalid("no shards to read")
        return [(k, paths[k]) for k in parse_shards(self.options.get("shards", ".."), len(paths))]

    def schema(self) -> StructType:
        """That of the first shard that can be opened, and what is added."""
        failed = None
        for _, path in self._shards():
            try:
                system, files = _files(path)
                own = from_arrow_schema(pq.ParquetFile(system.open_input_file(files[0])).schema_arrow)
                return StructType([f for f in own.fields if f.name not in ("shard_pos", "row_index", "error")] + ADDED)
            except (OSError, pa.ArrowInvalid, IndexError) as e:
                failed = e
        raise Invalid(f"no shard can be opened: {failed}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self._shards(), schema, self.options.get("on_error", "fail"), int(self.options.get("split_bytes", SPLIT)))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        shards = self._shards()
        return _Stream(shards, schema, self.options.get("on_error", "fail"), int(self.options.get("epochs", 1)), int(self.options.get("per_batch", 0)) or len(shards) * int(self.options.get("epochs", 1)), int(self.options.get("split_bytes", SPLIT)))


class _Batch(DataSourceReader):
    def __init__(self, shards: list[tuple[int, str]], schema: StructType, on_error: str, split: int):
        self.shards, self.wanted, self.on_error, self.split = shards, schema, on_error, split

    def partitions(self) -> list[InputPartition]:
        pieces = _partitions(self.shards, self.wanted, self.split)
        return [Shard(k, path, 0, p) for k, path in self.shards for p in pieces[k]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_shard(partition, self.wanted, self.on_error)


class _Stream(DataSourceStreamReader):
    def __init__(self, shards: list[tuple[int, str]], schema: StructType, on_error: str, epochs: int, per_batch: int, split: int):
        self.shards, self.wanted, self.on_error, self.per_batch, self.split = shards, schema, on_error, per_batch, split
        self.end, self.at = len(shards) * epochs, None

    def initialOffset(self) -> dict:
        self.at = 0
        return {"shards": 0}

    def latestOffset(self) -> dict:
        # after a restart the place is not known before a batch is planned: all that is left is one batch then
        return {"shards": self.end if self.at is None else min(self.end, self.at + self.per_batch)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = end["shards"]
        n = len(self.shards)
        due = [(*self.shards[k % n], k // n) for k in range(start["shards"], end["shards"])]
        pieces = _partitions(list({(pos, path): None for pos, path, _ in due}), self.wanted, self.split)
        return [Shard(pos, path, epoch, p) for pos, path, epoch in due for p in pieces[pos]]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return read_shard(partition, self.wanted, self.on_error)

    def commit(self, end: dict) -> None:
        self.at = max(self.at or 0, end["shards"])
