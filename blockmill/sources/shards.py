"""Numbered parquet shards: names, a local cache with a pluggable fetcher, and scans that keep the given order."""

from __future__ import annotations

import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from blockmill.errors import Invalid, ResourceNotFound
from blockmill.sources.staging import place, staged

Fetcher = Callable[[str, str], None]  # from a URL or path, to a path
PARALLEL = 8


def copy_fetcher(source: str, target: str) -> None:
    """Fetches from a folder; the file appears under its name only when it is whole."""
    shutil.copyfile(source, target + ".part")
    os.replace(target + ".part", target)


@dataclass(frozen=True)
class ShardSource:
    base_url: str = ""
    max_shard: int = 1822
    index_pad_width: int = 5
    shard_template: str = "shard_{index}.parquet"

    def format_index(self, shard: int) -> str:
        """Zero-padded; wider numbers stay whole."""
        return f"{shard:0{self.index_pad_width}d}"

    def format_shard_filename(self, shard: int) -> str:
        return self.shard_template.replace("{index}", self.format_index(shard))

    def filename(self, shard: Column) -> Column:
        """The same as a column."""
        index = F.format_string(f"%0{self.index_pad_width}d", shard)
        return F.replace(F.lit(self.shard_template), F.lit("{index}"), index)


def parse_shards(argument: str, max_shard: int) -> list[int]:
    """A comma list of numbers and half-open ranges (3, ..8, 5.., 0..10, 0..=9) within max_shard: sorted, each once."""
    out: set[int] = set()
    for part in filter(None, (p.strip() for p in argument.split(","))):
        m = re.fullmatch(r"(\d*)(\.\.(=?)(\d*))?", part)
        if not m or (m[3] and not m[4]):
            raise Invalid(f"not a shard range: {part}")
        first = int(m[1] or 0)
        last = first + 1 if m[2] is None else int(m[4]) + bool(m[3]) if m[4] else max_shard
        if first > last or last > max_shard:
            raise Invalid(f"{part} is outside of 0..{max_shard}")
        out.update(range(first, last))
    return sorted(out)


def train_val_split(shards: Sequence, share: float = 0.10) -> tuple[list, list]:
    """The last tenth of the shards (rounded up, one at least) is for validation; of one shard nothing is left to train on."""
    if not shards:
        raise Invalid("no shards to split")
    n = max(-int(-len(shards) * share // 1), 1)
    return list(shards[:-n]), list(shards[-n:])


def split_column(shards: DataFrame, column: str, share: float = 0.10) -> DataFrame:
    """shards, a row each, with part: the same split by the order of a column, without a list on the driver."""
    n = F.count("*").over(Window.partitionBy())
    held = F.greatest(F.ceil(n * share), F.lit(1))
    nth = F.row_number().over(Window.orderBy(column))
    return shards.withColumn("part", F.when(nth > n - held, "validation").otherwise("train"))


class ShardCache:
    """Shards in a folder. On a cluster it must be one that driver and executors share, since its paths are read by Spark."""

    def __init__(self, cache_dir: str, source: ShardSource = ShardSource(), fetcher: Fetcher = copy_fetcher):
        path = os.path.expanduser(os.path.expandvars(cache_dir))
        os.makedirs(path, exist_ok=True)
        self.cache_dir, self.source, self.fetcher = os.path.realpath(path), source, fetcher

    def format_shard_path(self, shard: int) -> str:
        return os.path.join(self.cache_dir, self.source.format_shard_filename(shard))

    def has_shard(self, shard: int) -> bool:
        return os.path.exists(self.format_shard_path(shard))

    def try_shard_path(self, shard: int) -> str:
        if not self.has_shard(shard):
            raise ResourceNotFound(f"shard {shard} not found")
        return self.format_shard_path(shard)

    def list_cached_shard_paths(self) -> list[str]:
        with os.scandir(self.cache_dir) as entries:
            return sorted(e.path for e in entries if e.is_file(follow_symlinks=False) and e.name.endswith(".parquet"))

    def list_cached_shard_ids(self) -> list[int]:
        """Of every parquet file in the cache; a file whose name does not fit the template is an error."""
        head, tail = self.source.shard_template.split("{index}")
        pattern = re.compile(re.escape(head) + r"(\d+)" + re.escape(tail))
        out = []
        for path in self.list_cached_shard_paths():
            if not (m := pattern.fullmatch(os.path.basename(path))):
                raise Invalid(f"not a shard of {self.source.shard_template}: {path}")
            out.append(int(m[1]))
        return out

    def load_shard(self, shard: int) -> str:
        return self.load_shards([shard])[0]

    def load_shards(self, shards: Iterable[int]) -> list[str]:
        """Fetches those that are missing, PARALLEL at a time; paths in the order asked for. The first failure is raised."""
        shards = list(shards)
        missing = sorted({s for s in shards if not self.has_shard(s)})
        name = self.source.format_shard_filename
        with ThreadPoolExecutor(PARALLEL) as pool:
            list(pool.map(lambda s: self.fetcher(f"{self.source.base_url}/{name(s)}", self.format_shard_path(s)), missing))
        return [self.try_shard_path(s) for s in shards]

    def get_shard(self, shard: int, download: bool = False) -> str:
        return self.load_shard(shard) if download else self.try_shard_path(shard)

    def read_cached_batches(self, spark: SparkSession, shard: int) -> DataFrame:
        return spark.read.parquet(self.try_shard_path(shard))

    def read_batches(self, spark: SparkSession, shard: int, download: bool = False) -> DataFrame:
        return spark.read.parquet(self.get_shard(shard, download))

    def catalog(self, spark: SparkSession) -> DataFrame:
        """shard_id, path, cached for every shard of the source."""
        have = spark.createDataFrame([(s,) for s in self.list_cached_shard_ids()], "shard_id long")
        every = spark.range(self.source.max_shard).withColumnRenamed("id", "shard_id")
        path = F.concat_ws("/", F.lit(self.cache_dir), self.source.filename(F.col("shard_id")))
        return every.join(have.withColumn("cached", F.lit(True)), "shard_id", "left").select("shard_id", path.alias("path"), F.coalesce("cached", F.lit(False)).alias("cached"))


def stream_fetcher(source: str, target: str) -> None:
    """Copies between any two paths that pyarrow's file systems open; the target appears under its name only when it is whole."""
    (have, at), (out, to) = (pafs.FileSystem.from_uri(p) if "://" in p else (pafs.LocalFileSystem(), p.removeprefix("file:")) for p in (source, target))
    draft = f"{to}.{uuid.uuid4().hex}.part"
    try:
        with have.open_input_stream(at) as a, out.open_output_stream(draft) as b:
            while data := a.read(1 << 22):
                b.write(data)
        out.move(draft, to)
    except BaseException:
        if out.get_file_info(draft).type != pafs.FileType.NotFound:
            out.delete_file(draft)
        raise


@dataclass(frozen=True)
class SharedCache:
    """Shards in a folder of any file system that the session opens, fetched by executors, a file a task. A shard is a file, or a folder of part files."""

    spark: SparkSession
    cache_dir: str
    source: ShardSource = ShardSource()
    fetcher: Fetcher = stream_fetcher

    def path(self, shard: int) -> str:
        return f"{self.cache_dir.rstrip('/')}/{self.source.format_shard_filename(shard)}"

    def cached(self) -> DataFrame:
        """shard_id and path of what is there, by the file system's listing; other files are passed over."""
        system, at = place(self.spark, self.cache_dir)
        names = [f.getPath().getName() for f in system.listStatus(at)] if system.exists(at) else []
        head, tail = map(re.escape, self.source.shard_template.split("{index}"))
        found = [(int(m[1]), f"{self.cache_dir.rstrip('/')}/{n}") for n in names if (m := re.fullmatch(rf"{head}(\d+){tail}", n))]
        return self.spark.createDataFrame(sorted(found), "shard_id long, path string")

    def missing(self, shards: DataFrame) -> DataFrame:
        """Those of shards (shard_id) that are not there, each once."""
        return shards.select(F.col("shard_id").cast("long")).distinct().join(self.cached(), "shard_id", "left_anti")

    def fetch(self, shards: DataFrame) -> DataFrame:
        """Fetches those that are missing; one row each: shard_id, path, and error, null where the shard is there now. It runs once, now.

        A task that runs twice fetches again under a name of its own, and the rename puts one whole file in place.
        """
        system, at = place(self.spark, self.cache_dir)
        system.mkdirs(at)
        base, folder, fetcher, name = self.source.base_url.rstrip("/"), self.cache_dir.rstrip("/"), self.fetcher, self.source.format_shard_filename
        wanted = sorted(r["shard_id"] for r in self.missing(shards).collect())  # a number a shard, as a list of shards is
        with ThreadPoolExecutor(PARALLEL) as pool:
            parts = dict(zip(wanted, pool.map(lambda s: _part_names(self.spark, f"{base}/{name(s)}"), wanted), strict=True))
        # a folder is filled under another name, which no template has, and shows when it is whole
        drafts = {s: f"{folder}/.{uuid.uuid4().hex}.folder" for s in wanted if parts[s] is not None}
        for draft in drafts.values():
            system.mkdirs(place(self.spark, draft)[1])
        files = [(s, f"{base}/{name(s)}/{p}", f"{drafts[s]}/{p}") if s in drafts else (s, f"{base}/{name(s)}", f"{folder}/{name(s)}") for s in wanted for p in parts[s] or [""]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for _, shard, have, to in zip(*(batch[c].to_pylist() for c in ("nth", "shard_id", "source", "target")), strict=True):
                    error = None
                    try:
                        fetcher(have, to)
                    except Exception as e:  # one error a shard; the others go on
                        error = f"{type(e).__name__}: {e}"
                    out.append({"shard_id": shard, "error": error})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("shard_id", pa.int64()), ("error", pa.string())]))

        listed = self.spark.createDataFrame([(k, *f) for k, f in enumerate(files)], "nth int, shard_id long, source string, target string")
        done = staged(listed.repartitionById(max(1, len(files)), F.col("nth")).mapInArrow(run, "shard_id long, error string"), "fetched")
        failed = {r["shard_id"]: r["error"] for r in done.where("error is not null").groupBy("shard_id").agg(F.min("error").alias("error")).collect()}
        for s, draft in drafts.items():
            for f in system.listStatus(place(self.spark, draft)[1]):
                if f.getPath().getName() not in parts[s]:  # of a task that was killed
                    system.delete(f.getPath(), False)
            if s in failed:
                system.delete(place(self.spark, draft)[1], True)
            elif not system.rename(place(self.spark, draft)[1], place(self.spark, f"{folder}/{name(s)}")[1]):
                failed[s] = "OSError: the folder cannot be renamed"
        return self.spark.createDataFrame([(s, f"{folder}/{name(s)}", failed.get(s)) for s in wanted], "shard_id long, path string, error string")

    def read(self, shards: Sequence[int], download: bool = False) -> DataFrame:
        """The rows of the shards, in the order given (shard_pos, row_index)."""
        wanted = self.spark.createDataFrame([(s,) for s in shards], "shard_id long")
        if download:
            failed = self.fetch(wanted).where("error is not null").orderBy("shard_id").first()
            if failed:
                raise ResourceNotFound(f"shard {failed['shard_id']} not fetched: {failed['error']}")
        elif lost := self.missing(wanted).orderBy("shard_id").first():
            raise ResourceNotFound(f"shard {lost['shard_id']} not found")
        return read_shards(self.spark, [self.path(s) for s in shards])


def _part_names(spark: SparkSession, path: str) -> list[str] | None:
    """The part files of a shard that is a folder with any, else None: it is fetched as a file."""
    try:
        system, at = place(spark, path)
        if system.getFileStatus(at).isFile():
            return None
        return sorted(f.getPath().getName() for f in system.listStatus(at) if f.isFile() and not f.getPath().getName().startswith(("_", "."))) or None
    except Exception:  # not there, or of a kind that only the fetcher knows; it says what is wrong
        return None


def _uri(spark: SparkSession, path: str) -> str:
    """The path as file names of a scan begin: absolute, with its scheme, percent-encoded."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return re.sub(r"^(\w+):/+", r"\1:/", system.makeQualified(at).toUri().toString())


def probe(spark: SparkSession, paths: Sequence[str], columns: str | None = None) -> list[str | None]:
    """Of each shard what is wrong with it, or None: that it is not there, that a footer of its files cannot be read, or that it lacks a
    column of columns (a schema as text) or has it in another type.

    Footers are read by Spark's own schema inference, a small job a shard, PARALLEL at a time, so any path that Spark opens will do.
    """
    wanted = {f.name: f.dataType for f in spark.createDataFrame([], columns).schema} if columns else {}

    def look(path: str) -> str | None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return "missing: no such path"
        try:
            have = {f.name: f.dataType for f in spark.read.option("mergeSchema", True).parquet(path).schema}
        except Exception as e:  # of many kinds, by the file's fault
            return f"corrupt: {str(e).splitlines()[0][:200]}"
        for name, kind in wanted.items():
            if have.get(name) != kind:
                return f"schema: column {name} is {have[name].simpleString() if name in have else 'not there'}, not {kind.simpleString()}"
        return None

    found = {}
    with ThreadPoolExecutor(PARALLEL) as pool:
        unique = list(dict.fromkeys(paths))
        found = dict(zip(unique, pool.map(look, unique), strict=True))
    return [found[p] for p in paths]


def scan_shards(spark: SparkSession, paths: Sequence[str], columns: str) -> tuple[DataFrame, DataFrame]:
    """The rows (the columns, shard_pos, row_index) of the shards that can be read, and of each other one an error (shard_pos, path, kind, message).

    A shard whose footers can be read and whose pages cannot still fails the query: nothing of a shard is left out in silence.
    """
    wrong = probe(spark, paths, columns)
    bad = [(k, p, *w.split(": ", 1)) for k, (p, w) in enumerate(zip(paths, wrong, strict=True)) if w]
    errors = spark.createDataFrame(bad, "shard_pos int, path string, kind string, message string")
    good = [k for k, w in enumerate(wrong) if not w]
    empty = spark.createDataFrame([], columns)
    if not good:
        return empty.withColumn("shard_pos", F.lit(None).cast("int")).withColumn("row_index", F.lit(None).cast("long")), errors
    return read_shards(spark, [paths[k] for k in good], places=good, columns=empty.schema).select(*(f"`{c}`" for c in empty.columns), "shard_pos", "row_index"), errors


def read_shards(spark: SparkSession, paths: Sequence[str], skip_corrupt: bool = False, places: Sequence[int] | None = None, columns: StructType | None = None) -> DataFrame:
    """All rows of the shards with shard_pos (the place of the path in the list) and row_index (in its file; in a shard that is a folder of
    part files, counted on from file to file in the order of their names).

    A shard that cannot be read fails the query, or with skip_corrupt is left out; scan_shards() tells which. A path may be listed more than
    once. places: the numbers of the paths, if they are not 0, 1 and so on. columns: those to read, if not all.
    """
    reader = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("ignoreMissingFiles", str(skip_corrupt).lower())
    of: dict[str, list[int]] = {}
    for k, path in zip(places or range(len(paths)), paths, strict=True):
        of.setdefault(_uri(spark, path), []).append(k)
    rows = (reader.schema(columns) if columns else reader).parquet(*dict.fromkeys(paths))
    found = []
    for file in sorted(rows.inputFiles()):
        short = re.sub(r"^(\w+):/+", r"\1:/", file)
        at = short
        while at not in of:
            at, slash, _ = at.rpartition("/")
            if not slash:
                raise Invalid(f"{file} belongs to no shard of the list")
        found += [(short, k) for k in of[at]]
    own = F.regexp_replace(F.col("_metadata.file_path"), r"^(\w+):/+", "$1:/")
    scan = rows.select("*", own.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    listed = spark.createDataFrame(found, "_file string, shard_pos int")
    per_shard: dict[int, int] = {}
    for _, k in found:
        per_shard[k] = per_shard.get(k, 0) + 1
    if max(per_shard.values(), default=0) > 1:
        counts = scan.groupBy("_file").agg(F.count("*").alias("_n"))
        before = F.sum("_n").over(Window.partitionBy("shard_pos").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
        listed = listed.join(counts, "_file", "left").select("_file", "shard_pos", F.coalesce(before, F.lit(0)).alias("_before"))
    else:
        listed = listed.withColumn("_before", F.lit(0).cast("long"))
    # a row for each file of the list, which the driver holds as well
    return scan.join(F.broadcast(listed), "_file").select(*(f"`{c}`" for c in rows.columns), "shard_pos", (F.col("_before") + F.col("_row")).alias("row_index"))
