"""Queries of shard names, cache, scans, vocabularies and scalar parsers, by name, and their SQL."""

from __future__ import annotations

import json
import os
import shutil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockmill.errors import BlockmillError, Invalid
from blockmill.functions import tensors, training
from blockmill.operators import groups, shuffle, text
from blockmill.plans.registry import docs, query
from blockmill.sources.shardlist import ShardList
from blockmill.sources.shards import ShardCache, SharedCache, ShardSource, parse_shards, read_shards, scan_shards
from blockmill.sources.staging import new_path

TABLES = ("region", "nation", "supplier")


def _cache(spark, sf: str) -> ShardCache:
    """A cache of three tables as shards 0, 12 and 312; its fetcher copies from the table folder."""

    def fetch(source: str, target: str) -> None:
        shard = int(os.path.basename(source).split("_")[1].split(".")[0])
        shutil.copyfile(f"{sf}/{TABLES[(0, 12, 312).index(shard)]}.parquet", target)

    return ShardCache(new_path(spark, "cache").removeprefix("file:"), ShardSource(base_url=sf), fetch)


_COUNTS = "(select count(*) from {})"


@query(
    "select * from (values "
    + ", ".join(f"({s}, 'shard_{s:05d}.parquet', false, true, {_COUNTS.format(t)})" for s, t in zip((0, 12, 312), TABLES, strict=True))
    + ") as v(shard_id, file, had, has, n_rows)"
)
def cache_reads(spark, sf):
    """Each shard before and after it is fetched, and its rows when it is read with fetching."""
    cache, out = _cache(spark, sf), []
    for s in (0, 12, 312):
        had = cache.has_shard(s)
        n = cache.read_batches(spark, s, download=True).count()
        out.append((s, os.path.basename(cache.get_shard(s)), had, cache.has_shard(s), n if n == cache.read_cached_batches(spark, s).count() else -1))
    return spark.createDataFrame(out, "shard_id int, file string, had boolean, has boolean, n_rows long")


@query("select * from (values (0, 0, 'shard_00000.parquet', true), (1, 12, 'shard_00012.parquet', true), (2, 312, 'shard_00312.parquet', true)) as v(place, shard_id, file, in_order)")
def cache_listing(spark, sf):
    """Paths and ids of a cache that was filled out of order."""
    cache = _cache(spark, sf)
    given = cache.load_shards([312, 0, 12, 312])
    paths, ids = cache.list_cached_shard_paths(), cache.list_cached_shard_ids()
    ordered = given == [cache.format_shard_path(s) for s in (312, 0, 12, 312)] and cache.load_shard(0) == cache.try_shard_path(0)
    return spark.createDataFrame([(k, i, os.path.basename(p), ordered) for k, (i, p) in enumerate(zip(ids, paths, strict=True))], "place int, shard_id int, file string, in_order boolean")


@query("select doc_id, 12 as shard_id, 1 as shard_pos, row_number() over (order by doc_id) - 1 as row_index, strlen(text)::bigint as n_bytes from documents union all select item_id, 0, 0, row_number() over (order by item_id) - 1, strlen(text)::bigint from benchmark union all select -1, 7, -1, -1, -1")
def cache_fetch(spark, sf):
    """Two tables as shards 12 and 0, folders of part files fetched by executors and read in that order; shard 7 is not there and is one error."""
    far = new_path(spark, "far")
    source = ShardSource(base_url=far)
    for table, key, shard in (("documents", "doc_id", 12), ("benchmark", "item_id", 0)):
        rows = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).alias("doc_id"), "text")
        _parts(rows, "doc_id").write.parquet(f"{far}/{source.format_shard_filename(shard)}")
    cache = SharedCache(spark, new_path(spark, "near"), source)
    errors = cache.fetch(spark.createDataFrame([(12,), (0,), (7,), (12,)], "shard_id long")).where("error is not null")
    rows = cache.read([0, 12]).select("doc_id", F.when(F.col("shard_pos") == 0, 0).otherwise(12).alias("shard_id"), "shard_pos", "row_index", text.byte_length(F.col("text")).alias("n_bytes"))
    none = F.lit(-1)
    return rows.unionByName(errors.select(none.alias("doc_id"), F.col("shard_id").cast("int"), none.alias("shard_pos"), none.alias("row_index"), none.alias("n_bytes")))


@query("select i as shard_id, 'shard_' || lpad(i::varchar, 5, '0') || '.parquet' as file, i in (0, 12, 312) as cached from (select unnest(range(0, 1822)) as i)")
def shard_catalog(spark, sf):
    cache = _cache(spark, sf)
    cache.load_shards([12, 312, 0])
    return cache.catalog(spark).select("shard_id", F.element_at(F.split("path", "/"), -1).alias("file"), "cached")


@query("select * from (values ('shard 5 not found'), ('not a shard range: x'), ('3..2 is outside of 0..9'), ('..10 is outside of 0..9')) as v(message)")
def shard_errors(spark, sf):
    cache, out = _cache(spark, sf), []
    for f in (lambda: cache.try_shard_path(5), *(lambda a=a: parse_shards(a, 9) for a in ("x", "3..2", "..10"))):
        try:
            f()
        except BlockmillError as e:
            out.append((str(e),))
    return spark.createDataFrame(out, "message string")


@query("select doc_id, 0 as shard_pos, row_number() over (order by doc_id) - 1 as row_index from documents")
def ordered_scan(spark, sf):
    return read_shards(spark, [f"{sf}/documents.parquet"]).select("doc_id", "shard_pos", "row_index")


@query("select r_name as name, 1 as shard_pos, row_number() over (order by r_regionkey) - 1 as row_index from region union all select n_name, 0, row_number() over (order by n_nationkey) - 1 from nation")
def folder_scan(spark, sf):
    """Two shards, one a folder of part files with a blank in its name, the other a file."""
    root = new_path(spark, "two shards")
    spark.read.parquet(f"{sf}/nation.parquet").selectExpr("n_name as name", "n_nationkey").repartitionByRange(3, "n_nationkey").sortWithinPartitions("n_nationkey").select("name").write.parquet(f"{root}/shard 1")
    spark.read.parquet(f"{sf}/region.parquet").coalesce(1).orderBy("r_regionkey").selectExpr("r_name as name").write.parquet(f"{root}/one")
    return read_shards(spark, [f"{root}/shard 1", spark.read.parquet(f"{root}/one").inputFiles()[0].replace("%20", " ")])


PART_BYTES = 32 << 20  # of text in a part file of a shard


def _parts(rows: DataFrame, key: str) -> DataFrame:
    """rows (with a column text) in the order of key, cut into partitions of about PART_BYTES of text, so of more partitions the more there is."""
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.repartitionByRange(max(3, -(-size // PART_BYTES)), key).sortWithinPartitions(key)


def _shards(spark, sf: str) -> list[str]:
    """documents, a file that is no parquet file, documents' texts in parts, a path that is not there, benchmark, whose columns are others, and documents again."""
    root = new_path(spark, "shards")
    spark.read.parquet(f"{sf}/benchmark.parquet").select("text").write.text(f"{root}/corrupt")
    _parts(docs(spark, sf).select("text", "doc_id"), "doc_id").write.parquet(f"{root}/parts")
    return [f"{sf}/documents.parquet", f"{root}/corrupt", f"{root}/parts", f"{root}/nowhere", f"{sf}/benchmark.parquet", f"{sf}/documents.parquet"]


_DOCS_AS_SHARDS = "select doc_id, k::int as shard_pos, row_number() over (partition by k order by doc_id) - 1 as row_index, strlen(text)::bigint as n_bytes, '' as error from documents, (values {}) as s(k)"


@query(_DOCS_AS_SHARDS.format("(0), (2), (5)") + " union all select -1, k::int, -1, -1, e from (values (1, 'corrupt'), (3, 'missing'), (4, 'schema')) as v(k, e)")
def scan_with_errors(spark, sf):
    """The rows of the shards that can be read, and of each other shard one error."""
    rows, errors = scan_shards(spark, _shards(spark, sf), "doc_id long, text string")
    good = rows.select("doc_id", "shard_pos", "row_index", text.byte_length(F.col("text")).alias("n_bytes"), F.lit("").alias("error"))
    none = F.lit(-1).cast("long")
    return good.unionByName(errors.select(none.alias("doc_id"), "shard_pos", none.alias("row_index"), none.alias("n_bytes"), F.col("kind").alias("error")))


@query(_DOCS_AS_SHARDS.format("(0), (2)") + " union all select -1, k::int, -1, -1, e from (values (1, 'ArrowInvalid'), (3, 'FileNotFoundError'), (4, 'Invalid')) as v(k, e)")
def shard_source(spark, sf):
    """The same list by the data source, whose errors are rows, without its last shard."""
    spark.dataSource.register(ShardList)
    rows = spark.read.format("blockmill_shards").schema("doc_id long, text string, shard_pos int, row_index long, error string").options(paths=json.dumps(_shards(spark, sf)), shards="..5", on_error="row").load()
    or_less = lambda c: F.coalesce(c, F.lit(-1))
    return rows.select(or_less(F.col("doc_id")).alias("doc_id"), "shard_pos", or_less(F.col("row_index")).alias("row_index"), or_less(text.byte_length(F.col("text"))).alias("n_bytes"), F.coalesce(F.substring_index("error", ":", 1), F.lit("")).alias("error"))


@query("select doc_id, e::int as epoch, k::int as shard_pos, row_number() over (partition by e, k order by doc_id) - 1 as row_index from documents, (values (0), (1)) as s(k), (values (0), (1)) as r(e)")
def shard_stream(spark, sf):
    """Two shards as a stream of two epochs, three shards a run, restarted from its checkpoint."""
    spark.dataSource.register(ShardList)
    shards = _shards(spark, sf)
    out, kept = new_path(spark, "stream"), new_path(spark, "stream-checkpoint")
    stream = spark.readStream.format("blockmill_shards").schema("doc_id long, shard_pos int, row_index long, error string, epoch int").options(paths=json.dumps([shards[0], shards[2]]), epochs=2, per_batch=3).load()
    for _ in range(2):  # each takes what is there when it begins: three shards, and after the restart all that are left
        running = stream.drop("error").writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        if not running.awaitTermination(600):
            running.stop()
            raise BlockmillError("the stream does not end")
    return spark.read.schema("doc_id long, shard_pos int, row_index long, epoch int").parquet(out)


@query("""
with s as (select source, row_number() over (order by source) - 1 as k from (select distinct source from documents))
select source, epoch, row_number() over (partition by epoch order by md5('3:' || epoch || ':' || k), k) - 1 as place from s, (values (7), (8)) as e(epoch)""")
def shard_orders(spark, sf):
    """The places of the sources, as shards, in two epochs."""
    names = [r.source for r in docs(spark, sf).select("source").distinct().orderBy("source").collect()]  # a name a shard, as a list of shards is
    rows = [(name, epoch, place) for epoch in (7, 8) for place, name in enumerate(shuffle.shard_order(names, 3, epoch))]
    return spark.createDataFrame(rows, "source string, epoch int, place long")


@query("select item_id, len(string_split(text, ' '))::bigint as n_tokens, list_sum(list_transform(string_split(text, ' '), lambda w: len(w)))::bigint as total from benchmark")
def tokenize_custom(spark, sf):
    """A user's own encoder: of each word its length."""
    rows = text.tokenize(spark.read.parquet(f"{sf}/benchmark.parquet"), lambda: lambda texts: [[len(w) for w in t.split(" ")] for t in texts])
    return rows.select("item_id", F.size("tokens").cast("long").alias("n_tokens"), F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("select * from (values ('old', 3), ('new', 8), ('newer', 9), ('new', 8), ('largest', 9), ('size', 6)) as v(what, id)")
def special_tokens(spark, sf):
    v = text.Vocabulary({"a": 0, "b": 7, "c": 2}, {"old": 3})
    rows = [(t, v.add_special(t)) for t in ("old", "new", "newer", "new")]
    return spark.createDataFrame([*rows, ("largest", v.max_token), ("size", len(v))], "what string, id int")


_DESCS = [("2 3", "F32", "Float"), ("", "I64", "Int"), (" 4  5 6", "Bool", "Bool"), ("7", "BF16", "Float"), ("2 x", "F32", "Float"), ("1", "F31", "Float"), ("1", "F32", "Real")]


@query("""select * from (values ('2 3', 2, 6, 24, 'ok'), ('', 0, 1, 8, 'ok'), ('4 5 6', 3, 120, 120, 'ok'), ('7', 1, 7, 14, 'ok'),
('2 x', -1, -1, -1, 'Invalid shape: 2 x'), ('1', -1, -1, -1, 'Invalid dtype: F31'), ('1', -1, -1, -1, 'Invalid kind: Real')) as v(shape, rank, n_elements, n_bytes, outcome)""")
def parse_descs(spark, sf):
    """Shapes, element types and kinds from their texts, good and bad."""
    out = []
    for shape, dtype, kind in _DESCS:
        try:
            t = tensors.TensorDesc(tensors.parse_kind(kind), tensors.parse_dtype(dtype), tuple(tensors.shape_from_text(shape)))
            out.append((tensors.shape_to_text(list(t.shape)), t.rank, t.num_elements, t.size_estimate, "ok"))
        except BlockmillError as e:
            out.append((shape, -1, -1, -1, str(e)))
    return spark.createDataFrame(out, "shape string, rank int, n_elements int, n_bytes int, outcome string")


@query("""select * from (values ('Vec', 'builtin', 'Vec', true), ('Array', 'builtin', 'Array', true), ('Tuple', 'builtin', 'Tuple', true), ('Thingy', 'builtin', 'Thingy', false),
('Struct:Foo', 'struct', 'Foo', false), ('Enum:Foo', 'enum', 'Foo', false)) as v(type, class, name, is_sequence)""")
def container_types(spark, sf):
    rows = spark.createDataFrame([(t, tensors.is_sequence(tensors.parse_container(t)[1])) for t in ("Vec", "Array", "Tuple", "Thingy", "Struct:Foo", "Enum:Foo")], "type string, is_sequence boolean")
    return rows.select("type", tensors.container_class(F.col("type")).alias("class"), tensors.container_name(F.col("type")).alias("name"), "is_sequence")


@query("select * from (values (0, '0.0 B'), (1023, '1023.0 B'), (1536, '1.5 KiB'), (5242880, '5.0 MiB'), (3221225472, '3.0 GiB'), (2251799813685248, '2048.0 TiB')) as v(n, shown)")
def human_sizes(spark, sf):
    return spark.createDataFrame([(n, training.human_size(n)) for n in (0, 1023, 1536, 5242880, 3221225472, 2251799813685248)], "n long, shown string")


@query("select item_id, (row_number() over (partition by item_id order by i) - 1)::int as pos, token from (select item_id, unnest(tokens) as token, generate_subscripts(tokens, 1) as i from (select item_id, list_transform(range(1, strlen(text) + 1), lambda i: ('0x' || substr(hex(encode(text)), (2 * i - 1)::int, 2))::int) as tokens from benchmark))")
def flatten_tokens(spark, sf):
    rows = spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", text.byte_tokens(F.col("text")).alias("tokens"))
    return training.flatten(rows, "item_id").select("item_id", "pos", "token")


@query("""
select vec_id::varchar as param_id, label::int as group_idx, round(list_sum(list_transform(embedding, lambda x: x::double - 0.1::double * (x::double + case when vec_id % 2 = 0 then 2 * x::double else 0 end))), 6) as total,
  1.0::double as state
from embeddings where label < 5""")
def group_update_multi(spark, sf):
    """The gradients of two devices added, a step for all groups, and the state saved and loaded."""
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("param_id"), "vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("value"))
    member = v.where("label < 5").select("param_id", F.lit(0).alias("type_tag"), F.col("label").alias("group_idx"))
    one = v.select("param_id", F.col("value").alias("grad"))
    two = v.where("vec_id % 2 = 0").select("param_id", F.transform("value", lambda x: 2 * x).alias("grad"))
    none = spark.createDataFrame([], "type_tag int, group_idx int, param_id string, state double")
    out = groups.step_multi(v.select("param_id", "value"), [one, two], member, none, lambda x, g, s: (F.zip_with(x, g, lambda a, b: a - 0.1 * b), F.coalesce(s, F.lit(0.0)) + 1))
    path = new_path(spark, "record")
    groups.save_record(groups.to_record(out, member), path)
    kept = groups.load_record(spark, path, member)
    total = F.round(F.aggregate("value", F.lit(0.0), lambda a, x: a + x), 6)
    return out.select("param_id", total.alias("total")).join(kept.select("param_id", "group_idx", "state"), "param_id")


@query("select 'no chosen parameters' as message union all select 'no other parameters' union all select 'parameter b is in group (0, 0) and in group (1, 1)'")
def group_errors(spark, sf):
    ids = spark.createDataFrame([("a",), ("b",)], "param_id string")
    out = []
    for f in (lambda: groups.split(ids, ids.limit(0)), lambda: groups.split(ids, ids), lambda: groups.check_disjoint(groups.assign(spark, [[["a", "b"]], [["z"], ["b"]]]))):
        try:
            f()
        except (Invalid, BlockmillError) as e:
            out.append((str(e),))
    return spark.createDataFrame(out, "message string")
