import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockmill.errors import DuplicateParamId, External, Invalid, ParseError, ResourceNotFound
from blockmill.functions import tensors, training
from blockmill.operators import groups, packing, shuffle, text
from blockmill.plans import moduletree as mt
from blockmill.plans.loader import CorpusLoader, to_blocks
from blockmill.sources import shards
from blockmill.streaming.blocks import Packer, pack_stream, text_stats

SF = "/root/testdata/sf0.001"


def test_source_defaults():
    s = shards.ShardSource()
    assert (s.format_index(0), s.format_index(312), s.format_index(1234567)) == ("00000", "00312", "1234567")
    assert s.format_shard_filename(0) == "shard_00000.parquet" and s.max_shard == 1822


def test_cache(tmp_path, spark):
    far, near = tmp_path / "far", tmp_path / "near"
    far.mkdir()
    for k in (0, 12, 312, 1821):
        spark.createDataFrame([(k, "x")], "n int, text string").toPandas().to_parquet(far / f"shard_{k:05d}.parquet")
    cache = shards.ShardCache(str(near), shards.ShardSource(base_url=str(far)))
    with pytest.raises(ResourceNotFound, match="shard 12 not found"):
        cache.try_shard_path(12)
    assert cache.load_shards([312, 0, 312]) == [cache.format_shard_path(k) for k in (312, 0, 312)]
    assert cache.get_shard(1821, download=True) and not cache.has_shard(12)
    assert cache.list_cached_shard_ids() == [0, 312, 1821]
    assert cache.list_cached_shard_paths() == sorted(map(cache.format_shard_path, (0, 312, 1821)))
    assert cache.read_cached_batches(spark, 312).first().n == 312 and cache.read_batches(spark, 12, True).first().n == 12
    assert cache.catalog(spark).where("cached").count() == 4
    with pytest.raises(FileNotFoundError):
        cache.load_shard(5)
    assert not cache.has_shard(5)
    rows = shards.read_shards(spark, cache.load_shards([312, 0])).orderBy("shard_pos", "row_index").collect()
    assert [(r.n, r.shard_pos, r.row_index) for r in rows] == [(312, 0, 0), (0, 1, 0)]
    (near / "other.parquet").write_text("")
    with pytest.raises(Invalid):
        cache.list_cached_shard_ids()


def test_shard_arguments_and_split():
    assert shards.parse_shards("0", 9) == [0] and shards.parse_shards("..8", 9) == list(range(8))
    assert shards.parse_shards("5..,0..2,1", 9) == [0, 1, 5, 6, 7, 8] and shards.parse_shards("2..=3", 9) == [2, 3]
    for bad in ("x", "3..2", "..10", "-1", "1..="):
        with pytest.raises(Invalid):
            shards.parse_shards(bad, 9)
    assert shards.train_val_split(list(range(25))) == (list(range(22)), [22, 23, 24])
    assert shards.train_val_split([1]) == ([], [1])
    with pytest.raises(Invalid):
        shards.train_val_split([])


def test_text(spark):
    df = spark.createDataFrame([(1, "é a1!"), (2, None), (3, "")], "k int, text string")
    rows = text.select_text(df, keep=("k",)).withColumn("n", text.byte_length(F.col("text"))).withColumn("b", text.byte_tokens(F.col("text"))).collect()
    assert [(r.k, r.n, r.b) for r in rows] == [(1, 6, list("é a1!".encode())), (3, 0, [])]
    seen, counters = text.watch(df, "w", n=F.count("text"))
    assert seen.count() == 3 and counters.get == {"n": 2}
    encoded = text.tokenize(df, lambda: lambda texts: [[len(t)] for t in texts]).orderBy("k").collect()
    assert [r.tokens for r in encoded] == [[5], None, [0]]


def test_vocabulary():
    v = text.Vocabulary({"a": 0, "b": 5}, {"<x>": 7})
    assert v.add_special("<x>") == 7 and v.add_special("<bos>") == 8 and v.add_special("<bos>") == 8 and len(v) == 4


def literal(batches, o):
    """The rule word by word: fill, look for the shortest, cut."""
    source, buffer, rows, row = iter(batches), [], [], []
    while True:
        while len(buffer) < o.min_buffer:
            more = next(source, None)
            if more is None:
                break
            buffer += more
        if not buffer:
            return rows
        best = min(range(len(buffer)), key=lambda k: len(buffer[k]))
        seq = buffer.pop(best)
        row += o.bos
        row += seq[: o.seq_len - len(row)]
        row += o.eos[: o.seq_len - len(row)]
        if len(row) == o.seq_len:
            rows.append(row)
            row = []


def sequences(rng):
    n = 0
    out = []
    for _ in range(rng.randrange(1, 5)):
        out.append([[100 * (n := n + 1) + j for j in range(rng.randrange(0, 15))] for _ in range(rng.randrange(0, 6))])
    return out


def test_packing_equals_the_literal_rule():
    rng = random.Random(1)
    for _ in range(2000):
        o = packing.PackOptions(rng.randrange(1, 4), rng.randrange(1, 13), rng.randrange(0, 9), tuple([9] * rng.randrange(2)), tuple([8] * rng.randrange(3)))
        batches = sequences(rng)
        flat = [s for b in batches for s in b]
        places, k = [], 0
        for b in batches:
            places.append([(len(s), k + j) for j, s in enumerate(b)])
            k += len(b)
        rows = {}
        for arrival, row, _, take, tail in packing.place(packing.pick_order(places, o.min_buffer), o):
            rows.setdefault(row, []).extend([*o.bos, *flat[arrival][:take], *o.eos[:tail]])
        assert [r for r in rows.values() if len(r) == o.seq_len] == literal(batches, o)


def test_blocks_drop_last_and_bos(spark):
    rng = random.Random(2)
    batches = [[[rng.randrange(250) for _ in range(rng.randrange(20))] for _ in range(30)] for _ in range(3)]
    rows = [(30 * b + j, b, s) for b, part in enumerate(batches) for j, s in enumerate(part)]
    o = packing.PackOptions(3, 16, 10, (256,), (257,))
    df = spark.createDataFrame(rows, "arrival long, batch int, tokens array<int>")
    want = literal(batches, o)
    want = want[: len(want) // 3 * 3]
    got = packing.blocks(df, o).orderBy("batch_id", "row_in_batch").collect()
    assert [r.tokens for r in got] == want and [3 * r.batch_id + r.row_in_batch for r in got] == list(range(len(want)))
    by = packing.blocks(df.withColumn("g", F.lit("one")), o, "g")
    assert sorted(r.tokens for r in by.collect()) == sorted(want)
    assert [len(b.rows) for b in to_blocks(packing.blocks(df, o)).collect()] == [3] * (len(want) // 3)
    with pytest.raises(Invalid):
        list(packing.place([(0, 0)], packing.PackOptions(1, 1, 1, (1, 2))))
    assert packing.blocks(df, packing.PackOptions(3, 16, 0)).count() == 0


def test_buffered_shuffle_bounds(spark):
    rng = random.Random(3)
    for _ in range(200):
        size = rng.randrange(2, 13)
        fill = rng.randrange(1, size + 1)
        out = list(shuffle.buffered(range(60), fill, size, seed=rng.randrange(9)))
        assert sorted(out) == list(range(60))
        assert all(p < i + min((i + 1) * fill, size) for i, p in enumerate(out))
    assert list(shuffle.buffered(range(10))) == list(shuffle.buffered(range(10)))
    for bad in ((0, 5), (6, 5), (1, 1)):
        with pytest.raises(Invalid):
            list(shuffle.buffered([], *bad))
    for n in (0, 1, 7, 8, 50, 128, 129, 700):
        got = shuffle.buffered_shuffle(spark.range(n).repartition(3), "id", seed=4, steps=64).orderBy("position").collect()
        assert [r.id for r in got] == list(shuffle.buffered(range(n), seed=4)), n
        assert [r.position for r in got] == list(range(n))
    df = spark.range(90).selectExpr("id as k", "case when id % 3 > 0 then id % 3 end as item")
    got = shuffle.buffered_shuffle(df, "k", 2, 5, seed=1, group="item", steps=4).collect()
    for g in (None, 1, 2):
        of = [r.k for r in sorted(got, key=lambda r: r.position) if r.item == g]
        assert of == list(shuffle.buffered([k for k in range(90) if k % 3 == (g or 0)], 2, 5, seed=1))


def test_row_numbers_of_large_and_repeated_values(spark):
    top = (1 << 60) + 1
    df = spark.range(3000).selectExpr(f"case when id < 500 then null when id < 2500 then {top} else {top} + id end as v", "id as _tie", "id as row")
    got = shuffle.global_index(df.repartition(5), "v", range_rows=100).collect()
    assert sorted(r.row_no for r in got) == list(range(3000))
    assert all((r.row < 500) == (r.row_no < 500) and (r.row < 2500) == (r.row_no < 2500) for r in got)
    assert all(r.row == r.row_no for r in got if r.row >= 2500)
    ranges = spark.read.parquet(*[f for f in shuffle.global_index(df, "v", range_rows=100).inputFiles()]).groupBy("_part").count().collect()
    assert max(r["count"] for r in ranges) < 400
    by = shuffle.global_index(df, "row", group="v", range_rows=100).collect()
    assert sorted(r.row_no for r in by if r.v is None) == list(range(500)) and all(r.row_no == r.row - 500 for r in by if r.v == top)


@pytest.mark.parametrize("min_buffer", [1, 2, 7, 30, 1000])
def test_parallel_packing_equals_the_literal_rule(spark, min_buffer):
    """Groups of many shapes in one frame, cut into small chunks; batches larger than a chunk, ties, a null group, an end that is cut."""
    rng = random.Random(min_buffer)
    o = packing.PackOptions(2, rng.randrange(5, 40), min_buffer, (9,), tuple([8] * rng.randrange(3)))
    rows, want = [], {}
    for g in range(25):
        n, per, top = rng.randrange(1, 150), rng.choice([1, 3, 7, 200]), rng.choice([3, 60])
        sizes, name = [rng.randrange(top) for _ in range(n)], f"g{g}" if g else None
        rows += [(name, k, k // per, size) for k, size in enumerate(sizes)]
        batches = [[(sizes[k], k) for k in range(a, min(a + per, n))] for a in range(0, n, per)]
        want[name] = [(p, *x) for p, x in enumerate(packing.place(packing.pick_order(batches, min_buffer), o))]
    got: dict = {}
    for r in packing.plan(spark.createDataFrame(rows, "part string, arrival long, batch long, length long"), o, "part", chunk=16).collect():
        got.setdefault(r.part, []).append((r.pick, r.arrival, r.row, r.off, r.take, r.tail))
    assert {g: sorted(v) for g, v in got.items()} == want


@pytest.mark.parametrize("min_buffer", [1, 2, 7, 30, 1000])
def test_one_batch_a_pick(spark, min_buffer):
    """The same groups with one batch admitted before a pick: batches of one sequence, small ones that take long to fill the buffer, large ones."""
    rng = random.Random(min_buffer + 1)
    o = packing.PackOptions(2, rng.randrange(5, 40), min_buffer, (9,), one_a_pick=True)
    rows, want, other = [], {}, {}
    for g in range(25):
        n, per, top = rng.randrange(1, 150), rng.choice([1, 2, 3, 7, 200]), rng.choice([3, 60])
        name, batches = f"g{g}" if g else None, []
        for k in range(n):
            size = rng.randrange(top)
            rows.append((name, k, k // per, size))
            if k % per == 0:
                batches.append([])
            batches[-1].append((size, k))
        want[name], other[name] = ([(p, *x) for p, x in enumerate(packing.place(packing.pick_order(batches, min_buffer, one), o))] for one in (True, False))
    got: dict = {}
    for r in packing.plan(spark.createDataFrame(rows, "part string, arrival long, batch long, length long"), o, "part", chunk=16).collect():
        got.setdefault(r.part, []).append((r.pick, r.arrival, r.row, r.off, r.take, r.tail))
    assert {g: sorted(v) for g, v in got.items()} == want
    assert want != other or min_buffer < 3


def test_dense_blocks_of_several_batches_agree_with_sql(spark, tmp_path):
    """A source has few documents in each arrival batch, so that several are admitted before 512 wait."""
    import duckdb

    from blockmill.plans import registry

    docs = spark.range(0, 60_000, 17).selectExpr("id as doc_id", "concat('src', id % 3) as source", "repeat('ab', cast(1 + pmod(xxhash64(id), 90) as int)) as text")
    docs.toPandas().to_parquet(tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    cols = "source, batch_id, row_in_batch, n_tokens, total"
    want = sorted(con.sql(f"select {cols} from ({registry.SQL['dense_blocks']})").fetchall())
    got = registry.QUERIES["dense_blocks"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in got.select(*cols.split(", ")).collect()) == want and len(want) > 100


def test_tables_of_fills():
    rng = random.Random(2)
    for _ in range(2000):
        o = packing.PackOptions(2, rng.randrange(2, 30), 3, tuple([9] * rng.randrange(3)), tuple([8] * rng.randrange(3)))
        sizes = [rng.randrange(40) for _ in range(rng.randrange(1, 60))]
        fill, full = packing.table(np.array(sizes), o)
        k = rng.randrange(len(sizes))
        if k:
            halves = packing.compose(*(packing._packed(*packing.table(np.array(s), o)) for s in (sizes[:k], sizes[k:])))
            assert (packing._unpacked(halves)[0] == fill).all() and (packing._unpacked(halves)[1] == full)[fill >= 0].all()
        start = rng.randrange(o.seq_len)
        try:
            *_, (_, row, off, take, tail) = packing.place([(size, 0) for size in sizes], o, 0, start)
        except Invalid:
            assert fill[start] == packing.BAD
            continue
        end = off + len(o.bos) + take + tail
        assert (fill[start], full[start]) == ((0, row + 1) if end >= o.seq_len else (end, row))


def test_hashed_orders(spark):
    df = spark.range(100)
    a, b = ([r.id for r in shuffle.hash_shuffle(x, "id", seed=1).collect()] for x in (df, df.repartition(7)))
    assert a == b and sorted(a) == list(range(100)) and a != [r.id for r in shuffle.hash_shuffle(df, "id", seed=2).collect()]
    assert shuffle.shard_order(range(9), 1, 0) == shuffle.shard_order(range(9), 1, 0) != shuffle.shard_order(range(9), 1, 1)


@pytest.mark.parametrize("n", [0, 1, 7, 1024])
def test_rebatch(spark, n):
    got = sorted((r.batch_id, r.row_in_batch, r.id) for r in shuffle.rebatch(spark.range(n).repartition(3), "id", 10).collect())
    assert got == [(k // 10, k % 10, k) for k in range(n)]


def linear(a, b, n):
    return mt.Module("Struct:Linear", {"weight": mt.Param(f"P{n}", (a, b)), "bias": mt.Param(f"P{n + 1}", (b,))})


def test_linear_tree(spark):
    t = mt.ModuleTree.build(spark, linear(2, 3, 1))
    assert t.to_xml() == (
        '<XmlModuleTree version="0.1"><Structure><Linear id="n:1" class="struct"><Param id="n:2" name="weight" param_id="P1" class="tensor" kind="Float" dtype="F32" shape="2 3" rank="2"/>'
        '<Param id="n:3" name="bias" param_id="P2" class="tensor" kind="Float" dtype="F32" shape="3" rank="1"/></Linear></Structure></XmlModuleTree>'
    )
    assert t.to_xml(True).endswith("</XmlModuleTree>\n") and "\n    <Linear" in t.to_xml(True)
    ids = lambda q: [r.id for r in q.to_df().orderBy("pre").collect()]
    assert t.query().expr == "/XmlModuleTree/Structure" and [r.elem for r in t.query().to_df().collect()] == ["Structure"]
    assert ids(t.query().params()) == ["n:2", "n:3"] and ids(t.select("Linear")) == ids(t.select("*")) == ["n:1"]
    assert ids(t.select("Linear/*[@name='weight']")) == ids(t.select("Linear").named_children("weight")) == ["n:2"]
    assert ids(t.select("Linear/*[2]")) == ids(t.select("Linear").indexed_children(1)) == ["n:3"]
    assert ids(t.query().params().filter("@rank=2")) == ids(t.query().params().rank(2)) == ["n:2"]
    assert t.param_ids() == ["P1", "P2"] and t.param_descs()[0].tensor.size_estimate == 24
    assert t.select("Linear/*[2]").to_fragments() == [t.fragment(3)]
    for bad in ("Linear[", "a/[1]", "Linear[@@x]", "Linear[@nothing=1]", "", "a b"):
        with pytest.raises(ParseError):
            t.select(bad)
    with pytest.raises(ResourceNotFound):
        mt.desc_of({"param_id": "p", "kind": None, "dtype": "F32", "shape": "1"})


def test_composite_tree(spark):
    t = mt.ModuleTree.build(spark, mt.Module("Tuple", [linear(2, 3, 1), mt.Module("Array", [linear(4, 5, 3)]), mt.Module("Vec", [linear(6, 7, 5), linear(8, 9, 7)]), mt.Module("Struct:Empty")]))
    ids = lambda q: [r.id for r in q.to_df().orderBy("pre").collect()]
    assert len(t.nodes) == 15 and t.nodes[-1]["id"] == "n:F"
    assert ids(t.select("*//Linear")) == ["n:2", "n:6", "n:A", "n:D"]
    assert ids(t.query().params().filter("@rank=2")) == ["n:3", "n:7", "n:B", "n:E"]
    assert ids(t.select("*/Vec/*[last()]")) == ["n:D"] and ids(t.select("Tuple/*[2]/*[1]/*[2]")) == ["n:8"]
    assert not any(n["name"] for n in t.nodes if n["elem"] == "Linear")
    # Spark's own XPath over the serialised tree agrees
    for path in ("*//Param[@rank=2]", "Tuple/Vec/*/*[1]", "*/descendant-or-self::Param[@name='bias']"):
        q = t.select(path)
        theirs = spark.range(1).select(F.xpath(F.lit(t.to_xml()), F.lit(f"{q.expr}/@param_id")).alias("x")).first().x
        assert sorted(theirs) == sorted(q.to_param_ids())


def test_scalars(spark):
    assert tensors.shape_to_text([2, 3, 4]) == "2 3 4" and tensors.shape_from_text("") == [] and tensors.shape_from_text(" 2  3") == [2, 3]
    for bad in ("a", "-1", "2 x"):
        with pytest.raises(External, match="Invalid shape"):
            tensors.shape_from_text(bad)
    with pytest.raises(External, match="Invalid dtype"):
        tensors.parse_dtype("F31")
    with pytest.raises(External):
        tensors.parse_kind("Real")
    assert [tensors.parse_container(x) for x in ("Vec", "Struct:Foo", "Enum:Foo")] == [("builtin", "Vec"), ("struct", "Foo"), ("enum", "Foo")]
    assert [tensors.is_sequence(x) for x in ("Vec", "Array", "Tuple", "Thingy")] == [True, True, True, False]
    d = tensors.TensorDesc("Float", "F32", (2, 3))
    assert (d.rank, d.num_elements, d.size_estimate) == (2, 6, 24) and tensors.TensorDesc("Int", "I8", ()).num_elements == 1
    row = spark.createDataFrame([("Struct:Foo", "2 3", "F16", 255)], "c string, s string, d string, n long").select(
        tensors.container_class(F.col("c")).alias("a"), tensors.container_name(F.col("c")).alias("b"), tensors.shape_array(F.col("s")).alias("s"), tensors.size_estimate(F.col("d"), tensors.shape_array(F.col("s"))).alias("z"), tensors.node_id(F.col("n")).alias("i")
    ).first()
    assert tuple(row) == ("struct", "Foo", [2, 3], 12, "n:FF")


def test_maths(spark):
    row = spark.createDataFrame([([1, 2, 3], [-3.0, 0.5, 40.0])], "t array<int>, x array<double>").select(
        training.inputs(F.col("t")).alias("a"), training.targets(F.col("t")).alias("b"), training.clip(F.col("x"), 2.0).alias("c"), training.relu_squared(F.col("x")).alias("d"), training.softcap(F.col("x")).alias("e"), training.cross_entropy(F.col("x"), F.lit(1)).alias("f")
    ).first()
    assert row.a == [1, 2] and row.b == [2, 3] and row.c == [-2.0, 0.5, 2.0] and row.d == [0.0, 0.25, 1600.0]
    assert row.e[2] == pytest.approx(15, abs=0.2) and row.f == pytest.approx(39.5)
    c = training.GptConfig()
    assert (c.init_seq_len, c.vocab_size, c.n_layer, c.n_head, c.n_kv_head, c.n_embed, c.expansion) == (1024, 50304, 12, 6, 6, 768, 4)
    assert c.flops_per_token(100, 40) == 360 + 113_246_208 and (c.head_dim, c.hidden_size, c.max_seq_len) == (128, 3072, 10240)
    assert training.human_size(1536) == "1.5 KiB" and training.learning_rate(0, 1.0, 100) == pytest.approx(1e-10)


def test_groups(spark):
    ok = groups.assign(spark, [[["a"], ["b"]], [["c"]]])
    assert groups.check_disjoint(ok) is ok
    with pytest.raises(DuplicateParamId) as e:
        groups.check_disjoint(groups.assign(spark, [[["a", "b"]], [["z"], ["b"]]]))
    assert (e.value.param_id, e.value.first, e.value.second) == ("b", (0, 0), (1, 1))
    with pytest.raises(Invalid):
        groups.split(ok, ok)
    params = spark.createDataFrame([("a", [1.0]), ("b", [1.0]), ("x", [1.0])], "param_id string, value array<double>")
    grads = spark.createDataFrame([("a", [9.0]), ("x", [9.0])], "param_id string, grad array<double>")
    state = spark.createDataFrame([(0, 0, "a", 5.0)], "type_tag int, group_idx int, param_id string, state double")
    out = groups.step(params, grads, ok, state, lambda v, g, s: (F.zip_with(v, g, lambda x, y: x - y), s + 1), clip_at=2.0)
    assert {r.param_id: (r.value, r.state, r.updated) for r in out.collect()} == {"a": ([-1.0], 6.0, True), "b": ([1.0], None, False), "x": ([1.0], None, False)}


def test_loader(spark, tmp_path):
    paths = []
    for k in range(3):
        p = str(tmp_path / f"shard_{k:05d}.parquet")
        spark.range(40).select(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), k + 1)).alias("text")).toPandas().to_parquet(p)
        paths.append(p)
    loader = CorpusLoader(spark, tuple(paths), packing.PackOptions(2, 16, 8, (256,)), seed=7)
    assert loader.num_items == 3 and loader.slice(1, 3).num_items == 2
    epoch = loader.start_epoch(1)
    rows = epoch.blocks.collect()
    s = epoch.stats()
    assert rows and all(len(r.tokens) == 16 for r in rows)
    assert s["progress"] == (3, 3) and s["token_count"] == 16 * len(rows) and s["byte_count"] == sum(len(f"text {str(i) * (k + 1)}") for k in range(3) for i in range(40))
    assert "3/3 files" in epoch.report()
    again = loader.start_epoch(1).blocks.collect()
    assert [r.tokens for r in again] == [r.tokens for r in rows] != [r.tokens for r in loader.start_epoch(2).blocks.collect()]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rng = random.Random(5)
    batches = []
    for b in range(3):
        part = [(30 * b + j, [rng.randrange(250) for _ in range(rng.randrange(20))]) for j in range(30)]
        batches.append(part)
        spark.createDataFrame([("g", a, t, "é") for a, t in part], "g string, arrival long, tokens array<int>, text string").coalesce(1).write.parquet(str(src / f"b{b}"))
    o = packing.PackOptions(1, 16, 10, (256,))
    schema = "g string, arrival long, tokens array<int>, text string"
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    for df, name, mode in ((pack_stream(stream, "g", o), "packed", "append"), (text_stats(stream), "stats", "complete")):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    packer, want = Packer(), []
    for part in batches:
        want += [r for _, r in packer.add(part, o)]
    assert sorted(r.tokens for r in spark.table("packed").collect()) == sorted(want)
    s = spark.table("stats").first()
    assert (s.n_texts, s.n_bytes) == (90, 180)


def test_stream_with_an_end_equals_the_batch(spark, tmp_path):
    """The end is in the last batch's own rows for one group, in a row of its own for the other; the tail comes out, and the state goes."""
    rng, src = random.Random(6), tmp_path / "in"
    o = packing.PackOptions(1, 16, 10, (256,))
    rows = {"a": [], "b": []}
    src.mkdir()
    for b in range(3):
        part = [(g, 30 * b + j, [rng.randrange(250) for _ in range(rng.randrange(20))], b == 2 and g == "a" and j == 29) for g in "ab" for j in range(30)]
        for g, a, t, _ in part:
            rows[g].append((a, b, t))
        part += [("b", 90, None, True)] if b == 2 else []
        spark.createDataFrame(part, "g string, arrival long, tokens array<int>, done boolean").coalesce(1).write.parquet(str(src / f"b{b}"))
    stream = spark.readStream.schema("g string, arrival long, tokens array<int>, done boolean").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = pack_stream(stream, "g", o, "done").writeStream.format("memory").queryName("ended").option("checkpointLocation", str(tmp_path / "kept")).start()
    q.processAllAvailable()
    left = q.lastProgress["stateOperators"][0]["numRowsTotal"]
    q.stop()
    flat = [(g, a, b, t) for g, of in rows.items() for a, b, t in of]
    want = packing.blocks(spark.createDataFrame(flat, "g string, arrival long, batch long, tokens array<int>"), o, "g").collect()
    assert sorted((r.g, r.row, r.tokens) for r in spark.table("ended").collect()) == sorted((r.g, r.batch_id, r.tokens) for r in want) and left == 0


def test_queries_agree_with_sql(spark):
    import duckdb

    from blockmill.plans import registry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{SF}/{f}')")
    for name, sql in registry.SQL.items():
        mine, theirs = registry.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        cols = sorted(mine.columns)
        assert cols == sorted(theirs.columns), name
        a, b = (sorted(map(str, x[cols].itertuples(index=False, name=None))) for x in (mine, theirs))
        assert a == b, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_shards_of_every_kind_of_path(spark, tmp_path):
    """Plain files, folders of part files, names with blanks and signs, relative paths, and a path listed twice."""
    import pandas as pd

    plain, odd, folder, many = tmp_path / "a.parquet", tmp_path / "b c+%d é.parquet", tmp_path / "folder x", tmp_path / "nested"
    pd.DataFrame({"n": [1, 2]}).to_parquet(plain)
    pd.DataFrame({"n": [3]}).to_parquet(odd)
    spark.range(10, 16).selectExpr("id as n").repartition(3).write.parquet(str(folder))
    many.mkdir()
    pd.DataFrame({"n": [20]}).to_parquet(many / "a.parquet")
    paths = [str(folder), str(odd), str(plain), f"file://{many}", str(odd)]
    rows = shards.read_shards(spark, paths).collect()
    by = {}
    for r in rows:
        by.setdefault(r.shard_pos, []).append((r.row_index, r.n))
    assert sorted(n for _, n in by[0]) == list(range(10, 16)) and sorted(k for k, _ in by[0]) == list(range(6))
    assert by[1] == by[4] == [(0, 3)] and sorted(by[2]) == [(0, 1), (1, 2)] and by[3] == [(0, 20)]
    os.chdir(tmp_path)
    assert {(r.shard_pos, r.n) for r in shards.read_shards(spark, [str(plain), str(odd)]).collect()} == {(0, 1), (0, 2), (1, 3)}


def test_packing_makes_tokens_once(spark):
    """One fold, whose lengths are staged, and one scan of the texts for their tokens."""
    plan = __import__("blockmill.plans.registry", fromlist=["x"]).QUERIES["dense_blocks"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    body = plan.split("Initial Plan")[-1]
    assert body.count("FlatMapGroupsInPandas") == 1 and body.count("FlatMapCoGroupsInPandas") == 1
    assert body.count("decode(") <= 1 and sum("Scan parquet" in line and "text" in line.split("]")[0] for line in body.splitlines()) == 1


def test_tokenizer_of_a_file(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.BPE({"a": 0, "b": 1, "ab": 2, "c": 3}, [("a", "b")]))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.add_special_tokens(["<s>"])
    path = str(tmp_path / "t.json")
    t.save(path)
    df = spark.createDataFrame([(1, "ab c"), (2, None), (3, "")], "id int, text string")
    assert {r.id: r.tokens for r in text.tokenize(df, text.file_encoder(path)).collect()} == {1: [2, 3], 2: None, 3: []}
    v = text.Vocabulary.load(path)
    assert v.tokens["ab"] == 2 and v.special == {"<s>": 4} and v.max_token == 4 and v.add_special("<s>") == 4 and v.add_special("<e>") == 5
    (tmp_path / "r.tiktoken").write_text("YQ== 0\nYg== 1\n")
    assert text.Vocabulary.load(str(tmp_path / "r.tiktoken")).tokens == {"a": 0, "b": 1}
    one = str(tmp_path / "one.parquet")
    spark.createDataFrame([("ab c " * 9,)] * 6, "text string").toPandas().to_parquet(one)
    loader = CorpusLoader(spark, (one,), packing.PackOptions(1, 18, 2), encoder=text.file_encoder(path))
    epoch = loader.start_epoch()
    assert [r.tokens for r in epoch.blocks.collect()] == [[2, 3] * 9] * 6 and epoch.stats()["token_count"] == 108
    epoch.close()


def test_shard_source_and_errors(spark, tmp_path):
    """A list with a corrupt, a missing and a clashing shard: rows of the good ones in order, an error each of the others; slices; failing."""
    import json

    from blockmill.sources.shardlist import ShardList

    good = spark.createDataFrame([(k, f"t{k}") for k in range(30)], "n long, text string").repartitionByRange(3, "n").sortWithinPartitions("n")
    good.write.parquet(str(tmp_path / "parts"))
    good.toPandas().to_parquet(tmp_path / "one.parquet")
    spark.createDataFrame([("x", "y")], "n string, text string").toPandas().to_parquet(tmp_path / "clash.parquet")
    spark.createDataFrame([], "n long, text string").write.parquet(str(tmp_path / "none"))
    (tmp_path / "bad.parquet").write_bytes(b"PAR1 no file")
    paths = [str(tmp_path / p) for p in ("parts", "bad.parquet", "one.parquet", "gone.parquet", "clash.parquet", "none", "one.parquet")]
    want = sorted((k, pos, k) for pos in (0, 2, 6) for k in range(30))
    rows, errors = shards.scan_shards(spark, paths, "n long, text string")
    assert sorted((r.n, r.shard_pos, r.row_index) for r in rows.collect()) == want
    assert [(r.shard_pos, r.kind) for r in errors.orderBy("shard_pos").collect()] == [(1, "corrupt"), (3, "missing"), (4, "schema")]
    rows, errors = shards.scan_shards(spark, paths[3:5], "n long")
    assert rows.count() == 0 and errors.count() == 2
    spark.dataSource.register(ShardList)
    source = lambda **o: spark.read.format("blockmill_shards").options(paths=json.dumps(paths), **o)
    got = source(on_error="row").load().collect()
    assert sorted((r.n, r.shard_pos, r.row_index) for r in got if r.error is None) == want
    assert sorted((r.shard_pos, r.error.split(":")[0]) for r in got if r.error) == [(1, "ArrowInvalid"), (3, "FileNotFoundError"), (4, "Invalid")]
    assert source(shards="2,6").load().count() == 60 and source(shards="2").load().rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="no such shard"):
        source(shards="3").schema("n long, error string").load().collect()


def test_large_shards_are_several_partitions(spark, tmp_path):
    """The row groups of a shard's files are dealt to partitions, and rows are numbered on; the texts of the queries' shard are cut by size."""
    import json

    import pyarrow as pa
    import pyarrow.parquet as pq

    from blockmill.plans import source_queries
    from blockmill.sources.shardlist import ShardList

    (tmp_path / "many").mkdir()
    for k in range(3):
        pq.write_table(pa.table({"n": range(40 * k, 40 * k + 40)}), tmp_path / f"many/{k}.parquet", row_group_size=15)
    spark.dataSource.register(ShardList)
    paths = json.dumps([str(tmp_path / "gone"), str(tmp_path / "many")])
    for split, parts in ((1, 10), (1 << 20, 2)):
        rows = spark.read.format("blockmill_shards").schema("n long, shard_pos int, row_index long, error string").options(paths=paths, on_error="row", split_bytes=split).load()
        got = rows.collect()
        assert rows.rdd.getNumPartitions() == parts
        assert sorted((r.n, r.shard_pos, r.row_index) for r in got if r.error is None) == [(k, 1, k) for k in range(120)]
        assert [r.shard_pos for r in got if r.error] == [0]
    texts = spark.range(64).selectExpr("id as k", "repeat('x', 1048576) as text")
    assert source_queries._parts(texts, "k").rdd.getNumPartitions() == 3
    assert source_queries._parts(texts.unionAll(texts).unionAll(texts), "k").rdd.getNumPartitions() == 6


def test_shared_cache(spark, tmp_path):
    far, near = tmp_path / "far", tmp_path / "near"
    far.mkdir()
    for k in (0, 5, 9):
        spark.createDataFrame([(k,)], "n int").toPandas().to_parquet(far / f"shard_{k:05d}.parquet")
    for prefix in ("", "file://"):
        cache = shards.SharedCache(spark, f"{prefix}{near}{len(prefix)}", shards.ShardSource(base_url=f"{prefix}{far}"))
        with pytest.raises(ResourceNotFound, match="shard 5 not found"):
            cache.read([9, 5])
        assert [(r.n, r.shard_pos) for r in cache.read([9, 5], download=True).orderBy("shard_pos").collect()] == [(9, 0), (5, 1)]
        got = cache.fetch(spark.createDataFrame([(5,), (0,), (0,), (3,)], "shard_id long")).orderBy("shard_id").collect()
        assert [(r.shard_id, r.error is None) for r in got] == [(0, True), (3, False)]
        assert [r.shard_id for r in cache.cached().collect()] == [0, 5, 9]
        with pytest.raises(ResourceNotFound, match="shard 3 not fetched"):
            cache.read([3], download=True)
    assert not [f for f in os.listdir(f"{near}0") if "part" in f]


def test_shared_cache_fetches_folders_by_file(spark, tmp_path):
    """A shard that is a folder is fetched a file a task and shows when it is whole; one whose file cannot be fetched does not show."""
    far, near = str(tmp_path / "far"), str(tmp_path / "near")
    for k in (1, 2):
        spark.range(90).selectExpr(f"id + {100 * k} as n").repartitionByRange(5, "n").sortWithinPartitions("n").write.parquet(f"{far}/shard_{k:05d}.parquet")

    def fetch(source: str, target: str) -> None:
        from pyspark import TaskContext

        if "shard_00002" in source and "part-00003" in source:
            raise OSError("torn")
        shards.stream_fetcher(source, target)
        with open(f"{far}/tasks", "a") as f:
            f.write(f"{TaskContext.get().partitionId()}\n")

    cache = shards.SharedCache(spark, near, shards.ShardSource(base_url=far), fetch)
    got = cache.fetch(spark.createDataFrame([(1,), (2,), (3,)], "shard_id long")).orderBy("shard_id").collect()
    assert [(r.shard_id, (r.error or "").split(":")[0]) for r in got] == [(1, ""), (2, "OSError"), (3, "FileNotFoundError")]
    assert len(set(open(f"{far}/tasks").read().split())) == 9
    assert sorted((r.n, r.row_index) for r in cache.read([1]).collect()) == [(100 + k, k) for k in range(90)]
    assert os.listdir(near) == ["shard_00001.parquet"]


def test_sink_publishes_whole_epochs_once(spark, tmp_path):
    from blockmill.plans import sink

    o, root = packing.PackOptions(2, 4, 0), str(tmp_path / "sink")
    block = lambda n: spark.range(8 * n).selectExpr("id div 8 as batch_id", "cast(id % 8 div 4 as int) as row_in_batch", "cast(id as int) as t").groupBy("batch_id", "row_in_batch").agg(F.sort_array(F.collect_list("t")).alias("tokens"))
    with pytest.raises(ResourceNotFound):
        sink.read(spark, root)
    assert sink.publish(block(3), root, 0, o)["tokens"] == 24
    first = sink.read(spark, root)
    assert sink.publish(block(5), root, 1, o)["blocks"] == 5 and sink.published(spark, root) == [0, 1]
    assert [r.tokens for r in first.collect()] == [list(range(k, k + 4)) for k in range(0, 24, 4)] and sink.read(spark, root).count() == 10
    for bad in (block(3).unionByName(block(1)), block(2).limit(3), block(2).withColumn("tokens", F.array(F.lit(1)))):
        with pytest.raises(Invalid):
            sink.publish(bad, root, 2, o)
    with pytest.raises(Invalid, match="is published"):
        sink.publish(block(1), root, 1, o)
    assert sink.published(spark, root) == [0, 1] and len(list((tmp_path / "sink").glob("epoch-*"))) == 2
    # a task that fails after it has written: its rows are there once
    tries = str(tmp_path / "tries")
    os.makedirs(tries)

    def once(batches):
        yield from batches
        if not os.path.exists(f"{tries}/failed"):
            open(f"{tries}/failed", "w").close()
            os._exit(1)

    made = block(4).coalesce(1).mapInArrow(once, "batch_id long, row_in_batch int, tokens array<int>")
    try:
        sink.publish(made, root, 2, o)
    except Exception:  # local masters do not try again
        sink.publish(made, root, 2, o)
    assert sink.read(spark, root, 2).count() == 8
    sink.reset(spark, root)
    assert sink.published(spark, root) == []


def test_counters_do_not_count_twice(spark, tmp_path):
    """Blocks that are read, counted and sorted again, by a range that is sampled: the counters stay."""
    p = str(tmp_path / "s.parquet")
    spark.range(50).selectExpr("concat('text ', id) as text").toPandas().to_parquet(p)
    epoch = CorpusLoader(spark, (p,), packing.PackOptions(2, 16, 8, (256,)), seed=7).start_epoch()
    n = epoch.blocks.count()
    assert epoch.blocks.orderBy(F.rand()).count() == n == len(epoch.blocks.collect())
    s = epoch.stats()
    assert s["token_count"] == 16 * n and s["byte_count"] == sum(len(f"text {k}") for k in range(50)) and s["file_count"] == 1 and epoch.stats()["token_count"] == 16 * n


def test_gradients_of_devices_and_records(spark, tmp_path):
    member = groups.assign(spark, [[["a"], ["b"]]])
    params = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0])], "param_id string, value array<double>")
    one = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "param_id string, grad array<double>")
    two = spark.createDataFrame([("a", [0.5, 0.5])], "param_id string, grad array<double>")
    state = spark.createDataFrame([], "type_tag int, group_idx int, param_id string, state double")
    out = groups.step_multi(params, [one, two], member, state, lambda v, g, s: (F.zip_with(v, g, lambda x, y: x - y), F.coalesce(s, F.lit(0.0)) + 1))
    assert {r.param_id: (r.value, r.state) for r in out.collect()} == {"a": ([-0.5, -1.5], 1.0), "b": ([1.0], 1.0)}
    path = str(tmp_path / "record")
    groups.save_record(groups.to_record(out, member), path)
    assert {tuple(r) for r in groups.load_record(spark, path, member).collect()} == {(0, 0, "a", 1.0), (0, 1, "b", 1.0)}
    with pytest.raises(Invalid, match="not in group"):
        groups.load_record(spark, path, groups.assign(spark, [[["a"]]]))


def test_more_paths(spark):
    t = mt.ModuleTree.build(spark, mt.Module("Tuple", [linear(2, 3, 1), mt.Module("Array", [linear(4, 5, 3)]), mt.Module("Vec", [linear(6, 7, 5), linear(8, 9, 7)])]))
    ids = lambda q: [r.id for r in q.to_df().orderBy("pre").collect()]
    for path in ("*//Param[@rank=2 and contains(@shape,'6')]", "*//Param[@name='bias' or @shape='2 3']", "*//Param[not(@rank=2)]", "*//Param[starts-with(@param_id,'P') and (@rank=1 or @shape='8 9')]/..", "*//Param[2]/ancestor::*[1]/*[1]", "Tuple/(Vec)/*", "*//Param[last()]"):
        q = t.select(path)
        theirs = spark.range(1).select(F.xpath(F.lit(t.to_xml()), F.lit(q.expr.replace("(Vec)", "Vec") + "/@id")).alias("x")).first().x
        assert sorted(theirs) == sorted(ids(q)) and theirs, path
    assert ids(t.select("Tuple/(Array|Vec)")) == ["n:5", "n:9"]
    assert [r.id for r in t.select("*/Vec").union(t.select("*/Array")).orderBy("pre").collect()] == ["n:5", "n:9"]
    for bad in ("*[@rank=]", "*[@rank=1 and]", "*[not(@rank=1]", "*[contains(@name)]", "*//..", "(A|)"):
        with pytest.raises(ParseError) as e:
            t.select(bad)
        assert str(e.value).startswith("XPST0003: ") and "\n  /XmlModuleTree" in str(e.value) and "^" in str(e.value)
    desc = t.param_descs()[0]
    assert mt.desc_of(mt.node_of(desc)) == desc
    assert t.debug(True).startswith("ModuleTree {\n<XmlModuleTree") and t.debug() == repr(t)


def test_tree_of_a_configuration(spark, capsys):
    small = training.GptConfig(vocab_size=11, n_layer=2, n_head=4, n_kv_head=2, n_embed=8)
    t = mt.ModuleTree.build(spark, mt.tree_of(small))
    total = sum(d.tensor.num_elements for d in t.param_descs())
    assert total == 2 * 11 * 8 + 2 * (2 * 64 + 2 * 32 + 2 * 8 * 32) and t.select("*/Vec/GPTBlock").to_df().count() == 2
    t.print_node(2)
    assert capsys.readouterr().out.startswith('<Embedding id="n:2" name="wte" class="struct">\n  <Param')
