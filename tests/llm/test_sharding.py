import zlib

from blockmill.llm import sharding as s


def check(rows, shards, n):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    sizes = [len(by.get(k, [])) for k in range(shards)]
    assert sum(sizes) == n and max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_law_and_contents(spark):
    sf = "/root/testdata/sf0.01"
    got = s.op3_sharding(spark, sf).collect()
    check(got, 40, 1000)
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in got} == set(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in got)
    assert {r.law for r in got} == {"rows"}


def test_many_buckets_edge_cases_and_reruns(spark):
    rows = [(k % 7 or None, None if k % 5 == 0 else "t" * (k % 90), k, "x") for k in range(500)] + [(1, "same", 1, "y")] * 50 + [(9, "long " * 20000, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, slot int, source string")
    out = s.shuffled(df, shards=7, bucket_bytes=2000)
    first = out.collect()
    check(first, 7, len(rows))
    assert out.columns == ["doc_id", "text", "source", "shard", "slot"]
    assert sorted([(r.doc_id, r.text, r.source) for r in first], key=str) == sorted([(a, b, d) for a, b, _, d in rows], key=str)
    again = s.shuffled(df.repartition(3), shards=7, bucket_bytes=2000).collect()
    key = lambda r: (r.shard, r.slot)
    assert [(r.doc_id, r.text) for r in sorted(first, key=key)] == [(r.doc_id, r.text) for r in sorted(again, key=key)]
    other = s.shuffled(df, shards=7, bucket_bytes=2000, seed=99).collect()
    assert [r.text for r in sorted(first, key=key)] != [r.text for r in sorted(other, key=key)]
    assert s.shuffled(df.limit(0)).count() == 0


def test_order_is_shuffled_and_written(spark):
    df = spark.range(4000).selectExpr("id as doc_id", "cast(id as string) as text")
    out = s.shuffled(df, shards=4)
    ids = [r.doc_id for r in out.orderBy("shard", "slot").collect()]
    rising = sum(a < b for a, b in zip(ids, ids[1:]))
    assert 1800 < rising < 2200
    assert sum(x < 2000 for x in ids[:1000]) in range(420, 580)
    back = spark.read.parquet(s.write(out))
    assert sorted(r.doc_id for r in back.collect()) == list(range(4000)) and back.select("shard").distinct().count() == 4


def test_repeated_rows_spread_and_clashing_names(spark):
    """20,000 rows alike, and as many of one key that differ elsewhere, beside others: no bucket holds much more than its part."""
    text = "same text " * 10
    many = spark.range(20000).selectExpr("1L as doc_id", f"'{text}' as text", "7L as _place", "0 as bucket", "0 as place", "1 as row")
    other = spark.range(20000).selectExpr("2L as doc_id", f"'{text}' as text", "id as _place", "1 as bucket", "0 as place", "2 as row")
    rest = spark.range(2000).selectExpr("id + 10 as doc_id", f"'{text}' as text", "id as _place", "2 as bucket", "0 as place", "3 as row")
    df = many.unionByName(other).unionByName(rest)
    out = s.shuffled(df, shards=7, bucket_bytes=200_000)
    got = out.collect()
    check(got, 7, 42000)
    assert out.columns == [*df.columns, "shard", "slot"]
    assert sorted((r.doc_id, r._place) for r in got) == sorted((r.doc_id, r._place) for r in df.collect())
    # equal rows lie everywhere: every shard has its part of them
    for doc in (1, 2):
        per = [sum(r.doc_id == doc for r in got if r.shard == k) for k in range(7)]
        assert max(per) - min(per) < 600
    passes = [p for p in out.inputFiles() if "shuffled" in p]
    sizes = [r["count"] for r in spark.read.parquet(*passes).groupBy("bucket").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 3 * 42000 / len(sizes)


def test_column_names_with_backticks(spark):
    df = spark.createDataFrame([(1, "a b", 5), (2, "c", 6)], ["doc_id", "text", "odd`name"])
    got = s.shuffled(df)
    assert got.columns == [*df.columns, "shard", "slot"] and {r[2] for r in got.collect()} == {5, 6}
