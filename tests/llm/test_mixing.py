import random
from fractions import Fraction

import duckdb
import pytest

from blockmill.llm import mixing as m


def plain_targets(sizes):
    """Dealt again and again by weight until none is above its stop."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: m.WEIGHTS[k % 3] for k, s in enumerate(names)}
    budget, full = Fraction(3 * sum(sizes.values()), 2), {}
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(full.values())
        total = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / total for s in rest}
        over = [s for s in rest if share[s] > 2 * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: Fraction(2 * sizes[s]) for s in over}


def plain_seats(targets, total):
    won = dict.fromkeys(targets, 0)
    for _ in range(total):
        s = max(won, key=lambda s: (targets[s] / (2 * won[s] + 1), -s))
        won[s] += 1
    return won


ROWS = [(k, " ".join(["w"] * (k % 37)), ["b", "a", None, "ä", "Z"][k % 5] if k % 3 else "a") for k in range(400)]
ROWS += [(None, "x y", "a"), (None, None, None), (5, "", "b"), (6, "word " * 30000, "b"), (7, " a\tb\x0bc d ", "a"), (7, " a\tb\x0bc d ", "a"), (8, None, "empty")]


def frame(spark):
    return spark.createDataFrame([(*r, 0, 1) for r in ROWS], "doc_id long, text string, source string, size int, n_chars int")


def test_targets_and_seats(spark):
    sizes = {}
    for _, t, s in ROWS:
        sizes[s] = sizes.get(s, 0) + len([w for w in (t or "").replace("\x0b", " ").replace("\t", " ").replace("\n", " ").split(" ") if w])
    got = {r.source: r for r in m.mix(frame(spark)).select("source", "source_size", "target").distinct().collect()}
    want = plain_targets(sizes)
    for s, r in got.items():
        assert r.source_size == sizes[s] and abs(r.target - float(want[s])) < 1e-6
    aims = m.targets(spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long"))
    aim = {r.idx: Fraction(r.target) for r in aims.collect() if r.source_size}
    got = {(r.idx, r.shard): r.seats for r in m.quotas(aims).collect()}
    for shard in range(m.SHARDS):
        won = plain_seats(aim, m.SEATS * (shard + 1) // m.SHARDS)
        assert {i: got[i, shard] for i in aim} == won


def test_quotas_by_divisor_equal_listed_seats(spark):
    """Few seats for many sources, and targets that differ by far."""
    rng = random.Random(1)
    for n, total in ((3, 7), (40, 16), (40, 100), (25, 1000)):
        aim = {i: float(rng.choice([1, 5, 300, 90000]) * rng.randrange(1, 50)) for i in range(1, n + 1)}
        df = spark.createDataFrame([(i, t, sum(aim.values()), n) for i, t in aim.items()], "idx int, target double, dealt double, n_sources long")
        got = {(r.idx, r.shard): r.seats for r in m.quotas(df, total, 4).collect()}
        for shard in range(4):
            assert {i: got[i, shard] for i in aim} == plain_seats({i: Fraction(t) for i, t in aim.items()}, total * (shard + 1) // 4)


def test_taken_is_near_target_and_bounded(spark):
    got = m.mix(frame(spark)).collect()
    assert len(got) == len(ROWS)
    taken, target = {}, {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in taken)


def test_expanded_words_are_the_taken_ones(spark):
    mixed = m.mix(frame(spark))
    out = m.expand(frame(spark))
    assert out.columns == ["doc_id", "text", "source", "size", "n_chars"]
    words = {}
    for r in out.select("doc_id", "source", m.word_count(out.text).alias("n"), (m.F.length("text") == out.n_chars).alias("ok")).collect():
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + r.n
        assert r.ok
    want = {}
    for r in mixed.collect():
        want[r.doc_id, r.source] = want.get((r.doc_id, r.source), 0) + r.taken
    assert words == {k: v for k, v in want.items() if v}


def test_sql_agrees_reruns_agree_and_empty_table(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    key = lambda r: tuple(map(str, r))
    mine = sorted([tuple(r) for r in m.op4_mixing(spark, sf).collect()], key=key)
    theirs = sorted(con.sql(f"select doc_id, size, source_size, target, taken, shard from ({m.SQL})").fetchall(), key=key)
    assert mine == theirs
    df = frame(spark)
    a, b = (sorted([tuple(r) for r in m.mix(x).select("doc_id", "source", "taken").collect()], key=key) for x in (df, df.repartition(5)))
    assert a == b
    assert m.mix(df.limit(0)).count() == 0 and m.expand(df.limit(0)).count() == 0


def test_small_sources_get_their_target_to_the_word(spark):
    """Beside sources of thousands of blocks, sources of parts of a block to some blocks."""
    rows = [(k, " ".join(["w"] * 5000), f"big{k % 6}") for k in range(360)]
    small = {"s0": 1, "s1": 7, "s2": 60, "s3": 300, "s4": 800, "s5": 1300}
    rows += [(1000 + 50 * k + j, " ".join(["w"] * part), s) for k, (s, n) in enumerate(small.items()) for j, part in enumerate([n // 3, n - n // 3])]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = m.mix(df)
    got = {r.source: r for r in mixed.groupBy("source").agg(m.F.sum("taken").alias("taken"), m.F.max("target").alias("target"), m.F.max("source_size").alias("size")).collect()}
    for s, n in small.items():
        assert got[s].target == 2 * n == got[s].taken
    assert all(abs(r.taken - r.target) <= 0.5 for r in got.values())
    assert abs(sum(r.taken for r in got.values()) - 1.5 * sum(r.size for r in got.values())) <= 0.001 * sum(r.size for r in got.values())
    words = {r.source: r.n for r in m.expand(df).groupBy("source").agg(m.F.sum(m.word_count(m.F.col("text"))).alias("n")).collect()}
    assert words == {s: r.taken for s, r in got.items()}
    # a target that is not a whole number of passes
    few = m.mix(spark.createDataFrame([(k, "w " * 11, "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string"))
    few = few.groupBy("source").agg(m.F.sum("taken").alias("taken"), m.F.max("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 for r in few)


def test_sql_with_tiny_sources_nulls_and_repeats(spark):
    con = duckdb.connect()
    own = frame(spark).select("doc_id", "text", "source")
    big = spark.range(600).selectExpr("id + 1000 as doc_id", "repeat('w ', cast(id % 300 as int)) as text", "concat('big', cast(id % 3 as string)) as source")
    tiny = spark.createDataFrame([(5000, "w w w", "tiny"), (5001, "w", "tiny2"), (5002, " ".join(["w"] * 90), "t90"), (5003, " ".join(["w"] * 500), "t500")], "doc_id long, text string, source string")
    df = own.unionByName(big).unionByName(tiny)
    documents = df.toArrow()  # noqa: F841
    theirs = con.sql(m.SQL).fetchall()
    key = lambda r: tuple(map(str, r))
    mine = [tuple(r) for r in m.mix(df).select("doc_id", *m.OUTPUTS, "source").collect()]
    assert sorted([r[:-1] for r in mine], key=key) == sorted(theirs, key=key)
    by = {}
    for _, size, _, target, taken, _, source in mine:
        by.setdefault(source, [target, 0])[1] += taken
        assert taken <= 2 * size
    assert all(abs(a - b) <= 0.5 for a, b in by.values()) and by["tiny"][1] == 6


def test_small_sources_beside_a_corpus(spark):
    """The sources of 3, 90 and 500 words beside 600,000."""
    small = {"a3": 3, "a90": 90, "a500": 500}
    rows = [(k, " ".join(["w"] * 1000), "big") for k in range(600)] + [(1000 + i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(small.items())]
    got = {r.source: r for r in m.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(m.F.sum("taken").alias("taken"), m.F.max("target").alias("target")).collect()}
    assert all(got[s].target == got[s].taken == 2 * n for s, n in small.items()) and abs(got["big"].taken - got["big"].target) <= 0.5


def test_shards_hold_their_quotas(spark):
    """In each shard of the mix a source has its quota of blocks, but for the documents that lie on two blocks."""
    df = spark.range(6000).selectExpr("id as doc_id", "repeat('w ', 100 + 10 * cast(id % 20 as int)) as text", "array('a','b','c')[cast(pmod(hash(id), 3) as int)] as source")
    out = m.expand(df, shard_col="part")
    held = {(r.source, r.part): r.n for r in out.groupBy("source", "part").agg(m.F.sum(m.word_count(m.F.col("text"))).alias("n")).collect()}
    aims = m.targets(df.groupBy("source").agg(m.F.sum(m.word_count(m.F.col("text"))).alias("source_size")))
    block = {r.idx: (r.source, r.block) for r in aims.collect()}
    seats = {(r.idx, r.shard): r.seats for r in m.quotas(aims).collect()}
    for (idx, shard), upto in seats.items():
        source, size = block[idx]
        quota = (upto - seats.get((idx, shard - 1), 0)) * size
        assert held.get((source, shard), 0) == pytest.approx(quota, rel=0.25)


def test_clashing_columns(spark):
    names = ["block", "chosen", "_s", "_start", "_order", "_bucket", "size", "target", "taken", "passes", "pieces", "row", "rounds", "shard", "start", "end", "spans", "place", "cut", "upto", "before", "b", "s"]
    df = spark.createDataFrame([(k, f"a b c {k}", "ab"[k % 2], *range(len(names))) for k in range(20)], ["doc_id", "text", "source", *names])
    mixed, out = m.mix(df), m.expand(df)
    assert mixed.count() == 20 and set(mixed.columns) == {*df.columns, "source_size"}
    assert out.columns == df.columns and all(tuple(r[3:]) == tuple(range(len(names))) for r in out.collect())


def test_rows_of_one_id_or_of_none_spread(spark):
    """60,000 null ids, and 3,000 equal rows, in one source: buckets stay small, the mix stays right, SQL agrees."""
    df = spark.range(60000).selectExpr("cast(null as bigint) as doc_id", "repeat('w ', 1 + cast(id % 7 as int)) as text", "'hot' as source")
    df = df.unionByName(spark.range(3000).selectExpr("5L as doc_id", "'w w w' as text", "'hot' as source")).unionByName(spark.range(2000).selectExpr("id as doc_id", "'w w' as text", "'b' as source"))
    mixed = m.mix(df)
    plans = mixed._jdf.queryExecution().optimizedPlan().toString()
    assert "content" in plans
    got = [tuple(r) for r in mixed.select("doc_id", *m.OUTPUTS).collect()]
    documents = df.toArrow()  # noqa: F841
    theirs = duckdb.connect().sql(m.SQL).fetchall()
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(theirs, key=key)
    assert all(r[4] <= 2 * r[1] for r in got)
    # the order by which rows are bucketed: no bucket of a source holds much more than its part
    sized = df.withColumn("n", m.F.lit(1))
    largest = max(r["count"] for r in m.ordered(sized, "text", ["doc_id"]).groupBy("source", "bucket").count().collect())
    assert largest < 70


def test_column_names_with_backticks(spark):
    df = spark.createDataFrame([(1, "a b", "s", 5)], ["doc_id", "text", "source", "odd`name"])
    got = m.expand(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {(1, "a b", "s", 5), (1, "a", "s", 5)} and m.mix(df).first()["odd`name"] == 5


def test_mix_is_laid_out_by_shards(spark, monkeypatch, tmp_path):
    """The seats say in which partition, and once written in which file, a row of the mix stands: shard after shard."""
    df = frame(spark)
    shards = lambda out: out.select("part", m.F.spark_partition_id().alias("at")).distinct().collect()
    for words, least in ((m.PART_WORDS, m.SHARDS), (100, m.SHARDS + 1)):
        monkeypatch.setattr(m, "PART_WORDS", words)
        out = m.expand(df, shard_col="part")
        assert out.rdd.getNumPartitions() >= least
        rows = sorted((r["at"], r.part) for r in shards(out))
        assert len({a for a, _ in rows}) == len(rows) > 1 and [p for _, p in rows] == sorted(p for _, p in rows)
    out.write.parquet(str(tmp_path / "mix"))
    files = spark.read.parquet(str(tmp_path / "mix")).select(m.F.input_file_name().alias("file"), "part").distinct().collect()
    assert [r.part for r in sorted(files, key=lambda r: r.file)] == sorted(r.part for r in files)
    # other seats, another layout
    monkeypatch.setattr(m, "quotas", lambda aims: aims.where("target > 0").select("idx", m.F.explode(m.F.sequence(m.F.lit(0), m.F.lit(m.SHARDS - 1))).alias("shard"), m.F.lit(m.SEATS).alias("seats")))
    assert {r.part for r in shards(m.expand(df, shard_col="part"))} != {r.part for r in files}
