import sys

import corpus_pipeline as p
from blockmill.llm import bpe, minhash, mixing, quality, toxicity

SF = "/root/testdata/sf0.1"


def test_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in p.STAGES:
        docs = p.staged(stage(spark, docs, SF if name in ("toxicity", "quality") else ""), f"test-{name}")
        seen.append(docs)
        if name != "encoding":
            assert docs.columns == columns, name
    toxic, good, unique, mixed, encoded = ({r.doc_id for r in d.select("doc_id").collect()} for d in seen)
    assert toxic > good > unique >= mixed == encoded
    # one document of each group stays, and it is the smallest
    classes = {r.doc_id: r.class_id for r in minhash.classes(seen[1]).collect()}
    assert unique == set(classes.values())
    # the mix holds the words that it takes
    taken = {r.doc_id: r.taken for r in mixing.mix(seen[2]).collect() if r.taken}
    held = {}
    for r in seen[3].select("doc_id", mixing.word_count(seen[3].text).alias("n")).collect():
        held[r.doc_id] = held.get(r.doc_id, 0) + r.n
    assert held == taken
    e = bpe.Bpe.load()
    for r in seen[4].limit(50).collect():
        assert r.ids == e.encode(r.text) and r.n_tokens == len(r.ids)


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    left = p.keep_good(spark, p.drop_toxic(spark, docs, SF), SF).select("doc_id").toPandas().doc_id
    known = labels.toPandas()
    clean, bad = known[(known.toxic == 0) & (known.quality == 1)], known[(known.toxic == 1) | (known.quality == 0)]
    assert clean.doc_id.isin(left).mean() > 0.97 and bad.doc_id.isin(left).mean() < 0.1


def test_stages_are_the_operators():
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "encoding"]
    assert {toxicity, quality, minhash, mixing, bpe} <= {v for v in vars(sys.modules["corpus_pipeline"]).values() if hasattr(v, "__file__")}


def test_empty_extra_and_null_columns(spark):
    """Columns of any name pass all stages but are not read; null texts, null ids and repeated rows have their defined results; so has an empty table."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = ["block", "chosen", "_s", "_gone", "gone", "row", "taken", "target", "size", "score", "label", "fold"]
    wide = docs.selectExpr("*", *(f"cast(doc_id + {k} as string) as `{c}`" for k, c in enumerate(extra)))
    odd = wide.limit(2).selectExpr(*(f"cast(null as {t}) as `{c}`" for c, t in wide.dtypes))
    wide = wide.unionByName(odd).unionByName(wide.limit(3))
    for name, stage in p.STAGES:
        wide = p.staged(stage(spark, wide, SF), f"test-wide-{name}")
        assert wide.columns[: 5 + len(extra)] == docs.columns + extra, name
    assert wide.count() > 0 and all(r[c] == str(r.doc_id + k) for r in wide.limit(20).collect() for k, c in enumerate(extra) if r.doc_id is not None)
    none = docs.limit(0)
    for name, stage in p.STAGES:
        none = p.staged(stage(spark, none, SF), f"test-none-{name}")
        assert none.count() == 0
