import numpy as np

from blockmill.llm import quality as q


def plain_margin(m, place, value):
    """All pairs, one by one."""
    total = m.bias + sum(m.linear[p] * x for p, x in zip(place, value))
    for i in range(len(place)):
        for j in range(i):
            total += float(m.factors[place[i]] @ m.factors[place[j]]) * value[i] * value[j]
    return total


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(0)
    m = q.Machine(np.zeros((len(q.STATS) + 1, q.BINS - 1)), 0.3, rng.normal(size=q.WORD_SPACE + 1000), rng.normal(size=(q.WORD_SPACE + 1000, q.RANK)))
    ptr, place, value = m.rows(["a b c a", "", "one two\nthree THREE!!"], np.array([[1.0], [np.nan], [3.0]]))
    got = m.margins(ptr, place, value)
    for k in range(3):
        s = slice(ptr[k], ptr[k + 1])
        assert np.isclose(got[k], plain_margin(m, place[s], value[s]))


def test_statistics():
    stats, ptr, _, weight = q.features(["AB cd cd\ncd", None, "x y\nx y\nx y"])
    name = {n: k for k, n in enumerate(q.STATS)}
    assert np.isclose(stats[0, name["share0"]], 2 / 11) and np.isclose(stats[0, name["share2"]], 2 / 11)
    assert np.isclose(stats[0, name["repeats"]], 2 / 4) and np.isclose(stats[0, name["top"]], 3 / 4) and np.isclose(stats[0, name["distinct"]], 2 / 4)
    assert np.isclose(stats[2, name["line_repeats"]], 2 / 3) and ptr.tolist() == [0, 2, 2, 4]
    assert np.isclose((weight[:2] ** 2).sum(), 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = q.op9_quality(spark, sf).toPandas()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.3)).all()
    held = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got[got.held_out], on="doc_id")
    assert (held.quality == held.predicted).mean() > 0.97 and held.predicted[held.quality == 1].mean() > 0.98


def test_edge_cases(spark):
    rows = [(k, f"a good calm text of number {k}", k, "s") for k in range(60)] + [(k, "$$$ !! " * (k % 7 + 1), k, None) for k in range(60, 120)]
    rows += [(1, "a good calm text of number 1", None, None), (200, None, None, None), (None, "", 0, ""), (201, "word " * 100000, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, score string")
    labels = spark.createDataFrame([*((k, int(k < 60)) for k in range(120)), (3, 1), (None, 0), (9, None)], "doc_id long, quality int")
    model = q.fit(docs, labels)
    got = q.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.predicted for r in got}
    assert by[5] == 1 and by[70] == 0
    assert q.keep(docs, model).columns == docs.columns and q.score(docs.limit(0), model).count() == 0
    assert q.score(docs.drop("n_chars"), model).count() == docs.count()
    assert {r.score for r in q.score(docs, q.fit(docs, labels.where("quality = 1"))).collect()} == {1.0}
