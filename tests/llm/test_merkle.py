import hashlib
import zlib

import pytest

from blockmill.llm import merkle as m


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r):
    return h(*("-" if r[c] is None else f"{len(str(r[c]).encode())}:{r[c]}" for c in m.FIELDS))


def climb(nodes, k):
    """The root of a list of digests, and the siblings of its k-th."""
    proof = []
    while len(nodes) > 1:
        first = k - k % 16
        proof += [d for j, d in enumerate(nodes[first : first + 16], first) if j != k]
        nodes = [h(*nodes[j : j + 16]) for j in range(0, len(nodes), 16)]
        k //= 16
    return nodes[0], proof


def brute(rows):
    """(doc_id, leaf, subroot, root, proof_sha256) of each row."""
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append((r["doc_id"] is not None, r["doc_id"], leaf(r)))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [[x[1:] for x in sorted(by[s], key=lambda x: (x[0], x[1] or 0, x[2]))] for s in sources]
    subroots = [climb([d for _, d in t], 0)[0] for t in trees]
    out = []
    for s, t in enumerate(trees):
        root, above = climb(subroots, s)
        digests = [d for _, d in t]
        for k, (doc_id, d) in enumerate(t):
            out.append((doc_id, d, subroots[s], root, h(*climb(digests, k)[1], *above)))
    return out


KEY = lambda r: tuple((x is None, str(x)) for x in r)
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    proof = "sha2(array_join(transform(arrays_zip(before, after), s -> s.before || s.after), ''), 256)"
    return sorted((tuple(r) for r in df.selectExpr("doc_id", "leaf", "subroot", "root", proof).collect()), key=KEY)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_trees_of_many_sizes(spark, monkeypatch, levels):
    monkeypatch.setattr(m, "LEVELS", levels)
    rows, doc = [], 0
    for source, n in [(None, 1), ("ä", 2), ("b", 15), ("c", 16), ("d", 17), ("e", 256), ("f", 257), ("Z", 600)] + [(f"s{k}", 1) for k in range(20)]:
        for _ in range(n):
            doc += 7
            rows.append((doc % 1009, source, "en", len(str(doc)), f"Text {doc} é"))
    got = rows_of(m.manifest(make(spark, rows).repartition(5)))
    assert got == sorted(brute([dict(zip(m.FIELDS, (a, b, c, d, e))) for a, b, c, d, e in rows]), key=KEY)


def test_query_and_tampering(spark):
    sf = "/root/testdata/sf0.001"
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").select(*m.FIELDS).collect()]
    got = m.op11_merkle(spark, sf).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(brute(docs))
    text = {d["doc_id"]: d["text"] for d in docs}
    for r in got:
        changed = zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text[r.doc_id])
        assert r.verified == (not changed) == (r.folded_root == r.root)


def test_edge_cases(spark):
    rows = [(None, None, None, None, None), (None, None, None, None, ""), (1, "", "", 0, ""), (1, "", "", 0, ""), (1, "", "", 0, "x"), (2, "a", "en", 9, "long " * 100000), (-5, "a", None, 1, "ÄB")]
    df = make(spark, rows).selectExpr("*", "1 as tree", "2 as idx", "'x' as digest", "3 as part", "4 as n")
    assert rows_of(m.manifest(df)) == sorted(brute([dict(zip(m.FIELDS, r)) for r in rows]), key=KEY)
    assert m.manifest(make(spark, [])).count() == 0
    one = m.manifest(make(spark, rows[2:3])).collect()[0]
    assert one.leaf == one.subroot == one.root and not one.before


def test_verify(spark):
    rows = [(k, "s" if k % 3 else "t", "en", 4, f"Text {k}") for k in range(50)]
    proofs = m.manifest(make(spark, rows))
    claimed = [(k, s, lang, n, t.lower() if k == 7 else t) for k, s, lang, n, t in rows] + [(99, "s", "en", 4, "new")]
    bad = {r.doc_id for r in m.verify(make(spark, claimed), proofs).collect() if not r.verified}
    assert bad == {7, 99}


def test_hot_source_goes_over_many_ranges(spark):
    """5,000 rows of one source, and as many of a null doc_id: the SQL agrees with the places."""
    duckdb = pytest.importorskip("duckdb")
    rows = [(None if k % 2 else k, "hot", "en", 1, f"t{k % 1500}") for k in range(9000)] + [(k, "cold", "en", 1, "t") for k in range(30)]
    df = make(spark, rows)
    got = rows_of(m.manifest(df.repartition(7)))
    assert got == sorted(brute([dict(zip(m.FIELDS, r)) for r in rows]), key=KEY)
    con = duckdb.connect()
    con.register("documents", df.where("doc_id is not null and doc_id < 400").toPandas())
    want = con.execute(m.SQL).fetchall()
    assert len(want) == 230 and all(w[6] == (w[5] == w[3]) for w in want)
