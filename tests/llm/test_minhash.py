import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from blockmill.llm import minhash as m
from blockmill.llm import words


def plain_words(text):
    out, word = [], []
    for b in (text or "").lower().encode() + b" ":
        if words.WORD[b]:
            word.append(b)
        elif word:
            out.append(bytes(word))
            word = []
    return out


def alignment(a, b):
    """The longest common subsequence of two word lists, over the longer one's length; row by row."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1] / max(len(a), len(b)) if a and b else 0.0


def may_link(a, b):
    """Whether two texts share words enough for a link, repeats counted."""
    return sum((Counter(a) & Counter(b)).values()) >= m.THRESHOLD * max(len(a), len(b))


def brute(rows):
    """class of each id by all pairs."""
    ids = sorted({i for i, _ in rows if i is not None})
    text = {}
    for i, t in rows:
        text.setdefault(i, t)
    own = {i: plain_words(text[i]) for i in ids}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[:n]:
            if own[i] and own[j] and may_link(own[i], own[j]) and (own[i] == own[j] or alignment(own[i], own[j]) >= m.THRESHOLD):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(n))


def hashed(text):
    return m.unpacked(m.short(next(m._each([text]))))


def test_similarity_equals_brute_force():
    rng = random.Random(1)
    linked = 0
    for k in range(1500):
        a = [rng.choice("abcdefgh") if k % 2 else text_of(rng, 1) for _ in range(rng.randrange(1, 60))]
        b = a[:]
        for _ in range(rng.randrange(0, 14)):
            at = rng.randrange(len(b) or 1)
            b[at : at + rng.randrange(0, 2)] = rng.choice([["x"], ["y", "z"], a[:6], []])
        want = alignment(a, b)
        got = m.similarity(hashed(" ".join(a)), hashed(" ".join(b)))
        assert got == pytest.approx(want) if want >= m.THRESHOLD else got <= want + 1e-12
        linked += want >= m.THRESHOLD
    assert 300 < linked < 1400


def test_an_edit_costs_a_word(spark):
    """Scattered edits of single words: the similarity is that of words, and such pairs are found."""
    rng = random.Random(11)
    rows, of = [], {}
    for g in range(150):
        n, edits = rng.choice([(60, 2), (120, 3), (300, 12), (300, 24), (2000, 150)])
        w = text_of(rng, n).split()
        near = w[:]
        for at in rng.sample(range(n), edits):
            near[at] = rng.choice(["qq", "", f"q{at}", f"{near[at]} q{at}"])
        rows += [(2 * g, " ".join(w)), (2 * g + 1, " ".join(near))]
        assert m.similarity(hashed(rows[-2][1]), hashed(rows[-1][1])) >= 1 - edits / n - 0.01
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * g + 1] == 2 * g for g in range(150)) >= 148 and all(got[2 * g] == 2 * g for g in range(150))


def test_long_texts_align_in_their_band():
    rng = random.Random(12)
    w = text_of(rng, 20000).split()
    near = [x if rng.random() > 0.05 else "edit" for x in w]
    assert 0.93 < m.similarity(hashed(" ".join(w)), hashed(" ".join(near))) < 0.97
    assert m.similarity(hashed(" ".join(w)), hashed(" ".join(w[10000:] + w[:10000]))) < m.THRESHOLD


def test_kmers_are_labelled_and_in_order():
    h = next(m._each(["a b c d e a b c d e a b c d e"]))
    x = m.kmers(h)
    assert len(np.unique(x)) == len(x) == 11
    assert len(m.kmers(next(m._each(["only two"])))) == 1
    assert len(m.kmers(next(m._each([None])))) == 0


def test_band_keys_do_not_depend_on_the_width(monkeypatch):
    x = m.kmers(next(m._each([text_of(random.Random(2), 500)])))
    whole = m.band_keys(x)
    monkeypatch.setattr(m, "WIDE", 64)
    assert (m.band_keys(x) == whole).all()


def test_classes_on_edge_cases(spark):
    rng = random.Random(3)
    base = text_of(rng, 80)
    w = base.split()
    near = " ".join(w[:40] + ["changed"] + w[41:])
    rows = [(5, base), (2, base), (9, near), (7, None), (8, ""), (11, None), (12, "!!! ..."), (20, "two words"), (21, "two words"), (30, text_of(rng, 90)), (None, base), (40, "long " * 5000), (41, "long " * 5000 + "end"), (5, base)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, kept int, class_id string")
    got = {r.doc_id: (r.class_id, r.kept) for r in m.classes(df).collect()}
    want = brute([r for r in rows if r[0] is not None])
    assert got == {i: (c, i == c) for i, c in want.items()}
    assert want[9] == want[5] == 2 and want[41] == 40 and want[21] == 20
    assert {r.doc_id for r in m.keep(df).collect()} == {None, *(i for i, c in want.items() if i == c)}
    assert m.classes(df.limit(0)).count() == 0


def test_chain_needs_no_common_centre(spark):
    """Texts that drift step by step are one class, though the ends are unlike."""
    rng = random.Random(4)
    w = text_of(rng, 200).split()
    rows = []
    for i in range(40):
        rows.append((i, " ".join(w)))
        w[rng.randrange(200)] = f"new{i}"
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
    assert len(set(want.values())) == 1


def test_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.class_id for r in m.classes(docs).collect()} == want


def test_hot_group_without_a_common_centre(spark, monkeypatch):
    """Copies of one base, edited so much that many are like few others: every link that joins components is found, in cells of any size."""
    rng = random.Random(6)
    base = text_of(rng, 150).split()
    rows = []
    for i in range(120):
        w = base[:]
        for _ in range(rng.randrange(1, 6)):
            w[rng.randrange(150)] = f"e{i}{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in m.classes(df).collect()}
    assert got == want
    cell = pd.DataFrame({"bucket": 1, "i": 0, "j": 0, "block": 0, "doc_id": range(120), "comp": range(120)})
    hs = list(m._each([t for _, t in rows]))
    cell["words"], cell["bands"] = [m.short(h) for h in hs], [np.array([1] + [0] * (m.BANDS - 1))] * 120
    root = list(range(120))
    for a, b in m._across(cell).itertuples(index=False):
        lo, hi = sorted((root[a], root[b]))
        root = [lo if r == hi else r for r in root]
    assert root == [want[i] for i in range(120)]


def test_small_bucket_whose_centres_coincide(spark, monkeypatch):
    """Three documents meet in two bands; all four centres are the one that is unlike the two others."""
    hashes = spark.range(200).select("id", *(m.F.xxhash64("id", m.F.lit(m.SEED + s)).alias(f"h{s}") for s in range(m.CENTRES))).collect()
    low = min(hashes, key=lambda r: max(r[1:]))
    others = [r.id for r in hashes if all(x > y for x, y in zip(r[1:], low[1:]))][:2]
    n_bands = m.BANDS

    import pyarrow as pa

    own = m._prints

    def meet(batches):
        for batch in own(batches):
            bands = [[7, 8, *(1000 * (i + 1) + k for k in range(n_bands - 2))] for i in batch["doc_id"].to_pylist()]
            yield batch.set_column(4, "bands", pa.array(bands, pa.list_(pa.int64())))

    monkeypatch.setattr(m, "_prints", meet)
    text = [f"w{k}" for k in range(200)]
    rows = [(low.id, " ".join(f"v{k}" for k in range(200))), (others[0], " ".join(text)), (others[1], " ".join([*text[:100], "x", *text[100:]]))]
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {low.id: low.id, others[0]: min(others), others[1]: min(others)}


def test_two_texts_under_one_id(spark):
    """One text stands for the id throughout: the class is that of the text kept, and the other links nothing."""
    rng = random.Random(8)
    a, b = text_of(rng, 100), text_of(rng, 100)
    near = lambda t: " ".join([*t.split()[:50], "zz", *t.split()[50:]])
    rows = [(10, a), (10, b), (10, b), (20, near(a)), (30, near(b)), (40, None), (40, a)]
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[40] == min(10 if got[20] == 10 else 20, 20)
    # exactly one of the two near texts is in the class of 10
    assert (got[20] == 10) != (got[30] == 10) and len(got) == 4
    if got[20] == 10:
        assert got[40] == 10
    else:
        assert got[40] == got[20] == 20


def edited(base, rng, share):
    """base with so many of its words replaced by new ones, in one run (which changes few pairs more than words)."""
    w, n = base[:], int(len(base) * share)
    at = rng.randrange(len(w) - n)
    w[at : at + n] = [f"u{rng.random()}" for _ in range(n)]
    return w


@pytest.mark.parametrize(("hot", "large"), [(64, 4), (3, 4), (64, 4096)])
def test_shared_passage_across_components(spark, monkeypatch, hot, large):
    """Many texts share a long passage and are unlike; some pairs among them are alike. Cells find those, or rare pairs of words, or both."""
    monkeypatch.setattr(m, "HOT", hot)
    monkeypatch.setattr(m, "LARGE", large)
    monkeypatch.setattr(m, "BLOCK", 16)
    rng = random.Random(9)
    passage = text_of(rng, 120).split()
    rows = []
    for i in range(60):
        w = passage + text_of(rng, 40).split()
        rows.append((2 * i, " ".join(w)))
        if i % 4 == 0:
            w[rng.randrange(120)] = "edit"
            rows.append((2 * i + 1, " ".join(w)))
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in m.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want
    assert 30 < len(set(want.values())) < len(rows)


def test_rare_grams_meet_every_link(spark):
    """Every pair of members that links across components shares a rare pair of neighbouring words."""
    rng = random.Random(10)
    base = text_of(rng, 60).split()
    texts = [" ".join(edited(base, rng, rng.choice([0.05, 0.1, 0.15, 0.3]))) for _ in range(40)]
    packed = [m.short(h) for h in m._each(texts)]
    rows = [(i, i, len(m.unpacked(p)), bytearray(p)) for i, p in enumerate(packed)]
    found = {}
    for r in m.rare(spark.createDataFrame(rows, "doc_id long, comp long, n_words long, words binary")).collect():
        found.setdefault(r.doc_id, set()).add(r.gram)
    for i in range(40):
        for j in range(i):
            if m.similarity(m.unpacked(packed[i]), m.unpacked(packed[j])) >= m.THRESHOLD:
                assert found.get(i, set()) & found.get(j, set())


def test_links_are_given_out(spark):
    rng = random.Random(13)
    w = text_of(rng, 100).split()
    rows = [(5, " ".join(w)), (3, " ".join(w)), (9, " ".join(["new", *w])), (7, text_of(rng, 50)), (8, None)]
    classed, edges = m.found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [tuple(r) for r in edges.collect()] == [(3, 9)]
    assert {r.doc_id: (r.class_id, r.text_id) for r in classed.collect()} == {5: (3, 3), 3: (3, 3), 9: (3, 9), 7: (7, 7), 8: (8, None)}


def test_keep_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4), (None, None, 5, 6)], "doc_id long, text string, _gone int, gone int")
    got = m.keep(df)
    assert got.columns == df.columns and {tuple(r) for r in got.collect()} == {(1, "a b c d e f", 1, 2), (None, None, 5, 6)}


def test_components_of_densely_linked_groups(spark, monkeypatch):
    """The rounds go over a few edges a node, not over all links of a group; components are those of a plain search, with any number of nodes held."""
    import random

    import pyarrow as pa

    from blockmill.llm import common

    sizes, kept = {}, common.staged

    def watched(df, tag, *args):
        out = kept(df, tag, *args)
        sizes[tag] = out.count()
        return out

    monkeypatch.setattr(common, "staged", watched)
    dense = [(1000 * g + x, 1000 * g + c) for g in (1, 2) for x in range(400) for c in range(60)]
    rng = random.Random(4)
    edges = dense + [(rng.randrange(3000, 3400), rng.randrange(3000, 3400)) for _ in range(250)] + [(-5, 1399), (7, 7)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for x in sorted(near):
        todo = [x] * (x not in want)
        while todo:
            y = todo.pop()
            if y not in want:
                want[y] = x
                todo += near[y]
    got = common.components(spark.createDataFrame(edges, "src long, dst long").repartition(3), "test").collect()
    assert len(got) == len(want) and dict(map(tuple, got)) == want
    assert sizes["test-edges"] <= 3 * len(want)
    # a task that cannot hold all nodes
    monkeypatch.setattr(common, "NODES", 50)
    batches = [pa.record_batch([pa.array(x) for x in zip(*edges[k : k + 100], strict=True)], names=["src", "dst"]) for k in range(0, len(edges), 100)]
    stars = [e for b in common._stars(iter(batches)) for e in zip(*(b[c].to_pylist() for c in ("u", "v")), strict=True)]
    assert all(u > v for u, v in stars) and len(stars) < len(edges)
    got = common.components(spark.createDataFrame(stars, "src long, dst long"), "test").collect()
    assert dict(map(tuple, got)) == want
