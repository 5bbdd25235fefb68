import zlib

import numpy as np
import pyarrow as pa

from blockmill.llm import toxicity as t
from blockmill.llm import words


def test_word_hashes_are_those_of_the_words():
    h, first, length = words.hashes(*words._join([b"abc de abc", b"", b"de", "é x".encode()]))
    assert h[0] == h[2] and h[1] == h[3] and len({*h.tolist()}) == 4
    assert first.tolist() == [0, 3, 3, 4, 6] and length.tolist() == [3, 2, 3, 2, 2, 1]


def test_blocks_cover_every_text(monkeypatch):
    texts = ["a b", None, "", "c " * 50, "d"]
    whole = [(a, b) for a, b, *_ in words.blocks(texts)]
    monkeypatch.setattr(words, "BLOCK", 8)
    parts = [(a, b) for a, b, *_ in words.blocks(texts)]
    assert whole == [(0, 5)] and parts[0][0] == 0 and parts[-1][1] == 5 and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_probabilities_sum_to_one():
    """A class's word model, with the words yet to come, is a distribution."""
    below = np.array([0.5, 0.3, 0.1])
    p, freed = t.discounted(np.array([10.0, 2.0, 0.0]), 3.0, below)
    assert np.isclose(p.sum() + freed * 0.1, 1.0)


def test_held_out_accuracy_and_columns(spark):
    sf = "/root/testdata/sf0.1"
    got = t.op1_toxicity(spark, sf).toPandas()
    assert list(got.columns[:4]) == ["doc_id", "held_out", "score", "predicted"]
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert ((got.score >= 0) & (got.score <= 1)).all() and (got.predicted == (got.score >= 0.5)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(got, on="doc_id")
    held = labels[labels.held_out]
    assert (held.toxic == held.predicted).mean() > 0.96
    assert held.predicted[held.toxic == 1].mean() > 0.85


def test_edge_cases(spark):
    docs = spark.createDataFrame(
        [(1, "you idiot fool", 0.1, "x"), (1, "you idiot fool", 0.2, None), (2, None, None, None), (None, "", 1.0, "y"), (3, "word " * 100000, 0.0, ""), *((k, f"fine day number {k} and more", 0.0, "z") for k in range(4, 60)), *((k, f"idiot fool number {k} go", 0.0, "z") for k in range(60, 120))],
        "doc_id long, text string, score double, predicted string",
    )
    labels = spark.createDataFrame([*((k, 0) for k in range(4, 60)), *((k, 1) for k in range(60, 120)), (5, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    model = t.fit(docs, labels)
    rows = t.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by = {r.doc_id: r.predicted for r in rows}
    assert by[70] == 1 and by[8] == 0
    assert t.keep(docs, model).columns == docs.columns
    assert t.score(docs.limit(0), model).count() == 0
    none = t.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in t.score(docs, none).collect()} == {0.0}


def test_a_phrase_of_ordinary_words_is_evidence(spark):
    """Both classes have the same words as often; two of them stand in one order in toxic texts, and in the other in ordinary ones."""
    rng = np.random.default_rng(2)

    def text(toxic):
        parts = rng.choice([f"w{k}" for k in range(30)], 40).tolist()
        at = int(rng.integers(1, 38))
        return " ".join(parts[:at] + (["blue", "moon"] if toxic else ["moon", "blue"]) + parts[at:])

    rows = [(k, text(k % 2), k % 2) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = t.score(docs, t.fit(docs, docs)).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[[zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]]
    assert len(held) > 200 and (held.toxic == held.predicted).mean() > 0.95


def test_pair_discounts_come_from_the_counts():
    once = pa.table({"label": [0, 1], "n1": [60, 10], "n2": [20, 0]})
    assert t.pair_discounts(once) == (0.6, t.MOST_DISCOUNT)
    assert t.pair_discounts(once.slice(0, 0)) == (t.LEAST_DISCOUNT, t.LEAST_DISCOUNT)


class Plain:
    """The model as the docstring has it, with dictionaries."""

    def __init__(self, texts, labels):
        grams = {(c, *g) for t, c in zip(texts, labels) for w in [t.split()] for g in zip(["<", "<", *w], ["<", *w], w)}
        self.n = {}
        for c, _, h, w in grams:
            self.n[c, h, w] = self.n.get((c, h, w), 0) + 1
        self.cont, stems, self.total, self.kinds = {}, set(), {}, {}
        for (c, h, w), n in self.n.items():
            self.cont[c, w] = self.cont.get((c, w), 0) + 1
            stems.add((c, h, w[: t_stem()]))
            self.total[c, h] = self.total.get((c, h), 0) + n
            self.kinds[c, h] = self.kinds.get((c, h), 0) + 1
        self.of = {}
        for c, _, s in stems:
            self.of[c, s] = self.of.get((c, s), 0) + 1
        once = [{n: sum(v == n for (k, *_), v in self.n.items() if k == c) for n in (1, 2)} for c in (0, 1)]
        self.discount = [min(t.MOST_DISCOUNT, max(t.LEAST_DISCOUNT, o[1] / max(1, o[1] + 2 * o[2]))) for o in once]

    def stem_p(self, c, s):
        total, d = sum(v for (k, _), v in self.of.items() if k == c), t.WORD_DISCOUNT
        freed = sum(min(v, d) for (k, _), v in self.of.items() if k == c) / total
        classes = sum((k, s) in self.of for k in (0, 1)) or 1
        return max(self.of.get((c, s), 0) - d, 0) / total + freed * classes / (len(self.of) + 1)

    def word_p(self, c, w):
        total, d, s = sum(v for (k, _), v in self.cont.items() if k == c), t.WORD_DISCOUNT, w[: t_stem()]
        freed = sum(min(v, d) for (k, _), v in self.cont.items() if k == c) / total
        classes = sum((k, w) in self.cont for k in (0, 1)) or 1
        of_stem = sum(v[: t_stem()] == s for _, v in self.cont) + 1
        return max(self.cont.get((c, w), 0) - d, 0) / total + freed * self.stem_p(c, s) * classes / of_stem

    def pair_p(self, c, h, w):
        if (c, h) not in self.total:
            return self.word_p(c, w)
        d = self.discount[c]
        return max(self.n.get((c, h, w), 0) - d, 0) / self.total[c, h] + d * self.kinds[c, h] / self.total[c, h] * self.word_p(c, w)

    def evidence(self, text):
        w = text.split()
        words_ = [np.log(self.word_p(1, x) / self.word_p(0, x)) for x in w]
        pairs = [np.log(self.pair_p(1, h, x) / self.pair_p(0, h, x)) for h, x in zip(["<", *w], w)]
        best = lambda v: max(np.mean(v[max(0, k + 1 - t.WINDOW) : k + 1]) for k in range(min(t.WINDOW, len(v)) - 1, len(v)))
        return [np.mean(words_), best(words_), np.mean(pairs), best(pairs)]


def t_stem():
    return t.STEM


def test_evidence_equals_a_plain_scorer(spark):
    rng = np.random.default_rng(5)
    kinds = [f"{a}{b}" for a in ("stemone", "stemtwo", "x", "other") for b in range(8)]
    texts = [" ".join(rng.choice(kinds, int(rng.integers(1, 30)), p=None if k % 2 else np.arange(1, 33) / 528)) for k in range(60)]
    labels = [k % 2 for k in range(60)]
    plain = Plain(texts, labels)
    model = t._counts(spark.createDataFrame(list(zip(texts, labels)), "text string, label int"))
    new = [" ".join(rng.choice([*kinds, "stemone99", "unknown", "stemtwo77"], 12)) for _ in range(40)]
    got = model.evidence(texts + new)
    want = np.array([plain.evidence(x) for x in texts + new])
    assert np.allclose(got, want, atol=1e-4), [(k, got[k], want[k], (texts + new)[k]) for k in np.flatnonzero(np.abs(got - want).max(axis=1) > 1e-4)[:3]]
