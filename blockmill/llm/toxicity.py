"""Toxicity by class-conditional Kneser-Ney bigram models.

A toxic and an ordinary model, each interpolated: class bigrams, counted by their distinct predecessors (so copies of a text count
once), back off to the class's continuation counts of words, and those to counts that both classes share: in how many classes a word
occurs, the class being the context. An expression that a class has seen rarely or never thus gets much the same chance from both.
Pairs have an absolute discount below 1 that each class's counts give, n1 / (n1 + 2 n2), so every pair that a class has seen counts.
A text's evidence is the difference of the two log-likelihoods, normalised by length, over the whole text and over its most telling
WINDOW words in a row, of the word level alone and with the pairs: pairs seen once are many and say little, words are few and say much, so
a logistic curve, fitted on a fold that the counts have not seen, weighs the four numbers and turns them into a score. The counts
that score are then those of all folds but the held-out one.

The labels may be fitted on a bounded sample (PER_CLASS documents of each class, those with the smallest seeded hashes), so the model
that is broadcast is bounded by that sample. Scoring covers every whole text in one narrow pass.

Defined cases: a null text is an empty one; a text without words has evidence 0 and gets the curve's value there; repeated rows are
scored alike, each once, and learnt from once; an empty table gives no rows; without labelled rows of both classes every score is 0.
Extra columns of the input, whatever their names, are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm import words
from blockmill.llm.common import fold, labelled_sample, release, slices, staged, table

PER_CLASS = 2000
SEED = 11
CALIBRATE = 4  # the fold that fits the curve; folds 1 to 3 give the counts
#: Absolute discount of words: what a class count gives to the shared counts. Counts up to the discount are left to them altogether.
WORD_DISCOUNT = 3.0
LEAST_DISCOUNT, MOST_DISCOUNT = 0.05, 0.95  # of pairs, where too few counts are there to estimate it
STEM = 5  # bytes of a word that its stem keeps
WINDOW = 2
START = np.uint64(0)
PAIR = np.uint64(0xD6E8FEB86659FD93)
FEATURES = ("whole", "best", "pairs_whole", "pairs_best")


def pair_keys(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mix(h * PAIR + w)


def previous(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each word's predecessor in its own text; START before the first."""
    prev = np.empty_like(h)
    prev[1:] = h[:-1]
    prev[first[:-1][first[:-1] < len(h)]] = START
    return prev


@dataclass
class Evidence:
    """log p(word | toxic) - log p(word | ordinary), as sorted tables."""

    word: np.ndarray  # sorted word hashes
    unigram: np.ndarray  # difference of the class models without a predecessor
    backoff: np.ndarray  # difference of the log backoff weights after this word
    start: float  # the same for START
    stem: np.ndarray  # sorted stem hashes
    unseen: np.ndarray  # the difference for a new word of that stem
    unknown: float  # for a word whose stem is new as well
    pair: np.ndarray  # sorted keys of the pairs that a class has seen
    value: np.ndarray  # the difference for those
    curve: np.ndarray | None = None  # weights of the evidence, the last one the offset

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text the mean of its words' differences, and the largest mean over WINDOW words in a row (all, if it has fewer);
        then the same two with the pairs."""
        out = np.zeros((len(texts), 4))
        if not len(self.word):
            return out
        for a, b, data, starts in words.blocks(texts):
            h, first, stems = words.hashes(data, starts, stem=STEM)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(self.word, h), len(self.word) - 1)
            known = self.word[at] == h
            uni = self.unigram[at].astype(float)
            new = np.flatnonzero(~known)
            of = np.minimum(np.searchsorted(self.stem, stems[new]), len(self.stem) - 1)
            uni[new] = np.where(self.stem[of] == stems[new], self.unseen[of], self.unknown)
            bow = np.where(known, self.backoff[at], 0.0)
            back = np.empty_like(bow)
            back[1:] = bow[:-1]
            prev_known = np.empty(len(h), bool)
            prev_known[1:] = known[:-1]
            heads = first[:-1][first[:-1] < len(h)]
            back[heads] = self.start
            prev_known[heads] = True
            value = uni + back
            both = np.flatnonzero(known & prev_known)
            if len(self.pair):
                keys = pair_keys(previous(h, first)[both], h[both])
                hit = np.minimum(np.searchsorted(self.pair, keys), len(self.pair) - 1)
                seen = self.pair[hit] == keys
                value[both[seen]] = self.value[hit[seen]]
            n = np.diff(first)
            doc = np.repeat(np.arange(len(n)), n)
            # the window that ends at each word begins at most WINDOW words before, and never before its text
            ends = np.arange(1, len(h) + 1)
            begin = np.maximum(ends - WINDOW, first[doc])
            full = n > 0
            for k, v in ((0, uni), (2, value)):
                total = np.concatenate([[0.0], np.cumsum(v)])
                out[a:b, k] = (total[first[1:]] - total[first[:-1]]) / np.maximum(n, 1)
                mean = (total[ends] - total[begin]) / np.minimum(WINDOW, n[doc])
                mean[ends - begin < np.minimum(WINDOW, n[doc])] = -np.inf  # a text's first words, where longer windows follow
                out[a:b, k + 1][full] = np.maximum.reduceat(mean, first[:-1][full])
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        x = self.evidence(texts)
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -700, 700)))


def discounted(count: np.ndarray, discount: float, below: np.ndarray) -> tuple[np.ndarray, float]:
    """One interpolated level: counts less their discount, and the mass so freed, dealt out as below says."""
    total = max(1.0, count.sum())
    freed = np.minimum(count, discount).sum() / total if count.sum() else 1.0
    return np.maximum(count - discount, 0) / total + freed * below, freed


def pair_discounts(once_: pa.Table) -> tuple[float, float]:
    """n1 / (n1 + 2 n2) of each class. once_: label, n1, n2, how many pairs have a count of 1, and of 2."""
    found = [LEAST_DISCOUNT, LEAST_DISCOUNT]
    for r in once_.to_pylist():
        found[r["label"]] = min(MOST_DISCOUNT, max(LEAST_DISCOUNT, r["n1"] / max(1, r["n1"] + 2 * r["n2"])))
    return found[0], found[1]


def fit_counts(words_: pa.Table, stems_: pa.Table, heads_: pa.Table, pairs_: pa.Table, discounts: tuple[float, float]) -> Evidence:
    """Counts of distinct words before a pair (h, w), by label, already summed.

    words_: label, w, its stem s, and cont, the pairs that end in w. stems_: label, s, and cont, the distinct h before it. heads_: label, h,
    total of its pairs' counts and kinds, how many pairs those are. pairs_: label, h, w, n. discounts: of a pair, by label.
    """
    none, no_keys = np.empty(0), np.empty(0, np.uint64)
    keys = lambda t, k: t[k].to_numpy().astype(np.int64).view(np.uint64)
    label = words_["label"].to_numpy()
    if not ((label == 1).any() and (label == 0).any()):
        return Evidence(no_keys, none, none, 0.0, no_keys, none, 0.0, no_keys, none)
    vocab, one, wi = np.unique(keys(words_, "w"), return_index=True, return_inverse=True)
    stems, si = np.unique(keys(stems_, "s"), return_inverse=True)
    heads, hi = np.unique(keys(heads_, "h"), return_inverse=True)
    of = np.searchsorted(stems, keys(words_, "s")[one])  # each word's stem
    shared_stem, stem_new = np.bincount(si).astype(float), 1.0  # classes that have it
    all_stems = shared_stem.sum() + stem_new
    shared_word = np.bincount(wi).astype(float)
    of_stem = np.bincount(of, shared_word, len(stems)) + 1  # one for words of the stem yet to come
    h, w = keys(pairs_, "h"), keys(pairs_, "w")
    pairs, first, inv = np.unique(pair_keys(h, w), return_index=True, return_inverse=True)
    ph, pw = np.searchsorted(heads, h[first]), np.searchsorted(vocab, w[first])
    uni, unseen, unknown, weight, pair_p = [], [], [], [], []
    for c in (0, 1):
        spread = lambda t, i, k, size, c=c: np.bincount(i[t["label"].to_numpy() == c], t[k].to_numpy()[t["label"].to_numpy() == c], size)
        stem_p, stem_freed = discounted(spread(stems_, si, "cont", len(stems)), WORD_DISCOUNT, shared_stem / all_stems)
        word_p, freed = discounted(spread(words_, wi, "cont", len(vocab)), WORD_DISCOUNT, stem_p[of] * shared_word / of_stem[of])
        total = spread(heads_, hi, "total", len(heads))
        lam = np.where(total > 0, discounts[c] * spread(heads_, hi, "kinds", len(heads)) / np.maximum(total, 1), 1.0)
        count = spread(pairs_, inv, "n", len(pairs))
        pair_p.append(np.maximum(count - discounts[c], 0) / np.maximum(total[ph], 1) + lam[ph] * word_p[pw])
        uni.append(np.log(word_p))
        unseen.append(np.log(freed * stem_p / of_stem))
        unknown.append(np.log(freed * stem_freed * stem_new / all_stems))
        weight.append(np.log(lam))
    bow = weight[1] - weight[0]
    at = np.minimum(np.searchsorted(heads, vocab), len(heads) - 1)
    return Evidence(
        vocab,
        (uni[1] - uni[0]).astype(np.float32),
        np.where(heads[at] == vocab, bow[at], 0.0).astype(np.float32),
        float(bow[np.searchsorted(heads, START)]) if (heads == START).any() else 0.0,
        stems,
        (unseen[1] - unseen[0]).astype(np.float32),
        float(unknown[1] - unknown[0]),
        pairs,
        np.log(pair_p[1] / pair_p[0]).astype(np.float32),
    )


def fit_curve(x: np.ndarray, y: np.ndarray) -> np.ndarray | None:
    """Logistic regression by Newton steps, both classes weighing alike; a weak prior keeps it finite where they can be parted."""
    if not len(x) or y.min() == y.max():
        return None
    mid, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mid) / scale, np.ones(len(x))])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w, prior = np.zeros(z.shape[1]), np.array([0.1] * x.shape[1] + [1e-6])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(prior), z.T @ (weight * (p - y)) + prior * w)
        w = w - step
        if abs(step).max() < 1e-8:
            break
    return np.append(w[:-1] / scale, w[-1] - (w[:-1] * mid / scale).sum())


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        label = np.asarray(batch["label"].to_numpy(zero_copy_only=False))
        texts = batch["text"].to_pylist()
        for a, b, data, starts in words.blocks(texts):
            h, first, stems = words.hashes(data, starts, stem=STEM)
            prev = previous(h, first)
            lead = previous(prev, first)
            of = np.repeat(label[a:b], np.diff(first))
            _, once = np.unique(pair_keys(lead, pair_keys(prev, h)) ^ of.astype(np.uint64), return_index=True)
            yield pa.record_batch(
                [pa.array(of[once].astype(np.int32)), *(pa.array(x[once].view(np.int64)) for x in (lead, prev, h, stems))],
                names=["label", "g", "h", "w", "s"],
            )


def _counts(rows: DataFrame) -> Evidence:
    """The counts are summed on the executors; what the driver gets is bounded by the sample's words."""
    pairs = staged(
        rows.select("label", "text")
        .mapInArrow(_triples, "label int, g long, h long, w long, s long")
        .distinct()
        .groupBy("label", "h", "w", "s")
        .agg(F.count("*").alias("n")),
        "toxicity-pairs",
    )
    once = pairs.groupBy("label").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
    return fit_counts(
        pairs.groupBy("label", "w").agg(F.min("s").alias("s"), F.count("*").alias("cont")).toArrow(),
        pairs.select("label", "h", "s").distinct().groupBy("label", "s").agg(F.count("*").alias("cont")).toArrow(),
        pairs.groupBy("label", "h").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).toArrow(),
        pairs.select("label", "h", "w", F.col("n").cast("int").alias("n")).toArrow(),
        pair_discounts(once.toArrow()),
    )


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Evidence:
    """docs: doc_id, text. labels: doc_id, toxic. Learns from at most per_class labelled documents of each class outside fold 0."""
    ids = labelled_sample(labels, "toxic", per_class, seed)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").distinct()  # at most 2 * per_class ids
    rows = staged(rows, "toxicity-sample")
    model = _counts(rows.where(F.col("fold") != CALIBRATE))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = shared.value.evidence(batch["text"].to_pylist())
            yield pa.record_batch([batch["label"], *(pa.array(x[:, k]) for k in range(4))], names=["label", *FEATURES])

    held = rows.where(F.col("fold") == CALIBRATE).select("label", "text").mapInArrow(evidence, ", ".join(["label int", *(f"{k} double" for k in FEATURES)])).toArrow()
    curve = fit_curve(np.column_stack([held[k].to_numpy() for k in FEATURES]), held["label"].to_numpy())
    shared.destroy()
    del model, shared  # the driver holds one model at a time
    whole = _counts(rows)  # the curve is fitted; the counts may now have all folds
    whole.curve = curve
    release(rows)
    return whole


def score(docs: DataFrame, model: Evidence, threshold: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: toxic), predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.scores(batch["text"].to_pylist())
            yield pa.record_batch([batch["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Evidence, threshold: float = 0.5) -> DataFrame:
    """The documents whose score is below threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(batch["text"].to_pylist()) < threshold))

    return docs.mapInArrow(run, docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
