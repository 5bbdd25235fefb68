"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

A document's features are its distinct words, hashed to WORD_SPACE places and weighted to length 1, one place for the quantile bin of each
structure statistic of its whole text, and one for the bin of each metadata number (n_chars; a missing one has a place of its own).
Every pair of features interacts through a product of RANK-dimensional factors, scored in linear time by the sum-of-squares identity:
sum over i<j of <v_i, v_j> x_i x_j = half of sum over f of (sum v_if x_i)^2 - sum (v_if x_i)^2.

The machine is fitted on a bounded sample (PER_CLASS documents of each class, those with the smallest seeded hashes). Scoring is one
narrow pass over every whole text; the model that is broadcast has a fixed size.

Defined cases: a null text is an empty one, and has only statistics; repeated rows are scored alike, each once, and learnt from once (of different texts of an id, from the smallest); an empty table gives no
rows; without labelled rows of both classes every score is 1, so nothing is rejected. Labels, lang, source and doc_id are never inputs,
and columns other than doc_id, text and the metadata are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm import words
from blockmill.llm.common import fold, labelled_sample, slices, table

PER_CLASS = 2000
SEED = 29
WORD_SPACE = 1 << 15
RANK = 4
BINS = 12
METADATA = ("n_chars",)
THRESHOLD = 0.3

#: byte classes whose shares are statistics: upper case, digits, white space, line ends, !?, other ASCII signs, non-ASCII
CLASSES = [[*range(65, 91)], [*range(48, 58)], [32, 9], [10, 13], [33, 63], [*range(34, 39), *range(42, 44), 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)], [*range(128, 256)]]
STATS = [*(f"share{k}" for k in range(len(CLASSES))), "log_words", "word_bytes", "distinct", "repeats", "top", "line_bytes", "line_repeats"]


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """stats (texts x STATS), then the sparse words: index pointer, hashed place, weight (each text's squares sum to 1)."""
    stats = np.zeros((len(texts), len(STATS)))
    counts, places, weights = np.zeros(len(texts), np.int64), [], []
    for a, b, data, starts in words.blocks(texts, lower=False):
        size = np.maximum(np.diff(starts) - 1, 1)
        low = data.copy()
        upper = (data >= 65) & (data <= 90)
        low[upper] += 32
        h, first, length = words.hashes(low, starts)
        n = np.diff(first)
        doc = np.repeat(np.arange(b - a), n)
        x = stats[a:b]
        for k, codes in enumerate(CLASSES):
            is_in = np.zeros(256, np.int64)
            is_in[codes] = 1
            x[:, k] = (np.add.reduceat(is_in[data], starts[:-1]) - (32 in codes)) / size
        x[:, 7] = np.log1p(n)
        x[:, 8] = np.bincount(doc, length, b - a) / np.maximum(n, 1)
        key = (doc.astype(np.uint64) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))
        distinct, times = np.unique(key, return_counts=True)
        of = (distinct >> np.uint64(32)).astype(np.int64)
        kinds = np.bincount(of, minlength=b - a)
        x[:, 9] = kinds / np.maximum(n, 1)
        if len(h):
            again = np.zeros(len(h))
            again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
            x[:, 10] = np.bincount(doc, again, b - a) / np.maximum(n, 1)
            top = np.zeros(b - a)
            np.maximum.at(top, of, times)
            x[:, 11] = top / np.maximum(n, 1)
        # lines by their words: the hash of a line is the sum of its words' mixed with their places
        ends = np.flatnonzero(data == 10)
        lines = np.bincount(np.searchsorted(starts, ends, "right") - 1, minlength=b - a) + 1
        x[:, 12] = np.log(size / lines)
        if len(h):
            begin = np.flatnonzero(np.diff(words.WORD[low], prepend=np.uint8(0)) == 1)
            line = np.searchsorted(ends, begin) + doc  # no line spans two texts
            edge = np.flatnonzero(np.diff(line, prepend=-1))
            with np.errstate(over="ignore"):
                total = np.add.reduceat(words.mix(h + np.arange(len(h), dtype=np.uint64) - np.repeat(edge, np.diff(np.append(edge, len(h)))).astype(np.uint64)), edge)
            of_line = doc[edge]
            unique = np.unique(np.stack([of_line.astype(np.uint64), total]), axis=1)[0].astype(np.int64)
            full = np.bincount(of_line, minlength=b - a)
            x[:, 13] = 1 - np.bincount(unique, minlength=b - a) / np.maximum(full, 1)
        w = np.log1p(times)
        norm = np.sqrt(np.bincount(of, w * w, b - a))
        counts[a:b] = kinds
        places.append((distinct & np.uint64(WORD_SPACE - 1)).astype(np.int64))
        weights.append(w / norm[of])
    none = np.empty(0)
    return stats, np.concatenate([[0], np.cumsum(counts)]), np.concatenate(places or [none]).astype(np.int64), np.concatenate(weights or [none])


@dataclass
class Machine:
    cuts: np.ndarray | None = None  # (STATS + METADATA) x (BINS - 1) quantiles
    bias: float = 0.0
    linear: np.ndarray | None = None
    factors: np.ndarray | None = None

    def rows(self, texts: list[str | None], metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pointer, place and value of all features; metadata: texts x METADATA, nan where missing."""
        stats, ptr, place, value = features(texts)
        dense = np.column_stack([stats, metadata])
        d = dense.shape[1]
        own = np.column_stack([np.where(np.isnan(dense[:, k]), BINS, np.searchsorted(self.cuts[k], dense[:, k], "right")) for k in range(d)])
        own = WORD_SPACE + np.arange(d) * (BINS + 1) + own
        n = np.diff(ptr)
        out = ptr + d * np.arange(len(ptr))
        places, values = np.empty(out[-1], np.int64), np.ones(out[-1])
        at = np.repeat(out[:-1], n) + np.arange(ptr[-1]) - np.repeat(ptr[:-1], n)
        places[at], values[at] = place, value
        places[(out[:-1] + n)[:, None] + np.arange(d)] = own
        return out, places, values

    def margins(self, ptr: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        vx = self.factors[place] * value[:, None]
        s = np.add.reduceat(vx, ptr[:-1])
        return self.bias + np.add.reduceat(self.linear[place] * value, ptr[:-1]) + 0.5 * ((s * s).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), ptr[:-1]))

    def scores(self, texts: list[str | None], metadata: np.ndarray) -> np.ndarray:
        if self.linear is None:
            return np.ones(len(texts))
        out = np.empty(len(texts))
        for k in range(0, len(texts), 256):
            part = slice(k, k + 256)
            if len(texts[part]):
                out[part] = 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(texts[part], metadata[part])), -500, 500)))
        return out


def fit_machine(texts: list[str | None], metadata: np.ndarray, y: np.ndarray, epochs: int = 4, rate: float = 0.1, ridge: float = 1e-4, seed: int = SEED) -> Machine:
    """Adagrad over seeded minibatches of the log loss; classes count as they occur in y."""
    m = Machine()
    if not len(y) or y.min() == y.max():
        return m
    stats = np.concatenate([features(texts[k : k + 512])[0] for k in range(0, len(texts), 512)])
    dense = np.column_stack([stats, metadata])
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    m.cuts = np.stack([np.quantile(c[~np.isnan(c)], grid) if (~np.isnan(c)).any() else np.zeros(BINS - 1) for c in dense.T])
    rng = np.random.default_rng(seed)
    space = WORD_SPACE + dense.shape[1] * (BINS + 1)
    m.bias = float(np.log(y.mean() / (1 - y.mean())))
    m.linear, m.factors = np.zeros(space), rng.normal(0, 0.02, (space, RANK))
    seen_w, seen_v, seen_b = np.full(space, 1e-4), np.full((space, RANK), 1e-4), 1e-4
    ptr, place, value = m.rows(texts, metadata)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for k in range(0, len(y), 32):
            ids = order[k : k + 32]
            n = ptr[ids + 1] - ptr[ids]
            at = np.repeat(ptr[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own, p, x = np.concatenate([[0], np.cumsum(n)]), place[at], value[at]
            g = (1 / (1 + np.exp(-np.clip(m.margins(own, p, x), -500, 500))) - y[ids]) / len(ids)
            row = np.repeat(np.arange(len(ids)), n)
            v = m.factors[p]
            s = np.add.reduceat(v * x[:, None], own[:-1])[row]
            uniq, inv = np.unique(p, return_inverse=True)
            gx = g[row] * x
            gw = np.bincount(inv, gx, len(uniq)) + ridge * m.linear[uniq]
            gv = np.stack([np.bincount(inv, gx * (s[:, f] - v[:, f] * x), len(uniq)) for f in range(RANK)], axis=1) + ridge * m.factors[uniq]
            seen_w[uniq] += gw * gw
            seen_v[uniq] += gv * gv
            seen_b += g.sum() ** 2
            m.linear[uniq] -= rate * gw / np.sqrt(seen_w[uniq])
            m.factors[uniq] -= rate * gv / np.sqrt(seen_v[uniq])
            m.bias -= rate * g.sum() / np.sqrt(seen_b)
    m.linear, m.factors = m.linear.astype(np.float32), m.factors.astype(np.float32)
    return m


def _metadata(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    names = batch.schema.names
    cols = [np.asarray(batch.column(names.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False), float) if c in names else np.full(batch.num_rows, np.nan) for c in METADATA]
    return np.log1p(np.maximum(np.column_stack(cols), 0))


def _inputs(docs: DataFrame) -> list:
    return ["text", *(F.col(c).cast("double").alias(c) for c in METADATA if c in docs.columns)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> Machine:
    """docs: doc_id, text and METADATA. labels: doc_id, quality. At most per_class labelled documents of each class outside fold 0."""
    ids = labelled_sample(labels, "quality", per_class, seed)
    rows = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(ids), "doc_id")
    inputs = F.struct("text", *(c for c in METADATA if c in docs.columns))
    rows = rows.groupBy("doc_id", "label").agg(F.min(inputs).alias("r")).select("doc_id", "label", "r.*").toArrow()  # at most 2 * per_class rows
    rows = rows.sort_by("doc_id")
    return fit_machine(rows["text"].to_pylist(), _metadata(rows), rows["label"].to_numpy().astype(float), seed=seed)


def score(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: good), predicted (1 if score >= threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = shared.value.scores(batch["text"].to_pylist(), _metadata(batch))
            yield pa.record_batch([batch["doc_id"], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)).mapInArrow(run, "doc_id long, score double, predicted int")


def keep(docs: DataFrame, model: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(shared.value.scores(batch["text"].to_pylist(), _metadata(batch)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")
