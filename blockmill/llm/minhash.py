"""Near-duplicates by Order MinHash, verified by a banded edit alignment.

A document's k-mers are its shingles of K words, each labelled with its occurrence number in the text. One sketch takes the PICK labelled
k-mers with the smallest seeded hashes and keeps them in text order, so it answers to edit similarity rather than to shared k-mers alone.
BANDS sketches are the keys under which documents meet. A pair that shares a part j of its k-mers has a sketch in common with probability of
about 1 - (1 - j * j) ** BANDS: 0.996 at j = 0.4, which some 9 in 100 scattered words replaced leave, and 0.95 at 0.3.

Similarity of two texts: the words of their best alignment (the longest common subsequence), divided by the words of the longer text. A
replaced, inserted or dropped word costs one word, not the K shingles that hold it; a passage that moved counts as changed. A pair links at
THRESHOLD or more. The alignment is exact though banded: at that similarity no more words can be left out on either side than bounds how far
off the diagonal a match may lie. Rows of the alignment are bits of one whole number, so a step handles all of the band at once.

One pass over the texts writes all that the rest needs: two hashes of the word sequence, the band keys, and the words as 32-bit hashes (the
alignment compares those). Texts are not read again. Of a doc_id's rows one is kept, that of the smallest hashes, throughout.

Equal word sequences are one class: only its smallest doc_id meets others. In each bucket every member is aligned with CENTRES members of
the smallest seeded hashes (fewer, where one has several), unless their lengths rule the link out. Buckets that are of one component then
need no further pair, so a group of m copies costs of the order of m pairs. Where a bucket that this leaves pairs of still holds several
components, its members meet in cells: tasks of one or two blocks of the bucket, bounded in members (BLOCK) and in words (BLOCK_WORDS), which count
the words that each text shares with all others at once and align what the count lets pass. Buckets of more than LARGE members, a passage that
a large part of a corpus holds, say, would make too many cells. Their members go by rare pairs of neighbouring words: texts that link share
so many of those that they share one of the rarest of either's (see rare()), rarity being counted over the members of all such buckets, and
those of one component alone are no candidates. Members that share one are aligned; only one of more than HOT members is not expanded, and
its members go to cells as above. So no candidate pair that could join two components is left out, and nothing is capped. Links and
components never reach the driver.

Defined cases: texts without words (null, empty, signs only) link with nothing; texts of fewer than K words have one k-mer, all their
words; rows with a null doc_id are left out of the classes; repeated rows of a doc_id count as one, and if their texts differ it is classed by
one of them, one with words if there is any; an empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from blockmill.llm import words
from blockmill.llm.common import components, fresh, release, slices, small, staged, table

K = 5
PICK = 2
ROWS = 1
BANDS = 32
CENTRES = 4
BLOCK = 4096
BLOCK_WORDS = 1 << 21
HOT = 64
LARGE = 4096
THRESHOLD = 0.8
SEED = 7
WIDE = 2048  # k-mers hashed at a time
STEP = np.uint64(0x9FB21C651E98DF25)


def kmers(h: np.ndarray, k: int = K) -> np.ndarray:
    """Labelled k-mer hashes of a text's word hashes, in text order and all distinct."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    with np.errstate(over="ignore"):
        x = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            x = x * STEP + h[i : n - k + 1 + i]
        x = words.mix(x + np.uint64(k))
        order = np.argsort(x, kind="stable")
        s = x[order]
        new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        if len(new) == len(x):
            return x
        nth = np.empty(len(x), np.uint64)
        nth[order] = (np.arange(len(x)) - np.repeat(new, np.diff(np.append(new, len(x))))).astype(np.uint64)
        return np.where(nth > 0, words.mix(x ^ (nth * STEP)), x)


def seeds(n: int, seed: int = SEED) -> np.ndarray:
    with np.errstate(over="ignore"):
        return words.mix(np.arange(1, n + 1, dtype=np.uint64) * STEP + np.uint64(seed))


def _least(x: np.ndarray, s: np.ndarray, pick: int) -> tuple[np.ndarray, np.ndarray]:
    """For each seed the places in x of its pick smallest hashes, and those hashes."""
    y = (x[None, :] ^ s[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    y ^= y >> np.uint64(32)
    y *= np.uint64(0x94D049BB133111EB)
    each, at, value = np.arange(len(s)), [], []
    for _ in range(min(pick, len(x))):
        i = y.argmin(axis=1)
        at.append(i)
        value.append(y[each, i])
        y[each, i] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return np.stack(at, axis=1), np.stack(value, axis=1)


def band_keys(x: np.ndarray, bands: int = BANDS, rows: int = ROWS, pick: int = PICK) -> np.ndarray:
    """The band keys of a text's labelled k-mers (0 for none)."""
    if not len(x):
        return np.zeros(bands, np.uint64)
    s = seeds(bands * rows)
    with np.errstate(over="ignore"):
        at, value = _least(x[:WIDE], s, pick)
        for k in range(WIDE, len(x), WIDE):
            more = _least(x[k : k + WIDE], s, pick)
            value = np.concatenate([value, more[1]], axis=1)
            at = np.concatenate([at, more[0] + k], axis=1)
            best = np.argsort(value, axis=1, kind="stable")[:, :pick]
            at, value = np.take_along_axis(at, best, 1), np.take_along_axis(value, best, 1)
        chosen = x[np.sort(at, axis=1)]  # in text order
        key = np.zeros(len(s), np.uint64)
        for k in range(chosen.shape[1]):
            key = words.mix(key * STEP + chosen[:, k])
        key = key.reshape(bands, rows)
        out = np.arange(bands, dtype=np.uint64)
        for k in range(rows):
            out = words.mix(out * STEP + key[:, k])
        return out


def labelled(w: np.ndarray) -> np.ndarray:
    """Words with their occurrence numbers, ascending; two texts' common ones are the words that they share, repeats counted."""
    return np.sort(kmers(w, 1))


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two ascending arrays of distinct values share."""
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def aligned(a: np.ndarray, b: np.ndarray, least: int) -> int:
    """Words of the longest common subsequence; any number below least may come out as a smaller one.

    Bit j of v is 0 where the alignment of the words so far grows at the j-th of b. With least words matched, len(a) - least of a and
    len(b) - least of b are left out, which bounds the band.
    """
    n, m = len(a), len(b)
    if min(n, m) < least:
        return 0
    left, right = n - least, m - least
    places: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << m) - 1
    v, banded, wide = full, left + right + 1 < m, (1 << (left + right + 1)) - 1
    for i, w in enumerate(a.tolist()):
        match = places.get(w)
        if match is None:
            continue
        if banded:
            match &= wide << (i - left) if i >= left else wide >> (left - i)
        u = v & match
        v = ((v + u) | (v - u)) & full
    return m - v.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """Of two texts' words; any value below threshold may come out as a smaller one."""
    n, m = len(a), len(b)
    most = max(n, m)
    if not n or not m or min(n, m) < threshold * most - 1e-9:
        return 0.0
    # what they begin and end with alike is aligned as it stands
    k = min(n, m)
    apart = np.flatnonzero(a[:k] != b[:k])
    head = int(apart[0]) if len(apart) else k
    a, b = a[head:], b[head:]
    k = min(len(a), len(b))
    apart = np.flatnonzero(a[len(a) - k :][::-1] != b[len(b) - k :][::-1])
    tail = int(apart[0]) if len(apart) else k
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    least = int(np.ceil(threshold * most - 1e-9)) - head - tail
    if min(len(a), len(b)) < least or (least > 0 and common(labelled(a), labelled(b)) < least):
        return 0.0
    return (head + tail + aligned(a, b, max(0, least))) / most


def _each(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text."""
    for a, b, data, starts in words.blocks(texts):
        h, first, _ = words.hashes(data, starts)
        for k in range(b - a):
            yield h[first[k] : first[k + 1]]


def short(h: np.ndarray) -> bytes:
    """Word hashes as they are kept."""
    return (h >> np.uint64(32)).astype(np.uint32).tobytes()


def unpacked(packed: bytes) -> np.ndarray:
    """Words that are kept."""
    return np.frombuffer(packed, np.uint32).astype(np.uint64)


PRINTS = "doc_id long, h1 long, h2 long, n_words long, bands array<long>, words binary"


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, two hashes of the whole word sequence (null without words), how many words, the band keys, and the words."""
    for batch in slices(batches):
        one, two, n, keys, packed = [], [], [], [], []
        with np.errstate(over="ignore"):
            for h in _each(batch["text"].to_pylist()):
                n.append(len(h))
                place = np.arange(len(h), dtype=np.uint64)
                one.append(words.mix(h + place * STEP).sum(dtype=np.uint64))
                two.append(words.mix((h ^ STEP) + place * words.PRIME).sum(dtype=np.uint64))
                packed.append(short(h))
                keys.append(band_keys(kmers(unpacked(packed[-1]))))
        none = np.asarray(n) == 0
        as_long = lambda x: pa.array(np.asarray(x, np.uint64).view(np.int64), mask=none)
        flat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(flat.view(np.int64)))
        yield pa.record_batch([batch["doc_id"], as_long(one), as_long(two), pa.array(n, pa.int64()), bands, pa.array(packed, pa.binary())], names=["doc_id", "h1", "h2", "n_words", "bands", "words"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        ok = [similarity(unpacked(x.as_py()), unpacked(y.as_py())) >= THRESHOLD - 1e-12 for x, y in zip(batch["words_a"], batch["words_b"], strict=True)]
        keep = pa.array(ok, pa.bool_())
        yield pa.record_batch([batch["a"].filter(keep), batch["b"].filter(keep)], names=["src", "dst"])


def links(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts align at THRESHOLD or more, as src, dst."""
    left = packed.select(F.col("doc_id").alias("a"), F.col("words").alias("words_a"))
    right = packed.select(F.col("doc_id").alias("b"), F.col("words").alias("words_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "words_a", "words_b").mapInArrow(_verify, "src long, dst long")


def _across(cell: pd.DataFrame) -> pd.DataFrame:
    """Links that join components within one cell of a bucket: the pairs of its two blocks (or of its one) that share no earlier band.

    Common words are counted for one text against all others at once; that bounds the similarity from above, and what passes is aligned.
    """
    bucket, two = int(cell["bucket"].iloc[0]), int(cell["i"].iloc[0]) != int(cell["j"].iloc[0])
    cell = cell.sort_values("doc_id", kind="stable")
    ids, block = cell["doc_id"].to_numpy(), cell["block"].to_numpy()
    bands = np.stack(cell["bands"].to_numpy())
    band = int(np.flatnonzero(bands[0] == bucket)[0])
    own = [unpacked(w) for w in cell["words"]]
    x = [labelled(w) for w in own]
    size = np.array([len(k) for k in x])
    flat = np.concatenate(x)
    order = np.argsort(flat, kind="stable")
    flat, of = flat[order], np.repeat(np.arange(len(x)), size)[order]
    names, root = np.unique(cell["comp"].to_numpy(), return_inverse=True)
    found = []
    for k in range(len(x)):
        later = np.arange(len(x)) > k
        open_ = later & (root != root[k])
        if two:
            open_ &= block != block[k]
        if not open_.any():
            continue
        open_ &= ~(bands[:, :band] == bands[k, :band]).any(axis=1)
        a, b = np.searchsorted(flat, x[k], "left"), np.searchsorted(flat, x[k], "right")
        n = b - a
        hit = np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        shared = np.bincount(of[hit], minlength=len(x))
        for other in np.flatnonzero(open_ & (shared >= THRESHOLD * np.maximum(size, size[k]) - 1e-9)):
            if root[other] != root[k] and similarity(own[k], own[other]) >= THRESHOLD - 1e-12:
                found.append((ids[k], ids[other]))
                root[root == root[other]] = root[k]
    return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")


PAIR = 2  # neighbouring words


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each labelled pair of neighbouring words of words, with the columns doc_id, comp and n_words, and how many pairs there are."""
    for batch in slices(batches, 128):
        x = [kmers(unpacked(w.as_py()), PAIR) for w in batch["words"]]
        size = np.array([len(k) for k in x], np.int64)
        of = np.repeat(np.arange(len(x)), size)
        own = [batch[c].take(pa.array(of)) for c in ("doc_id", "comp", "n_words")]
        yield pa.record_batch([*own, pa.array(size[of]), pa.array(np.concatenate(x).view(np.int64) if x else [], pa.int64())], names=["doc_id", "comp", "n_words", "n_pairs", "gram"])


def rare(members: DataFrame) -> DataFrame:
    """members: doc_id, comp, n_words, words. Their pairs of neighbouring words (doc_id, comp, n_words, gram, n) that other components have as well and that
    a link may need.

    Of a text of n words a link matches L, THRESHOLD * n or more, of a text of at most L / THRESHOLD words. Matched words stand side by side in
    both texts but where one of them has words that are not matched, so the texts share at least L - 1 - (n - L) - (L / THRESHOLD - L) pairs, which
    is least for the least L. All but so many of either's pairs and one more, the rarest of them, hence hold a shared one. Ordered by how
    many members have them, those of a single component come first: they are no one else's, and count without being listed.
    """
    each = staged(members.mapInArrow(_explode, "doc_id long, comp long, n_words long, n_pairs long, gram long"), "omh-grams")
    counts = each.groupBy("gram").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("gram", "n")
    of = each.join(counts, "gram").groupBy("doc_id", "comp", "n_words", "n_pairs").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("grams"))
    # texts below 1 / (1 - THRESHOLD) words link with equal ones alone
    shared = F.greatest(F.lit(1), F.ceil(F.col("n_words") * (3 * THRESHOLD - 2) - 1 - 1e-6))
    need = F.col("n_pairs") - shared + 1 - (F.col("n_pairs") - F.size("grams"))
    return of.where(need > 0).select("doc_id", "comp", "n_words", F.explode(F.slice("grams", F.lit(1), need.cast("int"))).alias("g")).select("doc_id", "comp", "n_words", "g.gram", "g.n")


def _long_enough(a: str, b: str) -> Column:
    """Whether two numbers of words allow a link."""
    return F.least(a, b) >= THRESHOLD * F.greatest(a, b) - 1e-6


def classes(docs: DataFrame) -> DataFrame:
    """One row per doc_id: class_id long, the smallest doc_id of its group of near-duplicates, kept boolean, and text_id long, the smallest doc_id
    of its word sequence (null without words), by which the links of found() name it."""
    return found(docs)[0]


def found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes, and the links by which they were joined: src and dst long, two text_ids whose texts align at THRESHOLD or more, each pair once.
    Copies are not expanded, nor are all pairs of one component."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    prints = staged(source.mapInArrow(_prints, PRINTS).withColumn("row", F.monotonically_increasing_id()), "omh-prints")
    first = F.struct(F.col("h1").isNull().alias("none"), "h1", "h2", "n_words", "row")
    one = prints.groupBy("doc_id").agg(F.min(first).alias("p")).select("doc_id", "p.h1", "p.h2", "p.n_words", "p.row")
    # hot groups of copies: partial aggregates, then a left join whose large side adaptive execution can split
    reps = staged(one.where("n_words > 0").groupBy("h1", "h2", "n_words").agg(F.min(F.struct("doc_id", "row")).alias("r")).select("h1", "h2", "n_words", F.col("r.doc_id").alias("rep"), F.col("r.row").alias("row")), "omh-reps")
    bands = staged(prints.select("row", "bands").join(reps.select("row", F.col("rep").alias("doc_id"), "n_words"), "row"), "omh-bands")
    flat = bands.select("doc_id", "row", "n_words", F.explode("bands").alias("bucket"))
    # most keys are one document's: they go first, by a count of whole numbers alone
    counts = flat.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = staged(flat.join(counts, "bucket").select("bucket", "n", "doc_id", "row", "n_words"), "omh-met")
    order = [F.struct(F.xxhash64("doc_id", F.lit(SEED + s)).alias("o"), F.col("doc_id"), F.col("n_words"), F.col("row")) for s in range(CENTRES)]
    buckets = met.groupBy("bucket").agg(F.sum("n_words").alias("all_words"), *(F.min(o).alias(f"c{s}") for s, o in enumerate(order)))
    centres = F.array_distinct(F.array(*(F.struct(f"c{s}.doc_id", f"c{s}.n_words", f"c{s}.row") for s in range(CENTRES))))
    members = staged(met.join(buckets.select("bucket", "all_words", centres.alias("centres")), "bucket"), "omh-members")
    stars = (
        members.select(F.col("doc_id").alias("x"), F.col("n_words").alias("nx"), F.col("row").alias("rx"), F.explode("centres").alias("c"))
        .where((F.col("x") != F.col("c.doc_id")) & _long_enough("nx", "c.n_words"))
        .select(F.least("x", "c.doc_id").alias("a"), F.greatest("x", "c.doc_id").alias("b"), F.least("rx", "c.row").alias("r1"), F.greatest("rx", "c.row").alias("r2"))
        .distinct()
    )
    pairs = staged(stars, "omh-stars")
    used = staged(pairs.select(F.explode(F.array("r1", "r2")).alias("row")).distinct(), "omh-used")
    packed = staged(prints.select("row", "doc_id", "words").join(small(used), "row", "left_semi"), "omh-words")
    linked = staged(links(pairs, packed), "omh-links")
    joined = staged(components(linked, "omh-first"), "omh-first-joined")
    # buckets that still hold several components, and more than one member that is no centre (centres may coincide). In all others the star
    # has compared every pair, so a pair of an earlier band was compared there
    gaps = members.where(F.col("n") - F.size("centres") > 1).select("bucket", "n", "all_words", "doc_id", "row", "n_words")
    placed = gaps.join(joined, gaps["doc_id"] == joined["node"], "left").select("bucket", "n", "all_words", "doc_id", "row", "n_words", F.coalesce("component", "doc_id").alias("comp"))
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("bucket")
    apart = staged(placed.join(mixed, "bucket", "left_semi"), "omh-apart")
    ids = staged(apart.select("row", "doc_id", "comp", "n_words").distinct(), "omh-apart-ids")
    own = staged(prints.select("row", "words").join(small(ids), "row"), "omh-apart-words")
    each, more, used_up = apart.where(F.col("n") <= LARGE), [], []
    large = apart.where(F.col("n") > LARGE)
    if not large.isEmpty():
        rares = staged(rare(own.join(large.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "comp", "n_words", "words")), "omh-rare")
        some = rares.where(F.col("n") <= HOT).select("gram", "doc_id", "comp", "n_words")
        other = some.select("gram", F.col("doc_id").alias("b"), F.col("comp").alias("cb"), F.col("n_words").alias("nb"))
        across = some.join(other, "gram").where((F.col("doc_id") < F.col("b")) & (F.col("comp") != F.col("cb")) & _long_enough("n_words", "nb")).select(F.col("doc_id").alias("a"), "b").distinct()
        more.append(staged(links(staged(across, "omh-across"), own), "omh-more"))
        used_up.append(rares)
        each = each.unionByName(large.join(rares.where(F.col("n") > HOT).select("doc_id").distinct(), "doc_id", "left_semi").select(each.columns))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("all_words") / BLOCK_WORDS)).cast("int")
    cells = (
        each.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(SEED)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "doc_id", "comp")
    )
    full = cells.join(own.select("doc_id", "words"), "doc_id").join(bands.select("doc_id", "bands"), "doc_id")
    rest = staged(full.groupBy("bucket", "i", "j").applyInPandas(_across, "src long, dst long"), "omh-rest")
    all_links = reduce(DataFrame.unionByName, [linked, *more, rest])
    edges = staged(all_links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "omh-edges")
    every = staged(components(edges, "omh-all"), "omh-all-joined")
    classed = staged(
        reps.join(every, reps["rep"] == every["node"], "left").select("h1", "h2", "n_words", "rep", F.coalesce("component", "rep").alias("class_id")), "omh-classes"
    )
    slim = staged(one.select("doc_id", "h1", "h2", "n_words"), "omh-slim")
    release(prints, reps, bands, met, members, pairs, used, packed, linked, joined, apart, ids, own, rest, every, *more, *used_up)
    classed_ = slim.join(classed, ["h1", "h2", "n_words"], "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"), F.col("rep").alias("text_id")
    )
    return classed_, edges


def keep(docs: DataFrame) -> DataFrame:
    """One document of each class, with all its columns: every row of doc_ids that classes() keeps, and rows without a doc_id."""
    name = fresh(docs, "gone")
    gone = classes(docs).where("not kept").select(F.col("doc_id").alias(name))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes, and of each text the number of other texts that it was linked with directly."""
    classed, edges = found(table(spark, sf_dir, "documents"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("end")).groupBy("end").agg(F.count("*").alias("n"))
    return classed.join(ends, F.col("text_id") == F.col("end"), "left").select("doc_id", "class_id", "kept", "text_id", F.coalesce("n", F.lit(0)).alias("n_links"))
